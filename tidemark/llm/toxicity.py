"""Toxicity by a counterfactual-regularised classifier.

Features of a text: its lower-cased words and the beginnings of its words, each as log(1 + count); those found in enough documents of the
fit are kept. A logistic regression is fitted on a bounded sample of labelled documents. For each of them that mentions a group, a
counterfactual text has the group's term swapped for the next term of its set; besides the usual loss, the squared difference of both
scores is penalised, so that the naming of a group by itself hardly moves a score.

Scoring covers every whole text in Spark tasks. Null and empty texts get the score of the empty text. Words of any length are read.
Repeated rows are scored each; an empty table gives an empty result; without labels of both kinds the score is the share of toxic labels.
Input columns named like the score's are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import release, sliced


# Sets of interchangeable group terms, in English, Spanish, French and German.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"), ("her", "his"), ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"), ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives", "refugees"),
    ("old", "young"), ("deaf", "blind", "disabled"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("ella", "él"), ("cristianos", "musulmanes", "judíos"), ("inmigrantes", "refugiados"),
    ("femmes", "hommes"), ("femme", "homme"), ("elle", "il"), ("chrétiens", "musulmans", "juifs"), ("immigrés", "réfugiés"),
    ("frauen", "männer"), ("frau", "mann"), ("christen", "muslime", "juden"), ("einwanderer", "flüchtlinge"),
)
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITIES for i, term in enumerate(terms)}
WORD = re.compile(r"[^\W\d_]+")
STARTS = (5, 7)
SAMPLE_ROWS = 6000
SAMPLE_CHARS = 40_000_000
LEAST_DOCUMENTS = 3
DOUBTFUL = 4.0
MOST_FEATURES = 60_000
COUNTERFACTUAL = 100.0  # weight of the penalty


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def features(counts: Counter) -> Counter:
    """Words and word beginnings (marked by a blank; not of group terms) with their counts."""
    found = Counter()
    for word, n in counts.items():
        found[word] += n
        for size in STARTS:
            if len(word) >= size and word not in SWAP:
                found[" " + word[:size]] += n
    return found


def swapped(counts: Counter) -> Counter:
    """The counts of the text with its group terms swapped."""
    other = Counter()
    for word, n in counts.items():
        other[SWAP.get(word, word)] += n
    return other


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[str, float]

    def score(self, counts: Counter) -> float:
        weights = self.weights
        total = Counter()
        for word, n in counts.items():
            if word in weights:
                total[word] += n
            for size in STARTS:
                if len(word) >= size and word not in SWAP and (start := " " + word[:size]) in weights:
                    total[start] += n
        z = self.bias + sum(weights[f] * math.log1p(n) for f, n in sorted(total.items()))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(texts: list[str | None], labels: list[int], l2: float = 2e-3, counterfactual: float = COUNTERFACTUAL, steps: int = 300, rate: float = 0.1) -> Model:
    """Full-batch Adam on loss + l2 * |w|^2 / 2 + counterfactual * mean squared score change over swapped texts.

    A feature under DOUBTFUL standard deviations from chance has its l2 raised by the square of what it lacks.
    """
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-3), 1 - 1e-3)
        return Model(math.log(share / (1 - share)), {})
    seen, toxic, swaps = Counter(), Counter(), []
    for row, (text, label) in enumerate(zip(texts, labels)):
        counts = words(text)
        found = features(counts)
        seen.update(found.keys())
        if label:
            toxic.update(found.keys())
        if any(w in SWAP for w in counts):
            swaps.append(row)
    # the spread of a feature over toxic texts, in standard deviations from chance; what chance may give is regularised more
    share = float(y.mean())
    odds = lambda f: abs(toxic[f] - share * seen[f]) / math.sqrt(seen[f] * share * (1 - share))
    telling = sorted((f for f, n in seen.items() if n >= LEAST_DOCUMENTS), key=lambda f: (-odds(f), f))[:MOST_FEATURES]
    place = {f: i for i, f in enumerate(telling)}
    rows, columns, values = array("q"), array("q"), array("d")
    for row, counts in enumerate(chain((words(t) for t in texts), (swapped(words(texts[i])) for i in swaps))):
        for f, n in features(counts).items():
            if f in place:
                rows.append(row)
                columns.append(place[f])
                values.append(math.log1p(n))
    rows, columns, values = np.frombuffer(rows, np.int64), np.frombuffer(columns, np.int64), np.frombuffer(values)
    total, here, there = len(y) + len(swaps), np.array(swaps, np.int64), len(y) + np.arange(len(swaps))
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both classes count alike
    ridge = l2 * np.array([max(1.0, (DOUBTFUL / max(odds(f), 0.1)) ** 2) for f in telling])
    w, bias = np.zeros(len(place)), math.log(share / (1 - share))
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, steps + 1):
        z = np.bincount(rows, values * w[columns], total) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.zeros(total)
        g[: len(y)] = weight * (p[: len(y)] - y) / len(y)
        if swaps:
            change = 2 * counterfactual * (p[here] - p[there]) / len(swaps)
            np.add.at(g, here, change * p[here] * (1 - p[here]))
            g[there] -= change * p[there] * (1 - p[there])
        gradient = np.append(np.bincount(columns, values * g[rows], len(place)) + ridge * w, g.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights = {f: float(w[i]) for f, i in place.items()}
    return Model(float(bias), {f: round(x, 9) for f, x in weights.items() if abs(x) > 1e-6})


def fit_sample(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fits on at most `rows` labelled rows and `chars` characters of their documents: those first by a hash of the key.

    A document that doesn't fit into what is left of the characters is passed over.
    The sample is drawn from the labels; only its keys, `rows` at most, go to the documents, so that no text is shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    sample = known.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"), F.xxhash64(key).alias("h")).orderBy("h", "key", "label").limit(rows)
    own = documents.select(F.col(f"`{key}`").alias("key"), F.coalesce(f"`{text}`", F.lit("")).alias("text")).join(F.broadcast(sample), "key")
    used, chosen, sizes = 0, [], Counter()
    for row in own.select("h", "key", F.length("text").alias("n")).collect():
        sizes[row.h, row.key] += row.n
    for (_, k), n in sorted(sizes.items()):
        if used + n <= chars:
            used += n
            chosen.append(k)
    if sizes and not chosen:
        chosen.append(min(sizes, key=lambda x: (sizes[x], x))[1])
    table = F.broadcast(documents.sparkSession.createDataFrame([(k,) for k in sorted(set(chosen))], documents.select(F.col(f"`{key}`").alias("key")).schema))
    texts = sorted(own.join(table, "key", "left_semi").select("h", "key", "label", "text").collect())
    return fit([r.text for r in texts], [r.label for r in texts])


def score_documents(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """documents with the score (in column `name`), from 0 to 1, higher for likelier toxic."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # its weights are bounded by the sample of the fit
    schema = T.StructType([f for f in documents.schema.fields if f.name.lower() != name.lower()])
    at = [c.lower() for c in documents.columns].index(text.lower())
    kept = [i for i, c in enumerate(documents.columns) if c.lower() != name.lower()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of = shared.value.score
        for batch in sliced(batches, at):
            values = pa.array([score_of(words(x.as_py())) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), values], [*schema.names, name])
        release()

    return documents.mapInArrow(score, T.StructType([*schema.fields, T.StructField(name, T.DoubleType())]))
