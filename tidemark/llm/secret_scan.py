"""Secret scans over a trigram inverted index.

Each rule's regex gives a Boolean query: the alternatives of its literal parts, each the set of lower-cased trigrams that it needs.
The index has a posting (trigram, text digest) for each trigram of some query and each text that holds it. Intersecting the postings of an
alternative gives the candidate texts of its rule (postings of equal texts fall together as tasks count them); only those are matched with
the rule's regex. A rule with an alternative without trigrams (a class only, such as hex digits) is matched on every text.
The candidates are a table of digests, written before it meets the texts, so that Spark knows its size: while it is small, no text moves.

Spans are code points, end exclusive. Null text: empty. Repeated and equal texts get equal spans; an empty table gives none.
Input columns named like a result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import added, literal_table, written


@dataclass(frozen=True)
class Rule:
    """kind: name in the result; group: the capture whose length must be `least` or more, 0 the whole match."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


# The three base rules. The runs of access and hex are maximal, so their least length stands in the pattern.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# More kinds of keys by their published prefixes.
MORE = (
    Rule("pem", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE
MOST_ALTERNATIVES = 64


def trigram_query(regex: str) -> list[frozenset[str]]:
    """The alternatives of a regex as sets of trigrams that a lower-cased match must hold; [] if it must be matched everywhere."""

    def closed(state):
        grams, tail = state
        return grams | {tail[i : i + 3] for i in range(len(tail) - 2)}, ""

    def walk(items, states):
        for kind, value in items:
            if kind is op.LITERAL:
                states = {(g, t + chr(value).lower()) for g, t in states}
            elif kind is op.IN and len(value) <= 6 and all(k is op.LITERAL for k, _ in value):
                states = {(g, t + chr(v).lower()) for g, t in states for _, v in value}
            elif kind is op.SUBPATTERN:
                states = walk(value[3], states)
            elif kind is op.BRANCH:
                states = {s for branch in value[1] for s in walk(branch, states)}
            elif kind is op.MAX_REPEAT and value[:2] == (0, 1):
                states = states | walk(value[2], states)
            elif kind is op.MAX_REPEAT and value[0] >= 1:
                states = {closed(s) for s in walk(value[2], states)}
            elif kind is not op.AT:
                states = {closed(s) for s in states}
            if len(states) > MOST_ALTERNATIVES:  # fewer, weaker alternatives: what all of them need
                common = frozenset.intersection(*[frozenset(closed(s)[0]) for s in states])
                states = {(common, "")}
        return states

    found = {closed(s)[0] for s in walk(_parser.parse(regex), {(frozenset(), "")})}
    if frozenset() in found:
        return []
    return sorted((a for a in found if not any(b < a for b in found)), key=sorted)


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of the rule's leftmost non-overlapping matches, without those that fail its length."""
    gaps, matches, held = F.split(text, rule.regex, -1), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    sizes = F.transform(matches, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), (F.length(F.get(held, i)) >= rule.least).alias("holds")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,order:int,end:int>>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["size"]).alias("end"))
        return F.struct((start + x["size"]).alias("at"), F.when(x["holds"], F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(sizes, empty, step, lambda acc: acc["found"])


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(digest, trigram) for each distinct text and each of the trigrams that it holds, lower-cased."""
    low = texts.select("digest", F.lower("body").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in trigrams]))
    return low.select("digest", F.explode(held).alias("trigram"))


def candidates(texts: DataFrame, queries: dict[str, list[frozenset[str]]]) -> DataFrame:
    """(digest, kinds): the texts that hold all trigrams of some alternative of a rule."""
    clauses = [(kind, n, len(grams), gram) for kind, query in queries.items() for n, grams in enumerate(query) for gram in sorted(grams)]
    table = literal_table(texts.sparkSession, ["kind", "clause", "needs", "trigram"], clauses)
    index = postings(texts, sorted({c[3] for c in clauses}))
    met = index.join(table, "trigram").groupBy("digest", "kind", "clause", "needs").agg(F.size(F.collect_set("trigram")).alias("has"))
    return met.filter(F.col("has") == F.col("needs")).groupBy("digest").agg(F.collect_set("kind").alias("kinds"))


def find_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """documents with secrets: array of (kind, start, end) by start, then by the order of rules."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex))}
    body = F.coalesce(f"`{text}`", F.lit(""))
    digest = F.unhex(F.sha2(body, 256)).alias("digest")
    keyed = documents.select(F.struct(*[f"`{c}`" for c in documents.columns]).alias("row"), digest)
    held = written(candidates(documents.select(body.alias("body"), digest), queries), "candidates") if queries else None
    joined = keyed.join(held, "digest", "left") if queries else keyed.withColumn("kinds", F.array().cast("array<string>"))
    body = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    found = []
    for order, rule in enumerate(rules):
        tried = F.array_contains("kinds", rule.kind) if rule.kind in queries else body.rlike(rule.regex)
        found.append(F.when(F.coalesce(tried, F.lit(False)), spans(body, rule, order)).otherwise(none))
    names = F.array(*[F.lit(r.kind) for r in rules])
    sorted_spans = F.transform(F.array_sort(F.concat(*found)), lambda s: F.struct(F.get(names, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = joined.select("row.*", sorted_spans.alias("_spans"))
    return added(out, secrets=F.col("_spans")).drop("_spans")


def redacted(text: Column, secrets: Column, mask: str = "[SECRET]") -> Column:
    """text with its secrets masked; overlapping spans are masked as one."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        upto = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), upto.alias("out"))

    return F.when(F.size(secrets) > 0, F.aggregate(secrets, start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))).otherwise(text)
