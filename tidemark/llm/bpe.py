"""Encoding and decoding with the word BPE vocabulary by a lexicon of frequent words.

1. Spark counts the words of all documents (each task counts, the counts are summed by word).
2. The most frequent words (`lexicon_words` at most, those that occur once left out) are encoded once and compiled into a minimal acyclic transducer; `addFile` gives the file to
   every executor, also to one that comes later, and tasks map it into memory.
3. Tasks split each whole text as the vocabulary's own pre-tokenizer does; known words get their ids from the transducer, all others by
   exact merges in rank order. Each task remembers words that it met, up to a bound.

The count from which on a word is frequent comes from the numbers of words by count, so that the driver is sent the lexicon's words alone.

Null text: empty, without ids. Special tokens in a text become their ids, as in the tokenizers library. Repeated rows are encoded each;
an empty table gives an empty result. Other columns are left out but for those in `keep`, which must not be named ids or decoded.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenizers import normalizers

from tidemark.llm.common import dropped, release, sliced, written
from tidemark.llm.lexicon import Lexicon, compile_lexicon
from tidemark.llm.merges import LONGEST_REMEMBERED, Encoder, MergeModel
from tidemark.llm.wordsplit import has_unassigned

LEXICON_WORDS = 50_000
COUNTED_AT_ONCE = 100_000


@cache
def _of_library():
    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def normalized(text: str) -> str:
    """NFC, then lower case letter by letter; by the library itself where a character is newer than Python's tables."""
    if text.isascii():
        return text.lower()
    if has_unassigned(text):
        return _of_library()(text)
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@cache
def _model(vocabulary: str) -> MergeModel:
    return MergeModel(vocabulary)


@cache
def _counter(vocabulary: str) -> Encoder:
    return Encoder(_model(vocabulary), False, normalized)


def count_words(documents: DataFrame, text: str = "text", vocabulary: str = "") -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in sliced(batches, 0):
            for word, n in zip(*_counter(vocabulary).words(batch.column(0).to_pylist())):
                counts[word] += n
            if len(counts) > COUNTED_AT_ONCE:
                yield give()
                counts.clear()
        yield give()
        release()

    return documents.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, words: int) -> list[str]:
    """The words that occur at least as often as some count, the least one for which there are `words` words at most.

    The words of each count are counted first: a corpus of N words has fewer than 1.5 * sqrt(N) different counts.
    """
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("many")).withColumn("upto", F.sum("many").over(Window.orderBy(F.desc("n"))))
    least = by_count.filter(F.col("upto") <= words).agg(F.min("n").alias("n")).first().n
    return [] if least is None else [r.word for r in counts.filter(F.col("n") >= least).select("word").collect()]


def build_lexicon(documents: DataFrame, vocabulary: str, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Counts, compiles, and gives the file to the executors; returns its name for `SparkFiles`."""
    counts = written(count_words(documents, text, vocabulary).filter((F.col("n") > 1) & (F.length("word") <= LONGEST_REMEMBERED)), "words")
    frequent = most_frequent(counts, words)
    dropped(counts)
    model = _model(vocabulary)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    with open(path, "wb") as file:  # the driver's own copy, from which addFile serves all executors
        file.write(compile_lexicon(sorted(model.encode_many(frequent).items())))
    documents.sparkSession.sparkContext.addFile(path)
    return name


@lru_cache(maxsize=1)  # a worker that serves several lexicons keeps the last
def _encoder(name: str, vocabulary: str) -> Encoder:
    return Encoder(_model(vocabulary), False, normalized, Lexicon(SparkFiles.get(name)).get)


def encode_documents(documents: DataFrame, vocabulary: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", words: int = LEXICON_WORDS) -> DataFrame:
    """The columns of keep, ids (binary: little-endian unsigned 32-bit) and decoded (the tokens of the ids, joined by blanks)."""
    name = build_lexicon(documents, vocabulary, words, text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, name_of = _encoder(name, vocabulary), _model(vocabulary).names.__getitem__
        for batch in sliced(batches, len(keep)):
            ids = encoder(batch.column(len(keep)).to_pylist())
            decoded = [" ".join(map(name_of, memoryview(data).cast("I"))) for data in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], [*keep, "ids", "decoded"])
        encoder.forget()  # the worker goes on to other tasks
        release()

    kept = documents.select(*[f"`{c}`" for c in keep], text)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keep)])
    return kept.mapInArrow(encode, f"{schema}, ids binary, decoded string")
