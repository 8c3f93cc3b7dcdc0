"""MinHash near-duplicates: banding, signature verification, confirmation on full sets, components by stars.

1. Tasks hash the word shingles of each whole text to its set, and take minima over universal hash functions (multiply-shift).
   Texts with equal sets form a class, which its smallest id stands for from here on: copies never meet in pairs.
2. Classes that share all minima of a band meet in a bucket. `banding` takes as many bands as let two sets of the asked similarity miss all of
   them once in 500 000 pairs: 34 of 7 minima at 85 per cent, 34 of 5 at 80.
3. Three rounds of candidates, each confirmed on full sets and joined into components:
   a. every class with the smallest of its bucket;
   b. in buckets that still hold several components, every class with the one of another component whose signature is nearest;
   c. in the buckets left, all pairs of different components whose signatures agree in so many minima as the asked similarity leads to, less
      four standard deviations, or more, first by the minima of the bands and then by 1024 others, which only the members of these buckets
      get: so texts that share much, but too little, are told apart where they are compared, and don't become rows.
   Pairs within a component are not made, however large its buckets are. A bucket of more than `BLOCK` members is compared in pairs of
   blocks, dealt by hash in groups of about two blocks' rows; no candidate is left out.
4. Components come from alternating large-star and small-star passes over the confirmed links.

Texts without words are linked with nothing. Null text: empty. Rows that repeat an id are one node: links join the classes of their texts. A row without an id stays alone, with
component null and kept. Ties: the smallest id is the one kept. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.common import dropped, release, same_table, sliced, written

WORDS = 5
SIMILAR = 85  # per cent
HIT, MISS = 0.3, 1 / 500_000  # chance to share one band, at least, and to share none, at most, at the asked similarity
DEVIATIONS = 4
FINE = 1024  # minima that tell the last round's pairs apart
BLOCK = 1024
HOT_KEYS = 1000  # keys with more than this part of all rows are joined by broadcast: there are fewer than that
SMALL = 1_000_000  # links that one task can take, whatever their keys
SEED = 20240229


@cache
def _constants() -> dict[str, np.ndarray]:
    random = np.random.default_rng(SEED)
    draw = lambda *shape: random.integers(0, 1 << 64, shape, np.uint64)
    letters = draw(256)
    letters[ord("A") : ord("Z") + 1] = letters[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return {
        "letters": letters, "space": space, "places": draw(WORDS) | np.uint64(1), "short": draw(WORDS), "base": draw(1) | np.uint64(1),
    }


@cache
def banding(percent: int) -> tuple[int, int, float]:
    """Bands, minima a band, and the least agreement of signatures (two decimals, rounded down) for sets of this similarity or more."""
    similar = min(max(percent, 1), 99) / 100
    rows = max(1, math.floor(math.log(HIT) / math.log(similar)))
    bands = math.ceil(math.log(MISS) / math.log1p(-(similar**rows)))
    return bands, rows, max(0.0, math.floor(100 * (similar - DEVIATIONS * math.sqrt(similar * (1 - similar) / (bands * rows)))) / 100)


@cache
def _functions(bands: int, rows: int) -> dict[str, np.ndarray]:
    random = np.random.default_rng([SEED, bands, rows])
    draw = lambda n: random.integers(0, 1 << 64, n, np.uint64)
    return {"multiply": draw(bands * rows) | np.uint64(1), "add": draw(bands * rows), "row": draw(rows) | np.uint64(1), "band": draw(bands)}


class Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            base = int(_constants()["base"][0])
            size = 1 << n.bit_length()
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        return self.up, self.down


_powers = Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text: A-Z lower-cased, words between ASCII white space; short texts are one shingle."""
    c = _constants()
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    word = ~c["space"][data]
    edges = np.flatnonzero(np.diff(word.astype(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = _powers.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), (c["letters"][data] * up[: len(data)]).cumsum(dtype=np.uint64)])
    words = _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    if len(words) < WORDS:
        return _mixed((words * c["places"][: len(words)]).sum(dtype=np.uint64, keepdims=True) + c["short"][len(words)])
    n = len(words) - WORDS + 1
    total = words[:n] * c["places"][0]
    for i in range(1, WORDS):
        total = total + words[i : i + n] * c["places"][i]
    return np.unique(_mixed(total))


def minima(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """The upper 32 bits of the least value of each universal hash function."""
    c = _functions(bands, rows)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[None, i : i + 1024] * c["multiply"][:, None] + c["add"][:, None]).min(1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def _sketches(documents: DataFrame, key: str, text: str, percent: int) -> DataFrame:
    """id, n, set_a and set_b (128 bits of the set), bands and signature (16 bits of each minimum)."""

    n_bands, n_rows, _ = banding(percent)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _functions(n_bands, n_rows)
        for batch in sliced(batches, 1):
            n, first, second, bands, signatures = [], [], [], [], []
            for value in batch.column(1):
                hashes = shingles(value.as_py())
                n.append(len(hashes))
                first.append(int(hashes.sum(dtype=np.uint64).astype(np.int64)))
                second.append(int(_mixed(hashes + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                if len(hashes):
                    least = minima(hashes, n_bands, n_rows).astype("<u2")
                    bands.append(_mixed((least.reshape(n_bands, n_rows).astype(np.uint64) * c["row"]).sum(1, dtype=np.uint64) + c["band"]).view(np.int64))
                    signatures.append(least.tobytes())
                else:
                    bands.append(None)
                    signatures.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())],
                ["id", "n", "set_a", "set_b", "bands", "signature"],
            )
        release()

    rows = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`"))
    return rows.mapInArrow(sketch, "id long, n long, set_a long, set_b long, bands array<long>, signature binary")


def _sets(documents: DataFrame) -> DataFrame:
    """(id, shingles) of (id, text)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found = [shingles(x.as_py()).view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])
        release()

    return documents.mapInArrow(hashed, "id long, shingles array<long>")


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], counts: str, total: int) -> DataFrame:
    """rows with the columns of a table that has one row for each key; its column `counts` says how many rows have the key.

    Keys with over 1 / HOT_KEYS of the `total` rows, fewer than HOT_KEYS, are broadcast, so that no task gets all rows of a hot key.
    """
    hot = F.col(counts) > max(total // HOT_KEYS, 100)
    few = F.broadcast(table.filter(hot).drop(counts))
    return rows.join(few, keys).unionByName(rows.join(few.select(keys), keys, "left_anti").join(table.filter(~hot).drop(counts), keys))


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id that has a link to a smaller one."""

    def stars(edges: DataFrame, large: bool, total: int) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"), F.count(F.lit(1)).alias("degree"))
        near = joined_by_key(both, least, ["a"], "degree", total) if total > SMALL else both.join(least.drop("degree"), "a")
        moved = near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")) if large else near.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    state = lambda edges: edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges, before = links.select("a", "b"), state(links)
    old = None
    while True:
        edges = written(stars(stars(edges, True, 2 * before[0]), False, before[0]), "stars")
        now = state(edges)
        if old is not None:
            dropped(old)
        if now == before or now[0] == 0:
            return same_table(edges.withColumnsRenamed({"a": "id", "b": "component"}), edges)
        before, old = now, edges


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("shingles").alias(f"of_{x}"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(side("b"), "b").join(side("a"), "a").filter(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def least_fine(percent: int) -> float:
    """The least agreement of fine signatures for sets of this similarity: bytes of different minima are equal once in 256 times."""
    agree = percent / 100 + (1 - percent / 100) / 256
    return agree - DEVIATIONS * math.sqrt(agree * (1 - agree) / FINE)


def _fine(sets: DataFrame) -> DataFrame:
    """(id, n, fine): a byte of each of FINE further minima."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [np.asarray(x.values).view(np.uint64) for x in batch.column(1)]
            fine = [minima(h, FINE, 1).astype(np.uint8).tobytes() for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hashes], pa.int64()), pa.array(fine, pa.binary())], ["id", "n", "fine"])
        release()

    return sets.mapInArrow(sketch, "id long, n long, fine binary")


def _size_fits(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _pairs_of(ids: np.ndarray, part: np.ndarray, n: np.ndarray, block: np.ndarray, signatures: np.ndarray, band: int, every: bool, least: float, percent: int, fine: np.ndarray | None = None) -> set[tuple[int, int]]:
    """Pairs of different components in one bucket's block, or pair of blocks, by signature: the nearest for each member, or all.

    A pair belongs to the first band that it shares, so that it is made in one bucket only.
    """
    pairs = set()
    mixed = block.min() != block.max()
    n_bands, n_rows, _ = banding(percent)
    for i in range(len(ids) - 1 if every else len(ids)):
        others = slice(i + 1 if every else 0, None)
        fits = (part[others] != part[i]) & (100 * np.minimum(n[others], n[i]) >= percent * np.maximum(n[others], n[i]))
        if mixed:  # pairs within a block are made where the block stands alone
            fits &= block[others] != block[i]
        at = np.flatnonzero(fits)
        if not len(at):
            continue
        same = signatures[others][at] == signatures[i]
        agree = same.mean(1)
        ok = (agree >= least) & (same.reshape(-1, n_bands, n_rows).all(2).argmax(1) == band)
        at, agree = at[ok], agree[ok]
        if fine is not None and len(at):
            close = (fine[others][at] == fine[i]).mean(1) >= least_fine(percent)
            at, agree = at[close], agree[close]
        if len(at) and not every:
            at = at[[agree.argmax()]]
        pairs.update((int(min(ids[i], x)), int(max(ids[i], x))) for x in ids[others][at])
    return pairs


def _compared(every: bool, least: float, percent: int):
    """`_pairs_of` for each of many small groups."""
    group = ["band", "bucket", "lo", "hi"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        signs = ["signature", "fine"] if every else ["signature"]
        rows = rows.drop_duplicates([*group, "id", *signs]).sort_values([*group, "id"])
        keys = rows[group].to_numpy()
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(rows)]
        columns = [rows[c].to_numpy() for c in ("id", "component", "n", "block")]
        signatures = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(len(rows), -1)
        fine = np.frombuffer(b"".join(rows["fine"]), np.uint8).reshape(len(rows), -1) if every else None
        pairs = set()
        for lo, hi in zip(cuts, cuts[1:]):
            pairs |= _pairs_of(*(c[lo:hi] for c in columns), signatures[lo:hi], keys[lo, 0], every, least, percent, fine[lo:hi] if every else None)
        return pd.DataFrame(sorted(pairs), columns=["a", "b"], dtype="int64")

    return compare


def _candidates(members: DataFrame, labels: DataFrame | None, sketches: DataFrame, sets: DataFrame, every: bool, least: float, percent: int, block: int) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket; a < b."""
    part = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id")) if labels is not None else members.withColumn("component", F.col("id"))
    sizes = part.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") != F.col("hi")).select("band", "bucket", "members")
    sizes = written(sizes, "buckets")
    left = part.join(sizes, ["band", "bucket"]).withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = left.withColumn("other", other).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    signs = sketches.select("id", "n", "signature")
    if every:
        signs = signs.join(_fine(sets.join(written(left.select("id").distinct(), "left"), "id", "left_semi").select("id", "shingles")), ["id", "n"])
    signed = spread.select("band", "bucket", "lo", "hi", "block", "id", "component").join(signs, "id")
    copies = sizes.agg(F.sum(F.col("members") * F.ceil(F.col("members") / block))).first()[0] or 0  # rows of `spread`
    chunks = max(1, copies // (2 * block))
    chunked = signed.withColumn("chunk", F.pmod(F.xxhash64("band", "bucket", "lo", "hi"), F.lit(chunks)))
    return chunked.groupBy("chunk").applyInPandas(_compared(every, least, percent), "a long, b long").distinct()


def _of_one_id(sketches: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join the classes of ids with several texts; a < b."""
    several = sketches.select("id", "set_a", "set_b", "n").groupBy("id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi"), F.min("set_b").alias("lo_b"), F.max("set_b").alias("hi_b")).filter("lo <> hi or lo_b <> hi_b").select("id")
    held = sketches.join(several, "id", "left_semi").join(classes, ["set_a", "set_b", "n"]).groupBy("id").agg(F.collect_set("class").alias("held"))
    return held.select(F.array_min("held").alias("a"), F.explode("held").alias("b")).filter("a < b").distinct()


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = SIMILAR, least_agreement: float | None = None, block: int = BLOCK) -> DataFrame:
    """id, n_shingles, component and kept (id = component) of every row."""
    least_agreement = banding(percent)[2] if least_agreement is None else least_agreement
    seen = Observation()
    sketches = written(_sketches(documents, key, text, percent).observe(seen, F.count(F.lit(1)).alias("rows")), "sketches")
    whole = F.col("id").isNotNull() & (F.col("n") > 0)
    set_key = ["set_a", "set_b", "n"]
    classes = written(sketches.filter(whole).groupBy(*set_key).agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "classes")
    single = sketches.join(classes.select(F.col("class").alias("id"), *set_key), ["id", *set_key], "left_semi").select("id", "n", "bands", "signature")
    buckets = single.select("id", F.posexplode("bands").alias("band", "bucket"))
    several = buckets.groupBy("band", "bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter(F.col("least") != F.col("most"))
    members = written(buckets.join(several.drop("most"), ["band", "bucket"]).distinct(), "members")
    needed = written(members.select("id").distinct(), "needed")
    near = written(single.select("id", "n", "signature").join(needed, "id", "left_semi"), "signatures")
    rows = documents.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sets = written(_sets(rows.join(needed, "id", "left_semi")).dropDuplicates(["id", "shingles"]), "sets")

    size = lambda x: near.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}")).distinct()
    stars = members.filter(F.col("id") != F.col("least")).select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    tried = written(stars.join(size("a"), "a").join(size("b"), "b").filter(_size_fits(F.col("n_a"), F.col("n_b"), percent)).select("a", "b"), "tried")
    links = written(_confirmed(tried, sets, percent).unionByName(_of_one_id(sketches.filter(whole), classes)), "links")
    labels = connected_components(links)
    done = [classes, members, needed, near, sets, tried, links, labels, sketches]
    for every in (False, True):
        pairs = _candidates(members.select("band", "bucket", "id"), labels, near, sets, every, least_agreement, percent, block).join(tried, ["a", "b"], "left_anti")
        new = written(pairs, "tried")
        found = written(_confirmed(new, sets, percent), "links")
        tried, links = tried.unionByName(new), links.unionByName(found)
        done += [new, found]
        if found.limit(1).count():
            labels = connected_components(links)
            done.append(labels)
    component = classes.join(labels.withColumnRenamed("id", "class"), "class", "left").select(*set_key, "copies", F.coalesce("component", "class").alias("component"))
    named = joined_by_key(sketches.filter(whole).select("id", *set_key), component, set_key, "copies", seen.get["rows"])
    named = named.select("id", "n", "component").unionByName(sketches.filter(~F.coalesce(whole, F.lit(False))).select("id", "n", F.col("id").alias("component")))
    out = named.select("id", F.col("n").alias("n_shingles"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
    out = written(out, "near_duplicates")
    dropped(*done)  # the result is all that stays of it on disk
    return out
