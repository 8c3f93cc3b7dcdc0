"""The graphs of near vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import hnsw, queries


def exact(rows, wanted, k):
    """(query id) -> the k nearest other rows as (distance, id), of vectors of the same length."""
    sound = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, (i, v) in enumerate(sound):
        if i in wanted:
            out.append((i, sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for r, (j, w) in enumerate(sound) if r != q and len(w) == len(v))[:k]))
    return out


def grouped(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((round(r.score, 9), r.id))
    return out


def test_small_tables_are_exact(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=4).tolist()) for i in range(60)] + [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(200 + i, [float(i), 1.0]) for i in range(4)]
    rows += [(300, None), (301, []), (302, [0.0, 0.0, 0.0, 0.0]), (303, [1.0, None, 1.0, 1.0]), (304, [float("nan"), 1.0, 1.0, 1.0]), (305, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, row string")
    wanted = {0, 5, 105, 129, 200, 300, 302, 305}
    found = hnsw.nearest(table, spark.createDataFrame([(i,) for i in wanted], "id long"))
    assert grouped(found) == {i: [(round(d, 9), j) for d, j in near] for i, near in exact(rows, wanted, 10)}
    assert hnsw.nearest(table.limit(0), table.select(F.col("vec_id").alias("id"))).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0])]
    found = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame([(1,)], "id long")).collect()
    assert len(found) == 9 and sorted(r.id for r in found) == [1] * 6 + [2] * 3


@pytest.mark.parametrize("size", [400, 4000])
def test_recall(spark, size):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + draw.normal(size=32)).tolist()) for i in range(3000)]
    wanted = set(range(0, 3000, 50))
    found = grouped(hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), spark.createDataFrame([(i,) for i in wanted], "id long"), size=size, beam=80))
    truth = {i: {j for _, j in near} for i, near in exact([(i, np.float32(v)) for i, v in rows], wanted, 10)}
    assert all(len(near) == 10 for near in found.values())
    assert np.mean([len(truth[i] & {j for _, j in found[i]}) / 10 for i in wanted]) >= 0.95


def test_a_graph_links_few_neighbours():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 16)).astype(np.float32)
    links = hnsw._layer(x, np.arange(2000), 8, 16, 40)
    assert links.shape == (2000, 16) and (links[1:, 0] >= 0).all()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() and i not in row for i, row in enumerate(links))


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in table], float), np.array([r.vec_id for r in table])
    hits = asked = 0
    found = {}
    for r in queries.op12_neighbours(spark, folder).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = found[int(ids[q])]
        assert sorted(mine) == list(range(1, 11))
        assert all(abs(d[np.flatnonzero(ids == i)[0]] - score) < 1e-12 for i, score in mine.values())
        hits, asked = hits + len(best & {i for i, _ in mine.values()}), asked + 10
    assert hits / asked >= 0.9
