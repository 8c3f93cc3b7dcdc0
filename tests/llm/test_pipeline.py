"""The pipeline on a small table with planted cases."""

import random

import pytest

import corpus_pipeline

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(4)
    words = [f"{a}{b}" for a in ("sto", "riv", "clo", "tab") for b in ("ne", "er", "ud", "le", "or")]
    rows = [(i, " ".join(draw.choices(words, k=60))) for i in range(120)]
    rows += [(200 + i, " ".join([*draw.choices(words, k=50), *draw.choices(["idiot", "scum", "moron"], k=8)])) for i in range(60)]
    rows += [(300, rows[5][1]), (301, rows[6][1].upper()), (302, rows[7][1] + " token = abcdefabcdefabcdef"), (303, None), (304, ""), (305, "long " + " ".join(words * 500)), (305, "long " + " ".join(words * 500))]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows] + [(None, "no id here", "en", "s", 10)], COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i in [*range(0, 120, 2), *range(200, 260, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns, name
        seen.append({r.doc_id: r.text for r in docs.collect()})
    toxic, single, masked = seen
    assert not [i for i in toxic if i is not None and 200 <= i < 260]
    assert {i for i in toxic if i is not None and i < 120} == set(range(120))
    assert 300 not in single and 301 not in single and 5 in single and 6 in single and None in single
    assert masked[302].endswith("[SECRET]") if 302 in masked else masked[7]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == set(masked)
    assert sum(p.length for p in pieces if p.doc_id == 305) > 2048


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 100


def test_near_copies_from_80_per_cent_go(spark):
    words = [f"w{i}" for i in range(124)]  # 120 shingles; two changed words leave 110 of 130: 84.6 per cent
    near = [*words[:20], "x", *words[21:60], "y", *words[61:]]
    other = [*words[:20], "x", *words[21:60], "y", *words[61:90], "z", *words[91:110], "u", *words[111:]]  # of the first 100 of 140: 71 per cent, of the second 84.6
    far = [*words[:60], *[f"v{i}" for i in range(64)]]
    rows = [(1, words), (2, near), (3, far), (4, other), (5, words[:102])]  # the last: 98 of 120 shingles
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in rows], COLUMNS)
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group_stays(spark, docs, "").collect()) == [1, 3]


def test_texts_of_one_id_stay(spark):
    text = lambda letter: " ".join(f"{letter}{i}" for i in range(40))
    rows = [(1, text("a")), (1, text("b")), (1, text("b")), (2, text("a")), (2, text("c")), (3, text("b")), (4, None), (4, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.one_of_each_group_stays(spark, docs, "").collect()]
    assert {t for _, t in kept} == {text(c) for c in "abcd"} | {None} and len(kept) == 5


def test_sequences_hold_tokens(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id in (1, 305)")
    pieces = corpus_pipeline.sequences(spark, docs, folder).collect()
    assert pieces and all(len(p.ids) == 4 * p.length for p in pieces)
