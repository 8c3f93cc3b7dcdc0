"""Texts that share much, but too little, are told apart by further minima; those that are similar enough never."""

import numpy as np

from tidemark.llm import neardup


def test_fine_signatures_tell_apart():
    draw = np.random.default_rng(7)
    passed = {}
    for percent in (70, 80, 85):
        same, own = round(200 * 2 * percent / (100 + percent)), 0
        hits = []
        for _ in range(60):
            common = draw.integers(0, 1 << 63, same, np.int64)
            own = 200 - same
            a, b = (np.concatenate([common, draw.integers(0, 1 << 63, own, np.int64)]).view(np.uint64) for _ in range(2))
            x, y = (neardup.minima(s, neardup.FINE, 1).astype(np.uint8) for s in (a, b))
            hits.append((x == y).mean() >= neardup.least_fine(80))
        passed[percent] = sum(hits)
    assert passed[70] <= 2 and passed[80] == passed[85] == 60


def test_framed_texts_make_few_rows(spark, monkeypatch):
    draw = np.random.default_rng(8)
    frame = " ".join(f"frame{i}" for i in range(104))
    texts = [(i, frame + " " + " ".join(f"w{x}" for x in draw.integers(0, 10**9, 25))) for i in range(200)]
    texts += [(1000 + i, t + " tail") for i, t in texts[:20]]  # and some that are similar enough
    rows = []

    def counted(pairs, sets, percent):
        rows.append(pairs.count())
        return confirmed(pairs, sets, percent)

    confirmed = neardup._confirmed
    monkeypatch.setattr(neardup, "_confirmed", counted)
    found = {r.id: r.component for r in neardup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=80).collect()}
    assert all(found[1000 + i] == i for i in range(20)) and len(set(found.values())) == 200
    assert rows[-1] < 2000  # of 24 000 pairs
