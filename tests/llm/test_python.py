"""Encoding, packing, media, top-k, toxicity and near duplicates against the libraries or brute force."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, lexicon, media, merges, neardup, packing, topk, toxicity, wordsplit

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "aeiou bcdst'sSTELLrevLΣσς_²½Ⅷ٣é  \n\t\x1c\x1f\x85ñßİıſK漢字ﬁ🙂$%.,!?<|endoftext|>0123⑤-–…ªº"


def hard_texts(n=400):
    draw = random.Random(5)
    return [None, "", " ", "x", "a" * 300, "ab" * 2000 + "!" * 500, "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "it's 'S 'LL we're", "  x  \n\n y"] + ["".join(draw.choice(LETTERS) for _ in range(draw.randrange(60))) for _ in range(n)]


def table(spark, texts, extra=True):
    rows = [(i, t, "x") for i, t in enumerate(texts)] + ([(1, texts[1], "y"), (None, "no id", "z")] if extra else [])
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def test_lexicon():
    words = sorted({"".join(random.Random(i).choices("abc", k=i % 7)) for i in range(300)} - {""})
    data = lexicon.compile_lexicon((w, array("I", [len(w), i]).tobytes()) for i, w in enumerate(words))
    path = "/tmp/spark-lexicon-test.bin"
    with open(path, "wb") as file:
        file.write(data)
    found = lexicon.Lexicon(path)
    for i, w in enumerate(words):
        assert list(memoryview(found.get(w)).cast("I")) == [len(w), i]
    assert found.get("") is None and found.get("abcabcabcabc") is None and found.get("z") is None
    assert len(found.finals) < sum(map(len, words)) / 3  # suffixes are shared


def test_long_and_short_merges_agree():
    model = merges.MergeModel(BYTE)
    words = [t for t in hard_texts() if t and len(t.encode()) <= 64]
    many = model.encode_many(words)
    assert all(list(memoryview(many[w]).cast("I")) == model.encode(w.encode()) for w in words)


def test_bpe(spark):
    texts = hard_texts()
    library = Tokenizer.from_file(WORD)
    out = bpe.encode_documents(table(spark, texts).drop("ids"), WORD, words=50).collect()
    assert len(out) == len(texts) + 2
    by_id = {r.doc_id: r for r in out}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(memoryview(bytes(by_id[i].ids)).cast("I")) == ids
        assert by_id[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_documents(table(spark, texts).drop("ids").limit(0), WORD).count() == 0


def test_packing(spark):
    texts = [*hard_texts(60), "word " * 5000, "word " * 2047, "word " * 2048]
    library = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(table(spark, texts, extra=False).drop("ids"), BYTE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [x for p in pieces for x in memoryview(bytes(p.ids)).cast("I")] == want
        assert all(p.length == 2048 for p in pieces[1:]) and [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) == gaps_by_rows(Counter(r.length for r in rows), 2048)[0]
    assert packing.pack_documents(table(spark, texts).drop("ids").limit(0), BYTE).count() == 0


def gaps_by_rows(lengths, capacity):
    """Best fit, the longest first, on single pieces: the gap that each met."""
    gaps, met = [], defaultdict(Counter)
    for x in sorted((x for x, n in lengths.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= x]
        gap = min(fits, default=capacity)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - x)
        met[x][gap] += 1
    return len(gaps), met


def test_best_fit_runs_equal_best_fit_by_rows(spark):
    draw = random.Random(3)
    for capacity in (7, 64, 500):
        lengths = {x: draw.randrange(1, 30) for x in draw.sample(range(1, capacity + 1), min(capacity, 40))}
        runs = packing.best_fit_runs(spark.createDataFrame(sorted(lengths.items()), "length long, n long"), capacity).collect()
        sequences, met = gaps_by_rows(lengths, capacity)
        assert max(r.first_sequence + r.n for r in runs) == sequences
        for x, n in lengths.items():
            own = sorted((r for r in runs if r.length == x), key=lambda r: r.first_rank)
            assert [r.first_rank for r in own] + [n] == [0, *(r.first_rank + r.n for r in own)]
            assert sum((Counter({capacity - r.offset: r.n}) for r in own), Counter()) == met[x]
        for s in range(sequences):
            at = 0
            for r in sorted((r for r in runs if r.first_sequence <= s < r.first_sequence + r.n), key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert 0 < at <= capacity


def test_media_round_trip(spark):
    texts = [*hard_texts(30), "é" * 7000]
    out = media.read_media(media.store_media(table(spark, texts).drop("ids"))).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        text = (texts[r.doc_id] if r.doc_id is not None else "no id") or ""
        payload = text.encode() + b" " * (max(1, -(-len(text.encode()) // 192)) * 192 - len(text.encode()))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.payload_bytes == len(payload) and r.n_bytes == len(text.encode())
        assert len(r.rgb) == 3 * r.height * r.width
    assert media.store_media(table(spark, texts).drop("ids").limit(0)).count() == 0


def test_media_by_bits_and_by_arrays():
    stored = media.encode_payload(bytes(range(256)) * 9)
    fast, slow = media.read_coefficients(stored), media.read_coefficients(stored, arrays=False)
    for c in fast.components:
        assert (fast.components[c].blocks == slow.components[c].blocks).all()
    assert media.read_payload(slow) == bytes(range(256)) * 9


def test_media_transform():
    picture = media.read_coefficients(media.encode_payload(b"abc"))
    part = picture.components[1]
    block = np.zeros((8, 8))
    for place, value in zip(media.ZIGZAG, part.blocks[0]):
        block[place // 8, place % 8] = value
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    want = sum(c(u) * c(v) / 4 * block[u, v] * math.cos((2 * 3 + 1) * u * math.pi / 16) * math.cos((2 * 5 + 1) * v * math.pi / 16) for u in range(8) for v in range(8))
    scaled = np.zeros((8, 8), np.float32)
    scaled.ravel()[media.ZIGZAG] = part.blocks[0]
    assert abs((media.COSINES.T @ scaled @ media.COSINES)[3, 5] - want) < 0.05
    assert [int(z) for z in media.ZIGZAG[:10]] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]


def test_bit_reader_runs():
    """A hand-made band: zero run, end-of-band run over two blocks, then a refinement that turns one new coefficient on."""
    blocks = np.zeros((3, 64), np.int16)
    codes = media.huffman_codes(bytes([0, 3, *[0] * 14]), bytes([0x21, 0x10, 0x00]))  # 00: two zeros and a bit; 01: run of 2 or 3 blocks; 10: end of band
    first = "00" + "1" + "10" + "01" + "0"  # block 0: coefficient 3 = 1, end; blocks 1 and 2: nothing
    data = int(first.ljust(16, "1"), 2).to_bytes(2, "big")
    media._ac_band(media.Bits(data), codes, blocks, [0, 1, 2], 1, 63, 0, 1)
    assert blocks[0, 3] == 2 and (np.count_nonzero(blocks) == 1)
    codes = media.huffman_codes(bytes([0, 2, *[0] * 14]), bytes([0x01, 0x00]))
    refine = "00" + "0" + "01" + "1" + "01" + "01"  # block 0: new -1 at 1; end of band, bit for coefficient 3; blocks 1, 2: end
    data = int(refine.ljust(16, "1"), 2).to_bytes(2, "big")
    media._ac_band(media.Bits(data), codes, blocks, [0, 1, 2], 1, 63, 1, 0)
    assert blocks[0, 1] == -1 and blocks[0, 3] == 3


def test_topk(spark):
    draw = np.random.default_rng(2)
    vectors = {i: draw.normal(size=6).round(2) for i in range(160)}
    vectors |= {i: vectors[3] for i in range(160, 200)}
    rows = [(i, v.tolist()) for i, v in vectors.items()] + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [1.0, 2.0]), (None, [1.0] * 6)]
    rows += [(5, vectors[5].tolist()), (7, (9 * vectors[7]).tolist()), (7, (3 * vectors[20]).tolist()), (40, (2 * vectors[60]).tolist())]  # repeated ids: rows of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 20 = 0 or vec_id = 904").selectExpr("vec_id as id")
    got = defaultdict(list)
    for r in topk.top_k(df, asked, block=16, query_block=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.id, r.score))
    cells = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    wanted = defaultdict(list)
    for at, (q, own) in enumerate(cells):
        if q % 20 == 0:
            wanted[q] += [(i, -s) for s, i in sorted((-int(own @ c), i) for k, (i, c) in enumerate(cells) if k != at)[:5]]
    assert {q: sorted(r) for q, r in got.items()} == {q: sorted(r) for q, r in wanted.items()} and len(wanted[40]) == 10
    assert all(got[q] == r for q, r in wanted.items() if len(r) == 5)
    assert 904 not in got
    assert topk.top_k(df.limit(0), asked).count() == 0
    few = df.filter("vec_id in (0, 20, 40)")
    assert topk.top_k(few, few.selectExpr("vec_id as id")).count() == 12  # four rows, as two have the id 40


def test_toxicity(spark):
    draw = random.Random(1)
    clean, bad = ["stone", "river", "cloud", "table", "green", "women", "men"], ["idiot", "scum"]
    texts = [" ".join(draw.choices(clean, k=20)) for _ in range(150)] + [" ".join([*draw.choices(clean[:5], k=15), *draw.choices(bad, k=3), "women"]) for _ in range(50)]
    model = toxicity.fit(texts, [0] * 150 + [1] * 50)
    score = lambda t: model.score(toxicity.words(t))
    assert score("river stone idiot scum") > 0.5 > score("river stone cloud")
    swap = lambda m: abs(m.score(toxicity.words("the women by the river")) - m.score(toxicity.words("the men by the river")))
    free = toxicity.fit(texts, [0] * 150 + [1] * 50, counterfactual=0.0)  # "women" marks most toxic texts here
    assert swap(free) > 0.02 and swap(model) < swap(free) / 20, (swap(free), swap(model))
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (3, "idiot " * 30000, 2.0), (3, "idiot " * 30000, 2.0)], "doc_id long, text string, score double")
    rows = toxicity.score_documents(docs, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score and rows[2].score == rows[3].score > 0.5
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(3, 1), (2, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    assert isinstance(toxicity.fit_sample(docs.drop("score"), labels), toxicity.Model)
    assert toxicity.fit_sample(docs.limit(0), labels.limit(0)).weights == {}


def brute_components(rows):
    words = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = words.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates(spark, block):
    draw = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [draw.choices(vocabulary, k=120) for _ in range(8)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "one two three four"), (6, "ONE two  three\tfour"), (7, "É a b c d"), (8, "é a b c d")]
    for k in range(90):
        words = list(base[k % 8 if k % 3 else 0])
        for _ in range(draw.randrange(0, 6)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((10 + k, " ".join(words)))
    rows += [(200 + k, rows[12][1]) for k in range(5)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows] + [(None, "one", 1)], "doc_id long, text string, component int")
    out = neardup.near_duplicates(df, block=block).collect()
    assert len(out) == len(rows) + 1
    assert {r.id: (r.n_shingles, r.component) for r in out if r.id is not None} == brute_components(rows)
    assert all(r.kept == (r.id == r.component) for r in out if r.id is not None)
    assert [(r.component, r.kept) for r in out if r.id is None] == [(None, True)]


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 100)], "a long, b long")
    found = {r.id: r.component for r in neardup.connected_components(links).collect()}
    assert found == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


def test_encoders_agree_with_the_library_on_every_letter():
    """Also on characters that are newer than Python's tables."""
    points = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    draw = random.Random(3)
    texts = [f"a{c}1" for c in points] + [f"a {c}'s {c}A" for c in points[::7]] + ["".join(draw.choices(points, k=12)) for _ in range(2000)]
    for path, byte_level, normal in ((BYTE, True, str), (WORD, False, bpe.normalized)):
        wanted = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
        for got, want in zip(merges.Encoder(merges.MergeModel(path), byte_level, normal)(texts), wanted):
            assert memoryview(got).cast("I").tolist() == want.ids


def test_words_that_meet_in_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(wordsplit, "MULTIPLY", np.uint64(0))
    texts = [t for t in hard_texts(50) if t]
    model = merges.MergeModel(BYTE)
    library = Tokenizer.from_file(BYTE)
    assert [memoryview(x).cast("I").tolist() for x in merges.Encoder(model, True)(texts)] == [library.encode(t).ids for t in texts]


def test_most_frequent_words(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 2)], "word string, n long")
    found = lambda words: sorted(bpe.most_frequent(counts, words))
    assert found(4) == ["a", "b", "c", "d"] and found(3) == ["a", "b", "c"] and found(2) == found(1) == ["a"] and found(0) == []
    assert bpe.most_frequent(counts.limit(0), 5) == []


def test_banding():
    assert neardup.banding(85) == (34, 7, 0.75)
    for percent in range(50, 100):
        bands, rows, least = neardup.banding(percent)
        similar = percent / 100
        assert (1 - similar**rows) ** bands <= 1 / 500_000
        assert least <= similar - 4 * (similar * (1 - similar) / (bands * rows)) ** 0.5


@pytest.mark.parametrize("every", [True, False])
def test_candidates_by_percent(every):
    """Sizes 100 and 82 may be 82 per cent similar."""
    for percent, pairs in ((80, {(1, 2)}), (85, set())):
        bands, rows, least = neardup.banding(percent)
        signatures = np.zeros((2, bands * rows), np.uint16)
        assert neardup._pairs_of(np.array([1, 2]), np.array([1, 2]), np.array([100, 82]), np.array([0, 0]), signatures, 0, every, least, percent) == pairs


def test_rows_of_one_id_are_one_node(spark):
    text = lambda letter: " ".join(f"{letter}{i}" for i in range(40))
    rows = [(5, text("a")), (5, text("b")), (2, text("a")), (3, text("b")), (7, text("c")), (7, text("d"))]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id, r.component) for r in out) == [(2, 2), (3, 2), (5, 2), (5, 2), (7, 7), (7, 7)]


def test_sample_passes_over_long_texts(spark):
    """A text over the limit, at any place of the order, leaves the others in."""
    rows = [(i, ("idiot scum " if i % 2 else "stone river ") * 3) for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(i, "cloud " * 400) for i in range(20, 30)], "doc_id long, text string")
    alone = toxicity.fit_sample(docs.filter("doc_id < 20"), labels, chars=2000)
    assert alone.weights and toxicity.fit_sample(docs, labels, chars=2000) == alone


def test_feature_of_stored_tensors(spark, monkeypatch):
    monkeypatch.setattr(media, "TENSOR_BYTES", 1)
    texts = [None, "", "x" * 700, "long text " * 300]
    read = media.read_media(media.store_media(table(spark, texts, extra=False)))
    rows = {r.doc_id: r for r in read.collect()}
    assert all(len(r.rgb) == 3 * r.height * r.width for r in rows.values())
    found = media.described(read)
    assert not {"height", "width", "rgb"} & set(found.columns)
    assert {r.doc_id: r.feature for r in found.collect()} == {i: r.feature for i, r in rows.items()}
    changed = media.described(read.selectExpr("doc_id", "feature", "height", "width", "cast(repeat('a', height * width * 3) as binary) as rgb")).collect()
    assert all(r.feature != rows[r.doc_id].feature for r in changed)
