"""The prefix trie and the structure repair against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import queries, repair, trie

COLUMNS = "conv_id long, turn long, role string, text string, node string, depth int"


def place(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def rebuilt(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), place(r or "", x or ""), r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(turns)] for c, turns in convs.items()}
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(int(c - np.fmod(c, 5)), [])[:h] + convs[c][h:]
    return out


def nodes(convs):
    members, children, out = defaultdict(list), defaultdict(list), {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    for p in sorted(members, key=len, reverse=True):
        below, n = [out[k] for k in children[p]], len(members[p])
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(convs[c]) == len(p)))
        out[p] = (
            min(members[p]), len(p), min(members[p[:-1]]) if p else None, n, len(below), sum(b[5] for b in below) if below else 1,
            (n - 1) * len(p[-1][1].encode() if p else b"") + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return set(out.values())


def made(seed, convs, lengths, roles, texts, gap=0):
    draw = random.Random(seed)
    return [(c, draw.choice([None, t, t, t + gap]), draw.choice(roles), draw.choice(texts)) for c in convs for t in range(draw.choice(lengths))]


def found_nodes(spark, rows, bound):
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], COLUMNS)
    turns, ids = trie.spliced(trie.turn_digests(table), base=lambda c: c - c % 5, heads=lambda c: F.crc32(c.cast("string")) % 9, most=8)
    return trie.prefix_trie(turns, ids, ("part", "turn"), bound)


@pytest.mark.parametrize("bound", [8192, 3])
def test_trie(spark, bound):
    rows = made(3, [*range(-7, 60), 1000, 1001, 5003, 9000000007], [1, 2, 3, 5, 9, 40], ["user", "assistant", None], ["a", "b", "é", None, "", "long " * 20_000])
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)] + [(None, 1, "user", "lost")]
    out = found_nodes(spark, rows, bound).collect()
    assert len(out) == len({(r.conv_id, r.depth) for r in out})
    assert {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out} == nodes(rebuilt(rows))


def test_a_chain_is_split_by_halves(spark):
    rows = [(0, t, "user", f"{t}") for t in range(300)]
    out = trie.prefix_trie(trie.turn_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), bound=16).collect()
    assert sorted((r.depth, r.n_leaves, r.n_children) for r in out) == [(d, 1, int(d < 300)) for d in range(301)]


def test_no_conversations(spark):
    assert trie.prefix_trie(trie.turn_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def damaged(rows):
    convs, ids = defaultdict(list), set()
    for c, t, r, x in rows:
        if c is None:
            continue
        ids.add(c)
        r, x = (" " if v is None else v for v in (r, x))
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        for copy in range((0 if kind == 0 else 2 if kind == 3 else 1)):
            text = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            convs[c].append(((t is not None, t or 0), place(r, x), copy, t, "user" if kind == 4 else r, text))
    return {c: [(t, r, x) for *_, t, r, x in sorted(convs[c], key=lambda v: v[:3])] for c in ids}


def cheapest(rows):
    """(cost, audit, turns) by dynamic programming over audits themselves."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def better(table, state, value):
        if state not in table or value[:2] < table[state][:2]:
            table[state] = value

    def inserted(table):
        for _ in range(3):
            for state, (c, a, o) in list(table.items()):
                for to in set(follows[state]) - {"s"}:
                    better(table, to, (c + 5, a + "I", (*o, (names[to], ""))))
        return table

    best = inserted({"": (0, "", ())})
    for role, text, fault in rows:
        new, more = {}, 5 if fault == "truncated" else 0
        for state, (c, a, o) in best.items():
            better(new, state, (c + 2, a + "D", o))
            if fault not in ("blank", "duplicate"):
                if role[:1] and role[:1] in follows[state]:
                    better(new, role[:1], (c + more, a + "K", (*o, (role, text))))
                for to in set(follows[state]) - {"s"}:
                    better(new, to, (c + more + 1, a + "R", (*o, (names[to], text))))
        best = inserted(new)
    return min(best[s] for s in ("", "a") if s in best)


def expected(rows):
    out = set()
    for c, turns in damaged(rows).items():
        seen, known, counts = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
        for _, role, text in turns:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            known.append((role, text, fault))
            if fault:
                counts[fault] += 1
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(known, known[1:]))
        cost, audit, kept = cheapest(known)
        out.add((c, gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("size", [4096, 3])
def test_repair(spark, size):
    roles, texts = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "usher"], ["a.", "b!", "c", "é?\n", None, "", "d .  ", "long " * 20_000 + "."]
    rows = made(5, range(150), [1, 1, 2, 3, 5, 9, 60], roles, texts, gap=2) + [(900, t, "user", "ok.") for t in range(40)] + [(None, 1, "user", "lost.")]
    table = spark.createDataFrame([(*r, "clash", 7) for r in rows], COLUMNS)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    out = repair.report(repair.damaged(table, F.crc32(name) % 20), table, size).collect()
    assert {tuple(r) for r in out} == expected(rows) and len(out) == len({r.conv_id for r in out})


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "tool", "Result."), (1, 2, "assistant", "cut"), (1, 3, "user", "Bye!")]
    found = repair.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    edited = repair.edits(found)
    assert [r.edit for r in edited.sort("position").collect()] == ["K", "D", "D", "R"]  # as dear as KRDD, and less
    turns = [(t.role, t.text) for r in repair.repaired(found, edited).sort("position").collect() for t in r.turns]
    assert turns == [("user", "Hello."), ("assistant", "Bye!")]
    assert repair.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), found.limit(0)).count() == 0


def test_doubled_pointers_take_the_least_path():
    target = np.full((6, 2), -1)  # labels 0 < 1; two paths of one first label never exist, unlike ones do
    target[0] = [1, 2]
    target[1, 1], target[2, 0], target[3, 1], target[4, 0] = 3, 3, 4, 5
    label, step, pointers = repair.least_paths(target)
    assert label.tolist() == [0, 1, 0, 1, 0, -1] and step[0] == 1 and pointers[-1][0] == 5


def test_queries_read_all_conversations(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r) for r in queries.op13_conversation_repair(spark, folder).collect()} == expected(rows)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert {tuple(r) for r in queries.op11_prefix_trie(spark, folder).select(*columns).collect()} == nodes(rebuilt(rows))
