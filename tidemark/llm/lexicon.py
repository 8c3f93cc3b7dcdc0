"""A minimal acyclic transducer from words to token ids, in one file that readers map into memory.

Words come sorted; equal suffixes are merged as they close, so that the automaton is minimal. Every arc carries the number of words
that sort before it at its state; the sum along a word is the word's number, which points at its ids.
"""

from __future__ import annotations

import mmap
from array import array
from bisect import bisect_left
from collections.abc import Iterable


def compile_lexicon(entries: Iterable[tuple[str, bytes]]) -> bytes:
    """The file's bytes; ids are given as little-endian unsigned 32-bit integers; entries are sorted by word (code points), each word once."""
    ids, ends = array("I"), array("I", [0])
    register: dict[tuple, int] = {}
    states: list[tuple[bool, list[tuple[int, int]]]] = []  # closed: final, arcs (label, state)
    counts: list[int] = []  # words from a closed state on
    path: list[list] = [[False, []]]  # open states along the last word: final, arcs; the last arc is open
    last = ""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs = path.pop()
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(states)
                states.append((final, arcs))
                counts.append(final + sum(counts[t] for _, t in arcs))
            label, _ = path[-1][1][-1]
            path[-1][1][-1] = (label, register[key])

    for word, tokens in entries:
        if word <= last and len(ends) > 1:
            raise ValueError("words must be sorted and distinct")
        shared = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        for letter in word[shared:]:
            path[-1][1].append((ord(letter), -1))
            path.append([False, []])
        path[-1][0] = True
        ids.frombytes(tokens)
        ends.append(len(ids))
        last = word
    close(0)
    states.append(tuple(path[0]))
    first, labels, targets, before, finals = array("I", [0]), array("I"), array("I"), array("I"), array("I")
    for final, arcs in states:
        passed = int(final)
        finals.append(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            before.append(passed)
            passed += counts[target]
        first.append(len(labels))
    parts = (first, labels, targets, before, finals, ends, ids)
    return array("I", [len(p) for p in parts]).tobytes() + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """Look-up in a mapped file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            words = memoryview(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)).cast("I")
        at, parts = 7, []
        for size in words[:7]:
            parts.append(words[at : at + size])
            at += size
        self.first, self.labels, self.targets, self.before, self.finals, self.ends, self.ids = parts
        self.root = len(self.finals) - 1

    def get(self, word: str) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers, if it is known."""
        first, labels, targets, before = self.first, self.labels, self.targets, self.before
        state, number = self.root, 0
        for letter in word:
            label, end = ord(letter), first[state + 1]
            arc = bisect_left(labels, label, first[state], end)
            if arc == end or labels[arc] != label:
                return None
            number += before[arc]
            state = targets[arc]
        return self.ids[self.ends[number] : self.ends[number + 1]].tobytes() if self.finals[state] else None
