"""Exact byte-pair merges of words from a vocabulary file, many words at a time."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain, count

import numpy as np

from tidemark.llm.common import slices
from tidemark.llm.wordsplit import CUT, distinct_words, word_bounds

REMEMBERED = 100_000
LONGEST_REMEMBERED = 64
NO_MERGE = np.int64(1 << 40)
NOTHING = np.int64(0xFFFFF)  # fills up rows; no vocabulary has so many ids
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
WIDTHS = (3, 5, 7, 9, 11, 13, 16, 20, 26, 36, 64)  # bytes; words of like size are merged together
ROWS = 50_000


@cache
def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in printable else next(spare)) for b in range(256)}


class MergeModel:
    """Ids of words; a word's last letter carries the vocabulary's end mark, if it has one."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            data = json.load(file)
        self.ids = data["model"]["vocab"]
        end = data["model"].get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        letters = byte_letters()
        self.inner = np.array([self.ids[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([self.ids[letters[b] + end] for b in range(256)], np.int64)
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self._store(np.array([a << 20 | b for a, b in self.merges], np.int64), np.array([rank << 20 | new for rank, new in self.merges.values()], np.int64))

    def _store(self, keys: np.ndarray, values: np.ndarray) -> None:
        """The merges as a hash table of two arrays; a pair is at its own slot or at one of the next ones, up to the first empty slot."""
        self.shift = np.uint64(64 - max(10, (4 * len(keys)).bit_length()))
        self.slots = np.full((1 << 64 - int(self.shift)) + 64, -1, np.int64)
        self.values = np.full(len(self.slots), NO_MERGE)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            left = left[np.argsort(at[left], kind="stable")]
            free = (self.slots[at[left]] < 0) & np.append(True, at[left][1:] != at[left][:-1])
            self.slots[at[left[free]]], self.values[at[left[free]]] = keys[left[free]], values[left[free]]
            left = left[~free]
            at[left] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * MULTIPLY >> self.shift).view(np.int64)

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 20 | new id of each pair, or NO_MERGE."""
        key = (left << 20 | right).ravel()
        at = self._slot(key)
        here = self.slots[at]
        found = np.where(here == key, self.values[at], NO_MERGE)
        far = np.flatnonzero((here != key) & (here >= 0))
        while len(far):
            at[far] += 1
            here = self.slots[at[far]]
            met = here == key[far]
            found[far[met]] = self.values[at[far[met]]]
            far = far[~met & (here >= 0)]
        return found.reshape(left.shape)

    def encode_many(self, words: Iterable[str]) -> dict[str, bytes]:
        """word -> its ids as little-endian unsigned 32-bit integers."""
        words = list(words)
        ids, sizes = self.encode_flat(words)
        ends, data = np.cumsum(4 * sizes).tolist(), ids.tobytes()
        return {w: data[a:b] for w, a, b in zip(words, [0, *ends], ends)}

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, data), np.int64, len(data))
        blob = np.frombuffer(b"".join(data) or b"\0", np.uint8)
        first, sizes, parts = np.cumsum(size) - size, np.zeros(len(data), np.int64), []
        for over, upto in zip((0, *WIDTHS), WIDTHS):
            rows = np.flatnonzero((size > over) & (size <= upto))
            for i in range(0, len(rows), ROWS):
                parts += self._encoded(rows[i : i + ROWS], blob, first, size, sizes, upto)
        for row in np.flatnonzero(size > WIDTHS[-1]).tolist():
            found = np.array([self.encode(data[row])], np.int64)
            sizes[row] = found.shape[1]
            parts.append((np.array([row]), found))
        begin = np.cumsum(sizes) - sizes
        ids = np.empty(int(sizes.sum()), "<u4")
        for rows, found in parts:
            inside = np.arange(found.shape[1]) < sizes[rows][:, None]
            ids[(begin[rows][:, None] + np.arange(found.shape[1]))[inside]] = found[inside]
        return ids, sizes

    def _encoded(self, rows: np.ndarray, blob: np.ndarray, first: np.ndarray, size: np.ndarray, sizes: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of `width` bytes at most, filled up to a matrix of symbols; gives rows and their symbols, and sets how many they have.

        Each step merges the leftmost pair of least rank in every row, so that all rows lose one column. Rows without a pair are done.
        """
        own, n = size[rows], np.arange(len(rows))
        raw = blob[np.minimum(first[rows][:, None] + np.arange(width), len(blob) - 1)]
        symbols = np.where(np.arange(width) < own[:, None], self.inner[raw], NOTHING)
        symbols[n, own - 1] = self.final[raw[n, own - 1]]
        values = self._merge(symbols[:, :-1], symbols[:, 1:])
        parts = []
        while len(rows):
            width = symbols.shape[1]
            here = np.arange(len(rows))
            at = values.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = values[here, at] if width > 1 else np.full(len(rows), NO_MERGE)
            done = best == NO_MERGE
            if done.any():
                sizes[rows[done]] = own[done]
                parts.append((rows[done], symbols[done]))
                live = ~done
                rows, own, symbols, values, at, best, here = rows[live], own[live], symbols[live], values[live], at[live], best[live], here[: live.sum()]
                if not len(rows):
                    break
            own = own - 1
            symbols[here, at] = best & 0xFFFFF
            keep = np.ones(symbols.shape, bool)
            keep[here, at + 1] = False
            symbols = symbols[keep].reshape(len(rows), width - 1)
            keep = np.ones(values.shape, bool)
            keep[here, at] = False
            values = values[keep].reshape(len(rows), width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            values[before, at[before] - 1] = self._merge(symbols[before, at[before] - 1], symbols[before, at[before]])
            values[after, at[after]] = self._merge(symbols[after, at[after]], symbols[after, at[after] + 1])
        return parts

    def encode(self, data: bytes) -> list[int]:
        """The same for one word of any length, with a heap of pairs."""
        symbols = [*self.inner[np.frombuffer(data[:-1], np.uint8)].tolist(), int(self.final[data[-1]])]
        n, get = len(symbols), self.merges.get
        left, right, live = [*range(-1, n - 1)], [*range(1, n), -1], [True] * n
        heap = [(m[0], i, m[1]) for i in range(n - 1) if (m := get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new = heapq.heappop(heap)
            j = right[i] if live[i] else -1
            found = get((symbols[i], symbols[j])) if j >= 0 else None
            if not found or found[1] != new:
                continue
            symbols[i], live[j], right[i] = new, False, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (m := get((symbols[a], symbols[right[a]]))):
                    heapq.heappush(heap, (m[0], a, m[1]))
        return [s for s, alive in zip(symbols, live) if alive]


class Encoder:
    """Whole texts to ids: words that it remembers, then those of a lexicon, then merges. What it remembers is bounded.

    Texts are handled in slices: their words are found and told apart as arrays, so that Python meets each word of a slice once.
    """

    def __init__(self, model: MergeModel, byte_level: bool, normalized: Callable[[str], str] = str, known: Callable[[str], bytes | None] | None = None):
        self.model, self.byte_level, self.normalized, self.known = model, byte_level, normalized, known
        self.forget()

    def forget(self) -> None:
        self.remembered: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Special tokens in a text become their ids; the words around them are split apart."""
        return [ids for lo, hi in slices(texts) for ids in self._encoded(texts[lo:hi])]

    def words(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The distinct words of a slice of texts and how often each occurs."""
        parts, _ = self._parts(texts)
        found, kind, _ = self._kinds(parts)
        return found, np.bincount(kind, minlength=len(found))

    def _parts(self, texts: list[str | None]) -> tuple[list[str], dict[int, tuple[int, list[int]]]]:
        """The normalised texts, cut at special tokens, and where texts were cut: text -> its first part, the tokens between its parts."""
        parts, cut = [], {}
        for i, text in enumerate(texts):
            if text and "<|" in text and self.model.marks.search(text):
                cut[i] = len(parts), [self.model.special[m] for m in self.model.marks.findall(text)]
                parts += map(self.normalized, self.model.marks.split(text))
            else:
                parts.append(self.normalized(text) if text else "")
        return parts, cut

    def _kinds(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct words, the kind of every word, and how many words each part has."""
        whole = CUT.join(parts) + CUT
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        begin, end, counts = word_bounds(points, self.byte_level)
        stands, kind = distinct_words(points, begin, end, LONGEST_REMEMBERED)
        return [whole[a:b] for a, b in zip(begin[stands].tolist(), end[stands].tolist())], kind, counts

    def _learn(self, new: list[str]) -> None:
        """Remembers words with the ids that the lexicon or the merges give."""
        known = [self.known(w) for w in new] if self.known else [None] * len(new)
        rest = [w for w, ids in zip(new, known) if ids is None]
        given = [(w, ids) for w, ids in zip(new, known) if ids is not None]
        ids, sizes = self.model.encode_flat(rest)
        self.remembered.update(zip(chain((w for w, _ in given), rest), count(len(self.remembered))))
        self.sizes = np.concatenate([self.sizes, np.array([len(x) // 4 for _, x in given], np.int64), sizes])
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(x for _, x in given), "<u4"), ids])

    def _encoded(self, texts: list[str | None]) -> list[bytes]:
        parts, cut = self._parts(texts)
        found, kind, counts = self._kinds(parts)
        if len(self.remembered) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        self._learn([w for w in dict.fromkeys(found) if w not in self.remembered])  # long words may be there twice
        place = np.fromiter(map(self.remembered.__getitem__, found), np.int64, len(found))
        first = (np.cumsum(self.sizes) - self.sizes)[place][kind]
        own = self.sizes[place][kind]
        upto = np.concatenate([[0], np.cumsum(own)])
        out = self.ids[np.repeat(first - upto[:-1], own) + np.arange(upto[-1])].tobytes()
        ends = (4 * upto[np.cumsum(counts)]).tolist()
        pieces = [out[a:b] for a, b in zip([0, *ends], ends)]
        if not cut:
            return pieces
        joined, at = [], 0
        for i in range(len(texts)):
            at, marks = cut.get(i, (at, []))
            joined.append(b"".join(x for piece, mark in zip(pieces[at : at + len(marks) + 1], [*marks, None]) for x in (piece, b"" if mark is None else array("I", [mark]).tobytes())))
            at += len(marks) + 1
        return joined
