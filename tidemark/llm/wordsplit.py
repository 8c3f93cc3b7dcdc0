"""Word splitting of the two public BPE vocabularies, on arrays of code points.

Every code point has a class: white space, letter, numeral or other. Words are runs of one class, so that their starts are where the
class changes; the few rules beside that (a blank belongs to the word after it, contractions, single numerals) move some starts.
Characters that this Python's Unicode tables don't know yet are classed by the tokenizers library itself.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
from tokenizers import Regex, pre_tokenizers

# Fixed value: the white space of Unicode, as a class.
SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
# Letters after an apostrophe that make a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")
BLANK, LETTER, NUMBER, OTHER, END = range(5)
CUT = "\ud800"  # between texts; no text in UTF-8 holds it
UNASSIGNED_TO = 0x40000  # no later code point is a letter or a numeral in any version so far


def _matched(pattern: str, text: str) -> np.ndarray:
    """Which characters of a text the library's regex engine matches."""
    held = np.ones(len(text), bool)
    for _, (lo, hi) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(text):
        held[lo:hi] = False
    return held


@cache
def unassigned() -> np.ndarray:
    """The code points up to `UNASSIGNED_TO` that Python's tables don't know."""
    return np.array([c for c in range(UNASSIGNED_TO) if unicodedata.category(chr(c)) == "Cn"], np.uint32)


@cache
def _is_unassigned() -> np.ndarray:
    found = np.zeros(0x110000, bool)
    found[unassigned()] = True
    return found


def has_unassigned(text: str) -> bool:
    return bool(_is_unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


@cache
def classes() -> np.ndarray:
    """Class of every code point."""
    found = np.full(0x110000, OTHER, np.uint8)
    text = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    for pattern, kind in ((r"[^\W\d_]", LETTER), (rf"[{SPACE}]", BLANK)):
        found[points[[m.start() for m in re.finditer(pattern, text)]]] = kind
    found[[ord(c) for c in re.findall(r"[^\W_]", text) if not c.isalpha()]] = NUMBER
    found[ord(CUT)] = END
    new = unassigned()
    text = new.tobytes().decode("utf-32-le")
    found[new[_matched(r"\p{L}", text)]] = LETTER
    found[new[_matched(r"\p{N}", text)]] = NUMBER
    return found


def word_bounds(points: np.ndarray, byte_level: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word of texts that each end with CUT, and the number of words of each text.

    Byte level: ` ?letters`, ` ?numerals`, ` ?others` and white space. Word level: letters, single numerals, others; white space is dropped.
    """
    kind = classes()[points]
    n = len(points)
    start = np.empty(n, bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == END
    if byte_level:
        after = np.flatnonzero(start[1:] & (kind[:-1] == BLANK) & (kind[1:] != END)) + 1
        start[after - 1] = True
        start[after[points[after - 1] == 0x20]] = False
    else:
        start |= kind == NUMBER
    mark = np.flatnonzero(start & (points == ord("'")))
    if len(mark):
        first, second = points[mark + 1], points[np.minimum(mark + 2, n - 1)]
        short = np.isin(first, [ord(c) for c in SHORT])
        long = np.zeros(len(mark), bool)
        for a, b in LONG:
            long |= (first == ord(a)) & (second == ord(b))
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    begin = np.flatnonzero(start)
    own = kind[begin]
    end = np.append(begin[1:], n)
    wanted = own != END if byte_level else (own != END) & (own != BLANK)
    place = np.concatenate([[0], np.cumsum(wanted)])[np.flatnonzero(own == END)]
    return begin[wanted], end[wanted], np.diff(place, prepend=0)


MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def distinct_words(points: np.ndarray, begin: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of one word of each kind, and the kind of every word. Words of more than `longest` characters are kinds of their own.

    Words are told apart by a hash of their letters, then compared letter by letter with the one that stands for their kind.
    """
    size = np.minimum(end - begin, longest + 1).astype(np.uint8)
    order = np.argsort(size, kind="stable")[::-1]
    sorted_size = size[order]
    at, value = begin[order], np.uint64(1) + sorted_size.astype(np.uint64)
    upto = len(order) - np.searchsorted(sorted_size[::-1], np.arange(longest + 2), side="right")  # words longer than j
    for j in range(longest + 1):
        k = upto[j]
        if not k:
            break
        value[:k] = (value[:k] ^ points[at[:k] + j]) * MULTIPLY
        value[:k] ^= value[:k] >> np.uint64(29)
    far = int(upto[longest])
    value[:far] = np.arange(far, dtype=np.uint64)  # each long word alone; a chance meeting shows below
    by_value = np.argsort(value)
    ordered = value[by_value]
    head = np.empty(len(ordered), bool)
    head[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=head[1:])
    kind = np.empty(len(ordered), np.int64)
    kind[by_value] = np.cumsum(head) - 1
    stands = by_value[head]
    model = at[stands][kind]
    same = bool((sorted_size[stands][kind] == sorted_size).all())
    for j in range(longest + 1):
        k = upto[j]
        if not k or not same:
            break
        same = bool((points[at[:k] + j] == points[model[:k] + j]).all())
    if not same:  # two words met in one hash: every word is a kind of its own
        return np.arange(len(begin)), np.arange(len(begin))
    out = np.empty(len(kind), np.int64)
    out[order] = kind
    return order[stands], out
