"""Edits of many texts at once: the texts of a batch are one array of code points with the places where rows begin, and the md5 draws
of all places are computed together. Each function takes a batch and gives the edited one; degrade.py says what they mean."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

AT_ONCE = 1 << 14  # draws
SHIFTS = np.repeat([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]], 4, axis=0).ravel()
SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)
FIRST = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], np.uint32)
WHITE = np.array([9, 10, 11, 12, 13, 32], np.uint32)
#: Code points up to here change case by a table, unless their case has another length; the rest goes through str.
TABLE = 0x180
_single = lambda f: np.array([ord(f(chr(c))) if len(f(chr(c))) == 1 else 0 for c in range(TABLE)], np.uint32)
UPPER, LOWER = _single(str.upper), _single(str.lower)
PLAIN = (UPPER > 0) & (LOWER > 0) | (np.arange(TABLE) == 0)
LETTER = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(TABLE)])


def compress(state: list[np.ndarray], m: np.ndarray) -> list[np.ndarray]:
    """One block of md5 for many messages: four arrays of state, sixteen of words."""
    a, b, c, d = (x.copy() for x in state)
    t, u = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=t), np.bitwise_and(t, b, out=t), np.bitwise_xor(t, d, out=t)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_and(t, d, out=t), np.bitwise_xor(t, c, out=t)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=t), np.bitwise_xor(t, d, out=t)
        else:
            g = 7 * i % 16
            np.invert(d, out=t), np.bitwise_or(t, b, out=t), np.bitwise_xor(t, c, out=t)
        t += a
        t += SINES[i]
        t += m[g]
        np.right_shift(t, np.uint32(32 - SHIFTS[i]), out=u)
        np.left_shift(t, np.uint32(SHIFTS[i]), out=t)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


@lru_cache(maxsize=4)
def decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all numbers under n: their decimal digits and the end mark as one word, and how many digits they have."""
    return np.array([int.from_bytes(b"%d\x80" % i, "little") for i in range(n)], np.uint64), np.array([len(str(i)) for i in range(n)])


class Draws:
    """md5 of prefix and decimal position, for prefixes by row."""

    def __init__(self, prefixes: list[bytes]):
        self.length = np.array([len(p) for p in prefixes], np.int64)
        self.rest = self.length % 64
        full = self.length // 64
        self.words = np.zeros((len(prefixes), 32), np.uint32)
        raw = self.words.view(np.uint8)
        for r, p in enumerate(prefixes):
            raw[r, : self.rest[r]] = np.frombuffer(p, np.uint8)[64 * full[r] :]
        self.words = np.ascontiguousarray(self.words.T)
        self.state = np.repeat(FIRST[:, None], len(prefixes), axis=1)
        for k in range(int(full.max(initial=0))):
            own = np.flatnonzero(full > k)
            block = np.array([np.frombuffer(prefixes[r], "<u4", 16, 64 * k) for r in own]).T
            self.state[:, own] = compress(list(self.state[:, own]), block)

    def at(self, row: np.ndarray, position: np.ndarray) -> np.ndarray:
        """(3, n): the first three words of each digest, as their hexadecimal digits read."""
        out = np.empty((3, len(row)), np.uint32)
        if not len(row):
            return out
        digits, sizes = decimals(1 << max(12, int(position.max()).bit_length()))
        size = sizes[position]
        two = self.rest[row] + size > 55
        for own in (np.flatnonzero(~two), np.flatnonzero(two)):
            for i in range(0, len(own), AT_ONCE):
                at = own[i : i + AT_ONCE]
                out[:, at] = self._digests(row[at], digits[position[at]], size[at], 32 if two[at[0]] else 16)
        return out

    def _digests(self, row: np.ndarray, text: np.ndarray, size: np.ndarray, words: int) -> np.ndarray:
        m = np.take(self.words[:words], row, axis=1)
        first, shift, n = self.rest[row] // 4, (self.rest[row] % 4 * 8).astype(np.uint64), np.arange(len(row))
        m[first, n] |= (text << shift).astype(np.uint32)
        high = text >> (np.uint64(32) - shift)
        m[first + 1, n] |= high.astype(np.uint32)
        if size.max() > 4:  # with its end, more than a word and a shift
            m[first + 2, n] |= (high >> np.uint64(32)).astype(np.uint32)
        m[words - 2] = (8 * (self.length[row] + size)).astype(np.uint32)
        state = [x[row] for x in self.state]
        for k in range(0, words, 16):
            state = compress(state, m[k : k + 16])
        return np.array(state[:3]).byteswap()


def one_of(draw: np.ndarray, n: int, nth: int = 0) -> np.ndarray:
    """A number under n from the nth four digits after the first eight."""
    word = draw[1 + nth // 2]
    return ((word & np.uint32(0xFFFF)) if nth % 2 else word >> np.uint32(16)) % np.uint32(n)


@dataclass
class Texts:
    """Code points of all rows, where each row begins (and the end), the prefix of each row's draws."""

    cp: np.ndarray
    start: np.ndarray
    place: list[bytes]

    def __post_init__(self) -> None:
        self.row = np.repeat(np.arange(len(self.place)), np.diff(self.start))

    def draws(self, kind: str) -> Draws:
        return Draws([p + f"|{kind}|".encode() for p in self.place])

    def resized(self, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where each code point goes, where rows begin) when each takes `count` places."""
        upto = np.r_[0, np.cumsum(count)]
        return upto[:-1], upto[self.start]

    def text(self, a: int, z: int) -> str:
        return self.cp[a:z].astype("<u4").tobytes().decode("utf-32-le")

    def spliced(self, spans: list[tuple[int, int, str]]) -> Texts:
        """With some spans (in order, each within a row) replaced."""
        if not spans:
            return self
        count, parts, last = np.ones(len(self.cp), np.int64), [], 0
        for a, z, new in spans:
            parts += [self.cp[last:a], np.frombuffer(new.encode("utf-32-le"), "<u4")]
            count[a:z] = 0
            count[a] = len(new)
            last = z
        return Texts(np.concatenate([*parts, self.cp[last:]]), self.resized(count)[1], self.place)

    def numbered(self, here: np.ndarray) -> np.ndarray:
        """How many of the marked code points of its row come up to each one."""
        upto = np.cumsum(here)
        before = np.r_[0, upto][self.start[:-1]]
        return upto - before[self.row]


def abbreviate(x: Texts, limit: np.ndarray, lexicon: dict[str, str]) -> Texts:
    if not len(x.cp) or not lexicon:
        return x
    low = x.cp | np.uint32(32)
    letter = (low >= 97) & (low <= 122)
    opens = np.r_[True, letter[1:] != letter[:-1]]
    opens[x.start[:-1][np.diff(x.start) > 0]] = True
    begin = np.flatnonzero(opens)
    end = np.r_[begin[1:], len(x.cp)]
    lower = np.where(x.cp < TABLE, LOWER[np.minimum(x.cp, TABLE - 1)], x.cp).astype(np.int64)
    keys = (np.minimum(end - begin, 1 << 20) << 42) | (lower[begin] << 21) | lower[end - 1]
    near = np.flatnonzero(np.isin(keys, [(len(w) << 42) | (ord(w[0]) << 21) | ord(w[-1]) for w in lexicon if w]))
    near = near[[x.text(begin[k], end[k]).lower() in lexicon for k in near]] if len(near) else near
    number = x.numbered(opens) - 1
    at = begin[near]
    draw = x.draws("abbreviate").at(x.row[at], number[at])
    spans = []
    for k in near[draw[0] < limit[x.row[at]]]:
        word = x.text(begin[k], end[k])
        short = lexicon[word.lower()]
        spans.append((begin[k], end[k], short.upper() if word == word.upper() else short))
    return x.spliced(spans)


def vary_units(x: Texts, limit: np.ndarray, unit: re.Pattern) -> Texts:
    digit = np.flatnonzero((x.cp >= 48) & (x.cp <= 57))
    found = []  # row, number in the row, match, place of the row's text
    for r, first in zip(*np.unique(x.row[digit], return_index=True), strict=True):
        a = int(digit[first])
        found += [(r, i, m, a) for i, m in enumerate(unit.finditer(x.text(a, x.start[r + 1])))]
    if not found:
        return x
    row = np.array([f[0] for f in found])
    draw = x.draws("units").at(row, np.array([f[1] for f in found]))
    comma, small, close = (one_of(draw, 2, k) == 0 for k in range(3))
    spans = []
    for k in np.flatnonzero(draw[0] < limit[row]):
        _, _, m, a = found[k]
        number = m[1].translate({46: ",", 44: "."}) if comma[k] else m[1]
        spans.append((a + m.start(), a + m.end(), number + ("" if close[k] else " ") + (m[2].lower() if small[k] else m[2].upper())))
    return x.spliced(spans)


def char_noise(x: Texts, limit: np.ndarray) -> Texts:
    n = len(x.cp)
    if not n:
        return x
    white = (x.cp <= 32) & np.isin(x.cp, WHITE)
    at = np.flatnonzero(~white & (limit[x.row] > 0))
    draw = x.draws("charnoise").at(x.row[at], at - x.start[x.row[at]])
    happens = draw[0] < limit[x.row[at]]
    at, draw = at[happens], draw[:, happens]
    kind = np.full(n, -1, np.int8)
    kind[at] = one_of(draw, 4)
    letter = np.zeros(n, np.uint32)
    letter[at] = 97 + one_of(draw, 26, 1)
    same = np.r_[x.row[1:] == x.row[:-1], False]  # the next one is of the same row
    before = np.r_[-1, np.where(same[:-1], kind[:-1], -1)]
    swaps = (kind == 3) & (before != 3) & same & ~np.r_[white[1:], True]
    gone = np.r_[False, swaps[:-1]]
    count = np.ones(n, np.int64)
    count[gone | (~swaps & (kind == 1))] = 0
    count[swaps | (~gone & (kind == 0))] = 2
    to, start = x.resized(count)
    out = np.repeat(x.cp, count)
    s = np.flatnonzero(swaps)
    out[to[s]], out[to[s] + 1] = x.cp[s + 1], x.cp[s]
    for k, off in ((0, 1), (2, 0)):
        own = np.flatnonzero((kind == k) & ~gone)
        out[to[own] + off] = letter[own]
    return Texts(out, start, x.place)


def _titled(word: str) -> str:
    runs, last = [], None
    for c in word:
        kind = unicodedata.category(c)[0] == "L"
        if kind == last:
            runs[-1] += c
        else:
            runs.append(c)
        last = kind
    return "".join(w[0].upper() + w[1:].lower() for w in runs)


def _words(x: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between single spaces that are not empty: where they begin and end, and the number of each in its row."""
    space = x.cp == 32
    opens = ~space & np.r_[True, space[:-1] | (x.row[1:] != x.row[:-1])]
    closes = ~space & np.r_[space[1:] | (x.row[1:] != x.row[:-1]), True]
    begin = np.flatnonzero(opens)
    return begin, np.flatnonzero(closes) + 1, x.numbered(space)[begin]


def vary_case(x: Texts, limit: np.ndarray) -> Texts:
    if not len(x.cp):
        return x
    begin, end, number = _words(x)
    draw = x.draws("case").at(x.row[begin], number)
    hit = draw[0] < limit[x.row[begin]]
    begin, end, how = begin[hit], end[hit], one_of(draw, 3)[hit]
    size = end - begin
    word = np.repeat(np.arange(len(begin)), size)
    at = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size) + begin[word]
    own = np.minimum(x.cp[at], TABLE - 1)
    plain = np.ones(len(begin), bool)
    plain[word[~PLAIN[own] | (x.cp[at] >= TABLE)]] = False
    run = np.r_[True, (LETTER[own][1:] != LETTER[own][:-1]) | (word[1:] != word[:-1])] if len(own) else np.zeros(0, bool)
    up = (how[word] == 0) | ((how[word] == 2) & run)
    cp = x.cp.copy()
    keep = plain[word]
    cp[at[keep]] = np.where(up, UPPER[own], LOWER[own])[keep]
    out = Texts(cp, x.start, x.place)
    change: list[Callable[[str], str]] = [str.upper, str.lower, _titled]
    return out.spliced([(begin[k], end[k], change[how[k]](x.text(begin[k], end[k]))) for k in np.flatnonzero(~plain)])


def vary_spaces(x: Texts, limit: np.ndarray) -> Texts:
    there = np.diff(x.start) > 0
    rows = np.flatnonzero(there)
    pads = np.zeros((2, len(x.place)), np.int64)
    for k, name in enumerate(("before", "after")):
        draw = x.draws(name).at(rows, np.zeros(len(rows), np.int64))
        pads[k, rows] = np.where(draw[0] < limit[rows], one_of(draw, 3) + 1, 0)
    at = np.flatnonzero(x.cp == 32)
    draw = x.draws("whitespace").at(x.row[at], x.numbered(x.cp == 32)[at])
    count = np.ones(len(x.cp), np.int64)
    count[at] = np.where(draw[0] < limit[x.row[at]], np.where(one_of(draw, 2) == 0, 2, 0), 1)
    to, start = x.resized(count)
    added = np.r_[0, np.cumsum(pads.sum(axis=0))]
    out = np.full(start[-1] + added[-1], 32, np.uint32)
    keep = count > 0
    out[(to + added[x.row] + pads[0][x.row])[keep]] = x.cp[keep]
    return Texts(out, start + added, x.place)


def rows_at_once(size: np.ndarray, most: int = 1 << 18) -> list[slice]:
    """Slices of rows of about `most` bytes."""
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    edges = [0, *cut.tolist(), len(size)]
    return [slice(a, z) for a, z in zip(edges, edges[1:], strict=False) if a < z]


def edited(text: pa.Array, place: pa.Array, change: Callable[[Texts, slice], Texts]) -> pa.Array:
    """The texts (null stays) after a change of the batch, some rows at a time."""
    parts = []
    for own in rows_at_once(np.asarray(pa.compute.fill_null(pa.compute.binary_length(text), 0))):
        rows = text.slice(own.start, own.stop - own.start)
        words = rows.to_pylist()
        cp = np.frombuffer("".join(w or "" for w in words).encode("utf-32-le"), "<u4")
        start = np.r_[0, np.cumsum([len(w or "") for w in words])]
        out = change(Texts(cp, start, [p.encode() for p in place.slice(own.start, len(words)).to_pylist()]), own)
        flat, at = out.cp.astype("<u4").tobytes().decode("utf-32-le"), out.start.tolist()
        parts.append(pa.array([None if w is None else flat[a:z] for w, a, z in zip(words, at, at[1:], strict=False)], pa.string()))
    return pa.chunked_array(parts, pa.string()).combine_chunks() if parts else pa.array([], pa.string())
