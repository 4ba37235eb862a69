"""Benchmark decontamination by the q-gram lemma, with banded alignment as proof.

An item of m characters that stands in a text with at most k edits shares m - Q + 1 - k * Q of its q-grams with it, all
inside a band of diagonals no wider than k. Hits of q-grams are counted in overlapping bands (2k wide, every k);
neighbouring bands that reach the bound form a region, which is aligned within the band, and the text is contaminated when
the item fits within its edit budget k = floor(EDITS * m). Items under Q characters have no q-gram: they count where they
stand exactly, with no letter or digit beside them. Items for which the bound is under 1 (13 to 15 characters) are parted
into k + 1 pieces, of which one must stand exactly; one automaton finds these and the short items in one pass. Texts and items are compared case-folded, white space as one space.

Repeated q-grams (rules of dashes, say) would give hits x places of the item. A slice of text with more than MOST_HITS of
them is halved down to LEAST_SLICE characters; beyond that its costliest q-grams are left out of the count, and the bound
of each item falls by the places it loses, so nothing is missed. Items that lose too many are looked for by the number of
their q-grams in a stretch of text; equal stretches are aligned once.

Items come in blocks of at most BLOCK_CHARS characters, each broadcast for itself; a worker takes its texts past all
blocks in one pass, without a shuffle, and keeps CACHED indexes.

Edge cases: null and empty texts are clean; null ids of documents are kept; items of null or blank text are not looked
for; items of equal normal form count once, under the least id (null first); very long texts are searched whole, in
slices that overlap by an item; of several places of an item the one of fewest edits is reported; an empty benchmark
leaves every text clean, an empty table gives an empty result; repeated rows are judged each for itself. clean() keeps all
columns of docs as they are, mark() reads the id and text alone, so names of other columns never clash."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

Q = 8
EDITS = 0.08
BLOCK_CHARS = 2_000_000
CHUNK, LEAST_SLICE = 1 << 20, 1 << 16
#: Pairs of a hit and a place of an item that are counted at a time (some 100 MB).
MOST_HITS = 2_000_000
#: Indexes that a worker keeps; with more blocks it holds HELD bytes of texts for each pass.
CACHED, HELD = 2, 32 << 20
#: Alignments remembered by their text.
MEMO = 20_000
_U = np.uint64
_B1 = 0x9E3779B97F4A7C15 | 1
_BASE = [_U(pow(_B1, e, 2**64)) for e in (1, 2, 4)]
_SPREAD = _U(0xD6E8FEB86659FD93)
TABLE_BITS = 22
END = "\0"
FAR = 1 << 40


def normal(text: str) -> str:
    return " ".join(text.casefold().split())


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray) -> np.ndarray:
    """Hash of the Q = 8 characters from each position on."""
    h = (points.astype(np.uint64) + _U(1)) * _SPREAD
    h ^= h >> _U(29)
    for e, step in enumerate((1, 2, 4)):
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * _BASE[e] + h[step:]
    return h * _SPREAD


def banded_distance(item: np.ndarray, region: np.ndarray, most: int) -> int | None:
    """Least edits that turn item into some part of region, if at most `most`; None beyond. The part may begin on any
    diagonal from 0 to len(region) - len(item) + most, and only cells within `most` of those are computed."""
    m, n = len(item), len(region)
    spread = max(0, n - m) + most
    far = np.int32(1 << 20)
    row = np.zeros(n + 1, np.int32)
    slope = np.arange(n + 1, dtype=np.int32)
    for i, c in enumerate(item, 1):
        lo, hi = max(0, i - 1 - most), min(n, i + spread)
        if lo > hi:
            return None
        now = np.full(n + 1, far, np.int32)
        now[lo : hi + 1] = row[lo : hi + 1] + 1
        now[lo + 1 : hi + 1] = np.minimum(now[lo + 1 : hi + 1], row[lo:hi] + (region[lo:hi] != c))
        now[lo : hi + 1] = np.minimum.accumulate(now[lo : hi + 1] - slope[lo : hi + 1]) + slope[lo : hi + 1]  # gaps within the row
        row = now
        if row.min() > most:
            return None
    return int(row.min())


class Index:
    """Q-grams of a block of items, and the search of texts for them."""

    def __init__(self, items: list[tuple[int | None, str]], edits: float = EDITS):
        short = [x for x in items if 0 < len(x[1]) < Q]
        items = [x for x in items if len(x[1]) >= Q]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.points = [code_points(t) for t in self.texts]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.budget = np.floor(self.size * edits + 1e-9).astype(np.int64)
        self.least = self.size - Q + 1 - self.budget * Q
        self.reach = int((self.size + self.budget).max(initial=0))
        weak = np.flatnonzero(self.least < 1)  # here the lemma says nothing
        self.least[weak] = FAR
        self.exact = self._automaton(short, weak.tolist())
        own = [grams(p) if n < FAR else np.zeros(0, np.uint64) for p, n in zip(self.points, self.least, strict=True)]
        every = np.concatenate(own) if own else np.zeros(0, np.uint64)
        where = np.repeat(np.arange(len(own), dtype=np.int32), [len(g) for g in own])
        place = np.concatenate([np.arange(len(g), dtype=np.int32) for g in own]) if own else np.zeros(0, np.int32)
        order = np.argsort(every, kind="stable")
        self.item, self.place = where[order], place[order]
        self.gram, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.gram >> _U(64 - TABLE_BITS)).astype(np.int64)] = True
        self.memo: dict[tuple[int, str], int | None] = {}

    def _automaton(self, short: list[tuple[int | None, str]], weak: list[int]) -> ahocorasick.Automaton | None:
        """Short items as they are, and pieces of the weak ones: k + 1 pieces, of which k edits leave one as it is."""
        keys: dict[str, list[tuple[bool, int | None, int]]] = {}
        for i, t in short:
            keys.setdefault(t, []).append((True, i, 0))
        for i in weak:
            n, k = len(self.texts[i]), int(self.budget[i]) + 1
            for j in range(k):
                a, z = n * j // k, n * (j + 1) // k
                keys.setdefault(self.texts[i][a:z], []).append((False, i, a))
        if not keys:
            return None
        out = ahocorasick.Automaton()
        for key, told in keys.items():
            out.add_word(key, (len(key), told))
        out.make_automaton()
        return out

    def search(self, texts: list[str]) -> list[dict[int | None, int]]:
        """{item id: least edits} for each normalised text."""
        found: list[dict[int, int]] = [{} for _ in texts]
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < CHUNK):
                size += len(texts[to]) + 1
                to += 1
            pieces = [(d, 0, len(texts[d])) for d in range(at, to)]
            if self.ids:
                self._pieces(texts, pieces, found)
            at = to
        out: list[dict[int | None, int]] = [{} for _ in texts]
        for d, text in enumerate(texts):
            if self.exact is not None:
                out[d] |= self._exact_in(text, found[d])
            out[d] |= {self.ids[i]: e for i, e in found[d].items()}
        return out

    def _exact_in(self, text: str, found: dict[int, int]) -> dict[int | None, int]:
        """One pass for whatever must stand exactly: the items under Q characters with no letter or digit beside them, and pieces
        of weak items, around which those are aligned (into found)."""
        out: dict[int | None, int] = {}
        for end, (size, told) in self.exact.iter(text):
            a, z = end + 1 - size, end + 1
            for whole, i, at in told:
                if whole:
                    if i not in out and not (a and text[a - 1].isalnum()) and not (z < len(text) and text[z].isalnum()):
                        out[i] = 0
                elif found.get(i, 1) > 0:
                    k, low = int(self.budget[i]), a - at
                    e = self._edits(i, text[max(0, low - k) : low + int(self.size[i]) + k])
                    if e is not None and e < found.get(i, k + 1):
                        found[i] = e
        return out

    def _pieces(self, texts: list[str], pieces: list[tuple[int, int, int]], found: list[dict[int, int]]) -> None:
        """Counts the hits of pieces (text, from, to) of texts and aligns the regions that reach the bound."""
        points = code_points(END.join(texts[d][a:z] for d, a, z in pieces))
        hashes = grams(points)
        hit = np.flatnonzero(self.table[(hashes >> _U(64 - TABLE_BITS)).astype(np.int64)])
        g = np.searchsorted(self.gram, hashes[hit]).clip(max=len(self.gram) - 1)
        same = self.gram[g] == hashes[hit]
        hit, g = hit[same], g[same]
        if not len(hit):
            return
        many = self.first[g + 1] - self.first[g]
        cold = np.ones(len(g), bool)
        need = self.least
        if int(many.sum()) > MOST_HITS:
            if len(pieces) > 1:
                self._pieces(texts, pieces[: len(pieces) // 2], found)
                self._pieces(texts, pieces[len(pieces) // 2 :], found)
                return
            d, a, z = pieces[0]
            if z - a > max(LEAST_SLICE, 4 * self.reach):
                middle = (a + z) // 2
                self._pieces(texts, [(d, a, middle + self.reach)], found)
                self._pieces(texts, [(d, middle, z)], found)
                return
            # The cheapest q-grams that keep within the bound are counted; items lose the places of the others.
            kinds, which, times = np.unique(g, return_inverse=True, return_counts=True)
            cost = times * (self.first[kinds + 1] - self.first[kinds])
            order = np.argsort(cost, kind="stable")
            dear = np.zeros(len(kinds), bool)
            dear[order[np.cumsum(cost[order]) > MOST_HITS]] = True
            cold = ~dear[which]
            lost = np.bincount(self.item[_ranges(self.first[kinds[dear]], self.first[kinds[dear] + 1])], minlength=len(self.ids))
            need = self.least - lost
        begins = np.cumsum([0, *(z - a + 1 for _, a, z in pieces)])
        for i, low, high in self._banded(hit[cold], g[cold], need):
            self._align(texts, pieces, begins, i, low, high, found)
        for i in np.flatnonzero(need < 1).tolist():
            for low, high in self._crowded(i, hit, g):
                self._align(texts, pieces, begins, i, low, high, found)

    def _banded(self, hit: np.ndarray, g: np.ndarray, need: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, from, to) of regions whose bands have the hits that an item needs."""
        many = self.first[g + 1] - self.first[g]
        where = _ranges(self.first[g], self.first[g + 1])
        item = self.item[where].astype(np.int64)
        diagonal = np.repeat(hit, many) - self.place[where] + self.size[item]  # never negative
        step = np.maximum(self.budget[item], 1)
        band = diagonal // step
        keys = np.concatenate([item << 40 | band, item << 40 | (band - 1).clip(0)])
        keys, counts = np.unique(keys, return_counts=True)
        item = keys >> 40
        keys = keys[(counts >= need[item]) & (need[item] > 0)]
        if not len(keys):
            return
        cut = np.flatnonzero(np.diff(keys) > 1) + 1
        for a, z in zip(keys[np.r_[0, cut]].tolist(), keys[np.r_[cut, len(keys)] - 1].tolist(), strict=True):
            i = a >> 40
            k, size = int(self.budget[i]), int(self.size[i])
            step, mask = max(k, 1), (1 << 40) - 1
            yield i, (a & mask) * step - size - k, (z & mask) * step + 2 * step + k

    def _crowded(self, i: int, hit: np.ndarray, g: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of text, as long as the item may be, that hold enough q-grams of it in any order."""
        mine = np.zeros(len(self.gram), bool)
        mine[np.searchsorted(self.gram, grams(self.points[i]))] = True
        at = hit[mine[g]]
        reach, least = int(self.size[i] + self.budget[i]), int(self.least[i])
        # A stretch from at[j] on has enough where the hit `least` - 1 further on is still within reach.
        at = at[: max(0, len(at) - least + 1)][at[least - 1 :] - at[: max(0, len(at) - least + 1)] < reach]
        if not len(at):
            return
        cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
        for a, z in zip(at[np.r_[0, cut]].tolist(), at[np.r_[cut, len(at)] - 1].tolist(), strict=True):
            yield a - reach, z + reach

    def _align(self, texts: list[str], pieces: list, begins: np.ndarray, i: int, low: int, high: int, found: list[dict[int, int]]) -> None:
        """Aligns item i with the region low to high, in each piece that it touches."""
        size, k = int(self.size[i]), int(self.budget[i])
        for p in range(max(0, int(np.searchsorted(begins, max(low, 0), "right")) - 1), len(pieces)):
            if begins[p] >= high:
                return
            d, begin, end = pieces[p]
            a, z = begin + max(0, low - int(begins[p])), min(end, begin + high - int(begins[p]))
            best = found[d].get(i, k + 1)
            if z - a < size - k or best == 0:
                continue
            text = texts[d]
            if text.find(self.texts[i], a, z) >= 0:
                found[d][i] = 0
            elif k:
                # Long regions go window by window, each with the reach of the item beyond the next one's begin.
                stride = max(size, Q * Q)
                for x in range(a, z, stride):
                    window = text[x : min(z, x + stride + size + k)]
                    if len(window) >= size - k and (e := self._edits(i, window)) is not None and e < best:
                        best = found[d][i] = e
                        if e == 1:
                            break

    def _edits(self, i: int, window: str) -> int | None:
        key = (i, window)
        if key not in self.memo:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[key] = banded_distance(self.points[i], code_points(window), int(self.budget[i]))
        return self.memo[key]


def _ranges(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The numbers from each a up to its z, one range after another."""
    many = z - a
    return np.repeat(a - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast items, at most about BLOCK_CHARS characters at a time."""
    items = benchmark.where(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(F.col(id_col).cast("long")).alias("id"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    out = []
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == b).select("id", "text").toArrow()
        own: dict[str, int | None] = {}
        for i, t in sorted(zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
            if t := normal(t):
                own.setdefault(t, i)
        if own:
            out.append(benchmark.sparkSession.sparkContext.broadcast([(i, t) for t, i in own.items()]))
    return out


_BUILT: dict = {}


def _index(block) -> Index:
    """The index of a block; a worker keeps the last CACHED ones."""
    if (key := id(block)) not in _BUILT:
        while len(_BUILT) >= CACHED:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[key] = (block, Index(block.value))
    return _BUILT[key][1]


def _searched(batches: Iterator[pa.RecordBatch], own: list, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Each batch with what all blocks find in its texts. All blocks pass in one go over the texts held."""
    held: list[pa.RecordBatch] = []
    room = HELD if len(own) > CACHED else 0

    def flush() -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
        texts = [[normal(v.as_py() or "") for v in b.column(b.schema.get_field_index(text_col))] for b in held]
        found: list[list[dict]] = [[{} for _ in t] for t in texts]
        for block in own:
            index = _index(block)
            for t, f in zip(texts, found, strict=True):
                for mine, new in zip(f, index.search(t), strict=True):
                    mine |= new
        yield from zip(held, found, strict=True)
        held.clear()

    for batch in batches:
        for at in range(0, len(batch), 500):
            held.append(batch.slice(at, 500))
            if sum(b.nbytes for b in held) > room:
                yield from flush()
    yield from flush()


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_items, items, contaminated): one row for each row of docs; items are item:edits, joined by commas."""
    slim = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, own, "text"):
            items = [",".join(f"{i}:{e}" for i, e in sorted(x.items(), key=lambda y: (y[0] is not None, y[0] or 0))) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in found], pa.int64()), pa.array(items, pa.string()), pa.array([bool(x) for x in found])], names=["doc_id", "n_items", "items", "contaminated"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, n_items bigint, items string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without contaminated rows; all columns stay."""
    own = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _searched(batches, own, text_col):
            yield batch.filter(pa.array([not x for x in found], pa.bool_()))

    return bounded(docs).mapInArrow(run, docs.schema)


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
