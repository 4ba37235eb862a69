"""Exact Jaccard self-join on word shingles in metric space, and the classes it links.

1. Texts become sets of distinct hashed shingles. Equal sets are one class, stood for by its smallest id, so copies cost no
   pairs; a task names a class once, however many copies it meets.
2. First pivots are single shingles. Between whole documents nearly all Jaccard distances are 1, where pivots separate
   nothing; from a shingle, documents that hold it are at less than 1. All shingles have one order: rare ones first, by
   counts over the whole corpus in CELLS cells, so that common lines and passages come last. A set's Voronoi region is that
   of its first shingle. A linked set lacks at most (1 - t) * n of its n shingles, so by this window the set is
   replicated into the regions of its first n - ceil(t * n) + 1 shingles, and any two linked sets meet in one.
3. Inside a region, counts of shingles in fixed cells (a vector per set, at least n / 8 cells) bound the number of shingles
   that two sets differ in from below: this metric prunes by the triangle inequality. What may still be linked becomes
   one larger region by connected components. Regions of common shingles are parted by the sets' sizes first (linked sets
   lie in one band of sizes or in neighbouring ones); a band of over MAX_BAND sets is one region without being gathered.
4. There the join is exact, by document pivots: sets within the radius r of a pivot are linked to it; by the triangle
   inequality only sets between r and 2r from the pivot can link to those, so that window alone is compared with them; what
   lies beyond r is the next region, joined recursively.
5. Regions of over MAX_REGION shingles are never gathered: they are parted once more as in 2 and 3, by the exact counts of
   shingles inside the region, as long as that makes them smaller. What stays large meets pivots (one of each of some
   groups not yet linked, twice as many each round) joined to all its sets, until every pair left over lies in one group.

Returned: one row per document with its class and its component, never all pairs. Nothing of the corpus comes to the
driver but cell counts and bitmaps of bounded size. Shuffled: (1 - t) * n rows of two longs per document, and the sets of
documents in regions.

Edge cases: null and blank texts have an empty set, no links and their own id as component; a null id is kept, links with
nothing and has a null component; repeated rows of one id are one document; fewer words than a shingle make one shingle of
the whole sequence; very long texts are shingled whole; a similarity of exactly num / den links; shingles equally common
are ordered by their hash, and the least id names a class; an empty table gives an empty result. Only the id and text
columns are read, so other columns never clash. Hashes have 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from . import textkernel as K
from .components import components
from .scratch import bounded, discard, materialize

#: Cells of the shingle counts (4 MB while they are counted, 1 MB as an order).
CELLS = 1 << 20
CELL_CHUNK = 1 << 14
#: Classes that a task remembers, to name each once.
SEEN = 500_000
#: Pivot shingles with fewer sets (copies counted) than this, or four times the mean cell, are dealt by the shingle alone.
COMMON = 512
#: Sets of a region that are compared in memory (some MB); beyond it they stay one region.
MAX_BUCKET = 4096
MAX_BAND = 512
#: Shingles of one region that a task may hold (32 MB).
MAX_REGION = 4_000_000
#: Pivots of one region in the first round, where regions are too large for a task.
PIVOTS = 32
_U = np.uint64


class Threshold:
    """Similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def near(self, both: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        return self.den * both >= self.num * (a + b - both)

    def within_two(self, both: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Distance of at most twice the radius."""
        return self.den * both >= (2 * self.num - self.den) * (a + b - both)

    def window(self, size: int) -> int:
        """Shingles, from the first on, of which a linked set has one."""
        return size - -(-self.num * size // self.den) + 1

    def band(self, size: Column) -> Column:
        """Number of a band of sizes, a little wider than linked sets can be apart."""
        return F.floor(F.log(size.cast("double")) / F.lit(np.log(self.den / self.num) * 1.001 + 1e-9)).cast("long")

    def may(self, differ: np.ndarray, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
        """Whether sets that differ in at least so many shingles can be linked."""
        return differ * (self.den + self.num) <= (a + b) * (self.den - self.num)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes) of each text; lower-cased A-Z."""
    for at, words in K.chunks(column, lower=True):
        windows = words.windows(k)
        for i in range(len(words.first) - 1):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= k:
                yield at + i, np.unique(windows[a : b - k + 1])
            elif b > a:
                yield at + i, K.mix(np.array([np.sum(words.hash[a:b] * K._SEQ_POW.upto(b - a)) + _U(b - a)], np.uint64))
            else:
                yield at + i, np.zeros(0, np.uint64)


def cell_counts(docs: DataFrame, k: int) -> np.ndarray:
    """Ranks of shingles by how common they are, from counts over all documents in CELLS cells; from 128 on a cell is common.
    Each task adds up its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, words in K.chunks(batch.column("text"), lower=True):
                windows = words.windows(k)
                if len(windows):
                    total += np.bincount((windows >> _U(44)).astype(np.int64), minlength=CELLS)
        parts = total.astype(np.uint32).reshape(-1, CELL_CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                own = np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64)
                sums[c] = sums[c] + own if c in sums else own
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["chunk", "counts"])

    found = docs.mapInArrow(run, "chunk int, counts binary").repartition("chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    out = np.zeros((CELLS // CELL_CHUNK, CELL_CHUNK), np.uint64)
    for c, x in zip(found["chunk"].to_pylist(), found["counts"], strict=True):
        out[c] = np.frombuffer(x.as_buffer(), np.uint64)
    counts = out.ravel()
    # A quarter of an octave is fine enough to tell common from rare; the last rank bit says that a cell is common.
    common = counts >= max(COMMON, 4 * int(counts.mean()))
    return np.minimum(126, np.log2(counts + 1.0) * 4).astype(np.uint8) | (common.astype(np.uint8) << np.uint8(7))


def vector(own: np.ndarray) -> np.ndarray:
    """Counts (up to 255) of a set's shingles in a power of two of cells, at least an eighth of its size."""
    cells = 1 << max(3, (max(1, len(own)) // 8).bit_length())
    return np.minimum(255, np.bincount((own & _U(cells - 1)).astype(np.int64), minlength=cells)).astype(np.uint8)


def folded(counts: np.ndarray, cells: int) -> np.ndarray:
    """The vector over fewer cells."""
    return counts.reshape(-1, cells).sum(0, dtype=np.int32)


def _with_sets(docs: DataFrame, k: int, limit: Threshold) -> DataFrame:
    """(doc_id, n_shingles, class, first, rare, cells) of each row; first (pivot shingles, of which so many are rare) and cells
    (vector) only where the task meets the class for the first time."""
    sent = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, seen = sent.value, set()
        for batch in batches:
            ids = batch.column("doc_id")
            for at in range(0, len(batch), 1000):
                part, texts = ids.slice(at, 1000), batch.column("text").slice(at, 1000)
                known = part.is_valid().to_pylist()
                n, cls, first, rare, cells = [], [], [], [], []
                for i, own in shingle_sets(texts, k):
                    n.append(len(own))
                    c = int(K.mix(np.array([np.add.reduce(K.mix(own + _U(1)), dtype=np.uint64) + _U(len(own))], np.uint64))[0])
                    cls.append(c)
                    if not len(own) or not known[i] or c in seen:
                        for x in (first, rare, cells):
                            x.append(None)
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(c)
                    take = limit.window(len(own))
                    ranks = rank[(own >> _U(44)).astype(np.int64)]
                    order = np.argsort(ranks, kind="stable")[:take]  # own is sorted: ties go by hash
                    first.append(K.signed(own[order]))
                    rare.append(int((ranks[order] < 128).sum()))
                    cells.append(vector(own).tobytes())
                yield pa.RecordBatch.from_arrays([part, pa.array(n, pa.int64()), pa.array(K.signed(np.array(cls, np.uint64))), pa.array(first, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(cells, pa.binary())], names=["doc_id", "n_shingles", "class", "first", "rare", "cells"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, class bigint, first array<bigint>, rare int, cells binary")


def link_bucket(sizes: list[int], cells: list[bytes], limit: Threshold) -> list[int]:
    """For each set, a set before it (or itself) that leads to every set it may be linked with: a forest in which sets that
    may be linked are connected."""
    m = len(sizes)
    root = list(range(m))
    if m > MAX_BUCKET:
        return [0] * m
    size = np.array(sizes)
    raw = [np.frombuffer(c, np.uint8) for c in cells]
    order = np.argsort(size, kind="stable")
    levels: dict[int, np.ndarray] = {}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    ordered = size[order]
    for a in range(m - 1):
        i = int(order[a])
        # Partners are no larger than size / t; their vectors are folded to the cells of the smaller set.
        to = int(np.searchsorted(ordered, size[i] * limit.den // limit.num, "right"))
        if to <= a + 1:
            continue
        width = len(raw[i])
        if width not in levels:
            levels.clear()
            fit = [j for j in order[a:] if len(raw[j]) >= width]
            levels[width] = (np.stack([folded(raw[j], width) for j in fit]), a)
        table, begin = levels[width]
        mine = folded(raw[i], width)
        apart = np.abs(table[a + 1 - begin : to - begin] - mine).sum(1)
        for j in order[a + 1 : to][limit.may(apart, size[i], ordered[a + 1 : to])].tolist():
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(m)]


#: Key of a set of members: their number, least and largest, and two sums of independent hashes.
_MEMBERS = ["c", "lo", "hi", "h", "g"]


def _members(over=lambda x: x) -> list[Column]:
    """The key of the classes of a pivot."""
    cls = F.col("class")
    return [over(x).alias(n) for n, x in zip(_MEMBERS, (F.count("*"), F.min(cls), F.max(cls), F.sum(F.xxhash64(cls) % 2**40), F.sum(F.xxhash64(cls, F.lit(1)) % 2**40)), strict=True)]


def _one_each(pivots: DataFrame) -> DataFrame:
    """Many pivots of near copies have the same members: one of them is enough."""
    return pivots.groupBy(*_MEMBERS).agg(F.min("pivot").alias("pivot"))


def _common_regions(rows: DataFrame, vectors: DataFrame, limit: Threshold) -> tuple[DataFrame, DataFrame]:
    """(pivot, class, cells, n) of the size bands of common pivots, and edges (u, v) of the bands too large to compare. Counts
    are partial before they are shuffled, so a pivot that a third of all sets hold fills no task."""
    common = rows.select("class", F.explode(F.slice("first", F.col("rare") + 1, F.size("first"))).alias("pivot"))
    pick = materialize(_one_each(common.groupBy("pivot").agg(*_members()).where("lo < hi")).select("pivot"), "common-pivots")
    own = common.join(pick, "pivot", "left_semi").join(vectors.select("class", "n"), "class")
    own = own.select("class", F.explode(F.array(limit.band(F.col("n")), limit.band(F.col("n")) - 1)).alias("_qm_band"), F.col("pivot").alias("_qm_pivot")).select(F.xxhash64("_qm_pivot", "_qm_band").alias("pivot"), "class").distinct()
    own = materialize(own, "common-bands")
    bands = materialize(_one_each(own.groupBy("pivot").agg(*_members()).where("lo < hi")), "bands")
    small = own.join(bands.where(F.col("c") <= MAX_BAND).select("pivot"), "pivot", "left_semi").join(vectors, "class").select("pivot", "class", "cells", "n")
    return small, own.join(bands.where(F.col("c") > MAX_BAND).select("pivot", "lo"), "pivot").select(F.col("class").alias("u"), F.col("lo").alias("v"))


def _regions(rows: DataFrame, limit: Threshold) -> DataFrame:
    """(node, component) of classes that may be linked with another, from (class, n_shingles, first, rare, cells)."""
    rows = rows.where("first is not null")
    member = rows.select("class", F.explode(F.slice("first", F.lit(1), F.col("rare"))).alias("pivot"))
    w = Window.partitionBy("pivot")
    meet = materialize(member.select("pivot", "class", *_members(lambda x: x.over(w))).where("lo < hi"), "meetings")
    vectors = rows.groupBy("class").agg(F.first("cells").alias("cells"), F.first("n_shingles").cast("long").alias("n"))
    own = meet.join(_one_each(meet), "pivot", "left_semi").select("pivot", "class").join(vectors, "class").select("pivot", "class", "cells", "n")
    banded, edges = _common_regions(rows, vectors, limit)
    own = own.unionByName(banded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, classes, sizes, cells, hub = None, [], [], [], None
        u, v = [], []

        def done() -> None:
            for i, r in enumerate(link_bucket(sizes, cells, limit)):
                if r != i:
                    u.append(classes[i])
                    v.append(classes[r])

        for batch in batches:
            for p, c, n, x in zip(batch.column("pivot").to_pylist(), batch.column("class").to_pylist(), batch.column("n").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if p != now:
                    done()
                    now, classes, sizes, cells, hub = p, [], [], [], None
                if hub is not None:  # a region too large to compare stays one region, without being held
                    u.append(c)
                    v.append(hub)
                elif not classes or classes[-1] != c:
                    classes.append(c)
                    sizes.append(n)
                    cells.append(x)
                    if len(classes) > MAX_BUCKET:
                        done()
                        hub, classes, sizes, cells = classes[0], [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
            u, v = [], []
        done()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    found = own.repartition("pivot").sortWithinPartitions("pivot", "class").mapInArrow(run, "u bigint, v bigint")
    return components(found.union(edges))


def _counts(flat: np.ndarray, first: np.ndarray, mark: np.ndarray) -> np.ndarray:
    return np.add.reduceat(mark[flat], first[:-1], dtype=np.int64)


def join_region(ids: list[int], sets: list[np.ndarray], limit: Threshold) -> list[int]:
    """The least id of each set's component, by exact comparison around pivots."""
    n = len(ids)
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def union(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)

    order = sorted(range(n), key=lambda i: ids[i])
    sizes = np.array([len(s) for s in sets])
    universe, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    own = [flat[begin[i] : begin[i + 1]] for i in range(n)]
    mark = np.zeros(len(universe), np.int32)
    left = np.array(order)
    while len(left) > 1:
        first = np.concatenate([[0], np.cumsum(sizes[left])])
        rows = np.concatenate([own[i] for i in left])
        pivot = left[0]
        mark[own[pivot]] = 1
        both = _counts(rows, first, mark)
        mark[own[pivot]] = 0
        linked = limit.near(both, sizes[left], sizes[pivot])
        window = ~linked & limit.within_two(both, sizes[left], sizes[pivot])
        near = left[linked]
        for i in near[1:]:
            union(int(pivot), int(i))
        if len(near) > 1 and window.any():
            near_first = np.concatenate([[0], np.cumsum(sizes[near])])
            near_rows = np.concatenate([own[i] for i in near])
            for z in left[window]:
                mark[own[z]] = 1
                shared = _counts(near_rows, near_first, mark)
                mark[own[z]] = 0
                if limit.near(shared, sizes[near], sizes[z]).any():
                    union(int(pivot), int(z))
        left = left[~linked]
    best: dict[int, int] = {}
    for i in range(n):
        r = find(i)
        best[r] = min(best.get(r, ids[i]), ids[i])
    return [best[find(i)] for i in range(n)]


def _sets_of(docs: DataFrame, regions: DataFrame, k: int) -> DataFrame:
    """(region, rep, own): the sets of the documents in regions. A bitmap of their ids spares all others the shuffle."""
    table = bitmap.collect(regions, "rep")
    sent = docs.sparkSession.sparkContext.broadcast(table)
    docs = docs.where("doc_id is not null")
    if table is None:  # too many for a bitmap: the texts are joined before they are shingled
        docs = docs.join(regions, docs["doc_id"] == regions["rep"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is not None:
                batch = batch.filter(pa.array(bitmap.contains(sent.value, batch.column("doc_id").to_numpy())))
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sets = [K.signed(own) for _, own in shingle_sets(part.column("text"), k)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "own"])

    sets = docs.mapInArrow(run, "doc_id bigint, own array<bigint>")
    return sets.join(regions, sets["doc_id"] == regions["rep"]).select("region", "rep", "own")


def _small_regions(sets: DataFrame, limit: Threshold) -> DataFrame:
    """(rep, component) of regions that a task may hold, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, ids, own = None, [], []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(join_region(ids, own, limit), pa.int64())], names=["rep", "component"])

        for batch in batches:
            lists = batch.column("own")
            values, first = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for i, (r, rep) in enumerate(zip(batch.column("region").to_pylist(), batch.column("rep").to_pylist(), strict=True)):
                if r != region:
                    if ids:
                        yield done()
                    region, ids, own = r, [], []
                if not ids or ids[-1] != rep:
                    ids.append(rep)
                    own.append(values[first[i] : first[i + 1]].copy())
        if ids:
            yield done()

    return sets.repartition("region").sortWithinPartitions("region", "rep").mapInArrow(run, "rep bigint, component bigint")


def _parted(sets: DataFrame, limit: Threshold) -> DataFrame:
    """(rep, component): regions within regions, by the exact counts of shingles inside each; sets without a region stand
    alone and are linked with none."""
    shingles = sets.select("region", "rep", F.explode("own").alias("s"))
    counts = shingles.groupBy("region", "s").agg(F.count("*").alias("c"))
    # A shingle of one set makes no link: it needs no row, but it counts as one of the rarest.
    shared = shingles.join(counts.where("c > 1"), ["region", "s"]).groupBy("region", "rep").agg(F.collect_list(F.struct("c", F.xxhash64("region", "s").alias("s"))).alias("shared"))
    both = sets.join(shared, ["region", "rep"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                n, first, rare, cells = [], [], [], []
                for own, shared in zip(part.column("own"), part.column("shared"), strict=True):
                    own = own.values.to_numpy().view(np.uint64)
                    ordered = sorted((x["c"], x["s"]) for x in shared.as_py())
                    ordered = ordered[: max(0, limit.window(len(own)) - (len(own) - len(ordered)))]
                    n.append(len(own))
                    first.append([s for _, s in ordered])
                    rare.append(sum(c < COMMON for c, _ in ordered))
                    cells.append(vector(own).tobytes())
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(rare, pa.int32()), pa.array(cells, pa.binary())], names=["class", "n_shingles", "first", "rare", "cells"])

    rows = materialize(both.select("rep", "own", "shared").mapInArrow(run, "class bigint, n_shingles bigint, first array<bigint>, rare int, cells binary"), "parted")
    return _regions(rows, limit).select(F.col("node").alias("rep"), "component")


def _pivot_rounds(sets: DataFrame, limit: Threshold) -> DataFrame:
    """(rep, component) of regions of any size: rounds of pivots against all sets of their region, twice as many each time."""
    labels = materialize(sets.select("region", "rep", F.col("rep").alias("component"), F.lit(False).alias("done")), "labels")
    edges, most = None, PIVOTS
    while True:
        # Only pairs of sets that have not been pivots and lie in different groups are still open.
        groups = labels.where("not done").groupBy("region", "component").agg(F.min_by("rep", F.xxhash64("rep")).alias("rep"))
        open_regions = groups.groupBy("region").agg(F.count("*").alias("c")).where("c > 1").select("region")
        dealt = groups.join(open_regions, "region", "left_semi").groupBy("region", F.pmod(F.xxhash64("rep", F.lit(most)), F.lit(most)).alias("k")).agg(F.min("rep").alias("rep"))
        chosen = materialize(dealt.select("region", "rep"), "pivots")
        if chosen.isEmpty():
            return labels.select("rep", "component")
        pivots = chosen.join(sets, ["region", "rep"]).select("region", F.col("rep").alias("pivot"), F.col("own").alias("p_own"))
        both = F.size(F.array_intersect("own", "p_own")).cast("long")
        total = F.size("own") + F.size("p_own")
        near = sets.join(pivots, "region").where("rep <> pivot").where(F.least(F.size("own"), F.size("p_own")) * limit.den >= F.greatest(F.size("own"), F.size("p_own")) * limit.num)
        found = near.where(both * limit.den >= (total - both) * limit.num).select(F.col("rep").alias("u"), F.col("pivot").alias("v"))
        edges = materialize(found if edges is None else edges.union(found), "links")
        comp = components(edges)
        after = materialize(
            labels.drop("component")
            .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
            .join(chosen.select("rep", F.lit(True).alias("p")), "rep", "left")
            .select("region", "rep", F.coalesce("component", "rep").alias("component"), (F.col("done") | F.coalesce("p", F.lit(False))).alias("done")),
            "labels",
        )
        discard(labels)
        labels, most = after, most * 2


def _joined_regions(sets: DataFrame, limit: Threshold, max_region: int) -> DataFrame:
    """(rep, component) of the sets (region, rep, own): small regions in a task each, large ones parted again."""
    sets = materialize(sets.dropDuplicates(["region", "rep"]).withColumn("above", F.lit(1 << 59)), "region-sets")
    parts = []
    while True:
        weight = materialize(sets.groupBy("region").agg(F.sum(F.size("own")).alias("w"), F.first("above").alias("above")), "region-weights")
        large = F.col("w") > max_region
        parts.append(_small_regions(sets.join(weight.where(~large).select("region"), "region", "left_semi"), limit))
        # A region that parting has made smaller by a tenth or more is parted again.
        shrinks = F.col("w") * 10 <= F.col("above") * 9
        stuck = weight.where(large & ~shrinks).select("region")
        if not stuck.isEmpty():
            parts.append(_pivot_rounds(materialize(sets.join(stuck, "region", "left_semi").drop("above"), "stuck-regions"), limit))
        wide = weight.where(large & shrinks).select("region", "w")
        if wide.isEmpty():
            return reduce(DataFrame.union, parts)
        now = materialize(sets.drop("above").join(wide, "region").withColumnRenamed("w", "above"), "large-regions")
        sets = materialize(now.join(_parted(now, limit), "rep").select(F.col("component").alias("region"), "rep", "own", "above"), "region-sets")


def link(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_region: int = MAX_REGION) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): one row for each row of docs. class_id is the smallest id with an
    equal set; component_id the smallest id that links reach."""
    limit = Threshold(num, den)
    slim = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(_with_sets(slim, k, limit), "shingles")
    classes = materialize(rows.where("doc_id is not null and n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    linked = _regions(rows, limit).withColumnRenamed("node", "class")
    regions = materialize(linked.join(classes, "class").select("rep", F.col("component").alias("region")), "regions")

    found = _joined_regions(_sets_of(slim, regions, k), limit, max_region)
    named = classes.join(found.groupBy("rep").agg(F.min("component").alias("component")), "rep", "left").select("class", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "class").join(named, "class", "left")
    alone = F.col("class_id").isNull() | F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")
