"""Exact cosine join inside groups: the pairs of one group whose cosine reaches a threshold, without listing the others.

The angle between vectors is a metric, so a few pivots of each group and everyone's angles to them are an index:

1. Equal vectors of a group are one class, represented by its least record_id; its members are linked to that.
2. Each group has PIVOTS pivots, its vectors of the least hashes. A vector's home is its nearest pivot.
3. Vectors are numbered by (home, angle to it) in distributed ranks and cut into chunks of at most CHUNK. A chunk knows the
   least and greatest angle of its vectors to every pivot: its box.
4. Two chunks can hold a pair within the angle r only if, for every pivot, their ranges of angles are at most r apart (triangle
   inequality). Chunks find each other by bands of the angle to the first one's home, then the boxes decide.
5. What is left is scored chunk against chunk, a product of two matrices of a bounded size.

For counts, two chunks whose greatest angles to some pivot add up to less than a threshold's angle count whole. High-dimensional
vectors that lie at right angles to each other leave little to prune at low thresholds; the join is exact all the same, and no
task holds more than two chunks.

Rows without group or vector, and zero vectors, are in no pair. Vectors of a group must have one length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import choose_two, dot, safe_rate, unit
from ..sources.sinks import settled
from .ranks import ranked

PIVOTS = 8
CHUNK = 1024
#: Angles to pivots are of vectors in single precision.
SLACK = 1e-4


def classes(vectors: DataFrame, group: str) -> DataFrame:
    """(grp, vector, record_id, weight): each different vector of a group, its least record_id and number of rows."""
    own = vectors.select(F.col(group).alias("grp"), "record_id", F.col("vector").cast("array<float>").alias("vector")).where("grp is not null and exists(vector, x -> x <> 0)")
    return own.groupBy("grp", "vector").agg(F.min("record_id").alias("record_id"), F.count("*").alias("weight"))


def _angle(a: Column, b: Column) -> Column:
    return F.acos(F.least(F.greatest(dot(a, b), F.lit(-1.0)), F.lit(1.0)))


def chunks(reps: DataFrame, pivots: int = PIVOTS, size: int = CHUNK) -> DataFrame:
    """The written index: (cid, grp, home, low, high, ids, weights, flat) per chunk; flat has the vectors one after another."""
    own = reps.withColumn("u", unit(F.col("vector")))
    first = Window.partitionBy("grp").orderBy(F.xxhash64("record_id"), "record_id")
    chosen = own.select("grp", "record_id", "u").withColumn("k", F.row_number().over(first)).where(F.col("k") <= pivots)
    table = chosen.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "u"))), lambda x: x["u"]).alias("pivots"))
    placed = own.join(table, "grp").withColumn("angles", F.transform("pivots", lambda p: _angle(F.col("u"), p))).drop("pivots", "u")
    placed = placed.withColumn("near", F.array_min("angles")).withColumn("home", F.array_position("angles", F.col("near")).cast("int") - 1)
    cut = ranked(placed, ["grp", "home"], ["near", "record_id"]).withColumn("chunk", F.expr(f"rank div {size}"))
    ends = lambda f, i: f(F.get("angles", F.lit(i)))
    out = cut.groupBy("grp", "home", "chunk").agg(
        F.filter(F.array(*(ends(F.min, i) for i in range(pivots))), lambda x: x.isNotNull()).alias("low"),
        F.filter(F.array(*(ends(F.max, i) for i in range(pivots))), lambda x: x.isNotNull()).alias("high"),
        F.collect_list(F.struct("record_id", "weight", "vector")).alias("m"),
    )
    each = lambda f: F.transform("m", lambda x: x[f])
    return settled(out.select(F.monotonically_increasing_id().alias("cid"), "grp", "home", "low", "high", each("record_id").alias("ids"), each("weight").alias("weights"), F.flatten(each("vector")).alias("flat")))


def near_chunks(index: DataFrame, least: float) -> DataFrame:
    """(grp, a, b, apart): pairs of chunks (a <= b) that may hold a pair of vectors within the angle of `least`; apart is the
    greatest angle that such a pair can have."""
    reach = math.acos(least) + SLACK
    width = max(reach, 0.05)
    band = lambda x: F.floor(x / width)
    boxes = index.select("grp", "cid", "home", "low", "high")
    own = lambda name: F.element_at(F.col(name), F.col("home") + 1)
    a = boxes.select("grp", F.col("cid").alias("a"), F.col("home").alias("pivot"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(band(own("low") - reach), band(own("high") + reach))).alias("band"))
    b = boxes.select("grp", F.col("cid").alias("b"), F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "ends"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
    b = b.withColumn("band", F.explode(F.sequence(band(F.col("ends.low")), band(F.col("ends.high"))))).drop("ends")
    close = F.forall(F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y)), lambda gap: gap <= reach)
    apart = F.array_min(F.zip_with("high_a", "high_b", lambda x, y: x + y)) + SLACK
    return a.join(b, ["grp", "pivot", "band"]).where(F.col("a") <= F.col("b")).where(close).select("grp", "a", "b", apart.alias("apart")).distinct()


def _matched(index: DataFrame, least: float) -> DataFrame:
    side = lambda s: index.select(F.col("cid").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("ids", "weights", "flat")))
    return near_chunks(index, least).join(side("a"), "a").join(side("b"), "b")


def _matrix(flat: pa.ListScalar, n: int) -> np.ndarray:
    m = flat.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _scored(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """(row, cosines, ids, ids, weights, weights) per pair of chunks; a chunk with itself has only the part above the diagonal."""
    for i in range(len(batch)):
        at = lambda c, i=i: batch.column(batch.schema.get_field_index(c))[i]
        ids_a, ids_b = at("ids_a").values, at("ids_b").values
        s = _matrix(at("flat_a"), len(ids_a)) @ _matrix(at("flat_b"), len(ids_b)).T
        if at("a").as_py() == at("b").as_py():
            s[np.tril_indices(len(ids_a))] = -2.0
        yield i, s, ids_a, ids_b, at("weights_a").values.to_numpy(), at("weights_b").values.to_numpy()


def cosine_join(vectors: DataFrame, group: str, least: float, pivots: int = PIVOTS, size: int = CHUNK) -> DataFrame:
    """(left_id, right_id, score) for records (record_id, group, vector): pairs of different vectors of one group whose cosine
    is `least` (over 0) or more, between the least record_ids of their vectors, and each least record_id with the others that
    have its vector."""
    if not 0 < least <= 1:
        raise ValueError(f"least must be in (0, 1], got {least}")
    reps = settled(classes(vectors, group))
    kind = dict(vectors.dtypes)["record_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, ids_a, ids_b, _, _ in _scored(batch):
                x, y = np.nonzero(s >= least)
                for k in range(0, len(x), 100_000):
                    p, q = x[k : k + 100_000], y[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([ids_a.take(pa.array(p)), ids_b.take(pa.array(q)), pa.array(s[p, q])], names=["x", "y", "score"])

    found = _matched(chunks(reps, pivots, size), least).mapInArrow(run, f"x {kind}, y {kind}, score double")
    pairs = found.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "score")
    several = reps.where("weight > 1").select("grp", "vector", F.col("record_id").alias("left_id"))
    own = vectors.select(F.col(group).alias("grp"), F.col("record_id").alias("right_id"), F.col("vector").cast("array<float>").alias("vector"))
    copies = own.join(several, ["grp", "vector"]).where("left_id < right_id").select("left_id", "right_id", F.lit(1.0).alias("score"))
    return pairs.unionByName(copies)


def cosine_links(vectors: DataFrame, group: str, least: float, pivots: int = PIVOTS, size: int = CHUNK) -> DataFrame:
    """(record_id, class_id, n_links) of records in a group: class_id is the least record_id with the record's vector, n_links the
    number of classes whose cosine with it is `least` (over 0) or more. Rows grow with the records, not with their pairs."""
    if not 0 < least <= 1:
        raise ValueError(f"least must be in (0, 1], got {least}")
    reps = settled(classes(vectors, group))
    kind = dict(vectors.dtypes)["record_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, s, ids_a, ids_b, _, _ in _scored(batch):
                near = s >= least
                for ids, n in ((ids_a, near.sum(axis=1)), (ids_b, near.sum(axis=0))):
                    yield pa.RecordBatch.from_arrays([ids, pa.array(n)], names=["class_id", "n"]).filter(pa.array(n > 0))

    links = _matched(chunks(reps, pivots, size), least).mapInArrow(run, f"class_id {kind}, n bigint").groupBy("class_id").agg(F.sum("n").alias("n_links"))
    known = reps.join(links, F.col("record_id") == F.col("class_id"), "left").select("grp", "vector", F.col("record_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = vectors.select(F.col(group).alias("grp"), "record_id", F.col("vector").cast("array<float>").alias("vector"))
    return own.join(known, ["grp", "vector"]).select("record_id", "class_id", "n_links")


def pair_counts(vectors: DataFrame, group: str, cuts: list[float], pivots: int = PIVOTS, size: int = CHUNK) -> DataFrame:
    """One row: n_pairs, all pairs of one group, and above, for each cut (ascending, over 0) the pairs of a greater cosine and of
    that cosine or a greater one, as (gt, ge). Counts come from chunks and weights; no pair is a row."""
    if not cuts or cuts[0] <= 0 or sorted(cuts) != cuts:
        raise ValueError(f"cuts must ascend from above 0, got {cuts}")
    sizes = vectors.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum(choose_two(F.col("n"))), F.lit(0)).cast("bigint").alias("n_pairs"))
    reps = settled(classes(vectors, group))
    angles = [math.acos(c) for c in cuts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(cuts), 2), np.int64)
        for batch in batches:
            apart = batch.column(batch.schema.get_field_index("apart")).to_numpy()
            for i, s, _, _, wa, wb in _scored(batch):
                pairs = np.multiply.outer(wa, wb)
                whole = int(pairs[s > -2].sum())
                for k, (cut, angle) in enumerate(zip(cuts, angles, strict=True)):
                    inside = apart[i] < angle
                    sums[k] += (whole, whole) if inside else (int(pairs[s > cut].sum()), int(pairs[s >= cut].sum()))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array(sums[:, 0]), pa.array(sums[:, 1])], names=["cut", "gt", "ge"])

    between = _matched(chunks(reps, pivots, size), cuts[0]).mapInArrow(run, "cut int, gt bigint, ge bigint")
    copies = reps.where("weight > 1").agg(F.sum(choose_two(F.col("weight"))).alias("n"))
    equal = copies.select(F.explode(F.sequence(F.lit(0), F.lit(len(cuts) - 1))).alias("cut"), F.when(F.element_at(F.array(*map(F.lit, cuts)), F.col("cut") + 1) < 1, F.coalesce("n", F.lit(0))).otherwise(0).alias("gt"), F.coalesce("n", F.lit(0)).alias("ge"))
    per = between.unionByName(equal).groupBy("cut").agg(F.sum("gt").alias("gt"), F.sum("ge").alias("ge"))
    above = per.agg(F.transform(F.array_sort(F.collect_list(F.struct("cut", "gt", "ge"))), lambda x: F.struct(x["gt"].alias("gt"), x["ge"].alias("ge"))).alias("above"))
    return total.join(above, F.lit(True))


def band_stats(vectors: DataFrame, group: str, lower: float, upper: float) -> DataFrame:
    """What a cascade with these bounds would hand to its adjudicator, over all pairs of one group."""
    counts = pair_counts(vectors, group, [lower, upper])
    inside = (F.col("above")[0]["gt"] - F.col("above")[1]["ge"]).alias("n_adjudicated")
    return counts.select("n_pairs", inside).withColumn("band_fraction", safe_rate(F.col("n_adjudicated"), F.col("n_pairs")))
