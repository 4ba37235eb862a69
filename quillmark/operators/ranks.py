"""Gapless ranks of groups of any size, without a window over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import settled


def ranked(rows: DataFrame, keys: list[str], order: list[str], rank: str = "rank", size: str = "size") -> DataFrame:
    """rows plus the place (from 0) in the group of `keys` (not null) by `order`, and the group's size. Rows are sorted by range
    of both, so a hot group lies in many partitions: a place is the count of the partitions before plus that in the own one.
    Only counts per partition and group meet in a window. Rows that are equal in keys and order get places as they come."""
    by = [*keys, *order]
    run = settled(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    own = run.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), size: F.sum("_n").over(Window.partitionBy(*keys))}).drop("_n")
    return run.join(own, ["_part", *keys]).withColumn(rank, F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


#: Parts of an interval that a round of percentiles() counts.
BINS = 1024


def percentiles(rows: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles (linear between neighbours) of a column, None where it is empty. Each wanted rank lies in an interval of
    values; a round counts the interval's BINS parts and goes on with the part that holds the rank, between the least and
    greatest value there, so a round divides the range and no task or driver holds the values. Nulls and NaN don't count."""
    own = settled(rows.select(F.col(column).cast("double").alias("v")).where("v is not null and not isnan(v)"))
    n, low, high = own.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    wanted = sorted({k for p in shares for k in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))})
    open_: dict[int, tuple[float, float, int]] = {k: (low, high, 0) for k in wanted}  # rank: least, greatest, values below
    while todo := sorted({(a, z, below) for a, z, below in open_.values() if a < z}):
        parts = [F.when(F.col("v").between(a, z), F.struct(F.lit(i).alias("i"), F.least(F.floor((F.col("v") - a) / ((z - a) / BINS)), F.lit(BINS - 1)).alias("b"))) for i, (a, z, _) in enumerate(todo)]
        each = own.select("v", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("x")).groupBy("x.i", "x.b").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        found: dict[int, list] = {}
        for r in each.collect():
            found.setdefault(r["i"], []).append(r)
        for k, (a, z, below) in open_.items():
            if a < z:
                for r in sorted(found[todo.index((a, z, below))], key=lambda r: r["b"]):
                    if k < below + r["n"]:
                        open_[k] = (r["a"], r["z"], below)
                        break
                    below += r["n"]
    out = []
    for p in shares:
        at = p * (n - 1)
        k = int(at)
        a, z = open_[k][0], open_[min(k + 1, n - 1)][0]
        out.append(a + (z - a) * (at - k))
    return out
