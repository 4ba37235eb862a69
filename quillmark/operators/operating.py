"""Operating points: precision against the automated share, and the effort that is left."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate
from .matching import running


DEFAULT_TARGET = 0.95


def curve(scored: DataFrame, label: str = "label") -> DataFrame:
    """(threshold, precision, recall, automated_share), one row per distinct score; label is 1 where the answer is right."""
    own = scored.select("score", F.col(label).alias("label"))
    total = own.agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    r = running(own).join(total, F.lit(True))
    taken = F.col("tp") + F.col("fp")
    return r.select(F.col("score").alias("threshold"), safe_rate(F.col("tp"), taken).alias("precision"), safe_rate(F.col("tp"), F.col("pos")).alias("recall"), safe_rate(taken, F.col("n")).alias("automated_share"))


def automated_share(points: DataFrame, target: float = DEFAULT_TARGET) -> DataFrame:
    """One row: the lowest threshold whose precision reaches the target and the share it automates; NaN and 0 if none."""
    good = F.col("precision") >= target
    return points.agg(F.coalesce(F.min(F.when(good, F.col("threshold"))), F.lit(float("nan"))).alias("threshold"), F.coalesce(F.max(F.when(good, F.col("automated_share"))), F.lit(0.0)).alias("automated_share"))


def score_histogram(scored: DataFrame, bins: int = 1000) -> DataFrame:
    """(bin, low, high, pos, n): counts of scores (score in [0, 1], label) per bin. Histograms of parts add up."""
    b = F.least(F.greatest(F.floor(F.col("score") * bins), F.lit(0)), F.lit(bins)).cast("int").alias("bin")
    return scored.groupBy(b).agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("label").cast("bigint").alias("pos"), F.count("*").alias("n"))


def cascade_thresholds(histogram: DataFrame, target: float = DEFAULT_TARGET, bins: int = 1000) -> DataFrame:
    """One row: the bounds of a cascade that leave the fewest pairs between them to an adjudicator, where the share of matches
    among pairs accepted (score from `upper` on) and that of others among pairs rejected (up to `lower`) both reach the target.
    Accepted pairs are a suffix of the histogram and rejected ones a prefix, so each cut is judged by a running sum, and for
    each upper cut the best lower one is the last that holds below it. A bound that accepts (rejects) nothing is infinite. Of
    equal bands the one of the lower upper bound is taken. The windows run over at most bins + 2 rows."""
    cuts = histogram.sparkSession.range(bins + 2).select(F.col("id").cast("int").alias("bin")).join(histogram, "bin", "left").fillna(0, ["pos", "n"])
    up, down = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = cuts.select("bin", F.sum("n").over(up).alias("n_accepted"), F.sum("pos").over(up).alias("right"), F.min("low").over(up).alias("upper"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("n_rejected"), F.coalesce(F.sum("pos").over(down), F.lit(0)).alias("wrong"), F.max("high").over(down).alias("lower"))
    holds = F.col("n_rejected") - F.col("wrong") >= target * F.col("n_rejected")
    last = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.max(F.when(holds, F.struct("n_rejected", "lower"))).over(last)
    total = F.max("n_accepted").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    choices = sums.withColumns({"below": below, "n_pairs": total}).where(F.col("right") >= target * F.col("n_accepted"))
    band = F.col("n_pairs") - F.col("n_accepted") - F.col("below.n_rejected")
    best = choices.select(F.struct(band.alias("n_adjudicated"), "bin", F.coalesce("below.lower", F.lit(float("-inf"))).alias("lower"), F.coalesce("upper", F.lit(float("inf"))).alias("upper"), "n_accepted", F.col("below.n_rejected").alias("n_rejected"), "n_pairs").alias("c")).agg(F.min("c").alias("c"))
    return best.select("c.lower", "c.upper", "c.n_pairs", "c.n_accepted", "c.n_rejected", "c.n_adjudicated", safe_rate(F.col("c.n_adjudicated"), F.col("c.n_pairs")).alias("band_fraction"))


def residual_effort(n: int | Column, share: float | Column, mean_seconds: float | Column) -> dict:
    """Hours by hand, hours that remain and hours saved. The mean has no default: it must have
    been measured. Takes numbers or columns."""
    base = n * mean_seconds / 3600
    return {"baseline_hours": base, "residual_hours": base * (1 - share), "hours_saved": base * share}


def severity_grid(spark, severities: Iterable[float], seeds: Iterable[int]) -> DataFrame:
    """The cells of a severity sweep; each row parametrises one degraded run."""
    return spark.createDataFrame([(float(s), int(k)) for s in severities for k in seeds], "severity double, seed int")


def sweep_summary(cells: DataFrame) -> DataFrame:
    """Mean and spread over seeds of each metric (severity, seed, metric, value)."""
    return cells.groupBy("severity", "metric").agg(F.avg("value").alias("mean"), F.stddev("value").alias("sd"), F.count("*").alias("n_seeds"))
