"""Frozen splits: temporal for records, supplied for pairs, with invariants that hold on every load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CUTOFF = "2025-01-01"


class SplitOverlap(ValueError):
    """dev and test share members, or one of them is empty."""


def temporal_part(date: Column, cutoff: str = CUTOFF) -> Column:
    """test from the cutoff on, else dev; a null date is dev."""
    return F.when(F.coalesce(date >= F.lit(cutoff).cast("date"), F.lit(False)), F.lit("test")).otherwise(F.lit("dev"))


def supplied_part(split: Column) -> Column:
    return F.when(split == "test", F.lit("test")).otherwise(F.lit("dev"))


def freeze_records(records: DataFrame, cutoff: str = CUTOFF) -> DataFrame:
    return records.select("record_id", temporal_part(F.col("release_date"), cutoff).alias("part"))


def freeze_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select("left_id", "right_id", supplied_part(F.col("split")).alias("part"))


def overlap(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One row: members in both parts, and members of each."""
    per = parts.groupBy(*keys).agg(F.max((F.col("part") == "dev").cast("int")).alias("d"), F.max((F.col("part") == "test").cast("int")).alias("t"))
    return per.agg(F.coalesce(F.sum(F.col("d") * F.col("t")), F.lit(0)).alias("n_shared"), F.coalesce(F.sum("d"), F.lit(0)).alias("n_dev"), F.coalesce(F.sum("t"), F.lit(0)).alias("n_test"))


def check(parts: DataFrame, keys: list[str], both: bool = True) -> DataFrame:
    r = overlap(parts, keys).first()
    if r["n_shared"] or (both and not (r["n_dev"] and r["n_test"])):
        raise SplitOverlap(str(r.asDict()))
    return parts


def write(parts: DataFrame, keys: list[str], path: str, overwrite: bool = False) -> None:
    """Freezes parts; an existing split is only replaced when told."""
    check(parts, keys).withColumn("frozen_at", F.current_timestamp()).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return check(spark.read.parquet(path), keys)


def select(df: DataFrame, parts: DataFrame, part: str, keys: list[str]) -> DataFrame:
    """Rows of one part; pairs match in their order."""
    return df.join(parts.where(F.col("part") == part).select(*keys), keys, "left_semi")
