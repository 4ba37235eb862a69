"""Corpus profiles: counts, positives, natural duplicates, division shares."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate
from ..functions.text import key_of, normalise
from . import taxonomy


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def positives_by(pairs: DataFrame, *keys: str) -> DataFrame:
    """Pairs, positives and their share per key."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("n_positive")).withColumn("positive_rate", safe_rate(F.col("n_positive"), F.col("n_pairs")))


def excluded_share(df: DataFrame, wide: Iterable[str], narrow: Iterable[str]) -> DataFrame:
    """One row: rows in the wide set, in the narrow set, and the share that the narrow set leaves out."""
    code = F.substring("cpv_code", 1, 2)
    out = df.agg(F.count_if(F.coalesce(code.isin(list(wide)), F.lit(False))).alias("n_wide"), F.count_if(F.coalesce(code.isin(list(narrow)), F.lit(False))).alias("n_narrow"))
    return out.withColumn("excluded_share", safe_rate(F.col("n_wide") - F.col("n_narrow"), F.col("n_wide")))


def natural_duplicates(records: DataFrame) -> DataFrame:
    """One row: groups of one buyer and title key with several notices, notices in them, titles with several buyers."""
    rows = records.where("buyer_id is not null").select("buyer_id", key_of(normalise(F.col("title"))).alias("title_key"))
    groups = rows.groupBy("buyer_id", "title_key").agg(F.count("*").alias("n"))
    titles = groups.groupBy("title_key").agg(F.count("*").alias("buyers"))
    return groups.agg(F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_notices")).join(titles.agg(F.count_if(F.col("buyers") > 1).alias("n_shared_titles")), F.lit(True))


def profile(records: DataFrame, least: int = 50) -> DataFrame:
    """One row of corpus facts: sizes, labels, leaves, duplicates."""
    size = records.agg(F.count("*").alias("n_records_all"), F.count("description").alias("n_described"), F.min("release_date").alias("first_date"), F.max("release_date").alias("last_date"))
    parts = [taxonomy.coverage(records, "class", least), taxonomy.leaf_sparsity(records), taxonomy.imbalance(records, "division"), natural_duplicates(records)]
    for p in parts:
        size = size.join(p, F.lit(True))  # one row each
    return size
