"""Code taxonomy: harvest, hierarchy, support and sparsity of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import label_at, level_of, safe_rate, short_form


def description_counts(codes: DataFrame) -> DataFrame:
    """(code, description, n) with both sides trimmed and blank codes gone."""
    return codes.select(F.trim("code").alias("code"), F.trim("description").alias("description")).where("code <> ''").groupBy("code", "description").agg(F.count("*").alias("n"))


def best_descriptions(codes: DataFrame) -> DataFrame:
    """The most frequent description of each code; the first in order among equals."""
    w = Window.partitionBy("code").orderBy(F.desc("n"), "description")
    return description_counts(codes).withColumn("rank", F.row_number().over(w)).where("rank = 1").select("code", "description")


def conflicting_codes(codes: DataFrame) -> DataFrame:
    return description_counts(codes).groupBy("code").agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("codes_with_conflicting_descriptions"))


def build(codes: DataFrame) -> DataFrame:
    """(cpv_code, cpv_code_full, cpv_description, level, parent_code) from rows (code, description): three levels by
    truncation; ancestors that were never published come without a description. ValueError on an empty harvest."""
    best = best_descriptions(codes)
    if best.isEmpty():
        raise ValueError("no codes harvested")
    own = best.where(F.col("code").rlike("^[0-9]{8}$")).select(short_form(F.col("code")).alias("cpv_code"), F.col("code").alias("cpv_code_full"), F.col("description").alias("cpv_description"), level_of(F.col("code")).alias("level"))
    own = own.groupBy("cpv_code", "level").agg(F.min_by("cpv_description", "cpv_code_full").alias("cpv_description"), F.min("cpv_code_full").alias("cpv_code_full"))
    ups = own.select(F.explode(F.filter(F.array(F.when(F.col("level") == 8, F.substring("cpv_code", 1, 4)), F.when(F.col("level") > 2, F.substring("cpv_code", 1, 2))), lambda x: x.isNotNull())).alias("cpv_code")).distinct()
    made = ups.join(own, "cpv_code", "left_anti").select("cpv_code", F.rpad("cpv_code", 8, "0").alias("cpv_code_full"), F.lit(None).cast("string").alias("cpv_description"), F.length("cpv_code").alias("level"))
    whole = own.select("cpv_code", "cpv_code_full", "cpv_description", "level").union(made)
    parent = F.when(F.col("level") == 4, F.substring("cpv_code", 1, 2)).when(F.col("level") == 8, F.substring("cpv_code", 1, 4))
    return whole.withColumn("parent_code", parent)


def missing_ancestors(taxonomy: DataFrame) -> DataFrame:
    """Rows whose parent is not in the taxonomy; none in a built one."""
    parents = taxonomy.select(F.col("cpv_code").alias("parent_code"))
    return taxonomy.where("parent_code is not null").join(parents, "parent_code", "left_anti")


def label_counts(train: DataFrame, level: str, code_col: str = "cpv_code") -> DataFrame:
    return train.groupBy(label_at(F.col(code_col), level).alias("label")).agg(F.count("*").alias("n"))


def supported_labels(train: DataFrame, level: str, least: int = 50, code_col: str = "cpv_code") -> DataFrame:
    return label_counts(train, level, code_col).where(F.col("n") >= least)


def coverage(train: DataFrame, level: str, least: int = 50, code_col: str = "cpv_code") -> DataFrame:
    """One row: labels seen and supported, and the share of rows whose label is supported (0 for an empty frame)."""
    n = label_counts(train, level, code_col)
    return n.agg(F.count("*").alias("n_labels"), F.count_if(F.col("n") >= least).alias("n_supported"), safe_rate(F.coalesce(F.sum(F.when(F.col("n") >= least, F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).alias("coverage"))


def leaf_sparsity(df: DataFrame, code_col: str = "cpv_code") -> DataFrame:
    n = df.where(F.col(code_col).isNotNull()).groupBy(code_col).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_distinct_leaves"), F.count_if(F.col("n") >= 20).alias("n_leaves_ge_20"), F.count_if(F.col("n") >= 50).alias("n_leaves_ge_50"), F.count_if(F.col("n") == 1).alias("n_singleton_leaves"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_records"))


def imbalance(df: DataFrame, level: str, code_col: str = "cpv_code") -> DataFrame:
    n = label_counts(df, level, code_col)
    return n.agg(F.max("n").alias("largest"), F.min("n").alias("smallest"), (F.max("n") / F.min("n")).alias("imbalance_ratio"), F.count_if(F.col("n") == 1).alias("n_singletons"))
