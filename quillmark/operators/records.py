"""Records: mapping from raw notices, validation, the discard waterfall and its report."""

from __future__ import annotations

import warnings
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import tolerant_date
from ..functions.text import normalise

RECORD_SCHEMA = T.StructType([T.StructField(c, T.DateType() if c == "release_date" else T.StringType()) for c in ("record_id", "title", "description", "manufacturer", "model", "serial_number", "buyer_id", "cpv_code", "release_date", "source")])
RECORD_COLUMNS = RECORD_SCHEMA.names
OPTIONAL = ["description", "manufacturer", "model", "serial_number", "buyer_id", "cpv_code", "release_date"]
# Sources, raw column names, divisions and boilerplate descriptions.
SOURCES = ["contractsfinder", "abtbuy", "upload"]
FIELD_MAP = {"record_id": "id", "title": "tender_title", "description": "tender_description", "buyer_id": "buyer_id", "cpv_code": "tender_classification_id", "release_date": "date"}
DIVISIONS = ["30", "31", "32", "33", "38", "39", "42", "43", "44", "48"]
BOILERPLATE = ["as per tender", "contract award notice", "transparency only", "notice of awarded contract following a mini competition", "call off from fcdo services ref xly120 121 21cc"]
MIN_CHARS = 60
REASONS = ["out_of_scope", "short", "desc_equals_title", "boilerplate"]


class SchemaError(ValueError):
    """A frame is no record frame."""


def to_records(raw: DataFrame, year: int, source: str = SOURCES[0], reference: str = "tender_id") -> DataFrame:
    """Raw notices as records, with tender_ref and bundle_year; rows without a title go."""
    empty_is_null = lambda c: F.nullif(F.col(FIELD_MAP[c]), F.lit("")).alias(c)
    out = raw.select(
        *(F.col(FIELD_MAP[c]).alias(c) if c == "record_id" else tolerant_date(F.col(FIELD_MAP[c])).alias(c) if c == "release_date" else empty_is_null(c) if c in FIELD_MAP else F.lit(source).alias(c) if c == "source" else F.lit(None).cast("string").alias(c) for c in RECORD_COLUMNS),
        F.nullif(F.col(reference), F.lit("")).alias("tender_ref"),
        F.lit(year).alias("bundle_year"),
    )
    return out.where(F.col("title").isNotNull())


def violations(df: DataFrame) -> DataFrame:
    """One row of counts: what validate() refuses, in one aggregate."""
    filled = {c: (F.count(c) if c in df.columns else F.lit(0)).alias(f"filled_{c}") for c in OPTIONAL}
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("record_id").isNull()).alias("null_ids"),
        (F.count("record_id") - F.count_distinct("record_id")).alias("duplicate_ids"),
        F.count_if(F.col("title").isNull()).alias("null_titles"),
        F.count_if(~F.coalesce(F.col("source").isin(SOURCES), F.lit(False))).alias("unknown_sources"),
        *filled.values(),
    )


def validate(df: DataFrame) -> DataFrame:
    """df, if it is a record frame; SchemaError otherwise. Optional columns that are all null warn."""
    if missing := [c for c in RECORD_COLUMNS if c not in df.columns]:
        raise SchemaError(f"missing columns: {missing}")
    if df.schema["release_date"].dataType != T.DateType():
        raise SchemaError("release_date is no date")
    r = violations(df).first().asDict()
    for what in ("null_ids", "duplicate_ids", "null_titles", "unknown_sources"):
        if r[what]:
            raise SchemaError(f"{what}: {r[what]}")
    if r["n_rows"] and (bare := [c for c in OPTIONAL if not r[f"filled_{c}"]]):
        warnings.warn(f"columns without any value: {bare}", stacklevel=2)
    return df


def discard_reason(code: Column, title: Column, description: Column, divisions: Iterable[str] = DIVISIONS, min_chars: int = MIN_CHARS, blocklist: Iterable[str] = BOILERPLATE) -> Column:
    """The first rule that a record fails; null if it is kept. title and description are normal forms."""
    whole = F.trim(F.concat(title, F.lit(" "), description))
    return (
        F.when(~F.coalesce(F.substring(code, 1, 2).isin(list(divisions)), F.lit(False)), REASONS[0])
        .when(F.length(whole) < min_chars, REASONS[1])
        .when(description == title, REASONS[2])
        .when(description.isin(list(blocklist)), REASONS[3])
    )


def waterfall(df: DataFrame, **rules) -> DataFrame:
    """df plus discard_reason, in one pass. Normal forms are columns of their own, so the rules share them."""
    forms = {"_qm_title": normalise(F.col("title")), "_qm_description": normalise(F.col("description"))}
    reason = discard_reason(F.col("cpv_code"), F.col("_qm_title"), F.col("_qm_description"), **rules)
    return df.withColumns(forms).withColumn("discard_reason", reason).drop(*forms)


def discard_report(judged: DataFrame, *keys: str) -> DataFrame:
    """Rows in, dropped by each rule, and out: one row, or one per key."""
    reason = F.col("discard_reason")
    return judged.groupBy(*keys).agg(F.count("*").alias("total_in"), *(F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"dropped_{r}") for r in REASONS), F.count_if(reason.isNull()).alias("total_out"))


def combined_report(judged: DataFrame, key: str) -> DataFrame:
    """discard_report per key and over all (null key), by rollup."""
    reason = F.col("discard_reason")
    return judged.rollup(key).agg(F.count("*").alias("total_in"), *(F.count_if(F.coalesce(reason == r, F.lit(False))).alias(f"dropped_{r}") for r in REASONS), F.count_if(reason.isNull()).alias("total_out"))


def check_report(report: DataFrame) -> None:
    """AssertionError unless every row counts itself out."""
    bad = report.where(F.col("total_in") - sum((F.col(f"dropped_{r}") for r in REASONS), F.lit(0)) != F.col("total_out"))
    if not bad.isEmpty():
        raise AssertionError("discard counts do not add up")


def kept(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("discard_reason").isNull()).drop("discard_reason")


def in_divisions(df: DataFrame, divisions: Iterable[str]) -> DataFrame:
    return df.where(F.substring("cpv_code", 1, 2).isin(list(divisions)))
