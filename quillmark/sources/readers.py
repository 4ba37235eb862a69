"""Readers: strict schemas, nothing inferred, headers verified before any job runs."""

from __future__ import annotations

import warnings
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ledger import LEDGER_SCHEMA

TIMING_SCHEMA = "item_id string, seconds double, started_at string, abandoned boolean"
# The header of a notice bundle, and the code and description columns of its two classification files.
NOTICE_COLUMNS = [
    "id", "tag", "date", "ocid", "language", "initiationType", "buyer_id", "buyer_name", "tender_id", "tender_mainProcurementCategory", "tender_title", "tender_status",
    "tender_procurementMethodDetails", "tender_description", "tender_procurementMethod", "tender_datePublished", "tender_suitability_sme", "tender_suitability_vcse",
    "tender_tenderPeriod_endDate", "tender_classification_id", "tender_classification_scheme", "tender_classification_description", "tender_contractPeriod_endDate",
    "tender_contractPeriod_startDate", "tender_value_amount", "tender_value_currency", "tender_minValue_amount", "tender_minValue_currency", "tender_procedure_isAccelerated",
    "title", "tender_communication_futureNoticeDate", "tender_procedure_acceleratedRationale",
]
CLASSIFICATION_FILES = {"main.csv": ("tender_classification_id", "tender_classification_description"), "tender_additionalClassifications.csv": ("id", "description")}


_RECORDS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("text", pa.string())])


class SchemaMismatch(RuntimeError):
    """A file's columns differ from those agreed. Reconcile them; nothing is coerced."""


def _stitched(pieces: DataFrame) -> DataFrame:
    """(file, first, record): records that lie in several blocks, from their pieces (file, block, opens, first, text)."""
    w = Window.partitionBy("file").orderBy("block", "opens")
    numbered = pieces.withColumn("n", F.sum(F.col("opens").cast("int")).over(w))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("block", "opens", "text"))), lambda p: p["text"])
    return numbered.groupBy("file", "n").agg(F.bool_or("first").alias("first"), F.array_join(lines, "\n").alias("record")).select("file", "first", "record")


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, first, record): the records of quoted CSV files as text; first marks those that begin a file. Files are read by
    lines in byte ranges, so many tasks share one. A line end is inside a field where the quotes before it are odd in number:
    their parity is summed per range, then over the ranges before (a small table), and each task cuts its range into records
    with the parity it begins with. What reaches over a range's edge is put together from its pieces, at most two a range."""
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("file", "block").agg((F.sum(quotes) % 2).cast("int").alias("odd"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = odd.select("file", "block", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    marked = lines.join(F.broadcast(starts), ["file", "block"]).select("file", "block", "inside", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, inside, head, held, number = None, False, False, [], 0
        out: list[dict] = []

        def piece(kind: str) -> dict:
            text = "\n".join(held)
            held.clear()
            return {"file": at[0], "block": at[1], "kind": kind, "first": at[1] == 0 and number == 0, "text": text}

        for batch in batches:
            for file, block, odd_start, line in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if (file, block) != at:
                    if held:  # reaches into the next range, or is all of this one inside a field
                        out.append(piece("middle" if head else "opens"))
                    at, inside, number = (file, block), bool(odd_start), 0
                    head = inside
                held.append(line)
                inside ^= line.count('"') % 2 == 1
                if not inside:
                    out.append(piece("ends" if head else "whole"))
                    head, number = False, number + 1
            if out:
                yield pa.RecordBatch.from_pylist(out, _RECORDS)
                out = []
        if held:
            yield pa.RecordBatch.from_pylist([piece("middle" if head else "opens")], _RECORDS)

    from ..sources.sinks import work_folder, write_table

    # One folder per kind, so that no expression over whole records is ever evaluated on a piece: as a plain filter, the kind may be
    # checked after an expression that both sides of a predicate share, and a piece is malformed CSV.
    cut, path = marked.mapInArrow(run, "file string, block bigint, kind string, first boolean, text string"), work_folder(spark, "csv")
    write_table(cut, path, "errorifexists", "kind")
    cut = spark.read.schema(cut.schema).parquet(path)
    whole = cut.where("kind = 'whole'").select("file", "first", F.col("text").alias("record"))
    long = _stitched(cut.where("kind <> 'whole'").select("file", "block", (F.col("kind") == "opens").alias("opens"), "first", "text"))
    return whole.unionByName(long)


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Quoted CSV with newlines inside fields; every column is a string, and a blank is an empty string. Columns are those of
    the header; a record of another number of fields, or another header in a further file, is an error."""
    options = {"quote": '"', "escape": '"', "maxCharsPerColumn": "-1", "mode": "FAILFAST", "multiLine": "true"}
    header = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", **options)
    text = F.regexp_replace("record", "\r$", "")
    records = csv_records(spark, path).withColumn("record", F.when(F.col("first"), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)).where("record <> ''")
    schema = ", ".join(f"`{c.replace('`', '``')}` STRING" for c in header.columns)
    rows = records.select("first", F.from_csv("record", schema, options).alias("r"))
    own = F.array(*(F.coalesce(F.col("r")[c], F.lit("")) for c in header.columns))
    told = F.array(*(F.lit(c) for c in header.columns))
    checked = rows.where(~F.col("first") | F.when(own == told, F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("header differs: "), F.array_join(own, ","))).cast("boolean")))
    return checked.select("r.*").fillna("")


def verify_columns(df: DataFrame, expected: Iterable[str], path: str) -> DataFrame:
    """df, if its columns are exactly the expected ones in any order."""
    there, want = set(df.columns), set(expected)
    if there != want:
        raise SchemaMismatch(f"{path}: missing {sorted(want - there)}, extra {sorted(there - want)}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_bundle(spark: SparkSession, year_dir: str, expected: Iterable[str] = tuple(NOTICE_COLUMNS), name: str = "main.csv") -> DataFrame:
    path = f"{year_dir}/{name}"
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return verify_columns(read_csv(spark, path), expected, path)


def read_benchmark(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(records of both tables, labelled pairs with their split). Ids get the prefix of their table; a pair that names an
    unknown record is refused."""
    records = None
    for table in ("A", "B"):
        raw = read_csv(spark, f"{folder}/table{table}.csv")
        own = raw.select(F.concat(F.lit(f"{table}:"), F.col("id")).alias("record_id"), F.col("name").alias("title"), F.nullif(F.col("description"), F.lit("")).alias("description"), *(F.lit(None).cast("string").alias(c) for c in ("manufacturer", "model", "serial_number", "buyer_id", "cpv_code")), F.lit(None).cast("date").alias("release_date"), F.lit("abtbuy").alias("source"), F.lit(table).alias("table"))
        records = own if records is None else records.unionByName(own)
    pairs = None
    for split in ("train", "valid", "test"):
        raw = read_csv(spark, f"{folder}/{split}.csv")
        own = raw.select(F.concat(F.lit("A:"), F.col("ltable_id")).alias("left_id"), F.concat(F.lit("B:"), F.col("rtable_id")).alias("right_id"), F.col("label").cast("int").alias("label"), F.lit(split).alias("split"))
        pairs = own if pairs is None else pairs.unionByName(own)
    check_references(pairs, records)
    return records, pairs


def check_references(pairs: DataFrame, records: DataFrame) -> None:
    ids = pairs.select(F.explode(F.array("left_id", "right_id")).alias("record_id"))
    if n := ids.join(records.select("record_id"), "record_id", "left_anti").count():
        raise ValueError(f"{n} pair members name unknown records")


def read_codes(spark: SparkSession, bundles: Iterable[str]) -> DataFrame:
    """(code, description) of all classification files that are there; blank codes are gone."""
    out = None
    for bundle in bundles:
        for name, (code, text) in CLASSIFICATION_FILES.items():
            if exists(spark, path := f"{bundle}/{name}"):
                own = read_csv(spark, path).select(F.trim(code).alias("code"), F.trim(text).alias("description")).where("code <> ''")
                out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no classification file found")
    return out


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The call ledger; a missing file is empty, torn and blank lines are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).json(path, mode="DROPMALFORMED")


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """The timing log; a malformed line is an error."""
    return spark.read.schema(TIMING_SCHEMA).json(path, mode="FAILFAST")


def accept_local(path: str, spark: SparkSession) -> str:
    """Stands in for a download: a path that is already there."""
    if not exists(spark, path):
        warnings.warn("fetching over a network is out of scope; copy the files there", stacklevel=2)
        raise FileNotFoundError(path)
    return path
