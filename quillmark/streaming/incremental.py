"""Incremental import: each micro-batch is normalised, blocked against the register and itself, scored and routed.

The reference workload has no stream; this is its one natural extension. The register is a folder of Parquet tables, partitioned
by the hashed block key: a batch names the buckets that it touches (at most BUCKETS numbers), and the scan is pruned to them.
Records of batches lie under `batches`; compact() makes one base table of them, which counts once its number is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import key_of, leading_token, normalise, token_grams
from ..sources.readers import exists
from ..sources.shared import Folder
from ..sources.sinks import settled

BUCKETS = 128
ROWS = "record_id string, title_norm string, title_key string, block_key string, grams array<string>, bucket int, batch_id int"


def prepare(records: DataFrame) -> DataFrame:
    """Records with normal title, comparison key, block key (null without a leading token) and its bucket, and grams."""
    own = records.select("record_id", normalise(F.col("title")).alias("title_norm"))
    title = F.col("title_norm")
    key = F.coalesce(leading_token(title), F.lit(""))
    return own.select("record_id", "title_norm", key_of(title).alias("title_key"), F.nullif(key, F.lit("")).alias("block_key"), token_grams(title).alias("grams"), F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"))


def read_register(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The register's rows of batches before a number, from some buckets alone where these are named."""
    bases = list(map(int, Folder(spark, f"{path}/bases").names()))
    parts = [(f"{path}/base-{max(bases)}", F.lit(True))] if bases else []
    if exists(spark, f"{path}/batches"):
        parts.append((f"{path}/batches", F.col("batch_id") > (max(bases) if bases else -1)))
    out = spark.createDataFrame([], ROWS)
    for folder, wanted in parts:
        out = out.unionByName(spark.read.schema(ROWS).parquet(folder).where(wanted))
    if before is not None:
        out = out.where(F.col("batch_id") < before)
    return out if buckets is None else out.where(F.col("bucket").isin(buckets))


def score_batch(own: DataFrame, register: DataFrame, duplicate_from: float, new_to: float) -> DataFrame:
    """(record_id, best_id, similarity, decision) of prepared rows, against the register and the batch's own rows of a smaller
    record_id: 1 where the comparison keys are equal (the least such record), else the best Jaccard similarity of grams within the
    block. Rows without a block key meet by equal keys alone. Equal rows meet by their key, so copies cost what they number."""
    known = register.select(F.col("record_id").alias("known_id"), "bucket", "title_key", "block_key", F.col("grams").alias("known_grams"))
    inside = own.select(F.col("record_id").alias("known_id"), "bucket", "title_key", "block_key", F.col("grams").alias("known_grams"))
    first = known.select("known_id", "title_key", F.lit(0).alias("turn")).unionByName(inside.select("known_id", "title_key", F.lit(1).alias("turn"))).where("title_key <> ''").groupBy("title_key").agg(F.min(F.struct("turn", "known_id")).alias("f"))
    equal = own.join(first, "title_key").where((F.col("f.turn") == 0) | (F.col("f.known_id") < F.col("record_id"))).select("record_id", F.col("f.known_id").alias("known_id"), F.lit(1.0).alias("s"))
    # One row stands for all of an equal key, on either side of the comparison.
    one = lambda rows: rows.where("block_key is not null").groupBy("bucket", "block_key", "title_key").agg(F.min(F.struct("known_id", "known_grams")).alias("k")).select("bucket", "block_key", "title_key", "k.*")
    left = own.join(equal.select("record_id"), "record_id", "left_anti").where("block_key is not null").select("record_id", "bucket", "block_key", "title_key", "grams")
    both = F.size(F.array_intersect("grams", "known_grams"))
    score = F.coalesce(F.try_divide(both, F.size("grams") + F.size("known_grams") - both), F.lit(0.0))
    near = lambda rows: left.join(rows.withColumnRenamed("title_key", "known_key"), ["bucket", "block_key"]).where("title_key <> known_key")
    pairs = near(one(known)).unionByName(near(one(inside)).where("known_id < record_id")).select("record_id", "known_id", score.alias("s")).unionByName(equal)
    best = pairs.groupBy("record_id").agg(F.max_by("known_id", F.struct("s", "known_id")).alias("best_id"), F.max("s").alias("similarity"))
    s = F.coalesce("similarity", F.lit(0.0))
    return own.select("record_id").join(best, "record_id", "left").select("record_id", "best_id", s.alias("similarity"), F.when(s >= duplicate_from, "duplicate").when(s <= new_to, "new").otherwise("uncertain").alias("decision"))


def import_batch(spark: SparkSession, batch: DataFrame, batch_id: int, register_path: str, decisions_path: str, duplicate_from: float = 0.8, new_to: float = 0.4) -> None:
    """One micro-batch; written under its number, so a replay after a failure replaces its own output only."""
    own = settled(prepare(batch))
    buckets = [r[0] for r in own.select("bucket").distinct().collect()]
    decided = score_batch(own, read_register(spark, register_path, batch_id, buckets), duplicate_from, new_to)
    decided.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{decisions_path}/batch={batch_id}")
    fresh = spark.read.parquet(f"{decisions_path}/batch={batch_id}").where("decision = 'new'").select("record_id")
    rows = own.join(fresh, "record_id", "left_semi").withColumn("batch_id", F.lit(batch_id)).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(f"{register_path}/batches")


def compact(spark: SparkSession, register_path: str, upto: int) -> None:
    """One base table, a file a bucket, of the register up to a batch that is finished. Readers take it once its number is
    written; only then do the tables that it replaces go."""
    folder, bases = Folder(spark, register_path), Folder(spark, f"{register_path}/bases")
    old = bases.names()
    if str(upto) in old:
        return
    read_register(spark, register_path, upto + 1).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{register_path}/base-{upto}")
    bases.write(str(upto), "")
    for n in old:
        bases.delete(n)
        folder.delete(f"base-{n}")
    for n in Folder(spark, f"{register_path}/batches").folders():
        if n.startswith("batch_id=") and int(n.split("=")[1]) <= upto:
            folder.delete(f"batches/{n}")


def start(stream: DataFrame, register_path: str, decisions_path: str, checkpoint: str, **options) -> StreamingQuery:
    spark = stream.sparkSession
    return stream.writeStream.foreachBatch(lambda df, n: import_batch(df.sparkSession or spark, df, n, register_path, decisions_path, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_windows(ledger: DataFrame, at: str = "ts", window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """Tokens used in sliding windows of a stream (or table) of calls; late rows count until the watermark passes."""
    t = ledger.withColumn("_at", F.to_timestamp(at))
    return t.withWatermark("_at", late).groupBy(F.window("_at", window, slide).alias("w")).agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.count("*").alias("calls")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "tokens", "calls")
