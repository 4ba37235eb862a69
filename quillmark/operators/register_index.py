"""An inverted index of the register: a search reads the buckets of its own words, not the register.

A posting says how much a word weighs in a record (summed over the fields that hold it). Postings lie in buckets of words
(folders, so a scan is pruned to those asked for) and in blocks of records; a block keeps the greatest weight of each word. For
the best `limit` records the blocks are taken in the order of what their maxima allow, and the rest stay unread once no block
can still reach the worst of them."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise, tokens
from .register import WEIGHTS

BUCKETS = 64
#: Blocks of records; their bounds for one query are all that the driver sees.
BLOCKS = 1024
#: Tasks of each shuffle of a build. Left to itself, Spark makes as few as there are cores, whose memory grows with the register.
TASKS = 256
#: Parts of a bucket, by block: files of its folder.
PARTS = 8


def _bucket(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def build(register: DataFrame, fields: dict[str, str], path: str, blocks: int = BLOCKS) -> None:
    """Writes the postings of register (record_id and fields, each with the letter of its weight): (term, block, top, ids, weights)
    by bucket. A hot word has a row for each block, so no row or task holds all of its records. Records without id or words are in
    no posting; an index that is there already is replaced."""
    texts = register.where("record_id is not null").select("record_id", *(normalise(F.col(c)).alias(c) for c in fields))
    weighted = lambda c, k: F.transform(F.array_distinct(tokens(F.col(c))), lambda w: F.struct(w.alias("term"), F.lit(WEIGHTS[k]).alias("w")))
    words = F.flatten(F.array(*(weighted(c, k) for c, k in fields.items())))
    block = F.pmod(F.xxhash64("record_id"), F.lit(blocks)).cast("int").alias("block")
    each = texts.select("record_id", block, F.explode(words).alias("x")).select("x.term", "record_id", "block", "x.w").repartition(TASKS, "block")
    own = each.groupBy("term", "record_id", "block").agg(F.sum("w").alias("w"))  # both groupings stay inside a block's task
    rows = own.groupBy("term", "block").agg(F.max("w").alias("top"), F.sort_array(F.collect_list(F.struct("record_id", "w"))).alias("p"))
    out = rows.select(_bucket(F.col("term")).alias("bucket"), "term", "block", "top", F.transform("p", lambda x: x["record_id"]).alias("ids"), F.transform("p", lambda x: x["w"]).alias("weights"))
    out.repartition(TASKS, "bucket", F.col("block") % PARTS).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(path)


def postings(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """The index rows of some words, from their buckets alone."""
    return spark.read.parquet(path).where(F.col("bucket").isin(sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})) & F.col("term").isin(words))


def _ranked(rows: DataFrame, n: int) -> DataFrame:
    each = rows.select("term", F.explode(F.arrays_zip("ids", "weights")).alias("x")).groupBy(F.col("x.ids").alias("record_id")).agg(F.round(F.sum("x.weights"), 9).alias("rank"), F.count("*").alias("n"))
    return each.where(F.col("n") == n).select("record_id", "rank")


def search(spark: SparkSession, path: str, query: str, limit: int | None = None) -> DataFrame:
    """(record_id, rank) of the records that hold every word of the query, as register.search ranks them: all, or the best
    `limit`, equal ranks in order of record_id."""
    words = sorted({w for w in query.lower().split() if w})
    if not words:
        raise ValueError("a search needs a word")
    rows = postings(spark, path, words)
    if limit is None:
        return _ranked(rows, len(words))
    bounds = rows.groupBy("block").agg(F.sum("top").alias("bound"), F.count("*").alias("n")).where(F.col("n") == len(words)).select("block", "bound").collect()
    order = sorted(((r["bound"], r["block"]) for r in bounds), reverse=True)
    take = 1
    while True:
        best = _ranked(rows.where(F.col("block").isin([b for _, b in order[:take]])), len(words)).orderBy(F.desc("rank"), "record_id").limit(limit)
        if take >= len(order):
            return best
        ranks = [r["rank"] for r in best.select("rank").collect()]
        if len(ranks) == limit and ranks[-1] > order[take][0] + 1e-9:
            return best
        take *= 4
