"""Training-corpus pipeline over the documents table: rules, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the caller writes it as Parquet and reads it back as the
next stage's docs. Rows with null ids or texts go through every stage; the quality rules drop texts without words. Very long
texts are read whole by every stage. Of near duplicates the document of the least id stays; rows that repeat that id with an
equal text become one, those with another text all stay. Columns of documents keep their names and values whatever they are
called, but for text and n_chars under the mask and the three that the last stage adds (ids, n_tokens, round_trip), which
replace columns of those names. An empty table passes all stages."""

from __future__ import annotations

import uuid

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bitmap, bpe, decontaminate, jaccard_join, pii, quality_rules
from quillmark.llm.scratch import delete, materialize, scope, scratch_dir

SHINGLE_WORDS, NUM, DEN = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group linked by a Jaccard similarity of 0.8 or more."""
    linked = materialize(jaccard_join.link(docs, SHINGLE_WORDS, NUM, DEN).select("doc_id", "component_id"), "linked")
    drop = materialize(linked.where("doc_id <> component_id").select(F.col("doc_id").alias("_qm_drop")).distinct(), "duplicates")
    # A bitmap of the ids to drop spares the texts of all other documents the shuffle.
    maybe, others = bitmap.split(docs, "doc_id", bitmap.collect(drop, "_qm_drop"))
    kept = others.unionByName(maybe.join(drop, maybe["doc_id"] == drop["_qm_drop"], "left_anti"))
    again = linked.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_qm_again")).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["_qm_again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == again["_qm_again"], "left_anti").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the text."""
    return pii.masked(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, and whether the ids decode to the text."""
    with open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        out = bpe.encoded(docs, f.read(), tokenizers.PATTERN)
    return out.withColumn("round_trip", F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")).drop("decoded")


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", personal_data), ("byte_bpe", tokens)]

#: Exact similarity joins and ranked merges have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope(spark):  # a stage's own tables go once its result is written
            done = stage(spark, docs, sf_dir)
            path = f"{scratch_dir(spark)}/pipeline/{name}-{uuid.uuid4().hex}"
            done.write.parquet(path)
            docs = spark.read.schema(done.schema).parquet(path)
        if before:  # nothing reads the stage before any more
            delete(spark, before)
        before = path
    return docs
