"""Vectors of texts: a cache table keyed by model and text, cosine pairs and nearest labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dot, unit
from ..functions.text import vector_key

VECTOR_SCHEMA = "key string, vector array<float>"


def missing(texts: DataFrame, model: str, cache: DataFrame | None) -> DataFrame:
    """Distinct (key, text) that the cache has no usable vector for."""
    need = texts.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("key", vector_key(model, F.col("text")))
    return need if cache is None else need.join(cache.where(F.size("vector") > 0).select("key"), "key", "left_anti")


def encode(need: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 64) -> DataFrame:
    """(key, vector): the model is loaded once per task that has rows, and never where nothing is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for df in batches:
            for at in range(0, len(df), batch):
                part = df.iloc[at : at + batch]
                model = model or load()
                yield pd.DataFrame({"key": part["key"], "vector": [list(map(float, v)) for v in model(part["text"].tolist())]})

    return need.select("key", "text").mapInPandas(run, VECTOR_SCHEMA).withColumn("vector", unit(F.col("vector")))


def embed(texts: DataFrame, model: str, load: Callable, cache_path: str | None = None, batch: int = 64) -> DataFrame:
    """texts plus vector. With a cache path, new vectors are appended there first, then all are read from it."""
    spark = texts.sparkSession
    cache = read_cache(spark, cache_path) if cache_path else None
    fresh = encode(missing(texts, model, cache), load, batch)
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
        vectors = read_cache(spark, cache_path)
    else:
        vectors = fresh
    keyed = texts.withColumn("key", vector_key(model, F.coalesce("text", F.lit(""))))
    return keyed.join(vectors.dropDuplicates(["key"]), "key", "left").drop("key")


def read_cache(spark, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(VECTOR_SCHEMA).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def cache_stats(texts: DataFrame, model: str, cache: DataFrame | None) -> DataFrame:
    gone = missing(texts, model, cache).agg(F.count("*").alias("n_missing"))
    own = texts.agg(F.count("*").alias("n_texts"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("n_unique"))
    return own.join(gone, F.lit(True)).select("n_texts", "n_unique", (F.col("n_unique") - F.col("n_missing")).alias("n_cached"), "n_missing")


def cosine_pairs(pairs: DataFrame, vectors: DataFrame, id_col: str = "record_id", vector_col: str = "vector") -> DataFrame:
    """pairs (left_id, right_id) plus the cosine of their vectors."""
    own = F.col(vector_col)
    v = vectors.select(F.col(id_col).alias("_id"), own.alias("_v"), F.sqrt(dot(own, own)).alias("_n"))
    left, right = (v.select(F.col("_id").alias(f"{side}_id"), F.col("_v").alias(f"_{side}"), F.col("_n").alias(f"_{side}_n")) for side in ("left", "right"))
    score = F.try_divide(dot(F.col("_left"), F.col("_right")), F.col("_left_n") * F.col("_right_n"))
    return pairs.join(left, "left_id").join(right, "right_id").withColumn("score", F.coalesce(score, F.lit(0.0))).drop("_left", "_right", "_left_n", "_right_n")


def shortlist(queries: DataFrame, labels: DataFrame, k: int = 12, block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, label_id, score): the k nearest of a label table for every query. The label table is a stated set
    of bounded size, held against all queries in blocks: one mapInPandas pass per block of at most block_rows labels."""
    import numpy as np

    n = labels.count()
    blocks = max(1, -(-n // block_rows))
    out = None
    for b in range(blocks):
        own = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(blocks)) == b).select("label_id", unit(F.col("vector")).alias("vector")).orderBy("label_id").toPandas()
        if not len(own):
            continue
        ids, matrix = own["label_id"].to_numpy(), np.stack(own["vector"].map(np.asarray)).astype(np.float64)
        sent = queries.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, matrix = sent.value
            for df in batches:
                if not len(df):
                    continue
                s = np.stack(df["vector"].map(np.asarray)).astype(np.float64) @ matrix.T
                take = np.argsort(-s, axis=1, kind="stable")[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(df["query_id"].to_numpy(), take.shape[1]), "label_id": ids[take].ravel(), "score": np.take_along_axis(s, take, 1).ravel()})

        kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, label_id {labels.schema['label_id'].dataType.simpleString()}, score double"
        part = queries.select("query_id", unit(F.col("vector")).alias("vector")).mapInPandas(run, kinds)
        out = part if out is None else out.union(part)
    if out is None:
        return queries.select("query_id").where(F.lit(False)).select("query_id", F.lit(None).cast(labels.schema["label_id"].dataType).alias("label_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
