"""Label classifiers on Spark ML, their results with alternatives, and what routes an unsupported label to review."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate
from ..functions.text import normalise, padded_grams
from . import margins


def _labels(train: DataFrame, label_col: str) -> list[str]:
    """Labels in order. Their number is that of the taxonomy's classes, not of the rows, so each goes to all tasks."""
    return [r[0] for r in train.select(label_col).distinct().orderBy(label_col).collect()]


def _index(df: DataFrame, labels: list[str], label_col: str) -> DataFrame:
    from pyspark.sql import SparkSession

    spark: SparkSession = df.sparkSession
    table = spark.createDataFrame([(x, float(i)) for i, x in enumerate(labels)], f"{label_col} string, _y double")
    # Sent to the rows: a join by merging would put all rows of a label into one task, and one file of what it writes.
    return df.join(F.broadcast(table), label_col)


def _spread(df: DataFrame) -> DataFrame:
    """df over all cores, however few files or row groups it came in."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


class TfidfSvm:
    """Character n-grams (2 to 5), smoothed idf, one linear machine per label, margins calibrated by a logistic out of fold. All
    labels are fitted in one chain of max_iter jobs (see margins)."""

    def __init__(self, features: int = 1 << 16, max_iter: int = 50, folds: int = margins.FOLDS):
        self.features, self.max_iter, self.folds = features, max_iter, folds

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("h", margins.hashed(padded_grams(normalise(F.col("text")), 2, 5), self.features))

    def fit(self, train: DataFrame, label_col: str = "label") -> TfidfSvm:
        self.labels = _labels(train, label_col)
        fold = F.pmod(F.xxhash64("text"), F.lit(self.folds)).cast("int").alias("fold")
        # Equal rows are one row that counts for all; the steps cost far more than their texts weigh, so all cores share them.
        once = _spread(train.groupBy("text", label_col).agg(F.count("*").alias("n")))
        rows = _index(self._hashed(once), self.labels, label_col).select("h", F.col("_y").cast("int").alias("y"), fold, "n")
        self.machines = margins.OneVsRest(len(self.labels), self.features, self.max_iter, self.folds).fit(rows)
        return self

    def scores(self, df: DataFrame) -> DataFrame:
        """df plus scores: array of (score, label), best first."""
        out = self.machines.scored(self._hashed(_spread(df)), list(map(str, self.labels)))
        return out.withColumn("scores", ranked(F.col("scores"))).drop("h")


class EmbeddingLogistic:
    """Multinomial logistic regression on a vector column."""

    def __init__(self, vector_col: str = "vector", max_iter: int = 100):
        self.vector_col, self.max_iter = vector_col, max_iter

    def fit(self, train: DataFrame, label_col: str = "label") -> EmbeddingLogistic:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.functions import array_to_vector

        self.labels = _labels(train, label_col)
        rows = _index(train.withColumn("features", array_to_vector(F.col(self.vector_col).cast("array<double>"))), self.labels, label_col)
        self.model = LogisticRegression(family="multinomial", labelCol="_y", maxIter=self.max_iter, regParam=1e-4).fit(rows.select("features", "_y"))
        return self

    def scores(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out = self.model.transform(df.withColumn("features", array_to_vector(F.col(self.vector_col).cast("array<double>"))))
        p = vector_to_array(F.col("probability"))
        parts = F.array(*(F.struct(p[i].alias("score"), F.lit(x).alias("label")) for i, x in enumerate(self.labels)))
        return out.withColumn("scores", ranked(parts)).drop("features", "rawPrediction", "probability", "prediction")


class ShortlistClassifier:
    """The nearest labels of a taxonomy go to an adjudicator, which picks one of them."""

    def __init__(self, choose: Callable[[DataFrame], DataFrame], k: int = 12):
        self.choose, self.k = choose, k

    def scores(self, queries: DataFrame, labels: DataFrame) -> DataFrame:
        """choose() gets (query_id, rank, label_id, score) and gives (query_id, label_id, score) of its pick."""
        from .embedding import shortlist

        near = shortlist(queries, labels, self.k)
        pick = self.choose(near).select("query_id", F.col("label_id").alias("_pick"), F.col("score").alias("_told"))
        s = F.struct(F.when(F.col("label_id") == F.col("_pick"), F.col("_told")).otherwise(F.col("score") * 0.5).alias("score"), F.col("label_id").cast("string").alias("label"))
        return near.join(pick, "query_id", "left").groupBy("query_id").agg(ranked(F.array_agg(s)).alias("scores"))


def ranked(scores: Column) -> Column:
    return F.sort_array(scores, asc=False)


def result(scored: DataFrame, alternatives: int = 5) -> DataFrame:
    """label, score and the next best alternatives from scores."""
    return scored.withColumns({"label": F.get("scores", 0)["label"], "score": F.get("scores", 0)["score"], "alternatives": F.slice("scores", 1, alternatives)}).drop("scores")


def route_unsupported(results: DataFrame, supported: DataFrame) -> DataFrame:
    """route: review for labels that are not supported, else auto."""
    known = supported.select("label").distinct().withColumn("_known", F.lit(True))
    return results.join(known, "label", "left").withColumn("route", F.when(F.col("_known"), F.lit("auto")).otherwise(F.lit("review"))).drop("_known")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(truth, predicted, n)."""
    return df.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_wide(df: DataFrame, truth: str, predicted: str, labels: list[str]) -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth")).pivot(predicted, labels).count().fillna(0)


def label_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Per label: support, precision, recall, F1; every label of either column appears."""
    c = confusion(df, truth, predicted)
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    p = c.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("n_predicted"))
    x = t.join(p, "label", "full").select("label", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("support", "tp", "n_predicted")))
    x = x.withColumns({"precision": safe_rate(F.col("tp"), F.col("n_predicted")), "recall": safe_rate(F.col("tp"), F.col("support"))})
    return x.withColumn("f1", safe_rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro_weighted_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    s = label_scores(df, truth, predicted)
    return s.agg(F.avg("f1").alias("macro_f1"), safe_rate(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"), safe_rate(F.sum("tp"), F.sum("support")).alias("accuracy"))


def best_by_score(df: DataFrame, *keys: str) -> DataFrame:
    """The row of best score of each key; of equal scores the least in all columns."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), *(c for c in sorted(df.columns) if c not in (*keys, "score")))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
