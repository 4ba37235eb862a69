"""Quality rules with adaptive thresholds (built-in functions only).

Every text gets counts of words, symbols, repeated lines and repeated 8-word windows. From them five whole-number
metrics follow. Per language and source, and merged per language and over all, each metric has a quantile sketch: a
histogram whose buckets keep the leading five bits of a value (relative error under 1/16), so sketches merge by adding
counts and come out alike however rows are dealt or retried. Fences over the sketches' quartiles (Tukey's, with a least
spread per metric) replace fixed cutoffs. A group's fence is drawn to that of its language, and this to that of all rows,
by weight: the coarser fence counts as PRIOR_ROWS rows, so a verdict never jumps with the size of a group. A small joined
table then judges the rows.

Edge cases: a null or empty text has no words and fails the base rules. Very long texts are counted whole, in one pass a
row. Null lang or source count as ''. Ties: a value on a fence is kept. Repeated rows are judged each for itself. An empty
table gives an empty result. Columns of the input that clash with names returned here are replaced in judge(), which keeps
all others; keep() returns the columns of the input alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOL_CLASS = "[#*$%&|<>]"
WINDOW = 8
#: metric: (quartile multiple above, or None; below, or None; least spread).
FENCES = {
    "m_word_len": (3, 3, 50),
    "m_symbols": (3, None, 50),
    "m_dup_lines": (3, None, 150),
    "m_repeats": (3, None, 80),
    "m_upper": (3, None, 30),
}
#: Rows that the fence of the coarser group counts for.
PRIOR_ROWS = 100
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the optimiser does."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 that occur twice or more in the text. Equal hashes are compared by their words."""

    def cover(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(ranked, lambda s: F.aggregate(F.sort_array(repeated(s)), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p")), lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"), p.alias("p")))["n"])

    def same(s: Column, a: Column, b: Column) -> Column:
        return (s[a]["h"] == s[b]["h"]) & (F.slice(words, s[a]["i"] + 1, WINDOW) == F.slice(words, s[b]["i"] + 1, WINDOW))

    def repeated(s: Column) -> Column:
        last = F.size(s) - 1
        near = F.filter(F.sequence(F.lit(0), last), lambda k: ((k > 0) & same(s, k, F.greatest(k - 1, F.lit(0)))) | ((k < last) & same(s, k, F.least(k + 1, last))))
        return F.transform(near, lambda k: s[k]["i"])

    def count(own: Column) -> Column:
        pairs = let(own, lambda h: _joined(h, 1))
        fours = let(pairs, lambda h: _joined(h, 2))
        windows = let(fours, lambda h: _joined(h, 4))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), cover(w)).otherwise(F.lit(0).cast("long")))

    return F.when(F.size(words) > WINDOW, let(F.transform(words, lambda x: F.xxhash64(x)), count)).otherwise(F.lit(0).cast("long"))


def _joined(hashes: Column, by: int) -> Column:
    """Hash of each element with the one `by` places on; the last `by` have none and go."""
    return F.transform(F.slice(hashes, 1, F.size(hashes) - by), lambda h, i: F.xxhash64(h, hashes[i + by]))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus the base counts and the metrics of each whole text; no row is moved."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE_CLASS}+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    found = let(
        F.struct(words.alias("w"), lines.alias("l")),
        lambda x: F.struct(
            F.size(x["w"]).cast("long").alias("n_words"),
            F.length(F.array_join(x["w"], "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, SYMBOL_CLASS, ""))).cast("long").alias("n_symbols"),
            (F.size(x["l"]) - F.size(F.array_distinct(x["l"]))).cast("long").alias("n_dup_lines"),
            _repeat_words(x["w"]).alias("n_repeat_words"),
            F.size(x["l"]).cast("long").alias("n_lines"),
            (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))).cast("long").alias("n_upper"),
        ),
    )
    # A generator is computed once a row, and filters on its columns stay above it.
    names = [*BASE, "n_lines", "n_upper", *FENCES, "base_failed"]
    rest = docs.select(*(c for c in docs.columns if c.lower() not in names))
    return rest.select("*", F.inline(F.array(found))).withColumns({
        "m_word_len": F.expr("word_chars * 100 div greatest(n_words, 1)"),
        "m_symbols": F.expr("n_symbols * 1000 div greatest(n_words, 1)"),
        "m_dup_lines": F.expr("n_dup_lines * 1000 div greatest(n_lines, 1)"),
        "m_repeats": F.expr("n_repeat_words * 1000 div greatest(n_words, 1)"),
        "m_upper": F.expr("n_upper * 1000 div greatest(word_chars, 1)"),
        "base_failed": (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30),
    })


def sketches(counted: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, metric, bucket, n) of rows that pass the base rules."""
    buckets = F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(f"shiftleft(shiftright({m}, greatest(length(bin({m})) - 5, 0)), greatest(length(bin({m})) - 5, 0))").alias("bucket")) for m in FENCES))
    return (
        counted.where("not base_failed")
        .select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.inline(buckets))
        .groupBy("lang", "source", "metric", "bucket")
        .agg(F.count("*").alias("n"))
    )


def merge(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, by adding the counts of their buckets."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """One row for each group: its rows, and a low and a high fence for every metric."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, "metric")
    upto = sketch.withColumns({"c": F.sum("n").over(w.orderBy("bucket")), "t": F.sum("n").over(w)})
    quart = upto.groupBy(*keys, "metric").agg(F.max("t").alias("t"), *(F.min(F.when(F.col("c") * 4 >= F.col("t") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3)))
    out = [F.max("t").alias(f"{tag}_rows")]
    for m, (up, down, least) in FENCES.items():
        spread = F.greatest(F.col("q3") - F.col("q1"), F.lit(least))
        is_m = F.col("metric") == m
        out += [F.max(F.when(is_m, F.col("q3") + up * spread)).alias(f"{tag}_{m}_hi")]
        if down is not None:
            out += [F.max(F.when(is_m, F.greatest(F.col("q1") - down * spread, F.lit(0)))).alias(f"{tag}_{m}_lo")]
    return quart.groupBy(*keys).agg(*out)


def thresholds(counted: DataFrame, lang_col: str = "lang", source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """(lang, source, <metric>_hi, <metric>_lo): one row for each pair of language and source."""
    base = sketches(counted, lang_col, source_col)
    own, lang, every = _fences(base, ["lang", "source"], "s"), _fences(merge(base, ["lang"]), ["lang"], "l"), _fences(merge(base, []), [], "a")
    both = own.join(lang, "lang").join(every.withColumn("_qm_one", F.lit(1)), F.lit(True), "inner")

    def drawn(c: str) -> Column:
        of_lang = f"((l_rows * l_{c} + {prior_rows} * a_{c}) div (l_rows + {prior_rows}))"
        return F.expr(f"(s_rows * s_{c} + {prior_rows} * {of_lang}) div (s_rows + {prior_rows})")

    names = [f"{m}_hi" for m in FENCES] + [f"{m}_lo" for m, f in FENCES.items() if f[1] is not None]
    return both.select("lang", "source", *(drawn(c).cast("long").alias(c) for c in names))


def apply_thresholds(counted: DataFrame, limits: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """counted plus kept; the join is on the pair of language and source."""
    limits = limits.select(F.col("lang").alias("_qm_lang"), F.col("source").alias("_qm_source"), *(F.col(c).alias(f"_qm_{c}") for c in limits.columns[2:]))
    ok = ~F.col("base_failed")
    for m, (_, down, _) in FENCES.items():
        ok &= F.coalesce(F.col(m) <= F.col(f"_qm_{m}_hi"), F.lit(True))
        if down is not None:
            ok &= F.coalesce(F.col(m) >= F.col(f"_qm_{m}_lo"), F.lit(True))
    joined = counted.join(limits, (F.coalesce(F.col(lang_col), F.lit("")) == F.col("_qm_lang")) & (F.coalesce(F.col(source_col), F.lit("")) == F.col("_qm_source")), "left")
    return joined.withColumn("kept", ok).drop(*(c for c in limits.columns))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """docs plus the counts and kept. Every text is counted once: rows are written with their counts, which the sketches
    read without the texts, and judged where they are."""
    counted = materialize(with_counts(docs, text_col), "quality-rows")
    # Written: a small table of its own is broadcast while it is small, and else joined with skewed pairs split.
    limits = materialize(thresholds(counted, lang_col, source_col, prior_rows), "quality-limits")
    return apply_thresholds(counted, limits, lang_col, source_col)


def keep(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs."""
    packed = docs.select(F.struct("*").alias("_qm_row"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = with_counts(packed.withColumn("_qm_text", F.col("_qm_row")[text_col]), "_qm_text").drop("_qm_text")
    counted = materialize(counted, "quality-rows")
    return apply_thresholds(counted, materialize(thresholds(counted, prior_rows=prior_rows), "quality-limits")).where("kept").select("_qm_row.*")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", prior_rows: int = PRIOR_ROWS) -> DataFrame:
    """One row for each document: id, base counts, metrics, base_failed, kept. Counts are taken once and written."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    counted = materialize(with_counts(slim).drop("text"), "quality-counts")
    limits = materialize(thresholds(counted, prior_rows=prior_rows), "quality-limits")
    return apply_thresholds(counted, limits).select("doc_id", *BASE, *FENCES, "base_failed", "kept")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
