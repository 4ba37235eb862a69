"""What a review found, each by a small case that failed before."""

import itertools

from pyspark.sql import functions as F

from quillmark.functions.text import grams_of, padded_grams
from quillmark.operators import degrade, matching, sampling, term_join, timing
from quillmark.plans import queries
from quillmark.sources import readers


def test_pieces_of_records_are_never_parsed(spark, tmp_path):
    """records across the edges of byte ranges, read without whole-stage code, where a filter's shared expressions come first."""
    rows = [(f"{i}", f"first, {i}\n" + f'said "{i}"\nand more ' * (i % 40), "") for i in range(300)]
    spark.createDataFrame(rows, "id string, text string, empty string").coalesce(1).write.csv(f"{tmp_path}/x.csv", header=True, quote='"', escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    options = {"spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in options}
    try:
        for k, v in options.items():
            spark.conf.set(k, v)
        assert sorted(map(tuple, readers.read_csv(spark, f"{tmp_path}/x.csv").collect())) == sorted(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_empty_sample_has_no_rate(spark):
    """no pair to judge is no clean sample."""
    pairs = spark.createDataFrame([], "left_id string, right_id string")
    log = spark.createDataFrame([("x", "y", "unsure")], "left_id string, right_id string, verdict string")
    assert tuple(sampling.contamination(pairs, log).first()) == (0, 0, None, None, None, None)


def test_rolling_sums_know_no_zone(spark):
    """two events an hour apart stay so where clocks skip that hour."""
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 1.0D, TIMESTAMP_NTZ'2024-03-10 02:30:00.5'), (2, 'a', 2.0D, TIMESTAMP_NTZ'2024-03-10 03:30:01'), (3, 'a', 4.0D, TIMESTAMP_NTZ'2024-03-10 03:31:00.4'), (4, 'a', 8.0D, CAST(NULL AS TIMESTAMP_NTZ)) AS t(i, k, v, ts)")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.i: r.rolling for r in timing.rolling_sum(rows, "v", "k", "ts").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == {1: 1.0, 2: 2.0, 3: 6.0, 4: 8.0}


def test_candidates_of_a_group_are_no_rows(spark, monkeypatch):
    """F2 of round 4: texts of a group meet in chunks; only pairs that reach the threshold become rows, the same for any size of chunk."""
    words = ["red", "blue", "old"], ["bolt", "gear", "rod"], ["LARGE", "PROMO"], ["Brand#1", "Brand#1é"]
    rows = [(f"{i:03}", "g" if i % 5 else "h", " ".join(w[i // k % len(w)] for w, k in zip(words, (1, 3, 9, 18), strict=True))) for i in range(72)] + [("e1", "g", ""), ("e2", "g", ""), ("x", "g", "é"), ("y", "k", "rod")]
    docs = spark.createDataFrame(rows, "record_id string, g string, text string")
    assert [r.p == grams_of(r.text) for r in docs.select("text", padded_grams(F.col("text")).alias("p")).collect()] == [True] * len(rows)
    own = {}
    for r in matching.tfidf(docs, padded_grams(F.col("text")), "g", sublinear=False).collect():
        own.setdefault((r.g, r.record_id), {})[r.term] = r.weight
    cosine = {(g, a, b): sum(x * own[h, b].get(t, 0) for t, x in own[g, a].items()) for (g, a), (h, b) in itertools.combinations(sorted(own), 2) if g == h}
    want = {k: round(s, 6) for k, s in cosine.items() if s >= 0.75 - 1e-9}
    texts = matching.text_classes(docs, "g").groupBy("g", F.col("class_id").alias("record_id"), "text").agg(F.count("*").alias("copies"))
    for size in (4, 512):
        found = term_join.similar_texts(texts, "g", 0.75, size=size)
        assert len({(r.g, *sorted((r.x, r.y))) for r in found.collect()}) == found.count() < len(want)
        monkeypatch.setattr(matching, "similar_texts", lambda *args, size=size: term_join.similar_texts(*args, size=size))
        assert {(r.g, r.left_id, r.right_id): round(r.similarity, 6) for r in matching.similar_in_group(docs, "g").collect()} == want


def test_low_lots_hold_the_first_pairs(spark):
    """F1 of round 4: five pairs of a group are chosen without sorting all of them, by luck or without."""
    members = spark.createDataFrame([(f"{k}{i}", k) for k in "abc" for i in range(12)] + [("d0", "d"), ("e0", "e")], "record_id string, kind string")
    apart = spark.createDataFrame([("g", "a", "b", 144), ("g", "c", "a", 144), ("h", "d", "e", 1)], "cls string, left_kind string, right_kind string, n bigint")
    every = matching.members_paired(apart, members, "kind", ["cls"])
    rows = lambda df: sorted(map(tuple, df.select("cls", "left_id", "right_id").collect()))
    want = rows(degrade.cap_per_group(every, "cls", 5, 7))
    assert len(want) == 6
    for spare in (12, 0.2):
        low = degrade.low_lots(apart, members, "cls", 5, 7, spare)
        assert rows(degrade.cap_per_group(low, "cls", 5, 7)) == want
    assert degrade.low_lots(apart, members, "cls", 5, 7, 4).count() < every.count() / 2


def test_rolling_sums_round_as_their_sql(spark, tmp_path):
    """F3 of round 4: sums near halves, of many digits or not finite round as the SQL's, which scales them."""
    import duckdb

    rows = [(i, 60 * i, i % 97 * 29.27 / 7 * 1e9 if i % 2 else i * 0.29 * 1.00005) for i in range(1500)] + [(1500 + i, 100_000 + 60 * i, v) for i, v in enumerate([-0.0000025, -2.0000005, 1e305, float("inf"), float("nan"), None, 0.0, -1e-9])]
    spark.createDataFrame(rows, "event_id long, at long, value double").selectExpr("event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at) ts", "'a' event_type", "value").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {i: repr(s) for i, s in con.sql(queries.ORACLE["rolling_60s"]).fetchall()}
    assert {r.event_id: repr(r.s) for r in queries.rolling_60s(spark, str(tmp_path)).collect()} == want
