import numpy as np
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from quillmark.functions import text
from quillmark.operators import blocking as B
from quillmark.operators import classify, margins, matching, register_index
from quillmark.plans import queries


def test_single_keys_list_no_pairs(spark):
    """with truth by a key, counts come from sizes, and equal those of listed pairs."""
    df = spark.createDataFrame([(f"{i:02}", f"steel pump {'ab'[i % 2]}", None if i == 5 else f"b{i % 3}") for i in range(24)], "record_id string, title string, buyer_id string")
    own = B.buyer_blocks(df)
    a, b = own.withColumnRenamed("record_id", "left_id"), own.withColumnRenamed("record_id", "right_id")
    listed = a.join(b, "block_key").where("left_id < right_id").select("left_id", "right_id", F.lit(1).alias("label"))
    out = B.sweep_single_key(df, B.SameBlock(own), 24, [1, 4, 99])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, B.sweep_single_key(df, listed, 24, [1, 4, 99]).collect()))
    assert "left_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_grams_are_sorted_without_a_lambda(spark):
    """no comparison by an interpreted function."""
    plan = queries.QUERIES["padded_grams"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "array_sort(" not in plan and plan.count("sort_array(") == 1


def test_a_fit_counts_equal_rows_and_orders_features_once(spark):
    """copies are one row with a weight, steps read features in order, and the machines are those of all rows."""
    rows = [([1, 5, 5, 2], 0, 0), ([3, 5], 1, 1), ([7, 1], 0, 2), ([], 1, 0)]
    of = lambda own, kind: margins.OneVsRest(2, 8, 6).fit(spark.createDataFrame(own, kind).coalesce(1))
    many = of([r for r in rows for _ in range(300)], "h array<int>, y int, fold int")
    once = of([(*r, 300) for r in rows], "h array<int>, y int, fold int, n long")
    for what in ("weights", "idf", "slope", "shift"):
        assert np.allclose(getattr(many, what), getattr(once, what), atol=1e-6)
    table = margins.packed(spark.createDataFrame([(*r, 1) for r in rows * 300], "h array<int>, y int, fold int, n long").coalesce(1), 8)
    assert sorted({bytes(r.x) for r in table.collect()}) == sorted(np.array(sorted(h), "<u2").tobytes() for h, _, _ in rows)
    wide = margins.OneVsRest(2, 1 << 17, 3).fit(spark.createDataFrame([([1 << 16, 3], 0, 0), ([4], 1, 1)], "h array<int>, y int, fold int"))
    assert wide.weights[1 << 16].any() and not wide.weights[0].any()


def test_rows_of_a_label_are_not_gathered(spark, monkeypatch):
    """the label's number reaches the rows without a shuffle by label, and equal texts come to the fit once."""
    seen = []
    monkeypatch.setattr(margins.OneVsRest, "fit", lambda self, rows: seen.append(rows) or self)
    df = spark.range(400).selectExpr("concat('red pump ', id % 40) AS text", "if(id % 40 = 7, 'b', 'a') AS label")
    classify.TfidfSvm(features=64).fit(df)
    assert "hashpartitioning(label" not in seen[0]._jdf.queryExecution().executedPlan().toString()
    assert seen[0].count() == 40 and seen[0].agg(F.sum("n")).first()[0] == 400


def test_normal_forms_are_made_once(spark):
    """The rules of the waterfall share the normal forms, whose patterns are plain classes; ASCII has its own."""
    plan = queries.QUERIES["discard_waterfall"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(text._ASCII_GAP) == 2 and r"[^\x00-\x7F" not in plan
    texts = matching.record_texts(queries.doc_records(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert texts.count("instr(") <= 4  # the description is cut out of the text once for all that read it


def test_normal_forms_of_every_character(spark):
    """The cheaper patterns give the same forms, and send the same texts to Python."""
    every = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(f"{c}A{c}{c} .b{c}",) for c in every] + [("",), (None,)], "t string")
    rows = df.select("t", text.normalise(F.col("t")).alias("n"), text.needs_exact(F.col("t")).alias("hard")).collect()
    assert [r.t for r in rows if r.n != text.normalise_str(r.t)] == []
    cut = df.select("t", text.text_of(F.col("t"), F.lit("\u2003 ")).alias("n"), F.regexp_replace(F.concat(F.coalesce("t", F.lit("")), F.lit(" \u2003 ")), r"(?U)^\s+|\s+$", "").alias("want"))
    assert cut.where("n <> want").isEmpty()
    plain = lambda t: t is None or all(c < "\x80" or "À" <= c <= "ÿ" and c not in "×÷" for c in t)
    signal = lambda t: bool(t) and any(c in text.MOJIBAKE_SIGNALS for c in t)
    assert [r.t for r in rows if r.hard and plain(r.t) and not signal(r.t) or not r.hard and not plain(r.t)] == []


def test_tasks_of_an_index_are_many(spark, tmp_path, monkeypatch):
    """a build has as many tasks whatever the cores, one shuffle by block for both groupings, and each record in one posting."""
    plans = []
    real = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, path))
    df = spark.createDataFrame([(f"{i:03}", f"red pump {i % 7}") for i in range(90)] + [("000", "red")], "record_id string, title string")
    register_index.build(df, {"title": "A"}, f"file://{tmp_path}/index", blocks=8)
    shuffles = [line for line in plans[0].splitlines() if "Exchange" in line]
    assert len(shuffles) == 2 and all(f"{register_index.TASKS})" in line.replace(", REPARTITION", ")") or f", {register_index.TASKS}" in line for line in shuffles)
    rows = spark.read.parquet(f"file://{tmp_path}/index").where("term = 'red'").collect()
    assert sorted(i for r in rows for i in r.ids) == [f"{i:03}" for i in range(90)] and {max(r.weights) for r in rows} == {1.0, 2.0}
