import json

import csv
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmark.plans import runs
from quillmark.sources import readers, sinks
from quillmark.streaming import incremental


def test_csv_is_strict(spark, tmp_path):
    d = tmp_path / "2099"
    d.mkdir()
    (d / "main.csv").write_text('id,title\n1,"two\nlines, ""quoted"""\n2,\n')
    df = readers.read_bundle(spark, str(d), ["title", "id"])
    assert [r.title for r in df.orderBy("id").collect()] == ['two\nlines, "quoted"', ""]
    with pytest.raises(readers.SchemaMismatch, match="missing"):
        readers.read_bundle(spark, str(d), ["id", "other"])
    with pytest.raises(FileNotFoundError):
        readers.read_bundle(spark, str(tmp_path / "none"), ["id"])


def test_benchmark(spark, tmp_path):
    for t in "AB":
        (tmp_path / f"table{t}.csv").write_text("id,name,description,price\n1,n,,5\n")
    for s in ("train", "valid", "test"):
        (tmp_path / f"{s}.csv").write_text("ltable_id,rtable_id,label\n1,1,1\n")
    records, pairs = readers.read_benchmark(spark, str(tmp_path))
    assert {r.record_id for r in records.collect()} == {"A:1", "B:1"} and pairs.count() == 3 and "price" not in records.columns
    (tmp_path / "test.csv").write_text("ltable_id,rtable_id,label\n1,9,1\n")
    with pytest.raises(ValueError):
        readers.read_benchmark(spark, str(tmp_path))


def test_logs(spark, tmp_path):
    assert readers.read_ledger(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "l.jsonl").write_text('{"ts": "t", "usd": 0.5}\n\n{"ts": "to')
    assert [r.usd for r in readers.read_ledger(spark, str(tmp_path / "l.jsonl")).where("ts is not null").collect()] == [0.5]
    (tmp_path / "t.jsonl").write_text('{"item_id": "a", "seconds": 1.0, "started_at": "s", "abandoned": false}\n')
    assert readers.read_timings(spark, str(tmp_path / "t.jsonl")).first().seconds == 1.0
    (tmp_path / "t.jsonl").write_text("{torn")
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_timings(spark, str(tmp_path / "t.jsonl")).collect()


def test_codes(spark, tmp_path):
    (tmp_path / "main.csv").write_text("tender_classification_id,tender_classification_description\n 1 , x \n,y\n")
    assert [tuple(r) for r in readers.read_codes(spark, [str(tmp_path)]).collect()] == [("1", "x")]
    with pytest.raises(ValueError):
        readers.read_codes(spark, [str(tmp_path / "none")])


def test_cache_sink(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.append_cache(spark.createDataFrame([("a", 1), ("a", 1)], "key string, v int"), path)
    sinks.append_cache(spark.createDataFrame([("a", 2), ("b", 2)], "key string, v int"), path)
    assert {(r.key, r.v) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    assert json.loads(sinks.report_json(spark.range(1).toDF("n"))) == [{"n": 0}]
    assert "50\\%" in sinks.latex_table(spark.createDataFrame([("50%",)], "x string"), "c", "r")


def test_runs(spark, tmp_path):
    env = runs.environment()
    run_id = runs.new_run_id("s", b"cfg")
    runs.write_run(tmp_path, run_id, {"b": 1, "a": {"x": [1, 2]}}, {"m": 1}, env, spark.range(2).toDF("n"))
    got = runs.load_run(tmp_path, run_id)
    assert got["metrics"] == {"m": 1} and spark.read.parquet(got["predictions"]).count() == 2
    assert runs.latest_run(tmp_path, "s") == run_id and runs.latest_run(tmp_path, "x") is None
    with pytest.raises(FileNotFoundError):
        runs.load_run(tmp_path, "none")
    with pytest.raises(runs.DirtyRun):
        runs.refuse_dirty({"run_id": "r", "env": {"git_dirty": True}})
    with pytest.raises(FileExistsError):
        runs.write_run(tmp_path, run_id, {}, {}, env)


def test_incremental_import(spark, tmp_path):
    """Rows that equal or resemble the register's or earlier ones of the batch; blank keys; replays; compaction."""
    reg, dec = str(tmp_path / "reg"), str(tmp_path / "dec")
    batches = [
        [("1", "red pump steel"), ("2", "microscope lens")],
        [("3", "Red pump, steel"), ("4", "ring binder"), ("5", "Ring binder!"), ("6", "ring binder a4"), ("7", "12 34"), ("8", "99"), ("9", ""), ("a", None), ("b", "12 34")],
        [("c", "ring binder"), ("d", "new thing"), ("e", "99")],
    ]
    frames = [spark.createDataFrame(rows, "record_id string, title string") for rows in batches]
    for n, df in enumerate(frames):
        for _ in range(2):  # a replay changes nothing
            incremental.import_batch(spark, df, n, reg, dec)
        if n == 1:
            before = sorted(map(str, incremental.read_register(spark, reg).drop("bucket").collect()))
            for _ in range(2):
                incremental.compact(spark, reg, 1)
            assert sorted(map(str, incremental.read_register(spark, reg).drop("bucket").collect())) == before
            incremental.import_batch(spark, frames[2], 2, reg, dec)
            incremental.compact(spark, reg, 2)
    got = {r.record_id: (r.decision, r.best_id) for r in spark.read.option("recursiveFileLookup", True).parquet(dec).collect()}
    assert got["3"] == ("duplicate", "1") and got["5"] == ("duplicate", "4") and got["6"][1] == "4" and got["b"] == ("duplicate", "7")
    assert all(got[x] == ("new", None) for x in "1279ad8") and got["c"] == ("duplicate", "4") and got["e"] == ("duplicate", "8") and got["4"][0] == "new"
    assert incremental.read_register(spark, reg).count() == len({x for x, (d, _) in got.items() if d == "new"})


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    reg, dec = str(tmp_path / "reg"), str(tmp_path / "dec")
    incremental.import_batch(spark, spark.createDataFrame([(str(i), f"word{i} thing") for i in range(60)], "record_id string, title string"), 0, reg, dec)
    incremental.compact(spark, reg, 0)
    key = incremental.prepare(spark.createDataFrame([("x", "word7 other")], "record_id string, title string")).first()
    rows = incremental.read_register(spark, reg, 1, [key.bucket])
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", rows._jdf.queryExecution().executedPlan().toString())
    assert {r.bucket for r in rows.collect()} == {key.bucket} and 1 <= rows.count() < 10


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("1", "red pump"), ("2", "blue ring")], "record_id string, title string").write.parquet(str(src))
    stream = spark.readStream.schema("record_id string, title string").parquet(str(src))
    q = incremental.start(stream, str(tmp_path / "reg"), str(tmp_path / "dec"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert incremental.read_register(spark, str(tmp_path / "reg")).count() == 2


def test_token_windows(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:05", 10, 1), ("2024-01-01 00:00:50", 5, 0)], "ts string, input_tokens int, output_tokens int")
    assert incremental.token_windows(df).agg(F.max("tokens")).first()[0] == 16


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
def test_csv_of_any_split_size(spark, tmp_path, size):
    """Fields with line ends, quotes and blanks, some longer than a range: equal rows however the files are split."""
    rng = random.Random(size)
    field = lambda: "".join(rng.choice(['a', 'ß', ',', '"', '\n', '\r\n', ' ', 'word']) for _ in range(rng.choice([0, 1, 5, 40, 300])))
    rows = [[str(i), field(), field()] for i in range(60)]
    for k in range(2):
        with open(tmp_path / f"p{k}.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator=["\n", "\r\n"][k], quoting=csv.QUOTE_ALL)
            w.writerows([["id", "te\"xt", "no\nte"], *rows[k * 30 : k * 30 + 30]])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        out = readers.read_csv(spark, str(tmp_path))
        assert out.columns == ["id", 'te"xt', "no\nte"]
        got = sorted((list(r) for r in out.collect()), key=lambda r: int(r[0]))
        assert got == rows
        tasks = readers.csv_records(spark, str(tmp_path / "p0.csv")).count() and spark.read.text(str(tmp_path / "p0.csv")).rdd.getNumPartitions()
        assert size > 1000 or tasks > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"id","text"\n"1","x"\n')
    (tmp_path / "b.csv").write_text('"id","other"\n"2","y"\n')
    with pytest.raises(Exception, match="header differs"):
        readers.read_csv(spark, str(tmp_path)).collect()
