"""Operators that must be exact, against brute force: cosine join, ranks, draws, percentiles, sweeps, cascade bounds, headers."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import classify, cosine_join, degrade, margins, operating, ranks, register, register_index, sweep


def vector_rows(seed, n=260):
    """Two groups of Gaussian vectors, a dense cluster, copies, a zero vector, nulls."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=12)
    rows = []
    for i in range(n):
        kind = i % 5
        v = base + rng.normal(size=12) * 0.1 if kind == 0 else rng.normal(size=12)
        if kind == 1 and rows:
            v = np.array(rows[rng.integers(len(rows))][2])
        rows.append((f"r{i:04}", int(rng.integers(2)), np.float32(v).tolist()))
    return rows + [("zero", 0, [0.0] * 12), ("none", 0, None), ("lost", None, rows[0][2])]


VECTORS = "record_id string, label int, vector array<float>"


def cosines(rows):
    own = [(r, g, np.array(v, float)) for r, g, v in rows if g is not None and v is not None and any(v)]
    return [(min(a, b), max(a, b), g, float(x @ y / math.sqrt((x @ x) * (y @ y))), bool((x == y).all())) for (a, g, x), (b, h, y) in itertools.combinations(own, 2) if g == h]


@pytest.mark.parametrize(("least", "pivots", "size"), [(0.2, 8, 1024), (0.5, 3, 16), (0.9, 1, 7), (0.99, 8, 4)])
def test_cosine_join(spark, least, pivots, size):
    rows = vector_rows(size)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    every = cosines(rows)
    first = {}  # the least record_id of each vector
    for r, g, v in sorted(x for x in rows if x[1] is not None and x[2] and any(x[2])):
        first.setdefault((g, tuple(v)), r)
    rep = {r: first[g, tuple(v)] for r, g, v in rows if g is not None and v and any(v)}
    want = {(a, b) for a, b, _, s, same in every if (rep[a] == a and rep[b] == b and not same and s >= least) or (same and rep[b] == a)}
    got = {(r.left_id, r.right_id): r.score for r in cosine_join.cosine_join(df, "label", least, pivots, size).collect()}
    assert set(got) == want
    score = {(a, b): s for a, b, _, s, _ in every}
    assert all(abs(s - score[p]) < 1e-9 for p, s in got.items())
    links = {r.record_id: (r.class_id, r.n_links) for r in cosine_join.cosine_links(df, "label", least, pivots, size).collect()}
    linked = collections.Counter(x for p in want if score[p] < 1 - 1e-12 or rep[p[1]] != p[0] for x in p)
    assert links == {r: (c, linked[c]) for r, c in rep.items()}
    n = sum(k * (k - 1) // 2 for k in collections.Counter(r[1] for r in rows if r[1] is not None).values())
    row = cosine_join.pair_counts(df, "label", [least, 0.995], pivots, size).first()
    assert row.n_pairs == n
    told = [(sum(s > c for *_, s, _ in every), sum(s >= c for *_, s, _ in every)) for c in (least, 0.995)]
    assert [tuple(x) for x in row.above] == told


def test_cosine_join_prunes(spark):
    """Clusters far apart: hardly a pair of chunks is left of those that one group has."""
    rng = np.random.default_rng(1)
    rows = [(f"r{c}-{i}", 0, np.float32(np.eye(8)[c] + rng.normal(size=8) * 0.02).tolist()) for c in range(8) for i in range(64)]
    index = cosine_join.chunks(cosine_join.classes(spark.createDataFrame(rows, VECTORS), "label"), 16, 16)
    n = index.count()
    assert cosine_join.near_chunks(index, 0.9).count() < n * (n + 1) // 2 / 3
    with pytest.raises(ValueError):
        cosine_join.cosine_join(spark.createDataFrame(rows[:2], VECTORS), "label", 0.0)


def test_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaaaab"), rng.randrange(50), i) for i in range(500)]
    out = ranks.ranked(spark.createDataFrame(rows, "k string, v int, i int").repartition(7), ["k"], ["v", "i"]).collect()
    want = {i: (sorted((v, j) for h, v, j in rows if h == k).index((v0, i)), sum(h == k for h, _, _ in rows)) for k, v0, i in rows}
    assert {r.i: (r["rank"], r["size"]) for r in out} == want


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1001])
def test_percentiles(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.random(), rng.randrange(3), 1e-9 * rng.random(), 1e12, -5.0]) for _ in range(n)]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "s double")
    shares = [0.0, 0.1, 0.5, 0.9, 1.0]
    assert ranks.percentiles(df, "s", shares) == pytest.approx(np.percentile(values, [100 * p for p in shares]).tolist(), rel=1e-12)
    assert ranks.percentiles(df.limit(0), "s", [0.5]) == [None]


def test_pairs_are_unranked(spark):
    pairs = [(i, j) for j in range(1, 60) for i in range(j)]
    i, j = degrade.unranked(F.col("id"))
    assert [tuple(r) for r in spark.range(len(pairs)).orderBy("id").select(i, j).collect()] == pairs
    for top in (10**6, 3 * 10**9):  # the last pairs of large blocks
        t = top * (top - 1) // 2
        got = spark.createDataFrame([(t - 1,), (t,), (t + 1,)], "id long").select(*degrade.unranked(F.col("id"))).collect()
        assert [tuple(r) for r in got] == [(top - 2, top - 1), (0, top), (1, top)]


def test_every_pair_can_be_drawn(spark):
    """Draws of many seeds from one block are even (chi-square), distinct, and reach every pair."""
    n, seeds = 12, 400
    blocks = spark.createDataFrame([(f"k{s}", f"{m:02}") for s in range(seeds) for m in range(n)], "block_key string, record_id string")
    out = degrade.sample_block_pairs(blocks, 5, 3).collect()
    per = collections.Counter(r.block_key for r in out)
    assert set(per.values()) == {5} and len(per) == seeds and len({tuple(r) for r in out}) == 5 * seeds
    count = collections.Counter((r.left_id, r.right_id) for r in out)
    cells, mean = n * (n - 1) // 2, 5 * seeds / (n * (n - 1) / 2)
    assert len(count) == cells
    chi = sum((count[p] - mean) ** 2 / mean for p in itertools.combinations([f"{m:02}" for m in range(n)], 2))
    assert chi < cells + 4 * math.sqrt(2 * cells)


def test_draws_of_a_large_block(spark):
    """1,000 members: the pairs drawn over seeds are of members from everywhere; a small block gives all its pairs."""
    blocks = spark.createDataFrame([("big", f"{m:04}") for m in range(1000)] + [("two", "a"), ("two", "b"), ("one", "a"), (None, "x")], "block_key string, record_id string")
    seen = set()
    for seed in range(12):
        out = degrade.sample_block_pairs(blocks, 40, seed).collect()
        assert sum(r.block_key == "big" for r in out) == 40 and [tuple(r)[1:] for r in out if r.block_key == "two"] == [("a", "b")]
        seen |= {x for r in out if r.block_key == "big" for x in (r.left_id, r.right_id)}
    assert len(seen) > 500
    assert degrade.sample_block_pairs(blocks.limit(0), 5, 1).count() == 0


def items(spark):
    words = ["red", "blue", "steel", "pump", "valve", "filter", "large", "230V", "pipe"]
    rng = random.Random(4)
    return spark.createDataFrame([(f"{i}", " ".join(rng.choice(words) for _ in range(5)) + f" {i}", f"b{i % 4}") for i in range(80)], "record_id string, title string, buyer_id string")


def test_severity_sweep(spark):
    """Severity 0 is the undegraded evaluation in each seed, and a cell alone gives what it gives among others."""
    r = items(spark)
    cells = {(x.severity, x.seed): x for x in sweep.severity_sweep(r, operating.severity_grid(spark, [0.0, 0.3], [7, 11]), 0.6).collect()}
    clean, other = cells[0.0, 7], cells[0.0, 11]
    assert clean.recall == clean.pair_completeness == 1.0 and tuple(clean)[2:] == tuple(other)[2:]
    assert cells[0.3, 7].recall < 1 and tuple(cells[0.3, 7])[2:] != tuple(cells[0.3, 11])[2:]
    alone = sweep.severity_sweep(r, operating.severity_grid(spark, [0.3], [7]), 0.6).first()
    assert tuple(alone) == tuple(cells[0.3, 7])


def test_rates_by_column_are_those_by_number(spark):
    r = items(spark).withColumn("description", F.concat(F.lit("temperature 1.5 kW number "), "record_id"))
    for severity in (0.0, 0.25, 1.0):
        one = degrade.degrade_frame(r, degrade.Degradation(severity), 7, suffix="::a").select("record_id", "title", "description")
        many = degrade.degrade_frame(r.withColumns({"s": F.lit(severity), "k": F.lit(7)}), degrade.Degradation(F.col("s")), F.col("k"), suffix="::a").select("record_id", "title", "description")
        assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    plain = degrade.degrade_frame(r, degrade.Degradation(0.25), 7).select("title").collect()
    assert sorted(plain) == sorted(degrade.degrade_frame(r, degrade.Degradation(0.25), 7, suffix="::a").select("title").collect())


@pytest.mark.parametrize(("seed", "target"), [(1, 0.9), (2, 0.7), (3, 1.0), (4, 0.5)])
def test_cascade_bounds(spark, seed, target):
    rng = random.Random(seed)
    rows = [(s, int(rng.random() < s)) for s in (rng.choice([rng.random(), 0.0, 1.0, 0.5]) for _ in range(150))]
    got = operating.cascade_thresholds(operating.score_histogram(spark.createDataFrame(rows, "score double, label int"), 50), target, 50).first()
    bins = [(min(math.floor(s * 50), 50), y) for s, y in rows]
    best = None
    for c, d in itertools.product(range(52), range(52)):
        up, down = [y for b, y in bins if b >= c], [y for b, y in bins if b < d]
        if d <= c and sum(up) >= target * len(up) and len(down) - sum(down) >= target * len(down):
            best = min(best or (10**9,), (len(rows) - len(up) - len(down), c))
    assert got.n_adjudicated == best[0] and got.n_pairs == len(rows)
    accepted, rejected = [y for s, y in rows if s >= got.upper], [y for s, y in rows if s <= got.lower]
    assert (len(accepted), len(rejected)) == (got.n_accepted, got.n_rejected) and got.lower < got.upper
    assert sum(accepted) >= target * len(accepted) and len(rejected) - sum(rejected) >= target * len(rejected)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 3])
def test_headers_within_edits(spark, most):
    rng = random.Random(most)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(9)))
    left, right = sorted({word() for _ in range(70)}), sorted({word() for _ in range(70)})
    found = register.edit_candidates(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), most)
    near = {(a, b) for a in left for b in right if distance(a, b) <= most}
    assert near <= {tuple(r) for r in found.collect()}
    h, t = spark.createDataFrame([(f"{x} ",) for x in left], "header string"), spark.createDataFrame([(f"T{x}", x) for x in right], "target string, alias string")
    out = register.map_headers(h, t, most)
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    want = {}
    for a in left:
        if own := sorted((distance(a, b), f"T{b}") for b in right if (a, b) in near):
            want[f"{a} "] = own[0]
    assert {r.header: (r.distance, r.target) for r in out.collect()} == want


def test_search_by_index_is_that_by_scan(spark, tmp_path):
    rng = random.Random(8)
    words = ["red", "steel", "pump", "valve", "common", "common", "ring", "rare"]
    text = lambda: " ".join(rng.choice(words[: rng.choice([5, 8])]) for _ in range(rng.randrange(6)))
    df = spark.createDataFrame([(f"{i:03}", text(), text() if i % 3 else None) for i in range(300)], "record_id string, title string, note string")
    fields, path = {"title": "A", "note": "C"}, f"file://{tmp_path}/index"
    register_index.build(df, fields, path, blocks=16)
    for query in ("common", "Red common", "rare steel pump", "nothing red"):
        want = sorted(((-round(r["rank"], 6), r.record_id) for r in register.search(df, query, fields).collect()))
        assert sorted((-round(r["rank"], 6), r.record_id) for r in register_index.search(spark, path, query).collect()) == want
        for limit in (1, 7, 1000):
            assert [(-round(r["rank"], 6), r.record_id) for r in register_index.search(spark, path, query, limit).collect()] == want[:limit]
    plan = register_index.postings(spark, path, ["red", "common"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "In(term" in plan
    with pytest.raises(ValueError):
        register_index.search(spark, path, " ")


def svm_rows(seed, n=150, labels=3):
    rng = random.Random(seed)
    words = [[f"w{k}{chr(97 + i)}x" for i in range(8)] for k in range(labels)]
    return [(" ".join(rng.choice(words[rng.randrange(labels) if rng.random() < 0.3 else i % labels]) for _ in range(6)), f"L{i % labels}") for i in range(n)]


def test_margins_are_those_of_plain_descent(spark):
    """The same steps in dense numpy, for the machines of all rows and of each fold's complement; the fold's own rows don't count."""
    model = classify.TfidfSvm(features=256, max_iter=12)
    rows = svm_rows(1)
    df = spark.createDataFrame(rows, "text string, label string").repartition(3)
    model.fit(df)
    own = model._hashed(df).select("h", "label", F.pmod(F.xxhash64("text"), F.lit(3)).alias("fold")).collect()
    n = len(own)
    tf = np.zeros((n, 256))
    for i, r in enumerate(own):
        np.add.at(tf[i], r.h, 1)
    x = tf * (np.log((1 + n) / (1 + (tf > 0).sum(axis=0))) + 1)
    x = np.c_[x / np.linalg.norm(x, axis=1)[:, None], np.ones(n)]
    fold = np.array([r.fold for r in own])
    for f in range(4):
        use = fold != f if f < 3 else np.ones(n, bool)
        for k, name in enumerate(model.labels):
            y = np.array([1.0 if r.label == name else -1.0 for r in own])
            before = ahead = np.zeros(257)
            for t in range(12):
                slope = -2 * y * np.maximum(0, 1 - y * (x @ ahead)) * use
                now = ahead - margins.STEP * (x.T @ slope / use.sum() + margins.DECAY * ahead)
                ahead, before = now + t / (t + 3) * (now - before), now
            assert np.allclose(model.machines.weights[:, f * 3 + k], before, atol=1e-3)


def test_calibration_is_out_of_fold(spark):
    """Labels of no sense are learnt by heart by the machines of all rows; calibration knows that it means nothing. Labels of
    some sense keep their scores."""
    rng = random.Random(2)
    noise = [("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)), rng.choice("AB")) for _ in range(120)]
    for rows, least, most in ((noise, 0.0, 0.65), (svm_rows(5), 0.7, 1.0)):
        model = classify.TfidfSvm(features=1 << 12, max_iter=25).fit(spark.createDataFrame(rows, "text string, label string"))
        scores = [r.score for r in classify.result(model.scores(spark.createDataFrame(rows, "text string, truth string"))).select("score").collect()]
        assert least <= sum(scores) / len(scores) <= most


def test_jobs_of_a_fit_do_not_grow_with_labels(spark):
    tracker, counts = spark.sparkContext.statusTracker(), []
    for labels in (2, 6):
        df = spark.createDataFrame(svm_rows(3, 60, labels), "text string, label string")
        spark.sparkContext.setJobGroup(f"fit{labels}", "fit")
        classify.TfidfSvm(features=128, max_iter=3).fit(df)
        counts.append(len(tracker.getJobIdsForGroup(f"fit{labels}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]
