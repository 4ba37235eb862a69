import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from quillmark.operators import adjudicate, blocking, classify, degrade, embedding, ledger, matching, operating, profile, records, register, sampling, splits, taxonomy, timing


def recs(spark, titles, **more):
    rows = [{"record_id": str(i), "title": t, "description": None} | {k: v[i] for k, v in more.items()} for i, t in enumerate(titles)]
    schema = "record_id string, title string, description string" + "".join(f", {k} string" for k in more)
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema)


def pairs(spark, *p):
    return spark.createDataFrame(list(p), "left_id string, right_id string")


def got(df):
    return {tuple(r) for r in df.collect()}


def test_waterfall_names_the_first_rule(spark):
    long = "laboratory centrifuge with rotor and a long description of sixty characters"
    rows = [("1", "t", long, "38000000"), ("2", "t", long, "99000000"), ("3", "t", "x", "38000000"), ("4", long, long, "38000000"), ("5", "a title that is long enough to pass the limit of sixty", "As per tender", "38000000"), ("6", "t", long, None)]
    df = spark.createDataFrame(rows, "record_id string, title string, description string, cpv_code string")
    judged = records.waterfall(df)
    assert {r.record_id: r.discard_reason for r in judged.collect()} == {"1": None, "2": "out_of_scope", "3": "short", "4": "desc_equals_title", "5": "boilerplate", "6": "out_of_scope"}
    report = records.discard_report(judged)
    records.check_report(report)
    assert report.first().total_out == 1 and records.kept(judged).count() == 1


def test_validation(spark):
    ok = spark.createDataFrame([("1", "t", None, None, None, None, "b", None, None, "upload")], records.RECORD_SCHEMA)
    with pytest.warns(UserWarning):
        records.validate(ok)
    with pytest.raises(records.SchemaError):
        records.validate(ok.union(ok))
    with pytest.raises(records.SchemaError):
        records.validate(ok.withColumn("source", F.lit("x")))
    with pytest.raises(records.SchemaError):
        records.validate(ok.drop("title"))


def test_raw_notices_become_records(spark):
    raw = spark.createDataFrame([("a", "T", "", "b", "38000000", "2025-03-04T09:00:00Z", "ref"), ("b", "", "d", "", "", "junk", "")], "id string, tender_title string, tender_description string, buyer_id string, tender_classification_id string, date string, tender_id string")
    (r,) = records.to_records(raw, 2025).collect()
    assert (r.record_id, r.description, r.release_date, r.bundle_year) == ("a", None, datetime.date(2025, 3, 4), 2025)


def test_blocks_pairs_and_reports(spark):
    df = recs(spark, ["zeiss microscope", "microscope zeiss", "", "of the"], buyer_id=["x", "x", "y", None])
    assert got(blocking.block_pairs(blocking.gram_blocks(df))) == {("0", "1")}
    assert got(blocking.block_pairs(blocking.gram_blocks(df, mode="single_key"))) == {("0", "1")}
    assert got(blocking.block_pairs(blocking.leading_blocks(df))) == set()
    assert got(blocking.block_pairs(blocking.buyer_blocks(df))) == {("0", "1")}
    assert blocking.applicable(df) == ["sorted_ngrams", "leading_token", "buyer"]
    assert blocking.applicable(df.drop("buyer_id")) == ["sorted_ngrams", "leading_token"]
    with pytest.raises(blocking.SchemeUnavailable):
        blocking.buyer_blocks(df.drop("buyer_id"))
    with pytest.raises(ValueError):
        blocking.build_blocks(df, "x")
    with pytest.raises(ValueError):
        blocking.gram_blocks(df, mode="x")
    r = blocking.block_report(df, blocking.leading_blocks(df), "leading_token").first()
    assert (r.n_blocks, r.unblocked) == (2, 2)
    assert blocking.block_pairs(blocking.gram_blocks(df), most=1).count() == 0


def test_exact_pairs_of_large_groups(spark):
    keys = spark.createDataFrame([(str(i), "a") for i in range(1000, 1700)] + [("1", "b"), ("2", "b"), ("3", "c"), ("4", "d"), ("5", "d"), ("6", "d")], "record_id string, key string")
    small = {("1", "2", 1.0), ("4", "5", 1.0), ("4", "6", 1.0)}  # one form for every size: links to the least
    assert got(matching.ExactMatcher().equal_pairs(keys)) == small | {("1000", str(i), 1.0) for i in range(1001, 1700)}


def test_operators_see_through_encodings(spark):
    same = [("ﬁlter press unit", "filter press unit"), ("ＡＢＣ pump", "abc pump"), ("CafÃ© grinder", "Café grinder")]
    df = recs(spark, [t for p in same for t in p], buyer_id=["b"] * 6)
    want = {("0", "1"), ("2", "3"), ("4", "5")}
    assert {r[:2] for r in matching.ExactMatcher().equal_pairs(matching.record_keys(df)).collect()} == want
    assert got(blocking.block_pairs(blocking.gram_blocks(df, mode="single_key"))) == want
    assert got(blocking.block_pairs(blocking.leading_blocks(df))) == want
    assert got(blocking.overlap_pairs(df, min_overlap=3)) == want
    assert {r.left_id: round(r.score, 6) for r in matching.TfidfMatcher().score_pairs(pairs(spark, *want), df).collect()} == {"0": 1.0, "2": 1.0, "4": 1.0}
    long = "laboratory ﬁlter press with a long title of more than sixty characters"
    row = spark.createDataFrame([("1", long, long.replace("ﬁ", "fi"), "38000000")], "record_id string, title string, description string, cpv_code string")
    assert records.waterfall(row).first().discard_reason == "desc_equals_title"


def test_blocking_metrics(spark):
    cand = pairs(spark, ("a", "b"), ("d", "c"))
    truth = spark.createDataFrame([("b", "a", 1), ("a", "d", 1), ("c", "d", 0)], "left_id string, right_id string, label int")
    r = blocking.evaluate(cand, truth, 4).first()
    assert (r.pair_completeness, round(r.reduction_ratio, 6)) == (0.5, round(1 - 2 / 6, 6))
    assert blocking.evaluate(cand, None, 4).first().pair_completeness is None
    assert blocking.evaluate(cand, truth, 1).first().reduction_ratio is None


def test_corpus_evaluation(spark):
    df = recs(spark, ["zeiss microscope lens", "microscope zeiss lens", "pump"])
    truth = spark.createDataFrame([("0", "1", 1)], "left_id string, right_id string, label int")
    rows = {r.scheme: r for r in blocking.evaluate_corpus(df, truth, options={"sorted_ngrams": {"min_overlap": 3}}).collect()}
    assert set(rows) == {"sorted_ngrams", "leading_token", "buyer", "union"}
    assert rows["buyer"].unavailable and rows["sorted_ngrams"].pair_completeness == 1 and rows["union"].n_candidates == 1
    assert rows["sorted_ngrams"].unblocked == 0 and rows["leading_token"].n_blocks == 3
    assert blocking.dropped_total(df, ["leading_token"], 0).first()[0] == 3


def test_sweep_and_operating_point(spark):
    shared = spark.createDataFrame([("a", "b", 9), ("a", "c", 3), ("b", "c", 1)], "left_id string, right_id string, shared long")
    truth = spark.createDataFrame([("a", "b", 1), ("a", "c", 1)], "left_id string, right_id string, label int")
    curve = blocking.sweep(shared, truth, 3, [1, 2, 8])
    assert {r.threshold: (r.n_candidates, r.pair_completeness) for r in curve.collect()} == {1: (3, 1.0), 2: (2, 1.0), 8: (1, 0.5)}
    assert blocking.operating_point(curve, 0.98).first().selected == 2
    none = blocking.operating_point(curve, 1.1).first()
    assert none.selected is None and none.best_threshold == 1


def test_matchers(spark):
    df = recs(spark, ["Pump A-4", "pump a4", "valve"])
    p = pairs(spark, ("0", "1"), ("0", "2"))
    assert {(r.left_id, r.right_id): r.score for r in matching.ExactMatcher().score_pairs(p, df).collect()} == {("0", "1"): 1.0, ("0", "2"): 0.0}
    s = {(r.left_id, r.right_id): r.score for r in matching.TfidfMatcher().score_pairs(p, df).collect()}
    assert 0.2 < s["0", "1"] < 1 and s["0", "2"] == 0
    with pytest.raises(KeyError):
        matching.ExactMatcher().score_pairs(pairs(spark, ("0", "x")), df)


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([("1", ["a", "a", "b"]), ("2", ["b"])], "record_id string, t array<string>")
    w = {(r.record_id, r.term): r.weight for r in matching.tfidf(df, F.col("t")).collect()}
    a, b = (1 + math.log(2)) * (math.log(3 / 2) + 1), 1.0
    assert w["1", "a"] == pytest.approx(a / math.hypot(a, b)) and w["2", "b"] == pytest.approx(1)


def test_prefix_filter_loses_no_pair(spark):
    import random

    rng = random.Random(5)
    words = ["pump", "valve", "ring", "bolt", "red", "blue", "steel", "small", "large"]
    docs = spark.createDataFrame([(str(i % 3), str(i), " ".join(rng.choices(words, k=rng.randint(1, 5)))) for i in range(60)], "g string, record_id string, text string")
    from quillmark.functions.text import padded_grams

    w = matching.tfidf(docs, padded_grams(F.col("text")), "g", sublinear=False)
    l, r = w.select("g", "term", F.col("record_id").alias("left_id"), F.col("weight").alias("a")), w.select("g", "term", F.col("record_id").alias("right_id"), F.col("weight").alias("b"))
    want = l.join(r, ["g", "term"]).where("left_id < right_id").groupBy("g", "left_id", "right_id").agg(F.sum(F.col("a") * F.col("b")).alias("s")).where("s >= 0.75").select("left_id", "right_id")
    assert got(matching.similar_in_group(docs, "g").select("left_id", "right_id")) == got(want)


@pytest.mark.parametrize(("ties", "want"), [("rows", 0.9), ("range", float("inf"))])
def test_threshold_ties(spark, ties, want):
    df = spark.createDataFrame([(0.9, 1, 0), (0.9, 0, 1)], "score double, label int, k int")
    assert matching.select_threshold(df, 1.0, ties, "k").first().threshold == want


def test_threshold_and_rates(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.7, 0), (0.6, 1)], "score double, label int")
    assert matching.select_threshold(df, 1.0).first().threshold == 0.8
    assert matching.select_threshold(df, 0.75).first().threshold == 0.6
    r = matching.prf1(matching.predict(df, 0.7)).first()
    assert (r.tp, r.fp, r.fn, round(r.f1, 6)) == (2, 1, 1, round(2 / 3, 6))
    assert matching.prf1(matching.predict(df.limit(0), 0.7)).first().f1 == 0
    assert matching.predict(df, float("inf")).where("predicted = 1").isEmpty()
    curve = operating.curve(df)
    assert operating.automated_share(curve, 1.0).first().automated_share == 0.5
    none = operating.automated_share(curve.where("precision < 1"), 1.0).first()
    assert math.isnan(none.threshold) and none.automated_share == 0
    assert operating.residual_effort(100, 0.5, 72) == {"baseline_hours": 2.0, "residual_hours": 1.0, "hours_saved": 1.0}


def test_cascade(spark):
    scored = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.5), ("a", "d", 0.1), ("b", "d", 0.6)], "left_id string, right_id string, score double")
    asked = []

    def ask(df):
        asked.append(df.count())
        return df.withColumn("score", F.lit(1.0))

    c = matching.CascadeMatcher(matching.ExactMatcher(), 0.2, 0.8, ask, max_adjudicated=1)
    assert {(r.left_id, r.right_id): r.score for r in c.resolve(scored).collect()} == {("a", "b"): 1.0, ("a", "c"): 1.0, ("a", "d"): 0.0, ("b", "d"): 0.6}
    assert asked == [1] and c.stats(scored).first().band_fraction == 0.5


def test_taxonomy(spark):
    codes = spark.createDataFrame([(" 30121100 ", "Copier"), ("30121100", "Copier"), ("30121100", "Other"), ("38000000", "Lab"), ("x", "bad"), ("", "none")], "code string, description string")
    t = {r.cpv_code: (r.level, r.parent_code, r.cpv_description) for r in taxonomy.build(codes).collect()}
    assert t == {"30121100": (8, "3012", "Copier"), "3012": (4, "30", None), "30": (2, None, None), "38": (2, None, "Lab")}
    assert taxonomy.missing_ancestors(taxonomy.build(codes)).isEmpty()
    assert taxonomy.conflicting_codes(codes).first()[0] == 1
    with pytest.raises(ValueError):
        taxonomy.build(codes.limit(0))


def test_support_and_sparsity(spark):
    df = spark.createDataFrame([("30120000",)] * 60 + [("31000000",)] * 10 + [(None,)], "cpv_code string")
    r = taxonomy.coverage(df, "class").first()
    assert (r.n_labels, r.n_supported, round(r.coverage, 6)) == (3, 1, round(60 / 71, 6))
    assert taxonomy.coverage(df.limit(0), "class").first().coverage == 0
    s = taxonomy.leaf_sparsity(df).first()
    assert (s.n_distinct_leaves, s.n_leaves_ge_50, s.n_records) == (2, 1, 70)


def test_splits(spark, tmp_path):
    df = spark.createDataFrame([("1", datetime.date(2025, 1, 1)), ("2", datetime.date(2024, 12, 31)), ("3", None)], "record_id string, release_date date")
    parts = splits.freeze_records(df)
    assert got(parts) == {("1", "test"), ("2", "dev"), ("3", "dev")}
    splits.write(parts, ["record_id"], str(tmp_path / "s"))
    with pytest.raises(Exception, match="already exists"):
        splits.write(parts, ["record_id"], str(tmp_path / "s"))
    assert splits.select(df, splits.load(spark, str(tmp_path / "s"), ["record_id"]), "test", ["record_id"]).count() == 1
    with pytest.raises(splits.SplitOverlap):
        splits.check(parts.union(parts.withColumn("part", F.lit("test"))), ["record_id"])
    with pytest.raises(splits.SplitOverlap):
        splits.check(parts.where("part = 'dev'"), ["record_id"])


def test_degradation_is_seeded_by_row(spark):
    df = recs(spark, [f"Laboratory microscope model {i} 230V" for i in range(20)]).withColumn("description", F.lit("Equipment for the laboratory, 1.5kW"))
    cfg = degrade.Degradation(0.5)
    a = got(degrade.degrade_frame(df, cfg, 7))
    assert a == got(degrade.degrade_frame(df.repartition(5), cfg, 7)) and a != got(degrade.degrade_frame(df, cfg, 8))
    assert got(degrade.degrade_frame(df, degrade.Degradation(0.0), 7)) == got(df)
    assert all(r.title for r in degrade.degrade_frame(df, degrade.Degradation(1.0), 7).collect())
    _, p = degrade.duplicate_pairs(df, cfg, 7)
    assert p.count() == 20
    with pytest.raises(ValueError):
        degrade.Degradation(1.5)
    with pytest.raises(ValueError):
        cfg.rate("x")


def test_degradation_words(spark):
    lex = degrade.read_lexicon()
    assert len(lex) == 49 and lex["number"] == "no"
    text, draws = F.col("t"), degrade.Draws(F.lit("7|x"))
    one = lambda t, edit: spark.createDataFrame([(t,)], "t string").select(edit.alias("t")).first().t
    assert one("Temperature TEMPERATURE temperatures, temperature", degrade.abbreviate(text, draws, 1.0, lex)) == "temp TEMP temperatures, temp"
    assert one("   ", degrade.char_noise(text, draws, 1.0)) == "   "
    for edit in (degrade.vary_units, degrade.char_noise, degrade.vary_case, degrade.vary_spaces):
        assert one("", edit(text, draws, 1.0)) == "" and one(None, edit(text, draws, 1.0)) is None and one("ab 2V", edit(text, draws, 0.0)) == "ab 2V"
    assert one("a 1.5 kW, 230V x", degrade.vary_units(text, draws, 1.0)).lower().replace(" ", "").replace(",5", ".5") == "a1.5kw,230vx"
    assert one("o'neil-SMITH pump", degrade.vary_case(text, draws, 1.0)).lower() == "o'neil-smith pump"
    assert one("a b c", degrade.vary_spaces(text, draws, 1.0)).replace(" ", "") == "abc"


def test_char_noise_edits_as_often_as_told(spark):
    import random

    rng = random.Random(2)
    text = "".join(chr(rng.randrange(0x4E00, 0x9000)) if i % 7 else " " for i in range(3000))
    out = spark.createDataFrame([(str(i), text) for i in range(4)], "i string, t string").select(degrade.char_noise(F.col("t"), degrade.Draws(F.col("i")), 0.2).alias("t")).collect()
    assert len({r.t for r in out}) == 4
    for r in out:
        assert abs(len(r.t) - len(text)) < 100 and r.t.count(" ") == text.count(" ")
        import difflib

        same = sum(m.size for m in difflib.SequenceMatcher(None, text, r.t, autojunk=False).get_matching_blocks())
        assert 0.75 < same / len(text) < 0.95


def test_distractors(spark):
    rows = [("1", "Laboratory microscope zeiss", "38120000", "b1", "R1"), ("2", "Laboratory microscopes zeiss", "38120000", "b2", "R2"), ("3", "Laboratory microscope zeiss", "38120000", "b1", "R3"), ("4", "Laboratory microscope zeiss", "31000000", "b4", "R4"), ("5", "Laboratory microscope zeiss!", "38120000", "b5", "R1 - AWARD")]
    df = spark.createDataFrame(rows, "record_id string, title string, cpv_code string, buyer_id string, tender_ref string")
    p = got(degrade.distractors(df, "cf", 7, max_per_group=100).select("left_id", "right_id"))
    assert ("1", "3") not in p and ("1", "5") not in p and ("1", "2") in p and ("3", "5") in p and not any("4" in x for x in p)
    assert degrade.distractors(df, "abtbuy", 7, max_pairs=2).count() == 2
    with pytest.raises(ValueError):
        degrade.distractors(df, "x", 7)


def test_samples(spark):
    df = spark.createDataFrame([(str(i), str(i + 1)) for i in range(50)], "left_id string, right_id string")
    a = sampling.draw(df, 10, 7, "left_id", "right_id")
    assert got(a) == got(sampling.draw(df.repartition(3), 10, 7, "left_id", "right_id")) and a.count() == 10
    assert sampling.draw(df, 99, 7, "left_id").count() == 50
    log = a.limit(4).withColumn("verdict", F.lit("unsure"))
    assert sampling.unjudged(a, log).count() == 6
    assert sampling.contamination(a, log).first().rate is None
    full = a.withColumn("verdict", F.lit("distinct"))
    assert sampling.contamination(a, full).first().rate == 0
    same = spark.createDataFrame([("x", "x"), ("y", "y")], "a string, b string")
    assert sampling.kappa(same, "a", "b").first().kappa == 1


def test_embedding_cache(spark, tmp_path):
    loads = spark.sparkContext.accumulator(0)

    def load():
        loads.add(1)
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("aa",), ("aa",), ("b",), (None,)], "text string")
    path = str(tmp_path / "cache")
    out = embedding.embed(df, "m", load, path)
    assert out.count() == 4 and all(abs(sum(x * x for x in r.vector) - 1) < 1e-5 for r in out.collect())
    before = loads.value
    embedding.embed(df, "m", load, path).collect()
    assert loads.value == before > 0
    s = embedding.cache_stats(df, "m", spark.read.parquet(path)).first()
    assert (s.n_texts, s.n_unique, s.n_cached, s.n_missing) == (4, 3, 3, 0)


def test_timing(spark):
    rows = [(str(i), float(i), False) for i in range(1, 101)] + [("x", 500.0, True)]
    df = spark.createDataFrame(rows, "item_id string, seconds double, abandoned boolean")
    r = timing.checked_summary(df)
    assert (r["n"], r["n_abandoned"], r["median_seconds"], round(r["p90_seconds"], 6)) == (100, 1, 50.5, 90.1)
    with pytest.raises(timing.TooFewTimings):
        timing.checked_summary(df.limit(5))
    log = []
    ticks = iter([0.0, 200.0])
    with pytest.raises(RuntimeError), timing.time_item("a", log.append, clock=lambda: next(ticks)):
        raise RuntimeError
    assert log[0]["abandoned"] and log[0]["seconds"] == 200


def request(n, text="p"):
    return adjudicate.Request(str(n), "sys", f"{text}{n}")


def test_client(tmp_path):
    now = [0.0]
    sent = []

    def transport(call):
        sent.append(call)
        return 200, {"text": "yes", "tokens_in": 700, "tokens_out": 10}, {}

    c = adjudicate.Client("m", transport, tmp_path, sleep=lambda s: now.__setitem__(0, now[0] + s), clock=lambda: now[0])
    a, b = c.complete(request(1)), c.complete(request(1))
    assert (a.cached, b.cached, b.usd, len(sent)) == (False, True, 0.0, 1)
    rows = list(adjudicate.read_rows(c.ledger))
    assert [r["cache_hit"] for r in rows] == [False, True] and rows[1]["usd_uncached"] > 0
    c.complete(request(2))
    assert now[0] >= 2.0
    again = adjudicate.Client("m", transport, tmp_path)
    assert again.quota.requests_today == 2


def test_client_limits(tmp_path):
    replies = iter([(429, {}, {"retry-after": "3"}), (500, {}, {}), (200, {"text": "t", "tokens_in": 1, "tokens_out": 1}, {"x-ratelimit-remaining-requests": "0"})])
    waits = []
    c = adjudicate.Client("m", lambda call: next(replies), tmp_path, sleep=waits.append, clock=lambda: 0.0)
    c.complete(request(1))
    assert waits[0] == 3.0
    with pytest.raises(adjudicate.DailyQuota) as e:
        c.complete_many([request(1), request(2)])
    assert set(e.value.done) == {"1"}
    with pytest.raises(adjudicate.ModelError):
        adjudicate.Client("m", lambda call: (400, {}, {}), tmp_path / "b", sleep=waits.append).complete(request(1))
    with pytest.raises(adjudicate.BudgetExceeded):
        adjudicate.Client("m", lambda call: (200, {"text": "t", "tokens_in": 1, "tokens_out": 1}, {}), tmp_path / "c", limits=adjudicate.Limits(cap_usd=0.0)).complete(request(1))
    with pytest.raises(adjudicate.ModelError):
        adjudicate.Client("m", lambda call: (200, {}, {}), tmp_path / "d", limits=adjudicate.Limits(tpm=10)).complete(request(1))
    assert adjudicate.retry_after("junk", 4.0) == 4.0 and adjudicate.retry_after("-1", 4.0) == 0.0


def test_ledger(spark):
    rows = [("2026-08-02T01:00:00", "r", "main", 10, 5, 7, 0.1, 0.1, False), ("2026-08-02T01:00:00", "r", "main", 10, 5, 0, 0.0, 0.1, True), ("2026-08-01T01:00:00", "p", "pilot", 1, 1, 1, 0.2, 0.2, False)]
    df = spark.createDataFrame(rows, "ts string, run_id string, condition string, input_tokens int, output_tokens int, latency_ms int, usd double, usd_uncached double, cache_hit boolean")
    u = ledger.usage(df, "2026-08-02").first()
    assert (round(u.spend_usd, 6), u.tokens_today, u.requests_today) == (0.3, 15, 1)
    (r,) = ledger.cost_by_run(df).collect()
    assert (r.run_id, r.n, round(r.usd_per_1000, 6)) == ("r", 2, 100.0)


def test_macro_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "t string, p string")
    r = classify.macro_weighted_f1(df, "t", "p").first()
    assert round(r.macro_f1, 6) == round((0.5 + 2 / 3 + 0) / 3, 6) and r.accuracy == 0.5
    assert classify.confusion_wide(df, "t", "p", ["a", "b"]).count() == 3


def test_classifiers(spark):
    rows = [(f"pump hydraulic {i}", "P", [1.0, 0.1 * (i % 3)]) for i in range(12)] + [(f"microscope lens {i}", "M", [0.1 * (i % 3), 1.0]) for i in range(12)]
    df = spark.createDataFrame(rows, "text string, label string, vector array<double>")
    for model in (classify.TfidfSvm(1 << 10, 10), classify.EmbeddingLogistic()):
        out = classify.result(model.fit(df).scores(df.withColumnRenamed("label", "truth")))
        assert out.where("label = truth").count() == 24
        assert {len(r.alternatives) for r in out.select("alternatives").collect()} == {2}
    routed = classify.route_unsupported(out, spark.createDataFrame([("P",)], "label string"))
    assert got(routed.select("label", "route").distinct()) == {("P", "auto"), ("M", "review")}


def test_shortlist_classifier(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    labels = spark.createDataFrame([("x", [1.0, 0.1]), ("y", [0.0, 1.0]), ("z", [-1.0, 0.0])], "label_id string, vector array<double>")
    near = embedding.shortlist(q, labels, k=2, block_rows=1)
    assert {(r.query_id, r["rank"]): r.label_id for r in near.collect()}[1, 1] == "x"
    c = classify.ShortlistClassifier(lambda df: df.where("rank = 2").withColumn("score", F.lit(0.99)), k=2)
    assert {r.query_id: r.scores[0].label for r in c.scores(q, labels).collect()} == {1: "y", 2: "x"}


def test_register(spark):
    rows = spark.createDataFrame([("1", "L", 0.9), ("2", "L", 0.9), ("3", "X", 0.9), ("4", "L", 0.1)], "row_id string, label string, score double")
    matches = spark.createDataFrame([("2", "r1", 0.95), ("2", "r2", 0.5)], "row_id string, register_id string, similarity double")
    routed = register.route(rows, matches, spark.createDataFrame([("L",)], "label string"), 0.9, 0.5, 0.5)
    assert {r.row_id: (r.decision, r.route) for r in routed.collect()} == {"1": ("new", "auto"), "2": ("duplicate", "review"), "3": ("new", "review"), "4": ("new", "review")}
    done, audit = register.commit(routed, spark.createDataFrame([("3", "overridden", "L"), ("4", "rejected", None)], "row_id string, verdict string, label string"))
    assert {r.row_id: r.label for r in done.collect()} == {"1": "L", "3": "L"} and audit.count() == 2


def test_service_and_notices(spark):
    assets = spark.createDataFrame([(1, 30), (2, 365), (3, 10)], "asset_id int, interval_days int")
    events = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-02-01"), (2, "2024-01-01")], "asset_id int, performed_at string")
    s = register.service_state(assets, events, F.lit("2024-03-20").cast("date"))
    assert {r.asset_id: r.state for r in s.collect()} == {1: "overdue", 2: "ok", 3: None}
    first = register.new_notifications(s, spark.createDataFrame([], "asset_id int, kind string, due date"))
    assert first.count() == 1 and register.new_notifications(s, first).isEmpty()


def test_hazards_and_evidence(spark):
    df = recs(spark, ["red pump", "pump blue"], cpv_code=["38120000", "99000000"])
    assert got(register.with_hazard(df).select("hazard_class", "interval_days")) == {("calibration_required", 365), (None, None)}
    assert register.evidence(pairs(spark, ("0", "1")), df).first().matched == ["pum", "ump"]
    assert len(register.ALIASES) == 4


def test_search_and_headers(spark):
    df = recs(spark, ["Red pump", "blue pump", "red ring"]).withColumn("description", F.lit("steel"))
    hits = register.search(df, "red steel", {"title": "A", "description": "C"})
    assert {r.record_id: round(r["rank"], 3) for r in hits.collect()} == {"0": 1.2, "2": 1.2}
    h = register.map_headers(spark.createDataFrame([("Serial No.",), ("zzzzzzzz",)], "header string"), spark.createDataFrame([("serial_number", "serial no"), ("title", "name")], "target string, alias string"))
    assert got(h.select("header", "target")) == {("Serial No.", "serial_number")}


def test_profile(spark):
    df = recs(spark, ["Pump", "pump!", "Ring", "Pump"], buyer_id=["b", "b", "b", "c"], cpv_code=["30000000"] * 3 + [None]).withColumn("release_date", F.lit("2024-01-01").cast("date"))
    r = profile.natural_duplicates(df).first()
    assert (r.n_groups, r.n_notices, r.n_shared_titles) == (1, 2, 1)
    assert profile.profile(df).first().n_records_all == 4
    assert json.dumps(profile.excluded_share(df, ["30"], []).first().asDict())


def test_truth_by_key_is_that_by_pairs(spark):
    df = recs(spark, [f"pump valve {i % 3} steel" for i in range(12)], buyer_id=[str(i % 4) if i else None for i in range(12)])
    blocks = blocking.buyer_blocks(df)
    listed = blocking.block_pairs(blocks, 1 << 30).withColumn("label", F.lit(1))
    shared = blocking.shared_grams(df)
    for truth in (listed, blocking.SameBlock(blocks)):
        assert blocking.evaluate(shared, truth, 12).first() == blocking.evaluate(shared, listed, 12).first()
        assert got(blocking.sweep(shared, truth, 12, [1, 3])) == got(blocking.sweep(shared, listed, 12, [1, 3]))
    assert blocking.SameBlock(blocks.limit(0)).total().first().n_true == 0


def test_rolling_sums_cross_chunks(spark):
    rows = [(i, "k", 1_700_000_000 + s) for i, s in enumerate([0, 30, 59, 60, 3599, 3600, 3601, 3659, 3660, 7200])] + [(99, "k", None)]
    df = spark.createDataFrame(rows, "i long, k string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("v", F.lit(1.0))
    for chunk in (60, 100, 3600):
        out = {r.i: r.rolling for r in timing.rolling_sum(df, "v", "k", "ts", chunk_seconds=chunk).collect()}
        assert {i: n for i, n in out.items() if i != 99} == {i: float(sum(t is not None and s - 60 < t <= s for _, _, t in rows)) for i, _, s in rows if s is not None} and len(out) == len(rows)


def test_ranks_by_rows_cross_buckets(spark):
    rows = [(i, [0.5, 0.5001, 7.0, -3.0, 0.5, 1.0][i % 6], i % 2) for i in range(60)]
    out = sorted((r["rank"], r.score, r.tp, r.fp) for r in matching.running(spark.createDataFrame(rows, "i long, score double, label int"), "rows", "i").collect())
    tp = fp = 0
    for (k, score, a, b), (_, s, label) in zip(out, sorted(rows, key=lambda r: (-r[1], r[0])), strict=True):
        tp, fp = tp + label, fp + 1 - label
        assert (score, a, b) == (s, tp, fp) and k == tp + fp


def test_shortlist_without_labels(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<double>")
    out = embedding.shortlist(q, spark.createDataFrame([], "label_id string, vector array<double>"))
    assert out.count() == 0 and out.columns == ["query_id", "label_id", "score", "rank"]


def test_limits_follow_headers(tmp_path):
    told = {"x-ratelimit-limit-requests": "50", "x-ratelimit-limit-tokens": "900", "x-ratelimit-remaining-requests": "n/a"}
    c = adjudicate.Client("m", lambda _: (200, {"text": "a", "tokens_in": 1, "tokens_out": 1}, told), tmp_path, sleep=lambda _: None, clock=lambda: 0.0)
    before = c.limits
    c.complete(adjudicate.Request("1", "s", "p", max_tokens=5))
    assert (c.limits.rpd, c.limits.tpm) == (50, 900) and (c.limits.rpm, c.limits.tpd) == (before.rpm, before.tpd) and c.quota.requests_left is None


@pytest.mark.parametrize("stop", ["kill", "quota"])
def test_answers_survive_a_stop(spark, tmp_path, stop):
    """A run that ends in mid batch loses no answer, and the replay pays for none again."""
    asked = []
    requests = spark.createDataFrame([(f"k{i}", f"p{i}") for i in range(9)] + [("k3", "p3")], "key string, prompt string")

    def make(most):
        def ask(prompt):
            if len(asked) >= most:
                raise adjudicate.DailyQuota("no more today") if stop == "quota" else RuntimeError("killed")
            asked.append(prompt)
            return prompt.upper() + "\n\"ä\""

        return lambda: ask

    path = f"file://{tmp_path}/answers"
    if stop == "quota":
        done, why = adjudicate.answer(requests, path, make(5), batch_rows=4)
        assert why == "no more today" and {r.key for r in done.collect()} == {"k0", "k1", "k2", "k3", "k4"}
    else:
        with pytest.raises(RuntimeError, match="killed"):
            adjudicate.answer(requests, path, make(5), batch_rows=4)
        assert adjudicate.AnswerStore(spark, path).answers().count() == 5
    store = adjudicate.AnswerStore(spark, path)
    store.keep("k5", "p5", "found")  # as if the driver had died before the commit
    done, why = adjudicate.answer(requests, path, make(100), batch_rows=4)
    assert why is None and {r.key: r.answer for r in done.collect()} == {f"k{i}": "found" if i == 5 else f"P{i}\n\"ä\"" for i in range(9)}
    assert sorted(asked) == [f"p{i}" for i in range(9) if i != 5] and not store.loose.names()
    again, why = adjudicate.answer(requests.limit(3), path, lambda: pytest.fail("asked"), batch_rows=4)
    assert why is None and again.count() == 3
