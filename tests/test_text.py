import hashlib

import pytest
from pyspark.sql import functions as F

from quillmark.functions import scalars as S
from quillmark.functions import text as X


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (None, ""),
        ("", ""),
        ("  Pump/Valve  ", "pump valve"),
        ("buyer's O’Neil", "buyers oneil"),
        ("Straße 100% 20°C", "strasse 100 20°c"),
        ("a\x07b\tc", "ab c"),
        ("donâ€™t", "dont"),
        ("ﬁlter Ｆｕｌｌ", "filter full"),
    ],
)
def test_normal_form(spark, raw, want):
    assert one(spark, raw, X.normalise) == want
    assert X.normalise_str(raw) == want
    assert X.normalise_str(X.normalise_str(raw)) == want


def test_builtin_form_agrees_where_it_may(spark):
    texts = ["Ärger, Straße; 5 µm", "plain TEXT!", "é è ê", "x - y", "Château à Âge", "fin â", "cafÃ©", "Ã© â", "âge\n", "ÃÂ"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", X.normalise_plain(F.col("x")).alias("y"), X.needs_exact(F.col("x")).alias("n"))
    for r in df.collect():
        if not r.n:
            assert r.y == X.normalise_str(r.x)


def test_grams_and_keys(spark):
    assert one(spark, "microscope zeiss a4", X.gram_key) == "a4|cop|cro|eis"
    assert one(spark, "", X.gram_key) is None
    assert set(one(spark, "ab abcd", X.token_grams)) == {"ab", "abc", "bcd"}
    assert one(spark, "supply of 12 pumps", X.leading_token) == "pumps"
    assert one(spark, "the of 12", X.leading_token) is None


def test_padded_grams_count_short_tokens_once(spark):
    assert sorted(one(spark, "a", X.padded_grams)) == sorted([" a", "a ", " a "])
    assert sorted(one(spark, "a4", X.padded_grams)) == sorted([" a", "a4", "4 ", " a4", "a4 ", " a4 "])


def test_references(spark):
    assert one(spark, "Lot UKRI-3547 and AB12345", X.title_refs) == ["AB12345", "UKRI3547"]
    assert one(spark, None, X.title_refs) == []
    assert one(spark, "IT-368-17809-IBC/17809 - AWARD", X.procurement_ref) == one(spark, "IT-368-17809-IBC/17809", X.procurement_ref)
    assert one(spark, None, X.procurement_ref) == ""


def test_keys_are_those_of_python(spark):
    assert one(spark, "text", lambda c: X.vector_key("m", c)) == hashlib.sha256(b"m\0text").hexdigest()


def test_dates_and_codes(spark):
    assert str(one(spark, "2024-06-20T00:30:00+01:00", S.tolerant_date)) == "2024-06-20"
    assert str(one(spark, "20250304", S.tolerant_date)) == "2025-03-04"
    assert one(spark, "2024-13-01", S.tolerant_date) is None
    assert [one(spark, c, S.level_of) for c in ("30000000", "30120000", "30121100")] == [2, 4, 8]
    assert one(spark, None, lambda c: S.label_at(c, "class")) == ""
    with pytest.raises(ValueError):
        S.label_at(F.lit("x"), "leaf")


def test_wilson(spark):
    low, high = S.wilson(F.lit(17), F.lit(50))
    r = spark.range(1).select(low.alias("a"), high.alias("b")).first()
    assert (r.a, r.b) == pytest.approx((0.2243, 0.4785), abs=1e-4)
    low, _ = S.wilson(F.lit(0), F.lit(0))
    assert spark.range(1).select(low.alias("a")).first().a is None


def test_sql_functions(spark):
    X.register(spark)
    assert spark.sql("select normalise_text('A/B'), normalise_key('Ä B-1')").first()[:] == ("a b", "b1")
