"""Dates, codes, intervals and vectors as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WILSON_Z = 1.959963984540054


def tolerant_date(text: Column) -> Column:
    """Date as written, in the source's own offset; compact dates too; null where there is none."""
    t = F.trim(text)
    long_form = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")
    return F.coalesce(long_form, F.when(t.rlike(r"^\d{8}(T.*)?$"), F.try_to_date(F.substring(t, 1, 8), "yyyyMMdd")))


def division(code: Column) -> Column:
    return F.substring(code, 1, 2)


def code_class(code: Column) -> Column:
    return F.substring(code, 1, 4)


def label_at(code: Column, level: str) -> Column:
    """Label of a code at 'division' or 'class'; a null code has the blank label."""
    if level not in ("division", "class"):
        raise ValueError(f"unknown level {level!r}")
    return F.substring(F.coalesce(code, F.lit("")), 1, 2 if level == "division" else 4)


def level_of(code: Column) -> Column:
    return F.when(code.endswith("000000"), 2).when(code.endswith("0000"), 4).otherwise(8)


def short_form(code: Column) -> Column:
    return F.substring(code, F.lit(1), level_of(code))


def choose_two(n: Column) -> Column:
    return F.floor(n.cast("long") * (n.cast("long") - 1) / 2).cast("long")


def notional_cost(tokens_in: Column, tokens_out: Column, rate_in: float = 0.15, rate_out: float = 0.60) -> Column:
    """US dollars at rates per million tokens."""
    return (tokens_in.cast("double") * F.lit(float(rate_in)) + tokens_out.cast("double") * F.lit(float(rate_out))) / F.lit(1e6)


def wilson(successes: Column, n: Column, z: float = WILSON_Z) -> tuple[Column, Column]:
    """Wilson score interval within [0, 1]; null for n <= 0."""
    s, n = successes.cast("double"), n.cast("double")
    p, z2 = s / n, F.lit(z * z)
    middle, half = (p + z2 / (2 * n)) / (1 + z2 / n), F.lit(z) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), middle - half)), F.when(ok, F.least(F.lit(1.0), middle + half))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Vector of length 1; a zero vector stays as it is."""
    by = lambda norm: F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(v)
    return F.transform(F.array(F.sqrt(dot(v, v))), by)[0]  # the length is computed once


def safe_rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def round_scaled(x: Column, places: int) -> Column:
    """A double rounded as SQL engines in C do: scaled, rounded half away from zero, scaled back. F.round goes by the decimal digits
    instead, and differs where scaling rounds: near halves, and from some 2**53 / 10**places on."""
    scaled = x * F.lit(float(10**places))
    size = F.abs(scaled)
    near = F.rint(size) + F.when(size - F.rint(size) == 0.5, F.lit(1.0)).otherwise(F.lit(0.0))  # rint takes halves to the even side
    out = F.signum(scaled) * near / F.lit(float(10**places))
    return F.when(F.isnan(scaled) | (size == float("inf")), x).otherwise(out)
