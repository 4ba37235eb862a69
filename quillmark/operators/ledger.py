"""The ledger of model calls: spend, quota use, cost per run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_rate

LEDGER_SCHEMA = (
    "ts string, run_id string, condition string, prompt_sha256 string, provider string, model string, input_tokens int, output_tokens int, latency_ms int, usd double, usd_uncached double, "
    "rate_usd_per_m_input double, rate_usd_per_m_output double, cache_hit boolean, rate_card_checked string"
)


def usage(ledger: DataFrame, day: str) -> DataFrame:
    """One row: spend to date, and tokens and requests of one UTC day that no cache answered."""
    today = F.startswith(F.col("ts"), F.lit(day)) & ~F.col("cache_hit")
    return ledger.agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("spend_usd"), F.coalesce(F.sum(F.when(today, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).cast("long").alias("tokens_today"), F.count_if(today).alias("requests_today"))


def cost_by_run(ledger: DataFrame, skip_condition: str = "pilot") -> DataFrame:
    """Per run: calls, latency per record, tokens and notional cost per 1000 records; pilots are left out."""
    g = ledger.where(F.coalesce(F.col("condition"), F.lit("")) != skip_condition).groupBy("run_id").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("ms_per_record"), F.sum("input_tokens").alias("tin"), F.sum("output_tokens").alias("tout"), F.sum("usd_uncached").alias("cost"), F.count_if("cache_hit").alias("hits"))
    return g.select("run_id", "n", "ms_per_record", ((F.col("tin") + F.col("tout")) * 1000 / F.col("n")).alias("tokens_per_1000"), (F.col("cost") * 1000 / F.col("n")).alias("usd_per_1000"), safe_rate(F.col("hits"), F.col("n")).alias("hit_rate"))


def adjudications_per_day(ledger: DataFrame) -> DataFrame:
    return ledger.where("not cache_hit").groupBy(F.substring("ts", 1, 10).alias("day")).agg(F.count("*").alias("n"))
