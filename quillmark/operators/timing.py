"""Handling times: a log of timed items and its summary; gaps between events as their analogue."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from .ranks import percentiles

IDLE_SECONDS = 120.0
LEAST_TIMINGS = 30


class TooFewTimings(ValueError):
    """Fewer timings than a mean needs."""


@contextmanager
def time_item(item_id: str, sink: Callable[[dict], None], idle: float = IDLE_SECONDS, clock: Callable[[], float] = time.monotonic) -> Iterator[None]:
    """Times a block; the record is written even if the block raises."""
    began, stamp = clock(), datetime.now(timezone.utc).isoformat()
    try:
        yield
    finally:
        s = clock() - began
        sink({"item_id": item_id, "seconds": s, "started_at": stamp, "abandoned": s > idle})


def append(path: str | Path, record: dict) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps(record, sort_keys=True) + "\n")


def summary(timings: DataFrame) -> DataFrame:
    """One row over (seconds, abandoned): counts, mean, median and 90th percentile (interpolated) of what was kept. The
    percentiles are exact and found by rounds of counts (ranks.percentiles)."""
    own = F.when(~F.col("abandoned"), F.col("seconds"))
    median, p90 = percentiles(timings.select(own.alias("s")), "s", [0.5, 0.9])
    totals = timings.agg(F.count(own).alias("n"), F.count_if(F.col("abandoned")).alias("n_abandoned"), F.avg(own).alias("mean_seconds"), F.coalesce(F.sum(own), F.lit(0.0)).alias("total_seconds"))
    return totals.select("n", "n_abandoned", "mean_seconds", F.lit(median).cast("double").alias("median_seconds"), F.lit(p90).cast("double").alias("p90_seconds"), "total_seconds")


def checked_summary(timings: DataFrame, least: int = LEAST_TIMINGS) -> dict:
    r = summary(timings).first().asDict()
    if r["n"] < least:
        raise TooFewTimings(f"{r['n']} timings; {least} are needed")
    return r


def gaps(events: DataFrame, key: str, at: str, order: str, idle: float) -> DataFrame:
    """Seconds since the key's previous event; longer than idle is abandoned."""
    before = F.lag(at).over(Window.partitionBy(key).orderBy(at, order))
    s = (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(1e6)
    return events.withColumn("seconds", s).where("seconds is not null").withColumn("abandoned", F.col("seconds") > idle)


def _millis(events: DataFrame, at: str) -> Column:
    """Milliseconds since 1970. A timestamp without a zone is taken as it is written: by way of the session's zone, hours that clocks
    skip or repeat would change the distance of events."""
    t = F.col(at)
    if events.schema[at].dataType != TimestampNTZType():
        return F.unix_millis(t.cast("timestamp"))
    whole = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return whole * 1000 + F.floor(F.date_part(F.lit("SECOND"), t) * 1000).cast("long")


def rolling_sum(events: DataFrame, value: str, partition: str, at: str, seconds: int = 60, chunk_seconds: int = 3600) -> DataFrame:
    """events plus rolling: the sum over the last `seconds`; what is exactly that old has left the window. A key's events
    are dealt into chunks of time, each with the events just before it once more, so a key of many events fills no task."""
    ms, span, chunk = _millis(events, at), seconds * 1000, max(chunk_seconds, seconds) * 1000
    own = events.withColumn("_ms", ms).withColumn("_own", F.floor(F.col("_ms") / chunk))
    both = own.withColumn("_chunk", F.explode(F.when(F.col("_ms") > (F.col("_own") + 1) * chunk - span, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    w = Window.partitionBy(partition, "_chunk").orderBy("_ms").rangeBetween(-(span - 1), 0)
    return both.withColumn("rolling", F.sum(value).over(w)).where("_own = _chunk or _own is null").drop("_ms", "_own", "_chunk")
