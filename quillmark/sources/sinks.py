"""Writers: Parquet tables, reports as JSON, append-only logs."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", *partition: str) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def write_corpus(df: DataFrame, report: DataFrame, path: str) -> None:
    """The corpus, and its report beside it."""
    df.write.mode("overwrite").parquet(f"{path}/corpus.parquet")
    report.coalesce(1).write.mode("overwrite").json(f"{path}/report.json")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; where it is unset, in a temporary one if all runs on one
    machine."""
    shared = (spark.conf.get("spark.checkpoint.dir", "") or "").rstrip("/")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="quillmark-work-"))
            atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
        shared = "file://" + _LOCAL[0]
    return f"{shared}/work/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written to a table of its own and read back: lineage ends here, whoever reads it."""
    path = work_folder(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_cache(df: DataFrame, path: str, key: str = "key") -> None:
    """New rows of a keyed cache: what is there stays."""
    from .readers import exists

    spark = df.sparkSession
    fresh = df.dropDuplicates([key])
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)


def report_json(report: DataFrame) -> str:
    """A bounded report (one row per key) as JSON with sorted keys."""
    rows = [r.asDict() for r in report.collect()]
    return json.dumps(rows, sort_keys=True, default=lambda x: x.isoformat() if isinstance(x, (date, datetime)) else str(x))


def latex_table(report: DataFrame, caption: str, run_id: str, fmt: Callable[[object], str] = str) -> str:
    """A bounded report as a LaTeX table that names its run."""

    def cell(x: object) -> str:
        s = "--" if x is None else fmt(x)
        for c in "&%_":
            s = s.replace(c, "\\" + c)
        return s

    lines = [f"% run {run_id}", "\\begin{table}", f"\\caption{{{cell(caption)} (run {cell(run_id)})}}", "\\begin{tabular}{" + "l" * len(report.columns) + "}", " & ".join(map(cell, report.columns)) + " \\\\"]
    lines += [" & ".join(map(cell, r)) + " \\\\" for r in report.collect()]
    return "\n".join([*lines, "\\end{tabular}", "\\end{table}"])
