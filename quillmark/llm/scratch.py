"""Tables written to the shared folder the cluster names, so that a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []
#: Bytes of texts that reach a Python worker at a time.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are bounded by bytes: rows are as long as documents, so a bound in rows alone
    says little about memory. A smaller setting stays."""
    conf = df.sparkSession.conf
    now = conf.get(_ARROW, "67108864").rstrip("bB")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        conf.set(_ARROW, str(ARROW_BYTES))
    return df


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one temporary folder for this process if all runs on one
    machine (as in tests), and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or ""
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="quillmark-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], ignore_errors=True)
    return "file://" + _LOCAL["dir"]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and later jobs reuse it."""
    path = f"{scratch_dir(df.sparkSession)}/quillmark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for held in _SCOPES:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quillmark/" in folder:
            delete(df.sparkSession, folder)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that materialize() writes within, once what is made of them has been written elsewhere."""
    held: list[str] = []
    _SCOPES.append(held)
    try:
        yield
    finally:
        _SCOPES.pop()
        for path in held:
            delete(spark, path)
