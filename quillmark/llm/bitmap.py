"""A bitmap that tells workers which values can be skipped.

Its size follows the number of values, BITS_EACH bits or more for each while that stays within MAX_BITS (32 MB), so it can
be broadcast at any scale; more values than have LEAST_BITS_EACH bits there get no bitmap (None), and the caller joins. Values that share a bit
only let more rows through: whoever uses it must not rely on a set bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bounded

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
BITS_EACH, LEAST_BITS_EACH = 32, 8


def collect(values: DataFrame, column: str) -> np.ndarray | None:
    """The bitmap of a column of longs (a written table: it is read twice). Bits are joined in Spark; at most MAX_BITS / 64
    rows come to the driver."""
    n = values.count()
    if max(MIN_BITS, n * LEAST_BITS_EACH) > MAX_BITS:
        return None
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (n * BITS_EACH).bit_length()))
    words = values.select(F.pmod(column, F.lit(bits)).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    table = words.toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out


def contains(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value (as 64 bits) is set."""
    bit = values.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return ((table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)


def split(docs: DataFrame, id_col: str, table: np.ndarray | None) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in the bitmap, all others): only the former need an exact join, and so a shuffle. Null ids are
    among the others; without a bitmap all rows are among the former."""
    if table is None:
        return docs, docs.where(F.lit(False))
    sent = bounded(docs).sparkSession.sparkContext.broadcast(table)

    def rows(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
                hit = contains(sent.value, ids.fill_null(0).to_numpy(zero_copy_only=False)) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit if inside else ~hit))

        return docs.mapInArrow(run, docs.schema)

    return rows(True), rows(False)
