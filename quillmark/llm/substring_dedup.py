"""Removal of repeated passages: every window of WINDOW words that also starts in a document of a smaller id goes.

Windows carry Rabin-Karp hashes and are counted in Spark. Most windows of a corpus occur once, so a lossless filter comes
first: the least hash of the WINDOW - GRAM + 1 grams of GRAM words inside a window is its anchor, and equal windows have
equal anchors. Anchors that occur in one document only rule their windows out. The shared anchors travel as a bitmap
sized by their number; a bit set by two anchors lets more windows through and changes no result. Where they are too many
for a bitmap, they are joined with the stretches of windows that each document has under them, and the texts of those
documents are joined with their stretches. Each remaining window is one row (hash, document, position); those whose hash
has a smaller document are merged per document into maximal intervals, which cut the text.

Passes over the texts: anchors, windows, cutting. Shuffled: anchors (about a twentieth of the words), the windows under
shared anchors, the positions found, and the texts that have any (with stretches also those that have shared anchors). No
row is larger than a document.

Edge cases: a null or short text has no window; a null id never is the smaller one and its windows stay; rows of one id
don't remove each other's windows; repeated rows are cut alike; very long texts are hashed and cut whole; an empty table
gives an empty result. Only the id and text columns are read, so other columns never clash. The hash has 64 bits: two
different windows are taken for equal with a chance of 1 in 1.8e19 a pair."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bitmap
from . import textkernel as K
from .scratch import bounded, materialize

WINDOW = 50
GRAM = 8
#: Windows that a task holds to settle those it has twice (some 30 MB).
HELD_WINDOWS = 1_000_000


def window_anchors(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(first words of windows that lie inside one document, their anchors)."""
    n = len(words.hash)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, span = words.windows(gram), window - gram + 1
    reach = 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    lengths = np.diff(words.first)
    fits = np.maximum(lengths - window + 1, 0)
    total = int(fits.sum())
    starts = np.arange(total, dtype=np.int64) - np.repeat(np.cumsum(fits) - fits, fits) + np.repeat(words.first[:-1], fits)
    return starts, low[starts]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _runs(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, doc_id, text_hash, start, n): n windows from word `start` on that share an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text_hash").to_numpy()
            for at, words in K.chunks(batch.column("text")):
                starts, anchors = window_anchors(words, window, gram)
                if not len(starts):
                    continue
                doc = words.doc_of()[starts]
                change = np.ones(len(starts), bool)  # runs of windows share their anchor
                change[1:] = (anchors[1:] != anchors[:-1]) | (doc[1:] != doc[:-1])
                own, first = doc[change], np.flatnonzero(change)
                n = np.diff(first, append=len(starts)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(K.signed(anchors[change])), pa.array(ids[at + own], pa.int64()), pa.array(keys[at + own], pa.int64()), pa.array((starts[change] - words.first[own]).astype(np.int32)), pa.array(n)], names=["anchor", "doc_id", "text_hash", "start", "n"])

    return docs.where("doc_id is not null").mapInArrow(run, "anchor bigint, doc_id bigint, text_hash bigint, start int, n int")


def shared_anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Anchors that occur in two documents or more."""
    return _runs(docs, window, gram).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")


def _settled(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash to deal by, whether the window goes for sure). Where a task holds several windows of one hash, only those of
    its least document are still open; the others are dealt evenly, so a hot passage doesn't fill one task."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    head = np.ones(len(h), bool)
    head[1:] = h[1:] != h[:-1]
    least = d[np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))]
    sure = np.zeros(len(h), bool)
    sure[order] = d > least
    return np.where(sure, K.mix(hashes ^ K.mix(ids.view(np.uint64) * np.uint64(3) + starts.astype(np.uint64))), hashes), sure


def _with_stretches(docs: DataFrame, shared: DataFrame, window: int, gram: int) -> DataFrame:
    """The documents that have shared anchors, with the (start, n) of their windows under them."""
    own = _runs(docs, window, gram).join(shared, "anchor", "left_semi").select("doc_id", "text_hash", "start", "n").distinct()
    return docs.join(own.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("stretches")), ["doc_id", "text_hash"])


def repeated_starts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, start): word positions of windows that also start in a document of a smaller id."""
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    shared = materialize(shared_anchors(docs, window, gram), "anchors")
    table = bitmap.collect(shared, "anchor")
    if table is None:
        docs = _with_stretches(docs, shared, window, gram)
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            hashes, ids, keys, starts = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            dealt, sure = _settled(hashes, ids, starts)
            return pa.RecordBatch.from_arrays([pa.array(K.signed(dealt)), pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(starts), pa.array(sure)], names=["hash", "doc_id", "text_hash", "start", "sure"])

        for batch in batches:
            ids, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("text_hash").to_numpy()
            for at, words in K.chunks(batch.column("text")):
                if table is None:
                    parts = [np.arange(s["start"], s["start"] + s["n"]) + words.first[i] for i, own in enumerate(batch.column("stretches").slice(at, len(words.first) - 1).to_pylist()) for s in own]
                    starts = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                else:
                    starts, anchors = window_anchors(words, window, gram)
                    starts = starts[bitmap.contains(table, anchors)] if len(starts) else starts
                if not len(starts):
                    continue
                doc = words.doc_of()[starts]
                held.append((words.windows(window)[starts], ids[at + doc], keys[at + doc], (starts - words.first[doc]).astype(np.int32)))
                if sum(len(x[0]) for x in held) >= HELD_WINDOWS:
                    yield flush()
        if held:
            yield flush()

    rows = docs.where("doc_id is not null").mapInArrow(run, "hash bigint, doc_id bigint, text_hash bigint, start int, sure boolean")
    first = F.min("doc_id").over(Window.partitionBy("hash"))
    return rows.withColumn("least", first).where("sure or least < doc_id").select("doc_id", "text_hash", "start")


def intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words covered by windows that begin at starts (sorted)."""
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + window).tolist(), strict=True))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row for each row of docs."""
    slim = _keyed(docs, id_col, text_col)
    found = materialize(repeated_starts(slim, window, gram).distinct().groupBy("doc_id", "text_hash").agg(F.collect_list("start").alias("starts")), "passages")
    # A bitmap of the ids with passages to cut spares all other texts the shuffle.
    maybe, others = bitmap.split(slim, "doc_id", bitmap.collect(found, "doc_id"))
    cut = maybe.withColumn("text_hash", F.xxhash64("text")).join(found, ["doc_id", "text_hash"], "left").select("doc_id", "text", "starts")
    both = cut.unionByName(others.withColumn("starts", F.lit(None).cast("array<int>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                counts, gone, texts = [], [], []
                for text, starts in zip(part.column("text"), part.column("starts"), strict=True):
                    words = text.as_py().encode().split()
                    counts.append(len(words))
                    if starts.is_valid:
                        for a, b in reversed(intervals(np.sort(starts.values.to_numpy(zero_copy_only=False)), window)):
                            del words[a:b]
                    gone.append(counts[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


