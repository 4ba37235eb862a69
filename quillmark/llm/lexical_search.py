"""Ranked lexical search: an inverted index in segments, and the best documents of each query by exact integer scores.

A segment is the inverted form of about SEGMENT_BYTES of text that a task reads anyway, so indexing shuffles nothing: its
documents are numbered in order of doc_id, and a term's postings are (gap to the document before, occurrences) as
variable-length bytes. Every row is indexed; the index is a Parquet table of one row a term and segment.

A search needs the counts of the whole corpus (documents, terms, and documents of each query term), which are sums over index
rows. Then the postings of the query terms alone meet in their segments, where each query is answered document at a time:
cursors over the postings are merged by a heap of next documents, a bounded heap keeps the best by score, then doc_id, and
terms whose bounds together can't reach the worst of a full heap leave the merge and are only looked up (the result stays
exact, ties included). The best of all segments are merged by one ranking, whose input is at most k rows a query and segment
and which Spark cuts to k before it shuffles.

Queries travel as broadcast blocks of at most about BLOCK_CHARS characters, any number of them; postings meet each block that
asks for them. Memory is bounded by a segment (or one document, if that is longer).

Edge cases: a null text has no term and is in no result; a null doc_id ranks before others of its score; repeated rows are
documents of their own, and so can fill two ranks; a query without known terms has no row; repeated terms of a query count
as often as they stand; rows of one item_id are one query; empty tables give an empty result; very long texts are one document of one segment. Only id and text
columns are read, so other columns never clash. Terms are told apart by 64-bit hashes inside a segment."""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import bounded, materialize

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SEGMENT_BYTES = 8 << 20
BLOCK_CHARS = 1 << 20
TOP = 20
#: Bytes of texts with separators as spaces and A-Z lower-cased.
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(128) if not chr(i).isalnum()]] = 32
_PLAIN[65:91] += 32
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.translate(_LOWER))


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of non-negative numbers, seven bits a byte, the lowest first."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        there = size > k
        out[at[there] + k] = (values[there] >> np.uint64(7 * k)) & np.uint64(127) | ((size[there] > k + 1).astype(np.uint64) << np.uint64(7))
    return out, size


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    first = np.flatnonzero(np.r_[True, raw[:-1] < 128]) if len(raw) else np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(first, append=len(raw)))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first) if len(raw) else np.zeros(0, np.int64)


INDEX = "segment bigint, term string, n bigint, total bigint, postings binary, doc_ids array<bigint>, lengths array<bigint>"


class _Segment:
    """Documents on their way into one segment."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.parts, self.bytes = [], [], [], 0

    def add(self, ids: list, words: K.Words) -> None:
        order = np.argsort(words.hash, kind="stable")  # stable: documents of a term stay in order
        h, d = words.hash[order], words.doc_of()[order]
        head = np.ones(len(h), bool)
        head[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(head)
        tf = np.diff(at, append=len(h))
        self.parts.append((h[at], d[at] + len(self.ids), tf, words.starts[order[at]], words.ends[order[at]], words.data))
        self.ids += ids
        self.lengths += np.diff(words.first).tolist()
        self.bytes += len(words.data)

    def batches(self, number: int) -> Iterator[pa.RecordBatch]:
        """The rows of the segment: its documents, then its terms."""
        schema = pa.schema([("segment", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("total", pa.int64()), ("postings", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is not None, self.ids[i] or 0))
        lengths = [self.lengths[i] for i in order]
        yield pa.RecordBatch.from_pylist([{"segment": number, "n": sum(x > 0 for x in lengths), "total": sum(lengths), "doc_ids": [self.ids[i] for i in order], "lengths": lengths}], schema)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        h, d, tf = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        d, part = rank[d], np.repeat(np.arange(len(self.parts)), [len(p[0]) for p in self.parts])
        place = np.concatenate([np.arange(len(p[0])) for p in self.parts])
        if not len(h):
            return
        by = np.lexsort((d, h))
        h, d, tf, part, place = h[by], d[by], tf[by], part[by], place[by]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        gap = np.diff(d, prepend=0)
        gap[first] = d[first]
        both = np.empty(2 * len(h), np.int64)
        both[::2], both[1::2] = gap, tf
        data, size = packed(both)
        ends = np.cumsum(size)[1::2]
        df = np.diff(first, append=len(h))
        offsets = np.r_[0, ends[first + df - 1]].astype(np.int64)
        for a in range(0, len(first), 20_000):
            z = min(a + 20_000, len(first))
            words = []
            for p, i in zip(part[first[a:z]].tolist(), place[first[a:z]].tolist(), strict=True):
                own = self.parts[p]
                words.append(own[5][own[3][i] : own[4][i]].tobytes().decode())
            body = data[offsets[a] : offsets[z]].tobytes()
            postings = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((offsets[a : z + 1] - offsets[a]).astype(np.int32).tobytes()), pa.py_buffer(body)])
            total = np.add.reduceat(tf, first)[a:z]
            none = lambda kind: pa.nulls(z - a, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(z - a, number)), pa.array(words, pa.string()), pa.array(df[a:z]), pa.array(total), postings, none(pa.list_(pa.int64())), none(pa.list_(pa.int64()))], schema=schema)


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The written index of docs: for each segment a row of its documents (term is null) and one of each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, now = TaskContext.get().partitionId() << 32, _Segment()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            data, offsets = K.buffers(batch.column("text"))
            for a, z in K.slices(offsets):
                now.add(ids[a:z], K.Words(_PLAIN[data[offsets[a] : offsets[z]]], offsets[a : z + 1] - offsets[a]))
                if now.bytes >= segment_bytes:
                    yield from now.batches(number)
                    number, now = number + 1, _Segment()
        if now.ids:
            yield from now.batches(number)

    slim = bounded(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return materialize(slim.mapInArrow(run, INDEX), "postings")


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, item_id, term, times) of queries."""
    slim = queries.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    n = -(-(slim.agg(F.sum(F.length("text"))).first()[0] or 1) // BLOCK_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(b, i, t, c) for b, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for t, c in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("block", "item_id", "term", "times"), r, strict=True)) for r in rows], pa.schema([("block", pa.int32()), ("item_id", pa.int64()), ("term", pa.string()), ("times", pa.int64())]))

    own = slim.select(F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("block"), "item_id", "text")
    return materialize(own.mapInArrow(run, "block int, item_id bigint, term string, times bigint"), "query-terms")


def best(cursors: list[tuple[int, list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) over cursors (highest score, documents in order, scores), documents in order of rank
    among equal scores. Only scores above 0 count."""
    cursors = sorted((c for c in cursors if c[0] > 0), key=lambda c: c[0])
    docs, scores = [c[1] for c in cursors], [c[2] for c in cursors]
    bounds, total = [], 0
    for c in cursors:
        total += c[0]
        bounds.append(total)  # of this cursor and all weaker ones
    at, first, floor = [0] * len(cursors), 0, 0
    heap: list[tuple[int, int]] = []
    merge = [(d[0], i) for i, d in enumerate(docs)]
    heapq.heapify(merge)
    while merge:
        doc, score = merge[0][0], 0
        while merge and merge[0][0] == doc:
            i = merge[0][1]
            score += scores[i][at[i]]
            at[i] += 1
            if at[i] < len(docs[i]):
                heapq.heapreplace(merge, (docs[i][at[i]], i))
            else:
                heapq.heappop(merge)
        for j in range(first - 1, -1, -1):
            if score + bounds[j] <= floor:
                break
            at[j] = p = bisect_left(docs[j], doc, at[j])
            if p < len(docs[j]) and docs[j][p] == doc:
                score += scores[j][p]
        if score <= floor:  # a later document of an equal score ranks lower
            continue
        if len(heap) < k:
            heapq.heappush(heap, (score, -doc))
        else:
            heapq.heapreplace(heap, (score, -doc))
        if len(heap) == k and heap[0][0] > floor:
            floor = heap[0][0]
            weak = first
            while weak < len(bounds) and bounds[weak] <= floor:
                weak += 1
            if weak > first:
                first = weak
                merge = [m for m in merge if m[1] >= first]
                heapq.heapify(merge)
    return sorted(((s, -d) for s, d in heap), key=lambda x: (-x[0], x[1]))


def norms(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 75 + (25 n N) div L, in whole numbers of any size."""
    if len(lengths) and int(lengths.max()) * 25 * n_docs < 1 << 63:
        return 75 + (25 * lengths * n_docs) // n_terms
    return np.array([75 + 25 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)


RESULT = "item_id bigint, doc_id bigint, score bigint"


def search(written: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each query in a written index."""
    spark = written.sparkSession
    segments, postings = written.where("term is null"), written.where("term is not null")
    n_docs, n_terms = segments.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = query_terms(queries, id_col, text_col)
    terms = asked.select("block", "term").distinct()
    n_blocks = (asked.agg(F.max("block")).first()[0] or 0) + 1
    sent = {}
    for b in range(n_blocks):
        own: dict[int | None, list[tuple[str, int]]] = {}
        for r in asked.where(F.col("block") == b).select("item_id", "term", "times").toLocalIterator():
            own.setdefault(r[0], []).append((r[1], r[2]))
        sent[b] = spark.sparkContext.broadcast(own)
    df = postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.ln((2 * F.lit(n_docs) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    weighted = materialize(terms.join(df.select("term", weight.alias("weight")), "term"), "query-weights")
    wanted = postings.select("segment", "term", "postings").join(weighted, "term").select("segment", "block", "term", "weight", "postings", *(F.lit(None).cast("array<bigint>").alias(c) for c in ("doc_ids", "lengths")))
    own = segments.select("segment", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "term", F.lit(None).cast("bigint").alias("weight"), "postings", "doc_ids", "lengths")
    rows = wanted.unionByName(own).repartition("segment", "block").sortWithinPartitions("segment", "block", F.asc_nulls_first("term"))

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        stream = (r for b in batches for at in range(0, len(b), 256) for r in b.slice(at, 256).to_pylist())
        for (_, block), group in groupby(stream, lambda r: (r["segment"], r["block"])):
            ids, lists, m = [], {}, None
            for row in group:
                if row["term"] is None:
                    ids, m = row["doc_ids"], norms(np.array(row["lengths"], np.int64), n_docs, max(n_terms, 1))
                else:
                    both = unpacked(row["postings"])
                    docs, tf = np.cumsum(both[::2]), both[1::2]
                    lists[row["term"]] = (docs.tolist(), row["weight"] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[docs])))
            held: dict[tuple[str, int], tuple[int, list[int], list[int]]] = {}
            for item, own in sent[block].value.items():
                cursors = []
                for term, times in own:
                    if term in lists and (term, times) not in held:
                        docs, scores = lists[term]
                        held[term, times] = (int(scores.max()) * times, docs, (scores * times).tolist())
                    if term in lists:
                        cursors.append(held[term, times])
                yield from ({"item_id": item, "doc_id": ids[d], "score": s} for s, d in best(cursors, k))

    schema = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for row in answers(batches):
            out.append(row)
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    found = rows.mapInArrow(run, RESULT)
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    return search(index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
