"""TF-IDF join inside groups: pairs of different texts of a group whose cosine reaches a threshold.

Pairs that may qualify are many times those that do, and every one of them would have a row for each term. They never become
rows here:

1. The different texts of a group are numbered in distributed ranks and cut into chunks of at most CHUNK.
2. Terms are counted per chunk, then per group. A chunk gets the idf of its own terms only.
3. Chunks of a group meet pair by pair. A task weighs the texts of two chunks and multiplies the two matrices, BLOCK terms at a
   time, so its products are of bounded size whatever the group's, and only the pairs that reach the threshold leave it.

A chunk is shuffled once for every other chunk of its group; with itself it meets where it is read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import grams_of, padded_grams
from ..sources.sinks import settled
from .ranks import ranked

CHUNK = 512
BLOCK = 4096


def chunks(texts: DataFrame, group: str, low: int, high: int, size: int = CHUNK) -> DataFrame:
    """The written index of texts (group, record_id, text, copies), all different in a group: (group, chunk, of,
    record_id, text, copies, term, idf), lists from record_id on, per chunk; `of` is the group's number of chunks. The idf is over all rows, copies included."""
    cut = ranked(texts.where("text <> ''"), [group], ["record_id"]).withColumn("chunk", F.expr(f"rank div {size}"))
    cut = settled(cut.withColumn("of", F.expr(f"(size - 1) div {size} + 1")).select(group, "chunk", "of", "record_id", "text", "copies"))
    n = texts.groupBy(group).agg(F.sum("copies").alias("n"))
    held = cut.select(group, "chunk", "copies", F.explode(F.array_distinct(padded_grams(F.col("text"), low, high))).alias("term")).groupBy(group, "chunk", "term").agg(F.sum("copies").alias("df"))
    held = settled(held)
    idf = held.groupBy(group, "term").agg(F.sum("df").alias("df")).join(n.hint("merge"), group).select(group, "term", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    each = lambda f: F.transform("m", lambda x: x[f]).alias(f)
    terms = held.join(idf.hint("merge"), [group, "term"]).groupBy(group, "chunk").agg(F.collect_list(F.struct("term", "idf")).alias("m")).select(group, "chunk", each("term"), each("idf"))
    rows = cut.groupBy(group, "chunk", "of").agg(F.collect_list(F.struct("record_id", "text", "copies")).alias("m")).select(group, "chunk", "of", *map(each, ("record_id", "text", "copies")))
    return settled(rows.join(terms.hint("merge"), [group, "chunk"]))


def _weights(texts: list[str], terms: list[str], idf: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, terms, weights) of the texts' vectors, each of length 1; texts and terms by number."""
    number = {t: i for i, t in enumerate(terms)}
    own = [[number[g] for g in grams_of(t, low, high)] for t in texts]
    flat = np.fromiter((x for row in own for x in row), np.int64)
    key, tf = np.unique(np.repeat(np.arange(len(own)), [len(row) for row in own]) * len(terms) + flat, return_counts=True)
    row, term = key // len(terms), key % len(terms)
    w = tf * idf[term]
    return row, term, w / np.sqrt(np.bincount(row, w * w, len(own)))[row]


def _cosines(a: tuple, b: tuple, n_a: int, n_b: int, number: np.ndarray, n_terms: int) -> np.ndarray:
    """All products of the vectors a and b; number has b's number of each term of a (-1: none)."""
    out = np.zeros((n_a, n_b))
    row_a, term_a, w_a = a[0], number[a[1]], a[2]
    order_a, order_b = np.argsort(term_a, kind="stable"), np.argsort(b[1], kind="stable")
    sorted_a, sorted_b = term_a[order_a], b[1][order_b]
    for first in range(0, n_terms, BLOCK):
        last = min(first + BLOCK, n_terms)
        sides = []
        for n, row, term, w, order, by in ((n_a, row_a, term_a, w_a, order_a, sorted_a), (n_b, *b, order_b, sorted_b)):
            at = order[np.searchsorted(by, first) : np.searchsorted(by, last)]
            m = np.zeros((n, last - first))
            m[row[at], term[at] - first] = w[at]
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def similar_texts(texts: DataFrame, group: str, least: float, low: int = 2, high: int = 4, size: int = CHUNK) -> DataFrame:
    """(group, x, y, similarity) of texts (group, record_id, text, copies), all different in a group: the pairs whose cosine by the
    group's idf is `least` (over 0) or more, either way round, and each text of several copies with itself."""
    if least <= 0:
        raise ValueError(f"least must be over 0, got {least}")
    index = chunks(texts, group, low, high, size)
    side = lambda s: index.select(group, F.col("chunk").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("record_id", "text", "copies", "term", "idf"))).hint("merge")
    met = index.where("chunk < of - 1").select(group, F.col("chunk").alias("a"), F.explode(F.sequence(F.col("chunk") + 1, F.col("of") - 1)).alias("b"))
    two = met.join(side("a"), [group, "a"]).join(side("b"), [group, "b"])
    kind = dict(texts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alone = "b" not in batch.schema.names
            for i in range(len(batch)):
                at = lambda c, i=i: batch.column(batch.schema.get_field_index(c))[i]
                weighed = lambda s, at=at: _weights(at(f"text_{s}").as_py(), at(f"term_{s}").as_py(), at(f"idf_{s}").values.to_numpy(), low, high)
                a, other = weighed("a"), "a" if alone else "b"
                b = a if alone else weighed("b")
                ids_a, ids_b, terms = at("record_id_a").values, at(f"record_id_{other}").values, at(f"term_{other}").values
                number = pc.fill_null(pc.index_in(at("term_a").values, value_set=terms), -1).to_numpy()
                s = _cosines(a, b, len(ids_a), len(ids_b), number, len(terms))
                if alone:
                    s[np.tril_indices(len(s), -1)] = 0.0
                    s[np.diag_indices(len(s))] *= at("copies_a").values.to_numpy() > 1
                x, y = np.nonzero(s >= least)
                for k in range(0, len(x), 100_000):
                    p, q = x[k : k + 100_000], y[k : k + 100_000]
                    own = batch.column(batch.schema.get_field_index(group)).take(pa.array(np.full(len(p), i)))
                    yield pa.RecordBatch.from_arrays([own, ids_a.take(pa.array(p)), ids_b.take(pa.array(q)), pa.array(s[p, q])], names=[group, "x", "y", "similarity"])

    schema = f"`{group}` {kind[group]}, x {kind['record_id']}, y {kind['record_id']}, similarity double"
    return side("a").mapInArrow(run, schema).unionByName(two.mapInArrow(run, schema))
