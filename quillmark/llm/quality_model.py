"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded: its words and pairs of neighbouring words,
hashed into CELLS cells with a learnt vector each, and measures of its characters and words go through one dense layer.
Gated attention gives each passage a weight, learnt from the labels of documents alone, and the weighted sum of the
encodings is scored by a logistic unit. Features come from the whole text of the row and from nothing else: labels,
language, source, id and other rows are no inputs, and every document is scored by arithmetic of its own, so a score has
the same bits alone, first, last or in any batch.

Training takes a bounded sample: at most TRAIN_ROWS labelled documents (one row of each id), those of the least hash of
their id among the rows whose crc32(id) mod 3 is not HELD_OUT, as many as make at most TRAIN_PASSAGES passages; documents
of over TRAIN_BAG passages are scored but not learnt from. So the driver gets some 20 MB at most. Scoring covers every
row in one Arrow pass without a shuffle. All seeds are fixed.

Edge cases: null and empty texts are a bag of one empty passage and get a score; very long texts are encoded whole, in
slices of passages; without labels, or with one kind only, every score is the smoothed share of label 1; several labels of
one document count as the lowest; documents of equal text tie with equal scores, and a score of 0.5 predicts 1; repeated
rows are scored each for itself; an empty table gives an empty result. Only the id and text columns are read, so other
columns, whatever their names, have no effect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .scratch import bounded, materialize

PASSAGE = 64
TRAIN_ROWS, TRAIN_PASSAGES, TRAIN_BAG = 8192, 32_768, 512
HELD_OUT = 1
#: Cells of hashed words, and as many of pairs.
CELL_BITS = 10
CELLS = 2 << CELL_BITS
HIDDEN, GATES, STEPS, BATCH, RATE, DECAY = 24, 12, 400, 128, 0.01, 1e-3
#: Passages whose cells are counted at a time.
SLICE = 1024
_U = np.uint64

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbol": b"#*$%&|<>@^~_=+{}[]\\/", "digit": b"0123456789", "stop": b".,;:?", "shout": b"!", "line": b"\n"}
_CLASS = np.zeros((len(_CLASSES), 256), np.int32)
for _k, _v in enumerate(_CLASSES.values()):
    _CLASS[_k, list(_v)] = 1
FEATURES = len(_CLASSES) + 9


def pairs_of(words: K.Words) -> np.ndarray:
    """Hash of each word with the next one; the last word of the chunk has none."""
    return K.mix(words.hash[:-1] + K.mix(words.hash[1:]))


def measures(words: K.Words, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(measures of each passage, number of passages of each document), from sums of whole numbers inside documents."""
    n_docs = len(words.first) - 1
    lengths = np.diff(words.first)
    bags = np.maximum(1, -(-lengths // PASSAGE))
    doc = np.repeat(np.arange(n_docs), bags)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(bags) - bags, bags)
    a = words.first[doc] + nth * PASSAGE
    b = np.minimum(a + PASSAGE, words.first[doc + 1])
    out = np.zeros((len(doc), FEATURES), np.float32)
    full = b > a
    if not full.any():
        out[:, -1] = 1
        return out, bags
    lo, hi = words.starts[a[full]], words.ends[b[full] - 1]
    count = (b - a)[full]
    chars = np.maximum(1, hi - lo)
    sums = np.zeros(len(words.data) + 1, np.int32)
    for k in range(len(_CLASSES)):
        np.cumsum(_CLASS[k][words.data], out=sums[1:])
        out[full, k] = (sums[hi] - sums[lo]) / chars * 10
    size = (words.ends - words.starts).astype(np.float64)
    h = words.hash
    doc_of = words.doc_of()

    def share(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[b[full]] - total[a[full]]) / count

    def again(back: int) -> np.ndarray:
        flag = np.zeros(len(h))
        if len(h) > back:
            flag[back:] = (h[back:] == h[:-back]) & (doc_of[back:] == doc_of[:-back])
        return flag

    # Pairs of words that the document has had before; the last word of a document begins none.
    own = np.flatnonzero(doc_of[1:] == doc_of[:-1])
    order = own[np.lexsort((own, pairs[own], doc_of[own]))]
    twice = np.zeros(len(h))
    twice[order[1:]] = (pairs[order[1:]] == pairs[order[:-1]]) & (doc_of[order[1:]] == doc_of[order[:-1]])
    which = np.repeat(np.arange(int(full.sum())), count)
    order = np.lexsort((h, which))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (which[order][1:] != which[order][:-1])
    distinct = np.bincount(which, weights=fresh, minlength=int(full.sum())) / count
    mean = share(size)
    spread = np.sqrt(np.maximum(0, share(size**2) - mean**2))
    k = len(_CLASSES)
    out[full, k] = mean / 5
    out[full, k + 1] = spread / 5
    out[full, k + 2] = share(again(1)) * 3
    out[full, k + 3] = share(again(2)) * 3
    out[full, k + 4] = share(twice) * 3
    out[full, k + 5] = distinct * 3
    out[full, k + 6] = share(size <= 3) * 2
    out[full, k + 7] = np.log1p(np.repeat(lengths, bags)[full]) / 5
    out[~full, -1] = 1
    return out, bags


def cells_of(words: K.Words, pairs: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, passage) of every word and pair among the words a to b of one document; a begins a passage."""
    at = np.arange(b - a)
    shift = _U(64 - CELL_BITS)
    inner = np.flatnonzero(at[:-1] % PASSAGE != PASSAGE - 1) if b - a > 1 else at[:0]
    cell = np.concatenate([words.hash[a:b] >> shift, (pairs[a + inner] >> shift) + _U(1 << CELL_BITS)])
    return cell.astype(np.uint16), np.concatenate([at, inner]) // PASSAGE


def counted(cell: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Counts of cells in n passages, over the root of the words and pairs in the passage."""
    table = np.bincount(passage * CELLS + cell, minlength=n * CELLS).reshape(n, CELLS)
    return table / np.sqrt(np.maximum(1, table.sum(1, keepdims=True)))


class Model:
    """Encoder, gated attention and logistic unit over bags of passages."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        g = lambda *s: r.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": g(FEATURES, HIDDEN), "E": g(CELLS, HIDDEN), "b": np.zeros(HIDDEN), "V": g(HIDDEN, GATES), "U": g(HIDDEN, GATES), "w": g(GATES, 1)[:, 0], "c": g(HIDDEN, 1)[:, 0], "d": np.zeros(1)}
        self.center, self.scale, self.prior = np.zeros(FEATURES), np.ones(FEATURES), None

    def encode(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.center) / self.scale @ self.p["W"] + c @ self.p["E"] + self.p["b"])

    def attend(self, h: np.ndarray, bags: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(bags) - bags
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        a = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(a[:, None] * h, first)
        y = 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))
        return {"t": t, "s": s, "a": a, "z": z, "y": y, "first": first}

    def gradients(self, x: np.ndarray, c: np.ndarray, bags: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """(weighted cross-entropy, its gradients)."""
        p = self.p
        h = self.encode(x, c)
        f = self.attend(h, bags)
        dy = (f["y"] - labels) * weight
        rep = np.repeat(dy[:, None] * p["c"], bags, axis=0)
        da = (rep * h).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), bags))
        du = de[:, None] * p["w"]
        dt, ds = du * f["s"] * (1 - f["t"] ** 2), du * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * rep + dt @ p["V"].T + ds @ p["U"].T) * (1 - h**2)
        y = np.clip(f["y"], 1e-12, 1 - 1e-12)
        loss = -float(np.sum(weight * (labels * np.log(y) + (1 - labels) * np.log(1 - y))))
        return loss, {"W": ((x - self.center) / self.scale).T @ dh, "E": c.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": (f["t"] * f["s"]).T @ de, "c": f["z"].T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, x: list[np.ndarray], cells: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS) -> Model:
        """Learns from documents: their measures, their (cell, passage) pairs and labels."""
        n, ones = len(labels), int(labels.sum())
        if n == 0 or ones in (0, n):
            self.prior = (ones + 1) / (n + 2)
            return self
        every = np.concatenate(x)
        self.center, self.scale = every.mean(0), np.maximum(every.std(0), 1e-3)
        weight = np.where(labels == 1, n / 2 / ones, n / 2 / (n - ones))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        r, order = np.random.default_rng(11), np.zeros(0, np.int64)
        for step in range(1, steps + 1):
            if len(order) < min(BATCH, n):
                order = np.concatenate([order, r.permutation(n)])
            now, order = order[:BATCH], order[BATCH:]
            bags = np.array([len(x[i]) for i in now])
            begin = np.cumsum(bags) - bags
            c = counted(np.concatenate([cells[i][0] for i in now]), np.concatenate([cells[i][1] + o for i, o in zip(now, begin, strict=True)]), int(bags.sum()))
            _, grad = self.gradients(np.concatenate([x[i] for i in now]), c, bags, labels[now], weight[now] / len(now))
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                self.p[k] = self.p[k] * (1 - RATE * DECAY) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score_words(self, words: K.Words) -> np.ndarray:
        """Scores of the documents of a chunk, each by itself."""
        n_docs = len(words.first) - 1
        if self.prior is not None:
            return np.full(n_docs, self.prior)
        pairs = pairs_of(words)
        x, bags = measures(words, pairs)
        ends = np.cumsum(bags)
        out = np.zeros(n_docs)
        for i in range(n_docs):
            mine, a, b = x[ends[i] - bags[i] : ends[i]], int(words.first[i]), int(words.first[i + 1])
            h = []
            for at in range(0, len(mine), SLICE):
                part = mine[at : at + SLICE].copy()
                h.append(self.encode(part, counted(*cells_of(words, pairs, a + at * PASSAGE, min(b, a + (at + SLICE) * PASSAGE)), len(part))))
            out[i] = self.attend(np.concatenate(h), bags[i : i + 1])["y"][0]
        return out


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS, passages: int = TRAIN_PASSAGES) -> Model:
    """A model from labelled documents that are not held out: at most `rows` of them, with at most `passages` passages."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_qm_id"), "quality")
    slim = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("key"))
    own = slim.join(F.broadcast(chosen), F.col("doc_id") == F.col("_qm_id")).select(F.col("_qm_id").cast("long").alias("doc_id"), "text", "key", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, words in K.chunks(batch.column("text"), chunk=1 << 19):
                pairs = pairs_of(words)
                x, bags = measures(words, pairs)
                ends, good = np.cumsum(bags), np.flatnonzero(bags <= TRAIN_BAG)
                cells = [cells_of(words, pairs, int(words.first[i]), int(words.first[i + 1])) for i in good]
                part = batch.slice(at, len(bags)).take(pa.array(good))
                columns = [pa.array(bags[good], pa.int64()), *(pa.array(v, pa.binary()) for v in ([x[ends[i] - bags[i] : ends[i]].tobytes() for i in good], [c.tobytes() for c, _ in cells], [p.astype(np.uint16).tobytes() for _, p in cells]))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), part.column("quality"), *columns], names=["doc_id", "key", "quality", "n", "x", "cells", "passages"])

    found = materialize(own.mapInArrow(run, "doc_id bigint, key bigint, quality int, n bigint, x binary, cells binary, passages binary"), "labelled-bags")
    # One row of each id (at most `rows` ids), and of those as many as the bound on passages lets in.
    sizes = found.groupBy("doc_id").agg(F.min(F.struct("key", "n")).alias("one")).orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id", "one.key", "one.n").toPandas()
    sizes = sizes[sizes["n"].cumsum() <= passages]
    picked = found.sparkSession.createDataFrame(list(zip(sizes["doc_id"].tolist(), sizes["key"].tolist(), strict=True)), "doc_id long, key long")
    table = found.join(F.broadcast(picked), ["doc_id", "key"]).dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = [np.frombuffer(b, np.float32).reshape(-1, FEATURES).astype(np.float64) for b in table["x"]]
    cells = [(np.frombuffer(c, np.uint16).astype(np.int64), np.frombuffer(p, np.uint16).astype(np.int64)) for c, p in zip(table["cells"], table["passages"], strict=True)]
    return Model().fit(x, cells, (table["quality"].to_numpy() == 1).astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of docs."""
    slim = bounded(docs).select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.zeros(len(batch))
            for at, words in K.chunks(batch.column("text"), chunk=1 << 19):
                y[at : at + len(words.first) - 1] = model.score_words(words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op10_quality_model(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
