"""Linear margins of all labels at once, and their calibration on rows that the machine never saw.

A label's machine is a squared-hinge classifier over hashed, idf-weighted, normalised features. The machines of every label, and
of every fold's complement, are columns of one matrix: a step broadcasts it, a task adds up the gradient of all of its rows and
returns that of the features that they touch, summed by feature in Spark, so a fit takes as many jobs as steps, whatever the
number of labels and folds. The features of a row are put in order once, before the steps, and may stand for n equal rows. A row's
fold is a hash of its text, so equal texts share one. Calibration then takes each row's margin from the machines of its own
fold's complement, counted in one job as a histogram per label, and fits one logistic per label to that.

The matrix, features x labels x (folds + 1), is what the driver (in single precision) and each worker (with a gradient of its
own in double precision) hold; features is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.sinks import settled

FOLDS = 3
#: Step size and weight decay of the accelerated descent; a row has length 1 with its bias apart, so the loss is 4-smooth.
STEP, DECAY = 0.25, 1e-4
MARGIN_BINS, MARGIN_END = 400, 4.0
ROWS_AT_ONCE = 256
#: Least slope of a calibration: a greater margin never is a lower score.
FLAT = 1e-3


def hashed(terms: Column, features: int) -> Column:
    """The features of terms, with repeats."""
    return F.transform(terms, lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def _flat(column: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows and where each row begins, of features in order (packed) or in any order (a list)."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    if isinstance(column, pa.ListArray):
        offsets = column.offsets.to_numpy()
        return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
    _, at, data = column.buffers()
    kind = _kind(features)
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat.view(kind), (offsets - offsets[0]) // kind.itemsize


def _kind(features: int) -> np.dtype:
    return np.dtype("<u2" if features <= 1 << 16 else "<u4")


class Sparse:
    """Rows of a batch: flat feature indices and values (normalised) of some rows at a time."""

    def __init__(self, column: pa.Array, idf: np.ndarray):
        self.flat, self.offsets = _flat(column, len(idf))
        self.idf, self.n, self.ordered = idf, len(column), not isinstance(column, pa.ListArray)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, row of each entry, index, value); the bias, which every row has, is no entry."""
        for a in range(0, self.n, ROWS_AT_ONCE):
            z = min(a + ROWS_AT_ONCE, self.n)
            flat = self.flat[self.offsets[a] : self.offsets[z]]
            row = np.repeat(np.arange(z - a), np.diff(self.offsets[a : z + 1]))
            if not self.ordered:
                flat = _in_order(row, flat, len(self.idf))
            new = np.ones(len(flat), bool)
            new[1:] = (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            row, index, tf = row[first], flat[first], np.diff(np.r_[first, len(flat)])
            value = tf * self.idf[index]
            norm = np.sqrt(np.bincount(row, value * value, z - a))
            yield a, z, row, index, (value / norm[row]).astype(np.float32)


def _in_order(row: np.ndarray, flat: np.ndarray, features: int) -> np.ndarray:
    """The features of each row in order."""
    key = row.astype(np.int64) * features + flat
    key.sort()
    return key % features


PACKED = "x binary, y int, fold int, n long"


def packed(rows: DataFrame, features: int) -> DataFrame:
    """rows (h, y, fold, n) with the features of each row in order, as bytes: what every step reads."""
    kind = _kind(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            flat, offsets = _flat(batch.column("h"), features)
            done = np.empty(len(flat), kind)
            for a in range(0, len(batch), ROWS_AT_ONCE):
                at = offsets[a : a + ROWS_AT_ONCE + 1]
                done[at[0] : at[-1]] = _in_order(np.repeat(np.arange(len(at) - 1), np.diff(at)), flat[at[0] : at[-1]], features)
            x = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer((offsets * kind.itemsize).astype(np.int32)), pa.py_buffer(done)])
            yield pa.RecordBatch.from_arrays([x, *(batch.column(c) for c in ("y", "fold", "n"))], names=["x", "y", "fold", "n"])

    return rows.mapInArrow(run, PACKED)


def _margins(weights: np.ndarray, n: int, row: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.repeat(weights[-1:], n, axis=0)
    first = np.flatnonzero(np.diff(row, prepend=-1))
    if len(first):
        out[row[first]] += np.add.reduceat(weights[index] * value[:, None], first, axis=0)
    return out


def _sums(index: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(index, kind="stable")
    kinds, first = np.unique(index[order], return_index=True)
    return kinds, np.add.reduceat(g[order], first, axis=0)


GRADIENT = "feature int, g array<float>"


def _rows_of(kinds: np.ndarray, g: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * g.shape[1], pa.int32()), pa.array(g.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), lists], names=["feature", "g"])


class OneVsRest:
    """fit() on (h, y, fold) and maybe n: hashed features, label number, fold, number of such rows; then margins and calibrated
    scores."""

    def __init__(self, labels: int, features: int, steps: int, folds: int = FOLDS):
        self.labels, self.features, self.steps, self.folds = labels, features, steps, folds

    def fit(self, rows: DataFrame) -> OneVsRest:
        copies = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
        rows = settled(packed(rows.select("h", "y", "fold", copies.alias("n")), self.features))
        sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.sum("n").alias("n")).collect()}
        n, seen = sum(sizes.values()), np.zeros(self.features)
        df = self._seen(rows).toPandas()
        seen[df["feature"].to_numpy(int)] = df["n"].to_numpy(float)
        self.idf = np.log((1 + n) / (1 + seen)) + 1
        sets = np.array([max(1, n - sizes.get(f, 0)) for f in range(self.folds)] + [max(1, n)], np.float32)
        self.weights = np.zeros((self.features + 1, self.labels * (self.folds + 1)), np.float32)
        before, ahead = self.weights, self.weights
        for t in range(self.steps):
            g = self._gradient(rows, ahead) / np.repeat(sets, self.labels) + DECAY * ahead
            now = (ahead - STEP * g).astype(np.float32)
            ahead, before = (now + t / (t + 3) * (now - before)).astype(np.float32), now
        self.weights = before
        self._calibrate(rows)
        return self

    def _seen(self, rows: DataFrame) -> DataFrame:
        """(feature, n): how many rows have a feature."""
        features = self.features

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, one = np.zeros(features), np.ones(features)
            for batch in batches:
                n = batch.column("n").to_numpy()
                for a, z, row, index, _ in Sparse(batch.column("x"), one).parts():
                    own += np.bincount(index, n[a:z][row], features)
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(own[there])], names=["feature", "n"])

        return rows.mapInArrow(part, "feature int, n double").groupBy("feature").agg(F.sum("n").alias("n"))

    def _gradient(self, rows: DataFrame, weights: np.ndarray) -> np.ndarray:
        labels, folds = self.labels, self.folds
        sent = rows.sparkSession.sparkContext.broadcast((weights, self.idf))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, idf = sent.value
            own = np.zeros(weights.shape)
            touched = np.zeros(len(own), bool)
            for batch in batches:
                y, fold, n = (batch.column(c).to_numpy() for c in ("y", "fold", "n"))
                for a, z, row, index, value in Sparse(batch.column("x"), idf).parts():
                    sign = np.where(np.arange(labels) == y[a:z, None], 1.0, -1.0).astype(np.float32)
                    sign = np.tile(sign, folds + 1)
                    slope = -2 * sign * np.maximum(0, 1 - sign * _margins(weights, z - a, row, index, value))
                    slope *= np.repeat(np.arange(folds + 1) != fold[a:z, None], labels, axis=1)  # a fold's complement has not seen it
                    slope *= n[a:z, None]
                    own[-1] += slope.sum(axis=0)
                    kinds, g = _sums(index, slope[row] * value[:, None])
                    own[kinds] += g
                    touched[kinds] = touched[-1] = True
            yield _rows_of(np.flatnonzero(touched), own[touched])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: tuple[np.ndarray, np.ndarray] | None = None
            for batch in batches:
                g = batch.column("g").values.to_numpy().reshape(len(batch), -1)[: len(batch)] if len(batch) else None
                if g is not None:
                    f = batch.column("feature").to_numpy()
                    own = _sums(f, g) if own is None else _sums(np.r_[own[0], f], np.r_[own[1], g])
            if own is not None:
                yield _rows_of(*own)

        out = np.zeros_like(weights)
        found = rows.mapInArrow(part, GRADIENT).repartition("feature").mapInArrow(total, GRADIENT).toArrow()
        sent.unpersist()
        if len(found):
            lists = found.column("g").combine_chunks()
            out[found.column("feature").to_numpy()] = lists.flatten().to_numpy().reshape(len(found), -1)
        return out

    def unseen(self, rows: DataFrame) -> DataFrame:
        """(label, bin, n, pos, total): per label, how many rows have a margin in a bin, how many of them are of the label, and the
        sum of the margins, each by the machine that was fitted without the row's fold."""
        labels = self.labels
        sent = rows.sparkSession.sparkContext.broadcast((self.weights, self.idf))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, idf = sent.value
            counts = np.zeros((3, labels * MARGIN_BINS))
            for batch in batches:
                y, fold, n = (batch.column(c).to_numpy() for c in ("y", "fold", "n"))
                for a, z, row, index, value in Sparse(batch.column("x"), idf).parts():
                    every = _margins(weights, z - a, row, index, value).reshape(z - a, -1, labels)
                    m = every[np.arange(z - a), fold[a:z]]
                    at = np.arange(labels) * MARGIN_BINS + np.clip((m + MARGIN_END) / (2 * MARGIN_END) * MARGIN_BINS, 0, MARGIN_BINS - 1).astype(int)
                    for k, w in enumerate((np.ones_like(m), np.arange(labels) == y[a:z, None], m)):
                        counts[k] += np.bincount(at.ravel(), (w * n[a:z, None]).ravel(), labels * MARGIN_BINS)
            there = np.flatnonzero(counts[0])
            yield pa.RecordBatch.from_arrays([pa.array(there // MARGIN_BINS, pa.int32()), pa.array(there % MARGIN_BINS, pa.int32()), *(pa.array(c[there]) for c in counts)], names=["label", "bin", "n", "pos", "total"])

        parts = rows.mapInArrow(run, "label int, bin int, n double, pos double, total double")
        return parts.groupBy("label", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "pos", "total")))

    def _calibrate(self, rows: DataFrame) -> None:
        self.slope, self.shift = np.ones(self.labels), np.zeros(self.labels)
        found = self.unseen(rows).toPandas()
        for k, own in found.groupby("label"):
            m = (own["total"] / own["n"]).to_numpy()
            self.slope[k], self.shift[k] = logistic(m, own["n"].to_numpy(), own["pos"].to_numpy())

    def scored(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df (with h) plus scores: array of (score, label), unordered."""
        weights = self.weights[:, self.labels * self.folds :]
        sent = df.sparkSession.sparkContext.broadcast((weights, self.idf, self.slope, self.shift))
        kind = pa.struct([("score", pa.float64()), ("label", pa.string())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, idf, slope, shift = sent.value
            for batch in batches:
                own = Sparse(batch.column(batch.schema.get_field_index("h")), idf)
                p = np.zeros((len(batch), len(names)))
                for a, z, row, index, value in own.parts():
                    p[a:z] = 1 / (1 + np.exp(-(slope * _margins(weights, z - a, row, index, value) + shift)))
                flat = pa.StructArray.from_arrays([pa.array(p.ravel()), pa.array(names * len(batch), pa.string())], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * len(names), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "scores"])

        more = StructType.fromDDL("scores array<struct<score:double,label:string>>")
        return df.mapInArrow(run, StructType([*df.schema.fields, *more.fields]))


def logistic(margin: np.ndarray, n: np.ndarray, pos: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic of pos among n at each margin, by Newton steps; targets are drawn in by one row of each
    kind, so separable margins keep a finite slope."""
    total = float(pos.sum())
    high, low = (total + 1) / (total + 2), 1 / (float(n.sum()) - total + 2)
    want = pos * high + (n - pos) * low
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = np.maximum(n * p * (1 - p), 1e-12)
        e = want - n * p
        g = np.array([(e * margin).sum() - 1e-6 * a, e.sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    if a < FLAT:  # margins that tell nothing about unseen rows: they still order scores, all near the share of the label
        return FLAT, float(np.log(want.sum() / (n.sum() - want.sum())) - FLAT * (n * margin).sum() / n.sum())
    return float(a), float(b)
