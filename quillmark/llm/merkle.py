"""Merkle manifest of a dataset: an external-memory node store, and proofs read from it by coordinate.

A row is a leaf, the sha256 of its fields; every ARITY consecutive nodes of a level make one node of the next, until one is
left. Each group (a language, say) has a tree of its own, whose top is its subroot, and the subroots are the leaves of the
last tree. A node's coordinate is (level, group, position).

* Leaves are sorted by range of (group, id), so a group that holds most rows lies in many partitions; positions are the
  counts of the partitions before plus the place in the own one. No task holds a group.
* Leaves are then dealt in aligned runs of ARITY**DEPTH positions. A task streams its runs in order and emits DEPTH
  levels of each, holding one run (at most 4,096 digests); the nodes go to Parquet partitioned by level. The next pass reads
  the last level of that as its leaves, so ten billion rows take three passes, each 1/4,096 of the one before.
* Proofs go the other way, by merge scans: a run's leaves, the nodes of its lower levels, and the path above its top, each
  sorted by coordinate, meet in one stream. What comes out of a pass is the path above the runs of the pass below.

Texts are read once; what is shuffled afterwards are digests (some 100 bytes a row). The driver sees the largest tree's
width and the root.

Edge cases: a null field is `-`; null groups come first and are one tree; rows of equal id are leaves in order of their
digests, null ids first; repeated rows are a leaf each; a lone leaf is its own subroot, and a lone subroot the root; an empty
table gives an empty result; very long texts are hashed whole by the JVM. Only the named columns are read, so others never
clash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize, scratch_dir

ARITY = 8
#: Levels that one pass builds; a run has ARITY**DEPTH leaves.
DEPTH = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """Strings that sort as groups do, null first, and are never null."""
    return F.coalesce(F.concat(F.lit("1"), group.cast("string")), F.lit("0"))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows (with `key`) plus pos, the gapless place in the key by `order`, and width, the key's number of rows."""
    by = ["key", *order]
    run = materialize(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "merkle-run")
    run = run.withColumn("_part", F.shiftright("_at", 33))
    own = run.groupBy("_part", "key").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "width": F.sum("_n").over(Window.partitionBy("key"))})
    out = run.join(own.drop("_n"), ["_part", "key"])
    return out.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before")


def next_level(nodes: list[str], arity: int = ARITY) -> list[str]:
    return [digest(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, len(batch), 1024):
            yield from batch.slice(at, 1024).to_pylist()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[dict]]]:
    """(key, block, rows) of a stream that is sorted by both; a run has at most ARITY**DEPTH leaves."""
    for (key, block), rows in groupby(_rows(batches), lambda r: (r["key"], r["block"])):
        yield key, block, list(rows)


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


NODE = "level int, key string, pos bigint, width bigint, hash string"
_NODE = pa.schema([("level", pa.int32()), ("key", pa.string()), ("pos", pa.int64()), ("width", pa.int64()), ("hash", pa.string())])


def _built(base: int, depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The levels above `base` of every run of a sorted stream."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for key, block, rows in _runs(batches):
            level, width, first = [r["hash"] for r in rows], rows[0]["width"], block * ARITY**depth
            for k in range(1, depth + 1):
                if width == 1:
                    break
                level, width, first = next_level(level), -(-width // ARITY), first // ARITY
                yield from ({"level": base + k, "key": key, "pos": first + i, "width": width, "hash": h} for i, h in enumerate(level))

    return lambda batches: _batches(nodes(batches), _NODE)


@dataclass
class Forest:
    """A written node store: leaves (key, pos, width, hash and more), nodes by level, and tops (key, subroot)."""

    leaves: DataFrame
    nodes: DataFrame | None
    rounds: list[DataFrame]
    depth: int

    def tops(self) -> DataFrame:
        own = self.leaves.where("width = 1").select("key", F.col("hash").alias("subroot"))
        return own if self.nodes is None else own.unionByName(self.nodes.where("width = 1").select("key", F.col("hash").alias("subroot")))


def grow(leaves: DataFrame, depth: int = DEPTH) -> Forest:
    """The store of all trees over leaves (key, pos, width, hash)."""
    spark = leaves.sparkSession
    path = f"{scratch_dir(spark)}/quillmark/merkle-{uuid.uuid4().hex}"
    widest = leaves.agg(F.max("width")).first()[0] or 0
    now, rounds, base, nodes = leaves, [], 0, None
    while widest > 1:
        rounds.append(now)
        runs = now.select("key", "pos", "width", "hash").where("width > 1").withColumn("block", F.expr(f"pos div {ARITY**depth}"))
        runs.repartition("key", "block").sortWithinPartitions("key", "block", "pos").mapInArrow(_built(base, depth), NODE).write.mode("append").partitionBy("level").parquet(path)
        base, widest = base + depth, -(-widest // ARITY**depth)
        nodes = spark.read.schema(NODE).parquet(path)
        now = nodes.where((F.col("level") == base) & (F.col("width") > 1))
    return Forest(leaves, nodes, rounds or [leaves], depth)


def _steps(at: int, width: int, levels: list[list[str]]) -> list[tuple[str, str]]:
    """(siblings to the left, to the right) of the leaf at a place of its run, on each level of the run."""
    out = []
    for level in levels:
        if width == 1:
            break
        first = at - at % ARITY
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + ARITY])))
        at, width = at // ARITY, -(-width // ARITY)
    return out


def folded(leaf: str, left: list[str], right: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right, strict=True):
        leaf = digest(a, leaf, b)
    return leaf


def _scan(forest: Forest, k: int, above: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of one pass in order of coordinate: per run the path above it, its nodes from the top level down, its leaves.
    A run that is a whole tree takes the path of its key, the others that of their top node."""
    depth, base = forest.depth, k * forest.depth
    leaves = forest.rounds[k]
    empty = F.lit(None).cast("array<string>")
    columns = lambda df, rank, block: df.select("key", block.cast("bigint").alias("block"), rank.cast("int").alias("rank"), "pos", "width", "hash", "left", "right", "subroot", *carried)
    none = {c: F.lit(None).cast(dict(leaves.dtypes)[c]) for c in carried}
    blank = {"left": empty, "right": empty, "subroot": F.lit(None).cast("string")}
    out = columns(leaves.withColumns(blank), F.lit(0), F.expr(f"pos div {ARITY**depth}"))
    if forest.nodes is not None and depth > 1:
        nodes = forest.nodes.where((F.col("level") > base) & (F.col("level") < base + depth)).withColumns(blank | none)
        out = out.unionByName(columns(nodes, F.col("level") - base, F.expr(f"pos div element_at(array({', '.join(str(ARITY ** (depth - r)) for r in range(1, depth))}), level - {base})")))
    top = above.withColumns({"width": F.lit(None).cast("bigint"), "hash": F.lit(None).cast("string")} | none)
    return out.unionByName(columns(top, F.lit(depth), F.col("pos"))).repartition("key", "block").sortWithinPartitions("key", "block", F.desc("rank"), "pos")


def _read(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[tuple[dict, list[str], list[str], str]]:
    """(leaf row, siblings to the left and right by level, subroot) from a merge scan."""
    for key, block, rows in _runs(batches):
        left, right, subroot, levels, leaves = [], [], "", [[] for _ in range(depth)], []
        for row in rows:
            if row["rank"] == depth:
                left, right, subroot = row["left"], row["right"], row["subroot"]
            else:
                levels[row["rank"]].append(row["hash"])
                if row["rank"] == 0:
                    leaves.append(row)
        for row in leaves:
            own = _steps(row["pos"] - block * ARITY**depth, row["width"], levels)
            yield row, [a for a, _ in own] + left, [b for _, b in own] + right, subroot


PATH = "key string, pos bigint, left array<string>, right array<string>, subroot string"
_PATH = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string())), ("subroot", pa.string())])


def _paths(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    return lambda batches: _batches(({"key": r["key"], "pos": r["pos"], "left": a, "right": b, "subroot": s} for r, a, b, s in _read(batches, depth)), _PATH)


def above_runs(forest: Forest, tops: DataFrame) -> DataFrame:
    """(key, pos, left, right, subroot): the path above each run of the leaves. tops has that of each key (pos 0)."""
    above = tops
    for k in range(len(forest.rounds) - 1, 0, -1):
        paths = materialize(_scan(forest, k, above, []).mapInArrow(_paths(forest.depth), PATH), "merkle-paths")
        above = paths.unionByName(tops.join(forest.rounds[k].where("pos = 0").select("key"), "key", "left_anti"))
    return above


@dataclass
class Manifest:
    """A dataset's forest, the tree over its subroots, and the root (None for an empty table)."""

    forest: Forest
    crown: Forest
    root: str | None

    def above(self) -> DataFrame:
        """The path above each run of leaves, up to the root."""
        nothing = F.array().cast("array<string>")
        spark = self.crown.leaves.sparkSession
        start = spark.range(1).select(F.lit("").alias("key"), F.lit(0).cast("bigint").alias("pos"), nothing.alias("left"), nothing.alias("right"), F.lit(self.root).alias("subroot"))
        crown, depth = _scan(self.crown, 0, above_runs(self.crown, start), ["group"]), self.crown.depth

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(({"key": r["group"], "pos": 0, "left": a, "right": b, "subroot": r["hash"]} for r, a, b, _ in _read(batches, depth)), _PATH)

        return above_runs(self.forest, materialize(crown.mapInArrow(paths, PATH), "merkle-crown"))

    def proofs(self) -> DataFrame:
        """(id, leaf, subroot, left, right): for each leaf the siblings of every level, up to the root."""
        depth = self.forest.depth
        schema = pa.schema([("id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("left", pa.list_(pa.string())), ("right", pa.list_(pa.string()))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _batches(({"id": r["id"], "leaf": r["hash"], "subroot": s, "left": a, "right": b} for r, a, b, s in _read(batches, depth)), schema)

        return _scan(self.forest, 0, self.above(), ["id"]).mapInArrow(run, "id bigint, leaf string, subroot string, left array<string>, right array<string>")

    def verified(self) -> DataFrame:
        """(id, leaf, subroot, root, proof_sha256, folded_root, verified): what the leaf in hand (`found`, else the leaf
        itself) and its proof fold to."""
        depth = self.forest.depth
        schema = pa.schema([(n, pa.string()) for n in ("leaf", "subroot", "proof_sha256", "folded_root")]).insert(0, pa.field("id", pa.int64()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ({"id": r["id"], "leaf": r["hash"], "subroot": s, "proof_sha256": digest(*(x for both in zip(a, b, strict=True) for x in both)), "folded_root": folded(r["found"] or r["hash"], a, b)} for r, a, b, s in _read(batches, depth))
            return _batches(rows, schema)

        out = _scan(self.forest, 0, self.above(), ["id", "found"]).mapInArrow(run, "id bigint, leaf string, subroot string, proof_sha256 string, folded_root string")
        return out.withColumn("root", F.lit(self.root)).withColumn("verified", F.col("folded_root") == F.col("root"))


def manifest(leaves: DataFrame, depth: int = DEPTH) -> Manifest:
    """The manifest of leaves (id, group, hash, found): `found` is the digest of the row in hand where it may differ."""
    # The salt spreads rows that are equal in everything.
    own = leaves.select("id", group_key(F.col("group")).alias("key"), "hash", "found", F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    own = materialize(own, "merkle-leaves")
    placed = materialize(numbered(own, "id", "hash", "salt").drop("salt"), "merkle-placed")
    discard(own)
    forest = grow(placed, depth)
    tops = materialize(forest.tops().select(F.col("key").alias("group"), F.lit("").alias("key"), F.col("subroot").alias("hash")), "merkle-tops")
    crown = grow(materialize(numbered(tops, "group"), "merkle-tops"), depth)
    root = crown.tops().first()
    return Manifest(forest, crown, root and root["subroot"])


def document_leaves(docs: DataFrame) -> DataFrame:
    """(id, group, hash, found) of documents. Where 3 divides the crc32 of the decimal doc_id, the row in hand has its text
    tampered with: A-Z are lower-cased."""
    own = [F.col(c) for c in FIELDS[:-1]]
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf_hash(*own, F.translate(text, UPPER, LOWER)))
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("lang").alias("group"), leaf_hash(*own, text).alias("hash"), tampered.alias("found"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    out = manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet"))).verified()
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
