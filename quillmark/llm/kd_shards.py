"""Shards by k-d tree: weighted medians along the widest metadata dimension, until leaves reach the target bytes.

1. A point is a group of equal texts, with its bytes as weight and its metadata as position: log size, language and source
   (names as numbers that keep their order). Equal texts stay together.
2. Groups that weigh over a twentieth of a shard (fewer than 20 a shard, so their list is small) are placed first, largest
   first, each into the emptiest shard. One that would push a shard over its share by more than SLACK is dealt into as few
   runs of documents as fit. What is left of each shard's share is its room.
3. All other points are split recursively: a node that is to fill some shards is cut along its widest dimension (spread
   relative to the whole) at the weighted quantile that gives the first half of its shards their room, until every node
   fills one shard. Quantiles are distributed: each round sums weights over bins of all open nodes' ranges and narrows the
   range to the bin that holds the quantile, until the bin's weight is under the tolerance or its range is one value.
   Dimensions are extended by hash bits, so ties split as well. Only sums per bin and node come to the driver, at most
   DRIVER_BINS; node tables of as many rows as shards are joined to the points, never a plan that grows with them.

The law is 'bytes': sizes of shards are near equal. Slots number the rows of a shard from 0 without gaps.

Edge cases: a null text is empty (8 bytes); null metadata count as ''; null ids come first in a shard; repeated rows get a
slot each, in an order by id, size and checksum; very long texts are points like others, and one longer than a shard fills
it; fewer points than shards leave shards empty; an empty table gives an empty result. Only the four named columns are
read, so others never clash."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

BINS, DRIVER_BINS, BUCKETS = 1024, 1 << 20, 4096
GROUP_SHARE = 20
#: A median may miss by this share of a shard's bytes, placed groups may go over theirs by SLACK.
TOLERANCE, SLACK = 0.002, 0.01
BITS = 48
#: Rows of a node table that is broadcast (some MB); longer ones are joined by shuffle.
NODE_ROWS = 100_000
DIMS = ["p0", "p1", "p2"]


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= NODE_ROWS else table


def _ordered(name: Column) -> Column:
    """The first six bytes of a name as a number: names in order give numbers in order."""
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.coalesce(name, F.lit("")), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _codes(points: DataFrame) -> DataFrame:
    """Each dimension as a whole number of BITS bits: 20 of its place between least and most, the rest of a hash."""
    spans = points.agg(*(F.min(d).alias(f"{d}_lo") for d in DIMS), *(F.max(d).alias(f"{d}_hi") for d in DIMS)).first()
    out = {}
    for k, d in enumerate(DIMS):
        lo, hi = spans[f"{d}_lo"] or 0.0, spans[f"{d}_hi"] or 0.0
        scaled = F.floor((F.col(d) - lo) / ((hi - lo) or 1.0) * (2**20 - 1)).cast("long")
        out[f"d{k}"] = scaled * 2 ** (BITS - 20) + F.pmod(F.xxhash64("point", F.lit(k)), F.lit(2 ** (BITS - 20)))
    return points.select("point", "w", *(v.alias(c) for c, v in out.items()))


def _cuts(tree: DataFrame, plan: dict[int, dict]) -> None:
    """Sets the cut of every planned node: the value that leaves its goal to the left."""
    spark, pending = tree.sparkSession, dict(plan)
    value = F.get(F.array(*(f"d{k}" for k in range(len(DIMS)))), F.col("dim"))
    while pending:
        bins = max(2, min(BINS, DRIVER_BINS // len(pending)))
        step = {k: max(1, -(-(p["hi"] - p["lo"]) // bins)) for k, p in pending.items()}
        nodes = _small(spark, [(k, p["dim"], p["lo"], p["hi"], step[k]) for k, p in pending.items()], "node int, dim int, lo long, hi long, step long")
        x = tree.join(nodes, "node").select("node", "w", value.alias("v"), "lo", "hi", "step").where("v >= lo and v < hi")
        sums: dict[int, dict[int, int]] = {}
        for r in x.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("w").alias("w")).collect():
            sums.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for k, p in list(pending.items()):
            at, weight, b = p["left"], 0, 0
            for b in sorted(sums.get(k, {})):
                weight = sums[k][b]
                if at + weight >= p["goal"]:
                    break
                at += weight
            else:
                weight = 0
            if weight <= p["slack"] or step[k] == 1:  # cut on the nearer side of the bin
                over = at + weight - p["goal"] < p["goal"] - at
                p["cut"] = p["lo"] + (b + over) * step[k]
                del pending[k]
            else:
                p["left"], p["lo"] = at, p["lo"] + b * step[k]
                p["hi"] = p["lo"] + step[k]


def assign(points: DataFrame, room: list[float]) -> tuple[DataFrame, list[dict]]:
    """((point, shard), splits) by recursive cuts; points has (point, w, d0..), room is what each shard is to take."""
    spark, n_dims = points.sparkSession, len(DIMS)
    tree = materialize(points.withColumn("node", F.lit(0).cast("int")), "kd-tree")
    todo = {0: (0, len(room))}  # node: its shards, from and to
    stats = [F.sum("w").alias("w"), *(F.min(f"d{k}").alias(f"lo{k}") for k in range(n_dims)), *(F.max(f"d{k}").alias(f"hi{k}") for k in range(n_dims))]
    whole, names, splits = None, 1, []
    before = [0.0]
    for r in room:
        before.append(before[-1] + r)
    while any(b - a > 1 for a, b in todo.values()):
        wide_nodes = _small(spark, [(k,) for k, (a, b) in todo.items() if b - a > 1], "node int")
        found = {r["node"]: r for r in tree.join(wide_nodes, "node").groupBy("node").agg(*stats).collect()}
        if not found:
            break
        whole = whole or found[0]
        todo |= {k: (a, a + 1) for k, (a, b) in todo.items() if b - a > 1 and k not in found}  # nodes without points
        plan = {}
        for k, r in found.items():
            a, b = todo[k]
            wide = max(range(n_dims), key=lambda i: (r[f"hi{i}"] - r[f"lo{i}"]) / max(1, whole[f"hi{i}"] - whole[f"lo{i}"]))  # noqa: B023
            middle, share = (a + b) // 2, max(before[b] - before[a], 1e-9)
            plan[k] = {"node": k, "dim": wide, "lo": r[f"lo{wide}"], "hi": r[f"hi{wide}"] + 1, "goal": r["w"] * (before[middle] - before[a]) / share, "left": 0, "slack": r["w"] / (b - a) * TOLERANCE, "middle": middle}
        _cuts(tree, plan)
        rows = []
        for k, p in plan.items():
            a, b = todo.pop(k)
            todo |= {names: (a, p["middle"]), names + 1: (p["middle"], b)}
            rows.append((k, p["dim"], p["cut"], names))
            splits.append(p | {"weight": found[k]["w"], "first": names})
            names += 2
        value = F.get(F.array(*(f"d{k}" for k in range(n_dims))), F.col("dim"))
        side = F.when(F.col("first").isNull(), F.col("node")).otherwise(F.col("first") + F.when(value < F.col("cut"), 0).otherwise(1))
        after = materialize(tree.join(_small(spark, rows, "node int, dim int, cut long, first int"), "node", "left").withColumn("node", side.cast("int")).drop("dim", "cut", "first"), "kd-tree")
        discard(tree)
        tree = after
    shard_of = _small(spark, [(k, a) for k, (a, _) in todo.items()], "node int, shard int")
    return tree.join(shard_of, "node").select("point", "shard"), splits


def place_groups(groups: list[tuple[int, int]], shards: int, share: float, least: float) -> tuple[dict[int, list[int]], list[float]]:
    """({group: shard of each of its runs}, load of each shard) for heavy groups (name, weight), largest first into the
    emptiest shards; a group that doesn't fit whole is dealt into the fewest runs that do, none lighter than `least`."""
    loads = [(0.0, s) for s in range(shards)]
    heapq.heapify(loads)
    placed = {}
    for name, weight in sorted(groups, key=lambda g: (-g[1], g[0])):
        runs = max(1, -int(-weight // (share * (1 + SLACK))))
        while True:
            runs = min(runs, shards)
            chosen = heapq.nsmallest(runs, loads)
            if runs == shards or chosen[-1][0] + weight / runs <= share * (1 + SLACK) or weight / runs <= least:
                break
            runs += 1
        placed[name] = [s for _, s in chosen]
        taken = set(placed[name])
        loads = [(w + weight / runs, s) if s in taken else (w, s) for w, s in loads]
        heapq.heapify(loads)
    return placed, [w for w, _ in sorted(loads, key=lambda x: x[1])]


def deal_runs(rows: DataFrame, placed: dict[int, list[int]], loads: list[float]) -> dict[int, list[int]]:
    """{group: cuts} for groups of several runs: documents are dealt by hash into buckets, and run i takes the buckets from
    cut i - 1 to cut i, so that runs weigh the same. Corrects the loads."""
    several = {g: s for g, s in placed.items() if len(s) > 1}
    if not several:
        return {}
    buckets = max(2, min(BUCKETS, DRIVER_BINS // len(several)))
    wanted = _small(rows.sparkSession, [(g, buckets) for g in several], "point long, buckets int")
    sums: dict[int, list[int]] = {g: [0] * buckets for g in several}
    for r in rows.join(wanted, "point").groupBy("point", _bucket(F.col("buckets")).alias("b")).agg(F.sum("size").alias("w")).collect():
        sums[r["point"]][r["b"]] = r["w"]
    cuts = {}
    for g, own in sums.items():
        n, total, at, cut, begun = len(several[g]), sum(own), 0, [buckets], 0
        for b, w in enumerate(own):
            if len(cut) < n and at + w / 2 >= total * len(cut) / n:
                loads[several[g][len(cut) - 1]] += (at - begun) - total / n
                begun = at
                cut.insert(-1, b)
            at += w
        loads[several[g][len(cut) - 1]] += (at - begun) - total / n
        cuts[g] = [buckets, *cut[:-1]]
    return cuts


def _bucket(buckets: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", F.lit(3)), buckets).cast("int")


def shard(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", extra_bytes: int = 8) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): one row for each row of docs. Give the number of shards, or
    the bytes that a shard is to reach."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + extra_bytes).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("point"),
        _ordered(F.col(lang_col)).alias("lang_code"),
        _ordered(F.col(source_col)).alias("source_code"),
    )
    rows = materialize(rows, "kd-rows")
    groups = rows.groupBy("point").agg(F.sum("size").alias("w"), F.max(F.log2("size").cast("double")).alias("p0"), F.min("lang_code").alias("p1"), F.min("source_code").alias("p2"))
    groups = materialize(groups, "kd-groups")
    total = groups.agg(F.sum("w")).first()[0] or 0
    if shards is None:
        shards = max(1, -(-total // max(1, target_bytes or 1)))
    share = max(1.0, total / shards)
    heavy = F.col("w") > share / GROUP_SHARE
    placed, loads = place_groups([(r["point"], r["w"]) for r in groups.where(heavy).select("point", "w").collect()], shards, share, share / GROUP_SHARE)
    cuts = deal_runs(rows, placed, loads)
    found, _ = assign(materialize(_codes(groups.where(~heavy)), "kd-points"), [max(0.0, share - w) for w in loads])
    # Fewer than GROUP_SHARE groups a shard are heavy, so their list is small at any scale.
    runs = _small(spark, [(g, s, cuts.get(g, [1])) for g, s in placed.items()], "point long, runs array<int>, cuts array<int>")
    marked = rows.join(runs, "point", "left")
    whole = marked.where("runs is not null").withColumn("shard", F.get("runs", F.size(F.filter(F.slice("cuts", 2, F.size("cuts")), lambda c: c <= _bucket(F.element_at("cuts", 1))))))
    placed_rows = whole.select("doc_id", "size", "text_crc32", "shard").unionByName(marked.where("runs is null").join(found, "point").select("doc_id", "size", "text_crc32", "shard"))
    return with_slots(placed_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_slots(placed: DataFrame, parts: int = 64) -> DataFrame:
    """Numbers from 0 in each shard, gapless: rows are numbered in parts, which are then set one after another."""
    placed = materialize(placed.withColumn("_qm_part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "kd-placed")
    counts = placed.groupBy("shard", "_qm_part").agg(F.count("*").alias("c"))
    before = counts.withColumn("_qm_before", F.coalesce(F.sum("c").over(Window.partitionBy("shard").orderBy("_qm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    number = F.row_number().over(Window.partitionBy("shard", "_qm_part").orderBy("doc_id", "size", "text_crc32")) - 1
    return placed.withColumn("_qm_own", number).join(before, ["shard", "_qm_part"]).withColumn("slot", (F.col("_qm_own") + F.col("_qm_before")).cast("long")).drop("_qm_own", "_qm_before", "_qm_part")


def op8_kd_shards(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards)
