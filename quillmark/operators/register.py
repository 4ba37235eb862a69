"""The register: routing of imports, commit, search, service dates and notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, token_grams, tokens


def route(rows: DataFrame, matches: DataFrame, supported: DataFrame, duplicate_from: float, new_to: float, auto_from: float) -> DataFrame:
    """rows (row_id, label, score) against matches (row_id, register_id, similarity): decision new, duplicate or uncertain
    by the best match; route auto only for new rows with a supported label and a score that is high enough."""
    best = matches.groupBy("row_id").agg(F.max_by("register_id", F.struct("similarity", "register_id")).alias("register_id"), F.max("similarity").alias("similarity"))
    known = supported.select("label").distinct().withColumn("_known", F.lit(True))
    s = F.coalesce("similarity", F.lit(0.0))
    decision = F.when(s >= duplicate_from, "duplicate").when(s <= new_to, "new").otherwise("uncertain")
    out = rows.join(best, "row_id", "left").join(known, "label", "left").withColumn("decision", decision)
    auto = (F.col("decision") == "new") & (F.col("score") >= auto_from) & F.coalesce("_known", F.lit(False))
    return out.withColumn("route", F.when(auto, "auto").otherwise("review")).drop("_known")


def commit(routed: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows for the register, one audit row each): auto rows, and reviewed ones that were accepted or overridden."""
    r = reviews.select("row_id", "verdict", F.col("label").alias("_label"))
    x = routed.join(r, "row_id", "left")
    take = (F.col("route") == "auto") | F.col("verdict").isin("accepted", "overridden")
    final = F.when(F.col("verdict") == "overridden", F.col("_label")).otherwise(F.col("label"))
    done = x.where(take).withColumn("final_label", final)
    audit = done.select("row_id", F.coalesce("verdict", F.lit("auto")).alias("action"), F.col("label").alias("proposed"), "final_label")
    return done.drop("label", "_label", "verdict").withColumnRenamed("final_label", "label"), audit


#: Weights of the fields that a search reads, most telling first.
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}


def search(register: DataFrame, query: str, fields: dict[str, str], limit: int | None = None) -> DataFrame:
    """register rows that hold every word of the query in some field, with a rank: summed weights of the matching words.
    Rows of one rank are in order of their id."""
    words = sorted({w for w in query.lower().split() if w})
    text = {c: tokens(normalise(F.col(c))) for c in fields}
    rank, every = F.lit(0.0), F.lit(True)
    for w in words:
        hits = [F.array_contains(t, w) for t in text.values()]
        some = F.lit(False)
        for (c, k), h in zip(fields.items(), hits, strict=True):
            rank += F.when(h, F.lit(WEIGHTS[k])).otherwise(0.0)
            some = some | h
        every = every & some
    out = register.withColumn("rank", rank).where(every)
    return out.orderBy(F.desc("rank"), "record_id").limit(limit) if limit else out


def edit_candidates(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """Distinct (l, r) of left (l) and right (r) that may be within `most` edits: r is parted into most + 1 pieces, of which so
    many edits leave one as it is, at most `most` places from its own. Pieces are join keys, so the tables meet by hash; strings
    too short to part meet by their length."""
    n, pieces = F.length("r"), most + 1
    cut = lambda size, j: F.floor(size * j / pieces).cast("int")
    keyed = right.select("r", F.explode(F.when(n < pieces, F.array(F.concat_ws("|", n, F.lit("*")))).otherwise(F.array(*(F.concat_ws("|", n, F.lit(j), F.expr("r").substr(cut(n, j) + 1, cut(n, j + 1) - cut(n, j))) for j in range(pieces))))).alias("k"))
    sizes = F.sequence(F.greatest(F.length("l") - most, F.lit(0)), F.length("l") + most)

    def own(size: Column) -> Column:
        def near(j: int) -> Column:
            a, z = cut(size, j), cut(size, j + 1)
            begins = F.sequence(F.greatest(a - most, F.lit(0)), a + most)
            return F.transform(begins, lambda x: F.concat_ws("|", size, F.lit(j), F.col("l").substr(x + 1, z - a)))

        return F.when(size < pieces, F.array(F.concat_ws("|", size, F.lit("*")))).otherwise(F.concat(*(near(j) for j in range(pieces))))

    probes = left.select("l", F.explode(sizes).alias("size")).select("l", F.explode(F.array_distinct(own(F.col("size")))).alias("k"))
    return probes.join(keyed, "k").select("l", "r").distinct()


def map_headers(headers: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """(header, target, distance): the nearest target or alias of each header within `most` edits; of equal ones the first by
    name."""
    h = headers.select("header", F.regexp_replace(F.lower("header"), "[^a-z0-9]", "").alias("l"))
    t = targets.select("target", F.regexp_replace(F.lower("alias"), "[^a-z0-9]", "").alias("r"))
    near = edit_candidates(h.select("l").distinct(), t.select("r").distinct(), most).withColumn("distance", F.levenshtein("l", "r")).where(F.col("distance") <= most)
    w = Window.partitionBy("header").orderBy("distance", "target")
    return h.join(near, "l").join(t, "r").withColumn("_r", F.row_number().over(w)).where("_r = 1").select("header", "target", "distance")


def service_state(assets: DataFrame, events: DataFrame, today: Column, soon_days: int = 30) -> DataFrame:
    """assets (asset_id, interval_days) with last_serviced (latest event), next_due, and state overdue, due_soon or ok."""
    last = events.groupBy("asset_id").agg(F.max("performed_at").cast("date").alias("last_serviced"))
    due = F.date_add("last_serviced", F.col("interval_days"))
    left = F.datediff("next_due", today)
    return assets.join(last, "asset_id", "left").withColumn("next_due", due).withColumn("state", F.when(left < 0, "overdue").when(left <= soon_days, "due_soon").when(left.isNotNull(), "ok"))


def new_notifications(states: DataFrame, sent: DataFrame) -> DataFrame:
    """Notices (asset_id, kind, due) that were not sent before: running it again sends nothing twice."""
    now = states.where(F.col("state").isin("overdue", "due_soon")).select("asset_id", F.col("state").alias("kind"), F.col("next_due").alias("due")).distinct()
    return now.join(sent.select("asset_id", "kind", "due"), ["asset_id", "kind", "due"], "left_anti")


# Divisions designated (for illustration) as carrying rules, their class and interval in days; header aliases.
HAZARDS = {"33": ("regulated", 365), "38": ("calibration_required", 365), "42": ("mechanical", 180)}
ALIASES = [("name", "Equipment Name"), ("manufacturer", "Make"), ("serial_number", "Serial No"), ("owning_department", "Dept")]


def with_hazard(records: DataFrame, hazards: dict[str, tuple[str, int]] = HAZARDS) -> DataFrame:
    """records with hazard_class and interval_days of their division; null where none is designated."""
    name, days = F.lit(None).cast("string"), F.lit(None).cast("int")
    for code, (kind, interval) in hazards.items():
        own = F.substring("cpv_code", 1, 2) == code
        name, days = F.when(own, F.lit(kind)).otherwise(name), F.when(own, F.lit(interval)).otherwise(days)
    return records.withColumns({"hazard_class": name, "interval_days": days})


def evidence(pairs: DataFrame, records: DataFrame, most: int = 10) -> DataFrame:
    """pairs plus matched: the first grams in order that both titles share, as what a reviewer sees."""
    g = records.select("record_id", token_grams(normalise(F.col("title"))).alias("g"))
    for side in ("left", "right"):
        pairs = pairs.join(g.select(F.col("record_id").alias(f"{side}_id"), F.col("g").alias(f"_{side}")), f"{side}_id", "left")
    shared = F.array_sort(F.array_intersect("_left", "_right"))
    return pairs.withColumn("matched", F.slice(F.coalesce(shared, F.array().cast("array<string>")), 1, most)).drop("_left", "_right")
