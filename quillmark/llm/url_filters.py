"""URL filters: a path-template tree per host, judged by smoothed labelled purity (built-in functions only).

1. Each path becomes a template: a segment of digits (with or without a file ending) is {n}, one with hexadecimal runs is
   {h}, others are themselves. Rows then shrink to one per host and template; the tree is built on those alone.
2. Downwards, level by level: where a node has more than max_children children, those with less than one in max_children
   of its rows become one wildcard '*'; common children stay as they are, and at most max_children can. Shares decide, so
   neither more rows of the same site nor one hot child changes the others. A node with no more templates below it than
   max_children can't hold a wildcard and is finished, so the levels end where the tree no longer branches widely.
3. Upwards, from the deepest labelled node: the children of a node and its own pages are pooled. A child whose share of
   good labels lies within z standard errors of the pool's merges with its parent; another splits off as a branch. Of the
   children that split off on the same side of the pool, those within z standard errors of their common share merge into
   one branch. What has merged counts for the parent one level up.
4. A template belongs to the longest branch that its path leads through, at least that of its host. It is blocked when the
   branch's purity, smoothed towards the share over all labelled rows, is below min_purity.

Rules given by hand come first: a rule fits its host and all subdomains where the path starts with the rule's; the longest
rule wins. Up to INLINE_RULES of them are part of the plan, longer lists are joined by host suffix and path prefix.

Edge cases: a null url or one without '://' has an empty host and path; such rows form a host of their own. Rows without
a label count in no purity and get the verdict of their branch; a host without labels has the prior. Paths of any depth
and length are read whole. Ties: of rules of equal length the last in order of text wins, of equal rules that of the last
verdict in order of text; a child exactly z errors away merges; a purity of exactly min_purity is allowed. Repeated rows
are judged each for itself; an empty table gives an empty result. Only the id and url columns of pages are read, so other
columns never clash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize

#: Fixed values of the contract: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INLINE_RULES = 100


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def join_rules(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (host, path, ...) plus rule and _qm_rule_verdict, for rules (verdict, host, path) of any number. Each url is
    tried with the suffixes of its host, and with the prefixes of its path of lengths that such a host's rules have."""
    r = rules.select("verdict", F.col("host").alias("_qm_h"), F.col("path").alias("_qm_p"), F.length("path").alias("_qm_l"))
    lengths = r.groupBy("_qm_h").agg(F.collect_set("_qm_l").alias("_qm_ls"))
    labels = F.split("host", r"\.")
    keys = rows.select("host", "path").distinct()
    tried = keys.withColumn("_qm_h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    tried = tried.join(lengths, "_qm_h").withColumn("_qm_l", F.explode(F.filter("_qm_ls", lambda n: n <= F.length("path")))).withColumn("_qm_p", F.expr("substring(path, 1, _qm_l)"))
    whole = F.concat("_qm_h", "_qm_p")
    found = tried.join(r.drop("_qm_l"), ["_qm_h", "_qm_p"]).groupBy("host", "path").agg(F.max(F.struct(F.length(whole).alias("n"), whole.alias("rule"), "verdict")).alias("_qm_best"))
    return rows.join(found, ["host", "path"], "left").withColumns({"rule": F.col("_qm_best.rule"), "_qm_rule_verdict": F.col("_qm_best.verdict")}).drop("_qm_best")


def lexical_template(path: Column) -> Column:
    """Segments by their kind: numbers, identifiers or the segment itself."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        lambda s: F.when(s.rlike(r"^[0-9]+(\.[a-z]{2,5})?$"), F.lit("{n}")).when(s.rlike(r"^[0-9a-f-]{8,}(\.[a-z]{2,5})?$") & s.rlike("[0-9]"), F.lit("{h}")).otherwise(s),
    )


def generalise(templates: DataFrame, max_children: int) -> DataFrame:
    """(host, raw, n, good, labelled) gets node: the template in the tree after wildcards, level by level."""
    done, level = [], 0
    now = templates.withColumn("node", F.lit("").cast("string"))
    while True:
        part = F.get(F.col("raw"), level)
        ended = now.where(part.isNull())
        child = now.where(part.isNotNull()).groupBy("host", "node", part.alias("_qm_part")).agg(F.sum("n").alias("_qm_c"), F.count("*").alias("_qm_t"))
        whole = child.groupBy("host", "node").agg(F.count("*").alias("_qm_kids"), F.sum("_qm_c").alias("_qm_all"), F.sum("_qm_t").alias("_qm_below"))
        # Nodes with few templates need no more levels: their paths are taken as they are.
        wide = whole.where(F.col("_qm_below") > max_children)
        kinds = child.join(wide, ["host", "node"]).select("host", "node", "_qm_part", ((F.col("_qm_kids") > max_children) & (F.col("_qm_c") * max_children < F.col("_qm_all"))).alias("_qm_wild"))
        more = now.where(part.isNotNull()).withColumn("_qm_part", part).join(kinds, ["host", "node", "_qm_part"], "left")
        rest = F.concat("node", F.lit("/"), F.array_join(F.slice("raw", level + 1, F.size("raw")), "/"))
        step = F.concat("node", F.lit("/"), F.when(F.col("_qm_wild"), F.lit("*")).otherwise(F.col("_qm_part")))
        after = more.withColumn("node", F.when(F.col("_qm_wild").isNull(), rest).otherwise(step)).withColumn("_qm_open", F.col("_qm_wild").isNotNull()).drop("_qm_wild", "_qm_part")
        after = materialize(after.unionByName(ended.withColumn("_qm_open", F.lit(False))), f"url-level-{level}")
        done.append(after.where("not _qm_open").drop("_qm_open"))
        now, level = after.where("_qm_open").drop("_qm_open"), level + 1
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _apart(good: Column, labelled: Column, share: Column, z: float) -> Column:
    return F.abs(good / labelled - share) > z * F.sqrt(share * (1 - share) / labelled)


def branches(nodes: DataFrame, z: float) -> DataFrame:
    """(host, branch, depth, good, labelled): the branches left of labelled nodes (host, node, good, labelled) when similar
    ones have merged, bottom-up; the branch '' of a host is what has merged with its root."""
    now = materialize(nodes.select("host", "node", (F.size(F.split("node", "/")) - 1).alias("depth"), "good", "labelled"), "url-nodes")
    found = []
    for k in range(now.agg(F.max("depth")).first()[0] or 0, 0, -1):
        kids = now.where(F.col("depth") == k).withColumn("up", F.expr(f"substring_index(node, '/', {k})"))
        both = kids.select("host", "up", "good", "labelled").unionByName(now.where(F.col("depth") == k - 1).select("host", F.col("node").alias("up"), "good", "labelled"))
        pool = both.groupBy("host", "up").agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("p"))
        own = F.col("good") / F.col("labelled")
        judged = materialize(kids.join(pool, ["host", "up"]).withColumns({"split": _apart(F.col("good"), F.col("labelled"), F.col("p"), z), "high": own > F.col("p")}), f"url-judged-{k}")
        off = judged.where("split")
        side = off.groupBy("host", "up", "high").agg(((F.sum("good") + 1) / (F.sum("labelled") + 2)).alias("q"))
        off = off.join(side, ["host", "up", "high"]).withColumn("alike", ~_apart(F.col("good"), F.col("labelled"), F.col("q"), z))
        merged = off.where("alike").groupBy("host", "up", "high").agg(F.sum("good").alias("_qm_good"), F.sum("labelled").alias("_qm_labelled"))
        off = off.join(merged, ["host", "up", "high"], "left").select("host", F.col("node").alias("branch"), "depth", *(F.when(F.col("alike"), F.col(f"_qm_{c}")).otherwise(F.col(c)).alias(c) for c in ("good", "labelled")))
        found.append(materialize(off, f"url-branches-{k}"))
        rest = now.where(F.col("depth") < k).unionByName(judged.where("not split").select("host", F.col("up").alias("node"), (F.col("depth") - 1).alias("depth"), "good", "labelled"))
        after = materialize(rest.groupBy("host", "node", "depth").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled")), f"url-nodes-{k}")
        discard(now)
        discard(judged)
        now = after
    return reduce(DataFrame.unionByName, found, now.withColumnRenamed("node", "branch"))


def template_verdicts(seen: DataFrame, max_children: int, z: float, strength: float, min_purity: float) -> DataFrame:
    """(host, raw, node, branch, purity, verdict) from rows (host, raw, quality)."""
    base = materialize(seen.groupBy("host", "raw").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("quality"), F.lit(0))).alias("good"), F.count("quality").alias("labelled")), "url-base")
    g, n = base.agg(F.sum("good"), F.sum("labelled")).first()
    prior = ((g or 0) + 1.0) / ((n or 0) + 2.0)
    tree = generalise(base, max_children)
    nodes = tree.groupBy("host", "node").agg(F.sum("good").alias("good"), F.sum("labelled").alias("labelled"))
    left = materialize(branches(nodes.where("labelled > 0"), z), "url-branches").withColumn("purity", (F.col("good") + strength * prior) / (F.col("labelled") + strength))
    # Only depths that have branches are tried; every host has its root.
    depths = F.array(F.lit(0), *(F.lit(r[0]) for r in left.where("depth > 0").select("depth").distinct().orderBy("depth").collect()))
    tried = nodes.select("host", "node", F.explode(F.filter(depths, lambda d: d < F.size(F.split("node", "/")))).alias("depth")).withColumn("branch", F.expr("substring_index(node, '/', depth + 1)"))
    best = tried.join(left.select("host", "branch", "purity"), ["host", "branch"]).groupBy("host", "node").agg(F.max(F.struct("depth", "branch", "purity")).alias("b"))
    out = tree.join(best, ["host", "node"], "left").withColumn("purity", F.coalesce("b.purity", F.lit(prior)))
    return materialize(out.select("host", "raw", "node", F.coalesce("b.branch", F.lit("")).alias("branch"), "purity", F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow")).alias("_qm_verdict")), "url-verdicts")


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_children: int = 50,
    z: float = 1.96,
    strength: float = 20.0,
    min_purity: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, template, branch, purity, verdict), one row for each row of pages. labels (doc_id,
    quality) belong to a page by the last number in its path; of several labels of one document the lowest counts."""
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    # Pages without a number get keys of their own, below those of labels, so that they don't meet in one task.
    number = F.expr(r"coalesce(try_cast(regexp_extract(path, '([0-9]{1,18})[^0-9]*$', 1) AS bigint), -1 - abs(xxhash64(host, path) % 1000000007))")
    rows = rows.withColumns({"raw": lexical_template(F.col("path")), "_qm_doc": number})
    marks = labels.where(F.col("doc_id") >= 0).groupBy(F.col("doc_id").cast("long").alias("_qm_doc")).agg(F.min("quality").cast("long").alias("quality"))
    seen = rows.select("host", "raw", "_qm_doc").join(marks, "_qm_doc", "left")
    out = rows.join(template_verdicts(seen, max_children, z, strength, min_purity), ["host", "raw"], "left")
    if len(rules) <= INLINE_RULES:
        rule, by_rule = match_rules(F.col("host"), F.col("path"), rules)
        out = out.withColumns({"rule": rule, "_qm_rule_verdict": by_rule})
    else:
        out = join_rules(out, pages.sparkSession.createDataFrame(rules, "verdict string, host string, path string"))
    return out.select("page_id", "host", "path", "rule", F.col("node").alias("template"), "branch", F.round("purity", 9).alias("purity"), F.coalesce("_qm_rule_verdict", "_qm_verdict", F.lit("allow")).alias("verdict"))


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
