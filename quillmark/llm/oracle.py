"""DuckDB SQL for the queries that it can express: URL filters, quality rules, Jaccard join, substring removal, Merkle
manifest, lexical search."""

from __future__ import annotations

from .quality_rules import FENCES, PRIOR_ROWS
from .url_filters import LOWER, RULES, UPPER

SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def url_filters(max_children: int = 50, z: float = 1.96, strength: float = 20.0, least: float = 0.5, levels: int = 12) -> str:
    """levels is the deepest path that the SQL follows; the operator has no such bound."""
    rules = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[1] + r[2]}'" for r in rules) + " END"
    told = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in rules) + " END"
    kind = r"CASE WHEN regexp_matches(s, '^[0-9]+(\.[a-z]{2,5})?$') THEN '{n}' WHEN regexp_matches(s, '^[0-9a-f-]{8,}(\.[a-z]{2,5})?$') AND regexp_matches(s, '[0-9]') THEN '{h}' ELSE s END"
    raw = f"list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {kind})"
    apart = lambda share: f"abs(good / labelled - {share}) > {z} * sqrt({share} * (1 - {share}) / labelled)"
    sql = rf"""WITH u AS MATERIALIZED (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path FROM pages),
 r AS MATERIALIZED (SELECT *, {raw} raw, TRY_CAST(regexp_extract(path, '([0-9]{{1,18}})[^0-9]*$', 1) AS BIGINT) doc FROM u), lb AS (SELECT doc_id, min(quality) quality FROM labels GROUP BY 1),
 t0 AS MATERIALIZED (SELECT host, raw, '' node, count(*) n, sum(coalesce(quality, 0)) good, count(quality) labelled FROM r LEFT JOIN lb ON doc_id = doc GROUP BY 1, 2)"""
    for k in range(levels):
        sql += f""", c{k} AS MATERIALIZED (SELECT host, node, raw[{k + 1}] p, sum(n) c, count(*) OVER w > {max_children} AND sum(n) * {max_children} < sum(sum(n)) OVER w wild FROM t{k} WHERE len(raw) > {k} GROUP BY 1, 2, 3 WINDOW w AS (PARTITION BY host, node)),
 t{k + 1} AS MATERIALIZED (SELECT t.host, raw, CASE WHEN len(raw) <= {k} THEN t.node WHEN wild THEN t.node || '/*' ELSE t.node || '/' || raw[{k + 1}] END node, n, good, labelled FROM t{k} t LEFT JOIN c{k} c ON c.host = t.host AND c.node = t.node AND c.p = raw[{k + 1}])"""
    sql += f""", b{levels} AS MATERIALIZED (SELECT host, node, len(string_split(node, '/')) - 1 depth, sum(good) good, sum(labelled) labelled FROM t{levels} GROUP BY 1, 2 HAVING sum(labelled) > 0), pr AS (SELECT (sum(good) + 1) / (sum(labelled) + 2) prior FROM t0)"""
    for k in range(levels, 0, -1):
        sql += f""", kid{k} AS MATERIALIZED (SELECT *, array_to_string(list_slice(string_split(node, '/'), 1, {k}), '/') up FROM b{k} WHERE depth = {k}),
 pool{k} AS (SELECT host, up, (sum(good) + 1) / (sum(labelled) + 2) p FROM (SELECT host, up, good, labelled FROM kid{k} UNION ALL SELECT host, node, good, labelled FROM b{k} WHERE depth = {k - 1}) GROUP BY 1, 2),
 j{k} AS MATERIALIZED (SELECT *, {apart("p")} split, good / labelled > p high FROM kid{k} JOIN pool{k} USING (host, up)), side{k} AS (SELECT host, up, high, (sum(good) + 1) / (sum(labelled) + 2) q FROM j{k} WHERE split GROUP BY 1, 2, 3),
 e{k} AS MATERIALIZED (SELECT *, NOT ({apart("q")}) alike FROM j{k} JOIN side{k} USING (host, up, high) WHERE split),
 s{k} AS MATERIALIZED (SELECT host, node branch, CASE WHEN alike THEN sum(good) FILTER (alike) OVER w ELSE good END good, CASE WHEN alike THEN sum(labelled) FILTER (alike) OVER w ELSE labelled END labelled FROM e{k} WINDOW w AS (PARTITION BY host, up, high)),
 b{k - 1} AS MATERIALIZED (SELECT host, node, depth, sum(good) good, sum(labelled) labelled FROM (SELECT host, node, depth, good, labelled FROM b{k} WHERE depth < {k} UNION ALL SELECT host, up, {k - 1}, good, labelled FROM j{k} WHERE NOT split) GROUP BY 1, 2, 3)"""
    every = " UNION ALL ".join(f"SELECT host, branch, good, labelled FROM s{k}" for k in range(1, levels + 1))
    return sql + f""", br AS MATERIALIZED ({every} UNION ALL SELECT host, node, good, labelled FROM b0), nd AS (SELECT DISTINCT host, node FROM t{levels}),
 best AS MATERIALIZED (SELECT nd.host, nd.node, br.branch, good, labelled FROM nd LEFT JOIN br ON br.host = nd.host AND (br.branch = nd.node OR starts_with(nd.node, br.branch || '/')) QUALIFY row_number() OVER (PARTITION BY nd.host, nd.node ORDER BY length(br.branch) DESC) = 1),
 v AS (SELECT host, node, coalesce(branch, '') branch, coalesce((good + {strength} * prior) / (labelled + {strength}), prior) purity FROM best, pr)
 SELECT page_id, r.host, path, {rule.replace('host', 'r.host')} "rule", node "template", branch, round(purity, 9) purity, coalesce({told.replace('host', 'r.host')}, CASE WHEN purity < {least} THEN 'block' ELSE 'allow' END) verdict FROM r JOIN t{levels} USING (host, raw) JOIN v USING (host, node)"""


def quality_rules() -> str:
    bucket = lambda m: f"(({m} >> greatest(length(bin({m})) - 5, 0)) << greatest(length(bin({m})) - 5, 0))"
    levels = {"s": ["lang", "source"], "l": ["lang"], "a": []}
    sql = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') text, coalesce(lang, '') lang, coalesce(source, '') source FROM documents), w AS (SELECT *, {SPLIT.format("text")} w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l FROM t),
 win AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 7), ' ') g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) i FROM w)), hit AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 rep AS (SELECT doc_id, count(DISTINCT p) n FROM (SELECT doc_id, unnest(range(i, i + 8)) p FROM hit) GROUP BY 1),
 c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) n_dup_lines, coalesce(n, 0) n_repeat_words, len(l) n_lines, length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) n_upper FROM w LEFT JOIN rep USING (doc_id)),
 f AS (SELECT *, CAST(word_chars * 100 // greatest(n_words, 1) AS BIGINT) m_word_len, CAST(n_symbols * 1000 // greatest(n_words, 1) AS BIGINT) m_symbols, CAST(n_dup_lines * 1000 // greatest(n_lines, 1) AS BIGINT) m_dup_lines, CAST(n_repeat_words * 1000 // greatest(n_words, 1) AS BIGINT) m_repeats, CAST(n_upper * 1000 // greatest(word_chars, 1) AS BIGINT) m_upper, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM c),
 b AS ({" UNION ALL ".join(f"SELECT lang, source, '{m}' metric, {bucket(m)} bucket, count(*) n FROM f WHERE NOT base_failed GROUP BY 1, 2, 4" for m in FENCES)})"""
    for tag, keys in levels.items():
        by = "".join(f"{k}, " for k in keys)
        cols = ", ".join(f"max(q3 + {up} * greatest(q3 - q1, {least})) FILTER (metric = '{m}') {tag}_{m}_hi" + (f", max(greatest(q1 - {down} * greatest(q3 - q1, {least}), 0)) FILTER (metric = '{m}') {tag}_{m}_lo" if down is not None else "") for m, (up, down, least) in FENCES.items())
        sql += f""", {tag}b AS (SELECT {by}metric, bucket, sum(n) n FROM b GROUP BY {by}metric, bucket), {tag}c AS (SELECT {by}metric, bucket, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) c, sum(n) OVER (PARTITION BY {by}metric) t FROM {tag}b),
 {tag}q AS (SELECT {by}metric, max(t) t, min(bucket) FILTER (c * 4 >= t) q1, min(bucket) FILTER (c * 4 >= t * 3) q3 FROM {tag}c GROUP BY {by}metric), {tag}f AS (SELECT {by}max(t) {tag}_rows, {cols} FROM {tag}q {"GROUP BY " + ", ".join(keys) if keys else ""})"""
    pick = lambda c: f"((s_rows * s_{c} + {PRIOR_ROWS} * ((l_rows * l_{c} + {PRIOR_ROWS} * a_{c}) // (l_rows + {PRIOR_ROWS}))) // (s_rows + {PRIOR_ROWS}))"
    ok = " AND ".join(f"coalesce({m} <= {pick(m + '_hi')}, true)" + (f" AND coalesce({m} >= {pick(m + '_lo')}, true)" if f[1] is not None else "") for m, f in FENCES.items())
    return sql + f" SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {', '.join(FENCES)}, base_failed, NOT base_failed AND {ok} kept FROM f LEFT JOIN sf USING (lang, source) LEFT JOIN lf USING (lang) LEFT JOIN af ON true"


JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {SPLIT.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} w FROM documents),
 s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) g FROM w)),
 n AS (SELECT doc_id, count(*) n FROM s GROUP BY 1), b AS (SELECT x.doc_id x, y.doc_id y, count(*) i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
 l AS (SELECT x, y FROM b JOIN n a ON a.doc_id = x JOIN n c ON c.doc_id = y WHERE 100 * i >= 90 * (a.n + c.n - i)), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
 r(a, z) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON e.x = r.z)
 SELECT d.doc_id, coalesce(n.n, 0) n_shingles, least(d.doc_id, coalesce(m.z, d.doc_id)) component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(z) z FROM r GROUP BY 1) m ON m.a = d.doc_id"""

SUBSTRING = f"""WITH w AS (SELECT doc_id, {SPLIT.format("coalesce(text, '')")} w FROM documents), win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) i FROM w)),
 hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) f FROM win) WHERE f < doc_id), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) p FROM hit), pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) p, unnest(w) x FROM w),
 kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) t, count(*) c FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
 SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(c, 0) AS BIGINT) n_removed, sha256(coalesce(t, '')) kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def merkle(levels: int = 6, crown: int = 2) -> str:
    """levels and crown bound the trees that the SQL follows (8**levels rows a language, 8**crown languages)."""
    field = lambda x: f"coalesce(strlen({x}) || ':' || {x}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(x) for x in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)) + ")"
    sql = f"""WITH tbl AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) t),
 crc AS (SELECT row_number() OVER () r, *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) crc FROM documents, tbl),
 lf AS MATERIALIZED (SELECT r, doc_id, coalesce('1' || lang, '0') k, {leaf("text")} leaf, CASE WHEN crc % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END found FROM crc),
 a0 AS MATERIALIZED (SELECT r, doc_id, leaf h, coalesce(found, leaf) f, k, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf, r) - 1 p, count(*) OVER (PARTITION BY k) width FROM lf)"""

    def tree(name: str, height: int) -> str:
        out = ""
        for i in range(height):
            run = "PARTITION BY k, p // 8 ORDER BY p ROWS BETWEEN"
            out += f""", {name}s{i} AS MATERIALIZED (SELECT k, p, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') g FROM {name}{i} WHERE width > 1),
 {name}{i + 1} AS MATERIALIZED (SELECT k, p, h, count(*) OVER (PARTITION BY k) width FROM (SELECT k, p // 8 p, sha256(string_agg(h, '' ORDER BY p)) h FROM {name}{i} WHERE width > 1 GROUP BY 1, 2))"""
        return out + f", {name}top AS (" + " UNION ALL ".join(f"SELECT k, h FROM {name}{i} WHERE width = 1" for i in range(height + 1)) + ")"

    sql += tree("a", levels) + ", c0 AS MATERIALIZED (SELECT k g, '' k, h, row_number() OVER (ORDER BY k) - 1 p, count(*) OVER () width FROM atop)" + tree("c", crown)
    steps = [(f"as{i}", f"s.k = d.k AND s.p = d.p // {8**i}") for i in range(levels)] + [(f"cs{i}", f"s.p = d.q // {8**i}") for i in range(crown)]
    sql += ", d0 AS (SELECT a0.r, doc_id, a0.k, a0.p, a0.h leaf, c0.h subroot, c0.p q, f, '' proof FROM a0 JOIN c0 ON c0.g = a0.k)"
    for i, (name, on) in enumerate(steps):
        sql += f", d{i + 1} AS (SELECT d.* REPLACE (CASE WHEN s.l IS NULL THEN f ELSE sha256(s.l || f || s.g) END AS f, proof || coalesce(s.l || s.g, '') AS proof) FROM d{i} d LEFT JOIN {name} s ON {on})"
    return sql + f" SELECT doc_id, leaf, subroot, ctop.h root, sha256(proof) proof_sha256, f folded_root, f = ctop.h verified FROM d{len(steps)}, ctop"


TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(UPPER, LOWER)

SEARCH = f"""WITH t AS MATERIALIZED (SELECT doc_id, row_number() OVER () r, {TERMS} w FROM documents),
 c AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) n_docs, CAST(sum(len(w)) AS BIGINT) n_terms FROM t), p AS MATERIALIZED (SELECT r, term, count(*) tf FROM (SELECT r, unnest(w) term FROM t) GROUP BY 1, 2),
 q AS MATERIALIZED (SELECT item_id, term, count(*) times FROM (SELECT item_id, unnest({TERMS}) term FROM benchmark) GROUP BY 1, 2),
 d AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) weight FROM p, c WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
 m AS (SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms m FROM t, c),
 s AS (SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) score FROM q JOIN d USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY 1, 2, 3)
 SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20"""

SUFFIX = """WITH t AS MATERIALIZED (SELECT row_number() OVER () r, doc_id, hex(encode(coalesce(text, ''))) x FROM documents), win AS (SELECT r, i, md5(substr(x, 2 * i + 1, 400)) g FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 199)) i FROM t)),
 hit AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1), o AS (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 200, true)::INT b FROM hit), n AS (SELECT r, i, sum(b) OVER (PARTITION BY r ORDER BY i) s FROM o),
 sp AS (SELECT r, s, min(i) a, max(i) + 200 z FROM n GROUP BY 1, 2), l AS (SELECT r, list(a ORDER BY a) a, list(z ORDER BY a) z FROM sp GROUP BY 1),
 k AS (SELECT doc_id, x, coalesce(a, []) a, coalesce(z, []) z FROM t LEFT JOIN l USING (r))
 SELECT doc_id, CAST(len(x) // 2 AS BIGINT) n_bytes, CAST(coalesce(list_sum(z) - list_sum(a), 0) AS BIGINT) n_removed, CAST(len(a) AS BIGINT) n_spans,
 sha256(unhex(array_to_string(list_transform(list_append(a, len(x) // 2), lambda q, i: substr(x, CASE WHEN i = 1 THEN 1 ELSE 2 * z[i - 1] + 1 END, 2 * (q - CASE WHEN i = 1 THEN 0 ELSE z[i - 1] END))), ''))) kept_sha256 FROM k"""

ORACLE: dict[str, str] = {"op1_url_filters": url_filters(), "op2_quality_rules": quality_rules(), "op3_jaccard_join": JACCARD, "op9_substring_dedup": SUBSTRING, "op11_suffix_dedup": SUFFIX, "op12_merkle_manifest": merkle(), "op13_lexical_search": SEARCH}
