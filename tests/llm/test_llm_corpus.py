"""Suffix-array dedup, Merkle manifest and lexical search against brute-force versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark.llm import bitmap, lexical_search, merkle, suffix_array

from test_llm_operators import docs_of, random_texts

# 11 Suffix arrays.


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=4, max_size=24).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 3)), min_size=1, max_size=12, unique_by=lambda x: x[0]), st.integers(2, 4), st.booleans())
def test_repeat_groups_of_contexts(contexts, window, every):
    """Every repeated window is covered and no other byte; a group's occurrences are all places of its string."""
    texts, weights = [c for c, _ in contexts], [n for _, n in contexts]
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    got = list(suffix_array.repeats(np.frombuffer(b"".join(texts), np.uint8), offsets, np.array(weights), window, every))
    count = collections.Counter(t[i : i + window] for t, n in contexts for _ in range(n) for i in range(len(t) - window + 1))
    want = [{p for i in range(len(t) - window + 1) if count[t[i : i + window]] > 1 for p in range(i, i + window)} for t in texts]
    found = [set() for _ in texts]
    groups = collections.defaultdict(set)
    for g, n, c, o in got:
        found[c] |= set(range(o, o + n))
        groups[g, n].add((c, o))
    assert found == want
    for (_, n), members in groups.items():
        strings = {texts[c][o : o + n] for c, o in members}
        assert len(strings) == 1
        if every:
            own = strings.pop()
            assert members == {(c, o) for c, t in enumerate(texts) for o in range(len(t) - n + 1) if t[o : o + n] == own}


def test_intervals_of_a_known_array():
    # banana$: prefixes of neighbours in the suffix array are 0 0 1 3 0 0 2.
    assert sorted(suffix_array.lcp_intervals([-1, 0, 1, 3, 0, 0, 2])) == [(0, 0, 6), (1, 1, 3), (2, 5, 6), (3, 2, 3)]


def repeated_bytes(rows, window):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        out.append((i, len(t), sum(gone), sum(gone[k] and not (k and gone[k - 1]) for k in range(len(t))), bytes(b for b, x in zip(t, gone, strict=True) if not x)))
    return sorted(out, key=str)


def suffix_docs(spark):
    rng = random.Random(5)
    words = ["alpha", "be", "gämma", "delta x", "\n", "-----", "no", "ééé"]
    fresh = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = fresh(30)
    texts = [rng.choice([None, "", fresh(5), fresh(40), passage + fresh(8), fresh(9) + passage + fresh(7), "a" * 300, fresh(300), "-" * 70]) for _ in range(120)] + [passage, fresh(30)]
    ids = [*range(120), None, None]
    return docs_of(spark, [*texts, texts[3], texts[9]], [*ids, 3, 9])


@pytest.mark.parametrize(("heavy", "bits"), [(2000, 1 << 28), (3, 1 << 28), (3, 1)])
def test_suffix_dedup(spark, monkeypatch, heavy, bits):
    """With repeated rows, null ids, runs of one byte; with anchors too hot to gather; without bitmaps."""
    monkeypatch.setattr(bitmap, "MAX_BITS", bits)
    monkeypatch.setattr(suffix_array.shared_contexts, "__defaults__", (suffix_array.WINDOW, suffix_array.GRAM, heavy))
    d = suffix_docs(spark).withColumn("text_hash", F.lit("clash")).withColumn("places", F.lit(1))
    got = suffix_array.dedup(d, window=40, gram=11)
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()), key=str) == repeated_bytes([(r.doc_id, r.text) for r in d.collect()], 40)


def test_suffix_groups_have_all_occurrences(spark):
    rows = {r.doc_id: (r.text or "").encode() for r in suffix_docs(spark).where("doc_id < 40").dropDuplicates(["doc_id"]).collect()}
    d = docs_of(spark, [t.decode() for t in rows.values()], list(rows))
    groups = collections.defaultdict(set)
    for r in suffix_array.repeat_groups(d, window=40, gram=11).collect():
        groups[r.group, r.length].add((r.doc_id, r.start))
    assert groups
    for (_, n), places in groups.items():
        string = {rows[i][s : s + n] for i, s in places}
        assert len(string) == 1 and len(places) > 1
        own = string.pop()
        assert places == {(i, s) for i, t in rows.items() for s in range(len(t) - n + 1) if t[s : s + n] == own}


def test_suffix_edges(spark):
    d = docs_of(spark, [None, "", "x" * 199, "y" * 201, "z" * 200])
    out = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_array.dedup(d).collect()}
    assert out == {0: (0, 0, 0), 1: (0, 0, 0), 2: (199, 0, 0), 3: (201, 201, 1), 4: (200, 0, 0)}
    assert suffix_array.dedup(d.limit(0)).count() == 0


def test_slices_of_a_long_text(spark, monkeypatch):
    """A passage across the edges of slices, in a text far longer than one."""
    rng = random.Random(3)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = fresh(900)
    text = (fresh(700) + passage) * 1 + fresh(5000) + passage + fresh(100)
    for chunk in (256, 1000, 1 << 20):
        seen = set()
        for own in suffix_array.contexts_of(suffix_array.pa.array([text, None, passage]), 200, 48, chunk):
            for d, s, n in zip(own.doc.tolist(), own.start.tolist(), own.n.tolist(), strict=True):
                assert not seen & {(d, k) for k in range(s, s + n)}
                seen |= {(d, k) for k in range(s, s + n)}
        assert seen == {(0, k) for k in range(len(text) - 199)} | {(2, k) for k in range(len(passage) - 199)}


# 12 Merkle manifest.


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle_rows(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: sha(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(text))

    def tree(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def path(levels, p):
        for level in levels[:-1]:
            yield "".join(level[p - p % 8 : p]), "".join(level[p + 1 : p - p % 8 + 8])
            p //= 8

    langs = collections.defaultdict(list)
    for r in rows:
        langs[r["lang"]].append((r["doc_id"], leaf(r, r["text"]), r))
    keys = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for k in keys:
        langs[k].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {k: tree([x[1] for x in langs[k]]) for k in keys}
    crown = tree([trees[k][-1][0] for k in keys])
    out = []
    for c, k in enumerate(keys):
        for p, (i, h, r) in enumerate(langs[k]):
            steps = [*path(trees[k], p), *path(crown, c)]
            now = h
            if i is not None and r["text"] is not None and zlib.crc32(str(i).encode()) % 3 == 0:
                now = leaf(r, "".join(x.lower() if "A" <= x <= "Z" else x for x in r["text"]))
            for a, b in steps:
                now = sha(a, now, b)
            root = crown[-1][0]
            out.append((i, h, trees[k][-1][0], root, sha(*(a + b for a, b in steps)), now, now == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_merkle(spark, depth):
    """Trees of many heights, null and odd languages, null and repeated ids; runs of 8, 64 and 4,096 leaves."""
    rng = random.Random(depth)
    langs = [None, "", "en", "de", "é", "zz"] + [f"l{i}" for i in range(12)]
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "Some Text", "ÄB c", f"T{i}"]), rng.choices(langs, [5, 5, 500, 70, 9, 8] + [1] * 12)[0], rng.choice([None, "s", "ß"]), rng.choice([None, i])) for i in range(620)]
    rows += rows[:5]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pos int")
    got = merkle.manifest(merkle.document_leaves(d), depth).verified().select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == merkle_rows([r.asDict() for r in d.collect()])


def test_merkle_proofs_fold_to_the_root(spark):
    d = docs_of(spark, [f"text {i}" for i in range(70)])
    m = merkle.manifest(merkle.document_leaves(d), 1)
    proofs = m.proofs().collect()
    assert len(proofs) == 70 and all(merkle.folded(r.leaf, r.left, r.right) == m.root for r in proofs)
    assert all(merkle.folded("0" * 64, r.left, r.right) != m.root for r in proofs)


def test_merkle_edges(spark):
    d = docs_of(spark, ["One"], [7])
    row = merkle.manifest(merkle.document_leaves(d)).verified().first()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha("")
    assert merkle.manifest(merkle.document_leaves(d.limit(0))).verified().count() == 0


# 13 Lexical search.


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_packed_numbers(values):
    data, size = lexical_search.packed(np.array(values, np.int64))
    assert lexical_search.unpacked(data.tobytes()).tolist() == values and size.sum() == len(data)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(0, 6), min_size=1, max_size=20), max_size=7), st.integers(1, 5))
def test_best_is_that_of_all_scores(lists, k):
    """Many ties and zero scores: the pruned merge gives what sorting all documents gives."""
    total = collections.Counter()
    for own in lists:
        total.update(own)
    want = sorted(((s, d) for d, s in total.items() if s > 0), key=lambda x: (-x[0], x[1]))[:k]
    cursors = [(max(own.values()), sorted(own), [own[d] for d in sorted(own)]) for own in lists]
    assert lexical_search.best(cursors, k) == want


def ranked_rows(docs, items, k):
    docs = [(i, lexical_search.terms_of(t or "")) for i, t in docs]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = collections.Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            tf, s = collections.Counter(w), 0
            for t in lexical_search.terms_of(text or ""):
                if t in tf:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    s += weight * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * (75 + (25 * len(w) * n_docs) // n_terms)))
            if s > 0:
                scores.append((-s, i is not None, i or 0))
        out += [(item, r, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [1, 3000, 8 << 20])
def test_search(spark, monkeypatch, size):
    """Segments of a document, of some and of all; queries in many blocks; nulls, repeated rows and repeated terms."""
    monkeypatch.setattr(lexical_search, "BLOCK_CHARS", 60)
    texts = random_texts(9, 60) + ["Ünïcode wörds ÜNÏCODE x2 _x2_", "bing BING", None]
    d = docs_of(spark, [*texts, texts[7], texts[7]], [*range(61), None, 70, 7, 80]).repartition(3).withColumn("term", F.lit("clash"))
    items = [(0, "bing ben bor"), (1, texts[8]), (2, None), (3, "nothing-like-it"), (4, "bing bing bing"), (5, "x2 Ünïcode"), (6, "")]
    q = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.search(lexical_search.index(d, segment_bytes=size), q, 7)
    assert sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=str) == ranked_rows([(r.doc_id, r.text) for r in d.collect()], items, 7)


def test_search_of_nothing(spark):
    d, q = docs_of(spark, ["a b", None]), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.index(d.limit(0)), q).count() == 0
    assert lexical_search.search(lexical_search.index(d), q.limit(0)).count() == 0
    assert lexical_search.search(lexical_search.index(d.where("text is null")), q).count() == 0
