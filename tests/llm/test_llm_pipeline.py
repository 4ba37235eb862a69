"""The pipeline's stages, each against a brute-force version on what the stage before it kept."""

import re

import corpus_pipeline as C
import public_tokenizers as P
from pyspark.sql import functions as F

from quillmark.llm import bpe, decontaminate, pii

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    bench = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = C.materialize(stage(spark, docs, DATA), f"test-{name}")
        after = {r.doc_id: r for r in docs.collect()}
        kept[name] = after
        if name != C.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "quality_rules":
            assert all(len(WORD.findall(r.text)) >= 20 for r in after.values())
        elif name == "near_duplicates":
            sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, r in before.items() for w in [WORD.findall(r.text.lower())]}
            near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
            assert not any(i in after and j in after for i, j in near)
            assert all(any(i == x or j == x for i, j in near) for x in set(before) - set(after))
        elif name == "decontamination":
            dirty = {i for i, r in before.items() if any(b in decontaminate.normal(r.text) for b in bench)}
            assert dirty and not dirty & set(after)
        elif name == "pii":
            assert all(not pii.base_spans(r.text) and len(r.text) == r.n_chars for r in after.values())
            assert all(after[i].text == r.text for i, r in before.items() if not pii.base_spans(r.text) and not pii.extra_spans(r.text, []))
        else:
            own = bpe.Encoder(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
            assert all(r.round_trip and list(r.ids) == own.encode(r.text) for r in after.values())


def test_odd_rows_pass(spark):
    text = "A plain sentence with quite a few different words that is long enough to be kept by every rule of the house today."
    rows = [(1, None, None, None, None), (None, text, "en", None, 3), (2, text, "en", "s", 3), (2, text, "en", "s", 3), (3, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_words", F.lit("clash"))
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = C.materialize(stage(spark, docs, DATA), f"odd-{name}")
        assert set(columns) <= set(docs.columns)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["2", "None"] and {r.n_words for r in docs.collect()} == {"clash"}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, DATA)
    assert empty.count() == 0
