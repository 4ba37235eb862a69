"""Edits of batches: the draws are md5, and no Column step runs for each character."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import degrade, edits


def test_draws_are_md5():
    """Prefixes around one and two blocks, positions of every length."""
    prefixes = [b"p" * n for n in (0, 3, 20, 46, 47, 50, 53, 54, 55, 56, 62, 63, 64, 65, 119, 200)]
    at = np.array([0, 9, 10, 99, 100, 999, 1000, 9999, 10000, 123456, 1000000])
    row, position = np.repeat(np.arange(len(prefixes)), len(at)), np.tile(at, len(prefixes))
    got = edits.Draws(prefixes).at(row, position)
    for r, p, *words in zip(row, position, *got, strict=True):
        assert hashlib.md5(prefixes[r] + str(p).encode()).hexdigest()[:24] == "".join(f"{w:08x}" for w in words)


def test_degraded_in_one_pass(spark):
    """both fields in one pass through Python, without lambdas over characters."""
    df = spark.createDataFrame([("1", "Temperature ß ΑΣ straße 5 mm\t1.5 kW", "x"), ("2", "", None), ("3", None, "ab")], "record_id string, title string, description string")
    out = degrade.degrade_frame(df, degrade.Degradation(0.5), 7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and plan.count("ArrowEvalPython") == 1
    rows = {r.record_id: r for r in out.collect()}
    assert rows["2"].title == "" and rows["3"].title != "" and len(rows) == 3


@pytest.mark.parametrize("edit", [edits.char_noise, edits.vary_case, edits.vary_spaces])
def test_rows_do_not_meet(edit):
    """A row alone gives what it gives among others."""
    words = ["ab cd", "", " x", "Éa ßb ΑΣ ", "y"]
    make = lambda own: edits.Texts(np.frombuffer("".join(own).encode("utf-32-le"), "<u4"), np.r_[0, np.cumsum([len(w) for w in own])], [b"7|%d|t" % words.index(w) for w in own])
    for limit in (0, 1 << 31, 1 << 32):
        run = lambda own: (lambda x: [x.text(a, z) for a, z in zip(x.start, x.start[1:], strict=False)])(edit(make(own), np.full(len(own), limit)))
        assert run(words) == [run([w])[0] for w in words]
        if not limit:
            assert run(words) == words
