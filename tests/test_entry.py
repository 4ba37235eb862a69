import __spark_entry__ as entry
import pytest

DATA = "/root/testdata/sf0.001"


def test_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert q and set(o) <= set(q)


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["left_id", "right_id", "shared"]


@pytest.mark.parametrize("name", ["normalise_documents", "discard_report_by_lang", "taxonomy_build", "selected_threshold", "embedding_topk_shortlist", "service_due"])
def test_against_duckdb(spark, name):
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    canon = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))
    assert canon(a) == canon(b)
