"""Every catalog query against its SQL counterpart in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillspark.plans import catalog, flows, oracle  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracle.oracle_sql()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "~"
    if hasattr(v, "tolist") and not isinstance(v, str):
        v = v.tolist()
    if isinstance(v, float):
        return "~" if v != v else str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return list(pdf.columns), sorted(tuple(cell(v) for v in r) for r in pdf.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    assert rows(catalog.Q[name](spark, sf).toPandas()) == rows(con.sql(SQL[name]).df())


def test_queries_without_sql_are_few():
    assert sorted(set(catalog.Q) - set(SQL)) == ["crawl_bfs_a1", "crawl_bfs_a2", "crawl_dfs", "embed_offline", "graph_answers", "ingest_counts", "page_main_text", "research_a1_sources", "research_run", "summary_sentences", "taint_scan", "traverse_a3", "traverse_a4", "vector_index_topk"]


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["doc_id", "duplicate_of"] and out.count() > 0
