import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

CHECKED = ["entity_upsert_fold", "edge_upsert_fold", "chunk_documents", "mutual_knn", "neighbors", "bm25_edges_plain", "rrf_fusion", "lateral_inhibition", "merge_edges", "curvature_cost_hist", "community_reports", "qa_rollup", "queue_fail", "token_budget", "components", "spreading_activation", "hybrid_search_plain", "edge_curvature", "mutual_knn_incremental", "chunk_lines", "ingest_graph"]


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = entry.queries()[name](spark, small)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert key(tuple(r) for r in df.select(columns).collect()) == key(result.fetchall())


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, small):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark, small):
    plan = entry.queries()["group_scan"](spark, small).where("group_id = 'default'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(group_id), EqualTo(group_id,default)]" in plan and "embedding" not in plan
