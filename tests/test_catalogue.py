import decimal
import os

import duckdb
import pytest

from strandwork.plans.catalogue import ORACLE_SQL, QUERIES

ROWS_ONLY = {"q_diff_parse", "q_retrieve", "q_coverage_plan", "q_contract_plan", "q_materialise", "q_surface_roots"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    want = sorted(repr(tuple(plain(r[rel.columns.index(c)]) for c in columns)) for r in rel.fetchall())
    assert got == want
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_reads_the_given_tables(spark, name, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        QUERIES[name](spark, str(tmp_path / "nowhere")).collect()


def test_the_others_are_known():
    assert set(QUERIES) - set(ORACLE_SQL) == ROWS_ONLY


def test_retrieval_finds_what_tasks_name(spark, sf):
    rows = QUERIES["q_retrieve"](spark, sf).collect()
    by = {(r.task_id, r.path): r for r in rows}
    for n in (0, 3):
        assert by[100 * n + 2, f"t{n}/shop/api.py"].source == "explicit" and by[100 * n + 2, f"t{n}/shop/api.py"].rank == 1
    found = {p.split("/", 1)[1] for t, p in by if t % 100 == 1}
    assert {"shop/store.py", "shop/models.py"} <= found
    assert not any(t % 100 == 3 for t, _ in by) and not any("node_modules" in p for _, p in by)


def test_plans_keep_to_their_caps(spark, sf):
    plan = QUERIES["q_coverage_plan"](spark, sf).collect()
    assert plan and all(r.score >= 120 for r in plan)
    assert len({(r.task_id, r.path, r.name) for r in plan}) == len(plan)
    docs = {r.task_id: r for r in QUERIES["q_materialise"](spark, sf).collect()}
    assert "def save_invoice" in docs[101].document and all(r.skipped == 0 for r in docs.values())
    spark.catalog.clearCache()


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE_SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["task_id", "path", "score", "rank"]
