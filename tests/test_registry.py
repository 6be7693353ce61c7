"""Registered queries against their SQL on the small tables, where those are at hand."""

from pathlib import Path

import duckdb
import pytest

from checks import views
from checks.compare import TABLES, rows
from checks.registry import CHECKS
from stallscope.operators import cdn_metrics as cm

SF = Path("/root/testdata/sf0.001")
QUICK = [
    "query_blocked_by_keyframe", "query_predicates", "dump_counts", "blocked_monitors", "generic_dumps", "signature_conditions",
    "export_lines", "event_cap", "conversions", "metrics_volume", "metrics_urls", "metrics_gaps", "networks", "top_values",
    "upstream_chain", "upstream_chain_all", "case_report", "case_state", "evidence_search", "untracked_files",
]


@pytest.fixture(scope="module")
def con():
    if not SF.exists():
        pytest.skip("driver tables are not here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, con, name):
    fn, sql = CHECKS[name]
    df = fn(spark, str(SF))
    cur = con.execute(sql)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows([d[0] for d in cur.description], cur.fetchall()) and sum(got[1].values()) > 0


def test_every_query_has_sql():
    assert len(CHECKS) > 80 and all(sql for _, sql in CHECKS.values())


def test_entry(spark, con):
    from __spark_entry__ import entry, oracle_sql, queries

    df = entry(spark)
    assert df.columns == ["place", "keyframe", "count"] and df.count() > 0
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_events_are_dealt_to_all_cores_behind_their_filters(spark):
    """A table of few row groups is read by few tasks; what is made of its rows isn't."""
    plan = views.cdn_logs(spark, str(SF)).where("ord > 5")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("RepartitionByExpression") < plan.index("Filter")


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
def test_marks_of_events_compile(spark):
    """A method of more than 8,000 bytes isn't compiled by the JVM: all events would go through an interpreter."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its generated code only when it has run
    try:
        plan = cm.slim_events(views.cdn_logs(spark, str(SF)))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stages = getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$")
    codes = getattr(stages, "MODULE$").codegenStringSeq(plan)
    sizes = [codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())]
    assert len(sizes) > 1 and max(sizes) <= 8000


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["export_raw_kv", "export_raw_json", "export_lines"])
def test_exports_compile_and_are_dealt_evenly(spark, name):
    """No method beyond what the JVM compiles, and as many parts as the session names: joined by size, they are one more than cores."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = CHECKS[name][0](spark, str(SF))._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    codes = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$").codegenStringSeq(plan)
    assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) <= 8000
    assert "REPARTITION_BY_NUM" in plan.toString()


@pytest.mark.skipif(not SF.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", ["evidence_stuck_frame", "evidence_monitor_class"])
def test_evidence_reads_the_dumps_once(spark, monkeypatch, name):
    read, whole = [], views.threads
    monkeypatch.setattr(views, "threads", lambda *a: read.append(a) or whole(*a))
    CHECKS[name][0](spark, str(SF))
    assert len(read) == 1
