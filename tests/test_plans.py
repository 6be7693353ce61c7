"""Whole plans: how often they read the events, and what they do when something is missing."""

import subprocess
import sys
from pathlib import Path

import builders as b
import pytest
from pyspark.sql import functions as F
from stallscope.operators.cdn_metrics import cdn_metrics
from stallscope.plans.cdn_report import analyse_events, analyse_incident
from stallscope.plans.incident import analyse_evidence
from stallscope.sources import signatures as sg

ROOT = Path(__file__).resolve().parent.parent


def scans(spark, path, job):
    """How many scans of ``path`` the executed plans of a job have."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = job()
    result.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    plans = store.executionsList()
    return sum(plans.apply(i).physicalPlanDescription().count(f"InMemoryFileIndex [file:{path}]") for i in range(before, plans.size()))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "e")
    rows = b.service(b.across_pops(12), "one") + b.service(b.bots_on_cold_pop(8), "two")
    b.events(spark, [{**r, "time_start": b.at(i)} for i, r in enumerate(rows)]).write.parquet(path)
    return path


def test_the_events_are_read_once(spark, stored):
    events = lambda: spark.read.parquet(stored)
    assert scans(spark, stored, lambda: events().groupBy("url").count()) == 1  # the count works
    assert scans(spark, stored, lambda: cdn_metrics(events())) == 1
    assert scans(spark, stored, lambda: analyse_events(events())) == 1
    assert scans(spark, stored, lambda: analyse_events(events(), max_events=20)) == 1


def test_a_failed_baseline_is_a_warning(spark, stored):
    events = spark.read.parquet(stored)
    missing = lambda: spark.read.schema(events.schema).parquet(f"{stored}-not-there")
    rows = analyse_incident(events, "2000-01-01T00:00:00Z", "2100-01-01T00:00:00Z", tier="*", history=missing).collect()
    assert {r.aem_service for r in rows} == {"one", "two"}
    assert all(r.warnings[0].startswith("POP baseline query failed (") and r.warnings[0].endswith("using in-window rarity heuristic.") for r in rows)
    rows = analyse_incident(events, "2000-01-01T00:00:00Z", "2100-01-01T00:00:00Z", tier="*").collect()
    assert all(r.warnings[0].startswith("POP baseline query returned no data") for r in rows)


def test_a_service_without_events_gets_an_empty_report(spark, stored):
    rows = analyse_incident(spark.read.parquet(stored), "2000-01-01T00:00:00Z", "2100-01-01T00:00:00Z", service="three").collect()
    assert [(r.aem_service, r.aem_tier, r.entryCount, r.missCount) for r in rows] == [("three", "publish", 0, 0)]
    assert rows[0].summary.startswith("No CDN log events matched the query") and rows[0].warnings[-1].startswith("No cache MISS events")


def test_evidence_to_findings(spark):
    block = '"{0}" #1\n   java.lang.Thread.State: BLOCKED\n\t- waiting to lock <0x1> (a com.acme.Lock)\n\tat com.acme.X.y(X.java:1)\n\n'
    rows = [
        ("c", "e1", 0, "a.tdump", "".join(block.format(f"t{i}") for i in range(30))), ("c", "e2", 1, "b.tdump", "nothing here"), ("c", "e3", 2, "x.log", "2024-01-01 00:00:00 line"),
        ("d", "e1", 0, "top.out", "load average: 1"),
    ]
    plan = analyse_evidence(spark.createDataFrame(rows, "case_id string, evidence_id string, ord bigint, name string, content string"), sg.bundled_signatures(spark), F.lit("2030-01-01").cast("timestamp"))
    assert {r.case_id: (r.thread_dumps, r.logs, r.top_outputs, r.parse_errors) for r in plan.inputs.collect()} == {"c": (2, 1, 0, 1), "d": (0, 0, 1, 0)}
    assert "thread-lock-contention" in {r.signature_id for r in plan.findings.where("case_id = 'c'").collect()}
    assert plan.finding_evidence.where("case_id = 'c'").count() > 0


def test_a_session_without_spark_defaults_has_a_scratch_folder(tmp_path):
    code = "from stallscope.session import *; s = local_session('x', '2', 2); d = stage(s.range(5), 't'); print(d.count(), checkpoint_dir(s).startswith('/'))"
    env = {"PATH": __import__("os").environ["PATH"], "SPARK_CONF_DIR": str(tmp_path), "HOME": str(tmp_path)}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split()[-2:] == ["5", "True"], out.stderr[-2000:]
