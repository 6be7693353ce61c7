"""Evidence routing and case tables."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallscope.operators import casebook as cb
from stallscope.operators import evidence as ev
from stallscope.sources import cases as src


def test_evidence_types(spark):
    rows = [
        ("trace.HAR", "3XMTHREADINFO", "generic"), ("a.png", "", "screenshot"), ("my-thread-dump.log", "", "thread-dump"),
        ("x.jfr", "", "thread-dump"), ("a.log", "x java.lang.Thread.State: y", "thread-dump"), ("a.log", "3XMTHREADINFO", "thread-dump"),
        ("a.log", '"main" #1 prio', "thread-dump"), ("a.log", 'x "main" #1', "log-export"), ("a.log", "nid=0x1 tid=0x2", "thread-dump"),
        ("a.log", "nid=0x1", "log-export"), ("top.txt", "load average: 1", "top-output"), ("top.txt", "  PID USER", "top-output"),
        ("top.txt", "", "log-export"), ("error.log", None, "log-export"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, content string, want string")
    got = df.select("i", "want", ev.evidence_type(F.col("name"), F.col("content")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_capture_times(spark):
    texts = ["first\n2024-01-15 14:32:45\nFull dump", "1TIDATETIME    Date: 2024/01/16 at 01:02:03:000", "nothing", "at 2024-01-15 14:32:45"]
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = df.select("i", F.date_format(ev.capture_time(F.col("content"), now), "yyyy-MM-dd HH:mm:ss").alias("t")).orderBy("i")
    assert [r.t for r in got.collect()] == ["2024-01-15 14:32:45", "2024-01-16 01:02:03", "2030-01-01 00:00:00", "2030-01-01 00:00:00"]


def test_search_offsets(spark):
    df = spark.createDataFrame([("c", 1, "aaAA b.a"), ("c", 2, "none"), ("d", 3, "x.x")], "case_id string, id int, content string")
    got = {r.id: (r.hits, r.offsets) for r in cb.search(df, "Aa").collect()}
    assert got == {1: (2, [0, 2])}
    assert {r.id: r.offsets for r in cb.search(df, ".").collect()} == {1: [6], 3: [1]}
    assert {r.case_id: (r.hits, r["items"]) for r in cb.search_totals(df, "x").collect()} == {"c": (0, 0), "d": (2, 1)}
    with pytest.raises(ValueError):
        cb.search(df, "")


def test_a_million_hits(spark):
    """Offsets cost in proportion to the hits, at and around the sizes of chunks."""
    counts = [1, 255, 256, 257, 65_536, 65_537, 1_000_000]
    texts = [(n, "".join("ab" + "x" * (i % 3) for i in range(n))) for n in counts]
    df = spark.createDataFrame(texts, "n int, content string")
    for r in cb.search(df, "AB").select("n", "hits", "offsets").collect():
        at, want = 0, []
        for i in range(r.n):
            want.append(at)
            at += 2 + i % 3
        assert r.hits == r.n and r.offsets == want


def day(n):
    return datetime(2024, 1, n)


CHANGE = "case_id string, updated_at timestamp, seq int, title string, status string, notes string, resolution string, resolved_by string"


def test_change_rows(spark):
    rows = [
        ("a", day(1), 0, "First", None, None, None, None), ("a", day(2), 0, None, None, "n1", None, None),
        ("a", day(3), 0, None, "resolved", None, "done", "me"), ("a", day(4), 0, None, None, "n2", None, None),
        ("b", day(1), 0, "B", "resolved", None, "fix", "you"), ("b", day(2), 0, None, "open", None, None, None),
        ("c", day(1), 0, None, None, None, None, None), ("c", day(1), 1, "late", None, None, None, None),
    ]
    got = {r.case_id: r for r in cb.current_cases(spark.createDataFrame(rows, CHANGE)).collect()}
    assert (got["a"].title, got["a"].status, got["a"].notes, got["a"].resolution) == ("First", "resolved", "n2", "done")
    assert got["a"].created_at == day(1) and got["a"].updated_at == day(4)
    assert (got["b"].status, got["b"].resolution, got["b"].resolved_by) == ("open", "fix", "you")  # reopening keeps them
    assert (got["c"].title, got["c"].status) == ("late", "open")


def test_only_thread_dumps_say_when_they_were_taken(spark):
    line = "2024-02-03 10:11:12 something\n"
    rows = [("a.log", line), ("b.tdump", line), ("shot.png", line), ("c.txt", line + "java.lang.Thread.State: x")]
    got = ev.route(spark.createDataFrame(rows, "name string, content string"), F.lit("2030-01-01").cast("timestamp"))
    assert {r.name: (r.type, r.captured_at.year) for r in got.collect()} == {
        "a.log": ("log-export", 2030), "b.tdump": ("thread-dump", 2024), "shot.png": ("screenshot", 2030), "c.txt": ("thread-dump", 2024),
    }


def test_evidence_changes(spark):
    rows = [("a", "e1", day(1), 0, "add", "x"), ("a", "e2", day(1), 1, "add", "y"), ("a", "e1", day(2), 0, "remove", "x")]
    df = spark.createDataFrame(rows, "case_id string, evidence_id string, updated_at timestamp, seq int, action string, source string")
    assert [r.evidence_id for r in cb.current_evidence(df).collect()] == ["e2"]


def test_lists(spark):
    rows = [(f"C-{i}", f"Title {i}", day(1 + i % 28), "resolved" if i % 2 else "open", i % 3) for i in range(80)]
    df = spark.createDataFrame(rows, "case_id string, title string, updated_at timestamp, status string, root_ord int")
    assert cb.closed_list(df).count() == 30 and cb.hidden_closed(df).collect()[0].hidden == 10
    assert cb.closed_list(df, text="title 7").count() == 6
    assert cb.default_case(df).collect()[0].updated_at == day(27)
    assert cb.filter_cases(df, text="c-1").count() == 5
    twice = df.unionByName(df.withColumn("root_ord", F.lit(-1)).withColumn("title", F.lit("root")))
    assert {r.title for r in cb.first_root_wins(twice).collect()} == {"root"}


def test_files(spark):
    files = spark.createDataFrame([("c", "/c/a.log"), ("c", "/c/b.TDUMP"), ("c", "/c/n.MD"), ("c", "/c/s.txt"), ("c", "/c/i.webp")], "case_id string, file_path string")
    known = spark.createDataFrame([("/c/a.log", None, ""), ("/gone", "/c/s.txt", "kept"), ("/lost", None, ""), ("", None, "")], "file_path string, stored_path string, content string")
    got = {r.evidence_id: r.type for r in cb.untracked_files(files, known).collect()}
    assert got == {"disk-b.TDUMP": "thread-dump", "disk-i.webp": "screenshot"}
    assert {r.file_path for r in cb.drop_missing(known, files).collect()} == {"/c/a.log", "/gone", ""}
    notes = spark.createDataFrame([("[a](./x/y.txt) [b](.\\z.log) [c](./x/y.txt) [d](/no.txt)",)], "n string")
    names = notes.select(cb.referenced_files(F.col("n")).alias("f")).collect()[0].f
    assert names[0] == "y.txt" and len(names) == 2


def test_tables_round_trip(spark, tmp_path):
    path = str(tmp_path / "cases")
    first = spark.createDataFrame([("a", None, None)], "case_id string, title string, status string")
    src.append_changes(first, path)
    src.append_changes(first.withColumn("case_id", F.lit("b")), path)
    assert {(r.case_id, r.title, r.status) for r in src.read_cases(spark, path).collect()} == {("a", "a", "open"), ("b", "b", "open")}
    src.write_findings(first, str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "findings")).where("case_id = 'a'").count() == 1


def test_case_report(spark, tmp_path):
    cases = spark.createDataFrame(
        [("a", "Slow", "resolved", "Fixed it", "me", day(1)), ("b", "Open one", "open", None, None, day(2))],
        "case_id string, title string, status string, resolution string, resolved_by string, created_at timestamp",
    )
    evidence = spark.createDataFrame(
        [("a", 0, "thread-dump", datetime(2024, 1, 1, 9, 5)), ("a", 1, "screenshot", datetime(2024, 1, 1, 8, 0)), ("a", 2, "log-export", datetime(2024, 1, 1, 7, 0))],
        "case_id string, ord bigint, type string, captured_at timestamp",
    )
    findings = spark.createDataFrame(
        [("a", 1, "s", "Sig", "high", ["step"], ["other"])],
        "case_id string, rank int, signature_id string, signature_name string, confidence string, next_steps array<string>, related_signatures array<string>",
    )
    lines = spark.createDataFrame(
        [("a", "s", (1, 0, 2, 0), "third"), ("a", "s", (0, 1, 0, 0), "second"), ("a", "s", (0, 0, 0, 0), "first")],
        "case_id string, signature_id string, pos struct<part:int,cond_ord:int,line_group:bigint,line_ord:int>, line string",
    )
    report = cb.case_report_lines(cases, evidence, findings, lines)
    got = [r.line for r in report.where("case_id = 'a'").orderBy(*cb.REPORT_ORDER).collect()]
    assert got[:9] == ["---", "case_id: a", 'title: "Slow"', "created: 2024-01-01T00:00:00.000Z", "status: resolved", "tags: [incident]", "---", "", "# a — Slow"]
    assert got[9:17] == [
        "", "## Summary", "Fixed it", "", "## Evidence", "- [[thread-dump-09h05.txt]] — Thread dump at 09h05",
        "- ![[screenshot-08h00.png]] — Screenshot at 08h00", "- [[log-export-07h00.log]] — Log export at 07h00",
    ]
    assert got[17:] == [
        "", "## Findings", "", "### [HIGH] Sig", "Signature: [[s]]", "", "**Evidence:**", "- first", "- second", "- third", "",
        "**Next Steps:**", "- [ ] step", "", "**Related:** [[other]]", "", "## Timeline", "- 09h05 — Thread dump at 09h05",
        "- 08h00 — Screenshot at 08h00", "- 07h00 — Log export at 07h00", "", "## Resolution", "**Resolved by:** me", "", "Fixed it",
    ]
    b = [r.line for r in report.where("case_id = 'b'").orderBy(*cb.REPORT_ORDER).collect()]
    assert "_Investigation in progress_" in b and b[-1] == "_Not yet resolved_" and "## Findings" not in b
    src.write_case_reports(report, str(tmp_path / "reports"))
    assert (tmp_path / "reports" / "case_id=a").is_dir()
