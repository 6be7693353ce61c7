"""Case and evidence tables: Spark query and DuckDB SQL side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import views as v
from stallscope.operators import casebook as cb
from stallscope.operators import evidence as ev
from stallscope.operators.case_signals import input_counts
from stallscope.sources.cases import with_case_defaults, with_evidence_defaults

CHECKS: dict[str, tuple] = {}


def check(name: str, sql: str | None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn

    return add


CASES = """SELECT concat('C-', CAST(o_orderkey AS VARCHAR(20))) AS case_id, concat('Order of ', o_orderpriority) AS title, o_orderdate AS updated_at,
  CASE WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status, o_custkey % 2 AS root_ord FROM orders"""
C = f"WITH c AS ({CASES})"


def cases(spark, sf):
    return spark.sql(CASES.replace("FROM orders", "FROM {orders}"), orders=v.table(spark, sf, "orders"))


@check("case_list", f"{C} SELECT case_id, title, status FROM c")
def case_list(spark, sf):
    return cb.newest_first(cases(spark, sf)).select("case_id", "title", "status")


@check("case_filter", f"{C} SELECT case_id FROM c WHERE status <> 'resolved' AND (lower(case_id) LIKE '%77%' OR lower(title) LIKE '%77%')")
def case_filter(spark, sf):
    return cb.filter_cases(cases(spark, sf), text="77").select("case_id")


@check("case_filter_title", f"{C} SELECT case_id FROM c WHERE status = 'resolved' AND lower(title) LIKE '%urgent%'")
def case_filter_title(spark, sf):
    return cb.closed_list(cases(spark, sf), text="URGENT").select("case_id")


@check("closed_cases", f"{C} SELECT case_id FROM c WHERE status = 'resolved' ORDER BY updated_at DESC, case_id LIMIT 30")
def closed_cases(spark, sf):
    return cb.closed_list(cases(spark, sf)).select("case_id")


@check("closed_cases_hidden", f"{C} SELECT greatest(count(*) - 30, 0) AS hidden FROM c WHERE status = 'resolved'")
def closed_cases_hidden(spark, sf):
    return cb.hidden_closed(cases(spark, sf))


@check("default_case", f"{C} SELECT case_id FROM c WHERE status = 'open' ORDER BY updated_at DESC, case_id LIMIT 1")
def default_case(spark, sf):
    return cb.default_case(cases(spark, sf)).select("case_id")


@check(
    "first_root_wins",
    f"""{C}, r AS (SELECT case_id, title, root_ord FROM c UNION ALL SELECT case_id, concat(title, ' (copy)'), 1 - root_ord FROM c WHERE status = 'open')
SELECT case_id, arg_min(title, root_ord) AS title, min(root_ord) AS root_ord FROM r GROUP BY 1""",
)
def first_root_wins(spark, sf):
    rows = cases(spark, sf).select("case_id", "title", "root_ord", "status")
    copies = rows.where("status = 'open'").select("case_id", F.concat("title", F.lit(" (copy)")).alias("title"), (1 - F.col("root_ord")).alias("root_ord"), "status")
    return cb.first_root_wins(rows.union(copies)).select("case_id", "title", "root_ord")


CHANGES = """SELECT concat('C-', CAST(o_custkey AS VARCHAR(20))) AS case_id, o_orderdate AS updated_at, o_orderkey AS seq,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('Title ', o_orderpriority) END AS title, CASE WHEN o_orderstatus = 'F' THEN 'resolved' WHEN o_orderstatus = 'O' THEN 'open' END AS status,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('note ', CAST(o_orderkey AS VARCHAR(20))) END AS notes, CASE WHEN o_orderstatus = 'F' THEN 'fixed' END AS resolution,
  CASE WHEN o_orderstatus = 'F' THEN concat('u', CAST(o_orderkey % 9 AS VARCHAR(20))) END AS resolved_by FROM orders"""


@check(
    "case_state",
    f"""WITH ch AS ({CHANGES}), g AS (SELECT case_id, max(updated_at) AS updated_at, """
    + ", ".join(f"arg_max({c}, (updated_at, seq)) FILTER ({c} IS NOT NULL) AS {c}" for c in cb.CASE_FIELDS)
    + """ FROM ch GROUP BY case_id) SELECT case_id, coalesce(title, case_id) AS title, coalesce(status, 'open') AS status, notes, resolution, resolved_by FROM g""",
)
def case_state(spark, sf):
    changes = spark.sql(CHANGES.replace("FROM orders", "FROM {orders}"), orders=v.table(spark, sf, "orders"))
    return with_case_defaults(cb.current_cases(changes)).select("case_id", *cb.CASE_FIELDS)


@check(
    "evidence_state",
    """WITH x AS (SELECT l_orderkey, l_partkey, arg_max(l_returnflag, (l_shipdate, l_linenumber)) AS f, arg_max(l_quantity, (l_shipdate, l_linenumber)) AS q
  FROM lineitem GROUP BY 1, 2) SELECT l_orderkey AS case_id, l_partkey AS evidence_id, q AS quantity FROM x WHERE f <> 'R'""",
)
def evidence_state(spark, sf):
    rows = v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("evidence_id"), F.col("l_shipdate").alias("updated_at"),
        F.col("l_linenumber").alias("seq"), F.when(F.col("l_returnflag") == "R", "remove").otherwise("add").alias("action"),
        F.col("l_quantity").alias("quantity"),
    )
    return cb.current_evidence(rows).select("case_id", "evidence_id", "quantity")


# Evidence ---------------------------------------------------------------------------------------------

NAMES = ["a.HAR", "Shot.PNG", "my-ThreadDump.txt", "rec.jfr", "plain.txt", "top.out", "desktop.log", "x.tdump", "view.webp", "note"]
EVIDENCE = (
    "SELECT doc_id, source AS case_id, doc_id AS ord, concat(CAST(doc_id AS VARCHAR(20)), '-', CASE doc_id % 10 "
    + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES))
    + """ END) AS name,
  CASE WHEN doc_id % 7 = 3 THEN concat('x java.lang.Thread.State: y', text) WHEN doc_id % 7 = 4 THEN concat(text, ' load average 3') WHEN doc_id % 7 = 5
  THEN concat(text, ' nid=0x1 tid=0x2') ELSE text END AS content FROM documents"""
)
EV = f"WITH ev AS ({EVIDENCE})"
TYPE_SQL = """CASE WHEN lower(name) LIKE '%.har' THEN 'generic' WHEN regexp_matches(lower(name), '\\.(png|jpg|jpeg|gif)$') THEN 'screenshot'
  WHEN lower(name) LIKE '%threaddump%' OR lower(name) LIKE '%thread-dump%' OR lower(name) LIKE '%thread_dump%' OR regexp_matches(lower(name), '\\.(tdump|jfr)$') THEN 'thread-dump'
  WHEN contains(content, 'java.lang.Thread.State:') OR contains(content, '3XMTHREADINFO') OR regexp_matches(content, '^"[^"]+" #\\d+')
    OR (contains(content, 'nid=0x') AND contains(content, 'tid=0x')) THEN 'thread-dump'
  WHEN contains(lower(name), 'top') AND (contains(content, 'load average') OR contains(content, 'PID')) THEN 'top-output' ELSE 'log-export' END"""


def evidence(spark, sf):
    return spark.sql(EVIDENCE.replace("FROM documents", "FROM {documents}"), documents=v.table(spark, sf, "documents"))


@check("evidence_types", f"{EV} SELECT doc_id, {TYPE_SQL} AS type FROM ev")
def evidence_types(spark, sf):
    return evidence(spark, sf).select("doc_id", ev.evidence_type(F.col("name"), F.col("content")).alias("type"))


@check(
    "evidence_input_counts",
    f"""{EV}, t AS (SELECT case_id, {TYPE_SQL} AS type FROM ev) SELECT case_id, count(*) FILTER (type = 'thread-dump') AS thread_dumps,
  count(*) FILTER (type = 'log-export') AS logs, count(*) FILTER (type = 'top-output') AS top_outputs, CAST(0 AS BIGINT) AS parse_errors FROM t GROUP BY 1""",
)
def evidence_input_counts(spark, sf):
    return input_counts(ev.route(evidence(spark, sf)))


STAMP = "CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), '2024-02-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(9)), 2, '0'), ' 10:11:12 dump') WHEN doc_id % 3 = 1 THEN concat(text, ' 1TIDATETIME    Date: 2024/03/', lpad(CAST(doc_id % 28 + 1 AS VARCHAR(9)), 2, '0'), ' at 01:02:03:000') ELSE text END"


@check(
    "capture_times",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('2024-02-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), ' 10:11:12')
  WHEN doc_id % 3 = 1 THEN concat('2024-03-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), ' 01:02:03') ELSE '2030-01-01 00:00:00' END AS captured FROM documents""",
)
def capture_times(spark, sf):
    docs = v.table(spark, sf, "documents").withColumn("content", F.expr(STAMP))
    now = F.lit("2030-01-01 00:00:00").cast("timestamp")
    return docs.select("doc_id", F.date_format(ev.capture_time(F.col("content"), now), "yyyy-MM-dd HH:mm:ss").alias("captured"))


@check(
    "evidence_defaults",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN source END, '') AS source,
  CASE WHEN doc_id % 5 = 0 THEN '2030-01-01 00:00:00' ELSE concat('2024-05-', lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0'), ' 00:00:00') END AS captured FROM documents""",
)
def evidence_defaults(spark, sf):
    docs = v.table(spark, sf, "documents")
    day = F.concat(F.lit("2024-05-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"))
    raw = docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("evidence_id"), F.lit("x").alias("file_path"),
        F.when(F.col("doc_id") % 4 > 0, F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 5 == 0, "not a date").otherwise(day).alias("captured_at"),
    )
    out = with_evidence_defaults(raw, F.lit("2030-01-01 00:00:00").cast("timestamp"))
    return out.select("doc_id", "source", F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss").alias("captured"))


FILES = "files AS (SELECT case_id, concat('/root/', case_id, '/', name, CASE WHEN doc_id % 11 = 0 THEN '.md' ELSE '' END) AS file_path, doc_id FROM ev)"


def _files(spark, sf):
    e = evidence(spark, sf)
    path = F.concat(F.lit("/root/"), "case_id", F.lit("/"), "name", F.when(F.col("doc_id") % 11 == 0, ".md").otherwise(""))
    return e.select("case_id", path.alias("file_path"), "doc_id", "name")


@check(
    "untracked_files",
    f"""{EV}, {FILES} SELECT case_id, regexp_extract(file_path, '[^/]+$') AS source,
  CASE WHEN ends_with(lower(file_path), '.tdump') THEN 'thread-dump' WHEN ends_with(lower(file_path), '.log') THEN 'log-export'
    WHEN regexp_matches(lower(file_path), '\\.(png|jpg|jpeg|gif|webp)$') THEN 'screenshot' ELSE 'generic' END AS type
FROM files WHERE doc_id % 11 <> 0 AND doc_id % 4 <> 1 AND doc_id % 6 <> 2""",
)
def untracked_files(spark, sf):
    files = _files(spark, sf)
    tracked = files.where((F.col("doc_id") % 4 == 1) | (F.col("doc_id") % 6 == 2)).select(
        F.when(F.col("doc_id") % 4 == 1, F.col("file_path")).alias("file_path"),
        F.when(F.col("doc_id") % 4 != 1, F.col("file_path")).alias("stored_path"),
    )
    return cb.untracked_files(files, tracked).select("case_id", "source", "type")


@check("missing_files", f"{EV} SELECT doc_id FROM ev WHERE doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 7 = 0")
def missing_files(spark, sf):
    files = _files(spark, sf)
    d = F.col("doc_id")
    tracked = files.select(
        "doc_id", F.when(d % 7 == 0, "").otherwise(F.col("file_path")).alias("file_path"), F.when(d % 3 == 0, "kept").otherwise("").alias("content")
    )
    return cb.drop_missing(tracked, files.where(d % 5 == 0).select("file_path")).select("doc_id")


Q = "the"


@check(
    "evidence_search",
    f"""WITH p AS (SELECT doc_id, string_split(lower(text), '{Q}') AS parts FROM documents WHERE contains(lower(text), '{Q}'))
SELECT doc_id, CAST(len(parts) - 1 AS BIGINT) AS hits, array_to_string(list_transform(range(1, len(parts)),
  lambda i: list_sum(list_transform(parts[:i], lambda x: length(x))) + (i - 1) * {len(Q)}), ',') AS offsets FROM p""",
)
def evidence_search(spark, sf):
    found = cb.search(v.table(spark, sf, "documents"), "The", "text")
    return found.select("doc_id", "hits", F.array_join(F.transform("offsets", lambda x: x.cast("string")), ",").alias("offsets"))


@check(
    "evidence_search_totals",
    f"""SELECT source AS case_id, CAST(sum((length(lower(text)) - length(replace(lower(text), '{Q}', ''))) // {len(Q)}) AS BIGINT) AS hits,
  count(*) FILTER (contains(lower(text), '{Q}')) AS items FROM documents GROUP BY 1""",
)
def evidence_search_totals(spark, sf):
    docs = v.table(spark, sf, "documents").withColumnRenamed("source", "case_id")
    return cb.search_totals(docs, "THE", "text")


@check(
    "referenced_files",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('f', page_id % 5, '.txt,deep.log') ELSE concat('f', page_id % 5, '.txt') END AS files FROM pages""",
)
def referenced_files(spark, sf):
    p = F.col("page_id")
    one = F.concat(F.lit("f"), (p % 5).cast("string"), F.lit(".txt"))
    notes = F.concat(
        F.col("html"), F.lit("see [a](./"), one, F.lit(") and [b](./"), one, F.lit(") or [c](/abs.txt)"),
        F.when(p % 2 == 0, " [d](./sub/dir/deep.log)").otherwise(""),
    )
    return v.table(spark, sf, "pages").select("page_id", F.array_join(cb.referenced_files(notes), ",").alias("files"))


LABEL = """concat(CASE type WHEN 'thread-dump' THEN 'Thread dump' WHEN 'log-export' THEN 'Log export' WHEN 'top-output' THEN 'Top output'
  WHEN 'screenshot' THEN 'Screenshot' ELSE 'Evidence' END, ' at ', strftime(taken, '%Hh%M'))"""
TIMED = f"{EV}, tm AS (SELECT *, {TYPE_SQL} AS type, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(doc_id % 1440 AS INTEGER)) AS taken FROM ev)"


def _timed(spark, sf):
    minutes = (F.col("doc_id") % 1440) * 60
    start = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = evidence(spark, sf).withColumn("type", ev.evidence_type(F.col("name"), F.col("content")))
    return rows.withColumn("captured_at", F.timestamp_seconds(start + minutes))


@check("case_timeline", f"{TIMED} SELECT case_id, ord, concat('- ', strftime(taken, '%Hh%M'), ' — ', {LABEL}) AS line FROM tm")
def case_timeline(spark, sf):
    return cb.timeline(_timed(spark, sf)).select("case_id", "ord", "line")


SAFE = "lower(concat(type, '-', strftime(taken, '%Hh%M')))"


REPORT_BLOCKS = [  # section, a, b, lines
    (0, 0, 0, ["'---'", "concat('case_id: ', case_id)", "'title: \"T\"'", "'created: 2024-01-01T00:00:00.000Z'", "'status: resolved'", "'tags: [incident]'", "'---'", "''",
               "concat('# ', case_id, ' — T')", "''", "'## Summary'", "'done'", "''", "'## Evidence'"]),
    (2, 0, 0, ["''"]), (3, 0, 0, ["'## Findings'", "''"]), (4, 1, 0, ["'### [HIGH] Sig s1'", "'Signature: [[s1]]'", "''", "'**Evidence:**'"]), (4, 1, 1, ["'- found it'"]),
    (4, 1, 2, ["''", "'**Next Steps:**'", "'- [ ] look'", "''", "'**Related:** [[s2]], [[s3]]'", "''"]),
    (5, 0, 0, ["'## Timeline'"]), (7, 0, 0, ["''", "'## Resolution'"]), (8, 0, 0, ["'**Resolved by:** Unknown'", "''", "'done'"]),
]
BLOCKS_SQL = " UNION ALL ".join(
    f"SELECT case_id, {section} AS section, {a} AS a, {b} AS b, unnest(range({len(lines)})) AS c, unnest([{', '.join(lines)}]) AS line FROM cs" for section, a, b, lines in REPORT_BLOCKS
)


@check(
    "case_report",
    f"""{TIMED}, cs AS (SELECT DISTINCT source AS case_id FROM documents), l AS ({BLOCKS_SQL}
  UNION ALL SELECT case_id, 1, ord, 0, 0, CASE WHEN type = 'screenshot' THEN concat('- ![[', {SAFE}, '.png]] — ', {LABEL}) ELSE concat('- [[', {SAFE},
    CASE WHEN type = 'log-export' THEN '.log' ELSE '.txt' END, ']] — ', {LABEL}) END FROM tm
  UNION ALL SELECT case_id, 6, ord, 0, 0, concat('- ', strftime(taken, '%Hh%M'), ' — ', {LABEL}) FROM tm)
SELECT case_id, CAST(section AS INTEGER) AS section, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS INTEGER) AS c, line FROM l""",
)
def case_report(spark, sf):
    rows = _timed(spark, sf)
    known = rows.select("case_id").distinct().select(
        "case_id", F.lit("T").alias("title"), F.lit("resolved").alias("status"), F.lit("done").alias("resolution"),
        F.lit(None).cast("string").alias("resolved_by"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    found = known.select(
        "case_id", F.lit(1).alias("rank"), F.lit("s1").alias("signature_id"), F.lit("Sig s1").alias("signature_name"),
        F.lit("high").alias("confidence"), F.array(F.lit("look")).alias("next_steps"),
        F.array(F.lit("s2"), F.lit("s3")).alias("related_signatures"),
    )
    zero = F.lit(0)
    pos = F.struct(zero.alias("part"), zero.alias("cond_ord"), zero.cast("bigint").alias("line_group"), zero.alias("line_ord"))
    lines = known.select("case_id", F.lit("s1").alias("signature_id"), pos.alias("pos"), F.lit("found it").alias("line"))
    report = cb.case_report_lines(known, rows, found, lines)
    return report.select("case_id", "section", "a", "b", "c", "line")
