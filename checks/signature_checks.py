"""Signature matching: Spark query and DuckDB SQL side by side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views as v
from checks.thread_checks import ADDR, DOM, SIGNALS_SQL, case_frames, signals
from stallscope.operators import case_signals as cs
from stallscope.operators import casebook as cb
from stallscope.operators import dump_signals as ds
from stallscope.operators import signature_match as sm
from stallscope.operators.condition_store import ConditionStore
from stallscope.plans.incident import analyse_evidence, derive_signals, match_cases, rematch, signature_frequency
from stallscope.session import Staging, stage
from stallscope.sources import signatures as sg
from stallscope.sources.dumps import parse_threads

CHECKS: dict[str, tuple] = {}


def check(name: str, sql: str | None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn

    return add


# id -> conditions (field, operator, number, text, test in SQL, observed value in SQL)
WHOLE = "CAST(CAST(\"{0}\" AS BIGINT) AS VARCHAR)"
CUSTOM = {
    "blocked-custom": [
        ("blockedThreadCount", "gt", 5.0, None, '"blockedThreadCount" > 5', WHOLE),
        ("waitingThreadCount", "lt", 1.0, None, '"waitingThreadCount" < 1', WHOLE),
    ],
    "class-exact": [
        ("topBlockedMonitorClass", "eq", None, "com.zaxxer.hikari.pool.HikariPool",
         "\"topBlockedMonitorClass\" = 'com.zaxxer.hikari.pool.HikariPool'", '"{0}"'),
    ],
    "class-part": [
        ("topBlockedMonitorClass", "contains", None, "Hikari", "contains(\"topBlockedMonitorClass\", 'Hikari')", '"{0}"'),
        ("topBlockedMonitorClass", "matches", None, "(?i)HIKARIPOOL$", "regexp_matches(\"topBlockedMonitorClass\", '(?i)HIKARIPOOL$')", '"{0}"'),
        ("suspiciousTimedWaitingKeyFrame", "contains", None, "hikari", "contains(\"suspiciousTimedWaitingKeyFrame\", 'hikari')", '"{0}"'),
    ],
    "digits": [
        ("gcThreadCount", "contains", 2.0, None, "contains(CAST(CAST(\"gcThreadCount\" AS BIGINT) AS VARCHAR), '2')", WHOLE),
        ("totalThreadCount", "eq", None, "400", "false", WHOLE),
        ("threadCountAnomaly", "eq", 0.0, None, '"threadCountAnomaly" = 0', WHOLE),
    ],
    "text-number": [
        ("topBlockedMonitorClass", "gte", 0.0, None, "false", '"{0}"'),
        ("activeRequestThreadCount", "gte", None, "50", '"activeRequestThreadCount" >= 50', WHOLE),
    ],
    "thread-lock-contention": [
        ("blockedThreadCount", "lte", 1000.0, None, '"blockedThreadCount" <= 1000', WHOLE),
        ("synchronizedBlockedMonitorCount", "gte", 1.0, None, '"synchronizedBlockedMonitorCount" >= 1', WHOLE),
        ("suspiciousTimedWaitingKeyFrame", "matches", None, ".", "\"suspiciousTimedWaitingKeyFrame\" <> ''", '"{0}"'),
        ("dominantActiveFingerprintCount", "gt", 0.0, None, '"dominantActiveFingerprintCount" > 0', WHOLE),
        ("topBlockedMonitorClass", "matches", None, "^com", "starts_with(\"topBlockedMonitorClass\", 'com')", '"{0}"'),
        ("activeRequestThreadCount", "gte", 1.0, None, '"activeRequestThreadCount" >= 1', WHOLE),
    ],
    "unknown": [
        ("noSuchSignal", "gt", 0.0, None, "false", "'N/A'"),
        ("dominantFingerprints", "gt", 0.0, None, "false", "'N/A'"),
    ],
}
BUNDLED = {
    "gc-pressure": [("gcThreadCount", "gte", 15.0, None, '"gcThreadCount" >= 15', WHOLE)],
    "servlet-pool-saturation": [("activeRequestThreadCount", "gte", 50.0, None, '"activeRequestThreadCount" >= 50', WHOLE)],
}
DESCRIBED = {
    "gc-pressure": "JVM GC-related threads active in the dump (workers + infrastructure)",
    "servlet-pool-saturation": "Active HTTP request threads (thread name contains HTTP method + path)",
}
ALL = {**BUNDLED, **CUSTOM}
CONDITIONS_SQL = f"{SIGNALS_SQL}, cond AS (" + " UNION ALL ".join(
    f"SELECT case_id, '{sid}' AS signature_id, {i} AS cond_ord, '{c[0]}' AS field, ({c[4]}) AS matched, {c[5].format(c[0])} AS observed_value FROM sig"
    for sid, conds in ALL.items()
    for i, c in enumerate(conds)
) + ")"
SCORES_SQL = f"""{CONDITIONS_SQL}, sc AS (SELECT case_id, signature_id, avg(CAST(matched AS INT)) AS score,
  coalesce(string_agg(field, ',' ORDER BY cond_ord) FILTER (matched), '') AS matched,
  coalesce(string_agg(field, ',' ORDER BY cond_ord) FILTER (NOT matched), '') AS unmatched FROM cond GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, signature_id) AS rank FROM sc WHERE score > 0)"""


def custom(spark):
    rows = [
        (sid, sid.title(), "", "1", [(f, op, (num, text), f"{f} holds") for f, op, num, text, _, _ in conds], [], ["look"], [])
        for sid, conds in CUSTOM.items()
    ]
    return spark.createDataFrame(rows, sg.SIGNATURE)


def signature_set(spark):
    return sg.overlay(sg.bundled_signatures(spark), custom(spark))


@check(
    "signature_conditions",
    f"{CONDITIONS_SQL} SELECT case_id, signature_id, cond_ord, field, matched, observed_value FROM cond",
)
def signature_conditions(spark, sf):
    out = sm.evaluate_conditions(signals(spark, sf), signature_set(spark))
    return out.select("case_id", "signature_id", "cond_ord", "field", "matched", "observed_value")


@check(
    "signature_findings",
    f"""{SCORES_SQL} SELECT case_id, rank, signature_id, round(score, 6) AS score,
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence, matched, unmatched FROM f""",
)
def signature_findings(spark, sf):
    out = rematch(signals(spark, sf), signature_set(spark))
    fields = lambda c: F.array_join(F.transform(c, lambda x: x["field"]), ",")
    return out.select(
        "case_id", "rank", "signature_id", F.round("confidence_score", 6).alias("score"), "confidence",
        fields("matched_conditions").alias("matched"), fields("unmatched_conditions").alias("unmatched"),
    )


@check("signature_frequency", f"{SCORES_SQL} SELECT signature_id, count(DISTINCT case_id) AS cases FROM f GROUP BY 1")
def signature_frequencies(spark, sf):
    return signature_frequency(rematch(signals(spark, sf), signature_set(spark)))


def _frames(spark, sf):
    threads = stage(v.threads(spark, sf), "threads")
    return ds.fingerprints(threads), ds.fingerprint_members(threads), ds.blocked_monitors(threads)


@check(
    "evidence_stuck_frame",
    f"""{SIGNALS_SQL}, hit AS (SELECT t.case_id, t.name, t.dump_ord, fp.count, fp.first_ord, t.ord FROM fp
  JOIN sig ON sig.case_id = fp.case_id AND "suspiciousTimedWaitingKeyFrame" <> ''
    AND (contains(fp.key_frame, "suspiciousTimedWaitingKeyFrame") OR contains("suspiciousTimedWaitingKeyFrame", fp.key_frame))
  JOIN t ON t.dump_id = fp.dump_id AND t.signature = fp.signature),
o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY dump_ord, count DESC, first_ord, ord) AS n FROM hit),
u AS (SELECT case_id, name, min(n) AS n, count(*) AS raw FROM o GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n) AS place, sum(raw) OVER (PARTITION BY case_id) AS total FROM u)
SELECT case_id, concat('Affected thread names (', count(*), CASE WHEN max(total) > 20 THEN '+' ELSE '' END, '): ',
  string_agg(name, ', ' ORDER BY place)) AS line FROM k WHERE place <= 20 GROUP BY case_id""",
)
def evidence_stuck_frame(spark, sf):
    found, fps, members, _ = case_frames(spark, sf)
    return sm.stuck_frame_lines(found, fps, members).select("case_id", "line")


@check(
    "evidence_hot_path",
    f"""{DOM}, b AS (SELECT case_id, dump_id, signature, count, key_frame FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS r
  FROM dom WHERE state = 'RUNNABLE') WHERE r = 1),
n AS (SELECT b.case_id, t.name, t.ord, row_number() OVER (PARTITION BY b.case_id ORDER BY t.ord) AS place FROM b
  JOIN t ON t.dump_id = b.dump_id AND t.signature = b.signature),
l AS (SELECT case_id, string_agg(name, ', ' ORDER BY place) AS names, count(*) AS k FROM n WHERE place <= 20 GROUP BY case_id)
SELECT case_id, 0 AS line_ord, concat('Hot code path: ', key_frame) AS line FROM b
UNION ALL SELECT b.case_id, 1, concat('Affected thread names (', k, CASE WHEN count > 20 THEN '+' ELSE '' END, '): ', names) FROM b JOIN l ON l.case_id = b.case_id""",
)
def evidence_hot_path(spark, sf):
    fps, members, _ = _frames(spark, sf)
    dominant = cs.dominant_fingerprints(cs.largest_fingerprints(fps))
    return sm.hot_path_lines(dominant, members).select("case_id", "line_ord", "line")


@check(
    "evidence_monitor_class",
    f"""{SIGNALS_SQL}, m AS (SELECT mon.*, row_number() OVER (PARTITION BY mon.dump_id ORDER BY first_ord) AS pick FROM mon
  JOIN sig ON sig.case_id = mon.case_id AND "topBlockedMonitorClass" <> '' AND (contains(mon.monitor_class, "topBlockedMonitorClass")
    OR contains("topBlockedMonitorClass", mon.monitor_class))),
l AS (SELECT *, array_to_string(list_slice(string_split(names, ', '), 1, 15), ', ') AS shown FROM m WHERE pick = 1)
SELECT case_id, dump_ord AS line_group, concat('Lock holder: ', holder) AS line FROM l WHERE holder IS NOT NULL
UNION ALL SELECT case_id, dump_ord, concat('Waiting threads (', waiting_thread_count, '): ', shown) FROM l""",
)
def evidence_monitor_class(spark, sf):
    found, _, _, monitors = case_frames(spark, sf)
    return sm.monitor_class_lines(found, monitors).select("case_id", "line_group", "line")


URLS_SQL = f"""{DOM}, u AS (SELECT t.case_id, concat('GET ', regexp_extract(t.name, 'GET (/[^ ?]*)', 1)) AS url,
  row_number() OVER (PARTITION BY t.case_id ORDER BY t.dump_ord, fp.count DESC, fp.first_ord, t.ord) AS n
  FROM t JOIN fp ON fp.dump_id = t.dump_id AND fp.signature = t.signature WHERE t.name LIKE '% GET /%'),
g AS (SELECT case_id, url, count(*) AS threads, min(n) AS first FROM u GROUP BY 1, 2)"""


@check("evidence_request_urls", f"{URLS_SQL} SELECT case_id, url, threads FROM g")
def evidence_request_urls(spark, sf):
    fps, members, _ = _frames(spark, sf)
    return sm.request_urls(fps, members).select("case_id", "url", "threads")


@check(
    "evidence_top_urls",
    f"""{URLS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY threads DESC, first) AS place FROM g)
SELECT case_id, 0 AS line_ord, 'Top requested URLs:' AS line FROM r WHERE place = 1
UNION ALL SELECT case_id, place, concat('  ', threads, ' threads — ', url) FROM r WHERE place <= 5""",
)
def evidence_top_urls(spark, sf):
    fps, members, _ = _frames(spark, sf)
    return sm.request_url_lines(sm.request_urls(fps, members)).select("case_id", "line_ord", "line")


@check(
    "evidence_blocked_info",
    f"""{ADDR}, f AS (SELECT case_id, min(dump_ord) AS dump_ord FROM mon GROUP BY 1),
r AS (SELECT mon.*, row_number() OVER (PARTITION BY mon.case_id ORDER BY first_ord) AS place FROM mon JOIN f
  ON f.case_id = mon.case_id AND f.dump_ord = mon.dump_ord)
SELECT case_id, x.field, place - 1 AS line_ord, concat(waiting_thread_count, ' threads waiting on ', monitor_class,
  CASE WHEN holder IS NOT NULL THEN concat(' | lock held by: ', holder) ELSE '' END, ' — ',
  array_to_string(list_slice(string_split(names, ', '), 1, 10), ', ')) AS line
FROM r, (VALUES ('blockedThreadCount'), ('synchronizedBlockedMonitorCount')) x(field) WHERE place <= 5""",
)
def evidence_blocked_info(spark, sf):
    _, _, monitors = _frames(spark, sf)
    return sm.blocked_info_lines(monitors).select("case_id", "field", "line_ord", "line")


@check(
    "evidence_plan",
    f"""{v.WITH_THREADS}, d AS (SELECT case_id, count(DISTINCT concat(dump_id, '/', CAST(ord // {v.PIECE} AS VARCHAR))) AS dumps FROM t GROUP BY 1),
o AS (SELECT source AS case_id, count(*) AS logs FROM documents GROUP BY 1)
SELECT case_id, dumps AS thread_dumps, CAST(0 AS BIGINT) AS logs, CAST(0 AS BIGINT) AS parse_errors FROM d
UNION ALL SELECT case_id, 1, logs, 1 FROM o""",
)
def evidence_plan(spark, sf):
    """Evidence of two kinds of cases to findings: pieces of dumps, and documents beside a dump that can't be read."""
    dumps = v.jstack_text(spark, sf).select(
        "case_id", F.concat_ws("-", "dump_id", F.col("piece").cast("string")).alias("evidence_id"), (F.col("dump_ord") * 1000000 + F.col("piece")).alias("ord"),
        F.lit("jvm.tdump").alias("name"), "content",
    )
    docs = v.table(spark, sf, "documents")
    logs = docs.select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("evidence_id"), F.col("doc_id").alias("ord"), F.lit("a.log").alias("name"), F.col("text").alias("content"))
    broken = docs.select("source").distinct().select(F.col("source").alias("case_id"), F.lit("broken").alias("evidence_id"), F.lit(-1).cast("bigint").alias("ord"), F.lit("b.tdump").alias("name"), F.lit("cut off").alias("content"))
    plan = analyse_evidence(dumps.unionByName(logs).unionByName(broken), signature_set(spark))
    return plan.inputs.select("case_id", "thread_dumps", "logs", "parse_errors")


NAMED = {
    "gc-pressure": ("High Garbage Collection Pressure", [
        "Read the GC logs for full collections, long pauses and old-generation occupancy", "Check heap size and whether the old generation stays near its limit",
        "Profile allocation on hot request paths", "Look for caches that grow without a bound"]),
    "servlet-pool-saturation": ("Servlet Thread Pool Saturation", [
        "Find the most frequent method and path among the thread names in the evidence", "Check whether one page or endpoint dominates",
        "Check the cache hit rate for the hot path", "Compare with the pool limit and with downstream latency"]),
}
NAMED_SQL = " UNION ALL ".join(
    f"SELECT '{sid}' AS signature_id, '{name}' AS signature_name, '{' | '.join(steps)}' AS next_steps"
    for sid, (name, steps) in {**{sid: (sid.title(), ["look"]) for sid in CUSTOM}, **NAMED}.items()
)


def incident(spark, sf):
    """Findings and evidence rows, from dump text on: pieces of dumps to threads, the first piece of a dump tells its format."""
    text = stage(v.jstack_text(spark, sf), "text")
    heads = text.join(text.groupBy("dump_id").agg(F.min("piece").alias("piece")), ["dump_id", "piece"], "left_semi").select("case_id", "dump_id", "dump_ord", "content")
    frames = derive_signals(heads, stage(v.in_order(parse_threads(text)), "threads"))
    return match_cases(frames, signature_set(spark))


@check(
    "incident_findings",
    f"""{SCORES_SQL}, named AS ({NAMED_SQL}) SELECT case_id, rank, signature_id, signature_name, next_steps, round(score, 6) AS score, matched, unmatched,
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM f JOIN named USING (signature_id)""",
)
def incident_findings(spark, sf):
    found, _ = incident(spark, sf)
    fields = lambda c: F.array_join(F.transform(c, lambda x: x["field"]), ",")
    return found.select(
        "case_id", "rank", "signature_id", "signature_name", "confidence", F.round("confidence_score", 6).alias("score"),
        fields("matched_conditions").alias("matched"), fields("unmatched_conditions").alias("unmatched"), F.array_join("next_steps", " | ").alias("next_steps"),
    )


LINES = {  # the queries above that give the lines of a field: their name, the field, line group and place in the group
    "evidence_stuck_frame": ("'suspiciousTimedWaitingKeyFrame'", "0", "0"),
    "evidence_hot_path": ("'dominantActiveFingerprintCount'", "0", "line_ord"),
    "evidence_monitor_class": ("'topBlockedMonitorClass'", "line_group", "row_number() OVER (PARTITION BY case_id, line_group ORDER BY line LIKE 'Lock holder: %' DESC) - 1"),
    "evidence_top_urls": ("'activeRequestThreadCount'", "0", "line_ord"),
    "evidence_blocked_info": ("field", "0", "line_ord"),
}
LINES_SQL = " UNION ALL ".join(
    f"SELECT case_id, {field} AS field, CAST({group} AS BIGINT) AS line_group, {place} AS line_ord, line FROM ({CHECKS[name][1]})"
    for name, (field, group, place) in LINES.items()
)
WORDED_SQL = " UNION ALL ".join(
    f"SELECT '{sid}' AS signature_id, {i} AS cond_ord, '{DESCRIBED.get(sid, c[0] + ' holds')}' AS description" for sid, conds in ALL.items() for i, c in enumerate(conds)
)


EVIDENCE_SQL = f"""{SCORES_SQL}, worded AS ({WORDED_SQL}), lines AS ({LINES_SQL}),
hit AS (SELECT * FROM cond JOIN worded USING (signature_id, cond_ord) WHERE matched),
placed AS (SELECT case_id, signature_id, 0 AS part, cond_ord, 0 AS line_group, 0 AS line_ord, concat(description, ': ', observed_value) AS line FROM hit
  UNION ALL SELECT hit.case_id, signature_id, 1, cond_ord, line_group, line_ord, line FROM hit JOIN lines ON lines.case_id = hit.case_id AND lines.field = hit.field)"""


@check(
    "finding_evidence",
    f"""{EVIDENCE_SQL}
SELECT case_id, signature_id, row_number() OVER (PARTITION BY case_id, signature_id ORDER BY part, cond_ord, line_group, line_ord) AS place, line FROM placed""",
)
def finding_evidence(spark, sf):
    """Every evidence line of every finding in reading order, from dump text to lines."""
    _, evidence = incident(spark, sf)
    w = Window.partitionBy("case_id", "signature_id").orderBy("pos")
    return evidence.select("case_id", "signature_id", F.row_number().over(w).cast("bigint").alias("place"), "line")


@check(
    "signature_rematch",
    f"""{SCORES_SQL.replace('"blockedThreadCount" > 5', '"blockedThreadCount" > 7')}
SELECT case_id, rank, signature_id, round(score, 6) AS score, matched, (SELECT count(*) FROM sig) AS evaluated FROM f""",
)
def signature_rematch(spark, sf):
    """Stored results, one condition of one signature changed: only that condition is evaluated, once for every case."""
    cases, before = stage(signals(spark, sf), "signals"), signature_set(spark)
    edit = F.transform("conditions", lambda c: F.when(
        (c["field"] == "blockedThreadCount") & (c["operator"] == "gt"),
        F.struct(c["field"].alias("field"), c["operator"].alias("operator"), F.struct(F.lit(7.0).alias("num"), F.lit(None).cast("string").alias("str")).alias("value"), c["description"].alias("description")),
    ).otherwise(c))
    staging = Staging(spark, "results")
    store = ConditionStore(spark, f"{staging.root}/store")
    store.rematch(cases, before)
    run = store.rematch(cases, before.withColumn("conditions", edit))
    fields = F.array_join(F.transform("matched_conditions", lambda x: x["field"]), ",")
    return run.findings.select("case_id", "rank", "signature_id", F.round("confidence_score", 6).alias("score"), fields.alias("matched")).withColumn("evaluated", F.lit(run.evaluated.count()).cast("bigint"))


FINDING_BLOCKS = {
    0: "[concat('### [', CASE WHEN score >= 0.8 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END, '] ', signature_name), concat('Signature: [[', signature_id, ']]'), '', '**Evidence:**']",
    2: """list_concat(['', '**Next Steps:**'], list_transform(string_split(next_steps, ' | '), lambda x: concat('- [ ] ', x)),
    CASE WHEN signature_id = 'servlet-pool-saturation' THEN ['', '**Related:** [[thread-lock-contention]]', ''] ELSE [''] END)""",
}
FOUND_SQL = " UNION ALL ".join(
    f"SELECT case_id, 4 AS section, rank AS a, {b} AS b, unnest(range(len(x))) AS c, unnest(x) AS line, NULL AS part, NULL AS cond_ord, NULL AS line_group, NULL AS line_ord FROM (SELECT *, {x} AS x FROM f JOIN named USING (signature_id))"
    for b, x in FINDING_BLOCKS.items()
)


@check(
    "case_report_findings",
    f"""{EVIDENCE_SQL}, named AS ({NAMED_SQL}), r AS ({FOUND_SQL}
  UNION ALL SELECT p.case_id, 4, rank, 1, 0, concat('- ', line), part, cond_ord, line_group, line_ord FROM placed p JOIN f ON f.case_id = p.case_id AND f.signature_id = p.signature_id
  UNION ALL SELECT case_id, 1, dump_ord, 0, 0, concat('- [[thread-dump-', printf('%02d', dump_ord % 24), 'h00.txt]] — Thread dump at ', printf('%02d', dump_ord % 24), 'h00'), NULL, NULL, NULL, NULL
    FROM (SELECT DISTINCT case_id, dump_ord FROM t)
  UNION ALL SELECT DISTINCT case_id, 3, 0, 0, 0, '## Findings', NULL, NULL, NULL, NULL FROM f
  UNION ALL SELECT case_id, 8, 0, 0, 0, '_Not yet resolved_', NULL, NULL, NULL, NULL FROM sig)
SELECT case_id, CAST(section AS INTEGER) AS section, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS INTEGER) AS c, CAST(part AS INTEGER) AS part,
  CAST(cond_ord AS INTEGER) AS cond_ord, CAST(line_group AS BIGINT) AS line_group, CAST(line_ord AS INTEGER) AS line_ord, line FROM r""",
)
def case_report_findings(spark, sf):
    """Reports of open cases from dump text on: dumps, findings with all evidence, the closing line. A line's ``line_ord`` is its place in its group; ``case_report`` compares the other sections."""
    found, evidence = incident(spark, sf)
    dumps = v.thread_rows(spark, sf).select("case_id", "dump_id").distinct().withColumn("ord", F.substring("dump_id", 9, 2).cast("bigint"))
    midnight = F.lit("2024-01-01 00:00:00").cast("timestamp")
    listed = dumps.select("case_id", "ord", F.lit("thread-dump").alias("type"), F.timestamp_seconds(F.unix_seconds(midnight) + F.col("ord") % 24 * 3600).alias("captured_at"))
    none = F.lit(None).cast("string")
    cases = dumps.select("case_id").distinct().select(
        "case_id", F.lit("T").alias("title"), F.lit("open").alias("status"), none.alias("resolution"), none.alias("resolved_by"), midnight.alias("created_at")
    )
    report = cb.case_report_lines(cases, listed, stage(found, "found"), evidence).where("section IN (1, 4, 8) OR (section = 3 AND c = 0)")
    return report.select("case_id", "section", "a", "b", "c", "pos.part", "pos.cond_ord", "pos.line_group", "pos.line_ord", "line")
