"""Thread parsing, thread queries, dump and case signals: Spark query and DuckDB SQL side by side."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import views as v
from stallscope.functions.text import number_text
from stallscope.operators import case_signals as cs
from stallscope.operators import dump_signals as ds
from stallscope.operators import thread_query as q
from stallscope.session import Staging, remove_path, stage_all
from stallscope.sources.dumps import file_counts, parse_threads, read_dump_files
from stallscope.streaming import dump_watch as dw

CHECKS: dict[str, tuple] = {}
T = v.WITH_THREADS


def check(name: str, sql: str | None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn

    return add


def positioned(rows, *cols):
    """Result rows with their place in result order as a number (small results only)."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy("_pos"))).select("place", *cols)


# Parsing ----------------------------------------------------------------------------------------------

PARSED = [
    "case_id", "dump_id", "name", "state", "top_frame", "key_frame", "depth", "waiting_on", "waiting_class", "locked",
    "nid", "elapsed",
]


@check("parse_jstack", f"{T} SELECT {', '.join(PARSED)} FROM t")
def parse_jstack(spark, sf):
    return v.threads(spark, sf).select(
        *[c for c in PARSED if c not in ("depth", "locked")],
        F.size("frames").alias("depth"),
        F.get("locked_monitors", F.lit(0)).alias("locked"),
    )


@check(
    "parse_monitor_lines",
    f"""{T} SELECT dump_id, count(waiting_on) + count(locked) AS monitor_lines,
  count(waiting_on) AS waits, count(locked) AS locks FROM t GROUP BY dump_id""",
)
def parse_monitor_lines(spark, sf):
    return v.threads(spark, sf).groupBy("dump_id").agg(
        F.sum(F.size("monitor_lines")).alias("monitor_lines"),
        F.count("waiting_on").alias("waits"),
        F.sum(F.size("locked_monitors")).alias("locks"),
    )


@check(
    "parse_j9",
    f"""{T} SELECT dump_id, name, state, top_frame, replace(top_frame, '.', '/') AS raw_top_frame, depth,
  CASE WHEN gc THEN '' WHEN frame1 NOT LIKE 'java.%' AND frame1 NOT LIKE 'jdk.%' THEN frame1
       WHEN frame2 NOT LIKE 'java.%' THEN frame2 ELSE frame3 END AS key_frame FROM t""",
)
def parse_j9(spark, sf):
    parsed = parse_threads(v.j9_text(spark, sf))
    return parsed.select(
        "dump_id", "name", "state", "top_frame", F.coalesce(F.get("raw_frames", F.lit(0)), F.lit("")).alias("raw_top_frame"),
        F.size("frames").alias("depth"), "key_frame",
    )


@check(
    "thread_file_counts",
    f"""{T} SELECT source_file, count(name) AS thread_count,
  CASE WHEN count(name) = 0 THEN 'no threads found' END AS parse_error
FROM (SELECT concat(dump_id, '-', CAST(ord // {v.PIECE} AS VARCHAR)) AS source_file, name FROM t
      UNION ALL SELECT concat('doc-', CAST(doc_id AS VARCHAR)), NULL FROM documents) GROUP BY source_file""",
)
def thread_file_counts(spark, sf):
    dumps = v.jstack_text(spark, sf).select(
        F.concat("dump_id", F.lit("-"), F.col("piece").cast("string")).alias("source_file"), "content"
    )
    docs = v.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_file"), F.col("text").alias("content")
    )
    every = dumps.unionByName(docs)
    return file_counts(every, parse_threads(every))


# Thread query -----------------------------------------------------------------------------------------

CLASS_SQL = r"CASE WHEN key_frame = '' THEN '' ELSE regexp_replace(regexp_replace(key_frame, '\(.*\)$', ''), '\.[^.]*$', '') END"
METHOD_SQL = r"regexp_extract(regexp_replace(key_frame, '\(.*\)$', ''), '[^.]*$')"
PACKAGE_SQL = rf"regexp_replace({CLASS_SQL}, '\.[^.]*$', '')"
URL_SQL = r"nullif(regexp_extract(name, '\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+(/\S*)', 1), '')"
ROWS = f"""{T}, r AS (SELECT dump_ord, ord, name AS thread, state, depth AS stackdepth, key_frame AS keyframe,
  {CLASS_SQL} AS class, {PACKAGE_SQL} AS package, {METHOD_SQL} AS method, top_frame AS topframe, elapsed, nid,
  {URL_SQL} AS url, frame1, frame2, frame3, gc, waiting_on, locked FROM t)"""


@check("query_rows", f"{ROWS} SELECT thread, state, stackdepth, keyframe, class, package, method, topframe, elapsed, nid, url FROM r")
def query_rows(spark, sf):
    return q.ThreadQuery().run(v.threads(spark, sf)).drop("_pos")


PREDICATES = {
    "state equals": (lambda: q.equals("state", "blocked"), "state = 'BLOCKED'"),
    "thread glob": (lambda: q.equals("thread", "*B2C*"), "thread ILIKE '%b2c%'"),
    "one letter glob": (lambda: q.equals("thread", "pool-b2c-?"), "thread ILIKE 'pool-b2c-_'"),
    "missing is blank": (lambda: q.equals("url", ""), "url IS NULL"),
    "any frame": (lambda: q.equals("frame", "*HikariPool.get*"), "NOT gc AND frame1 LIKE '%HikariPool.get%'"),
    "any monitor line": (lambda: q.equals("frame", "- locked*"), "locked IS NOT NULL"),
    "no frame": (lambda: q.differs("frame", "*ServiceRegistry*"), "gc OR frame2 NOT LIKE '%ServiceRegistry%'"),
    "not glob": (lambda: q.differs("thread", "*b2c*"), "thread NOT ILIKE '%b2c%'"),
    "not equal": (lambda: q.differs("state", "runnable"), "state <> 'RUNNABLE'"),
    "depth at least": (lambda: q.compares("stackdepth", ">=", "3"), "stackdepth >= 3"),
    "elapsed below": (lambda: q.compares("elapsed", "<", 10), "elapsed < 10"),
    "text is no number": (lambda: q.compares("state", ">=", 0), "false"),
    "missing is zero": (lambda: q.compares("url", "<=", 0), "url IS NULL"),
    "hex is a number": (lambda: q.compares("nid", ">", 300), "CAST(concat('0x', substr(nid, 3)) AS BIGINT) > 300"),
    "number differs": (lambda: q.differs("stackdepth", "3"), "stackdepth <> 3"),
    "text differs from number": (lambda: q.differs("state", 5), "true"),
    "in list": (lambda: q.one_of("state", ["blocked", " waiting"]), "state IN ('BLOCKED', 'WAITING')"),
    "and": (lambda: q.all_of(q.equals("state", "WAITING"), q.equals("thread", "*b2c*")), "state = 'WAITING' AND thread LIKE '%b2c%'"),
    "or": (lambda: q.some_of(q.equals("state", "WAITING"), q.equals("thread", "*b2c*")), "state = 'WAITING' OR thread LIKE '%b2c%'"),
    "unknown field": (lambda: q.equals("colour", "red"), "false"),
    "url glob": (lambda: q.equals("url", "/content/1?.html"), "coalesce(url, '') ILIKE '/content/1_.html'"),
    "class equals": (lambda: q.equals("class", "com.example.job.step1"), "class ILIKE 'com.example.job.step1'"),
}


@check(
    "query_predicates",
    ROWS + " " + " UNION ALL ".join(f"SELECT '{n}' AS predicate, count(*) AS rows FROM r WHERE {sql}" for n, (_, sql) in PREDICATES.items()),
)
def query_predicates(spark, sf):
    threads = v.threads(spark, sf)
    one = threads.agg(*[F.count_if(p()).alias(n) for n, (p, _) in PREDICATES.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("predicate"), F.col(f"`{n}`").alias("rows")) for n in PREDICATES])
    return one.select(F.inline(pairs))


@check(
    "query_blocked_by_keyframe",
    f"""{ROWS}, g AS (SELECT keyframe, count(*) AS count, min(dump_ord * 1000000000 + ord) AS first FROM r
  WHERE state = 'BLOCKED' GROUP BY keyframe)
SELECT row_number() OVER (ORDER BY count DESC, first) AS place, keyframe, count FROM g ORDER BY count DESC, first LIMIT 5""",
)
def query_blocked_by_keyframe(spark, sf):
    query = q.ThreadQuery().where(q.equals("state", "BLOCKED")).stats_count("keyframe").top(5)
    return positioned(query.run(v.threads(spark, sf)), "keyframe", "count")


@check(
    "query_stats_by_two",
    f"""{ROWS}, g AS (SELECT state, coalesce(url, '') AS url, count(*) AS count, min(dump_ord * 1000000000 + ord) AS first
  FROM r WHERE thread LIKE '10.0.0%' OR thread LIKE 'pool%' GROUP BY 1, 2)
SELECT row_number() OVER (ORDER BY count DESC, first) AS place, state, url, count FROM g""",
)
def query_stats_by_two(spark, sf):
    some = q.some_of(q.equals("thread", "10.0.0*"), q.equals("thread", "pool*"))
    return positioned(q.ThreadQuery().stats_count("state", "url").where(some).run(v.threads(spark, sf)), "state", "url", "count")


@check(
    "query_dedup",
    f"""{ROWS} SELECT thread, state, url, elapsed FROM (SELECT *, row_number() OVER (PARTITION BY url, state ORDER BY dump_ord, ord) AS rn FROM r)
WHERE url IS NULL OR rn = 1""",
)
def query_dedup(spark, sf):
    return q.ThreadQuery().dedup("url", "state").run(v.threads(spark, sf)).select("thread", "state", "url", "elapsed")


@check(
    "query_top",
    f"""{ROWS} SELECT row_number() OVER (ORDER BY dump_ord, ord) AS place, thread, keyframe FROM r WHERE state = 'WAITING'
ORDER BY dump_ord, ord LIMIT 7""",
)
def query_top(spark, sf):
    query = q.ThreadQuery().top(7).where(q.equals("state", "WAITING"))
    return positioned(query.run(v.threads(spark, sf)), "thread", "keyframe")


@check(
    "query_dedup_then_count",
    f"{ROWS} SELECT count(DISTINCT url) + count(*) FILTER (url IS NULL) AS count FROM r WHERE state = 'BLOCKED'",
)
def query_dedup_then_count(spark, sf):
    return q.ThreadQuery().where(q.equals("state", "BLOCKED")).dedup("url").stats_count().run(v.threads(spark, sf)).drop("_pos")


@check(
    "query_stats_of_stats",
    f"""{ROWS}, g AS (SELECT state, method, count(*) AS c FROM r GROUP BY 1, 2),
s AS (SELECT state, count(*) AS count, min(-c) AS most FROM g GROUP BY state) SELECT state, count FROM s""",
)
def query_stats_of_stats(spark, sf):
    return q.ThreadQuery().stats_count("state", "method").stats_count("state").run(v.threads(spark, sf)).drop("_pos")


@check("query_total_matched", f"{ROWS} SELECT count(*) AS total_matched FROM r WHERE state = 'WAITING' AND stackdepth >= 3")
def query_total_matched(spark, sf):
    query = q.ThreadQuery().where(q.equals("state", "WAITING")).where(q.compares("stackdepth", ">=", 3)).dedup("url").top(3)
    return query.total_matched(v.threads(spark, sf))


@check(
    "query_share_bar",
    f"""{ROWS}, g AS (SELECT state, count(*) AS count FROM r GROUP BY state)
SELECT state, count, CAST(floor(100.0 * count / (SELECT max(count) FROM g) + 0.5) AS BIGINT) AS share FROM g""",
)
def query_share_bar(spark, sf):
    return q.with_share(q.ThreadQuery().stats_count("state").run(v.threads(spark, sf))).drop("_pos")


@check(
    "query_sorted",
    f"""{ROWS}, g AS (SELECT method, count(*) AS count FROM r GROUP BY method)
SELECT row_number() OVER (ORDER BY method DESC) AS place, method, count FROM g""",
)
def query_sorted(spark, sf):
    rows = q.sort_result(q.ThreadQuery().stats_count("method").run(v.threads(spark, sf)), "method", descending=True)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("method"))).alias("place"), "method", "count")


# Dump signals -----------------------------------------------------------------------------------------

COUNTS_SQL = """count(*) AS total_thread_count,
  count(*) FILTER (state = 'RUNNABLE') AS runnable_count, count(*) FILTER (state = 'BLOCKED') AS blocked_count,
  count(*) FILTER (state = 'WAITING') AS waiting_count, count(*) FILTER (state = 'TIMED_WAITING') AS timed_waiting_count,
  CAST(0 AS BIGINT) AS new_count, CAST(0 AS BIGINT) AS terminated_count,
  count(*) FILTER (NOT gc AND frame1 LIKE 'java.net.%') AS io_thread_count, count(*) FILTER (gc) AS gc_thread_count,
  count(*) FILTER (name LIKE '% GET /%') AS active_request_thread_count"""


@check("dump_counts", f"{T} SELECT case_id, dump_id, dump_ord, {COUNTS_SQL} FROM t GROUP BY 1, 2, 3")
def dump_counts(spark, sf):
    return ds.thread_counts(v.threads(spark, sf))


@check(
    "dump_counts_j9",
    f"""{T} SELECT dump_id, count(*) AS total_thread_count, count(*) FILTER (state = 'BLOCKED') AS blocked_count,
  count(*) FILTER (NOT gc AND frame1 LIKE 'java.net.%') AS io_thread_count, count(*) FILTER (gc) AS gc_thread_count
FROM t GROUP BY dump_id""",
)
def dump_counts_j9(spark, sf):
    counts = ds.thread_counts(v.in_order(parse_threads(v.j9_text(spark, sf))))
    return counts.select("dump_id", "total_thread_count", "blocked_count", "io_thread_count", "gc_thread_count")


FPS = f"""{T}, fp AS (SELECT case_id, dump_id, dump_ord, signature, count(*) AS count, min(ord) AS first_ord,
  arg_min(state, ord) AS state, arg_min(key_frame, ord) AS key_frame, arg_min(top_frame, ord) AS top_frame
  FROM t WHERE NOT gc GROUP BY 1, 2, 3, 4)"""


@check("fingerprints", f"{FPS} SELECT case_id, dump_id, signature, count, state, key_frame, top_frame FROM fp")
def fingerprints(spark, sf):
    return ds.fingerprints(v.threads(spark, sf)).select(
        "case_id", "dump_id", "signature", "count", "state", "key_frame", "top_frame"
    )


@check(
    "fingerprint_names",
    f"""{T}, n AS (SELECT dump_id, signature, ord, name, row_number() OVER (PARTITION BY dump_id, signature ORDER BY ord) AS rn FROM t WHERE NOT gc)
SELECT dump_id, signature, string_agg(name, ', ' ORDER BY rn) AS names FROM n WHERE rn <= 20 GROUP BY 1, 2""",
)
def fingerprint_names(spark, sf):
    members = ds.fingerprint_members(v.threads(spark, sf))
    names = ds.first_names(members, [*ds.KEYS, "signature"], 20, ["ord"])
    return names.select("dump_id", "signature", F.array_join("names", ", ").alias("names"))


MONS = f"""{FPS}, w AS (SELECT *, row_number() OVER (PARTITION BY dump_id, waiting_on ORDER BY ord) AS rn FROM t WHERE waiting_on IS NOT NULL),
h AS (SELECT dump_id, locked, arg_min(name, ord) AS holder FROM t WHERE locked IS NOT NULL GROUP BY 1, 2),
mon AS (SELECT w.case_id, w.dump_id, w.dump_ord, w.waiting_on AS monitor_address, count(*) AS waiting_thread_count,
  arg_min(waiting_class, ord) AS monitor_class, min(ord) AS first_ord,
  string_agg(name, ', ' ORDER BY rn) FILTER (rn <= 20) AS names, any_value(h.holder) AS holder
  FROM w LEFT JOIN h ON h.dump_id = w.dump_id AND h.locked = w.waiting_on GROUP BY 1, 2, 3, 4)"""


@check("blocked_monitors", f"{MONS} SELECT dump_id, monitor_address, waiting_thread_count, monitor_class, names, holder FROM mon")
def blocked_monitors(spark, sf):
    return ds.blocked_monitors(v.threads(spark, sf)).select(
        "dump_id", "monitor_address", "waiting_thread_count", "monitor_class",
        F.array_join("waiting_thread_names", ", ").alias("names"), F.col("lock_holder_thread").alias("holder"),
    )


@check(
    "generic_dumps",
    r"""WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, E' \t\r\f\v')) AS ls FROM documents)
SELECT doc_id, greatest(len(list_filter(ls, lambda x: regexp_matches(x, '^"[^"]+"') OR regexp_matches(x, '(?i)Thread-\d+'))), 1) AS total_thread_count,
  len(list_filter(ls, lambda x: regexp_matches(x, '(?i)^(GC |Gang |G1 |ConcurrentMark|concurrent mark|ZWorker|Shenandoah|MM |GCWorker)'))) AS gc_thread_count,
  len(list_filter(ls, lambda x: starts_with(x, 'at ') OR regexp_matches(x, '^\w[\w.$]+\([\w.$]+:\d+\)'))) AS frames
FROM l""",
)
def generic_dumps(spark, sf):
    docs = v.table(spark, sf, "documents").select(
        F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("dump_id"), F.col("doc_id").alias("dump_ord"),
        F.col("text").alias("content"),
    )
    return ds.generic_dumps(docs).select(
        F.col("dump_ord").alias("doc_id"), "total_thread_count", "gc_thread_count", F.size("frames").cast("bigint").alias("frames")
    )


# Case signals -----------------------------------------------------------------------------------------

DOM = f"""{MONS}, inst AS (SELECT *, count(*) OVER (PARTITION BY case_id, signature) AS dumps,
  row_number() OVER (PARTITION BY case_id, signature ORDER BY count DESC, dump_ord DESC) AS pick,
  row_number() OVER (PARTITION BY case_id ORDER BY dump_ord, count DESC, first_ord) AS seen FROM fp),
large AS (SELECT i.*, s.seen_first FROM inst i JOIN (SELECT case_id, signature, min(seen) AS seen_first FROM inst GROUP BY 1, 2) s
  USING (case_id, signature) WHERE pick = 1),
dom AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY count DESC, seen_first) AS rank FROM large
  WHERE dumps > 1 OR count > 50) WHERE rank <= 10)"""


@check("dominant_fingerprints", f"{DOM} SELECT case_id, rank, signature, count, dump_id, state, key_frame FROM dom")
def dominant_fingerprints(spark, sf):
    large = cs.largest_fingerprints(ds.fingerprints(v.threads(spark, sf)))
    return cs.dominant_fingerprints(large).select("case_id", "rank", "signature", "count", "dump_id", "state", "key_frame")


@check(
    "stuck_stacks",
    f"""{DOM}, s AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank) AS place FROM dom
  WHERE state IN ('BLOCKED', 'WAITING', 'TIMED_WAITING') AND key_frame NOT LIKE 'java.%' AND key_frame NOT LIKE 'jdk.%'),
nm AS (SELECT t.case_id, t.dump_id, t.signature, name, t.ord, row_number() OVER (PARTITION BY t.case_id, t.dump_id, t.signature ORDER BY t.ord) AS k FROM t WHERE t.signature IS NOT NULL),
l AS (SELECT case_id, dump_id, signature, string_agg(name, ', ' ORDER BY k) AS names FROM nm WHERE k <= 10 GROUP BY 1, 2, 3)
SELECT s.case_id, place, key_frame AS display_frame, count, state, names FROM s JOIN l ON l.case_id = s.case_id AND l.dump_id = s.dump_id AND l.signature = s.signature WHERE place <= 8""",
)
def stuck_stacks(spark, sf):
    threads = stage_all({"threads": v.threads(spark, sf)})["threads"]
    stuck = cs.stuck_stacks(cs.dominant_fingerprints(cs.largest_fingerprints(ds.fingerprints(threads))))
    named = cs.with_thread_names(stuck, ds.fingerprint_members(threads))
    return named.select("case_id", "place", "display_frame", "count", "state", F.array_join("thread_names", ", ").alias("names"))


ADDR = f"""{MONS}, addr AS (SELECT case_id, monitor_address, count(*) AS dumps, max(waiting_thread_count) AS waiters,
  min(dump_ord * 1000000000 + first_ord) AS seen FROM mon GROUP BY 1, 2),
best AS (SELECT m.case_id, m.monitor_address, m.monitor_class, m.holder, a.dumps, a.waiters, a.seen,
  row_number() OVER (PARTITION BY m.case_id, m.monitor_address ORDER BY m.dump_ord) AS pick
  FROM mon m JOIN addr a ON a.case_id = m.case_id AND a.monitor_address = m.monitor_address AND a.waiters = m.waiting_thread_count)"""


@check(
    "top_monitors",
    f"""{ADDR} SELECT case_id, rank, monitor_address, waiting_thread_count, monitor_class, lock_holder_thread FROM (
  SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY waiters DESC, seen) AS rank, monitor_address,
  waiters AS waiting_thread_count, monitor_class, holder AS lock_holder_thread FROM best WHERE pick = 1) WHERE rank <= 5""",
)
def top_monitors(spark, sf):
    return cs.top_monitors(cs.case_monitors(ds.blocked_monitors(v.threads(spark, sf)))).select(
        "case_id", "rank", "monitor_address", "waiting_thread_count", "monitor_class", "lock_holder_thread"
    )


@check("persistent_monitors", f"{ADDR} SELECT case_id, monitor_address, dumps FROM addr WHERE dumps > 1")
def persistent_monitors(spark, sf):
    return cs.persistent_monitors(cs.case_monitors(ds.blocked_monitors(v.threads(spark, sf))))


SIGNALS_SQL = f"""{DOM}, c AS (SELECT case_id, dump_id, dump_ord, {COUNTS_SQL} FROM t GROUP BY 1, 2, 3),
cc AS (SELECT case_id, CAST(max(total_thread_count) AS DOUBLE) AS n, avg(total_thread_count) AS avg_n, max(blocked_count) AS blocked,
  max(waiting_count) AS waiting, max(timed_waiting_count) AS timed, max(io_thread_count) AS io, max(gc_thread_count) AS gcs,
  max(active_request_thread_count) AS active, avg(io_thread_count / total_thread_count) AS io_ratio FROM c GROUP BY case_id),
addr AS (SELECT case_id, monitor_address, count(*) AS dumps, max(waiting_thread_count) AS waiters,
  min(dump_ord * 1000000000 + first_ord) AS seen FROM mon GROUP BY 1, 2),
best AS (SELECT m.case_id, m.monitor_class, a.waiters, a.seen,
  row_number() OVER (PARTITION BY m.case_id ORDER BY a.waiters DESC, a.seen, m.dump_ord) AS pick FROM mon m
  JOIN addr a ON a.case_id = m.case_id AND a.monitor_address = m.monitor_address AND a.waiters = m.waiting_thread_count),
susp AS (SELECT case_id, key_frame, count, row_number() OVER (PARTITION BY case_id ORDER BY count DESC, dump_ord, first_ord) AS pick
  FROM fp WHERE state = 'TIMED_WAITING' AND signature NOT LIKE '%LinkedBlockingQueue.take%'),
bn AS (SELECT DISTINCT t.dump_id, t.name FROM t JOIN fp ON fp.dump_id = t.dump_id AND fp.signature = t.signature AND fp.state = 'BLOCKED'),
sy AS (SELECT case_id, max(n) AS n FROM (SELECT w.case_id, w.dump_id, count(DISTINCT w.waiting_on) AS n FROM w
  JOIN bn ON bn.dump_id = w.dump_id AND bn.name = w.name WHERE w.rn <= 20 GROUP BY 1, 2) GROUP BY case_id),
act AS (SELECT case_id, max(count) AS n FROM large WHERE state = 'RUNNABLE' GROUP BY case_id),
sig AS (SELECT cc.case_id, cc.n AS "totalThreadCount", cc.avg_n AS "avgThreadCount", CAST(blocked AS DOUBLE) AS "blockedThreadCount",
  CAST(waiting AS DOUBLE) AS "waitingThreadCount", CAST(timed AS DOUBLE) AS "timedWaitingThreadCount",
  CAST(coalesce(s.count, 0) AS DOUBLE) AS "suspiciousTimedWaitingCount", CAST(io AS DOUBLE) AS "ioThreadCount",
  CAST(gcs AS DOUBLE) AS "gcThreadCount", CAST(coalesce(d.count, 0) AS DOUBLE) AS "dominantFingerprintCount",
  coalesce(d.count, 0) / cc.n AS "dominantFingerprintRatio",
  CAST((SELECT count(*) FROM addr a WHERE a.case_id = cc.case_id AND a.dumps > 1) AS DOUBLE) AS "persistentBlockedMonitors",
  CAST(coalesce(b.waiters, 0) AS DOUBLE) AS "maxBlockedOnSingleMonitor",
  CAST(coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM mon m WHERE m.case_id = cc.case_id GROUP BY m.dump_id)), 0) AS DOUBLE) AS "blockedMonitorCount",
  CASE WHEN cc.n > 500 THEN 1.0 ELSE 0.0 END AS "threadCountAnomaly", CASE WHEN io_ratio > 0.15 THEN 1.0 ELSE 0.0 END AS "ioSaturationDetected",
  CAST(coalesce(sy.n, 0) AS DOUBLE) AS "synchronizedBlockedMonitorCount", CAST(coalesce(act.n, 0) AS DOUBLE) AS "dominantActiveFingerprintCount",
  coalesce(act.n, 0) / cc.n AS "dominantActiveFingerprintRatio", CAST(active AS DOUBLE) AS "activeRequestThreadCount",
  coalesce(s.key_frame, '') AS "suspiciousTimedWaitingKeyFrame", coalesce(b.monitor_class, '') AS "topBlockedMonitorClass"
  FROM cc LEFT JOIN susp s ON s.case_id = cc.case_id AND s.pick = 1 LEFT JOIN dom d ON d.case_id = cc.case_id AND d.rank = 1
  LEFT JOIN best b ON b.case_id = cc.case_id AND b.pick = 1 LEFT JOIN sy ON sy.case_id = cc.case_id LEFT JOIN act ON act.case_id = cc.case_id)"""
RATIOS = {"avgThreadCount", "dominantFingerprintRatio", "dominantActiveFingerprintRatio"}
SIGNAL_COLUMNS = ", ".join(
    [f'round("{c}", 6) AS "{c}"' for c in cs.NUMBER_SIGNALS] + [f'"{c}"' for c in cs.TEXT_SIGNALS]
)


def case_frames(spark, sf):
    """Signals of cases and the frames they come from, threads read once; what feeds several branches is a table."""
    parsed = stage_all({"threads": v.threads(spark, sf)})["threads"]
    reduced = stage_all({"fps": ds.fingerprints(parsed), "monitors": ds.blocked_monitors(parsed)})
    members = ds.fingerprint_members(parsed)
    found = cs.case_signals(ds.thread_counts(parsed), reduced["fps"], members, reduced["monitors"])
    return found, reduced["fps"], members, reduced["monitors"]


def signals(spark, sf):
    return case_frames(spark, sf)[0]


@check("case_signals", f"{SIGNALS_SQL} SELECT case_id, {SIGNAL_COLUMNS} FROM sig")
def case_signals(spark, sf):
    return signals(spark, sf).select(
        "case_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in cs.NUMBER_SIGNALS], *cs.TEXT_SIGNALS
    )


@check(
    "dump_watch",
    f"""{T}, days AS (SELECT *, CAST(substr(dump_id, 9, 2) AS INT) AS d FROM t)
SELECT dump_id AS dump, state, count(*) AS n, sum(CAST(substr(nid, 3) AS BIGINT)) AS nids FROM days
WHERE d % 5 <> 0 AND (d % 2 = 1 OR ord % 2 = 0) GROUP BY 1, 2""",
)
def dump_watch(spark, sf):
    """Dump files with half of the threads, then rewritten whole on odd days and deleted on every fifth: the folder as it is."""
    staging = Staging(spark, "watched")
    folder, table = f"{staging.root}/dumps", f"{staging.root}/parsed"
    days = v.thread_rows(spark, sf).select("dump_id").distinct()

    def write(pieces, mode):
        rows = pieces.select("dump_id", "piece", "content").repartition("dump_id").sortWithinPartitions("dump_id", "piece")
        rows = rows.select(F.col("dump_id").alias("dump"), "content")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("lineSep", "\n\n").partitionBy("dump").text(folder)

    write(v.jstack_text(spark, sf, F.col("ord") % 2 == 0), "append")
    dw.refresh(spark, folder, table, 0)
    write(v.jstack_text(spark, sf).where("dump_ord % 2 = 1"), "overwrite")
    dw.refresh(spark, folder, table, 1)
    for (day,) in days.where("CAST(substr(dump_id, 9, 2) AS INT) % 5 = 0").collect():  # days of a month
        remove_path(spark, f"{folder}/dump={day}")
    threads = dw.refresh(spark, folder, table, 2)
    dump = F.regexp_extract("source_file", "dump=([0-9-]+)", 1).alias("dump")
    return threads.groupBy(dump, "state").agg(F.count("*").alias("n"), F.sum(F.substring("nid", 3, 20).cast("bigint")).alias("nids"))


@check("query_rows_kept", f"{T} SELECT dump_id, name AS thread, depth, frame1, frame3, locked FROM t WHERE state = 'BLOCKED' AND NOT gc")
def query_rows_kept(spark, sf):
    """Frames and monitor lines that a query carries along."""
    rows = q.ThreadQuery().where(q.equals("state", "blocked"), q.differs("thread", "GC task*")).run(v.threads(spark, sf), keep=("dump_id", "frames", "locked_monitors"))
    return rows.select(
        "dump_id", "thread", F.size("frames").alias("depth"), F.col("frames")[0].alias("frame1"), F.col("frames")[2].alias("frame3"),
        F.get("locked_monitors", F.lit(0)).alias("locked"),
    )


@check("dump_files_of_paths", f"{T} SELECT dump_id AS dump, state, count(*) AS n FROM t WHERE ord % 3 = 0 OR CAST(substr(dump_id, 9, 2) AS INT) % 2 = 1 GROUP BY 1, 2")
def dump_files_of_paths(spark, sf):
    """Dump files in two folders, one with files that the pattern leaves out, read together."""
    root = Staging(spark, "dump-paths").root
    odd = F.col("dump_ord") % 2 == 1
    for name, pieces in (("odd", v.jstack_text(spark, sf).where(odd)), ("even", v.jstack_text(spark, sf, F.col("ord") % 3 == 0).where(~odd))):
        rows = pieces.repartition("dump_id").sortWithinPartitions("dump_id", "piece").select(F.col("dump_id").alias("dump"), "content")
        rows.write.option("lineSep", "\n\n").partitionBy("dump").text(f"{root}/{name}")
    rows.select("content").write.option("compression", "gzip").mode("append").text(f"{root}/even/dump=2000-01-01")
    files = read_dump_files(spark, [f"{root}/odd/*", f"{root}/even/*"], "*.txt")
    threads = parse_threads(files.withColumn("dump_ord", F.lit(0)))
    return threads.groupBy(F.regexp_extract("source_file", "dump=([0-9-]+)", 1).alias("dump"), "state").agg(F.count("*").alias("n"))


@check(
    "case_signals_of_all_cases",
    f"""{SIGNALS_SQL}, every AS (SELECT DISTINCT concat('case-', CAST(n_nationkey AS VARCHAR(10))) AS case_id FROM nation)
SELECT e.case_id, {', '.join(f'coalesce(round("{c}", 6), 0) AS "{c}"' for c in cs.NUMBER_SIGNALS)}, {', '.join(f'coalesce("{c}", {chr(39) * 2}) AS "{c}"' for c in cs.TEXT_SIGNALS)}
FROM every e LEFT JOIN sig USING (case_id)""",
)
def case_signals_of_all_cases(spark, sf):
    """Cases without a dump have signals of zero."""
    parsed = stage_all({"threads": v.threads(spark, sf)})["threads"]
    reduced = stage_all({"fps": ds.fingerprints(parsed), "monitors": ds.blocked_monitors(parsed)})
    cases = v.table(spark, sf, "nation").select(F.concat(F.lit("case-"), F.col("n_nationkey").cast("string")).alias("case_id")).distinct()
    out = cs.case_signals(ds.thread_counts(parsed), reduced["fps"], ds.fingerprint_members(parsed), reduced["monitors"], cases)
    return out.select("case_id", *[F.round(c, 6).alias(c) for c in cs.NUMBER_SIGNALS], *cs.TEXT_SIGNALS)
