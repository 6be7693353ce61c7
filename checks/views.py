"""Views over the driver's tables, in SQL that Spark and DuckDB read alike (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallscope.sources.dumps import parse_threads

CDN_LOGS = """
SELECT event_id AS ord, ts AS time_start,
  concat('svc-', CAST(user_id % 4 AS VARCHAR(10))) AS aem_service,
  CASE WHEN user_id % 10 = 0 THEN 'author' ELSE 'publish' END AS aem_tier,
  concat('/', event_type, '/', CAST(k AS VARCHAR(10))) AS url,
  CASE WHEN user_id = 149 AND event_id % 4 = 0 THEN 'ZZZ' WHEN user_id % 5 = 0 THEN 'FRA'
       WHEN user_id % 5 = 1 THEN 'LHR' WHEN user_id % 5 = 2 THEN 'AMS' ELSE 'BMA' END AS pop,
  CASE WHEN event_id % 10 < 4 THEN 'MISS' WHEN event_id % 10 = 4 THEN 'MISS-CLUSTER'
       WHEN event_id % 10 < 7 THEN 'HIT' WHEN event_id % 10 = 7 THEN 'HIT-STALE'
       WHEN event_id % 20 = 8 THEN 'PASS' WHEN event_id % 20 = 18 THEN 'HITPASS' ELSE '' END AS cache_status,
  CASE WHEN event_id % 20 = 9 THEN 'HIT' ELSE '' END AS fastly_info_state,
  CASE WHEN event_id % 3 = 0 THEN 'ERROR' ELSE 'MISS' END AS response_x_cache,
  CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 429 WHEN event_type = 'error' AND k % 3 = 1 THEN 503
       WHEN event_type = 'error' THEN 404 WHEN k % 17 = 0 THEN 301 ELSE 200 END AS status,
  CASE WHEN event_type = 'error' AND k % 3 = 1 THEN 503 WHEN k % 29 = 0 THEN 429 ELSE 200 END AS origin_status,
  CASE WHEN user_id % 6 = 0 THEN 'Generic Bot' WHEN user_id % 6 = 1 THEN '-' WHEN user_id % 12 = 2 THEN 'Search Bot' ELSE '' END AS bot_name,
  concat('10.0.', CAST(user_id % 8 AS VARCHAR(10)), '.', CAST(user_id AS VARCHAR(10))) AS client_ip,
  CASE WHEN user_id % 7 = 0 THEN '20940' WHEN user_id % 7 = 1 THEN '16509' ELSE '7922' END AS client_as_number,
  CASE WHEN user_id % 7 = 0 THEN 'akamai international b.v.' WHEN user_id % 7 = 1 THEN 'amazon.com, inc.' ELSE 'comcast cable' END AS client_as_name,
  concat('agent/', CAST(user_id % 9 AS VARCHAR(10))) AS request_user_agent,
  CASE WHEN user_id % 3 = 0 THEN 'US' WHEN user_id % 3 = 1 THEN 'DE' ELSE 'JP' END AS geo_country_code,
  CAST(k * 10 AS DOUBLE) AS response_ttl, (k % 2 = 0) AS shielding_used, (event_id % 10 <> 4) AS is_cacheable,
  CASE WHEN event_id % 20 = 8 AND k % 2 = 0 THEN 'pass_noheaders120.000' WHEN event_id % 20 = 8 THEN 'pass_private' WHEN event_id % 40 = 3 THEN 'pass_s_private' ELSE '' END AS fetch_action,
  CASE WHEN k % 4 = 0 THEN 'application/json' WHEN k % 4 = 1 THEN 'text/html' ELSE 'text/html;charset=utf-8' END AS content_type,
  CASE WHEN k % 5 = 0 THEN 'max-age=60' WHEN k % 5 = 1 THEN 'no-store' WHEN k % 5 = 2 THEN 'private, max-age=0'
       WHEN k % 5 = 3 THEN 'max-age=900,stale-while-revalidate=1800' ELSE '' END AS fetch_cache_control,
  CASE WHEN k % 9 = 0 THEN 'stale-while-revalidate=43200,stale-if-error=43200' ELSE '' END AS fetch_surrogate_control,
  CASE WHEN k % 31 = 0 THEN 'blocked' ELSE '' END AS ddos_action, CASE WHEN k % 37 = 0 THEN 'r1' ELSE '' END AS ddos_rule,
  CASE WHEN k % 41 = 0 THEN 'scan' ELSE '' END AS malicious_flags, CASE WHEN k % 43 = 0 THEN 'rate' ELSE '-' END AS deny_reason,
  CASE WHEN k % 3 = 0 THEN 'Accept-Encoding' WHEN k % 3 = 1 THEN 'Accept-Encoding, User-Agent' ELSE '' END AS response_vary,
  CASE WHEN user_id % 4 = 0 THEN 'www.a.example' WHEN user_id % 4 = 1 THEN 'www.b.example' ELSE '' END AS origin_host,
  CASE WHEN user_id % 7 = 0 THEN concat('192.0.2.', CAST(k AS VARCHAR(10)), ', 10.0.', CAST(user_id % 8 AS VARCHAR(10)), '.', CAST(user_id AS VARCHAR(10)))
       WHEN user_id % 7 = 1 THEN concat('192.0.2.', CAST(k AS VARCHAR(10)), ', 203.0.113.9') ELSE '' END AS original_x_forwarded_for,
  CASE WHEN user_id % 7 = 0 THEN '1.1 akamai.net(ghost)' ELSE '' END AS request_via
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
"""

THREAD_ROWS = """
SELECT concat('case-', CAST(CAST(floor((day(ts) - 1) / 6) AS INT) AS VARCHAR(10))) AS case_id,
  CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS dump_id, event_id AS ord,
  CASE WHEN event_type = 'view' THEN concat('10.0.0.', CAST(user_id AS VARCHAR(10)), ' [', CAST(event_id AS VARCHAR(20)), '] GET /content/', CAST(k % 12 AS VARCHAR(10)), '.html HTTP/1.1')
       WHEN event_type = 'click' THEN concat('http-nio-8080-exec-', CAST(user_id AS VARCHAR(10)))
       WHEN event_type = 'purchase' THEN concat('pool-b2c-', CAST(user_id AS VARCHAR(10)))
       WHEN event_type = 'error' THEN concat('GC task thread#', CAST(user_id AS VARCHAR(10)))
       ELSE concat('scheduler-', CAST(user_id AS VARCHAR(10))) END AS name,
  CASE WHEN k % 5 = 1 THEN 'BLOCKED' WHEN k % 5 = 2 THEN 'WAITING' WHEN k % 5 = 3 THEN 'TIMED_WAITING' ELSE 'RUNNABLE' END AS state,
  CASE WHEN k % 5 = 1 THEN 'com.zaxxer.hikari.pool.HikariPool.getConnection(HikariPool.java:213)'
       WHEN k % 5 = 2 THEN 'java.lang.Object.wait(Native Method)'
       WHEN k % 5 = 3 THEN 'jdk.internal.misc.Unsafe.park(Native Method)'
       WHEN k % 10 = 0 THEN 'java.net.SocketInputStream.read(SocketInputStream.java:50)'
       ELSE 'com.example.web.Search.run(Search.java:7)' END AS frame1,
  CASE WHEN k % 3 = 0 THEN 'java.util.concurrent.LinkedBlockingQueue.take(LinkedBlockingQueue.java:442)'
       WHEN k % 3 = 1 THEN 'org.apache.felix.framework.ServiceRegistry.getService(ServiceRegistry.java:380)'
       ELSE 'com.example.dao.UserRepository.findById(UserRepository.java:45)' END AS frame2,
  concat('com.example.job.Step', CAST(k % 4 AS VARCHAR(10)), '.exec(Step.java:1)') AS frame3,
  CASE WHEN k % 5 = 1 OR k % 10 = 2 THEN concat('0x00000000000', CAST(k % 6 AS VARCHAR(10))) END AS waiting_on,
  CASE WHEN k % 5 = 1 THEN 'com.zaxxer.hikari.pool.HikariPool' WHEN k % 10 = 2 THEN 'java.util.concurrent.locks.Sync' END AS waiting_class,
  CASE WHEN k % 25 = 4 THEN concat('0x00000000000', CAST(k % 6 AS VARCHAR(10))) END AS locked,
  concat('0x', CAST(k + 100 AS VARCHAR(10))) AS nid, CAST(k AS DOUBLE) + 0.5 AS elapsed
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
"""


# Expected thread table: what parsing the dump text must give.
THREADS = """
SELECT case_id, dump_id, CAST(substr(dump_id, 9, 2) AS BIGINT) AS dump_ord, ord, name, state, gc,
  CASE WHEN gc THEN '' ELSE frame1 END AS top_frame,
  CASE WHEN gc THEN '' WHEN frame1 NOT LIKE 'java.%' AND frame1 NOT LIKE 'jdk.%' THEN frame1
       WHEN frame2 NOT LIKE 'java.%' THEN frame2 ELSE frame3 END AS key_frame,
  CASE WHEN gc THEN 0 ELSE 3 END AS depth, frame1, frame2, frame3,
  CASE WHEN NOT gc THEN concat(frame1, '|', frame2, '|', frame3) END AS signature,
  CASE WHEN NOT gc THEN waiting_on END AS waiting_on,
  CASE WHEN NOT gc THEN waiting_class END AS waiting_class,
  CASE WHEN NOT gc THEN locked END AS locked, nid, elapsed
FROM (SELECT *, name LIKE 'GC task thread#%' AS gc FROM thread_rows)
"""

WITH_CDN = f"WITH cdn_logs AS ({CDN_LOGS})"
WITH_THREADS = f"WITH thread_rows AS ({THREAD_ROWS}), t AS ({THREADS})"

PIECE = 1000


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def view(spark: SparkSession, sf: str, sql: str, even: bool = False) -> DataFrame:
    """``sql`` over the events, dealt to all cores: a file of few row groups is read by as few tasks, and what is made of a
    row takes many times as long as to read it.

    By size, Spark joins the parts to about one a core; if that is one more than there are cores, all wait for it. ``even`` keeps
    the session's number of parts, for queries whose work per row outweighs a task.
    """
    parts = [int(spark.conf.get("spark.sql.shuffle.partitions"))] if even else []
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=table(spark, sf, "events").repartition(*parts, "event_id"))


def cdn_logs(spark: SparkSession, sf: str, even: bool = False) -> DataFrame:
    return view(spark, sf, CDN_LOGS, even)


def thread_rows(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, THREAD_ROWS)


def _pieces(rows: DataFrame, block: Column) -> DataFrame:
    """Dump text, a thousand threads of a dump per row, so that no dump is gathered whole."""
    piece = F.floor(F.col("ord") / PIECE).cast("bigint")
    listed = rows.select("case_id", "dump_id", piece.alias("piece"), "ord", block.alias("b")).groupBy(
        "case_id", "dump_id", "piece"
    ).agg(F.sort_array(F.collect_list(F.struct("ord", "b"))).alias("l"))
    return listed.select(
        "case_id", "dump_id", F.substring("dump_id", 9, 2).cast("bigint").alias("dump_ord"), "piece",
        F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("content"),
    )


def jstack_text(spark: SparkSession, sf: str, keep: Column | None = None) -> DataFrame:
    rows = thread_rows(spark, sf) if keep is None else thread_rows(spark, sf).where(keep)
    wait = F.when(F.col("state") == "BLOCKED", "\t- waiting to lock <").otherwise("\t- parking to wait for  <")
    monitor = F.concat(wait, "waiting_on", F.lit("> (a "), "waiting_class", F.lit(")"))
    head = F.concat(
        F.lit('"'), "name", F.lit('" #'), F.col("ord").cast("string"), F.lit(" prio=5 nid="), "nid", F.lit(" elapsed="),
        F.col("elapsed").cast("string"), F.lit(" x"),
    )
    stack = F.array(
        F.concat(F.lit("\tat "), "frame1"), monitor, F.concat(F.lit("\tat "), "frame2"),
        F.concat(F.lit("\t- locked <"), "locked", F.lit("> (a java.lang.Object)")), F.concat(F.lit("\tat "), "frame3"),
    )
    gc = F.col("name").startswith("GC task thread#")
    shown = F.when(gc, F.array().cast("array<string>")).otherwise(F.array_compact(stack))
    state = F.concat(F.lit("   java.lang.Thread.State: "), "state")
    return _pieces(rows, F.array_join(F.concat(F.array(head, state), shown), "\n"))


def j9_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = thread_rows(spark, sf)
    letter = (
        F.when(F.col("state") == "BLOCKED", "B").when(F.col("state") == "WAITING", "W")
        .when(F.col("state") == "TIMED_WAITING", "T").otherwise("R")
    )
    head = F.concat(F.lit('3XMTHREADINFO      "'), "name", F.lit('" J9VMThread:0x00, state:'), letter, F.lit(", prio=5"))
    path = lambda c: F.concat(
        F.lit("4XESTACKTRACE                at "), F.replace(F.col(c), F.lit("."), F.lit("/"))
    )
    gc = F.col("name").startswith("GC task thread#")
    stack = F.array(path("frame1"), path("frame2"), path("frame3"))
    shown = F.when(gc, F.array().cast("array<string>")).otherwise(stack)
    return _pieces(rows, F.array_join(F.concat(F.array(head), shown, F.array(F.lit("NULL"))), "\n"))


def in_order(parsed: DataFrame) -> DataFrame:
    """Threads of all pieces of a dump, numbered through."""
    return parsed.withColumn("ord", F.col("piece") * PIECE + F.col("ord"))


def threads(spark: SparkSession, sf: str) -> DataFrame:
    """The thread table, through dump text and back."""
    return in_order(parse_threads(jstack_text(spark, sf)))
