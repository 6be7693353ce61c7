"""The query operators on a five-thread table and a larger generated one."""

import random

import pytest
from pyspark.sql import functions as F

from stallscope.operators import thread_query as q

POOL = "com.zaxxer.hikari.pool.HikariPool.getConnection(HikariPool.java:213)"
ROWS = [
    ("http-exec-1", "BLOCKED", [POOL, "com.example.dao.Users.find(Users.java:45)"], POOL),
    ("http-exec-2", "BLOCKED", [POOL, "com.example.dao.Orders.find(Orders.java:78)"], POOL),
    ("http-exec-3", "WAITING", ["java.lang.Object.wait(Native Method)", "com.example.queue.Tasks.poll(Tasks.java:88)"],
     "com.example.queue.Tasks.poll(Tasks.java:88)"),
    ("scheduler-1", "TIMED_WAITING", ["java.lang.Thread.sleep(Native Method)", "com.example.Jobs.run(Jobs.java:55)"],
     "com.example.Jobs.run(Jobs.java:55)"),
    ("main", "RUNNABLE", ["com.example.Main.main(Main.java:10)"], "com.example.Main.main(Main.java:10)"),
]
SCHEMA = (
    "dump_ord bigint, ord bigint, name string, state string, frames array<string>, monitor_lines array<string>, "
    "top_frame string, key_frame string, nid string, elapsed double"
)


def table(spark, rows):
    full = [(1, i, n, s, fr, [], fr[0] if fr else "", key, None, None) for i, (n, s, fr, key) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def five(spark):
    return table(spark, ROWS).cache()


def result(query, threads, *cols):
    rows = query.run(threads).orderBy("_pos")
    return [tuple(r) for r in rows.select(*cols).collect()]


CASES = [
    (lambda: q.equals("state", "blocked"), 2),
    (lambda: q.one_of("state", ["BLOCKED", " waiting"]), 3),
    (lambda: q.differs("state", "BLOCKED"), 3),
    (lambda: q.equals("thread", "*HTTP-exec*"), 3),
    (lambda: q.equals("frame", "*HikariPool*"), 2),
    (lambda: q.differs("frame", "*HikariPool*"), 3),
    (lambda: q.equals("keyframe", "*dao*"), 0),
    (lambda: q.compares("stackdepth", ">=", 2), 4),
    (lambda: q.compares("stackdepth", "<", "2"), 1),
    (lambda: q.differs("stackdepth", 2), 1),
    (lambda: q.compares("state", ">", 0), 0),
    (lambda: q.equals("thread", "http?exec?1"), 1),
    (lambda: q.equals("thread", "http_exec%"), 0),
    (lambda: q.equals("class", "com.example.main"), 1),
    (lambda: q.equals("package", "com.zaxxer.hikari.pool"), 2),
    (lambda: q.equals("method", "poll"), 1),
    (lambda: q.equals("nothing", "x"), 0),
    (lambda: q.compares("nothing", ">=", 0), 5),
    (lambda: q.all_of(q.equals("state", "BLOCKED"), q.equals("thread", "*1")), 1),
    (lambda: q.some_of(q.equals("state", "WAITING"), q.equals("thread", "main")), 2),
]


def test_predicates(five):
    counts = five.agg(*[F.count_if(p()).alias(str(i)) for i, (p, _) in enumerate(CASES)]).collect()[0]
    assert [counts[str(i)] for i in range(len(CASES))] == [n for _, n in CASES]


def test_rows_without_command(five):
    rows = q.ThreadQuery().run(five, keep=["frames"]).orderBy("_pos").collect()
    assert [r.thread for r in rows] == [r[0] for r in ROWS]
    assert rows[0]["class"] == "com.zaxxer.hikari.pool.HikariPool" and rows[0].method == "getConnection"
    assert rows[0].stackdepth == 2 and rows[0].url is None and len(rows[0].frames) == 2


def test_stats_order_and_top(five):
    query = q.ThreadQuery().stats_count("state")
    assert result(query, five, "state", "count") == [
        ("BLOCKED", 2), ("WAITING", 1), ("TIMED_WAITING", 1), ("RUNNABLE", 1),
    ]
    assert result(query.top(2), five, "state") == [("BLOCKED",), ("WAITING",)]


def test_filters_run_before_commands(five):
    early = q.ThreadQuery().where(q.equals("state", "BLOCKED")).top(1)
    late = q.ThreadQuery().top(1).where(q.equals("state", "WAITING"))
    assert result(early, five, "thread") == [("http-exec-1",)]
    assert result(late, five, "thread") == [("http-exec-3",)]


def test_count_of_nothing(five):
    assert result(q.ThreadQuery().where(q.equals("thread", "zzz")).stats_count(), five, "count") == [(0,)]


def test_errors():
    with pytest.raises(ValueError):
        q.compares("state", ">", "high")
    with pytest.raises(ValueError):
        q.ThreadQuery().dedup()


def request(i, verb, path):
    return (f"10.0.0.{i} [1786{i}] {verb} {path} HTTP/1.1", "RUNNABLE", [], "")


def test_dedup_keeps_rows_without_a_value(spark):
    rows = [request(1, "GET", "/a"), request(2, "POST", "/a"), ("plain", "RUNNABLE", [], ""), ("other", "RUNNABLE", [], ""), request(3, "GET", "/b?x=1")]
    threads = table(spark, rows)
    assert [t for (t,) in result(q.ThreadQuery().dedup("url"), threads, "url")] == ["/a", None, None, "/b?x=1"]
    assert result(q.ThreadQuery().dedup("url").stats_count(), threads, "count") == [(4,)]
    assert result(q.ThreadQuery().stats_count("url"), threads, "url", "count") == [("/a", 2), ("", 2), ("/b?x=1", 1)]
    assert len(result(q.ThreadQuery().dedup("nothing"), threads, "thread")) == 5


def test_hex_numbers(spark):
    threads = table(spark, ROWS).withColumn("nid", F.when(F.col("ord") == 0, "0x3900").when(F.col("ord") == 1, "12"))
    assert result(q.ThreadQuery().where(q.compares("nid", ">", "0x3000")), threads, "nid") == [("0x3900",)]
    assert len(result(q.ThreadQuery().where(q.compares("nid", "<=", 0)), threads, "nid")) == 3


def test_chain_against_plain_python(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        # a third of the threads serve one address
        path = "/hot" if rnd.random() < 0.34 else f"/p{rnd.randrange(40)}"
        rows.append(request(i, "GET", path)[:1] + (rnd.choice(["RUNNABLE", "BLOCKED", "WAITING"]), [POOL], POOL))
    threads = table(spark, rows)
    seen, first = set(), []
    for name, state, *_ in rows:
        url = name.split(" ")[3]
        if (url, state) not in seen:
            seen.add((url, state))
            first.append(state)
    counts = sorted(((-first.count(s), first.index(s), s) for s in set(first)))
    got = result(q.ThreadQuery().dedup("url", "state").stats_count("state").top(2), threads, "state", "count")
    assert got == [(s, -n) for n, _, s in counts][:2]
    plan = q.ThreadQuery().dedup("url", "state").run(threads)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_share_and_sort(five):
    rows = q.with_share(q.ThreadQuery().stats_count("state").run(five))
    assert {r.state: r.share for r in rows.collect()} == {"BLOCKED": 100, "WAITING": 50, "TIMED_WAITING": 50, "RUNNABLE": 50}
    assert [r.thread for r in q.sort_result(q.ThreadQuery().run(five), "thread", descending=True).collect()][0] == "scheduler-1"
    assert [r.stackdepth for r in q.sort_result(q.ThreadQuery().run(five), "stackdepth").collect()] == [1, 2, 2, 2, 2]
