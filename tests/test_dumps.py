"""Dump text to thread rows and dump signals."""

from pyspark.sql import functions as F

from stallscope.operators import dump_signals as ds
from stallscope.sources import dumps as d

JSTACK = """2024-01-15 10:00:00
Full thread dump:

"http-1" #21 prio=5 nid=0x3900 elapsed=12.50 waiting for monitor entry
   java.lang.Thread.State: BLOCKED (on object monitor)
	at com.acme.pool.Pool.take(Pool.java:10)
	- waiting to lock <0x0000abc1> (a com.acme.pool.Pool)
	at com.acme.dao.Users.find(Users.java:4)

"http-2" #22 prio=5 nid=77
   java.lang.Thread.State: BLOCKED (on object monitor)
	at com.acme.pool.Pool.take(Pool.java:10)
	- waiting to lock <0x0000abc1>
	at com.acme.dao.Users.find(Users.java:4)

"holder" #23
   java.lang.Thread.State: RUNNABLE
	at java.net.SocketInputStream.read(SocketInputStream.java:50)
	- locked <0x0000abc1> (a com.acme.pool.Pool)
	- locked <0x0000abc2> (a java.lang.Object)

"parked" #24
   java.lang.Thread.State: WAITING (parking)
	at jdk.internal.misc.Unsafe.park(Native Method)
	- parking to wait for  <0x0000ddd1> (a java.util.concurrent.locks.Sync)
	at com.acme.job.Loop.run(Loop.java:7)

"both" #25
   java.lang.Thread.State: TIMED_WAITING (sleeping)
	- parking to wait for  <0x0000ddd1> (a first.ParkClass)
	- waiting to lock <0x0000eee1>

"odd" #26
   java.lang.Thread.State: SLEEPY

"GC task thread#0 (ParallelGC)" os_prio=0 runnable

"1.2.3.4 [17] GET /content/a.html HTTP/1.1" #27
   java.lang.Thread.State: RUNNABLE
	at java.util.HashMap.get(HashMap.java:1)

"alone" #28
"""

J9 = """1TISIGINFO     Dump Event
3XMTHREADINFO      "worker-1" J9VMThread:0x01, state:R, prio=5
4XESTACKTRACE                at com/acme/Api.handle(Api.java:42)
4XESTACKTRACE                at java/io/Reader.read(Reader.java:1)
NULL
3XMTHREADINFO      "worker-2" J9VMThread:0x02, state:CW, prio=5
3XMTHREADINFO3           Java callstack: state:B
4XESTACKTRACE                at java/lang/Object.wait(Native Method)
3XMTHREADINFO      "GC Worker" J9VMThread:0x03, state:P
"""

GENERIC = """"a thread" running
  at java.io.Reader.read(Reader.java:1)
  at com.acme.X.y(X.java:2)
Thread-12 is here
GC thread 1
serving GET /x
com.acme.Z.run(Z:33)
"""


def frame(spark, **texts):
    rows = [("c", name, i + 1, text) for i, (name, text) in enumerate(texts.items())]
    return spark.createDataFrame(rows, "case_id string, dump_id string, dump_ord bigint, content string")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_jstack_fields(spark):
    t = by_name(d.parse_threads(frame(spark, a=JSTACK)))
    assert list(t) == ["http-1", "http-2", "holder", "parked", "both", "odd", "1.2.3.4 [17] GET /content/a.html HTTP/1.1"]
    a = t["http-1"]
    assert (a.state, a.nid, a.elapsed) == ("BLOCKED", "0x3900", 12.5)
    assert a.frames == ["com.acme.pool.Pool.take(Pool.java:10)", "com.acme.dao.Users.find(Users.java:4)"]
    assert (a.waiting_on, a.waiting_class) == ("0x0000abc1", "com.acme.pool.Pool")
    assert t["http-2"].waiting_class is None and t["http-2"].nid == "77" and t["http-2"].elapsed is None
    assert t["holder"].locked_monitors == ["0x0000abc1", "0x0000abc2"]
    assert t["holder"].key_frame == t["holder"].top_frame
    assert t["parked"].key_frame == "com.acme.job.Loop.run(Loop.java:7)"
    assert (t["parked"].waiting_on, t["parked"].waiting_class) == ("0x0000ddd1", "java.util.concurrent.locks.Sync")
    # a lock line after a park line wins the address and keeps the class of the park line
    assert (t["both"].waiting_on, t["both"].waiting_class) == ("0x0000eee1", "first.ParkClass")
    assert t["odd"].state == "RUNNABLE" and t["odd"].top_frame == "" and t["odd"].key_frame == ""
    assert [x.startswith("- ") for x in t["both"].monitor_lines] == [True, True]


def test_j9_fields(spark):
    t = by_name(d.parse_threads(frame(spark, a=J9)))
    assert {n: r.state for n, r in t.items()} == {"worker-1": "RUNNABLE", "worker-2": "BLOCKED", "GC Worker": "RUNNABLE"}
    assert t["worker-1"].frames[0] == "com.acme.Api.handle(Api.java:42)"
    assert t["worker-1"].raw_frames[0] == "com/acme/Api.handle(Api.java:42)"
    assert t["worker-2"].key_frame == "java.lang.Object.wait(Native Method)"


def test_formats_and_counts(spark):
    dumps = frame(spark, j=JSTACK, k=J9, g=GENERIC, e="")
    threads = d.parse_threads(dumps)
    got = {r.dump_id: r for r in ds.dump_signals(dumps, threads).collect()}
    assert {k: r.format for k, r in got.items()} == {"j": "jstack", "k": "ibm-j9", "g": "generic", "e": "generic"}
    j, k, g, e = got["j"], got["k"], got["g"], got["e"]
    assert (j.total_thread_count, j.blocked_count, j.waiting_count, j.timed_waiting_count, j.runnable_count) == (7, 2, 1, 1, 3)
    assert (j.io_thread_count, j.gc_thread_count, j.active_request_thread_count, j.new_count) == (1, 0, 1, 0)
    assert (k.total_thread_count, k.io_thread_count, k.gc_thread_count) == (3, 1, 1)
    assert (g.total_thread_count, g.io_thread_count, g.gc_thread_count, g.active_request_thread_count) == (2, 1, 1, 1)
    assert (e.total_thread_count, e.runnable_count) == (1, 1)


def test_dump_without_threads_keeps_zeros(spark):
    dumps = frame(spark, x="3XMTHREADINFO nothing here")
    row = ds.dump_signals(dumps, d.parse_threads(dumps)).collect()[0]
    assert (row.total_thread_count, row.blocked_count) == (0, 0)


def test_fingerprints_and_monitors(spark):
    dumps = frame(spark, j=JSTACK, g=GENERIC)
    threads = d.parse_threads(dumps)
    fps = {(r.dump_id, r.signature.split("(")[0]): r for r in ds.fingerprints(threads, dumps).collect()}
    assert fps["j", "com.acme.pool.Pool.take"]["count"] == 2
    assert fps["g", "java.io.Reader.read"]["count"] == 2
    mons = {r.monitor_address: r for r in ds.blocked_monitors(threads).collect()}
    assert mons["0x0000abc1"].waiting_thread_names == ["http-1", "http-2"]
    assert mons["0x0000abc1"].lock_holder_thread == "holder"
    assert mons["0x0000eee1"].monitor_class == "first.ParkClass"
    assert mons["0x0000ddd1"].lock_holder_thread is None
    assert mons["0x0000ddd1"].waiting_thread_count == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.tdump").write_text(JSTACK)
    (tmp_path / "b.tdump").write_text("nothing")
    (tmp_path / "c.other").write_text(JSTACK)
    dumps = d.read_dump_files(spark, str(tmp_path), glob="*.tdump")
    got = d.file_counts(dumps, d.parse_threads(dumps)).orderBy("source_file").collect()
    assert [(r.thread_count, r.parse_error) for r in got] == [(7, None), (0, "no threads found")]


def test_first_names_limit_is_pushed_below_the_shuffle(spark):
    threads = d.parse_threads(frame(spark, j=JSTACK))
    names = ds.first_names(ds.fingerprint_members(threads), [*ds.KEYS, "signature"], 20, ["ord"])
    plan = names._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert [r.names for r in names.where(F.col("signature").startswith("com.acme.pool")).collect()] == [["http-1", "http-2"]]
