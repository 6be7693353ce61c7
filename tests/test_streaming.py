"""Streams give the numbers of a batch."""

import json
import os
import time

import builders as b
from pyspark.sql import functions as F
from stallscope.operators import cdn_metrics as cm
from stallscope.operators import thread_query as q
from stallscope.sources import cdn_export as ce
from stallscope.streaming import cdn_stream as st
from stallscope.streaming import dump_watch as dw


def raw(row):
    out = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in row.items() if k not in ("pop", "request_via", "time_start")}
    out["server_datacenter"], out["xdata.request_via"] = row["pop"], row["request_via"]
    if row["time_start"]:
        out["time_start"] = row["time_start"].strftime("%Y-%m-%dT%H:%M:%SGMT")
    return out


def test_metrics_of_a_stream_equal_the_batch(spark, tmp_path):
    rows = b.service(b.across_pops(20), "one") + b.service(b.bots_on_cold_pop(15) + b.ttl_pairs(fetch_cache_control="max-age=60"), "two")
    source = tmp_path / "in"
    source.mkdir()
    for i in range(3):
        part = rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3]
        (source / f"part-{i}.json").write_text("\n".join(json.dumps({"result": raw(r)}) for r in part) + '\n{"lastrow":true}\n')
    table, check = str(tmp_path / "parts"), str(tmp_path / "check")
    st.write_partials(st.export_stream(spark, str(source), 1), table, check).trigger(availableNow=True).start().awaitTermination()
    assert len(list((tmp_path / "parts" / "volume").glob("batch_id=*"))) == 3
    base = b.cold_pop_baseline(spark, service="two")
    streamed = {r.aem_service: r for r in st.stream_metrics(spark, table, base).collect()}
    batch = {r.aem_service: r for r in cm.cdn_metrics(ce.read_export(spark, str(source)), base).collect()}
    assert streamed == batch and streamed["two"].baselineUsed == 1


def test_compacted_days_give_the_same_metrics(spark, tmp_path):
    """One part a day is read after compaction; a batch that runs again, and a compaction that broke off, change nothing."""
    rows = b.service(b.across_pops(20), "one") + b.service(b.bots_on_cold_pop(15) + b.ttl_pairs(fetch_cache_control="max-age=60"), "two")
    source, table = tmp_path / "in", str(tmp_path / "parts")
    source.mkdir()
    for i in range(6):
        part = rows[i * len(rows) // 6 : (i + 1) * len(rows) // 6]
        (source / f"part-{i}.json").write_text("\n".join(json.dumps({"result": raw(r)}) for r in part))
        os.utime(source / f"part-{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    day = lambda batch: f"2026-07-0{1 + batch // 2}"
    stream = lambda: st.write_partials(st.export_stream(spark, str(source), 1), table, str(tmp_path / "check"), day=day)
    stream().trigger(availableNow=True).start().awaitTermination()
    base = b.cold_pop_baseline(spark, service="two")
    want = {r.aem_service: r for r in cm.cdn_metrics(ce.read_export(spark, str(source)), base).collect()}
    got = lambda: {r.aem_service: r for r in st.stream_metrics(spark, table, base).collect()}
    assert got() == want and st.compact(spark, table, "2026-07-01") == 0
    assert st.compact(spark, table, "2026-07-03") == 2 and [(r.day, r.first, r.last) for r in st.runs(spark, table)] == [("2026-07-01", 0, 1), ("2026-07-02", 2, 3)]
    assert got() == want
    files = {f.split("/parts/")[1].rsplit("/", 1)[0] for f in st.arrived_parts(spark, table)["volume"].inputFiles()}
    assert len(files) == 4 and sum(f.startswith("runs/") for f in files) == 2
    for name in cm.PART_GROUPS:  # batch 1 runs again, and its parts are written anew
        again = spark.read.parquet(f"{table}/{name}/batch_id=1").collect()
        if again:
            spark.createDataFrame(again * 2, spark.read.parquet(f"{table}/{name}/batch_id=1").schema).write.mode("overwrite").parquet(f"{table}/{name}/batch_id=1")
    broken = tmp_path / "parts" / "manifest" / "v=2"  # a compaction that didn't come to its end
    broken.mkdir()
    (broken / "part-0.parquet").write_text("")
    assert got() == want
    assert st.compact(spark, table, "2026-07-04") == 1 and len(st.runs(spark, table)) == 3 and got() == want
    assert not list((tmp_path / "parts" / "volume").glob("batch_id=[0-3]")) and len(list((tmp_path / "parts" / "volume").glob("batch_id=*"))) == 2
    assert st.compact(spark, table, "2026-07-05") == 0 and got() == want


def test_minute_counts(spark, tmp_path):
    path = str(tmp_path / "events")
    b.events(spark, b.cloud_burst()).write.parquet(path)
    stream = spark.readStream.schema(b.EVENT_SCHEMA).parquet(path)
    out = st.minute_counts(stream).writeStream.outputMode("complete").format("memory").queryName("minutes")
    query = out.trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(requests) AS n FROM minutes").collect()[0].n == 220


BLOCK = '"{0}" #1\n   java.lang.Thread.State: {1}\n\tat com.acme.X.y(X.java:1)\n\n'


def test_watched_dumps(spark, tmp_path):
    """New, rewritten and deleted files: the answer is that of the folder as it is."""
    folder = tmp_path / "dumps"
    folder.mkdir()
    table, batch = str(tmp_path / "t"), iter(range(10))

    def counts():
        threads = dw.refresh(spark, str(folder), table, next(batch), "*.tdump")
        return {r.state: r["count"] for r in q.ThreadQuery().stats_count("state").run(threads, order=("source_file", "ord")).collect()}

    (folder / "a.tdump").write_text(BLOCK.format("x", "BLOCKED") + BLOCK.format("y", "RUNNABLE"))
    (folder / "skip.txt").write_text(BLOCK.format("z", "BLOCKED"))
    assert counts() == {"BLOCKED": 1, "RUNNABLE": 1}
    (folder / "b.tdump").write_text(BLOCK.format("z", "BLOCKED"))
    assert counts() == {"BLOCKED": 2, "RUNNABLE": 1}
    (folder / "a.tdump").write_text(BLOCK.format("x", "RUNNABLE") * 2)
    os.utime(folder / "a.tdump", (2_000_000_000, 2_000_000_000))
    assert counts() == {"BLOCKED": 1, "RUNNABLE": 2}
    (folder / "a.tdump").write_text("no threads any more")
    os.utime(folder / "a.tdump", (2_000_000_100, 2_000_000_100))
    assert counts() == {"BLOCKED": 1}
    (folder / "b.tdump").unlink()
    assert counts() == {} and counts() == {}


def test_a_refresh_passes_no_addresses_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    folder, table = tmp_path / "dumps", str(tmp_path / "t")
    folder.mkdir()
    for i in range(6):
        (folder / f"{i} a.tdump").write_text(BLOCK.format("é", "BLOCKED"))
        os.utime(folder / f"{i} a.tdump", (1_000_000_000 + i, 1_000_000_000 + i))
    whole, most = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda df: (most.append(len(rows := whole(df))), rows)[1])
    for name in ("toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: 1 / 0)
    first = dw.refresh(spark, str(folder), table, 0)
    (folder / "3 a.tdump").write_text(BLOCK.format("x", "RUNNABLE"))
    os.utime(folder / "3 a.tdump", (1_500_000_000, 1_500_000_000))
    again = dw.refresh(spark, str(folder), table, 1)
    assert max(most) <= 1
    plan = dw.read_versions(spark, str(folder), dw.listing(spark, str(folder)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(modificationTime" in plan
    assert sorted((r.name, r.state) for r in again.collect()) == [("x", "RUNNABLE")] + [("é", "BLOCKED")] * 5 and len(first.columns) > 5


def test_a_watch_delivers_at_its_triggers(spark, tmp_path):
    folder = tmp_path / "dumps"
    folder.mkdir()
    (folder / "a.tdump").write_text(BLOCK.format("x", "BLOCKED"))
    seen = []
    writer = dw.watch(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c"), q.ThreadQuery().stats_count("state"), lambda result, n: seen.append({r.state: r["count"] for r in result.collect()}))
    running = writer.trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(600):
            if seen:
                break
            time.sleep(0.1)
    finally:
        running.stop()
    assert seen[0] == {"BLOCKED": 1}


def test_order_of_arrival_over_many_partitions(spark):
    """Ties in time go to the event that came first, also in a batch of more than 128 partitions."""
    rows = [b.event(url="/u", pop="P", client_as_number="1", client_as_name=f"name {i}", cache_status="MISS", response_ttl=float(i + 1)) for i in range(400)]
    events = b.events(spark, rows).drop("ord").coalesce(1).select("*", F.monotonically_increasing_id().alias("n")).repartitionByRange(200, "n")
    numbered = events.withColumn("ord", F.monotonically_increasing_id())
    assert numbered.agg(F.max("ord")).first()[0] >= 128 << 33
    parts = cm.partials(cm.tag_events(numbered))
    halves = [numbered.where("n < 200"), numbered.where("n >= 200")]
    for name in ("firsts", "times"):
        split = [cm.partials(cm.tag_events(h))[name].withColumn("batch_id", F.lit(i)) for i, h in enumerate(halves)]
        merged = cm.merge_part(name, split[0].unionByName(split[1]), batch="batch_id")
        columns = [c for c in merged.columns if c not in ("ord", "ttl_ord")]
        assert merged.select(columns).collect() == parts[name].select(columns).collect()
    # a later batch comes after an earlier one, whatever the numbers in it
    late = [cm.partials(cm.tag_events(h))["firsts"].withColumn("batch_id", F.lit(i)) for i, h in enumerate(reversed(halves))]
    assert cm.merge_part("firsts", late[0].unionByName(late[1]), batch="batch_id").where("dim = 'name'").first().a == "name 200"


def test_a_batch_is_marked_once_for_all_parts(spark, tmp_path, monkeypatch):
    rows = b.service(b.across_pops(20), "one")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"result": raw(r)}) for r in rows))
    seen, whole = [], st.partials

    def watched(events, *rest):
        seen.append((events.columns, events.storageLevel.useMemory, "REPARTITION_BY_COL" in events._jdf.queryExecution().toString()))
        return whole(events, *rest)

    monkeypatch.setattr(st, "partials", watched)
    stream = st.write_partials(st.export_stream(spark, str(tmp_path / "in")), str(tmp_path / "parts"), str(tmp_path / "check"))
    stream.trigger(availableNow=True).start().awaitTermination()
    assert seen == [([*cm.KEYS, *cm.SLIM], True, True)]
