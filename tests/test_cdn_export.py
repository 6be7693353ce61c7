"""Every shape of export, scans and their bounds."""

import json
import random
import re
from collections import Counter
from datetime import datetime, timezone

from pyspark.sql import functions as F

from builders import at, event, events
from stallscope.functions.text import strip, strip_long
from stallscope.sources import cdn_export as ce
from stallscope.sources import cdn_scan as scan

ONE = {"url": "/a", "cache_status": " miss ", "status": "200", "server_datacenter": "BMA", "is_cacheable": "TRUE", "response_ttl": "12.5s"}


def lines(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord bigint, value string")


def parsed(df):
    return df.orderBy("ord").collect()


def test_lines(spark):
    rows = parsed(
        ce.parse_lines(
            lines(
                spark, "", "[", "]", "  ", "not json", '"text"', "[1]", "{}",
                json.dumps(ONE) + ",", json.dumps({"preview": False, "result": {**ONE, "url": "/b"}}),
                '{"preview":false,"lastrow":true}', '{"preview":true}', json.dumps({"url": "/c", "preview": True, "status": 404}),
                '{"cache_status":null,"url":"/d","shielding_used":1}',
            )
        )
    )
    assert [r.url for r in rows] == ["/a", "/b", "/c", "/d"]
    a = rows[0]
    assert (a.cache_status, a.status, a.pop, a.is_cacheable, a.response_ttl) == ("MISS", 200, "BMA", True, 12.5)
    assert rows[2].status == 404 and rows[3].cache_status == "" and rows[3].shielding_used is True


def test_every_object_of_a_line_is_an_event(spark, tmp_path):
    odd = {**ONE, "url": '/q"}, {"', "bot_name": "}{", "_raw": json.dumps({"client_ip": "1.1.1.1", "l": [{}, {}]})}
    three = [json.dumps({**odd, "origin_host": h}) for h in "abc"]
    texts = [", ".join(three), "".join(three), " ".join(three) + ",", three[0] + "\t{}," + three[1], ",".join(three) + "]", json.dumps({"result": odd, "l": [{}, {}]})]
    rows = ce.parse_lines(lines(spark, *texts)).groupBy("ord").agg(F.sort_array(F.collect_list("origin_host")).alias("h"), F.collect_set("url").alias("u")).orderBy("ord").collect()
    assert [r.h for r in rows] == [["a", "b", "c"]] * 3 + [["a", "b"], ["a", "b", "c"], [""]]
    assert all(r.u == [odd["url"]] for r in rows)
    # a part of an array, as a writer of several files leaves it: no bracket, all on one line
    (tmp_path / "part.json").write_text(", ".join(three) + ",")
    assert ce.read_export(spark, str(tmp_path)).count() == 3


KV = """{ [-]
   url: /kv/page?x=1
   cache_status: PASS
   status: 429
   xdata: { [+]
   }
   time_start: 2026-07-16T03:40:00GMT
   bot_name:
   url: /kv/last
}"""


def test_raw_merge(spark):
    inner = {"url": "/inner", "status": 503, "xdata": {"request_via": "1.1 edge"}, "client_ip": "1.2.3.4"}
    rows = parsed(
        ce.parse_lines(
            lines(
                spark,
                json.dumps({"url": "/outer", "_raw": json.dumps(inner)}),
                json.dumps({"_raw": KV, "pop": "x"}),
                json.dumps({"_raw": json.dumps(inner), "xdata.request_via": "2.0 explicit", "client_ip": ""}),
            )
        )
    )
    assert (rows[0].url, rows[0].status, rows[0].request_via, rows[0].client_ip) == ("/outer", 503, "1.1 edge", "1.2.3.4")
    assert (rows[1].url, rows[1].status, rows[1].cache_status, rows[1].bot_name) == ("/kv/last", 429, "PASS", "")
    assert rows[1].time_start.astimezone(timezone.utc) == datetime(2026, 7, 16, 3, 40, tzinfo=timezone.utc)
    assert (rows[2].request_via, rows[2].client_ip) == ("2.0 explicit", "")


def test_raw_that_only_looks_like_json_is_read_as_a_block(spark):
    """Text that starts like an object and is none falls through to its key-value lines."""
    broken = '{"cut off: here,\n   url: /from/block\n   cache_status: MISS\n   status: 404\n'
    row = parsed(ce.parse_lines(lines(spark, json.dumps({"_raw": broken}), json.dumps({"_raw": '{"url": "/whole"}'}))))
    assert (row[0].url, row[0].cache_status, row[0].status) == ("/from/block", "MISS", 404) and row[1].url == "/whole"


def test_long_text_is_stripped_alike(spark):
    """Text is trimmed only where an end needs it, and a comma taken only where one is last."""
    ends = ["", " ", "\t", "\r\n", "\x0b", "\f", "\u00a0", "\ufeff", ",", ", ", ",,", ",\u2028", ", \u2029 ", ",\u0085"]
    texts = [a + b + c for a in ends for b in ("", '{"url": "/a, "}') for c in ends]
    df = lines(spark, *texts).select("value", strip_long(F.col("value")).alias("long"), strip(F.col("value")).alias("short")).collect()
    assert all(r.long == r.short for r in df) and len(df) == len(texts)
    given = [a + '{"url": "/a, "}' + c for a in ends if "," not in a for c in ends]
    assert [r.url for r in parsed(ce.parse_lines(lines(spark, *given)))] == ["/a, "] * len(given)


def test_raw_is_parsed_once(spark):
    """A parse that stands in its own conditions is done again for each of them."""
    plan = ce.parse_lines(lines(spark, "{}"))._jdf.queryExecution().optimizedPlan().toString()
    choice, tried = plan.split("Generate explode(")[1:3]
    assert choice.count("from_json(") == 1 and tried.count("from_json(") == 1


def test_block_lines(spark):
    """Odd lines of a block, held against a plain reading of them."""
    parts = ["a", "k.-9", ":", ": ", "{", " ", "\t", "\r", "\f", "\n", "\n", '"', "\\", "\u00a0", "\u2028", "}", "x: y", "\U0001f600"]
    draw = random.Random(7)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 12))) for _ in range(3000)]

    def read(text):
        found = {}
        for line in text.split("\n"):
            key, colon, value = line.strip(" \t\x0b\f\r").partition(":")
            value = value.strip(" \t\x0b\f\r")
            if colon and re.fullmatch("[A-Za-z0-9_.-]+", key) and not value.startswith("{"):
                found[key] = value
        return found

    rows = lines(spark, *texts).select("ord", "value", ce.kv_json(F.col("value")).alias("j")).collect()
    for r in rows:
        assert {k: v for k, v in json.loads(r.j, strict=False).items() if k} == read(r.value), repr(r.value)


def test_only_what_starts_as_an_object_is_tried_as_json(spark):
    texts = ['{"url": "/a"}', '{ \t\r\n "url": "/a"}', "{'url': '/a'}", "{}", "{ }", "{ [-]\n url: /a", "{url: 1}", "{", "[1]", "{\u00a0}"]
    tried = lines(spark, *texts).select(F.col("value").rlike(ce.MAY_BE_OBJECT).alias("t")).collect()
    assert [r.t for r in tried] == [True] * 5 + [False] * 5


def test_documents(spark):
    two = [ONE, {**ONE, "url": "/b"}]
    docs = [
        json.dumps(two, indent=1),
        json.dumps({"results": two}),
        json.dumps({"result": two}),
        json.dumps({"result": ONE}, indent=2),
        json.dumps(ONE, indent=2),
        "\n".join(json.dumps(x) for x in two),
        KV,
        "   ",
        "plain words",
        "[]",
    ]
    got = {}
    for r in ce.parse_documents(lines(spark, *docs)).orderBy("ord", "pos", "url").collect():
        got.setdefault(r.ord, []).append(r.url)
    assert got == {0: ["/a", "/b"], 1: ["/a", "/b"], 2: ["/a", "/b"], 3: ["/a"], 4: ["/a"], 5: ["/a", "/b"], 6: ["/kv/last"]}


def test_files_of_mixed_shape(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps({**ONE, "url": f"/l{i}"}) for i in range(3)))
    (tmp_path / "array.json").write_text(json.dumps([{**ONE, "url": "/x"}], indent=2))
    (tmp_path / "block.txt").write_text(KV)
    (tmp_path / "empty.txt").write_text("")
    urls = sorted(r.url for r in ce.read_export(spark, str(tmp_path)).collect())
    assert urls == ["/kv/last", "/l0", "/l1", "/l2", "/x"]
    ce.save_raw(ce.read_lines(spark, str(tmp_path / "lines.json")), str(tmp_path / "saved"))
    assert ce.read_export(spark, str(tmp_path / "saved")).count() == 3


def test_a_block_of_any_size_is_an_event(spark, tmp_path):
    """A file gives the event of its block however large it is, with the last value of every key."""
    filler = "".join(f"   status: {200 + i}\n   url: /page/{i}\n   more{i}: {'x' * 600}\n" for i in range(99)) + "\n\u00a0url: /no key\n"
    head, tail = "{ [-]\n   origin_host: only here\n   url: {\n", "   bot_name:\n   url: /kv/last\n   more7: { [+]\n   status: 429\u00a0\n}\n"
    (tmp_path / "large.txt").write_text(head + filler * 1200 + tail)
    (tmp_path / "small.txt").write_text(head + filler + tail)
    (tmp_path / "a.json").write_text(json.dumps([ONE]))
    (tmp_path / "z.json").write_text(json.dumps([ONE]))
    assert (tmp_path / "large.txt").stat().st_size > 70_000_000
    df = ce.read_export(spark, str(tmp_path), keep_raw=True).drop("ord")
    rows = {r.source_file.rsplit("/", 1)[-1]: r.asDict() | {"source_file": ""} for r in df.collect()}
    assert rows.keys() == {"large.txt", "small.txt", "a.json", "z.json"} and rows["large.txt"] == rows["small.txt"]
    large = rows["large.txt"]
    assert (large["url"], large["status"], large["origin_host"], large["bot_name"]) == ("/kv/last", 429, "only here", "")
    assert len(large["raw"]) == 103 and large["raw"]["more7"] == "" and large["raw"]["more98"] == "x" * 600
    bare = {r.source_file.rsplit("/", 1)[-1]: r.url for r in ce.read_export(spark, str(tmp_path)).collect()}
    assert bare == {"large.txt": "/kv/last", "small.txt": "/kv/last", "a.json": "/a", "z.json": "/a"}


ODD = [
    KV, KV.replace("\n", "\r\n"), "\ufeff" + KV, "\u00a0url: /a\u00a0\nstatus: 200\n\u00a0url: /b", "url: /a\nurl: {x", "xdata: { [+]", "unknown: 1", "plain words", "  \n ", "{}", "{}\n{}", "{}\nurl: /x",
    '{"preview":false,"lastrow":true}\n{}', "[{},\n{}\n]", '[{"url":"x","result":5}]', '{"results":[\n{}\n]}', '{"result":5}\nurl: /x', "[]\nurl: /x", "[-]\nurl: /x", "[section]\nurl: /x", "[2024-01-01]\nurl: /x",
    "[1,\n2]\nurl: /z", '{"url": "/x\nuser: bob\n"}', '{\n"url": "/x\nurl: bob\n"}', "{\nurl: /x\n}", "{ a }\njunk\n{}", "{ a }\n\u00a0foo: x\n{}", "{\n\n\f\n\"a\"\nurl: /ff", "{\n{\nurl: /cc", "xdata:\nurl: /xd\nrequest_via: 2",
    "url: a\rb\nstatus: 1\r\n\r\n", "a: 1\n\n\n url : /x\n\turl:/tab\nstatus:\t 404 \t", 'url: /q"uote\\back\nbot_name: \\n', "url: /b\n}\n{", "url: / x\u0085\nstatus: 5 ", "note: {}\nurl: /n", "[truely]\nurl: /t",
]


def test_a_file_reduced_to_lines_is_read_as_its_whole_text(spark, tmp_path):
    for i, text in enumerate(ODD):
        (tmp_path / f"{i}.txt").write_text(text, newline="")
    number = F.regexp_extract("source_file", r"([0-9]+)\.txt$", 1).cast("bigint")
    for keep_raw in (False, True):
        shown = lambda df: Counter(str({k: v for k, v in r.asDict().items() if v not in (None, "")}) for r in df.collect())  # noqa: E731, B023
        got = ce.read_export(spark, str(tmp_path), keep_raw).withColumn("ord", number).drop("source_file")
        want = ce.parse_documents(lines(spark, *ODD), keep_raw).drop("pos")
        assert shown(got) == shown(want) and want.count() > len(ODD) * 2 / 3


def test_times(spark):
    texts = ["1784173200", "1784173200123", "2026-07-16T03:40:00GMT", "2026-07-16T03:40:00Z", "2026-07-16T05:40:00+02:00", "bad", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    from stallscope.functions.convert import to_time

    got = [r.ms for r in df.select("i", F.unix_millis(to_time(F.col("t"))).alias("ms")).orderBy("i").collect()]
    assert got == [1784173200000, 1784173200123, 1784173200000, 1784173200000, 1784173200000, None, None]


def bound(spark, value):
    now = F.lit("2026-07-16 03:40:25").cast("timestamp")
    col = F.date_format(scan.time_bound(value, now), "yyyy-MM-dd HH:mm:ss")
    return spark.range(1).select(col.alias("t")).collect()[0].t


def test_time_bounds(spark):
    assert bound(spark, "") == bound(spark, "now") == "2026-07-16 03:40:25"
    assert bound(spark, "-60m@m") == "2026-07-16 02:40:00"
    assert bound(spark, "-2h") == "2026-07-16 01:40:25"
    assert bound(spark, "@d") == "2026-07-16 00:00:00"
    assert bound(spark, "-1w") == "2026-07-09 03:40:25"
    assert bound(spark, "+1mon") == "2026-08-16 03:40:25"
    assert bound(spark, "1784173200") == bound(spark, "1784173200999") == "2026-07-16 03:40:00"
    assert bound(spark, "2026-07-16T03:30:00GMT") == "2026-07-16 03:30:00"
    assert [scan.is_relative(x) for x in ("-60m@m", "@d", "now", "2026-07-16T00:00:00Z", "-5x")] == [True, True, True, False, False]
    assert [scan.baseline_days(x) for x in (None, 0, 1, 2, 9)] == [2, 2, 1, 2, 2]


def test_scan_and_baseline(spark):
    rows = [event(url=f"/apac/{i}", time_start=at(i * 60), pop="" if i == 3 else "BMA") for i in range(10)]
    rows += [event(url="/EU/x_y?z", time_start=at(30), aem_tier="author"), event(url="/other", time_start=at(30), aem_service="two")]
    df = events(spark, rows)
    start, end = "2026-07-16T03:26:00Z", "2026-07-16T03:30:00Z"
    assert scan.incident_events(df, start, end, service="svc").count() == 4
    assert scan.incident_events(df, start, end, service="svc", urls=["/APAC/1*", "/apac/2"]).count() == 2
    assert scan.incident_events(df, "2026-07-16T03:25:00Z", end, tier="*", urls=["/eu/x_y?z"]).count() == 1
    assert scan.incident_events(df, "2026-07-16T03:25:00Z", end, tier="*", urls=["/eu/x?y*"]).count() == 0
    base = scan.pop_baseline(df, "2026-07-16T03:30:00Z", service="svc").collect()
    assert [(r["pop"], r["count"]) for r in base] == [("BMA", 4)]
    plan = scan.incident_events(df, start, end, service="svc")._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in plan


def test_scan_reaches_the_file_filters(spark, tmp_path):
    path = str(tmp_path / "log")
    events(spark, [event(time_start=at(1))]).write.parquet(path)
    df = scan.incident_events(spark.read.parquet(path), "2026-07-16T03:00:00Z", "2026-07-16T04:00:00Z", service="svc").select("url")
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "PushedFilters" in plan and "EqualTo(aem_service,svc)" in plan and "GreaterThanOrEqual(time_start" in plan
    assert "client_ip" not in plan.split("ReadSchema")[1]


def test_cap_ranks_one_range_only(spark, monkeypatch):
    """A mass without a time, or in one instant, is cut by ranges of its order: the same rows, few of them ranked."""
    import random

    monkeypatch.setattr(scan, "ORD_RANGE_BITS", 3)
    rnd = random.Random(3)
    rows = [(s, "publish", rnd.choice([None, None, at(0), at(1)]), o) for s in ("a", "b") for o in rnd.sample(range(-500, 500), 300)]
    df = spark.createDataFrame(rows, "aem_service string, aem_tier string, time_start timestamp, ord bigint")
    for cap in (7, 140, 299):
        kept = {(r.aem_service, r.ord) for r in scan.cap_events(df, cap).collect()}
        first = {s: sorted((r for r in rows if r[0] == s), key=lambda r: (r[2] is None, r[2] or at(0), r[3]))[:cap] for s in ("a", "b")}
        assert kept == {(r[0], r[3]) for some in first.values() for r in some}


def test_cap(spark):
    rows = [event(url=f"/{i}", time_start=at(i // 7), aem_service="a") for i in range(100)]
    rows += [event(url=f"/n{i}", time_start=None, aem_service="a") for i in range(5)]
    rows += [event(url=f"/b{i}", time_start=at(0), aem_service="b") for i in range(10)]
    df = events(spark, list(reversed(rows)))
    kept = scan.cap_events(df, 30).groupBy("aem_service").agg(F.count("*").alias("n"), F.max("time_start").alias("t"))
    got = {r.aem_service: r.n for r in kept.collect()}
    assert got == {"a": 30, "b": 10}
    late = {r.url for r in scan.cap_events(df, 102).where("aem_service = 'a' and time_start is null").collect()}
    assert late == {"/n4", "/n3"}
    assert scan.cap_events(df, 0).count() == 115
    assert {c: scan.cap_events(df, c).where("aem_service = 'a'").count() for c in (1, 100, 105, 106)} == {1: 1, 100: 100, 105: 105, 106: 105}
    flags = {r.aem_service: r.truncated for r in scan.truncation(df, 10).collect()}
    assert flags == {"a": True, "b": True}


def test_raw_record_of_any_shape(spark):
    from stallscope.sources.raw_record import with_raw

    inner = {"a": {"b": {"c": 1.5, "d": [1, None, "x"]}}, "e": "{no", "f": None, "g": True, "h": {}, "url": "/shadow", "x y": {"z.w": {"q": {"r": {"s": "deep"}}}}}
    cases = {
        json.dumps({"url": "/u", "n": 5, "_raw": json.dumps(inner)}): {"a.b.c": "1.5", "a.b.d": "1,,x", "e": "{no", "g": "true", "x y.z.w.q.r.s": "deep", "n": "5", "url": "/u"},
        '{"a":1,"a":2,"o":{"p":1}}': {"a": "2", "o": '{"p":1}'},
        "nope: 1\n k2:  v2 \n{ [-]\n col: { [+]\n}\nk2: last": {"nope": "1", "k2": "last", "col": ""},
        json.dumps({"preview": False, "result": {"k": "v", "_raw": "{ [-]\n q: 1\n}"}}): {"k": "v", "q": "1"},
        '{"_raw":5,"l":[1,[2,3],{"z":1}],"o":{"p":null}}': {"l": '1,[2,3],{"z":1}', "o": '{"p":null}'},
        None: {}, "": {}, "{}": {}, '{"broken': {}, "[1]": {},
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, value string")
    assert [r.raw for r in with_raw(df).orderBy("i").collect()] == list(cases.values())
    kept = ce.parse_documents(spark.createDataFrame([('[{"url":"/a","n":1},7,{"url":"/b","o":{"p":2}}]',), ('{"result":[{"url":"/c"}]}',), (KV,)], "value string"), keep_raw=True)
    got = {r.url: r.raw for r in kept.collect()}
    assert got["/a"] == {"url": "/a", "n": "1"} and got["/b"] == {"url": "/b", "o": '{"p":2}'} and got["/c"] == {"url": "/c"} and got["/kv/last"]["url"] == "/kv/last"


def test_files_are_found_without_their_addresses_on_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    (tmp_path / "lines.json").write_text(json.dumps({**ONE, "url": "/l"}))
    for i in range(3):
        (tmp_path / f"one line {i}.json").write_text(json.dumps([{**ONE, "url": f"/x{i}{k}"} for k in "ab"]))
        (tmp_path / f"block{i}.txt").write_text(KV)
    whole, most = DataFrame.collect, []
    monkeypatch.setattr(DataFrame, "collect", lambda df: (most.append(len(rows := whole(df))), rows)[1])
    for name in ("toLocalIterator", "toArrow", "toPandas"):
        monkeypatch.setattr(DataFrame, name, lambda *a, **k: 1 / 0)
    df = ce.read_export(spark, str(tmp_path), keep_raw=True)
    assert max(most) <= 1
    rows = df.collect()
    assert sorted(r.url for r in rows) == ["/kv/last"] * 3 + ["/l"] + [f"/x{i}{k}" for i in range(3) for k in "ab"] and all(r.raw["url"] == r.url for r in rows)
