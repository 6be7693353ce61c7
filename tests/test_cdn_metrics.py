"""Metrics of the scenario generators, all services in one job, and skew against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import builders as b
from builders import at, event, events, service
from stallscope.operators import cdn_metrics as cm
from stallscope.operators.quantile import exact_quantiles

SWR_WEEKS = 14 * 86400


def scenarios():
    one = [("MISS", 200, 200), ("MISS", 200, 200), ("MISS", 429, 200), ("HIT", 200, 200), ("PASS", 200, 200), ("PASS", 500, 500)]
    pops3 = ["BMA", "FRA", "LHR"]
    vary = ["Accept-Encoding", "Accept-Encoding", "Accept-Encoding, User-Agent", ""]
    pass_rows = [
        event(cache_status="PASS", fetch_action="pass_noheaders"), event(cache_status="PASS", fetch_action="pass_private"),
        event(cache_status="PASS", status=301), event(cache_status="PASS", status=429),
    ]
    clustered = [event(url=f"/article/{u}", pop=p, time_start=at(0)) for u in range(20) for p in pops3]
    spread = [event(url=f"/article/{u}", pop=p, time_start=at(u * 3 + i)) for u in range(20) for i, p in enumerate(pops3)]
    chain = {"client_ip": "23.52.12.49", "request_via": "1.1 edge"}
    return {
        "volume": [event(url=f"/{i}", cache_status=c, status=s, origin_status=o) for i, (c, s, o) in enumerate(one)],
        "pass": pass_rows,
        "nomiss": [event(cache_status="PASS"), event(cache_status="HIT")],
        "states": [
            event(cache_status="PASS"), event(cache_status="hitpass"), event(cache_status="", fastly_info_state="HIT-STALE"),
            event(cache_status="", fastly_info_state="", response_x_cache="MISS"), event(cache_status="MISS-WAIT"), event(cache_status="ERROR"),
        ],
        "unique": b.unique_urls(100),
        "stale": b.stale_content(),
        "pops": b.across_pops(),
        "within": [event(time_start=at(0)), event(time_start=at(10))],
        "beyond": [event(response_ttl=5.0, time_start=at(0)), event(response_ttl=5.0, time_start=at(60))],
        "instant": [event(time_start=at(0)) for _ in range(5)],
        "vary": [event(url=f"/{i}", response_vary=v) for i, v in enumerate(vary)],
        "clustered": clustered + [event(url="/article/0", time_start=at(60))],
        "spread": spread,
        "bot": b.bots_on_cold_pop(),
        "rare": [event(url=f"/p{i}") for i in range(99)] + [event(url="/rare", pop="ZZZ")],
        "reasons": [event(url="/x", pop=p) for p in ("BMA", "FRA", "LHR", "AMS", "CDG")],
        "repeats": [event(url="/x") for _ in range(5)],
        "swronly": [event(fetch_surrogate_control="stale-while-revalidate=43200,stale-if-error=43200"), event(url="/b")],
        "directives": [
            event(fetch_cache_control="no-store"), event(url="/b", fetch_cache_control="private, max-age=0"),
            event(url="/c", fetch_cache_control="max-age=300"),
        ],
        "misspass": [event(fetch_action="pass_noheaders120.000"), event(url="/b")],
        "cloud": [{**e, **chain, "original_x_forwarded_for": "135.132.91.21, 23.52.12.49"} for e in b.cloud_burst()],
        "nochain": [{**e, **chain, "original_x_forwarded_for": "23.52.12.49"} for e in b.cloud_burst()],
        "badchain": [{**e, **chain, "original_x_forwarded_for": "135.132.91.21, 9.9.9.9"} for e in b.cloud_burst()],
        "eyeball": [{**e, "client_as_name": "comcast cable communications"} for e in b.unique_urls(30)],
        "nohost": b.unique_urls(5, origin_host=""),
        "ttl": b.ttl_pairs(fetch_cache_control="max-age=60"),
        "swr": b.ttl_pairs(fetch_surrogate_control=f"max-age=60,stale-while-revalidate={SWR_WEEKS}"),
        "shield": [event(url=f"/{i}", shielding_used=i % 2 == 0) for i in range(4)],
        "content": [event(is_cacheable=False), event(is_cacheable=False, content_type="text/html"), event(content_type="application/json")],
    }


@pytest.fixture(scope="module")
def m(spark):
    rows = [r for name, part in scenarios().items() for r in service(part, name)]
    base = b.cold_pop_baseline(spark, service="bot")
    return {r.aem_service: r for r in cm.cdn_metrics(events(spark, rows), base).collect()}


def test_field_count(m):
    assert len(cm.SCALARS) == 89 and len(cm.LISTS) == 12
    assert set(cm.SCALARS + cm.LISTS) <= set(m["volume"].asDict())


def test_volume(m):
    x = m["volume"]
    assert (x.totalRequests, x.missCount, x.hitCount, x.passCount, x.otherCount) == (6, 3, 1, 2, 0)
    assert x.missRatio == 0.75 and (x.passWith200Count, x.passNon200Count) == (1, 1)
    assert (x.error429Count, x.missWith429Count, x.missShareOf429, x.originError5xxCount) == (1, 1, 1.0, 1)
    s = m["states"]
    assert (s.missCount, s.hitCount, s.passCount, s.otherCount) == (2, 1, 2, 1)


def test_pass(m):
    x = m["pass"]
    assert (x.passCount, x.passWith200Count, x.passWith200Share, x.pass429Count, x.passNon200Non429Count) == (4, 2, 0.5, 1, 1)
    assert (x.pass200NoHeadersShare, x.pass200PrivateShare) == (0.5, 0.5)
    assert {(r.status, r["count"]) for r in x.passStatusTop} == {(200, 2), (301, 1), (429, 1)}


def test_no_miss(m):
    assert m["nomiss"].missCount == 0 and "No cache MISS" in m["nomiss"].warnings[0]
    assert m["volume"].warnings == []


def test_urls(m):
    x = m["unique"]
    assert (x.distinctMissUrlCount, x.uniqueMissUrlRatio, x.singleRequestMissUrlShare, x.repeatedMissUrlCount) == (100, 1.0, 1.0, 0)
    x = m["stale"]
    assert (x.missCount, x.repeatedMissUrlCount, x.maxRequestsForSingleMissUrl) == (300, 30, 10)
    assert (x.repeatedUrlMultiPopShare, x.shortTtlMissShare, x.avgMissTtlSeconds) == (0.0, 1.0, 30.0)
    x = m["pops"]
    assert (x.distinctPopCount, x.avgPopsPerRepeatedMissUrl, x.repeatedUrlMultiPopShare, x.topPopMissShare) == (4, 4.0, 1.0, 0.25)
    assert len(m["unique"].topMissUrls) == 10 and m["pops"].topMissUrls[0].pops == 4


def test_miss_reasons(m):
    x = m["reasons"]
    assert (x.distinctUrlPopPairs, x.firstFetchPerPopMissCount, x.repeatSamePopMissCount) == (5, 5, 0)
    x = m["repeats"]
    assert (x.firstFetchPerPopMissCount, x.repeatSamePopMissCount, x.coldPopFirstFetchShare, x.repeatSamePopShare) == (1, 4, 0.2, 0.8)


def test_timing(m):
    assert m["within"].refetchWithinTtlCount == 1 and m["beyond"].refetchWithinTtlCount == 0
    assert m["instant"].refetchWithinTtlCount == 4
    assert m["clustered"].coldFetchBurstRatio > 10 and 0 < m["spread"].coldFetchBurstRatio < 2
    assert m["unique"].coldFetchBurstRatio == 0
    assert m["instant"].burstRatio < 5.0001


def test_vary(m):
    x = m["vary"]
    assert (x.missVaryShare, x.highCardinalityVaryMissShare) == (0.75, 0.25)
    assert (x.topMissVaryValues[0].value, x.topMissVaryValues[0]["count"]) == ("Accept-Encoding", 2)
    assert m["unique"].missVaryShare == 0 and m["unique"].topMissVaryValues == []


def test_bots_and_rare_pops(m):
    x = m["bot"]
    assert (x.botMissShare, x.rarePopMissShare, x.botOnRarePopMissShare, x.topAsnMissShare, x.baselineUsed) == (1.0, 1.0, 1.0, 1.0, 1)
    assert x.topBotName == "Generic Bot" and x.popMissBreakdown[0].rare is True
    assert m["rare"].rarePopMissShare == 0.01 and m["rare"].baselineUsed == 0
    assert m["repeats"].rarePopMissShare == 0


def test_directives(m):
    x = m["swronly"]
    assert (x.missNoPositiveTtlShare, x.missNoStoreShare) == (1.0, 0.0) and "stale-while-revalidate" in x.sampleMissSurrogateControl
    x = m["directives"]
    assert x.missNoStoreShare == pytest.approx(2 / 3) and x.missNoPositiveTtlShare == pytest.approx(2 / 3)
    assert x.sampleMissCacheControl == "no-store"
    assert m["misspass"].misspassMissShare == 0.5


def test_sources(m):
    x = m["cloud"]
    assert x.cloudAsnRequestShare == 1.0 and "akamai" in x.topAsnRequestName and x.peakRequestsPerSec == 200 and x.burstRatio > 10
    sample = x.topSourceAsns[0].forwardedSample
    assert (sample.realClientIp, sample.via) == ("135.132.91.21", "1.1 edge")
    assert m["nochain"].topSourceAsns[0].forwardedSample is None and m["badchain"].topSourceAsns[0].forwardedSample is None
    assert m["eyeball"].cloudAsnRequestShare == 0
    assert m["nohost"].topOriginHost == "" and m["unique"].topOriginHost == "www.example.com"


def test_ttl(m):
    x = m["ttl"]
    assert (x.ttlDataSufficient, x.windowSeconds, x.p90AggGapSeconds, x.observedMaxAgeSeconds) == (1, 120.0, 120.0, 60)
    assert (x.recommendedTtlSeconds, x.observedSwrSeconds, x.recommendedSwrSeconds) == (300, 0, 604800)
    assert (m["swr"].observedSwrSeconds, m["swr"].recommendedSwrSeconds) == (SWR_WEEKS, SWR_WEEKS)
    assert m["unique"].ttlDataSufficient == 0 and m["unique"].recommendedTtlSeconds == 0


def test_shield_and_content(m):
    assert m["shield"].shieldingUsedMissShare == 0.5
    x = m["content"]
    assert x.cacheableFalseMissShare == pytest.approx(2 / 3)
    assert (x.dominantMissContentType, x.dominantMissContentTypeShare) == ("text/html", pytest.approx(2 / 3))


@pytest.mark.parametrize("most", [cm.MetricParams.slice_rows, 7, 1])
def test_gaps_of_a_hot_url_against_numpy(spark, most):
    """A third of the requests hit one URL; slices, and parts of them, cut its history in many places."""
    rnd = random.Random(3)
    rows = []
    for _ in range(1500):
        hot = rnd.random() < 0.34
        rows.append(
            event(
                url="/hot" if hot else f"/u{rnd.randrange(60)}", pop=rnd.choice(["A", "B"]), time_start=at(rnd.randrange(0, 20000) / 4),
                cache_status=rnd.choice(["MISS", "HIT", "PASS"]), response_ttl=float(rnd.choice([0, 5, 300])),
            )
        )
    df = cm.tag_events(events(spark, rows))
    times = cm.request_times(df, slice_seconds=60 if most > 7 else 600)
    got = cm.gap_metrics(times, most=most).collect()[0]
    parts = cm.sliced_times(times, most=most).groupBy("url", "slice", "part").agg(F.count("*").alias("rows"), F.min("us").alias("lo"), F.max("us").alias("hi")).collect()
    assert sum(p.rows for p in parts) == times.count()
    assert all(p.rows <= most + 2 or p.lo // 1000 == p.hi // 1000 for p in parts)  # two POPs share a millisecond at most
    if most == 7:
        assert sum(p.url == "/hot" for p in parts) > 40 and max(p.part for p in parts) >= 5
    agg, pop, refetch, last, last_pop, last_miss = [], [], 0, {}, {}, {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["time_start"], i))
    for i in order:
        r = rows[i]
        if r["cache_status"] == "PASS":
            continue
        t, u, k = r["time_start"].timestamp(), r["url"], (r["url"], r["pop"])
        if u in last:
            agg.append(t - last[u])
        if k in last_pop:
            pop.append(t - last_pop[k])
        last[u] = last_pop[k] = t
        if r["cache_status"] == "MISS":
            if k in last_miss and last_miss[k][1] > 0 and t - last_miss[k][0] <= last_miss[k][1]:
                refetch += 1
            last_miss[k] = (t, r["response_ttl"])
    assert got["_gaps"] == len(agg)
    assert got.p50AggGapSeconds == pytest.approx(np.percentile(agg, 50))
    assert got.p90AggGapSeconds == pytest.approx(np.percentile(agg, 90))
    assert got.p90PerPopGapSeconds == pytest.approx(np.percentile(pop, 90))
    assert got.refetchWithinTtlCount == refetch


def test_quantiles_against_numpy(spark):
    rnd = random.Random(5)
    data = {"a": [rnd.randrange(10**9) for _ in range(400)], "b": [7], "c": [0, 0, 0, 1, 10**12], "d": [rnd.randrange(5) for _ in range(99)]}
    rows = [(k, v, 1) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v bigint, w bigint")
    for r in exact_quantiles(df, ["k"], "v", "w", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).collect():
        for p in (50, 90, 99):
            assert r[f"p{p}"] == pytest.approx(np.percentile(data[r.k], p))
        assert r.n == len(data[r.k])


def test_top_lists_limit_before_the_shuffle(spark):
    urls = cm.url_counts(cm.url_pop_counts(cm.tag_events(events(spark, b.across_pops()))))
    plan = cm.top_miss_urls(urls)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    counters = cm.volume_counts(cm.tag_events(events(spark, b.across_pops())))._jdf.queryExecution().executedPlan().toString()
    assert counters.count("HashAggregate") == 2 and "SortAggregate" not in counters and "BatchEvalPython" not in counters


def test_parts_merge_to_the_same_metrics(spark):
    rows = service(b.across_pops(20) + b.bots_on_cold_pop(15) + b.unique_urls(40) + b.ttl_pairs(fetch_cache_control="max-age=60"), "x")
    whole = events(spark, rows)
    halves = [whole.where(F.col("ord") % 2 == i) for i in (0, 1)]
    both = [cm.partials(cm.tag_events(h)) for h in halves]
    merged = {n: cm.merge_part(n, both[0][n].unionByName(both[1][n])) for n in cm.PART_GROUPS}
    assert cm.metrics_from_parts(merged).collect()[0] == cm.cdn_metrics(whole).collect()[0]


def test_lifetimes_are_read_from_either_header_and_spelling(spark):
    cases = [  # cache, surrogate, lifetime, stale lifetime
        ("Max-Age = 007, S-MaxAge=5", "", 5, None), ("max-age=60", "max-age=9,stale-while-revalidate=3", 9, 3), ("max-age=0", "", None, None),
        ("max-age=99999999999999999999", "", None, None), ("x-max-age=4", "smax-age=4", None, None), ("STALE-WHILE-REVALIDATE=08", "s-maxage=0", None, 8), (None, None, None, None),
    ]
    rows = [b.event(fetch_cache_control=cc, fetch_surrogate_control=sc) for cc, sc, _, _ in cases]
    got = cm.tag_events(events(spark, rows)).orderBy("ord").select("max_age", "swr").collect()
    assert [tuple(r) for r in got] == [c[2:] for c in cases]
