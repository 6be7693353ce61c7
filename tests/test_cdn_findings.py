"""Scenario to findings, upstream check and reports."""

import pytest
from pyspark.sql import functions as F

import builders as b
from builders import at, event, events, service
from stallscope.operators.cdn_findings import decimals, duration, percent
from stallscope.operators.upstream import first_targets, jump_tables, match_suffixes, resolve_upstream, resolve_upstream_all
from stallscope.plans import cdn_report as cr
from stallscope.session import stage

HOST = "www.shop.example"


def scenarios():
    ttl = {"fetch_cache_control": "max-age=3600"}
    long_pops = [event(url=f"/article/{u}", pop=p, time_start=at(u * 4 + i)) for u in range(30) for i, p in enumerate(("BMA", "FRA", "LHR", "AMS"))]
    near = [event(url=f"/u{u}", pop=p, **ttl) for u in range(600) for p in ("A", "B", "C", "D")] + [event(url="/u0", pop="A", **ttl)]
    flagged = [event(url=f"/f{i}", cache_status="HIT", ddos_action="blocked" if i < 2 else "") for i in range(10)]
    fwd = {"client_as_number": "20940", "client_as_name": "akamai international b.v.", "client_ip": "23.52.12.49",
           "original_x_forwarded_for": "135.132.91.21, 23.52.12.49", "request_via": "1.1 edge (ghost)", "origin_host": HOST}
    diverse_own = [
        {**e, "client_as_number": "20940", "client_as_name": "akamai international b.v.", "origin_host": HOST} for e in b.diverse_burst()
    ]
    return {
        "unique": b.unique_urls(200, **ttl),
        "stale": b.stale_content(**ttl),
        "pops": b.across_pops(**ttl),
        "bot": b.bots_on_cold_pop(**ttl),
        "nostore": b.across_pops(fetch_cache_control="no-store"),
        "shielded": b.across_pops(shielding_used=True, **ttl),
        "notcacheableflag": b.across_pops(is_cacheable=False, **ttl),
        "vary": b.stale_content(response_vary="Accept-Encoding, User-Agent", **ttl),
        "lowvary": b.stale_content(response_vary="Accept-Encoding", **ttl),
        "clustered": [event(url=f"/article/{u}", pop=p, time_start=at(0), **ttl) for u in range(30) for p in ("A", "B", "C", "D")]
        + [event(url="/article/0", pop="A", time_start=at(60), **ttl)],
        "organic": [{**e, **ttl} for e in long_pops],
        "near": near,
        "hit": [event(cache_status="HIT")],
        "pass200": [event(cache_status="PASS", fetch_action="pass_noheaders") for _ in range(25)],
        "pass301": [event(cache_status="PASS", status=301) for _ in range(30)],
        "pass429": [event(cache_status="PASS", status=429) for _ in range(30)],
        "cloud": b.cloud_burst(),
        "flagged": flagged,
        "oneip": b.one_ip_burst(),
        "diverse": b.diverse_burst(),
        "own": diverse_own,
        "ownflagged": [{**e, "ddos_action": "blocked"} for e in diverse_own],
        "forward": b.bots_on_cold_pop(**fwd, **ttl),
        "raise": b.ttl_pairs(fetch_cache_control="max-age=60"),
        "keep": b.ttl_pairs(fetch_cache_control="max-age=86400"),
        "none": b.ttl_pairs(),
        "r429": [event(url=f"/{i}", status=429 if i < 4 else 200, origin_status=503 if i == 9 else 200, deny_reason="rate" if i == 8 else "") for i in range(10)],
    }


@pytest.fixture(scope="module")
def reports(spark):
    rows = [r for name, part in scenarios().items() for r in service(part, name)]
    cnames = spark.createDataFrame([(HOST, HOST + ".edgekey.net", 0)], "host string, target string, ord bigint")
    base = b.cold_pop_baseline(spark, service="bot").unionByName(b.cold_pop_baseline(spark, service="forward"))
    return cr.analyse_events(events(spark, rows), base, cnames).cache()


@pytest.fixture(scope="module")
def found(reports):
    return {r.aem_service: r for r in reports.collect()}


def of(row, fid):
    return next((f for f in row.findings if f.signatureId == fid), None)


def text(f):
    return " ".join(f.evidence)


@pytest.mark.parametrize(
    "name, fid",
    [
        ("unique", "cdn-unique-url-burst"), ("stale", "cdn-stale-content"), ("pops", "cdn-pop-fragmentation"),
        ("bot", "cdn-bot-cold-pop"), ("nostore", "cdn-uncacheable"), ("notcacheableflag", "cdn-pop-fragmentation"),
    ],
)
def test_top_finding(found, name, fid):
    top = found[name].findings[0]
    assert (top.signatureId, top.confidence) == (fid, "high")
    assert found[name].verdictId == fid and "high confidence" in found[name].summary


def test_scores_fall(found):
    for r in found.values():
        scores = [f.confidenceScore for f in r.findings if f.rankGroup == 0]
        assert scores == sorted(scores, reverse=True) and all(s > 0 for s in scores)
    assert of(found["notcacheableflag"], "cdn-uncacheable") is None
    assert [f for f in found["hit"].findings if f.rankGroup == 0] == []


def test_informational_condition_does_not_count(found):
    f = of(found["clustered"], "cdn-pop-fragmentation")
    assert f.confidenceScore == 1.0
    assert next(c for c in f.matchedConditions if c.field == "coldFetchBurstRatio").observedValue.endswith("×")
    assert "clustered in time" in text(f) and "synchronized invalidation" in text(f)
    assert "organic per-POP traffic diversity" in text(of(found["organic"], "cdn-pop-fragmentation"))


def test_shield_lines(found):
    assert "shielding is OFF for 100%" in text(of(found["pops"], "cdn-pop-fragmentation"))
    assert "shielding is ON for 100%" in text(of(found["shielded"], "cdn-pop-fragmentation"))
    assert "requested only once" in text(of(found["unique"], "cdn-pop-fragmentation"))


def test_vary_lines(found):
    assert 'top values: "Accept-Encoding, User-Agent" (300×)' in text(of(found["vary"], "cdn-stale-content"))
    assert "high-cardinality header (User-Agent" in text(of(found["vary"], "cdn-stale-content"))
    assert "limited to lower-cardinality headers" in text(of(found["lowvary"], "cdn-stale-content"))
    assert "No Vary header observed" in text(of(found["stale"], "cdn-stale-content"))


def test_percent_near_the_edges(found):
    t = text(of(found["near"], "cdn-pop-fragmentation"))
    assert "99.96% of MISSes are the first fetch" in t and "0.04% of MISSes were already cached" in t
    assert "100% of MISSes are the first fetch" in text(of(found["pops"], "cdn-pop-fragmentation"))


def test_pass_findings(found):
    f = of(found["pass200"], "cdn-pass-200-bypass")
    assert f.confidence == "high" and "no cache headers" in text(f)
    assert "HTTP 301" in text(of(found["pass301"], "cdn-pass-non200"))
    assert of(found["pass429"], "cdn-pass-non200") is None and of(found["pass429"], "cdn-pass-200-bypass") is None


def test_ddos(found):
    f = of(found["cloud"], "cdn-ddos-pattern")
    assert f.confidence == "high" and "akamai" in text(f) and "[cloud/hosting]" in text(f)
    assert of(found["flagged"], "cdn-ddos-pattern").confidence == "high"
    f = of(found["oneip"], "cdn-ddos-pattern")
    assert "single client IP" in text(f) and "curl/8.0" in text(f)
    assert of(found["diverse"], "cdn-ddos-pattern") is None and of(found["hit"], "cdn-ddos-pattern") is None


def test_own_network_is_left_out(found):
    assert found["own"].upstream.provider == "akamai" and found["diverse"].upstream is None
    assert of(found["own"], "cdn-ddos-pattern") is None
    f = of(found["ownflagged"], "cdn-ddos-pattern")
    assert "own CDN (akamai) — confirmed via DNS (www.shop.example → www.shop.example.edgekey.net)" in text(f)
    assert "NOT akamai" in " ".join(f.nextSteps)
    assert next(c for c in f.matchedConditions if c.field == "cloudAsnRequestShare").observedValue == "0%"


def test_forwarder_line(found):
    t = text(of(found["forward"], "cdn-bot-cold-pop"))
    assert "AS20940 akamai international b.v. looks like this origin's own CDN forwarding real visitor traffic" in t
    assert "DNS confirms this origin is fronted by akamai" in t and "real end-user IP (135.132.91.21)" in t
    assert "(Via: 1.1 edge (ghost))" in t
    assert "looks like this origin's own CDN" not in text(of(found["bot"], "cdn-bot-cold-pop"))


def test_ttl_recommendation(found):
    f = of(found["raise"], "cdn-ttl-recommendation")
    assert (f.signatureName, f.confidence, f.confidenceScore) == ("Increase cache TTL to ~5m (current 60s)", "high", 0.9)
    assert of(found["none"], "cdn-ttl-recommendation").confidence == "medium"
    f = of(found["keep"], "cdn-ttl-recommendation")
    assert f.confidence == "low" and "do not lower" in f.signatureName and "max-age=" not in f.nextSteps[0]
    assert of(found["pops"], "cdn-ttl-recommendation") is None
    assert "max-age ~5m (current 60s), stale-while-revalidate ~7d (current none)" in text(of(found["raise"], "cdn-stale-content"))


def test_rate_limits(found):
    f = of(found["r429"], "cdn-rate-limit-429")
    assert (f.confidence, f.confidenceScore) == ("high", 1.0)
    assert [c.field for c in f.matchedConditions] == ["error429Count", "missWith429Count", "missShareOf429", "originError5xxCount", "cdnDeniedCount"]
    assert found["r429"].summary.endswith("4 HTTP 429s, 100% of them on MISSes.")


def test_order_and_summaries(found):
    order = [f.signatureId for f in found["pass301"].findings]
    assert order == ["cdn-pass-non200"]
    assert found["cloud"].summary.startswith("No cache MISSes in 220 events") and "220 PASS" in found["cloud"].summary
    groups = [f.rankGroup for f in found["raise"].findings]
    assert groups == sorted(groups)
    assert any("baseline query returned no data" in w for w in found["pops"].warnings)
    assert not any("baseline" in w for w in found["bot"].warnings)


def test_report_text(spark, reports, tmp_path):
    lines = [r.line for r in cr.report_lines(reports).where("aem_service = 'raise'").orderBy("line_no").collect()]
    assert lines[0] == "# CDN Cache Miss Analysis — raise" and "## Findings" in lines
    assert "- TTL: current 60s, recommended ~300s (req rate 12.0/min; P90 gap shield 120s / edge 120s)" in lines
    cr.write_reports(reports.where("aem_service in ('raise', 'hit')"), str(tmp_path / "out"))
    stored = {r.aem_service for r in spark.read.text(str(tmp_path / "out")).select("aem_service").distinct().collect()}
    assert stored == {"raise", "hit"}


def test_cap_warning(spark):
    rep = cr.analyse_events(events(spark, b.unique_urls(20)), max_events=10).collect()[0]
    assert rep.totalRequests == 10 and "10-event cap" in rep.warnings[0]


def test_number_text(spark):
    cells = {
        percent("0.9995584D"): "99.96%", percent("1.0D"): "100%", percent("0.0D"): "0%", percent("0.004D"): "0.40%", percent("0.455D"): "46%",
        duration("0"): "0s", duration("89"): "89s", duration("90"): "2m", duration("5400"): "1.5h", duration("7200"): "2h", duration("172800"): "2d",
        duration("26460"): "7.3h", decimals("1.005D", 2): "1.00", decimals("2.5D", 0): "3", decimals("0.125D", 2): "0.13",
    }
    row = spark.range(1).select(*[F.expr(sql).alias(str(i)) for i, sql in enumerate(cells)]).collect()[0]
    assert [row[str(i)] for i in range(len(cells))] == list(cells.values())


def test_chains(spark):
    records = [("a.x", "b.x", 0), ("b.x", "E1.Akamaiedge.NET.", 0), ("c.x", "d.x", 0), ("loop", "loop", 0), ("two", "z.fastly.net", 1), ("two", "plain.x", 0)]
    long = [(f"h{i}", f"h{i + 1}", 0) for i in range(12)] + [("h13", "x.fastly.net", 0), ("k0", "x.fastly.net", 0)]
    cnames = spark.createDataFrame(records + long, "host string, target string, ord bigint")
    hosts = spark.createDataFrame([(h,) for h in ("a.x", "c.x", "loop", "two", "", "h0", "k0", "www.cdn77.net", "nope")], "host string")
    got = {r.hostname: (r.chain, r.provider) for r in resolve_upstream(hosts, cnames).collect()}
    assert got == {
        "a.x": (["b.x", "E1.Akamaiedge.NET."], "akamai"), "k0": (["x.fastly.net"], "fastly"), "www.cdn77.net": ([], "cdn77"),
    }
    suffixes = spark.createDataFrame([("fastly.net", "f", 1), ("x.fastly.net", "first", 0)], "suffix string, provider string, ord int")
    pairs = spark.createDataFrame([("a.x.fastly.net.",), ("fastly.net",), ("notfastly.net",)], "host string")
    assert {r.host: r.provider for r in match_suffixes(stage(pairs, "p"), suffixes).collect()} == {"a.x.fastly.net.": "first", "fastly.net": "f"}


def test_all_chains_by_doubling(spark):
    """Random records with cycles, dead ends and shared targets: walk, doubling and plain Python agree; 4 rounds, hot targets dealt."""
    import random

    from stallscope.session import Staging

    rnd = random.Random(5)
    names = [f"n{i}.x" for i in range(300)]
    first = {n: rnd.choice(["hub.x", "hub.x", rnd.choice(names), rnd.choice(names), "e.fastly.net", "nowhere.x"]) for n in names}
    first |= {f"line{i}.x": f"line{i + 1}.x" for i in range(12)} | {"line12.x": "L.Akamaiedge.net.", "hub.x": "hub2.x", "hub2.x": "c.cloudfront.net"}
    first |= {"ring0.x": "ring1.x", "ring1.x": "ring2.x", "ring2.x": "ring0.x", "self.x": "self.x", "www.cdn77.net": "n1.x"}
    cnames = spark.createDataFrame([(h, t, 0) for h, t in first.items()] + [("hub.x", "a.x", 1), ("void.x", None, 0)], "host string, target string, ord bigint")
    hosts = spark.createDataFrame([(h,) for h in [*first, *names[:9], "", "nope", None, "void.x"]], "host string")
    known = {"e.fastly.net": "fastly", "c.cloudfront.net": "amazon", "L.Akamaiedge.net.": "akamai", "www.cdn77.net": "cdn77"}
    want = {}
    for host in first:
        chain, at = [], host
        while at not in known and at in first and len(chain) < 9:
            at = first[at]
            chain.append(at)
        if at in known:
            want[host] = (chain, known[at])
    assert {len(c) for c, _ in want.values()} >= {0, 1, 2, 3, 8, 9} and "line3.x" not in want
    for found in (resolve_upstream(hosts, cnames), resolve_upstream_all(hosts, cnames, hot_rows=5)):
        rows = found.collect()
        assert len(rows) == len(want) and {r.hostname: (r.chain, r.provider) for r in rows} == want
    assert len(jump_tables(first_targets(cnames), Staging(spark, "t"), 10, 5)) == 5
    assert resolve_upstream_all(hosts.limit(0), cnames).count() == 0
    assert {r.hostname for r in resolve_upstream_all(hosts, cnames.limit(0)).collect()} == {"www.cdn77.net"}
