"""Ranked findings of the cache-miss metrics, one metrics row at a time.

Everything here is an expression over one row per service, so findings need no shuffle: the list of
findings of a service is built, filtered and sorted inside its row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallscope.functions import cdn_texts as tx
from stallscope.functions.sqltext import decimals, duration, integer, percent, quote, short_decimals
from stallscope.session import stage

NO_TEXTS = "cast(array() AS array<string>)"
UPSTREAM_TYPE = "struct<hostname: string, chain: array<string>, provider: string>"
FORWARDED = "a.forwardedSample IS NOT NULL"


FORMATS = {
    "pct": percent,
    "dur": duration,
    "int": integer,
    "f1": lambda x: decimals(x, 1),
    "f2": lambda x: decimals(x, 2),
    "n2": lambda x: short_decimals(x, 2),
    "orNone": lambda x: f"CASE WHEN {x} > 0 THEN {duration(x)} ELSE 'none' END",
    "orAsk": lambda x: f"coalesce(nullif({x}, ''), '?')",
}


def value(hole: str) -> str:
    """SQL text of one hole; ``[fmt:x]`` inside an expression is formatted too."""
    m = re.match(r"^(\w+):(.+)$", hole, re.S)
    if m and m.group(1) in FORMATS:
        return FORMATS[m.group(1)](m.group(2).strip())
    if hole == "@url":
        return url_reason()
    inner = re.sub(r"\[(\w+):([^\]]+)\]", lambda k: FORMATS[k.group(1)](k.group(2)), hole)
    return f"cast(({inner}) AS string)"


def fill(template: str) -> str:
    """SQL that fills the holes of a text."""
    parts = [p for p in re.split(r"(\{[^{}]+\})", template) if p]
    sql = [value(p[1:-1]) if p.startswith("{") else quote(p) for p in parts]
    return sql[0] if len(sql) == 1 else f"concat({', '.join(sql)})"


def when(cond: str | None, sql: str) -> str:
    return sql if cond is None else f"CASE WHEN {cond} THEN {sql} END"


def url_reason() -> str:
    cases = " ".join(f"WHEN {cond} THEN {fill(text)}" for cond, text in tx.URL_REASONS)
    return f"CASE {cases} END"


def listing(spec: str) -> str:
    """An array of lines for ``@name n``."""
    name, n = spec[1:].split()
    if name == "forwarders":
        return f"array_compact(transform(slice(topAsns, 1, {n}), a -> {forwarder()}))"
    array, cond, var, text = tx.LISTS[name]
    rows = array if cond is None else f"filter({array}, {var} -> {cond})"
    return f"transform(slice({rows}, 1, {n}), {var} -> {fill(text)})"


def provider_match(name: str) -> str:
    return (
        f"coalesce({name} <> '' AND upstream.provider <> '' AND "
        f"regexp_like({name}, concat('(?i)\\\\b\\\\Q', upstream.provider, '\\\\E\\\\b')), false)"
    )


def forwarder() -> str:
    """Why a network that tops the list may be the origin's own front door; null without proof."""
    dns = provider_match("a.name")
    proof = f"array_compact(array({when(dns, fill(tx.FORWARDER_DNS))}, {when(FORWARDED, fill(tx.FORWARDER_HEADERS))}))"
    return f"CASE WHEN {dns} OR {FORWARDED} THEN concat({fill(tx.FORWARDER)}, array_join({proof}, '; '), '.') END"


def miss_reason() -> str:
    more = f"CASE WHEN {tx.NOT_CACHEABLE} >= 0.3 THEN {fill(tx.MISS_REASON_DIRECTIVE)} ELSE '' END"
    return f"concat({fill(tx.MISS_REASON)}, {more})"


def text_lines(items: list[tuple[str | None, str]]) -> str:
    """An array of the lines whose condition holds; lists among them are spliced in."""
    groups = []
    for cond, text in items:
        if text == "@reason":
            groups.append(f"array({miss_reason()})")
        elif text.startswith("@"):
            groups.append(when(cond, listing(text)))
        else:
            groups.append(when(cond, f"array({fill(text)})"))
    return f"flatten(array_compact(array({', '.join(groups)})))" if groups else NO_TEXTS


def texts(items: list[str]) -> str:
    return f"array({', '.join(quote(i) for i in items)})" if items else NO_TEXTS


def matched_item(field: str, description: str, observed: str) -> str:
    return f"named_struct('field', {quote(field)}, 'description', {quote(description)}, 'observedValue', {fill(observed)})"


def unmatched_item(field: str, description: str) -> str:
    return f"named_struct('field', {quote(field)}, 'description', {quote(description)}, 'required', true)"


NO_UNMATCHED = "cast(array() AS array<struct<field: string, description: string, required: boolean>>)"


def finding(group: int, fid: str, name: str, conf: str, score: str, matched: str, unmatched: str, evidence: str, steps: str, related: list[str]) -> str:
    return (
        f"named_struct('rankGroup', {group}, 'signatureId', {quote(fid)}, 'signatureName', {name}, 'confidence', {conf}, "
        f"'confidenceScore', cast({score} AS double), 'matchedConditions', {matched}, 'unmatchedConditions', {unmatched}, "
        f"'evidence', {evidence}, 'nextSteps', {steps}, 'relatedSignatures', {texts(related)})"
    )


def hypothesis(h: dict) -> str:
    """One hypothesis: its score is the share of its counting conditions that hold."""
    conds = h["conditions"]
    scored = [c for c in conds if c[4]]
    hits = " + ".join(f"CASE WHEN {c[2]} THEN 1 ELSE 0 END" for c in scored)
    score = f"(({hits}) / {len(scored)}.0D)"
    conf = f"CASE WHEN {score} >= 0.8 THEN 'high' WHEN {score} >= 0.5 THEN 'medium' ELSE 'low' END"
    matched = ", ".join(when(c[2], matched_item(c[0], c[1], c[3])) for c in conds)
    unmatched = ", ".join(when(f"NOT ({c[2]})", unmatched_item(c[0], c[1])) for c in scored)
    return finding(
        0, h["id"], quote(h["name"]), conf, score, f"array_compact(array({matched}))",
        f"array_compact(array({unmatched}))", text_lines(tx.EVIDENCE[h["id"]]), texts(h["steps"]), h["related"],
    )


def context(fid: str, name: str, conf: str, score: str) -> str:
    c = tx.CONTEXT[fid]
    matched = ", ".join(when(cond, matched_item(field, desc, observed)) for cond, field, desc, observed in c["matched"])
    return finding(
        1, fid, name, conf, score, f"array_compact(array({matched}))", NO_UNMATCHED, text_lines(tx.EVIDENCE[fid]),
        text_lines(c["steps"]), c["related"],
    )


SCORE_OF = "CASE {c} WHEN 'high' THEN 0.9D WHEN 'medium' THEN 0.6D ELSE 0.3D END"


def hypotheses_sql() -> str:
    """Hypotheses with a score above zero, best first, in table order on a tie."""
    every = f"array({', '.join(hypothesis(h) for h in tx.HYPOTHESES)})"
    kept = f"filter({every}, h -> missCount > 0 AND h.confidenceScore > 0)"
    return (
        f"array_sort({kept}, (x, y) -> CASE WHEN x.confidenceScore > y.confidenceScore THEN -1 "
        "WHEN x.confidenceScore < y.confidenceScore THEN 1 ELSE 0 END)"
    )


def ddos_sql() -> str:
    c = tx.CONTEXT["cdn-ddos-pattern"]
    body = context("cdn-ddos-pattern", quote(c["name"]), "ddos_confidence", SCORE_OF.format(c="ddos_confidence"))
    return when("signal_count > 0", body)


def ttl_sql() -> str:
    name = f"CASE WHEN raise THEN {fill(tx.TTL_RAISE_NAME)} ELSE {fill(tx.TTL_KEEP_NAME)} END"
    body = context("cdn-ttl-recommendation", name, "ttl_confidence", SCORE_OF.format(c="ttl_confidence"))
    return when("ttlDataSufficient = 1 AND recommendedTtlSeconds > 0", body)


def rate_limit_sql() -> str:
    conf = "CASE WHEN missShareOf429 >= 0.5 THEN 'high' WHEN missShareOf429 > 0 THEN 'medium' ELSE 'low' END"
    fid = "cdn-rate-limit-429"
    return when("error429Count > 0", context(fid, quote(tx.CONTEXT[fid]["name"]), conf, "missShareOf429"))


def pass_sql(fid: str, count: str, share: str) -> str:
    conf = f"CASE WHEN {share} >= 0.7 THEN 'high' ELSE 'medium' END"
    return when(f"{count} >= 20 AND {share} >= 0.5", context(fid, quote(tx.CONTEXT[fid]["name"]), conf, share))


def with_signals(metrics: DataFrame) -> DataFrame:
    """Columns shared by the context findings: upstream exclusion, burst signals, TTL direction."""
    if "upstream" not in metrics.columns:
        metrics = metrics.withColumn("upstream", F.expr(f"cast(null AS {UPSTREAM_TYPE})"))
    total = "greatest(totalRequests, 1)"
    steps = [
        {"x_matched": f"filter(topSourceAsns, a -> {provider_match('a.name')})"},
        {"x_share": f"coalesce(aggregate(x_matched, 0L, (s, a) -> s + a.count), 0L) / {total}"},
        {"own_cdn": "upstream IS NOT NULL AND x_share > 0"},
        {"x_rest": "CASE WHEN own_cdn THEN filter(topSourceAsns, a -> NOT exists(x_matched, b -> b.asn = a.asn)) ELSE topSourceAsns END"},
        {
            "x_next": "get(x_rest, 0)",
            "x_sample": "get(x_matched, 0).forwardedSample",
            "x_cloud": "CASE WHEN own_cdn THEN greatest(0.0D, cloudAsnRequestShare - x_share) ELSE cloudAsnRequestShare END",
        },
        {
            "x_topShare": f"CASE WHEN own_cdn THEN coalesce(x_next.count / {total}, 0.0D) ELSE topAsnRequestShare END",
            "x_topName": "CASE WHEN own_cdn THEN coalesce(x_next.name, '') ELSE topAsnRequestName END",
            "x_shown": "CASE WHEN exists(x_rest, a -> a.cloud) THEN filter(x_rest, a -> a.cloud) "
            "WHEN size(x_rest) > 0 THEN x_rest ELSE topSourceAsns END",
        },
        {
            "cloud_burst": "x_cloud >= 0.4 AND (burstRatio >= 5 OR x_topShare >= 0.3)",
            "cdn_flagged": "cdnThreatShare >= 0.1",
            "ip_burst": "topClientIpRequestShare >= 0.2 AND burstRatio >= 5",
            "ua_burst": "topUserAgentRequestShare >= 0.6 AND burstRatio >= 5",
            "country_burst": "topCountryRequestShare >= 0.6 AND burstRatio >= 5",
            "raise": "observedMaxAgeSeconds = 0 OR recommendedTtlSeconds > observedMaxAgeSeconds",
            "swr_raise": "recommendedSwrSeconds > 0 AND (observedSwrSeconds = 0 OR recommendedSwrSeconds > observedSwrSeconds)",
        },
        {
            "keep": "NOT raise",
            "signal_count": "cast(cloud_burst AS int) + cast(cdn_flagged AS int) + cast(ip_burst AS int) + cast(ua_burst AS int) "
            "+ cast(country_burst AS int)",
            "ttl_confidence": "CASE WHEN raise AND observedMaxAgeSeconds > 0 THEN 'high' WHEN raise THEN 'medium' ELSE 'low' END",
        },
        {
            "ddos_confidence": "CASE WHEN cdn_flagged OR x_cloud >= 0.8 OR (x_cloud >= 0.5 AND burstRatio >= 8) OR signal_count >= 2 "
            "THEN 'high' ELSE 'medium' END"
        },
    ]
    for s in steps:
        metrics = metrics.withColumns({k: F.expr(v) for k, v in s.items()})
    return metrics


SIGNAL_COLUMNS = [
    "x_matched", "x_share", "own_cdn", "x_rest", "x_next", "x_sample", "x_cloud", "x_topShare", "x_topName", "x_shown",
    "cloud_burst", "cdn_flagged", "ip_burst", "ua_burst", "country_burst", "raise", "keep", "swr_raise", "signal_count",
    "ttl_confidence", "ddos_confidence",
]


def classify(metrics: DataFrame) -> DataFrame:
    """Metrics rows with ``hypotheses`` (ranked) and ``findings`` (hypotheses, then context findings).

    An ``upstream`` column (hostname, chain, provider) names the origin's own content network, if known.
    """
    extra = [
        ddos_sql(), ttl_sql(), rate_limit_sql(),
        pass_sql("cdn-pass-200-bypass", "passWith200Count", "passWith200Share"),
        pass_sql("cdn-pass-non200", "passNon200Non429Count", "passNon200Non429Share"),
    ]
    rows = with_signals(metrics)
    rows = rows.withColumn("hypotheses", F.expr(hypotheses_sql()))
    rows = rows.withColumn("findings", F.expr(f"concat(hypotheses, array_compact(array({', '.join(extra)})))"))
    return rows.drop(*SIGNAL_COLUMNS)


def finding_rows(classified: DataFrame, keys: list[str]) -> DataFrame:
    """Findings as rows, ``rank`` giving their order in the report of a service.

    The few rows are written first: taken apart directly, the optimizer would build the whole list again
    for every column of a finding.
    """
    table = stage(classified.select(*keys, "findings"), "findings")
    return table.select(*keys, F.posexplode("findings").alias("rank", "f")).select(
        *keys, (F.col("rank") + 1).alias("rank"), "f.*"
    )
