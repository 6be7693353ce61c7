"""Access-log scans, metrics, findings and reports: Spark query and DuckDB SQL side by side."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from checks import views as v
from stallscope.functions import fixed
from stallscope.operators import cdn_findings as cf
from stallscope.operators import cdn_metrics as cm
from stallscope.operators import upstream as up
from stallscope.operators.quantile import exact_quantiles
from stallscope.plans import cdn_report as cr
from stallscope.session import checkpoint_dir, stage
from stallscope.session import Staging
from stallscope.sources import cdn_export as ce
from stallscope.sources import cdn_scan as scan
from stallscope.streaming import cdn_stream as st

CHECKS: dict[str, tuple] = {}
K = "aem_service, aem_tier"


def check(name: str, sql: str | None):
    def add(fn):
        CHECKS[name] = (fn, sql)
        return fn

    return add


def q(words):
    return ", ".join(f"'{w}'" for w in words)


BLANK = q(fixed.BLANK_FLAGS)
FLAG = lambda c: f"(lower(trim({c})) NOT IN ({BLANK}))"
AGE = (
    "coalesce(" + ", ".join(
        f"TRY_CAST(regexp_extract({h}, '(?i)(?:^|[^a-z-]){n}\\s*=\\s*0*([1-9][0-9]*)', 1) AS BIGINT)"
        for h in ("fetch_surrogate_control", "fetch_cache_control") for n in ("s-maxage", "max-age")
    ) + ")"
)
SWR = (
    "coalesce(" + ", ".join(
        f"TRY_CAST(regexp_extract({h}, '(?i)stale-while-revalidate\\s*=\\s*0*([1-9][0-9]*)', 1) AS BIGINT)"
        for h in ("fetch_surrogate_control", "fetch_cache_control")
    ) + ")"
)
NO_STORE = "(?i)(no-store|no-cache|private|max-age\\s*=\\s*0+(?:$|[^0-9]))"
CLOUD = "(?i)\\b(?:" + "|".join(fixed.CLOUD_WORDS) + ")\\b"
E = f"""{v.WITH_CDN}, s AS (SELECT *, coalesce(nullif(upper(trim(cache_status)), ''), nullif(upper(trim(fastly_info_state)), ''),
  nullif(upper(trim(response_x_cache)), ''), '') AS st FROM cdn_logs),
e AS (SELECT *, CASE WHEN starts_with(st, 'HITPASS') OR starts_with(st, 'PASS') THEN 'PASS' WHEN starts_with(st, 'MISS') THEN 'MISS'
  WHEN starts_with(st, 'HIT') THEN 'HIT' ELSE 'OTHER' END AS d, epoch_us(time_start) AS us, epoch_us(time_start) // 1000000 AS sec,
  {AGE} AS age, {SWR} AS swr, regexp_matches(fetch_cache_control, '{NO_STORE}') OR regexp_matches(fetch_surrogate_control, '{NO_STORE}') AS nostore,
  {FLAG('bot_name')} AS bot, regexp_matches(client_as_name, '{CLOUD}') AS cloud, status = 429 OR origin_status = 429 AS r429 FROM s)"""


def R(a: str, b: str) -> str:
    """A share rounded like the Spark side, 0 without a denominator."""
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0), 6)"


def events(spark, sf):
    return v.cdn_logs(spark, sf)


def tagged(spark, sf):
    return cm.tag_events(events(spark, sf))


def rounded(df, keep=()):
    return df.select(
        *[F.round(c, 6).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes]
    )


# Exports and scans ------------------------------------------------------------------------------------

# Columns that the view lacks, made from others.
EXPORT_MORE = {
    "server_region": "concat('region ', pop)", "server_hostname": "concat('cache-', lower(pop), '-1')",
    "cache_location": "CASE WHEN cache_status = 'HIT' THEN 'EDGE' ELSE 'ORIGIN_FETCH' END", "response_age": "response_ttl / 4",
}
EXPORT_COLUMNS = [
    "url", "request_user_agent", "fetch_surrogate_control", "fetch_cache_control", "cache_status", "fastly_info_state", "response_x_cache", "pop",
    "server_region", "server_hostname", "bot_name", "client_ip", "client_as_number", "client_as_name", "fetch_action", "cache_location", "content_type",
    "ddos_action", "ddos_rule", "malicious_flags", "deny_reason", "geo_country_code", "aem_service", "aem_tier", "origin_host", "original_x_forwarded_for",
    "response_vary", "status", "origin_status", "response_age", "response_ttl", "is_cacheable", "shielding_used", "request_via",
]
WITH_EXPORT = f"{v.WITH_CDN}, exported AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in EXPORT_MORE.items())} FROM cdn_logs)"
EXPORT_SQL = f"""{WITH_EXPORT} SELECT {', '.join(EXPORT_COLUMNS)}, epoch_us(time_start) // 1000000 AS second FROM exported"""


def exported(spark, sf):
    return v.cdn_logs(spark, sf, even=True).withColumns({c: F.expr(x) for c, x in EXPORT_MORE.items()})


def _raw_columns(df):
    """Events under their raw keys, as text."""
    text = {c: F.col(c).cast("string") for c in df.columns if c not in ("ord", "time_start", "pop", "request_via")}
    stamp = F.date_format(F.col("time_start").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'GMT'")
    return {**text, "server_datacenter": F.col("pop"), "xdata.request_via": F.col("request_via"), "time_start": stamp}


def _export(parsed):
    return parsed.select(*EXPORT_COLUMNS, F.unix_seconds("time_start").alias("second"))


@check("export_lines", EXPORT_SQL)
def export_lines(spark, sf):
    """Event lines, some wrapped, some with a trailing comma, between markers and broken lines."""
    e = exported(spark, sf)
    one = F.struct(*[c.alias(n) for n, c in _raw_columns(e).items()])
    wrapped = F.to_json(F.struct(F.lit("false").alias("preview"), one.alias("result")))
    line = F.when(F.col("ord") % 3 == 0, wrapped).when(F.col("ord") % 3 == 1, F.concat(F.to_json(one), F.lit(",  "))).otherwise(F.to_json(one))
    junk = F.element_at(F.array(*[F.lit(x) for x in ("", "[", "]", "{bad", '{"preview":false,"lastrow":true}', "{}")]), (F.col("ord") % 6 + 1).cast("int"))
    lines = e.select("ord", F.explode(F.array(line, junk)).alias("value"))
    return _export(ce.parse_lines(lines))


@check("export_raw_json", EXPORT_SQL)
def export_raw_json(spark, sf):
    """Events inside ``_raw`` as JSON; the explicit address wins over the one inside."""
    e = exported(spark, sf)
    cols = {n: c for n, c in _raw_columns(e).items() if n not in ("url", "xdata.request_via")}
    inner = F.struct(
        F.lit("/shadowed").alias("url"), F.struct(F.col("request_via")).alias("xdata"), *[c.alias(n) for n, c in cols.items()]
    )
    lines = e.select("ord", F.to_json(F.struct("url", F.to_json(inner).alias("_raw"))).alias("value"))
    return _export(ce.parse_lines(lines))


def _kv(e):
    """Events as key-value blocks. The lines are made by a higher-order function, which keeps them out of the generated loop of the
    view: fused, both are one method that is too long for the JIT compiler and is interpreted for every event."""
    members = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in _raw_columns(e).items()])
    parts = F.transform(members, lambda m: F.concat(m["key"], F.lit(": "), m["value"]))
    head = [F.lit(x) for x in ("{ [-]", "  url: /replaced by the last line", "  xdata: { [+]", "  }")]
    return F.concat_ws("\n", *head, parts, F.lit("}"))


@check("export_raw_kv", EXPORT_SQL)
def export_raw_kv(spark, sf):
    e = exported(spark, sf)
    return _export(ce.parse_lines(e.select("ord", F.to_json(F.struct(_kv(e).alias("_raw"))).alias("value"))))


@check("export_kv_blocks", EXPORT_SQL)
def export_kv_blocks(spark, sf):
    e = exported(spark, sf)
    return _export(ce.parse_documents(e.select("ord", _kv(e).alias("value"))))


@check("export_documents", EXPORT_SQL)
def export_documents(spark, sf):
    """Documents of at most 50 events: arrays, wrappers of two kinds, single objects, event lines."""
    e = exported(spark, sf)
    one = F.struct(*[c.alias(n) for n, c in _raw_columns(e).items()])
    kind = F.floor(F.col("ord") / 50) % 5
    docs = e.select(F.floor(F.col("ord") / 50).alias("doc"), kind.alias("kind"), "ord", F.to_json(one).alias("j"))
    many = docs.where("kind < 4").groupBy("doc", "kind").agg(F.collect_list("j").alias("l"))
    joined = F.array_join("l", ",\n")
    text = (
        F.when(F.col("kind") == 0, F.concat(F.lit("[\n"), joined, F.lit("]")))
        .when(F.col("kind") == 1, F.concat(F.lit('{"results": ['), joined, F.lit("]}")))
        .when(F.col("kind") == 2, F.concat(F.lit('{"result": ['), joined, F.lit("]}")))
        .otherwise(F.array_join("l", "\n"))
    )
    single = docs.where("kind = 4").select(
        F.col("ord").alias("doc"),
        F.when(F.col("ord") % 2 == 0, F.concat(F.lit('{"result":\n '), "j", F.lit("}"))).otherwise(F.col("j")).alias("value"),
    )
    return _export(ce.parse_documents(many.select("doc", text.alias("value")).unionByName(single)))


NOTE = "{note: [not json"
RAW_MAP_SQL = f"""{WITH_EXPORT}, kept AS (SELECT *, CAST(ord AS VARCHAR) AS id FROM exported)
SELECT ord, 'url' AS key, url AS value FROM kept UNION ALL SELECT ord, 'status', CAST(status AS VARCHAR) FROM kept
UNION ALL SELECT ord, 'edge.pop.name', pop FROM kept UNION ALL SELECT ord, 'edge.pop.load', concat(id, ',1.5,x') FROM kept
UNION ALL SELECT ord, 'edge.live', CASE WHEN is_cacheable THEN 'true' ELSE 'false' END FROM kept
UNION ALL SELECT ord, 'edge.a.b.c.d.e.f', id FROM kept UNION ALL SELECT ord, 'xdata.request_via', request_via FROM kept
UNION ALL SELECT ord, 'note', '{NOTE}' FROM kept UNION ALL SELECT ord, concat('k', client_as_number), client_ip FROM kept
UNION ALL SELECT ord, 'seen', 'explicit' FROM kept UNION ALL SELECT ord, 'bot', bot_name FROM kept WHERE bot_name <> ''"""


@check("export_raw_map", RAW_MAP_SQL)
def export_raw_map(spark, sf):
    """The untyped record of every event: nested members of any name and depth under ``_raw``, numbers, flags, lists, nulls, keys
    that differ from event to event, and explicit members that win."""
    e = exported(spark, sf)
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    inner = F.concat(
        F.lit('{"url": "/shadowed", "gone": null, "none": {}, "seen": "in raw", "edge": {"pop": {"name": '), text("pop"), F.lit(', "load": ['), F.col("ord").cast("string"),
        F.lit(', 1.50, "x"]}, "live": '), F.col("is_cacheable").cast("string"), F.lit(', "a": {"b": {"c": {"d": {"e": {"f": '), F.col("ord").cast("string"),
        F.lit('}}}}}}, "xdata": {"request_via": '), text("request_via"), F.lit(f'}}, "note": "{NOTE}", "k'), F.col("client_as_number"), F.lit('": '), text("client_ip"), F.lit("}"),
    )
    one = F.struct("url", "status", F.lit("explicit").alias("seen"), F.nullif("bot_name", F.lit("")).alias("bot"), inner.alias("_raw"))
    lines = e.select("ord", F.when(F.col("ord") % 2 == 0, F.to_json(F.struct(one.alias("result")))).otherwise(F.to_json(one)).alias("value"))
    return ce.parse_lines(lines, keep_raw=True).select("ord", F.explode("raw"))


def _single_line(e, size, opening, closing):
    """Documents of ``size`` events on one line: doc and the pieces to be written one after another."""
    one = F.to_json(F.struct(*[c.alias(n) for n, c in _raw_columns(e).items()]))
    rows = e.select(F.floor(F.col("ord") / size).alias("doc"), "ord", one.alias("j"))
    ends = rows.groupBy("doc").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    head, tail = F.when(F.col("ord") == F.col("first"), opening).otherwise(""), F.when(F.col("ord") == F.col("last"), closing).otherwise(",")
    return rows.join(ends, "doc").select("doc", "ord", F.concat(head, "j", tail).alias("value"))


def _write(rows, folder, kind, separator):
    near = rows.repartition("doc").sortWithinPartitions("doc", "ord").select(F.lit(kind).alias("kind"), "doc", "value")
    near.write.mode("append").option("lineSep", separator).partitionBy("kind", "doc").text(folder)


@check("export_split_documents", EXPORT_SQL)
def export_split_documents(spark, sf):
    """Files of one line each that hold up to 5,000 events, as arrays and as wrappers, read as records."""
    e, staging = exported(spark, sf), Staging(spark, "export-documents")
    folder = f"{staging.root}/documents"
    _write(_single_line(e.where("ord % 2 = 0"), 10_000, "[", "]"), folder, "array", " ")
    _write(_single_line(e.where("ord % 2 = 1"), 10_000, '{"preview": false, "results": [', "]}"), folder, "wrapper", " ")
    return _export(ce.read_documents(spark, folder))


@check("export_files", EXPORT_SQL)
def export_files(spark, sf):
    """A folder of event lines, arrays of one line and key-value blocks: every file is read in the shape that it has."""
    e, staging = exported(spark, sf), Staging(spark, "export-files")
    folder = f"{staging.root}/files"
    block = F.col("ord") % 500 == 7
    _write(e.where(block).select(F.col("ord").alias("doc"), "ord", _kv(e).alias("value")), folder, "block", "\n")
    _write(_single_line(e.where(~block & (F.col("ord") % 2 == 0)), 10_000, "[", "]"), folder, "array", " ")
    one = F.to_json(F.struct(*[c.alias(n) for n, c in _raw_columns(e).items()]))
    _write(e.where(~block & (F.col("ord") % 2 == 1)).select((F.col("ord") % 3).alias("doc"), "ord", one.alias("value")), folder, "line", "\n")
    return _export(ce.read_export(spark, folder))


@check("export_saved", EXPORT_SQL)
def export_saved(spark, sf):
    """Raw lines that were saved give the same events when they are read again."""
    e, folder = exported(spark, sf), f"{Staging(spark, 'export-saved').root}/lines"
    one = F.to_json(F.struct(*[c.alias(n) for n, c in _raw_columns(e).items()]))
    ce.save_raw(e.select("ord", one.alias("value")), folder)
    return _export(ce.read_export(spark, folder))


WINDOW = ("2024-01-10T00:00:00Z", "2024-01-12T12:00:00Z")
IN_WINDOW = "time_start >= TIMESTAMP '2024-01-10 00:00:00' AND time_start < TIMESTAMP '2024-01-12 12:00:00'"


def _stamped(spark, sf):
    e = events(spark, sf)
    return e.withColumn("time_start", F.col("time_start").cast("timestamp"))


@check(
    "incident_scan",
    f"""{v.WITH_CDN} SELECT ord, aem_service, url FROM cdn_logs WHERE aem_service = 'svc-1' AND aem_tier = 'publish' AND {IN_WINDOW}
  AND (url ILIKE '/view/1%' OR url ILIKE '/ERROR/%')""",
)
def incident_scan(spark, sf):
    rows = scan.incident_events(_stamped(spark, sf), *WINDOW, service="svc-1", urls=["/view/1*", " /ERROR/* ", ""])
    return rows.select("ord", "aem_service", "url")


@check(
    "incident_scan_relative",
    f"""{v.WITH_CDN} SELECT {K}, count(*) AS n FROM cdn_logs WHERE time_start >= TIMESTAMP '2024-01-19 00:00:00'
  AND time_start < TIMESTAMP '2024-01-20 07:30:00' GROUP BY 1, 2""",
)
def incident_scan_relative(spark, sf):
    now = F.lit("2024-01-20 07:30:12").cast("timestamp")
    rows = scan.incident_events(_stamped(spark, sf), "-1d@d", "@m", tier="*", now=now)
    return rows.groupBy("aem_service", "aem_tier").agg(F.count("*").alias("n"))


BASELINE_SQL = """SELECT aem_service, aem_tier, pop, count(*) AS count FROM cdn_logs
  WHERE time_start >= TIMESTAMP '2024-01-08 00:00:00' AND time_start < TIMESTAMP '2024-01-10 00:00:00' AND pop <> '' GROUP BY 1, 2, 3"""


def baseline(spark, sf):
    return scan.pop_baseline(_stamped(spark, sf), WINDOW[0], tier="*", days=5)


@check("pop_baseline", f"{v.WITH_CDN} {BASELINE_SQL}")
def pop_baseline(spark, sf):
    return baseline(spark, sf)


CAP = 600


@check(
    "event_cap",
    f"""{v.WITH_CDN} SELECT ord, aem_service, aem_tier FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY time_start, ord) AS rn
  FROM cdn_logs) WHERE rn <= {CAP}""",
)
def event_cap(spark, sf):
    return scan.cap_events(events(spark, sf), CAP).select("ord", "aem_service", "aem_tier")


@check("event_cap_reached", f"{v.WITH_CDN} SELECT {K}, count(*) AS events, count(*) >= {CAP} AS truncated FROM cdn_logs GROUP BY 1, 2")
def event_cap_reached(spark, sf):
    return scan.truncation(events(spark, sf), CAP)


# Conversions ------------------------------------------------------------------------------------------


@check(
    "conversions",
    r"""SELECT event_id, CAST(round(value * 100) AS BIGINT) / 100.0 AS num, k % 3 = 0 AS flag, CASE WHEN k % 2 = 0 THEN epoch_us(ts) // 1000000 ELSE epoch_us(ts) // 1000 END AS stamp,
  CASE WHEN (floor(p + 0.5) = 100 AND p < 100) OR (floor(p + 0.5) = 0 AND p > 0) THEN format('{:.2f}%', p) ELSE concat(CAST(floor(p + 0.5) AS BIGINT), '%') END AS pct,
  CASE WHEN s <= 0 THEN '0s' WHEN s < 90 THEN concat(CAST(floor(s + 0.5) AS BIGINT), 's') WHEN s < 5400 THEN concat(CAST(floor(s / 60 + 0.5) AS BIGINT), 'm')
    WHEN s < 172800 THEN concat(CASE WHEN s % 3600 = 0 THEN format('{:.0f}', s / 3600) ELSE format('{:.1f}', s / 3600) END, 'h')
    ELSE concat(CAST(floor(s / 86400 + 0.5) AS BIGINT), 'd') END AS dur
FROM (SELECT *, (event_id % 401) / 400.0 * 100 AS p, CAST(k * k * 60 AS DOUBLE) AS s FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events))""",
)
def conversions(spark, sf):
    from stallscope.functions import convert, sqltext

    e = v.table(spark, sf, "events").withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))
    cents = F.format_string("%.2f", F.round(F.col("value") * 100).cast("bigint") / 100)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    flag = F.when(F.col("k") % 3 == 0, F.element_at(F.array(F.lit(" True"), F.lit("1"), F.lit("YES ")), (F.col("event_id") % 3 + 1).cast("int"))).otherwise("no")
    secs, ms = F.floor(us / 1000000).cast("string"), F.floor(us / 1000).cast("string")
    stamp = F.when(F.col("k") % 2 == 0, convert.to_time(secs)).otherwise(convert.to_time(ms))
    return e.select(
        "event_id",
        convert.to_number(F.concat(F.lit("  "), cents, F.lit(" ms"))).alias("num"),
        convert.to_bool(flag).alias("flag"),
        F.when(F.col("k") % 2 == 0, F.unix_seconds(stamp)).otherwise(F.unix_millis(stamp)).alias("stamp"),
        F.expr(sqltext.percent("event_id % 401 / 400.0D")).alias("pct"),
        F.expr(sqltext.duration("k * k * 60")).alias("dur"),
    )


# Metrics ----------------------------------------------------------------------------------------------


@check("disposition", f"{E} SELECT {K}, d AS disposition, count(*) AS n FROM e GROUP BY 1, 2, 3")
def disposition(spark, sf):
    return tagged(spark, sf).groupBy("aem_service", "aem_tier", F.col("d").alias("disposition")).agg(F.count("*").alias("n"))


HIGH_VARY = "(?i)(?:" + "|".join(fixed.HIGH_CARDINALITY_VARY) + ")"
VOLUME_SQL = f"""{E}, a AS (SELECT {K}, count(*) AS n, count(*) FILTER (d = 'MISS') AS m, count(*) FILTER (d = 'HIT') AS h, count(*) FILTER (d = 'PASS') AS p,
  count(*) FILTER (d = 'OTHER') AS o, count(*) FILTER (d = 'PASS' AND status = 200) AS p200, count(*) FILTER (d = 'PASS' AND status <> 200) AS pn200,
  count(*) FILTER (d = 'PASS' AND status = 429) AS p429, count(*) FILTER (d = 'PASS' AND status NOT IN (200, 429)) AS pn429,
  count(*) FILTER (d = 'PASS' AND status = 200 AND starts_with(fetch_action, 'pass_noheaders')) AS nohead,
  count(*) FILTER (d = 'PASS' AND status = 200 AND regexp_matches(fetch_action, '^pass_(s_)?private')) AS priv,
  count(*) FILTER (r429) AS e429, count(*) FILTER (r429 AND d = 'MISS') AS m429, count(*) FILTER (origin_status BETWEEN 500 AND 599) AS o5,
  count(*) FILTER ({FLAG('ddos_action')} OR {FLAG('deny_reason')}) AS den, count(*) FILTER (d = 'MISS' AND response_ttl > 0 AND response_ttl < 60) AS short,
  count(*) FILTER (d = 'MISS' AND regexp_matches(fetch_surrogate_control, '(?i)stale-(while-revalidate|if-error)')) AS stale,
  avg(response_ttl) FILTER (d = 'MISS' AND response_ttl > 0) AS ttl, count(*) FILTER (d = 'MISS' AND trim(response_vary) <> '') AS vary,
  count(*) FILTER (d = 'MISS' AND regexp_matches(response_vary, '{HIGH_VARY}')) AS hvary, count(*) FILTER (d = 'MISS' AND shielding_used) AS sh,
  count(*) FILTER (d = 'MISS' AND bot) AS b, count(*) FILTER (cloud) AS cl,
  count(*) FILTER ({FLAG('ddos_action')} OR {FLAG('ddos_rule')} OR {FLAG('malicious_flags')} OR {FLAG('deny_reason')}) AS thr,
  count(*) FILTER (d = 'MISS' AND NOT is_cacheable) AS nc, count(*) FILTER (d = 'MISS' AND starts_with(lower(fetch_action), 'pass')) AS mp,
  count(*) FILTER (d = 'MISS' AND age IS NULL) AS nottl, count(*) FILTER (d = 'MISS' AND nostore) AS nost,
  (max(us) FILTER (d IN ('MISS', 'HIT')) - min(us) FILTER (d IN ('MISS', 'HIT'))) / 1e6 AS win, greatest((max(us) - min(us)) / 1e6, 1) AS allwin,
  count(*) FILTER (d IN ('MISS', 'HIT')) AS cachen FROM e GROUP BY 1, 2),
vol AS (SELECT {K}, n AS "totalRequests", m AS "missCount", h AS "hitCount", p AS "passCount", o AS "otherCount", {R('m', 'm + h')} AS "missRatio",
  p200 AS "passWith200Count", {R('p200', 'p')} AS "passWith200Share", pn200 AS "passNon200Count", p429 AS "pass429Count", pn429 AS "passNon200Non429Count",
  {R('pn429', 'p')} AS "passNon200Non429Share", {R('nohead', 'p200')} AS "pass200NoHeadersShare", {R('priv', 'p200')} AS "pass200PrivateShare",
  e429 AS "error429Count", {R('e429', 'n')} AS "error429Ratio", m429 AS "missWith429Count", {R('m429', 'e429')} AS "missShareOf429",
  o5 AS "originError5xxCount", den AS "cdnDeniedCount", short AS "shortTtlMissCount", {R('short', 'm')} AS "shortTtlMissShare",
  {R('stale', 'm')} AS "staleEligibleMissShare", round(coalesce(ttl, 0), 6) AS "avgMissTtlSeconds", {R('vary', 'm')} AS "missVaryShare",
  {R('hvary', 'm')} AS "highCardinalityVaryMissShare", round(win, 6) AS "windowSeconds", {R('cachen * 60.0', 'win')} AS "cacheableRequestRatePerMin",
  {R('sh', 'm')} AS "shieldingUsedMissShare", b AS "botMissCount", {R('b', 'm')} AS "botMissShare", {R('cl', 'n')} AS "cloudAsnRequestShare",
  {R('thr', 'n')} AS "cdnThreatShare", {R('nc', 'm')} AS "cacheableFalseMissShare", {R('mp', 'm')} AS "misspassMissShare",
  {R('nottl', 'm')} AS "missNoPositiveTtlShare", {R('nost', 'm')} AS "missNoStoreShare" FROM a)"""


@check("metrics_volume", f"{VOLUME_SQL} SELECT * FROM vol")
def metrics_volume(spark, sf):
    return rounded(cm.volume(cm.volume_counts(tagged(spark, sf))).drop("_burstWindow", "_timed"))


URL_SQL = f"""{VOLUME_SQL}, up AS (SELECT {K}, url, pop, count(*) AS n, count(*) FILTER (d = 'MISS') AS miss, count(*) FILTER (d = 'MISS' AND bot) AS missbot,
  count(*) FILTER (d IN ('MISS', 'HIT')) AS cacheable, count(*) FILTER (d = 'PASS' AND status = 200) AS pass200, min(us) FILTER (d = 'MISS') AS first FROM e GROUP BY 1, 2, 3, 4),
u AS (SELECT {K}, url, CAST(sum(miss) AS BIGINT) AS miss, count(*) FILTER (miss > 0) AS pops, sum(cacheable) AS cacheable, CAST(sum(pass200) AS BIGINT) AS pass200 FROM up GROUP BY 1, 2, 3),
us AS (SELECT {K}, count(*) FILTER (miss > 0) AS du, count(*) FILTER (miss = 1) AS one, count(*) FILTER (miss > 1) AS rep, max(miss) AS most, CAST(sum(pops) AS BIGINT) AS pairs,
  CAST(sum(miss) AS BIGINT) AS m, avg(pops) FILTER (miss > 1) AS ap, count(*) FILTER (miss > 1 AND pops > 1) AS multi, count(*) FILTER (cacheable > 0) AS cu,
  count(*) FILTER (cacheable = 1) AS c1 FROM u GROUP BY 1, 2),
urls AS (SELECT {K}, du AS "distinctMissUrlCount", {R('du', 'm')} AS "uniqueMissUrlRatio", one AS "singleRequestMissUrlCount", {R('one', 'du')} AS "singleRequestMissUrlShare",
  rep AS "repeatedMissUrlCount", most AS "maxRequestsForSingleMissUrl", pairs AS "distinctUrlPopPairs", pairs AS "firstFetchPerPopMissCount",
  {R('pairs', 'm')} AS "coldPopFirstFetchShare", m - pairs AS "repeatSamePopMissCount", {R('m - pairs', 'm')} AS "repeatSamePopShare",
  {R('c1', 'cu')} AS "singleRequestCacheableUrlShare", round(coalesce(ap, 0), 6) AS "avgPopsPerRepeatedMissUrl", multi AS "repeatedUrlMultiPopCount",
  {R('multi', 'rep')} AS "repeatedUrlMultiPopShare" FROM us)"""


@check("metrics_urls", f"{URL_SQL} SELECT * FROM urls")
def metrics_urls(spark, sf):
    return rounded(cm.url_metrics(cm.url_counts(cm.url_pop_counts(tagged(spark, sf)))))


@check(
    "metrics_first_fetch",
    f"""{E}, r AS (SELECT *, row_number() OVER (PARTITION BY {K}, url, pop ORDER BY us, ord) AS rn FROM e WHERE d = 'MISS')
SELECT {K}, count(*) FILTER (rn = 1) AS "firstFetchPerPopMissCount", count(*) FILTER (rn > 1) AS "repeatSamePopMissCount" FROM r GROUP BY 1, 2""",
)
def metrics_first_fetch(spark, sf):
    m = cm.url_metrics(cm.url_counts(cm.url_pop_counts(tagged(spark, sf))))
    return m.select("aem_service", "aem_tier", "firstFetchPerPopMissCount", "repeatSamePopMissCount")


def TOP(src: str, cols: str, count: str, value: str, k: int = 10) -> str:
    return f"SELECT {K}, rank, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY {count} DESC, {value}) AS rank FROM {src}) WHERE rank <= {k}"


@check("top_miss_urls", f"{URL_SQL}, x AS (SELECT {K}, url, miss AS count, pops FROM u WHERE miss > 0) {TOP('x', 'url, count, pops', 'count', 'url')}")
def top_miss_urls(spark, sf):
    return cm.top_miss_urls(cm.url_counts(cm.url_pop_counts(tagged(spark, sf)))).select("aem_service", "aem_tier", "rank", "url", "count", "pops")


@check("top_pass200_urls", f"{URL_SQL}, x AS (SELECT {K}, url, pass200 AS count FROM u WHERE pass200 > 0) {TOP('x', 'url, count', 'count', 'url')}")
def top_pass200_urls(spark, sf):
    return cm.top_pass200_urls(cm.url_counts(cm.url_pop_counts(tagged(spark, sf)))).select("aem_service", "aem_tier", "rank", "url", "count")


POP_SQL = f"""{URL_SQL}, base AS ({BASELINE_SQL}), bt AS (SELECT {K}, sum(count) AS total FROM base GROUP BY 1, 2),
pc AS (SELECT {K}, pop, CAST(sum(n) AS BIGINT) AS requests, CAST(sum(miss) AS BIGINT) AS miss, CAST(sum(missbot) AS BIGINT) AS miss_bot FROM up WHERE pop <> '' GROUP BY 1, 2, 3),
pt AS (SELECT {K}, sum(requests) AS total FROM pc GROUP BY 1, 2),
pops AS (SELECT pc.aem_service, pc.aem_tier, pc.pop, requests, miss, miss_bot,
  CASE WHEN bt.total > 0 THEN coalesce(base.count, 0) / bt.total ELSE requests / pt.total END <= 0.01 AS rare, CASE WHEN bt.total > 0 THEN 1 ELSE 0 END AS "baselineUsed"
  FROM pc JOIN pt ON pt.aem_service = pc.aem_service AND pt.aem_tier = pc.aem_tier LEFT JOIN bt ON bt.aem_service = pc.aem_service AND bt.aem_tier = pc.aem_tier
  LEFT JOIN base ON base.aem_service = pc.aem_service AND base.aem_tier = pc.aem_tier AND base.pop = pc.pop)"""


@check("pops_with_baseline", f"{POP_SQL} SELECT * FROM pops")
def pops_with_baseline(spark, sf):
    return cm.pop_counts(cm.url_pop_counts(tagged(spark, sf)), baseline(spark, sf))


@check(
    "pops_in_window",
    f"{POP_SQL} SELECT pc.aem_service, pc.aem_tier, pop, miss, requests / total <= 0.01 AS rare FROM pc JOIN pt ON pt.aem_service = pc.aem_service AND pt.aem_tier = pc.aem_tier",
)
def pops_in_window(spark, sf):
    return cm.pop_counts(cm.url_pop_counts(tagged(spark, sf)), None).select("aem_service", "aem_tier", "pop", "miss", "rare")


SEC_SQL = f"""{POP_SQL}, sc AS (SELECT {K}, sec, count(*) AS n FROM e GROUP BY 1, 2, 3), pk AS (SELECT {K}, max(n) AS peak FROM sc GROUP BY 1, 2),
cs AS (SELECT {K}, first // 1000000 AS sec, count(*) AS n FROM up WHERE first IS NOT NULL GROUP BY 1, 2, 3), cp AS (SELECT {K}, max(n) AS peak, CAST(sum(n) AS BIGINT) AS n FROM cs GROUP BY 1, 2)"""


@check(
    "seconds",
    f'{SEC_SQL} SELECT pk.aem_service, pk.aem_tier, pk.peak AS "peakRequestsPerSec", cp.peak AS cold_peak, cp.n AS cold FROM pk JOIN cp ON cp.aem_service = pk.aem_service AND cp.aem_tier = pk.aem_tier',
)
def seconds(spark, sf):
    t = tagged(spark, sf)
    cold = cm.cold_seconds(cm.url_pop_counts(t)).withColumnsRenamed({"_coldPeak": "cold_peak", "_cold": "cold"})
    return cm.second_metrics(cm.second_counts(t)).join(cold, cm.KEYS)


DIMS = {
    "passStatus": ("CAST(status AS VARCHAR)", "d = 'PASS'"),
    "vary": ("trim(response_vary)", "d = 'MISS'"),
    "bot": ("trim(bot_name)", "d = 'MISS' AND bot"),
    "contentType": ("lower(trim(split_part(content_type, ';', 1)))", "d = 'MISS'"),
    "originHost": ("origin_host", "true"),
    "ip": ("client_ip", "true"),
    "userAgent": ("request_user_agent", "true"),
    "country": ("geo_country_code", "true"),
    "maxAge": ("CAST(age AS VARCHAR)", "d = 'MISS' AND age IS NOT NULL"),
    "swr": ("CAST(swr AS VARCHAR)", "d = 'MISS' AND age IS NOT NULL AND swr IS NOT NULL"),
}
VAL_SQL = f"{SEC_SQL}, val AS (" + " UNION ALL ".join(
    f"SELECT {K}, '{d}' AS dim, {x} AS value, count(*) AS count FROM e WHERE {c} AND {x} <> '' GROUP BY 1, 2, 4" for d, (x, c) in DIMS.items()
) + f"), tv AS (SELECT *, row_number() OVER (PARTITION BY {K}, dim ORDER BY count DESC, value) AS rank FROM val)"


@check("top_values", f"{VAL_SQL} SELECT {K}, dim, rank, value, count FROM tv WHERE rank <= 10")
def top_values(spark, sf):
    return cm.top_values(cm.value_counts(tagged(spark, sf))).select("aem_service", "aem_tier", "dim", "rank", "value", "count")


@check(
    "value_spread",
    f"""{VAL_SQL} SELECT {K}, count(*) FILTER (dim = 'ip') AS ips, count(*) FILTER (dim = 'userAgent') AS agents, count(*) FILTER (dim = 'country') AS countries,
  max(count) FILTER (dim = 'ip') AS top_ip, coalesce(max(count) FILTER (dim = 'bot'), 0) AS top_bot FROM val GROUP BY 1, 2""",
)
def value_spread(spark, sf):
    m = cm.value_metrics(cm.value_counts(tagged(spark, sf)))
    return m.select(
        "aem_service", "aem_tier", F.col("_distinct_ip").alias("ips"), F.col("_distinct_userAgent").alias("agents"),
        F.col("_distinct_country").alias("countries"), F.col("_top_ip").alias("top_ip"), F.col("_top_bot").alias("top_bot"),
    )


NET_SQL = f"""{VAL_SQL}, net AS (SELECT {K}, client_as_number AS asn, count(*) AS count, count(*) FILTER (d = 'MISS') AS miss, bool_or(cloud) AS cloud,
  arg_min(client_as_name, us * 1000000 + ord) AS name,
  arg_min(split_part(original_x_forwarded_for, ',', 1), us * 1000000 + ord) FILTER (contains(original_x_forwarded_for, ', ') AND split_part(original_x_forwarded_for, ', ', 2) = client_ip) AS ip,
  arg_min(request_via, us * 1000000 + ord) FILTER (contains(original_x_forwarded_for, ', ') AND split_part(original_x_forwarded_for, ', ', 2) = client_ip) AS via
  FROM e GROUP BY 1, 2, 3)""".replace("us * 1000000 + ord", "(us, ord)")


@check("networks", f"{NET_SQL} SELECT * FROM net")
def networks(spark, sf):
    t = tagged(spark, sf)
    rows = cm.networks(cm.network_counts(t), cm.first_values(t))
    return rows.select("aem_service", "aem_tier", "asn", "count", "miss", "cloud", "name", "forwardedSample.*").withColumnRenamed("realClientIp", "ip")


SAMPLE_SQL = f"""smp AS (SELECT {K}, arg_min(fetch_cache_control, (us, ord)) FILTER (fetch_cache_control <> '') AS cc,
  arg_min(fetch_surrogate_control, (us, ord)) FILTER (fetch_surrogate_control <> '') AS sc FROM e WHERE d = 'MISS' AND (age IS NULL OR nostore) GROUP BY 1, 2)"""


@check("cache_directive_samples", f"{NET_SQL}, {SAMPLE_SQL} SELECT * FROM smp")
def cache_directive_samples(spark, sf):
    firsts = cm.first_values(tagged(spark, sf)).where("grp = ''")
    pick = lambda d: F.max(F.when(F.col("dim") == d, F.col("a")))
    return firsts.groupBy(*cm.KEYS).agg(pick("cacheControl").alias("cc"), pick("surrogateControl").alias("sc"))


GAP_SQL = f"""{NET_SQL}, {SAMPLE_SQL}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY {K}, url ORDER BY us, pop, ord) AS ga, us - lag(us) OVER (PARTITION BY {K}, url, pop ORDER BY us, ord) AS gp
  FROM e WHERE d IN ('MISS', 'HIT')),
gm AS (SELECT {K}, quantile_cont(ga, 0.5) / 1e6 AS p50, quantile_cont(ga, 0.9) / 1e6 AS p90, quantile_cont(gp, 0.9) / 1e6 AS pp90, count(ga) AS gaps FROM g GROUP BY 1, 2),
rf AS (SELECT {K}, count(*) FILTER (pttl > 0 AND us - pus <= pttl * 1000000) AS refetch FROM (SELECT *, lag(us) OVER w AS pus, lag(response_ttl) OVER w AS pttl FROM e WHERE d = 'MISS'
  WINDOW w AS (PARTITION BY {K}, url, pop ORDER BY us, ord)) GROUP BY 1, 2)"""


def times(spark, sf, slice_seconds=600):
    return stage(cm.request_times(tagged(spark, sf), slice_seconds=slice_seconds), "times")


GAPS = f"""{GAP_SQL} SELECT gm.aem_service, gm.aem_tier, round(p50, 4) AS p50, round(p90, 4) AS p90, round(pp90, 4) AS pp90, gaps, refetch FROM gm
  JOIN rf ON rf.aem_service = gm.aem_service AND rf.aem_tier = gm.aem_tier"""


def _gaps(m):
    return m.select(
        "aem_service", "aem_tier", F.round("p50AggGapSeconds", 4).alias("p50"), F.round("p90AggGapSeconds", 4).alias("p90"),
        F.round("p90PerPopGapSeconds", 4).alias("pp90"), F.col("_gaps").alias("gaps"), F.col("refetchWithinTtlCount").alias("refetch"),
    )


@check("metrics_gaps", GAPS)
def metrics_gaps(spark, sf):
    return _gaps(cm.gap_metrics(times(spark, sf, 86400)))


@check("metrics_gaps_cut", GAPS)
def metrics_gaps_cut(spark, sf):
    """The same with every slice of more than 50 rows of a URL cut at its quantiles."""
    return _gaps(cm.gap_metrics(times(spark, sf, 86400), most=50))


@check(
    "exact_quantiles",
    "SELECT event_type, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.99), 4) AS p99, count(*) AS n FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS x FROM events) GROUP BY 1",
)
def quantiles(spark, sf):
    e = v.table(spark, sf, "events").select("event_type", F.round(F.col("value") * 100).cast("bigint").alias("x"), F.lit(1).alias("w"))
    out = exact_quantiles(e, ["event_type"], "x", "w", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("event_type", *[F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")], "n")


def _ladder(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {s} THEN {s}" for s in fixed.TTL_STEPS) + f" ELSE {fixed.TTL_STEPS[-1]} END"


ON = lambda t: f"{t}.aem_service = vol.aem_service AND {t}.aem_tier = vol.aem_tier"
BEST = lambda dim: f"coalesce((SELECT value FROM tv WHERE {ON('tv')} AND dim = '{dim}' AND rank = 1), '')"
BEST_N = lambda dim: f"coalesce((SELECT count FROM tv WHERE {ON('tv')} AND dim = '{dim}' AND rank = 1), 0)"
SPREAD = lambda dim: f"(SELECT count(*) FROM val WHERE {ON('val')} AND dim = '{dim}')"
M, N = '"missCount"', '"totalRequests"'
ALL_SQL = f"""{GAP_SQL}, pm AS (SELECT {K}, count(*) FILTER (miss > 0) AS dp, max(miss) AS top, coalesce(sum(miss) FILTER (rare), 0) AS rare, coalesce(sum(miss_bot) FILTER (rare), 0) AS rbot,
  max("baselineUsed") AS bu FROM pops GROUP BY 1, 2), nm AS (SELECT {K}, count(*) FILTER (miss > 0) AS das, max(miss) AS tm, max(count) AS tc,
  arg_min(name, (-count, asn)) AS tname FROM net GROUP BY 1, 2),
mm AS (SELECT vol.*, urls.* EXCLUDE ({K}), round(cp.peak / (cp.n / a.allwin), 6) AS "coldFetchBurstRatio", refetch AS "refetchWithinTtlCount",
  round(p50, 4) AS "p50AggGapSeconds", round(p90, 4) AS "p90AggGapSeconds", round(pp90, 4) AS "p90PerPopGapSeconds",
  coalesce(TRY_CAST({BEST('maxAge')} AS BIGINT), 0) AS "observedMaxAgeSeconds", coalesce(TRY_CAST({BEST('swr')} AS BIGINT), 0) AS "observedSwrSeconds",
  CASE WHEN gaps >= 10 THEN 1 ELSE 0 END AS "ttlDataSufficient",
  CASE WHEN gaps >= 10 THEN greatest({_ladder('p90')}, coalesce(TRY_CAST({BEST('maxAge')} AS BIGINT), 0)) ELSE 0 END AS "recommendedTtlSeconds",
  CASE WHEN gaps >= 10 THEN greatest({_ladder('pp90')}, 604800, coalesce(TRY_CAST({BEST('swr')} AS BIGINT), 0)) ELSE 0 END AS "recommendedSwrSeconds",
  dp AS "distinctPopCount", {R('pm.top', M)} AS "topPopMissShare", {BEST('bot')} AS "topBotName", {R(BEST_N('bot'), M)} AS "topBotMissShare", das AS "distinctClientAsCount",
  {R('tm', M)} AS "topAsnMissShare", {R('tc', N)} AS "topAsnRequestShare", tname AS "topAsnRequestName", pk.peak AS "peakRequestsPerSec",
  round(pk.peak / ({N} / a.allwin), 6) AS "burstRatio", {BEST('originHost')} AS "topOriginHost", {SPREAD('ip')} AS "distinctClientIpCount", {R(BEST_N('ip'), N)} AS "topClientIpRequestShare",
  {BEST('ip')} AS "topClientIpAddress", {SPREAD('userAgent')} AS "distinctUserAgentCount", {R(BEST_N('userAgent'), N)} AS "topUserAgentRequestShare", {BEST('userAgent')} AS "topUserAgentName",
  {SPREAD('country')} AS "distinctCountryCount", {R(BEST_N('country'), N)} AS "topCountryRequestShare", {BEST('country')} AS "topCountryCode",
  {R('pm.rare', M)} AS "rarePopMissShare", {R('pm.rbot', M)} AS "botOnRarePopMissShare", bu AS "baselineUsed", coalesce(smp.cc, '') AS "sampleMissCacheControl",
  coalesce(smp.sc, '') AS "sampleMissSurrogateControl", {BEST('contentType')} AS "dominantMissContentType", {R(BEST_N('contentType'), M)} AS "dominantMissContentTypeShare"
  FROM vol JOIN a ON {ON('a')} JOIN urls ON {ON('urls')} JOIN cp ON {ON('cp')} JOIN pk ON {ON('pk')} JOIN gm ON {ON('gm')} JOIN rf ON {ON('rf')} JOIN pm ON {ON('pm')} JOIN nm ON {ON('nm')}
  LEFT JOIN smp ON {ON('smp')})"""


def metrics(spark, sf):
    return cm.cdn_metrics(events(spark, sf), baseline(spark, sf))


def _gap_digits(df):
    gaps = ["p50AggGapSeconds", "p90AggGapSeconds", "p90PerPopGapSeconds"]
    return rounded(df.withColumns({c: F.round(c, 4) for c in gaps}))


@check("cdn_metrics", f"{ALL_SQL} SELECT {K}, {', '.join(chr(34) + c + chr(34) for c in cm.SCALARS)} FROM mm")
def cdn_metrics(spark, sf):
    return _gap_digits(metrics(spark, sf).select("aem_service", "aem_tier", *cm.SCALARS))


# Lists of the metrics: (name, field of an entry, value in SQL, rows in SQL).
METRIC_LISTS = [
    ("topMissUrls", "url", "url", "d = 'MISS'"), ("topPass200Urls", "url", "url", "d = 'PASS' AND status = 200"), ("popMissBreakdown", "pop", "trim(pop)", "d = 'MISS' AND pop <> ''"),
    ("topBots", "bot", "trim(bot_name)", "d = 'MISS' AND bot"), ("topClientIps", "ip", "trim(client_ip)", "trim(client_ip) <> ''"),
    ("topUserAgents", "userAgent", "trim(request_user_agent)", "trim(request_user_agent) <> ''"), ("topCountries", "country", "trim(geo_country_code)", "trim(geo_country_code) <> ''"),
    ("passStatusTop", "status", "CAST(status AS VARCHAR)", "d = 'PASS'"), ("topMissVaryValues", "value", "trim(response_vary)", "d = 'MISS' AND trim(response_vary) <> ''"),
    ("topSourceAsns", "asn", "trim(client_as_number)", "trim(client_as_number) <> ''"), ("topAsns", "asn", "trim(client_as_number)", "d = 'MISS' AND trim(client_as_number) <> ''"),
]
LISTS_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {K}, '{name}' AS list, row_number() OVER (PARTITION BY {K} ORDER BY count(*) DESC, {value}) - 1 AS place, {value} AS value, count(*) AS n FROM e WHERE {rows} GROUP BY {K}, {value}) WHERE place < 10"
    for name, _, value, rows in METRIC_LISTS
)


@check("cdn_metric_lists", f"{E} {LISTS_SQL}")
def cdn_metric_lists(spark, sf):
    """The assembled lists of the metric row, place by place."""
    table = stage(metrics(spark, sf), "metrics")
    parts = [
        table.select("aem_service", "aem_tier", F.lit(name).alias("list"), F.posexplode(name).alias("place", "x")).select(
            "aem_service", "aem_tier", "list", F.col("place").cast("bigint").alias("place"), F.col(f"x.{field}").cast("string").alias("value"), F.col("x.count").alias("n")
        )
        for name, field, _, _ in METRIC_LISTS
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


# The further fields of list entries: (list, value, text of the fields, rows with their count n) in SQL.
LIST_FIELDS = [
    ("topMissUrls", "url", "CAST(pops AS VARCHAR)", "(SELECT aem_service, aem_tier, url, count(*) AS n, count(DISTINCT pop) AS pops FROM e WHERE d = 'MISS' GROUP BY 1, 2, 3)"),
    ("popMissBreakdown", "pop", "concat(CAST(n / total AS DECIMAL(18, 6)), ' ', CASE WHEN rare THEN 'rare' ELSE 'usual' END)",
     "(SELECT pops.aem_service, pops.aem_tier, pop, miss AS n, rare, \"missCount\" AS total FROM pops JOIN mm ON mm.aem_service = pops.aem_service AND mm.aem_tier = pops.aem_tier WHERE miss > 0)"),
    ("topSourceAsns", "asn", "concat(name, ' ', CASE WHEN cloud THEN 'cloud' ELSE 'other' END)", "(SELECT aem_service, aem_tier, asn, name, cloud, count AS n FROM net WHERE trim(asn) <> '')"),
    ("topAsns", "asn", "name", "(SELECT aem_service, aem_tier, asn, name, miss AS n FROM net WHERE trim(asn) <> '' AND miss > 0)"),
]
FIELDS_SQL = " UNION ALL ".join(
    f"SELECT * FROM (SELECT {K}, '{name}' AS list, row_number() OVER (PARTITION BY {K} ORDER BY n DESC, {value}) - 1 AS place, {value} AS value, {fields} AS fields FROM {rows}) WHERE place < 10"
    for name, value, fields, rows in LIST_FIELDS
)


@check("cdn_list_fields", f"{ALL_SQL} {FIELDS_SQL}")
def cdn_list_fields(spark, sf):
    """What list entries hold beside value and count: POPs of a URL, share and rarity of a POP, name and kind of a network."""
    table = stage(metrics(spark, sf), "metrics")
    fields = {
        "topMissUrls": ("url", F.col("x.pops").cast("string")),
        "popMissBreakdown": ("pop", F.concat_ws(" ", F.round("x.share", 6).cast("decimal(18,6)").cast("string"), F.when(F.col("x.rare"), "rare").otherwise("usual"))),
        "topSourceAsns": ("asn", F.concat_ws(" ", "x.name", F.when(F.col("x.cloud"), "cloud").otherwise("other"))),
        "topAsns": ("asn", F.col("x.name")),
    }
    listed = lambda name: table.select("aem_service", "aem_tier", F.lit(name).alias("list"), F.posexplode(name).alias("place", "x"))
    parts = [
        listed(name).select("aem_service", "aem_tier", "list", F.col("place").cast("bigint").alias("place"), F.col(f"x.{value}").alias("value"), text.alias("fields"))
        for name, (value, text) in fields.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@check(
    "cdn_metrics_by_day",
    f"""{E} SELECT {K}, CAST(day(time_start) AS INT) AS day, count(*) AS "totalRequests", count(*) FILTER (d = 'MISS') AS "missCount",
  count(DISTINCT url) FILTER (d = 'MISS') AS "distinctMissUrlCount" FROM e GROUP BY 1, 2, 3""",
)
def cdn_metrics_by_day(spark, sf):
    """The same reductions under another key: service, tier and day."""
    keys = ["aem_service", "aem_tier", "day"]
    t = cm.tag_events(events(spark, sf).withColumn("day", F.dayofmonth("time_start")))
    vol = cm.volume(cm.volume_counts(t, keys), keys).select(*keys, "totalRequests", "missCount")
    urls = cm.url_metrics(cm.url_counts(cm.url_pop_counts(t, keys), keys), keys).select(*keys, "distinctMissUrlCount")
    return cm.combine([vol, urls], keys)


@check("cdn_stream_metrics", f"{ALL_SQL} SELECT {K}, {', '.join(chr(34) + c + chr(34) for c in cm.SCALARS)} FROM mm")
def cdn_stream_metrics(spark, sf):
    """The events as arriving micro-batches, reduced, merged and finished."""
    e = events(spark, sf)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = f"{folder}/in"
    e.withColumn("time_start", F.col("time_start").cast("timestamp")).repartitionByRange(3, "ord").sortWithinPartitions(
        "ord"
    ).write.mode("overwrite").parquet(source)
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(source)
    st.write_partials(stream, f"{folder}/parts", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return _gap_digits(st.stream_metrics(spark, f"{folder}/parts", baseline(spark, sf)).select("aem_service", "aem_tier", *cm.SCALARS))


@check("cdn_stream_compacted", f"{ALL_SQL} SELECT {K}, {', '.join(chr(34) + c + chr(34) for c in cm.SCALARS)} FROM mm")
def cdn_stream_compacted(spark, sf):
    """The same from a stream of five batches on three days, of which two are compacted, one after the other."""
    e = events(spark, sf)
    folder = Staging(spark, "stream-compacted").root
    e.withColumn("time_start", F.col("time_start").cast("timestamp")).repartitionByRange(5, "ord").sortWithinPartitions("ord").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    days = ("2024-01-01", "2024-01-01", "2024-01-02", "2024-01-02", "2024-01-03")
    day = lambda batch: days[min(batch, 4)]
    st.write_partials(stream, f"{folder}/parts", f"{folder}/cp", day=day).trigger(availableNow=True).start().awaitTermination()
    st.compact(spark, f"{folder}/parts", "2024-01-02")
    st.compact(spark, f"{folder}/parts", "2024-01-03")
    return _gap_digits(st.stream_metrics(spark, f"{folder}/parts", baseline(spark, sf)).select("aem_service", "aem_tier", *cm.SCALARS))


# Findings and reports ---------------------------------------------------------------------------------


# The hypotheses in order, with the tests that score them; thresholds stand here, apart from the code under test.
HYPOTHESIS_TESTS = {
    "cdn-uncacheable": ["missNoPositiveTtlShare >= 0.7", "missNoStoreShare >= 0.5"],
    "cdn-unique-url-burst": ["uniqueMissUrlRatio >= 0.8", "singleRequestMissUrlShare >= 0.7", "distinctMissUrlCount >= 50"],
    "cdn-stale-content": [
        "repeatSamePopMissCount >= 10", "repeatSamePopShare >= 0.3", "shortTtlMissShare >= 0.5 OR staleEligibleMissShare >= 0.5 OR refetchWithinTtlCount >= 5",
    ],
    "cdn-pop-fragmentation": [
        "repeatedUrlMultiPopShare >= 0.5", "avgPopsPerRepeatedMissUrl >= 2", "distinctPopCount >= 3", "repeatedMissUrlCount >= 5", "shieldingUsedMissShare < 0.5",
    ],
    "cdn-bot-cold-pop": ["botMissShare >= 0.5", "rarePopMissShare >= 0.4", "botOnRarePopMissShare >= 0.3", "topAsnMissShare >= 0.3"],
}


def _hyp_sql() -> str:
    parts = []
    for i, (name, conditions) in enumerate(HYPOTHESIS_TESTS.items()):
        score = " + ".join(f"CASE WHEN {_quoted(c)} THEN 1 ELSE 0 END" for c in conditions)
        parts.append(f"SELECT {K}, {i} AS o, '{name}' AS id, CAST(({score}) AS DOUBLE) / {len(conditions)} AS score FROM mm WHERE {M} > 0")
    return " UNION ALL ".join(parts)


def _quoted(cond: str) -> str:
    import re

    return re.sub(r"\b([a-z][A-Za-z0-9]*[A-Z][A-Za-z0-9]*)\b", r'"\1"', cond)


FIND_SQL = f"""{ALL_SQL}, hyp AS ({_hyp_sql()}), hr AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY score DESC, o) AS rank FROM hyp WHERE score > 0)"""


@check(
    "cdn_hypotheses",
    f"""{FIND_SQL} SELECT {K}, rank, id AS "signatureId", round(score, 6) AS "confidenceScore",
  CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM hr""",
)
def cdn_hypotheses(spark, sf):
    rows = cf.finding_rows(cf.classify(stage(metrics(spark, sf), "metrics")), cm.KEYS).where("rankGroup = 0")
    return rows.select("aem_service", "aem_tier", "rank", "signatureId", F.round("confidenceScore", 6).alias("confidenceScore"), "confidence")


@check(
    "cdn_context_findings",
    f"""{FIND_SQL}, b AS (SELECT *, "cloudAsnRequestShare" >= 0.4 AND ("burstRatio" >= 5 OR "topAsnRequestShare" >= 0.3) AS s1, "cdnThreatShare" >= 0.1 AS s2,
  "topClientIpRequestShare" >= 0.2 AND "burstRatio" >= 5 AS s3, "topUserAgentRequestShare" >= 0.6 AND "burstRatio" >= 5 AS s4, "topCountryRequestShare" >= 0.6 AND "burstRatio" >= 5 AS s5,
  "observedMaxAgeSeconds" = 0 OR "recommendedTtlSeconds" > "observedMaxAgeSeconds" AS up FROM mm)
SELECT {K}, 'cdn-ddos-pattern' AS "signatureId", CASE WHEN s2 OR "cloudAsnRequestShare" >= 0.8 OR ("cloudAsnRequestShare" >= 0.5 AND "burstRatio" >= 8)
  OR s1::INT + s2::INT + s3::INT + s4::INT + s5::INT >= 2 THEN 'high' ELSE 'medium' END AS confidence FROM b WHERE s1 OR s2 OR s3 OR s4 OR s5
UNION ALL SELECT {K}, 'cdn-ttl-recommendation', CASE WHEN up AND "observedMaxAgeSeconds" > 0 THEN 'high' WHEN up THEN 'medium' ELSE 'low' END FROM b
  WHERE "ttlDataSufficient" = 1 AND "recommendedTtlSeconds" > 0
UNION ALL SELECT {K}, 'cdn-rate-limit-429', CASE WHEN "missShareOf429" >= 0.5 THEN 'high' WHEN "missShareOf429" > 0 THEN 'medium' ELSE 'low' END FROM b WHERE "error429Count" > 0
UNION ALL SELECT {K}, 'cdn-pass-200-bypass', CASE WHEN "passWith200Share" >= 0.7 THEN 'high' ELSE 'medium' END FROM b WHERE "passWith200Count" >= 20 AND "passWith200Share" >= 0.5
UNION ALL SELECT {K}, 'cdn-pass-non200', CASE WHEN "passNon200Non429Share" >= 0.7 THEN 'high' ELSE 'medium' END FROM b WHERE "passNon200Non429Count" >= 20 AND "passNon200Non429Share" >= 0.5""",
)
def cdn_context_findings(spark, sf):
    rows = cf.finding_rows(cf.classify(stage(metrics(spark, sf), "metrics")), cm.KEYS).where("rankGroup = 1")
    return rows.select("aem_service", "aem_tier", "signatureId", "confidence")


def cnames(spark, sf):
    """CNAME records next to the hosts of the log: two real chains and one step per address of the pages table."""
    fixed_part = [
        ("www.a.example", "x.corp.example", 0), ("x.corp.example", "www.a.example.edgekey.net", 0),
        ("www.b.example", "lb.corp.example", 0),
    ]
    return spark.createDataFrame(fixed_part, "host string, target string, ord bigint")


HOSTS_SQL = """hosts AS (SELECT DISTINCT page_id, concat('h', page_id, '.site', page_id % 7, '.example') AS host FROM pages),
cn AS (SELECT host, CASE WHEN page_id % 7 = 0 THEN concat('h', page_id, '.edgekey.net.') WHEN page_id % 7 = 1 THEN concat('n', page_id, '.corp.example')
  WHEN page_id % 7 = 2 THEN 'loop.example' ELSE concat('d', page_id, '.cloudfront.net') END AS target, page_id % 2 AS ord FROM hosts WHERE page_id % 7 < 4
  UNION ALL SELECT concat('n', page_id, '.corp.example'), CASE WHEN page_id % 2 = 0 THEN 'X.FASTLY.net' ELSE 'end.corp.example' END, 0 FROM hosts WHERE page_id % 7 = 1
  UNION ALL SELECT 'loop.example', 'loop.example', 0)"""
PROVIDER = "CASE " + " ".join(
    f"WHEN h = '{s}' OR ends_with(h, '.{s}') THEN '{p}'" for s, p in fixed.CDN_SUFFIXES
) + " END"


UPSTREAM_SQL = f"""WITH RECURSIVE {HOSTS_SQL}, walk AS (SELECT host AS hostname, host AS cur, CAST('' AS VARCHAR) AS chain, 0 AS hop, CAST(NULL AS VARCHAR) AS provider FROM hosts
  UNION ALL SELECT hostname, target, concat(chain, CASE WHEN chain = '' THEN '' ELSE ' ' END, target), hop + 1,
    (SELECT {PROVIDER} FROM (SELECT rtrim(lower(target), '.') AS h)) FROM walk JOIN cn ON cn.host = walk.cur WHERE provider IS NULL AND hop < 9)
SELECT hostname, chain, provider FROM walk WHERE provider IS NOT NULL"""


def page_hosts(spark, sf):
    """Hosts of the pages table and their records."""
    pages = v.table(spark, sf, "pages")
    p = F.col("page_id")
    s = lambda *x: F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in x])
    t = p.cast("string")
    host = s("h", t, ".site", (p % 7).cast("string"), ".example")
    hosts = pages.select("page_id", host.alias("host")).distinct()
    target = F.when(p % 7 == 0, s("h", t, ".edgekey.net.")).when(p % 7 == 1, s("n", t, ".corp.example")).when(p % 7 == 2, F.lit("loop.example")).otherwise(s("d", t, ".cloudfront.net"))
    direct = hosts.where(p % 7 < 4).select("host", target.alias("target"), (p % 2).alias("ord"))
    second = hosts.where(p % 7 == 1).select(
        s("n", t, ".corp.example").alias("host"), F.when(p % 2 == 0, "X.FASTLY.net").otherwise("end.corp.example").alias("target"), F.lit(0).cast("bigint").alias("ord")
    )
    loop = hosts.limit(1).select(F.lit("loop.example").alias("host"), F.lit("loop.example").alias("target"), F.lit(0).cast("bigint").alias("ord"))
    return hosts.select("host"), direct.unionByName(second).unionByName(loop)


@check("upstream_chain", UPSTREAM_SQL)
def upstream_chain(spark, sf):
    return up.resolve_upstream(*page_hosts(spark, sf)).select("hostname", F.array_join("chain", " ").alias("chain"), "provider")


@check("upstream_chain_all", UPSTREAM_SQL)
def upstream_chain_all(spark, sf):
    return up.resolve_upstream_all(*page_hosts(spark, sf)).select("hostname", F.array_join("chain", " ").alias("chain"), "provider")


@check(
    "suffix_provider",
    f"""{HOSTS_SQL.replace('hosts AS', 'WITH hosts AS', 1)} SELECT target AS host, (SELECT {PROVIDER} FROM (SELECT rtrim(lower(target), '.') AS h)) AS provider FROM cn
  WHERE (SELECT {PROVIDER} FROM (SELECT rtrim(lower(target), '.') AS h)) IS NOT NULL""",
)
def suffix_provider(spark, sf):
    p = F.col("page_id")
    t = p.cast("string")
    rows = v.table(spark, sf, "pages").select("page_id").distinct()
    a = rows.where(p % 7 == 0).select(F.concat(F.lit("h"), t, F.lit(".edgekey.net.")).alias("host"), "page_id")
    b = rows.where(p % 7 == 3).select(F.concat(F.lit("d"), t, F.lit(".cloudfront.net")).alias("host"), "page_id")
    c = rows.where((p % 7 == 1) & (p % 2 == 0)).select(F.lit("X.FASTLY.net").alias("host"), "page_id")
    hosts = a.unionByName(b).unionByName(c)
    suffixes = spark.createDataFrame([(s, pr, i) for i, (s, pr) in enumerate(fixed.CDN_SUFFIXES)], "suffix string, provider string, ord int")
    found = up.match_suffixes(hosts.select("host").distinct(), suffixes)
    return hosts.join(found, "host").select("host", "provider")


INCIDENT = ("2024-01-19T00:00:00Z", "2024-01-21T00:00:00Z")


@check(
    "cdn_incident",
    f"""{E}, w AS (SELECT * FROM e WHERE aem_tier = 'publish' AND time_start >= TIMESTAMP '2024-01-19 00:00:00' AND time_start < TIMESTAMP '2024-01-21 00:00:00'),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY time_start, ord) AS rn FROM w) WHERE rn <= {CAP}),
b AS (SELECT {K}, count(*) AS n FROM e WHERE trim(pop) <> '' AND time_start >= TIMESTAMP '2024-01-17 00:00:00' AND time_start < TIMESTAMP '2024-01-19 00:00:00' GROUP BY 1, 2),
g AS (SELECT {K}, count(*) AS n, count(*) FILTER (d = 'MISS') AS miss, count(*) FILTER (d = 'HIT') AS hit, count(*) FILTER (d = 'PASS') AS pass,
  count(DISTINCT url) FILTER (d = 'MISS') AS urls, count(*) FILTER (r429) AS r429 FROM c GROUP BY 1, 2), a AS (SELECT {K}, count(*) AS n FROM w GROUP BY 1, 2)
SELECT {K}, g.n AS "entryCount", miss AS "missCount", hit AS "hitCount", pass AS "passCount", urls AS "distinctMissUrlCount", r429 AS "error429Count",
  concat_ws(' / ', CASE WHEN a.n >= {CAP} THEN 'Result hit the {CAP}-event cap — analysis may be truncated. Narrow the window/URLs or raise the cap.' END,
    CASE WHEN b.n IS NULL THEN 'POP baseline query returned no data — using in-window rarity heuristic.' END,
    CASE WHEN miss = 0 THEN 'No cache MISS events in the analysed window — nothing to attribute.' END) AS warnings
FROM g JOIN a USING ({K}) LEFT JOIN b USING ({K})""",
)
def cdn_incident(spark, sf):
    """From the scan to the report in one plan: window, cap, baseline, metrics, warnings."""
    rep = cr.analyse_incident(_stamped(spark, sf), *INCIDENT, max_events=CAP)
    return rep.select(
        "aem_service", "aem_tier", "entryCount", "missCount", "hitCount", "passCount", "distinctMissUrlCount", "error429Count", F.array_join("warnings", " / ").alias("warnings")
    )


# Texts of the report, filled in SQL: shares as percent (two decimals next to 0 and 100), whole numbers, one decimal.
PCT = lambda x: (
    f"""CASE WHEN (floor("{x}" * 100 + 0.5) = 100 AND "{x}" * 100 < 100) OR (floor("{x}" * 100 + 0.5) = 0 AND "{x}" > 0) THEN printf('%.2f%%', "{x}" * 100)
  ELSE concat(CAST(floor("{x}" * 100 + 0.5) AS BIGINT), '%') END"""
)
INT = lambda x: f"CAST(floor({x} + 0.5) AS BIGINT)"
ONE = lambda x: f"printf('%.1f', \"{x}\")"
ASK = lambda x: f"coalesce(nullif(\"{x}\", ''), '?')"
VERDICTS = {
    "cdn-uncacheable": "Responses are not cacheable (no cache lifetime)", "cdn-unique-url-burst": "Burst of unique / uncacheable URLs",
    "cdn-stale-content": "Content not staying cached (same-POP re-fetches)", "cdn-pop-fragmentation": "Cache fragmentation across POPs",
    "cdn-bot-cold-pop": "Bot burst on rarely-used POPs",
}
REPORT_SQL = f"""{FIND_SQL}, verdict AS (SELECT hr.* EXCLUDE (rank), CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.5 THEN 'medium' ELSE 'low' END AS conf,
  CASE id {' '.join(f"WHEN '{i}' THEN '{n}'" for i, n in VERDICTS.items())} END AS name FROM hr WHERE rank = 1),
rep AS (SELECT mm.*, id, conf, name,
  concat_ws(' ', concat("missCount", ' cache MISSes of ', "totalRequests", ' events (MISS ratio ', {INT('"missRatio" * 100')}, '% of MISS+HIT).'),
    CASE WHEN id IS NOT NULL THEN concat('Most likely cause: ', name, ' (', conf, ' confidence).')
      ELSE 'No single hypothesis met its threshold — see the per-hypothesis conditions for partial matches.' END,
    CASE WHEN "error429Count" > 0 THEN concat("error429Count", ' HTTP 429s, ', {INT('"missShareOf429" * 100')}, '% of them on MISSes.') END) AS summary
  FROM mm LEFT JOIN verdict ON verdict.aem_service = mm.aem_service AND verdict.aem_tier = mm.aem_tier)"""


@check(
    "cdn_report",
    f"""{REPORT_SQL} SELECT {K}, "totalRequests" AS "entryCount", id AS "verdictId", name AS "verdictName", conf AS "verdictConfidence", summary,
  CASE WHEN "topOriginHost" = 'www.a.example' THEN 'www.a.example: x.corp.example > www.a.example.edgekey.net: akamai' END AS upstream FROM rep""",
)
def cdn_report(spark, sf):
    rep = cr.analyse_events(events(spark, sf), baseline(spark, sf), cnames(spark, sf))
    path = F.when(F.col("upstream").isNotNull(), F.concat_ws(": ", "upstream.hostname", F.array_join("upstream.chain", " > "), "upstream.provider"))
    return rep.select("aem_service", "aem_tier", "entryCount", "verdictId", "verdictName", "verdictConfidence", "summary", path.alias("upstream"))


TTL_LINE = f"""CASE WHEN "ttlDataSufficient" = 1 THEN concat('- TTL: current ', CASE WHEN "observedMaxAgeSeconds" > 0 THEN CAST("observedMaxAgeSeconds" AS VARCHAR) ELSE '?' END, 's, recommended ~',
  "recommendedTtlSeconds", 's (req rate ', {ONE('cacheableRequestRatePerMin')}, '/min; P90 gap shield ', {INT('"p90AggGapSeconds"')}, 's / edge ', {INT('"p90PerPopGapSeconds"')}, 's)')
  ELSE '- TTL: insufficient repeat-request data in this window to size a TTL' END"""
REPORT_LINES = [
    "concat('# CDN Cache Miss Analysis — ', aem_service)", "''", "concat('**Tier:** ', aem_tier)", "''", "'## Summary'", "summary", "''", "'## Key metrics'",
    "concat('- Events analysed: ', \"totalRequests\")",
    "concat('- Cache MISS: ', \"missCount\", '  |  HIT: ', \"hitCount\", '  |  PASS: ', \"passCount\", ' (PASS+200: ', \"passWith200Count\", ')')",
    f"concat('- PASS breakdown: ', {PCT('passWith200Share')}, ' are 200 (bypassing cache), ', {PCT('passNon200Non429Share')}, ' non-200 excl. 429 (429s: ', \"pass429Count\", ')')",
    f"concat('- MISS ratio (MISS/MISS+HIT): ', {PCT('missRatio')})",
    f"concat('- HTTP 429: ', \"error429Count\", ' (', {PCT('missShareOf429')}, ' on MISS); origin 5xx: ', \"originError5xxCount\")",
    f"concat('- Distinct MISS URLs: ', \"distinctMissUrlCount\", ' (unique ratio ', {PCT('uniqueMissUrlRatio')}, ')')",
    f"concat('- Why MISS: ', {PCT('coldPopFirstFetchShare')}, ' first-fetch-at-POP (cold), ', {PCT('repeatSamePopShare')}, ' repeat-at-same-POP (should HIT), ', {PCT('notCacheable')}, ' not-cacheable-by-directive')",
    f"concat('- POPs serving MISS: ', \"distinctPopCount\", '; origin shielding on: ', {PCT('shieldingUsedMissShare')}, ' of MISSes')",
    TTL_LINE,
    f"concat('- Bot MISS share: ', {PCT('botMissShare')}, '; rare-POP MISS share: ', {PCT('rarePopMissShare')})",
    f"concat('- Traffic sources: ', {PCT('cloudAsnRequestShare')}, ' from cloud/hosting ASNs; top ', {ASK('topAsnRequestName')}, ' (', {PCT('topAsnRequestShare')}, '); peak ', "
    f"\"peakRequestsPerSec\", '/s (burst ', {ONE('burstRatio')}, '×); CDN-flagged ', {PCT('cdnThreatShare')})",
    f"concat('- Client concentration: ', \"distinctClientIpCount\", ' distinct IPs (top ', {PCT('topClientIpRequestShare')}, ': ', {ASK('topClientIpAddress')}, '); ', \"distinctUserAgentCount\", "
    f"' distinct user agents (top ', {PCT('topUserAgentRequestShare')}, ': \"', {ASK('topUserAgentName')}, '\"); ', \"distinctCountryCount\", ' distinct countries (top ', "
    f"{PCT('topCountryRequestShare')}, ': ', {ASK('topCountryCode')}, ')')",
    "''", "'## Findings'",
]


@check(
    "cdn_report_text",
    f"""{REPORT_SQL}, shown AS (SELECT *, greatest("missNoPositiveTtlShare", "missNoStoreShare") AS "notCacheable" FROM rep),
lines AS (SELECT {K}, unnest(range({len(REPORT_LINES)})) AS line_no, unnest([{', '.join(REPORT_LINES)}]) AS line FROM shown)
SELECT {K}, CAST(line_no AS INTEGER) AS line_no, line FROM lines""",
)
def cdn_report_text(spark, sf):
    """Everything above the findings."""
    rep = cr.analyse_events(events(spark, sf), baseline(spark, sf))
    return cr.report_lines(rep).where(F.col("line_no") < len(REPORT_LINES))
