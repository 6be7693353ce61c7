"""Cache-miss metrics of every service and tier.

The events are reduced along a few groupings, each pre-aggregated before its shuffle:

* plain counters per service                       ``volume_counts`` -> ``volume``
* counts per URL and POP                           ``url_pop_counts`` -> ``url_metrics``, ``pop_metrics``
* counts per second                                ``second_counts`` -> ``second_metrics``
* counts per value of a source or header field     ``value_counts`` -> ``value_metrics``
* counts per network                               ``network_counts`` -> ``network_metrics``
* distinct request times per URL and POP           ``request_times`` -> ``gap_metrics``

No grouping gathers the rows of one service or one URL in a task: windows run over counts, or over
one part of a time slice of one URL, cut so that no part holds more than a given number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.text import any_of, strip
from stallscope.operators.quantile import exact_quantiles
from stallscope.session import Staging, stage, stage_all

KEYS = ["aem_service", "aem_tier"]
NO_TIME = 2**62


@dataclass(frozen=True)
class MetricParams:
    """Thresholds of the metric job."""

    short_ttl_seconds: int = fixed.SHORT_TTL_SECONDS
    min_ttl_gaps: int = fixed.MIN_TTL_GAPS
    ttl_steps: list[int] = field(default_factory=lambda: list(fixed.TTL_STEPS))
    swr_floor_seconds: int = fixed.SWR_FLOOR_SECONDS
    rare_pop_share: float = fixed.RARE_POP_SHARE
    cloud_words: list[str] = field(default_factory=lambda: list(fixed.CLOUD_WORDS))
    top_k: int = fixed.TOP_K
    time_slice_seconds: int = 600
    slice_rows: int = 1_000_000  # of one URL in one slice; a slice with more is cut into parts of equal depth


def _disposition(seen: Column) -> Column:
    return (
        F.when(seen.startswith("HITPASS") | seen.startswith("PASS"), "PASS")
        .when(seen.startswith("MISS"), "MISS")
        .when(seen.startswith("HIT"), "HIT")
        .otherwise("OTHER")
    )


def disposition(cache_status: Column, state: Column, x_cache: Column) -> Column:
    """HIT, MISS, PASS or OTHER from the first non-blank state."""
    text = lambda c: F.nullif(F.upper(strip(c)), F.lit(""))
    return _disposition(F.coalesce(text(cache_status), text(state), text(x_cache), F.lit("")))


def flagged(c: Column) -> Column:
    return ~F.lower(strip(F.coalesce(c, F.lit("")))).isin(fixed.BLANK_FLAGS)


#: Lifetimes that a header may name: the word looked for first, and the pattern that reads it.
LIFETIMES = {
    "s-maxage": r"(?i)(?:^|[^a-z-])s-maxage\s*=\s*0*([1-9][0-9]*)",
    "max-age": r"(?i)(?:^|[^a-z-])max-age\s*=\s*0*([1-9][0-9]*)",
    "stale-while-revalidate": r"(?i)stale-while-revalidate\s*=\s*0*([1-9][0-9]*)",
}


def lifetime(header: str, lowered: str, name: str) -> Column:
    """A positive number, or 0 or null where the header has none; only a header that holds the word is matched.

    The zero in front spares the cast of blank text: a failing cast costs an exception per row.
    """
    digits = F.regexp_extract(header, LIFETIMES[name], 1)
    return F.when(F.col(lowered).contains(name), F.concat(F.lit("0"), digits).try_cast("bigint"))


def _first_positive(names: list[str]) -> Column:
    return F.coalesce(*[F.when(F.col(n) > 0, F.col(n)) for n in names])


def tag_events(events: DataFrame, params: MetricParams = MetricParams()) -> DataFrame:
    """The columns the metrics need, with derived marks; nothing is evaluated until a grouping asks for it.

    The marks come in steps, so that a text that several of them read is made once. The list of hops, made by a higher-order
    function, keeps the first step out of the generated loop of the query before it: fused, both are one method that is too
    long for the JIT compiler and is interpreted for every event.
    """
    header = lambda c: F.coalesce(c, F.lit(""))
    state = lambda c: F.upper(strip(F.col(c)))
    no_store = r"(?i)(no-store|no-cache|private|max-age\s*=\s*0+(?:$|[^0-9]))"
    held = {"_state0": state("cache_status"), "_state1": state("fastly_info_state"), "_state2": state("response_x_cache")}
    hops = F.transform(F.split(header("original_x_forwarded_for"), r",\s*", -1), strip)
    first = {
        **held, "_hops": hops, "us": F.unix_micros(F.col("time_start").cast("timestamp")),
        "cc": header("fetch_cache_control"), "sc": header("fetch_surrogate_control"),
    }
    lowered = {"_lower_sc": F.lower("sc"), "_lower_cc": F.lower("cc")}
    numbers = {f"_{name}_{h}": lifetime(h, f"_lower_{h}", name) for h in ("sc", "cc") for name in LIFETIMES}
    seen = reduce(lambda rest, c: F.when(F.col(c) != "", F.col(c)).otherwise(rest), reversed(held), F.lit(""))
    d, cc, sc, listed = F.col("d"), F.col("cc"), F.col("sc"), F.col("_hops")
    marks = {
        "is_miss": d == "MISS",
        "is_hit": d == "HIT",
        "is_pass": d == "PASS",
        "is_cacheable_state": d.isin("MISS", "HIT"),
        "second": F.floor(F.col("us") / 1000000).cast("bigint"),
        "max_age": _first_positive([f"_{name}_{h}" for h in ("sc", "cc") for name in ("s-maxage", "max-age")]),
        "swr": _first_positive([f"_stale-while-revalidate_{h}" for h in ("sc", "cc")]),
        "no_store": cc.rlike(no_store) | sc.rlike(no_store),
        "stale_ok": sc.rlike("(?i)stale-(while-revalidate|if-error)"),
        "is_bot": flagged(F.col("bot_name")),
        "is_cloud": F.coalesce("client_as_name", F.lit("")).rlike(r"(?i)\b" + any_of(params.cloud_words) + r"\b"),
        "is_429": (F.col("status") == 429) | (F.col("origin_status") == 429),
        "fetch": F.lower(F.coalesce("fetch_action", F.lit(""))),
        "vary": strip(F.coalesce("response_vary", F.lit(""))),
        "forwarded": (F.size(listed) > 1) & (F.element_at(listed, -1) == F.col("client_ip")),
        "real_ip": F.get(listed, F.lit(0)),
    }
    steps = events.withColumns(first).withColumns({**lowered, "_seen": seen}).withColumns({"d": _disposition(F.col("_seen")), **numbers})
    return steps.withColumns(marks).drop("_seen", *held, "_hops", *lowered, *numbers)


#: What the groupings read of an event, marks included.
SLIM = [
    "ord", "time_start", "us", "second", "url", "pop", "d", "is_miss", "is_hit", "is_pass", "is_cacheable_state", "is_cacheable", "is_bot", "is_cloud", "is_429",
    "status", "origin_status", "response_ttl", "shielding_used", "max_age", "swr", "no_store", "stale_ok", "fetch", "cc", "sc", "vary", "bot_name",
    "content_type", "origin_host", "client_ip", "request_user_agent", "geo_country_code", "client_as_number", "client_as_name", "forwarded", "real_ip",
    "request_via", "ddos_action", "ddos_rule", "malicious_flags", "deny_reason",
]


def slim_events(events: DataFrame, keys: list[str] = KEYS, params: MetricParams = MetricParams()) -> DataFrame:
    """Tagged events without the columns no grouping reads. Written as a table, they spare every grouping the raw events."""
    return tag_events(events, params).select(*keys, *[c for c in SLIM if c not in keys])


def _ratio(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def volume_counts(tagged: DataFrame, keys: list[str] = KEYS, params: MetricParams = MetricParams()) -> DataFrame:
    """Counters that need one pass and no second grouping."""
    miss, passed = F.col("is_miss"), F.col("is_pass")
    ok = F.col("status") == 200
    n = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    high_vary = F.col("vary").rlike("(?i)" + any_of(fixed.HIGH_CARDINALITY_VARY))
    ttl = F.col("response_ttl")
    timed_cacheable = F.col("is_cacheable_state") & F.col("us").isNotNull()
    return tagged.groupBy(*keys).agg(
        F.count("*").alias("totalRequests"),
        n(miss).alias("missCount"),
        n(F.col("is_hit")).alias("hitCount"),
        n(passed).alias("passCount"),
        n(F.col("d") == "OTHER").alias("otherCount"),
        n(passed & ok).alias("passWith200Count"),
        n(passed & ~ok).alias("passNon200Count"),
        n(passed & (F.col("status") == 429)).alias("pass429Count"),
        n(passed & ~F.col("status").isin(200, 429)).alias("passNon200Non429Count"),
        n(passed & ok & F.col("fetch").startswith("pass_noheaders")).alias("_noheaders"),
        n(passed & ok & F.col("fetch").rlike("^pass_(s_)?private")).alias("_private"),
        n(F.col("is_429")).alias("error429Count"),
        n(miss & F.col("is_429")).alias("missWith429Count"),
        n(F.col("origin_status").between(500, 599)).alias("originError5xxCount"),
        n(flagged(F.col("ddos_action")) | flagged(F.col("deny_reason"))).alias("cdnDeniedCount"),
        n(miss & (ttl > 0) & (ttl < params.short_ttl_seconds)).alias("shortTtlMissCount"),
        n(miss & F.col("stale_ok")).alias("_stale"),
        F.coalesce(F.sum(F.when(miss & (ttl > 0), ttl)), F.lit(0.0)).alias("_ttlSum"),
        n(miss & (ttl > 0)).alias("_ttlCount"),
        n(miss & (F.col("vary") != "")).alias("_vary"),
        n(miss & high_vary).alias("_highVary"),
        n(miss & F.col("shielding_used")).alias("_shield"),
        n(miss & F.col("is_bot")).alias("botMissCount"),
        n(F.col("is_cloud")).alias("_cloud"),
        n(
            flagged(F.col("ddos_action")) | flagged(F.col("ddos_rule")) | flagged(F.col("malicious_flags"))
            | flagged(F.col("deny_reason"))
        ).alias("_threat"),
        n(miss & ~F.col("is_cacheable")).alias("_notCacheable"),
        n(miss & F.col("fetch").startswith("pass")).alias("_misspass"),
        n(miss & F.col("max_age").isNull()).alias("_noTtl"),
        n(miss & F.col("no_store")).alias("_noStore"),
        F.min(F.when(timed_cacheable, F.col("us"))).alias("_minCacheable"),
        F.max(F.when(timed_cacheable, F.col("us"))).alias("_maxCacheable"),
        n(timed_cacheable).alias("_timedCacheable"),
        F.min("us").alias("_minAll"),
        F.max("us").alias("_maxAll"),
        F.count("us").alias("_timed"),
    )


def volume(counted: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counters and shares per service from the counts."""
    window = F.coalesce((F.col("_maxCacheable") - F.col("_minCacheable")) / 1e6, F.lit(0.0))
    all_span = F.coalesce((F.col("_maxAll") - F.col("_minAll")) / 1e6, F.lit(0.0))
    m = "missCount"
    return counted.select(
        *keys, "totalRequests", "missCount", "hitCount", "passCount", "otherCount",
        _ratio(m, F.col(m) + F.col("hitCount")).alias("missRatio"),
        "passWith200Count",
        _ratio("passWith200Count", "passCount").alias("passWith200Share"),
        "passNon200Count", "pass429Count", "passNon200Non429Count",
        _ratio("passNon200Non429Count", "passCount").alias("passNon200Non429Share"),
        _ratio("_noheaders", "passWith200Count").alias("pass200NoHeadersShare"),
        _ratio("_private", "passWith200Count").alias("pass200PrivateShare"),
        "error429Count",
        _ratio("error429Count", "totalRequests").alias("error429Ratio"),
        "missWith429Count",
        _ratio("missWith429Count", "error429Count").alias("missShareOf429"),
        "originError5xxCount", "cdnDeniedCount", "shortTtlMissCount",
        _ratio("shortTtlMissCount", m).alias("shortTtlMissShare"),
        _ratio("_stale", m).alias("staleEligibleMissShare"),
        _ratio("_ttlSum", "_ttlCount").alias("avgMissTtlSeconds"),
        _ratio("_vary", m).alias("missVaryShare"),
        _ratio("_highVary", m).alias("highCardinalityVaryMissShare"),
        window.alias("windowSeconds"),
        _ratio(F.col("_timedCacheable") * 60.0, window).alias("cacheableRequestRatePerMin"),
        _ratio("_shield", m).alias("shieldingUsedMissShare"),
        "botMissCount",
        _ratio("botMissCount", m).alias("botMissShare"),
        _ratio("_cloud", "totalRequests").alias("cloudAsnRequestShare"),
        _ratio("_threat", "totalRequests").alias("cdnThreatShare"),
        _ratio("_notCacheable", m).alias("cacheableFalseMissShare"),
        _ratio("_misspass", m).alias("misspassMissShare"),
        _ratio("_noTtl", m).alias("missNoPositiveTtlShare"),
        _ratio("_noStore", m).alias("missNoStoreShare"),
        F.greatest(all_span, F.lit(1.0)).alias("_burstWindow"),
        F.col("_timed"),
    )


# URL and POP ----------------------------------------------------------------------------------------


def url_pop_counts(tagged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts per URL and POP; every URL and POP metric comes from this one reduction."""
    miss = F.col("is_miss")
    return tagged.groupBy(*keys, "url", "pop").agg(
        F.count("*").alias("requests"),
        F.count_if(miss).alias("miss"),
        F.count_if(miss & F.col("is_bot")).alias("miss_bot"),
        F.count_if("is_cacheable_state").alias("cacheable"),
        F.count_if(F.col("is_pass") & (F.col("status") == 200)).alias("pass200"),
        F.min(F.when(miss, F.col("us"))).alias("first_miss_us"),
    )


def url_counts(url_pop: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return url_pop.groupBy(*keys, "url").agg(
        F.sum("miss").alias("miss"),
        F.count_if(F.col("miss") > 0).alias("pops"),
        F.sum("cacheable").alias("cacheable"),
        F.sum("pass200").alias("pass200"),
    )


def url_metrics(urls: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """URL cardinality, repeats, and why each MISS happened (first fetch at a POP or a repeat there)."""
    repeated = F.col("miss") > 1
    sums = urls.groupBy(*keys).agg(
        F.count_if(F.col("miss") > 0).alias("distinctMissUrlCount"),
        F.count_if(F.col("miss") == 1).alias("singleRequestMissUrlCount"),
        F.count_if(repeated).alias("repeatedMissUrlCount"),
        F.max("miss").alias("maxRequestsForSingleMissUrl"),
        F.sum("pops").alias("distinctUrlPopPairs"),
        F.sum("miss").alias("_miss"),
        F.avg(F.when(repeated, F.col("pops"))).alias("avgPopsPerRepeatedMissUrl"),
        F.count_if(repeated & (F.col("pops") > 1)).alias("repeatedUrlMultiPopCount"),
        F.count_if(F.col("cacheable") > 0).alias("_cacheableUrls"),
        F.count_if(F.col("cacheable") == 1).alias("_singleCacheable"),
    )
    pairs = F.col("distinctUrlPopPairs")
    return sums.select(
        *keys, "distinctMissUrlCount",
        _ratio("distinctMissUrlCount", "_miss").alias("uniqueMissUrlRatio"),
        "singleRequestMissUrlCount",
        _ratio("singleRequestMissUrlCount", "distinctMissUrlCount").alias("singleRequestMissUrlShare"),
        "repeatedMissUrlCount", "maxRequestsForSingleMissUrl", "distinctUrlPopPairs",
        pairs.alias("firstFetchPerPopMissCount"),
        _ratio(pairs, "_miss").alias("coldPopFirstFetchShare"),
        (F.col("_miss") - pairs).alias("repeatSamePopMissCount"),
        _ratio(F.col("_miss") - pairs, "_miss").alias("repeatSamePopShare"),
        _ratio("_singleCacheable", "_cacheableUrls").alias("singleRequestCacheableUrlShare"),
        F.coalesce("avgPopsPerRepeatedMissUrl", F.lit(0.0)).alias("avgPopsPerRepeatedMissUrl"),
        "repeatedUrlMultiPopCount",
        _ratio("repeatedUrlMultiPopCount", "repeatedMissUrlCount").alias("repeatedUrlMultiPopShare"),
    )


def _top(rows: DataFrame, by: list[str], count: str, value: str, k: int) -> DataFrame:
    """The ``k`` largest per group, ties by value; the rank limit applies before and after the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(count), value)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_miss_urls(urls: DataFrame, keys: list[str] = KEYS, k: int = fixed.TOP_K) -> DataFrame:
    rows = urls.where("miss > 0").select(*keys, "url", F.col("miss").alias("count"), "pops")
    return _top(rows, keys, "count", "url", k)


def top_pass200_urls(urls: DataFrame, keys: list[str] = KEYS, k: int = fixed.TOP_K) -> DataFrame:
    rows = urls.where("pass200 > 0").select(*keys, "url", F.col("pass200").alias("count"))
    return _top(rows, keys, "count", "url", k)


def pop_counts(
    url_pop: DataFrame, baseline: DataFrame | None, keys: list[str] = KEYS, params: MetricParams = MetricParams()
) -> DataFrame:
    """MISSes per POP and whether the POP is rare: by the baseline where the service has one, else in the window."""
    pops = url_pop.where("pop <> ''").groupBy(*keys, "pop").agg(
        F.sum("requests").alias("requests"), F.sum("miss").alias("miss"), F.sum("miss_bot").alias("miss_bot")
    )
    totals = pops.groupBy(*keys).agg(F.sum("requests").alias("_requests"))
    rows = pops.join(totals, keys)
    in_window = F.col("requests") / F.nullif(F.col("_requests"), F.lit(0))
    if baseline is None:
        usual, used = F.lit(None).cast("double"), F.lit(0)
    else:
        baseline = stage(baseline, "baseline")
        known = [k for k in keys if k in baseline.columns]
        base_totals = baseline.groupBy(*known).agg(F.sum("count").alias("_base"))
        rows = rows.join(baseline.withColumnRenamed("count", "_base_pop"), [*known, "pop"], "left")
        rows = rows.join(base_totals, known, "left")
        used = F.when(F.coalesce("_base", F.lit(0)) > 0, 1).otherwise(0)
        usual = F.when(used == 1, F.coalesce("_base_pop", F.lit(0)) / F.nullif(F.col("_base"), F.lit(0)))
    share = F.coalesce(usual, in_window)
    return rows.select(
        *keys, "pop", "requests", "miss", "miss_bot",
        (share <= params.rare_pop_share).alias("rare"), used.alias("baselineUsed"),
    )


def pop_metrics(pops: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    rare = F.col("rare")
    sums = pops.groupBy(*keys).agg(
        F.count_if(F.col("miss") > 0).alias("distinctPopCount"),
        F.max("miss").alias("_top"),
        F.sum(F.when(rare, F.col("miss")).otherwise(0)).alias("_rare"),
        F.sum(F.when(rare, F.col("miss_bot")).otherwise(0)).alias("_rareBot"),
        F.max("baselineUsed").alias("baselineUsed"),
    )
    return sums


def cold_seconds(url_pop: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Peak per second, and number, of first fetches of a URL at a POP."""
    firsts = url_pop.where(F.col("first_miss_us").isNotNull())
    per_second = firsts.groupBy(*keys, F.floor(F.col("first_miss_us") / 1000000).alias("s")).agg(F.count("*").alias("n"))
    return per_second.groupBy(*keys).agg(F.max("n").alias("_coldPeak"), F.sum("n").alias("_cold"))


def second_counts(tagged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return tagged.where(F.col("second").isNotNull()).groupBy(*keys, "second").agg(F.count("*").alias("n"))


def second_metrics(per_second: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    return per_second.groupBy(*keys).agg(F.max("n").alias("peakRequestsPerSec"))


# Values of source and header fields -------------------------------------------------------------------


def spread(rows: DataFrame, keep: list[str], items: list[Column]) -> DataFrame:
    """One row per item that is not null; the items are structs that start with a non-null field.

    Nulls are dropped after the explode: that keeps the items in generated code.
    """
    out = rows.select(*keep, F.inline(F.array(*items)))
    return out.where(F.col(out.columns[len(keep)]).isNotNull())


def value_counts(tagged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts per ``(dim, value)`` over the events each field is judged on; one shuffle for all fields."""
    miss = F.col("is_miss")
    text = lambda c: strip(F.coalesce(F.col(c).cast("string"), F.lit("")))
    content = F.lower(strip(F.split(F.coalesce("content_type", F.lit("")), ";").getItem(0)))
    dims = {
        "passStatus": (F.col("is_pass"), text("status")),
        "vary": (miss, F.col("vary")),
        "bot": (miss & F.col("is_bot"), text("bot_name")),
        "contentType": (miss, content),
        "originHost": (F.lit(True), text("origin_host")),
        "ip": (F.lit(True), text("client_ip")),
        "userAgent": (F.lit(True), text("request_user_agent")),
        "country": (F.lit(True), text("geo_country_code")),
        "maxAge": (miss & F.col("max_age").isNotNull(), F.col("max_age").cast("string")),
        "swr": (miss & F.col("max_age").isNotNull() & F.col("swr").isNotNull(), F.col("swr").cast("string")),
    }
    pairs = [
        F.when(F.coalesce(cond, F.lit(False)) & (value != ""), F.struct(F.lit(dim).alias("dim"), value.alias("value")))
        for dim, (cond, value) in dims.items()
    ]
    return spread(tagged, keys, pairs).groupBy(*keys, "dim", "value").agg(F.count("*").alias("count"))


def value_metrics(counts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Number of values and count of the most frequent one, per field."""
    pick = lambda dim, col: F.max(F.when(F.col("dim") == dim, F.col(col)))
    per_dim = counts.groupBy(*keys, "dim").agg(F.count("*").alias("distinct"), F.max("count").alias("top"))
    return per_dim.groupBy(*keys).agg(
        *[F.coalesce(pick(d, "distinct"), F.lit(0)).alias(f"_distinct_{d}") for d in ("ip", "userAgent", "country")],
        *[
            F.coalesce(pick(d, "top"), F.lit(0)).alias(f"_top_{d}")
            for d in ("bot", "contentType", "ip", "userAgent", "country")
        ],
    )


def top_values(counts: DataFrame, keys: list[str] = KEYS, k: int = fixed.TOP_K) -> DataFrame:
    return _top(counts, [*keys, "dim"], "count", "value", k)


# Networks ---------------------------------------------------------------------------------------------


def network_counts(tagged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Requests and MISSes per network number, cloud mark included."""
    asn = strip(F.coalesce("client_as_number", F.lit("")))
    return (
        tagged.withColumn("asn", asn)
        .where("asn <> ''")
        .groupBy(*keys, "asn")
        .agg(F.count("*").alias("count"), F.count_if("is_miss").alias("miss"), F.max("is_cloud").alias("cloud"))
    )


def first_seen(rows: DataFrame, by: list[str], cols: list[str]) -> DataFrame:
    """Values of the first row, in time and reading order, of every group.

    The earliest time per group is a plain hash aggregate; only the rows at that time are looked at again.
    """
    rows = rows.withColumn("us", F.coalesce("us", F.lit(NO_TIME)))
    earliest = stage(rows.groupBy(*by).agg(F.min("us").alias("us")), "earliest")
    at_first = rows.select(*by, "us", "ord", *cols).join(earliest, [*by, "us"])
    return at_first.groupBy(*by, "us").agg(F.min("ord").alias("ord"), F.min_by(F.struct(*cols), F.struct("ord", *cols)).alias("f")).select(
        *by, "us", "ord", "f.*"
    )


def first_values(tagged: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """First cache directives of non-cacheable MISSes, first name and first forwarded request per network."""
    asn = strip(F.coalesce("client_as_number", F.lit("")))
    none = F.lit("")
    bad = F.col("is_miss") & (F.col("max_age").isNull() | F.col("no_store"))
    item = lambda cond, dim, grp, a, b=none: F.when(
        F.coalesce(cond, F.lit(False)),
        F.struct(F.lit(dim).alias("dim"), grp.alias("grp"), a.alias("a"), b.alias("b")),
    )
    name, via = F.coalesce("client_as_name", none), strip(F.coalesce("request_via", none))
    pairs = [
        item(bad & (strip(F.col("cc")) != ""), "cacheControl", none, F.col("cc")),
        item(bad & (strip(F.col("sc")) != ""), "surrogateControl", none, F.col("sc")),
        item(asn != "", "name", asn, name),
        item((asn != "") & F.col("forwarded"), "forwarded", asn, F.col("real_ip"), via),
    ]
    return first_seen(spread(tagged, [*keys, "us", "ord"], pairs), [*keys, "dim", "grp"], ["a", "b"])


def networks(counts: DataFrame, firsts: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Networks with their name and, where one was seen, a request forwarded for a real visitor."""
    names = firsts.where("dim = 'name'").select(*keys, F.col("grp").alias("asn"), F.col("a").alias("name"))
    samples = firsts.where("dim = 'forwarded'").select(
        *keys, F.col("grp").alias("asn"), F.struct(F.col("a").alias("realClientIp"), F.col("b").alias("via")).alias("forwardedSample")
    )
    return counts.join(names, [*keys, "asn"], "left").join(samples, [*keys, "asn"], "left")


# Gaps between requests --------------------------------------------------------------------------------


def request_times(tagged: DataFrame, keys: list[str] = KEYS, slice_seconds: int = 600) -> DataFrame:
    """HIT and MISS requests per URL, POP and instant, tagged with their time slice.

    Rows of one URL in one slice are then at most one per instant and POP, however hot the URL is.
    """
    miss, ttl = F.col("is_miss"), F.col("response_ttl")
    timed = tagged.where(F.col("is_cacheable_state") & F.col("us").isNotNull())
    # last TTL of an instant by reading order
    return timed.groupBy(
        *keys, "url", "pop", "us", F.floor(F.col("us") / (slice_seconds * 1000000)).cast("bigint").alias("slice")
    ).agg(
        F.count("*").alias("n"),
        F.count_if(miss).alias("n_miss"),
        F.count_if(miss & (ttl > 0)).alias("n_ttl"),
        F.max_by(F.when(miss, ttl), F.when(miss, F.col("ord"))).alias("ttl"),
        F.max(F.when(miss, F.col("ord"))).alias("ttl_ord"),
    )


def sliced_times(times: DataFrame, keys: list[str] = KEYS, most: int = MetricParams.slice_rows) -> DataFrame:
    """``times`` with ``part``: where a URL has more than ``most`` rows in a time slice, the slice is cut at quantiles.

    Rows are counted per millisecond, and a part begins whenever another ``most`` rows have gone by; so a part holds
    at most ``most`` rows and those of one millisecond. A slice has a bounded number of milliseconds, whatever the traffic,
    and rows find their part by their millisecond, which is no hot key.
    """
    by_slice = [*keys, "url", "slice"]
    hot = times.groupBy(*by_slice).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most).select(*by_slice)
    fine = times.withColumn("ms", F.floor(F.col("us") / 1000))
    bins = fine.join(hot, by_slice, "left_semi").groupBy(*by_slice, "ms").agg(F.count(F.lit(1)).alias("rows"))
    gone = F.sum("rows").over(Window.partitionBy(*by_slice).orderBy("ms")) - F.col("rows")
    parts = bins.select(*by_slice, "ms", F.floor(gone / most).alias("part"))
    return fine.join(parts, [*by_slice, "ms"], "left").drop("ms").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))


def request_gaps(times: DataFrame, keys: list[str] = KEYS, most: int = MetricParams.slice_rows) -> DataFrame:
    """Gaps between consecutive requests of a URL (kind ``agg``) and of a URL at one POP (``pop``), counted.

    Kind ``refetch`` counts MISSes within the TTL of the previous MISS of the same URL and POP.

    Gaps inside a part of a time slice come from windows over that part; gaps across parts from the edges of
    each, of which there is one row per URL (and POP) and part.
    """
    cut = ["slice", "part"]
    times = sliced_times(times, keys, most)
    rows = times.repartition(*[F.col(c) for c in (*keys, "url", *cut)])
    by_url, by_pop = [*keys, "url"], [*keys, "url", "pop"]
    in_url = Window.partitionBy(*by_url, *cut).orderBy("us", "pop")
    in_pop = Window.partitionBy(*by_pop, *cut).orderBy("us")
    before = in_pop.rowsBetween(Window.unboundedPreceding, -1)
    miss_us, miss_ttl = F.when(F.col("n_miss") > 0, F.col("us")), F.when(F.col("n_miss") > 0, F.col("ttl"))
    inside = rows.select(
        *by_pop, *cut, "us", "n", "n_miss", "n_ttl", "ttl",
        (F.col("us") - F.lag("us").over(in_url)).alias("gap_agg"),
        (F.col("us") - F.lag("us").over(in_pop)).alias("gap_pop"),
        F.last(miss_us, ignorenulls=True).over(before).alias("prev_miss"),
        F.last(miss_ttl, ignorenulls=True).over(before).alias("prev_ttl"),
    )
    gap = lambda kind, us, n: F.struct(F.lit(kind).alias("kind"), us.alias("gap_us"), n.alias("n"))
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    extra = F.col("n") - 1
    within = lambda prev, ttl, us: (ttl > 0) & (us - prev <= ttl * 1000000)
    # inside one instant every MISS but the last is followed at once; the last may follow an earlier MISS
    refetch = F.when(
        F.col("n_miss") > 0,
        F.col("n_ttl") - F.when(F.col("ttl") > 0, 1).otherwise(0)
        + F.when(within(F.col("prev_miss"), F.col("prev_ttl"), F.col("us")), 1).otherwise(0),
    ).otherwise(0).cast("bigint")
    inner = [
        part
        for kind, col in (("agg", "gap_agg"), ("pop", "gap_pop"))
        for part in (
            F.when(F.col(col).isNotNull(), gap(kind, F.col(col), one)),
            F.when(extra > 0, gap(kind, zero, extra)),
        )
    ]
    inner.append(F.when(refetch > 0, gap("refetch", zero, refetch)))

    pop_edges = times.groupBy(*by_pop, *cut).agg(
        F.min("us").alias("lo"),
        F.max("us").alias("hi"),
        F.min(miss_us).alias("miss_lo"),
        F.max(miss_us).alias("miss_hi"),
        F.max_by(miss_ttl, miss_us).alias("miss_ttl"),
    )
    pop_edges = stage(pop_edges, "edges")
    over_pop = Window.partitionBy(*by_pop).orderBy(*cut)
    earlier = over_pop.rowsBetween(Window.unboundedPreceding, -1)
    pop_steps = pop_edges.select(
        *keys,
        (F.col("lo") - F.lag("hi").over(over_pop)).alias("gap_us"),
        "miss_lo",
        F.last("miss_hi", ignorenulls=True).over(earlier).alias("prev_miss"),
        F.last(F.when(F.col("miss_hi").isNotNull(), F.col("miss_ttl")), ignorenulls=True).over(earlier).alias("prev_ttl"),
    )
    url_edges = pop_edges.groupBy(*by_url, *cut).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    url_steps = url_edges.select(
        *keys, (F.col("lo") - F.lag("hi").over(Window.partitionBy(*by_url).orderBy(*cut))).alias("gap_us")
    )

    steps = lambda rows, kind: rows.where(F.col("gap_us").isNotNull()).select(
        *keys, F.lit(kind).alias("kind"), "gap_us", one.alias("n")
    )
    late = pop_steps.where(within(F.col("prev_miss"), F.col("prev_ttl"), F.col("miss_lo")))
    rows = (
        spread(inside, keys, inner)
        .unionByName(steps(pop_steps, "pop"))
        .unionByName(steps(url_steps, "agg"))
        .unionByName(late.select(*keys, F.lit("refetch").alias("kind"), zero.alias("gap_us"), one.alias("n")))
    )
    return rows.groupBy(*keys, "kind", "gap_us").agg(F.sum("n").alias("n"))


def gap_metrics(times: DataFrame, keys: list[str] = KEYS, most: int = MetricParams.slice_rows) -> DataFrame:
    """Median and P90 gaps per URL, P90 per URL and POP, their number, and re-fetches within the TTL."""
    counted = stage(request_gaps(times, keys, most), "gaps")
    refetches = counted.where("kind = 'refetch'").groupBy(*keys).agg(F.sum("n").alias("refetchWithinTtlCount"))
    gaps = counted.where("kind <> 'refetch'")
    q = exact_quantiles(gaps, [*keys, "kind"], "gap_us", "n", {"p50": 0.5, "p90": 0.9}, counted=True)
    pick = lambda kind, col: F.max(F.when(F.col("kind") == kind, F.col(col)))
    wide = q.groupBy(*keys).agg(
        (pick("agg", "p50") / 1e6).alias("p50AggGapSeconds"),
        (pick("agg", "p90") / 1e6).alias("p90AggGapSeconds"),
        (pick("pop", "p90") / 1e6).alias("p90PerPopGapSeconds"),
        pick("agg", "n").alias("_gaps"),
    )
    return combine([wide, refetches], keys).withColumn(
        "refetchWithinTtlCount", F.coalesce("refetchWithinTtlCount", F.lit(0))
    )


def nice_ttl(seconds: Column, steps: list[int]) -> Column:
    """Smallest step that covers the gap, the largest step beyond."""
    out = F.lit(steps[-1])
    for s in reversed(steps):
        out = F.when(seconds <= s, F.lit(s)).otherwise(out)
    return out


# Assembly ---------------------------------------------------------------------------------------------


def _listed(rows: DataFrame, keys: list[str], name: str, item: Column, cond: Column | None = None) -> Column:
    """Ranked short list as an array (its rows were limited before)."""
    entry = F.struct("rank", item.alias("v"))
    entry = F.when(cond, entry) if cond is not None else entry
    return F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["v"]).alias(name)


def _listed_values(tops: DataFrame, keys: list[str]) -> DataFrame:
    value, count = F.col("value"), F.col("count")
    lists = {
        "passStatusTop": ("passStatus", F.struct(value.try_cast("int").alias("status"), count)),
        "topMissVaryValues": ("vary", F.struct(value, count)),
        "topBots": ("bot", F.struct(value.alias("bot"), count)),
        "topClientIps": ("ip", F.struct(value.alias("ip"), count)),
        "topUserAgents": ("userAgent", F.struct(value.alias("userAgent"), count)),
        "topCountries": ("country", F.struct(value.alias("country"), count)),
    }
    best = lambda dim: F.max(F.when((F.col("dim") == dim) & (F.col("rank") == 1), value))
    return tops.groupBy(*keys).agg(
        *[_listed(tops, keys, n, item, F.col("dim") == dim) for n, (dim, item) in lists.items()],
        best("bot").alias("topBotName"),
        best("contentType").alias("dominantMissContentType"),
        best("originHost").alias("topOriginHost"),
        best("ip").alias("topClientIpAddress"),
        best("userAgent").alias("topUserAgentName"),
        best("country").alias("topCountryCode"),
        F.coalesce(best("maxAge").cast("bigint"), F.lit(0)).alias("observedMaxAgeSeconds"),
        F.coalesce(best("swr").cast("bigint"), F.lit(0)).alias("observedSwrSeconds"),
    )


def _network_frames(nets: DataFrame, keys: list[str], k: int) -> list[DataFrame]:
    sums = nets.groupBy(*keys).agg(
        F.count_if(F.col("miss") > 0).alias("distinctClientAsCount"),
        F.max("miss").alias("_topAsnMiss"),
        F.max("count").alias("_topAsn"),
    )
    by_count = _top(nets, keys, "count", "asn", k)
    sources = by_count.groupBy(*keys).agg(
        _listed(by_count, keys, "topSourceAsns", F.struct("asn", "name", "count", "cloud", "forwardedSample")),
        F.max(F.when(F.col("rank") == 1, F.col("name"))).alias("topAsnRequestName"),
    )
    missing = nets.where("miss > 0").select(*keys, "asn", "name", F.col("miss").alias("count"), "forwardedSample")
    by_miss = _top(missing, keys, "count", "asn", k)
    misses = by_miss.groupBy(*keys).agg(
        _listed(by_miss, keys, "topAsns", F.struct("asn", "name", "count", "forwardedSample"))
    )
    return [sums, sources, misses]


# Names of the metrics and lists of a report.
SCALARS = [
    "totalRequests", "missCount", "hitCount", "passCount", "otherCount", "missRatio", "passWith200Count",
    "passWith200Share", "passNon200Count", "pass429Count", "passNon200Non429Count", "passNon200Non429Share",
    "pass200NoHeadersShare", "pass200PrivateShare", "error429Count", "error429Ratio", "missWith429Count",
    "missShareOf429", "originError5xxCount", "cdnDeniedCount", "distinctMissUrlCount", "uniqueMissUrlRatio",
    "singleRequestMissUrlCount", "singleRequestMissUrlShare", "repeatedMissUrlCount", "maxRequestsForSingleMissUrl",
    "distinctUrlPopPairs", "firstFetchPerPopMissCount", "coldPopFirstFetchShare", "repeatSamePopMissCount",
    "repeatSamePopShare", "coldFetchBurstRatio", "shortTtlMissCount", "shortTtlMissShare", "staleEligibleMissShare",
    "avgMissTtlSeconds", "refetchWithinTtlCount", "missVaryShare", "highCardinalityVaryMissShare", "windowSeconds",
    "cacheableRequestRatePerMin", "singleRequestCacheableUrlShare", "p50AggGapSeconds", "p90AggGapSeconds",
    "p90PerPopGapSeconds", "observedMaxAgeSeconds", "recommendedTtlSeconds", "observedSwrSeconds",
    "recommendedSwrSeconds", "ttlDataSufficient", "distinctPopCount", "topPopMissShare", "avgPopsPerRepeatedMissUrl",
    "repeatedUrlMultiPopCount", "repeatedUrlMultiPopShare", "shieldingUsedMissShare", "botMissCount", "botMissShare",
    "topBotName", "topBotMissShare", "distinctClientAsCount", "topAsnMissShare", "cloudAsnRequestShare",
    "topAsnRequestShare", "topAsnRequestName", "peakRequestsPerSec", "burstRatio", "cdnThreatShare", "topOriginHost",
    "distinctClientIpCount", "topClientIpRequestShare", "topClientIpAddress", "distinctUserAgentCount",
    "topUserAgentRequestShare", "topUserAgentName", "distinctCountryCount", "topCountryRequestShare",
    "topCountryCode", "rarePopMissShare", "botOnRarePopMissShare", "baselineUsed", "cacheableFalseMissShare",
    "misspassMissShare", "missNoPositiveTtlShare", "missNoStoreShare", "sampleMissCacheControl",
    "sampleMissSurrogateControl", "dominantMissContentType", "dominantMissContentTypeShare",
]
LISTS = [
    "passStatusTop", "topPass200Urls", "topMissVaryValues", "topSourceAsns", "topClientIps", "topUserAgents",
    "topCountries", "topMissUrls", "popMissBreakdown", "topBots", "topAsns", "warnings",
]
TEXTS = [
    "topBotName", "topAsnRequestName", "topOriginHost", "topClientIpAddress", "topUserAgentName", "topCountryCode",
    "sampleMissCacheControl", "sampleMissSurrogateControl", "dominantMissContentType",
]


def partials(tagged: DataFrame, keys: list[str] = KEYS, params: MetricParams = MetricParams()) -> dict[str, DataFrame]:
    """The reduced frames that all metrics come from. Parts of different events can be merged."""
    return {
        "volume": volume_counts(tagged, keys, params),
        "url-pop": url_pop_counts(tagged, keys),
        "seconds": second_counts(tagged, keys),
        "values": value_counts(tagged, keys),
        "networks": network_counts(tagged, keys),
        "firsts": first_values(tagged, keys),
        "times": request_times(tagged, keys, params.time_slice_seconds),
    }


PART_GROUPS = {
    "volume": [], "url-pop": ["url", "pop"], "seconds": ["second"], "values": ["dim", "value"], "networks": ["asn"],
    "firsts": ["dim", "grp"], "times": ["url", "pop", "us", "slice"],
}
MINIMA = {"first_miss_us", "_minCacheable", "_minAll"}
MAXIMA = {"_maxCacheable", "_maxAll", "cloud"}


def merge_part(name: str, rows: DataFrame, keys: list[str] = KEYS, batch: str | None = None, keep_batch: bool = False) -> DataFrame:
    """One part from the same part of several sets of events.

    Events arrive in the order of the column ``batch``, then of ``ord``; without ``batch``, ``ord`` orders the sets too.
    With ``keep_batch`` the column stays, so that the result can be merged again with parts of other batches.
    """
    by, arrival = [*keys, *PART_GROUPS[name]], [batch] if batch else []
    kept = arrival if keep_batch else []
    if name == "firsts":
        first = F.min_by(F.struct("us", *kept, "ord", "a", "b"), F.struct("us", *arrival, "ord", "a", "b"))
        return rows.groupBy(*by).agg(first.alias("f")).select(*by, "f.*")
    folds = []
    for c in rows.columns:
        if c in by or c in ("ttl", "ttl_ord", batch):
            continue
        fold = F.min if c in MINIMA else F.max if c in MAXIMA else F.sum
        folds.append(fold(c).alias(c))
    if name == "times":
        last = F.when(F.col("ttl_ord").isNotNull(), F.struct(*arrival, "ttl_ord"))
        # Of the batch that gave the lifetime; without one, any batch will do.
        folds += [F.max_by(c, last).alias(c) for c in ("ttl", "ttl_ord")] + [F.coalesce(F.max_by(c, last), F.max(c)).alias(c) for c in kept]
    else:
        folds += [F.max(c).alias(c) for c in kept]
    return rows.groupBy(*by).agg(*folds)


REUSED_PARTS = ["url-pop", "values", "firsts", "times"]


def metrics_from_slim(
    slim: DataFrame,
    baseline: DataFrame | None = None,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
) -> DataFrame:
    """All metrics from a table of ``slim_events``; when this returns, the table isn't read any more."""
    return metrics_from_parts(stage_all(partials(slim, keys, params)), baseline, keys, params)


def cdn_metrics(
    events: DataFrame,
    baseline: DataFrame | None = None,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
) -> DataFrame:
    """All metrics of every service and tier (or other ``keys``): 89 scalars and 12 lists in one row.

    The events are read once; the groupings read what was kept of them.
    """
    staging = Staging(events.sparkSession, "cdn")
    metrics = metrics_from_slim(staging.write("events", slim_events(events, keys, params)), baseline, keys, params)
    staging.drop("events")
    return metrics


def metrics_from_parts(
    parts: dict[str, DataFrame],
    baseline: DataFrame | None = None,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
) -> DataFrame:
    """Metrics from the reduced frames; those in ``REUSED_PARTS`` feed several branches and should be tables."""
    url_pop, values, firsts = parts["url-pop"], parts["values"], parts["firsts"]
    more = stage_all(
        {
            "urls": url_counts(url_pop, keys),
            "networks": networks(parts["networks"], firsts, keys),
            "pops": pop_counts(url_pop, baseline, keys, params),
        }
    )
    urls, nets, pops = more["urls"], more["networks"], more["pops"]

    top_urls = top_miss_urls(urls, keys, params.top_k)
    top_pass = top_pass200_urls(urls, keys, params.top_k)
    miss_pops = pops.where("miss > 0").select(*keys, "pop", F.col("miss").alias("count"), "rare")
    sample = lambda dim: F.max(F.when(F.col("dim") == dim, F.col("a")))
    top_pops = _top(miss_pops, keys, "count", "pop", params.top_k)
    frames = [
        url_metrics(urls, keys),
        pop_metrics(pops, keys),
        cold_seconds(url_pop, keys),
        second_metrics(parts["seconds"], keys),
        value_metrics(values, keys),
        _listed_values(top_values(values, keys, params.top_k), keys),
        *_network_frames(nets, keys, params.top_k),
        gap_metrics(parts["times"], keys, params.slice_rows),
        top_urls.groupBy(*keys).agg(_listed(top_urls, keys, "topMissUrls", F.struct("url", "count", "pops"))),
        top_pass.groupBy(*keys).agg(_listed(top_pass, keys, "topPass200Urls", F.struct("url", "count"))),
        top_pops.groupBy(*keys).agg(_listed(top_pops, keys, "_popList", F.struct("pop", "count", "rare"))),
        firsts.where("grp = ''").groupBy(*keys).agg(
            sample("cacheControl").alias("sampleMissCacheControl"),
            sample("surrogateControl").alias("sampleMissSurrogateControl"),
        ),
    ]
    return finish(combine([volume(parts["volume"], keys), *frames], keys), keys, params)


def empty_metrics(services: DataFrame, like: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Metrics of services without events, in the columns of ``like``: zeros, blank texts, empty lists."""
    blank = {"string": F.lit("")}
    columns = []
    for f in like.schema:
        kind = f.dataType.simpleString()
        if f.name in keys:
            value = F.col(f.name)
        elif f.name == "warnings":
            value = F.array(F.lit(fixed.NO_MISS_WARNING))
        elif kind.startswith("array"):
            value = F.array().cast(f.dataType)
        else:
            value = blank.get(kind, F.lit(0).cast(f.dataType))
        columns.append(value.alias(f.name))
    return services.select(*columns)


def combine(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames with one row per key put side by side: stacked, then folded by key in one shuffle."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns if c not in keys]
    )


def finish(joined: DataFrame, keys: list[str], params: MetricParams) -> DataFrame:
    """Ratios, recommendations and warnings from the joined parts."""
    zero = F.lit(0)
    m, n = F.coalesce("missCount", zero), F.col("totalRequests")
    count = lambda c: F.coalesce(F.col(c), zero)
    enough = F.when(count("_gaps") >= params.min_ttl_gaps, 1).otherwise(0)
    ttl = F.greatest(nice_ttl(F.col("p90AggGapSeconds"), params.ttl_steps), count("observedMaxAgeSeconds"))
    swr = F.greatest(
        nice_ttl(F.col("p90PerPopGapSeconds"), params.ttl_steps), F.lit(params.swr_floor_seconds), count("observedSwrSeconds")
    )
    no_miss = F.when(m == 0, F.lit(fixed.NO_MISS_WARNING))
    derived = joined.withColumns(
        {
            "coldFetchBurstRatio": _ratio(count("_coldPeak"), count("_cold") / F.col("_burstWindow")),
            "burstRatio": _ratio(count("peakRequestsPerSec"), F.col("_timed") / F.col("_burstWindow")),
            "ttlDataSufficient": enough,
            "recommendedTtlSeconds": F.when(enough == 1, ttl).otherwise(0).cast("bigint"),
            "recommendedSwrSeconds": F.when(enough == 1, swr).otherwise(0).cast("bigint"),
            "topPopMissShare": _ratio(count("_top"), m),
            "rarePopMissShare": _ratio(count("_rare"), m),
            "botOnRarePopMissShare": _ratio(count("_rareBot"), m),
            "topBotMissShare": _ratio(count("_top_bot"), m),
            "topAsnMissShare": _ratio(count("_topAsnMiss"), m),
            "topAsnRequestShare": _ratio(count("_topAsn"), n),
            "distinctClientIpCount": count("_distinct_ip"),
            "topClientIpRequestShare": _ratio(count("_top_ip"), n),
            "distinctUserAgentCount": count("_distinct_userAgent"),
            "topUserAgentRequestShare": _ratio(count("_top_userAgent"), n),
            "distinctCountryCount": count("_distinct_country"),
            "topCountryRequestShare": _ratio(count("_top_country"), n),
            "dominantMissContentTypeShare": _ratio(count("_top_contentType"), m),
            "popMissBreakdown": F.transform(
                "_popList",
                lambda p: F.struct(p["pop"].alias("pop"), p["count"].alias("count"), (p["count"] / m).alias("share"), p["rare"].alias("rare")),
            ),
            "warnings": F.array_compact(F.array(no_miss)),
        }
    )
    lists = [
        F.coalesce(F.col(c), F.array().cast(derived.schema[c].dataType)).alias(c) for c in LISTS
    ]
    numbers = [c for c in SCALARS if c not in TEXTS]
    return derived.select(
        *keys,
        *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in TEXTS else F.coalesce(F.col(c), zero).alias(c) for c in SCALARS],
        *lists,
    ).fillna({c: 0 for c in numbers})
