"""Events to reports, for all services in one job."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.functions import cdn_texts as tx
from stallscope.functions import fixed
from stallscope.operators.cdn_findings import classify, fill
from stallscope.operators.cdn_metrics import KEYS, MetricParams, empty_metrics, metrics_from_slim, slim_events
from stallscope.operators.upstream import resolve_upstream
from stallscope.session import Staging
from stallscope.sources.cdn_scan import cap_events, incident_events, pop_baseline, truncation, truncation_warning


def with_upstream(metrics: DataFrame, cnames: DataFrame) -> DataFrame:
    """Add the ``upstream`` struct of the top origin host of every service, null where none is known."""
    hosts = metrics.where("topOriginHost <> ''").select(F.col("topOriginHost").alias("host"))
    found = resolve_upstream(hosts, cnames).select(
        F.col("hostname").alias("_host"), F.struct("hostname", "chain", "provider").alias("upstream")
    )
    joined = metrics.withColumn("_host", F.trim("topOriginHost")).join(found, "_host", "left")
    return joined.drop("_host")


def summary() -> Column:
    """One-paragraph headline of a report."""
    some = F.expr(f"CASE WHEN passCount > 0 THEN {fill(tx.SUMMARY_PASS)} ELSE '' END")
    verdict = F.expr(f"CASE WHEN verdictName IS NOT NULL THEN {fill(tx.SUMMARY_VERDICT)} ELSE {fill(tx.SUMMARY_OPEN)} END")
    rate = F.expr(f"CASE WHEN error429Count > 0 THEN {fill(tx.SUMMARY_429)} END")
    return (
        F.when(F.col("totalRequests") == 0, F.lit(tx.SUMMARY_EMPTY))
        .when(F.col("missCount") == 0, F.concat(F.expr(fill(tx.SUMMARY_NO_MISS)), some))
        .otherwise(F.concat_ws(" ", F.expr(fill(tx.SUMMARY_MISS)), verdict, rate))
    )


def reports(metrics: DataFrame) -> DataFrame:
    """Metrics with findings, verdict (the first hypothesis) and summary."""
    first = F.get("hypotheses", F.lit(0))
    rows = classify(metrics).withColumns(
        {
            "verdictId": first["signatureId"],
            "verdictName": first["signatureName"],
            "verdictConfidence": first["confidence"],
        }
    )
    return rows.withColumn("entryCount", F.col("totalRequests")).withColumn("summary", summary()).drop("hypotheses")


def analyse_events(
    events: DataFrame,
    baseline: DataFrame | None = None,
    cnames: DataFrame | None = None,
    max_events: int = 0,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
    with_baseline_warning: bool = False,
    services: DataFrame | None = None,
    baseline_failure: str | None = None,
) -> DataFrame:
    """Reports of every service: cap, metrics, upstream check, findings.

    Without baseline rows for a service its POP rarity is judged within the window, with a warning; the warning
    names ``baseline_failure`` where the baseline could not be had at all. ``services`` (the ``keys``) adds reports
    of services that have no event.
    """
    staging = Staging(events.sparkSession, "report")
    slim = staging.write("events", slim_events(events, keys, params))  # the only read of the events
    capped = staging.write("capped", cap_events(slim, max_events, keys)) if max_events > 0 else slim
    found = metrics_from_slim(capped, baseline, keys, params)
    if services is not None:
        found = staging.write("found", found)
        found = found.unionByName(empty_metrics(services.join(found, keys, "left_anti"), found, keys))
    metrics = staging.write("metrics", found)
    notes = []
    if max_events > 0:
        hit = truncation(slim, max_events, keys).where("truncated").select(*keys, "truncated")
        metrics = metrics.join(hit, keys, "left")
        notes.append(F.when(F.col("truncated"), truncation_warning(max_events)))
    if baseline_failure is not None:
        notes.append(F.lit(fixed.FAILED_BASELINE_WARNING.format(baseline_failure)))
    elif with_baseline_warning or baseline is not None:
        notes.append(F.when(F.col("baselineUsed") == 0, fixed.NO_BASELINE_WARNING))
    if notes:
        metrics = metrics.withColumn("warnings", F.concat(F.array_compact(F.array(*notes)), F.col("warnings")))
    if cnames is not None:
        metrics = with_upstream(metrics, cnames)
    out = staging.write("reports", reports(metrics.drop("truncated")))
    staging.drop("events", "capped", "found", "metrics")
    return out


def analyse_incident(
    events: DataFrame,
    start: str,
    end: str,
    service: str | None = None,
    tier: str | None = None,
    urls: list[str] | None = None,
    max_events: int = 0,
    days: int | None = None,
    cnames: DataFrame | None = None,
    now: datetime | Column | None = None,
    history: Callable[[], DataFrame] | None = None,
    params: MetricParams = MetricParams(),
) -> DataFrame:
    """The whole incident: scan window and addresses, cap, POP baseline, metrics, upstream check, reports.

    ``history`` gives the events the baseline is counted on (``events`` unless given). If they can't be read, the
    incident is still analysed, with a warning. A named service without events gets an empty report.
    """
    scanned = incident_events(events, start, end, service, tier, urls, now)
    baseline, failure = None, None
    try:
        before = history() if history else events
        baseline = Staging(events.sparkSession, "baseline").write("pops", pop_baseline(before, start, service, tier, days, now))
    except PySparkException as e:
        failure = str(e.getMessage() or e).splitlines()[0]
    services = None
    if service is not None and tier != "*":
        services = events.sparkSession.createDataFrame([(service, tier or fixed.DEFAULT_TIER)], "aem_service string, aem_tier string")
    return analyse_events(scanned, baseline, cnames, max_events, KEYS, params, True, services, failure)


def report_lines(report: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Report text of every service as ordered lines: head, summary, key metrics, warnings, findings."""
    metric_lines = [
        fill(t).replace("[ttl]", fill(tx.KEY_METRIC_TTL)) if "[ttl]" in t else fill(t) for t in tx.KEY_METRICS
    ]
    finding = (
        "concat(array('', concat('### [', upper(f.confidence), '] ', f.signatureName)), "
        "CASE WHEN size(f.matchedConditions) > 0 THEN concat(array('**Signals matched:**'), transform(f.matchedConditions, "
        "c -> concat('- ', c.description, ' — `', c.observedValue, '`'))) ELSE array() END, "
        "CASE WHEN size(f.evidence) > 0 THEN concat(array('**Evidence:**'), transform(f.evidence, e -> concat('- ', e))) ELSE array() END, "
        "CASE WHEN size(f.nextSteps) > 0 THEN concat(array('**Next steps:**'), transform(f.nextSteps, s -> concat('- ', s))) ELSE array() END)"
    )
    lines = (
        "concat(array(concat('# CDN Cache Miss Analysis — ', aem_service), '', concat('**Tier:** ', aem_tier), '', '## Summary', "
        f"summary, '', '## Key metrics', {', '.join(metric_lines)}, ''), "
        "CASE WHEN size(warnings) > 0 THEN concat(array('## Warnings'), transform(warnings, w -> concat('- ', w)), array('')) ELSE array() END, "
        f"array('## Findings'), flatten(transform(findings, f -> {finding})))"
    )
    return report.select(*keys, F.posexplode(F.expr(lines)).alias("line_no", "line"))


def write_reports(report: DataFrame, path: str, keys: list[str] = KEYS) -> None:
    """One folder per service and tier, the report text in order."""
    text = report_lines(report, keys).groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l")
    )
    text.select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("value")).write.partitionBy(
        *keys
    ).mode("append").text(path)
