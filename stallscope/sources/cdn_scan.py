"""Scans over the event table: incident window, POP baseline, event cap."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.session import stage

SERVICE_KEYS = ["aem_service", "aem_tier"]
ORD_RANGE_BITS = 16  # rows of one instant are counted by ranges of this many bits of their order

# Unit of a relative time and the interval unit it stands for.
UNITS = {
    "us": ("SECOND", 1e-6), "ms": ("SECOND", 1e-3), "cs": ("SECOND", 1e-2), "ds": ("SECOND", 1e-1), "s": ("SECOND", 1),
    "m": ("MINUTE", 1), "h": ("HOUR", 1), "d": ("DAY", 1), "w": ("DAY", 7), "mon": ("MONTH", 1), "q": ("MONTH", 3),
    "y": ("YEAR", 1),
}
SNAPS = {"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}
RELATIVE = re.compile(r"^([-+]?)(\d+)(mon|us|ms|cs|ds|s|m|h|d|w|q|y)(?:@([a-z0-9]+))?$")


def is_relative(value: str) -> bool:
    v = value.strip().lower()
    return v in ("now", "rt") or bool(RELATIVE.match(v)) or bool(re.match(r"^@[a-z0-9]+$", v))


def _snapped(t: Column, unit: str | None) -> Column:
    """The start of the unit ``t`` lies in. Weeks start on Sunday; ``w0`` to ``w6`` are the last Sunday to Saturday."""
    if not unit:
        return t
    if re.fullmatch(r"w[0-6]?", unit):
        day = F.date_trunc("day", t)
        back = F.pmod(F.dayofweek(day) - 1 - F.lit(int(unit[1:] or 0)), F.lit(7))
        return F.timestamp_seconds(F.unix_seconds(day) - back * 86400)
    if unit not in SNAPS:
        raise ValueError(f"unknown time unit after @: {unit}")
    return F.date_trunc(SNAPS[unit], t)


def time_bound(value: str | None, now: Column) -> Column:
    """A window bound as a column: ISO text, epoch seconds or milliseconds, or relative to ``now``."""
    v = (value or "").strip()
    low = v.lower()
    if low in ("", "now", "rt"):
        return now
    if low.startswith("@"):
        return _snapped(now, low[1:])
    rel = RELATIVE.match(low)
    if rel:
        sign, amount, unit, snap = rel.groups()
        name, factor = UNITS[unit]
        n = int(amount) * factor * (-1 if sign == "-" else 1)
        moved = now + F.expr(f"INTERVAL '{n:f}' SECOND" if name == "SECOND" else f"INTERVAL '{int(n)}' {name}")
        return _snapped(moved, snap)
    if re.match(r"^\d{13}$", v):
        return F.timestamp_seconds(F.lit(int(v) // 1000))
    if re.match(r"^\d{10}$", v):
        return F.timestamp_seconds(F.lit(int(v)))
    return F.date_trunc("second", F.to_timestamp(F.lit(re.sub("GMT$", "Z", v))))


def baseline_days(days: int | None, most: int = fixed.MAX_BASELINE_DAYS) -> int:
    """Look-back of the baseline: ``days``, at most ``most``, and ``most`` where none is given."""
    return min(days, most) if days and days >= 1 else most


def _now(now: datetime | Column | None) -> Column:
    if isinstance(now, Column):
        return now
    return F.lit(now or datetime.now(timezone.utc)).cast("timestamp")


def scoped(events: DataFrame, service: str | None, tier: str | None) -> DataFrame:
    """Events of one service (or all) and one tier (``publish`` unless given, ``*`` for all)."""
    if service is not None:
        events = events.where(F.col("aem_service") == service)
    tier = tier or fixed.DEFAULT_TIER
    return events if tier == "*" else events.where(F.col("aem_tier") == tier)


def url_filter(urls: list[str] | None) -> Column | None:
    """Any of the addresses, ``*`` matching any text; None when none are given."""
    kept = [u.strip() for u in urls or [] if u.strip()]
    out = None
    for u in kept:
        test = F.col("url").ilike(_star_only(u))
        out = test if out is None else out | test
    return out


def _star_only(url: str) -> str:
    """Only ``*`` is a wildcard in addresses; ``?`` starts the query string."""
    return "".join("%" if c == "*" else "\\" + c if c in "%_\\" else c for c in url)


def incident_events(
    events: DataFrame,
    start: str,
    end: str,
    service: str | None = None,
    tier: str | None = None,
    urls: list[str] | None = None,
    now: datetime | Column | None = None,
) -> DataFrame:
    """Events of the window ``[start, end)``. All tests are plain comparisons that reach the file scan."""
    at = _now(now)
    rows = scoped(events, service, tier).where(
        (F.col("time_start") >= time_bound(start, at)) & (F.col("time_start") < time_bound(end, at))
    )
    wanted = url_filter(urls)
    return rows if wanted is None else rows.where(wanted)


def pop_baseline(
    events: DataFrame,
    start: str,
    service: str | None = None,
    tier: str | None = None,
    days: int | None = None,
    now: datetime | Column | None = None,
    most_days: int = fixed.MAX_BASELINE_DAYS,
) -> DataFrame:
    """Requests per POP over the days before the incident start, blank POPs left out; ``most_days`` bounds the look-back."""
    n = baseline_days(days, most_days)
    at = _now(now)
    upper = time_bound(start, at)
    lower = (at if is_relative(start) else upper) - F.expr(f"INTERVAL '{n}' DAY")
    rows = scoped(events, service, tier).where((F.col("time_start") >= lower) & (F.col("time_start") < upper))
    pop = F.trim("pop")
    return (
        rows.where(pop != "").groupBy(*SERVICE_KEYS, pop.alias("pop")).agg(F.count("*").alias("count"))
    )


def cap_events(events: DataFrame, max_events: int = 0, keys: list[str] | None = None) -> DataFrame:
    """The first ``max_events`` events of every service in time order (0 keeps all); events without a time come last.

    Counts per second find the second in which the cap is reached; earlier seconds are kept as they are. The rows of that one
    second, or all those without a time, are a table, and counted once more by instant and by range of ``ord``; only the
    rows of one such range are ranked.
    """
    keys = keys or SERVICE_KEYS
    if max_events <= 0:
        return events
    micros = F.coalesce(F.unix_micros(F.col("time_start").cast("timestamp")), F.lit(2**62))
    second = F.floor(micros / 1000000).cast("bigint")
    place = F.struct(micros.alias("at"), F.shiftright(F.coalesce(F.col("ord").cast("bigint"), F.lit(-(2**62))), ORD_RANGE_BITS).alias("range"))
    before, last = _split_at_cap(events.withColumn("_left", F.lit(max_events).cast("bigint")), keys, second)
    early, rest = _split_at_cap(stage(last, "cap-second"), keys, place)
    order = Window.partitionBy(*keys).orderBy("time_start", "ord")
    ranked = rest.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= F.col("_left"))
    return reduce(DataFrame.unionByName, [df.select(*events.columns) for df in (before, early, ranked)])


def _split_at_cap(rows: DataFrame, keys: list[str], slot: Column) -> tuple[DataFrame, DataFrame]:
    """Rows before the slot in which the ``_left`` rows of a service end, and the rows of that slot with what is left for them."""
    rows = rows.withColumn("_slot", slot)
    counts = rows.groupBy(*keys, "_left", "_slot").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    cut = (
        counts.withColumn("_before", F.coalesce(earlier, F.lit(0)))
        .where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("n") >= F.col("_left")))
        .select(*keys, F.col("_slot").alias("_cut"), (F.col("_left") - F.col("_before")).alias("_rest"))
    )
    marked = rows.join(stage(cut, "cap"), keys, "left")
    before = marked.where(F.col("_cut").isNull() | (F.col("_slot") < F.col("_cut")))
    last = marked.where(F.col("_slot") == F.col("_cut")).withColumn("_left", F.col("_rest"))
    return before.drop("_slot", "_cut", "_rest", "_left"), last.drop("_slot", "_cut", "_rest")


def truncation(events: DataFrame, max_events: int = 0, keys: list[str] | None = None) -> DataFrame:
    """Events per service and whether the cap was reached (also when there are exactly as many)."""
    hit = (F.count("*") >= max_events) if max_events > 0 else F.lit(False)
    return events.groupBy(*(keys or SERVICE_KEYS)).agg(F.count("*").alias("events"), hit.alias("truncated"))


def truncation_warning(max_events: int) -> str:
    return f"Result hit the {max_events}-event cap — analysis may be truncated. Narrow the window/URLs or raise the cap."
