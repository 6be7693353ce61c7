"""Per-dump signals from thread rows, for every dump at once.

Frames keyed by ``KEYS``: counts, stack fingerprints, their members, blocked monitors. Names of the
threads behind a fingerprint are not kept as one list, which would grow with the group; members stay
rows and only the first few names are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.firsts import first_rows
from stallscope.functions.frames import is_request, url_pattern
from stallscope.functions.text import any_of, contains_any, starts_with_any, strip
from stallscope.sources.dumps import GENERIC, J9, JSTACK, detect_format

KEYS = ["case_id", "dump_id", "dump_ord"]


def _named_like(name: Column, starts: list[str]) -> Column:
    return name.rlike("(?i)^" + any_of(starts))


def is_gc_thread() -> Column:
    name = F.col("name")
    return F.when(F.col("format") == J9, _named_like(name, fixed.GC_NAMES_J9)).otherwise(
        _named_like(name, fixed.GC_NAMES_JSTACK)
    )


def is_io_thread() -> Column:
    raw = F.col("raw_frames")
    return F.when(
        F.col("format") == J9, F.exists(raw, lambda f: contains_any(f, fixed.IO_PARTS_J9))
    ).otherwise(F.exists(raw, lambda f: starts_with_any(f, fixed.IO_STARTS_JSTACK)))


def _count_columns() -> list[Column]:
    states = [F.count_if(F.col("state") == s).alias(f"{s.lower()}_count") for s in fixed.THREAD_STATES]
    return [
        F.count("*").alias("total_thread_count"),
        *states,
        F.count_if(is_io_thread()).alias("io_thread_count"),
        F.count_if(is_gc_thread()).alias("gc_thread_count"),
        F.count_if(is_request(F.col("name"))).alias("active_request_thread_count"),
    ]


COUNTS = [
    "total_thread_count", *[f"{s.lower()}_count" for s in fixed.THREAD_STATES],
    "io_thread_count", "gc_thread_count", "active_request_thread_count",
]


def thread_counts(threads: DataFrame) -> DataFrame:
    """Thread, state, IO, GC and request counts of every dump that has threads."""
    return threads.groupBy(*KEYS).agg(*_count_columns())


def _generic_lines() -> Column:
    return F.transform(F.split("content", "\n", -1), strip)


def _generic_frames(lines: Column) -> Column:
    framed = F.filter(lines, lambda l: l.startswith("at ") | l.rlike(r"^\w[\w.$]+\([\w.$]+:\d+\)"))
    return F.transform(framed, lambda l: F.regexp_replace(l, r"^at\s+", ""))


def dump_facts(dumps: DataFrame) -> DataFrame:
    """Format of every dump, and of those in no known format best-effort counts and frames, from one pass over the text.

    Feeds several branches as a table: they then don't read the text again.
    """
    lines = F.col("_lines")
    headers = F.filter(lines, lambda l: l.rlike('^"[^"]+"') | l.rlike(r"(?i)Thread-\d+"))
    generic = F.col("format") == GENERIC
    base = (
        dumps.withColumn("format", detect_format(F.col("content")))
        .withColumn("_lines", F.when(generic, _generic_lines()).otherwise(F.array().cast("array<string>")))
        .withColumn("frames", _generic_frames(lines))
        .withColumn("total_thread_count", F.greatest(F.size(headers), F.lit(1)).cast("bigint"))
    )
    zero = F.lit(0).cast("bigint")
    return base.select(
        *KEYS,
        "format",
        "frames",
        "total_thread_count",
        F.col("total_thread_count").alias("runnable_count"),
        *[zero.alias(f"{s.lower()}_count") for s in fixed.THREAD_STATES[1:]],
        F.size(F.filter("frames", lambda f: starts_with_any(f, fixed.IO_STARTS_GENERIC)))
        .cast("bigint")
        .alias("io_thread_count"),
        F.size(F.filter(lines, lambda l: _named_like(l, fixed.GC_NAMES_GENERIC))).cast("bigint").alias("gc_thread_count"),
        F.size(F.filter(lines, is_request)).cast("bigint").alias("active_request_thread_count"),
    )


def _facts(dumps: DataFrame) -> DataFrame:
    return dump_facts(dumps) if "content" in dumps.columns else dumps


def generic_dumps(dumps: DataFrame) -> DataFrame:
    """Counts and frames of the dumps in no known format; takes dumps or their ``dump_facts``."""
    return _facts(dumps).where(F.col("format") == GENERIC)


def dump_signals(dumps: DataFrame, threads: DataFrame) -> DataFrame:
    """One row per dump (given as dumps or their ``dump_facts``); dumps without a single thread keep zeros."""
    facts = _facts(dumps)
    listed = facts.where(F.col("format") != GENERIC).select(*KEYS, "format")
    zeros = {c: 0 for c in COUNTS}
    parsed = listed.join(thread_counts(threads), KEYS, "left").fillna(zeros)
    return parsed.unionByName(generic_dumps(facts).drop("frames"))


# Stack fingerprints -------------------------------------------------------------------------------


def signature() -> Column:
    return F.array_join(F.slice("raw_frames", 1, fixed.SIGNATURE_FRAMES), "|")


def fingerprint_members(threads: DataFrame) -> DataFrame:
    """One row per thread with frames: the fingerprint it belongs to and its place and name."""
    return threads.where(F.size("raw_frames") > 0).select(*KEYS, signature().alias("signature"), "ord", "name")


def fingerprints(threads: DataFrame, dumps: DataFrame | None = None) -> DataFrame:
    """Threads of a dump grouped by their top frames, described by the first thread of the group.

    With ``dumps`` given, the single fingerprint of each generic dump is added.
    """
    sized = threads.where(F.size("raw_frames") > 0).withColumn("signature", signature())
    first = first_rows(sized.select(*KEYS, "signature", "ord", "state", "raw_frames", "raw_key_frame", "format"), [*KEYS, "signature"], F.col("ord"), F.count("*").alias("count"))
    grouped = first.select(
        *KEYS,
        "signature",
        "count",
        F.col("ord").alias("first_ord"),
        "state",
        F.get("raw_frames", F.lit(0)).alias("top_frame"),
        F.col("raw_key_frame").alias("key_frame"),
        F.slice("raw_frames", 1, fixed.STORED_FRAMES).alias("frames"),
        F.when(F.col("format") == JSTACK, F.nullif(url_pattern(F.col("raw_frames")), F.lit(""))).alias("url_pattern"),
    )
    if dumps is None:
        return grouped
    text_only = generic_dumps(dumps).where(F.size("frames") > 0)
    head = F.get("frames", F.lit(0))
    return grouped.unionByName(
        text_only.select(
            *KEYS,
            F.array_join(F.slice("frames", 1, fixed.SIGNATURE_FRAMES), "|").alias("signature"),
            F.col("total_thread_count").alias("count"),
            F.lit(0).cast("bigint").alias("first_ord"),
            F.lit("RUNNABLE").alias("state"),
            head.alias("top_frame"),
            head.alias("key_frame"),
            F.slice("frames", 1, fixed.STORED_FRAMES).alias("frames"),
            F.lit(None).cast("string").alias("url_pattern"),
        )
    )


def first_names(rows: DataFrame, by: list[str], n: int, order: list[str], name: str = "name") -> DataFrame:
    """The first ``n`` names of every group as one short list, in order.

    The rank limit is applied on both sides of the shuffle, so a huge group sends ``n`` rows per task.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    kept = rows.select(*by, *order, name).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    listed = kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rn", name))).alias("_l"))
    return listed.select(*by, F.transform("_l", lambda x: x[name]).alias("names"))


# Blocked monitors ---------------------------------------------------------------------------------


def monitor_waiters(threads: DataFrame) -> DataFrame:
    return threads.where(F.col("waiting_on").isNotNull()).select(
        *KEYS, F.col("waiting_on").alias("monitor_address"), "ord", "name",
        F.coalesce("waiting_class", F.lit("unknown")).alias("monitor_class"),
    )


def lock_holders(threads: DataFrame) -> DataFrame:
    """First thread of a dump that holds each address."""
    held = threads.select(*KEYS, "ord", F.explode(F.array_distinct("locked_monitors")).alias("monitor_address"))
    first = held.groupBy(*KEYS, "monitor_address").agg(F.min("ord").alias("ord")).alias("h")
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*KEYS, "ord")]
    return first.join(threads.select(*KEYS, "ord", "name", "frames").alias("t"), same).select(
        *[f"h.{c}" for c in KEYS], "monitor_address", F.col("name").alias("lock_holder_thread"), F.col("frames").alias("lock_holder_stack")
    )


def blocked_monitors(threads: DataFrame) -> DataFrame:
    """Monitors with waiters: how many, the class the first waiter names, the holder, the first waiters."""
    by = [*KEYS, "monitor_address"]
    waiters = monitor_waiters(threads)
    counted = first_rows(waiters.drop("name"), by, F.col("ord"), F.count("*").alias("waiting_thread_count"))
    counted = counted.select(*by, "waiting_thread_count", "monitor_class", F.col("ord").alias("first_ord"))
    names = first_names(waiters, by, fixed.STORED_WAITERS, ["ord"]).withColumnRenamed("names", "waiting_thread_names")
    return counted.join(names, by).join(lock_holders(threads), by, "left")
