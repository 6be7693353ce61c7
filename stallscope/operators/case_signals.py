"""Case signals: the dumps of every case reduced to one row, plus the ranked lists behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.firsts import first_rows, packed, unpacked
from stallscope.functions.text import contains_any, starts_with_any
from stallscope.operators.dump_signals import KEYS, first_names

NUMBER_SIGNALS = [
    "totalThreadCount", "avgThreadCount", "blockedThreadCount", "waitingThreadCount", "timedWaitingThreadCount",
    "suspiciousTimedWaitingCount", "ioThreadCount", "gcThreadCount", "dominantFingerprintCount",
    "dominantFingerprintRatio", "persistentBlockedMonitors", "maxBlockedOnSingleMonitor", "blockedMonitorCount",
    "threadCountAnomaly", "ioSaturationDetected", "synchronizedBlockedMonitorCount", "dominantActiveFingerprintCount",
    "dominantActiveFingerprintRatio", "activeRequestThreadCount",
]
TEXT_SIGNALS = ["suspiciousTimedWaitingKeyFrame", "topBlockedMonitorClass"]


def seen_first() -> Column:
    """Place of a fingerprint in reading order: dumps in order, larger groups first, then first thread."""
    return F.struct("dump_ord", (-F.col("count")).alias("neg_count"), "first_ord")


def count_signals(dump_signals: DataFrame) -> DataFrame:
    """Largest counts over the dumps of a case, the mean, and the IO share test."""
    io_ratio = F.col("io_thread_count") / F.nullif(F.col("total_thread_count"), F.lit(0))
    peak = lambda c: F.max(c)
    return dump_signals.groupBy("case_id").agg(
        peak("total_thread_count").alias("totalThreadCount"),
        F.avg("total_thread_count").alias("avgThreadCount"),
        peak("blocked_count").alias("blockedThreadCount"),
        peak("waiting_count").alias("waitingThreadCount"),
        peak("timed_waiting_count").alias("timedWaitingThreadCount"),
        peak("io_thread_count").alias("ioThreadCount"),
        peak("gc_thread_count").alias("gcThreadCount"),
        peak("active_request_thread_count").alias("activeRequestThreadCount"),
        # a dump without threads leaves the mean undefined, and the test negative
        F.when((F.avg(io_ratio) > fixed.IO_RATIO_THRESHOLD) & (F.min("total_thread_count") > 0), 1)
        .otherwise(0)
        .alias("ioSaturationDetected"),
        F.when(F.max("total_thread_count") > fixed.THREAD_COUNT_THRESHOLD, 1).otherwise(0).alias("threadCountAnomaly"),
    )


def largest_fingerprints(fps: DataFrame) -> DataFrame:
    """Every stack of a case once: its largest instance (later dump on a tie) and in how many dumps it is."""
    by = ["case_id", "signature"]
    slim = fps.select(*by, "dump_id", "dump_ord", "count", "state", "top_frame", "key_frame", "frames", "first_ord")
    largest = first_rows(slim, by, packed(-F.col("count"), -F.col("dump_ord")), F.count("*").alias("dumps"), tie="dump_id").alias("l")
    seen = first_rows(fps.select(*by, "dump_ord", "count", "first_ord"), by, packed(F.col("dump_ord"), -F.col("count")), tie="first_ord")
    seen = seen.select(*by, seen_first().alias("seen_first")).alias("s")
    both = largest.join(seen, [F.col(f"l.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by])
    return both.select(*[f"l.{c}" for c in by], "dumps", "seen_first", *slim.columns[2:])


def _seen_first() -> Column:
    seen = unpacked(F.col("seen"))
    return F.struct(seen["first"].alias("dump_ord"), seen["second"].alias("first_ord")).alias("seen_first")


def dominant_fingerprints(largest: DataFrame) -> DataFrame:
    """Stacks seen in several dumps, or in one with many threads; the ten largest of each case."""
    w = Window.partitionBy("case_id").orderBy(F.desc("count"), "seen_first")
    return (
        largest.where((F.col("dumps") > 1) | (F.col("count") > fixed.SINGLE_DUMP_DOMINANT_COUNT))
        .withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= fixed.DOMINANT_FINGERPRINTS)
    )


def stuck_stacks(dominant: DataFrame, n: int = 8) -> DataFrame:
    """Dominant stacks that wait or block in application code; the first eight of each case."""
    frame = F.when(F.col("key_frame") != "", F.col("key_frame")).otherwise(F.col("top_frame"))
    w = Window.partitionBy("case_id").orderBy("rank")
    return (
        dominant.withColumn("display_frame", frame)
        .where(F.col("state").isin("BLOCKED", "WAITING", "TIMED_WAITING"))
        .where(~starts_with_any(F.col("display_frame"), fixed.JVM_PREFIXES_DISPLAY))
        .withColumn("place", F.row_number().over(w))
        .where(F.col("place") <= n)
    )


def with_thread_names(stuck: DataFrame, members: DataFrame, n: int = fixed.STUCK_STACK_NAMES) -> DataFrame:
    """Stuck stacks with the names of the first ``n`` threads in them, in the dump they were taken from."""
    by = ["case_id", "dump_id", "signature"]
    rows = members.join(stuck.select(*by), by, "left_semi")
    named = first_names(rows, by, n, ["ord"]).withColumnRenamed("names", "thread_names")
    return stuck.join(named, by, "left")


def case_monitors(monitors: DataFrame) -> DataFrame:
    """Every monitor address of a case once, at the first dump where it has most waiters."""
    slim = monitors.select("case_id", "monitor_address", "dump_id", "dump_ord", "waiting_thread_count", "monitor_class", "lock_holder_thread", "waiting_thread_names", "first_ord")
    seen = [F.count("*").alias("dumps"), F.min(packed(F.col("dump_ord"), F.col("first_ord"))).alias("seen")]
    most = first_rows(slim, ["case_id", "monitor_address"], packed(-F.col("waiting_thread_count"), F.col("dump_ord")), *seen, tie="dump_id")
    return most.select(
        "case_id", "monitor_address", "dumps", _seen_first(), "dump_id", "waiting_thread_count", "monitor_class", "lock_holder_thread", "waiting_thread_names"
    )


def top_monitors(by_address: DataFrame, n: int = 5) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy(F.desc("waiting_thread_count"), "seen_first")
    return by_address.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def persistent_monitors(by_address: DataFrame) -> DataFrame:
    """Addresses with waiters in more than one dump of a case."""
    return by_address.where(F.col("dumps") > 1).select("case_id", "monitor_address", "dumps")


def monitor_signals(by_address: DataFrame, monitors: DataFrame) -> DataFrame:
    earliest = F.struct(
        F.col("waiting_thread_count"), -F.col("seen_first.dump_ord"), -F.col("seen_first.first_ord")
    )
    per_case = by_address.groupBy("case_id").agg(
        F.count_if(F.col("dumps") > 1).alias("persistentBlockedMonitors"),
        F.max("waiting_thread_count").alias("maxBlockedOnSingleMonitor"),
        F.max_by("monitor_class", earliest).alias("topBlockedMonitorClass"),
    )
    widest = (
        monitors.groupBy(*KEYS).agg(F.count("*").alias("n")).groupBy("case_id").agg(F.max("n").alias("blockedMonitorCount"))
    )
    return per_case.join(widest, "case_id")


def suspicious_waits(fps: DataFrame) -> DataFrame:
    """Largest timed-waiting stack of a case that is no idle pool worker; first one on a tie."""
    text = F.concat_ws("\n", F.array("key_frame"), F.col("frames"))
    stuck = fps.where((F.col("state") == "TIMED_WAITING") & ~contains_any(text, fixed.IDLE_FRAME_PARTS))
    first = F.struct("count", -F.col("dump_ord"), -F.col("first_ord"))
    return stuck.groupBy("case_id").agg(
        F.max("count").alias("suspiciousTimedWaitingCount"),
        F.max_by("key_frame", first).alias("suspiciousTimedWaitingKeyFrame"),
    )


def synchronized_monitors(monitors: DataFrame, members: DataFrame, fps: DataFrame) -> DataFrame:
    """Most monitors in one dump with a listed waiter inside a BLOCKED stack."""
    waiters = monitors.select(*KEYS, "monitor_address", F.explode("waiting_thread_names").alias("name"))
    blocked = fps.where(F.col("state") == "BLOCKED").select(*KEYS, "signature")
    # few waiter names are listed per monitor, so they bound the member rows that need a stack state
    listed = members.join(waiters.select(*KEYS, "name").distinct(), [*KEYS, "name"], "left_semi")
    names = listed.join(blocked, [*KEYS, "signature"], "left_semi").select(*KEYS, "name")
    hit = waiters.join(names, [*KEYS, "name"], "left_semi").select(*KEYS, "monitor_address").distinct()
    per_dump = hit.groupBy(*KEYS).agg(F.count("*").alias("n"))
    return per_dump.groupBy("case_id").agg(F.max("n").alias("synchronizedBlockedMonitorCount"))


def fingerprint_signals(largest: DataFrame, dominant: DataFrame) -> DataFrame:
    active = largest.groupBy("case_id").agg(
        F.max(F.when(F.col("state") == "RUNNABLE", F.col("count"))).alias("dominantActiveFingerprintCount")
    )
    top = dominant.groupBy("case_id").agg(F.max("count").alias("dominantFingerprintCount"))
    return active.join(top, "case_id", "left")


def case_signals(
    dump_signals: DataFrame,
    fps: DataFrame,
    members: DataFrame,
    monitors: DataFrame,
    cases: DataFrame | None = None,
) -> DataFrame:
    """One row of signals per case, under the names signature conditions use.

    ``cases`` adds cases without a dump, as zeros.
    """
    largest = largest_fingerprints(fps)
    by_address = case_monitors(monitors)
    counts = count_signals(dump_signals)
    base = cases.select("case_id").join(counts, "case_id", "left") if cases is not None else counts
    joined = (
        base.join(fingerprint_signals(largest, dominant_fingerprints(largest)), "case_id", "left")
        .join(monitor_signals(by_address, monitors), "case_id", "left")
        .join(suspicious_waits(fps), "case_id", "left")
        .join(synchronized_monitors(monitors, members, fps), "case_id", "left")
    )
    total = F.nullif(F.col("totalThreadCount"), F.lit(0))
    filled = joined.withColumn("dominantFingerprintRatio", F.col("dominantFingerprintCount") / total).withColumn(
        "dominantActiveFingerprintRatio", F.col("dominantActiveFingerprintCount") / total
    )
    filled = filled.fillna({c: 0 for c in NUMBER_SIGNALS}).fillna({c: "" for c in TEXT_SIGNALS})
    return filled.select("case_id", *NUMBER_SIGNALS, *TEXT_SIGNALS)


def input_counts(evidence: DataFrame, parse_errors: DataFrame | None = None) -> DataFrame:
    """Dumps, logs, top outputs and unreadable files per case."""
    counts = evidence.groupBy("case_id").agg(
        F.count_if(F.col("type") == "thread-dump").alias("thread_dumps"),
        F.count_if(F.col("type") == "log-export").alias("logs"),
        F.count_if(F.col("type") == "top-output").alias("top_outputs"),
    )
    if parse_errors is None:
        return counts.withColumn("parse_errors", F.lit(0).cast("bigint"))
    errors = parse_errors.groupBy("case_id").agg(F.count("*").alias("parse_errors"))
    return counts.join(errors, "case_id", "left").fillna({"parse_errors": 0})
