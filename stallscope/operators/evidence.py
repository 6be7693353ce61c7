"""Row-wise routing of evidence: what kind of file it is and when it was captured."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.text import contains_any


def _ends_with_any(col: Column, endings: list[str]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | col.endswith(e)
    return out


def evidence_type(name: Column, content: Column) -> Column:
    """Type by file name first, then by content."""
    low, text = F.lower(name), F.coalesce(content, F.lit(""))
    dump_name = contains_any(low, fixed.DUMP_NAME_PARTS) | _ends_with_any(low, fixed.DUMP_NAME_ENDINGS)
    dump_text = (
        text.contains("java.lang.Thread.State:")
        | text.contains("3XMTHREADINFO")
        | text.rlike(r'^"[^"]+" #\d+')
        | (text.contains("nid=0x") & text.contains("tid=0x"))
    )
    top = low.contains("top") & (text.contains("load average") | text.contains("PID"))
    return (
        F.when(low.endswith(".har"), "generic")
        .when(_ends_with_any(low, fixed.IMAGE_ENDINGS), "screenshot")
        .when(dump_name | dump_text, "thread-dump")
        .when(top, "top-output")
        .otherwise("log-export")
    )


def discovered_type(name: Column) -> Column:
    """Type of a file found in a case folder, by its ending alone."""
    ext = F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))
    return (
        F.when(ext == ".tdump", "thread-dump")
        .when(ext == ".log", "log-export")
        .when(ext.isin(fixed.DISCOVERED_IMAGE_ENDINGS), "screenshot")
        .otherwise("generic")
    )


def capture_time(content: Column, now: Column | None = None) -> Column:
    """Time a dump says it was taken: a line that starts with one, else the J9 date line, else ``now``."""
    now = now if now is not None else F.lit(datetime.now(timezone.utc)).cast("timestamp")
    text = F.coalesce(content, F.lit(""))
    line = F.regexp_extract(text, r"(?m)^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    j9 = r"1TIDATETIME\s+Date:\s+(\d{4}/\d{2}/\d{2}) at (\d{2}:\d{2}:\d{2})"
    day, clock = F.replace(F.regexp_extract(text, j9, 1), F.lit("/"), F.lit("-")), F.regexp_extract(text, j9, 2)
    return F.coalesce(
        F.nullif(line, F.lit("")).try_cast("timestamp"),
        F.when(day != "", F.concat(day, F.lit(" "), clock)).try_cast("timestamp"),
        now,
    )


def route(evidence: DataFrame, now: Column | None = None) -> DataFrame:
    """Evidence rows with ``type`` and ``captured_at``: a thread dump says when it was taken, the rest counts as taken now."""
    now = now if now is not None else F.lit(datetime.now(timezone.utc)).cast("timestamp")
    typed = evidence.withColumn("type", evidence_type(F.col("name"), F.col("content")))
    return typed.withColumn("captured_at", F.when(F.col("type") == "thread-dump", capture_time(F.col("content"), now)).otherwise(now))
