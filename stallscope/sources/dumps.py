"""Thread-dump files and their threads.

A dump is one row ``(dump_id, dump_ord, content, ...)``; any further columns (``case_id``,
``source_file``) ride along to the thread rows. Both known formats are parsed in the same pass over
the text, so the text is read once whatever the mix of formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.frames import first_frame, key_frame
from stallscope.functions.text import contains_any, strip

JSTACK, J9, GENERIC = "jstack", "ibm-j9", "generic"

QUOTED_NAME = r'^"([^"]+)"'
J9_HEADER = r'3XMTHREADINFO[^\S\n]+"([^"\n]+)"'
LOCK_WAIT = r"- waiting to lock <(0x[0-9a-f]+)>(?:\s+\(a ([^)]+)\))?"
PARK_WAIT = r"- parking to wait for\s+<(0x[0-9a-f]+)>(?:\s+\(a ([^)]+)\))?"
LOCKED = r"- locked <(0x[0-9a-f]+)>"
STATE_LINE = r"java\.lang\.Thread\.State:\s+(\w+)"

THREAD_COLUMNS = [
    "format", "ord", "name", "state", "frames", "raw_frames", "monitor_lines", "top_frame", "key_frame",
    "raw_key_frame", "waiting_on", "waiting_class", "locked_monitors", "nid", "elapsed",
]


def read_dump_files(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """One row per dump file, content whole; ``dump_id`` is the file's address.

    ``dump_ord`` is left to the caller (capture time, list order); see ``with_dump_order``.
    """
    reader = spark.read
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_path").alias("dump_id"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("value").alias("content"),
    )


def detect_format(content: Column) -> Column:
    """J9 markers win, then jstack header or state line, else generic."""
    jstack = content.rlike(r'^"[^"]+"\s+#\d+') | content.contains("java.lang.Thread.State:")
    return F.when(contains_any(content, fixed.J9_MARKERS), J9).when(jstack, JSTACK).otherwise(GENERIC)


#: A text that is in every line a pattern matches; it is looked for first, since most lines match none.
HELD = {LOCK_WAIT: "- waiting to lock <", PARK_WAIT: "- parking to wait for", LOCKED: "- locked <", STATE_LINE: "java.lang.Thread.State:"}


def _fits(line: Column, pattern: str) -> Column:
    return line.contains(HELD[pattern]) & line.rlike(pattern) if pattern in HELD else line.rlike(pattern)


def _line_values(lines: Column, pattern: str, group: int = 1) -> Column:
    """First match per line, over the lines that match."""
    hits = F.filter(lines, lambda l: _fits(l, pattern))
    return F.transform(hits, lambda l: F.regexp_extract(l, pattern, group))


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _position(lines: Column, pattern: str) -> Column:
    """1-based position of the first matching line, 0 when none."""
    return F.array_position(F.transform(lines, lambda l: _fits(l, pattern)), True)


def _jstack_state(lines: Column) -> Column:
    seen = F.upper(_last(_line_values(lines, STATE_LINE)))
    return F.when(seen.isin(fixed.THREAD_STATES), seen).otherwise("RUNNABLE")


def _j9_state(header: Column, lines: Column) -> Column:
    on_header = F.regexp_extract(header, r"state:(\w)", 1)
    later = _last(_line_values(lines, r"3XMTHREADINFO3.*state:(\w)"))
    letter = F.coalesce(later, on_header)
    state = F.lit("RUNNABLE")
    for code, name in fixed.J9_STATES.items():
        state = F.when(letter == code, name).otherwise(state)
    return state


def _waiting_class(lines: Column) -> Column:
    """Class of the last lock line that names one, else of a park line that came before any lock line."""
    lock_classes = F.filter(_line_values(lines, LOCK_WAIT, 2), lambda c: c != "")
    lock_at, park_at = _position(lines, LOCK_WAIT), _position(lines, PARK_WAIT)
    park_first = (park_at > 0) & ((lock_at == 0) | (park_at < lock_at))
    park_class = F.nullif(F.get(_line_values(lines, PARK_WAIT, 2), F.lit(0)), F.lit(""))
    return F.coalesce(_last(lock_classes), F.when(park_first, park_class))


def parse_threads(dumps: DataFrame) -> DataFrame:
    """Thread rows of every jstack and J9 dump; generic dumps have none.

    ``ord`` is the place of the thread in its dump.
    """
    carried = [c for c in dumps.columns if c not in ("content", *THREAD_COLUMNS)]
    fmt = F.col("format")
    blocks = (
        F.when(fmt == JSTACK, F.split("content", r'\n(?=")', -1))
        .when(fmt == J9, F.split("content", r"(?m)^(?=" + J9_HEADER.replace("(", "(?:", 1) + ")", -1))
        .otherwise(F.array().cast("array<string>"))
    )
    exploded = (
        dumps.withColumn("format", detect_format(F.col("content")))
        .select(*carried, "format", F.posexplode(blocks).alias("ord", "block"))
        .withColumn("ord", F.col("ord").cast("bigint"))
        # a one-row explode: the filter below would otherwise be pushed below the lines, and repeat them
        .withColumn("_lines", F.explode(F.array(F.filter(F.transform(F.split("block", "\n", -1), strip), lambda l: l != ""))))
        .withColumn("_header", F.coalesce(F.get("_lines", F.lit(0)), F.lit("")))
        .withColumn(
            "name",
            F.when(fmt == JSTACK, F.regexp_extract("_header", QUOTED_NAME, 1)).otherwise(
                F.regexp_extract("_header", "^" + J9_HEADER, 1)
            ),
        )
        .where((F.col("name") != "") & ((fmt == J9) | (F.size("_lines") >= 2)))
    )
    lines, header = F.col("_lines"), F.col("_header")
    is_jstack = fmt == JSTACK
    no_text = F.array().cast("array<string>")
    at_lines = F.transform(
        F.filter(lines, lambda l: l.startswith("at ")), lambda l: F.regexp_replace(l, r"^at\s+", "")
    )
    j9_frames = F.transform(_line_values(lines, r"4XESTACKTRACE\s+at\s+(.+)"), strip)
    locks = _line_values(lines, LOCK_WAIT)
    parks = _line_values(lines, PARK_WAIT)
    nid = F.regexp_extract(header, r"(?i)\bnid=(0x[0-9a-f]+|\d+)", 1)
    elapsed = F.regexp_extract(header, r"\belapsed=(\d+(?:\.\d+)?)", 1)
    with_frames = exploded.withColumn("raw_frames", F.when(is_jstack, at_lines).otherwise(j9_frames))
    raw = F.col("raw_frames")
    dots = lambda c: F.replace(c, F.lit("/"), F.lit("."))
    return with_frames.withColumn(
        "raw_key_frame",
        F.when(is_jstack, key_frame(raw, fixed.JVM_PREFIXES_JSTACK)).otherwise(key_frame(raw, fixed.JVM_PREFIXES_J9)),
    ).select(
        *carried,
        "format",
        "ord",
        "name",
        F.when(is_jstack, _jstack_state(lines)).otherwise(_j9_state(header, lines)).alias("state"),
        F.when(is_jstack, raw).otherwise(F.transform(raw, dots)).alias("frames"),
        "raw_frames",
        F.when(is_jstack, F.filter(lines, lambda l: l.startswith("- "))).otherwise(no_text).alias("monitor_lines"),
        F.when(is_jstack, first_frame(raw)).otherwise(dots(first_frame(raw))).alias("top_frame"),
        F.when(is_jstack, F.col("raw_key_frame")).otherwise(dots(F.col("raw_key_frame"))).alias("key_frame"),
        "raw_key_frame",
        F.when(is_jstack, F.coalesce(_last(locks), F.get(parks, F.lit(0)))).alias("waiting_on"),
        F.when(is_jstack, _waiting_class(lines)).alias("waiting_class"),
        F.when(is_jstack, _line_values(lines, LOCKED)).otherwise(no_text).alias("locked_monitors"),
        F.when(is_jstack, F.nullif(nid, F.lit(""))).alias("nid"),
        F.when(is_jstack, F.nullif(elapsed, F.lit("")).cast("double")).alias("elapsed"),
    )


def file_counts(dumps: DataFrame, threads: DataFrame, key: str = "source_file") -> DataFrame:
    """Thread count per file, files without threads kept; a file without any is reported as unreadable."""
    counts = threads.groupBy(key).agg(F.count("*").alias("n"))
    listed = dumps.select(key).distinct()
    return listed.join(counts, key, "left").select(
        key,
        F.coalesce("n", F.lit(0)).alias("thread_count"),
        F.when(F.col("n").isNull(), F.lit("no threads found")).alias("parse_error"),
    )
