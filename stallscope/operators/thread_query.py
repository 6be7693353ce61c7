"""Filter, de-duplicate, group-count and cut thread rows.

Predicates are plain ``Column`` builders over the fields below; a ``ThreadQuery`` holds filters and
commands. All filters run before all commands, wherever they were added, and every command keeps the
order in which its rows were first seen.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import frames as fr
from stallscope.functions.text import glob_match, like_pattern, number_text

ROW_FIELDS = [
    "thread", "state", "stackdepth", "keyframe", "class", "package", "method", "topframe", "elapsed", "nid", "url",
]


def field(name: str) -> Column:
    """A query field as a column of thread rows; an unknown field is missing on every row."""
    key = F.col("key_frame")
    known = {
        "thread": F.col("name"),
        "state": F.col("state"),
        "stackdepth": F.size("frames"),
        "keyframe": key,
        "class": fr.class_name(key),
        "package": fr.package_name(key),
        "method": fr.method_name(key),
        "topframe": F.col("top_frame"),
        "elapsed": F.col("elapsed"),
        "nid": F.col("nid"),
        "url": fr.request_url(F.col("name")),
    }
    return known.get(name.lower(), F.lit(None).cast("string"))


def _text(name: str) -> Column:
    col = number_text(field(name)) if name.lower() == "elapsed" else field(name).cast("string")
    return F.coalesce(col, F.lit(""))


def _number(name: str) -> Column:
    """The field as a number: missing or blank is 0, hex text counts, other text is not a number."""
    text = F.trim(_text(name))
    hex_digits = F.regexp_extract(text, "^0[xX]([0-9a-fA-F]+)$", 1)
    from_hex = F.conv(F.nullif(hex_digits, F.lit("")), 16, 10).try_cast("double")
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    return F.when(text == "", F.lit(0.0)).otherwise(F.coalesce(from_hex, plain))


def _is_glob(value: str) -> bool:
    return "*" in value or "?" in value


def _any_frame(glob: str) -> Column:
    pattern = like_pattern(glob)
    return F.exists(F.concat("frames", "monitor_lines"), lambda f: f.ilike(pattern))


def equals(name: str, value: str) -> Column:
    """Case-insensitive equality, or a glob; ``frame`` looks at every frame and monitor line."""
    if name.lower() == "frame":
        return _any_frame(value)
    if _is_glob(value):
        return glob_match(_text(name), value)
    return F.upper(_text(name)) == value.upper()


def differs(name: str, value: str | float) -> Column:
    """Inequality: numeric for numbers (text that is no number differs), else the reverse of ``equals``."""
    number = _as_number(value)
    if number is not None:
        return F.coalesce(_number(name) != number, F.lit(True))
    return ~equals(name, str(value))


def compares(name: str, op: str, value: str | float) -> Column:
    """Numeric ``>= <= > <``; a row whose text is no number never matches."""
    number = _as_number(value)
    if number is None:
        raise ValueError(f'Operator "{op}" requires a numeric value for field "{name}"')
    left = _number(name)
    tests = {">=": left >= number, "<=": left <= number, ">": left > number, "<": left < number}
    if op not in tests:
        raise ValueError(f"Unknown operator: {op}")
    return F.coalesce(tests[op], F.lit(False))


def one_of(name: str, values: Sequence[str]) -> Column:
    return F.upper(_text(name)).isin([v.strip().upper() for v in values])


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates)


def some_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates)


def _as_number(value: str | float) -> float | None:
    if isinstance(value, (int, float)):
        return float(value)
    text = value.strip()
    try:
        return float(int(text, 16)) if text.lower().startswith("0x") else float(text)
    except ValueError:
        return None


class ThreadQuery:
    """Filters plus a chain of commands. Each call returns a new query."""

    def __init__(self, filters: tuple[Column, ...] = (), commands: tuple[tuple, ...] = ()):
        self._filters = filters
        self._commands = commands

    def where(self, *predicates: Column) -> "ThreadQuery":
        return ThreadQuery(self._filters + predicates, self._commands)

    def stats_count(self, *by: str) -> "ThreadQuery":
        return ThreadQuery(self._filters, (*self._commands, ("stats", [f.lower() for f in by])))

    def top(self, n: int) -> "ThreadQuery":
        if n < 0:
            raise ValueError("top needs a count of rows")
        return ThreadQuery(self._filters, (*self._commands, ("top", n)))

    def dedup(self, *fields: str) -> "ThreadQuery":
        if not fields:
            raise ValueError("dedup needs at least one field")
        return ThreadQuery(self._filters, (*self._commands, ("dedup", [f.lower() for f in fields])))

    def matched(self, threads: DataFrame) -> DataFrame:
        return threads.where(all_of(*self._filters)) if self._filters else threads

    def total_matched(self, threads: DataFrame) -> DataFrame:
        """Rows the filters keep, before any command."""
        return self.matched(threads).agg(F.count("*").alias("total_matched"))

    def run(self, threads: DataFrame, order: Sequence[str] = ("dump_ord", "ord"), keep: Sequence[str] = ()) -> DataFrame:
        """Result rows with a ``_pos`` column that sorts them in result order.

        ``keep`` names thread columns (frames, monitor lines, source file) to carry until an
        aggregation drops them.
        """
        rows = self.matched(threads).select(
            *[field(f).alias(f) for f in ROW_FIELDS], *keep, F.struct(*order).alias("_pos")
        )
        for kind, arg in self._commands:
            if kind == "stats" and not arg:
                rows = rows.agg(F.count("*").alias("count")).withColumn("_pos", F.lit(0))
            elif kind == "stats":
                rows = _stats(rows, arg)
            elif kind == "top":
                rows = rows.orderBy("_pos").limit(arg)
            else:
                rows = _dedup(rows, arg)
        return rows


def _result_field(rows: DataFrame, name: str) -> Column:
    if name not in rows.columns:
        return F.lit(None).cast("string")
    return number_text(F.col(name)) if dict(rows.dtypes)[name] == "double" else F.col(name).cast("string")


def _stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Count per combination, a missing value counting as ''; most frequent first, then first seen."""
    keyed = rows.select("_pos", *[F.coalesce(_result_field(rows, f), F.lit("")).alias(f) for f in dict.fromkeys(by)])
    counted = keyed.groupBy(*dict.fromkeys(by)).agg(F.count("*").alias("count"), F.min("_pos").alias("_first"))
    return counted.withColumn("_pos", F.struct((-F.col("count")).alias("n"), F.col("_first"))).drop("_first")


def _dedup(rows: DataFrame, by: list[str]) -> DataFrame:
    """First row per combination of values; rows missing one of the fields are all kept.

    The rank filter lets each task drop repeats before the shuffle, so a hot value sends one row per
    task, and rows without a value do not meet in one partition at all.
    """
    known = [f for f in by if f in rows.columns]
    if len(known) < len(by):
        return rows
    has_all = all_of(*[F.col(f).isNotNull() for f in known])
    first = Window.partitionBy(*known).orderBy("_pos")
    kept = rows.where(has_all).withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return kept.unionByName(rows.where(~has_all))


def sort_result(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Order result rows by any column; numbers sort as numbers, text as text."""
    col = F.col(column)
    return rows.orderBy(col.desc_nulls_last() if descending else col.asc_nulls_last(), "_pos")


def with_share(rows: DataFrame, count: str = "count") -> DataFrame:
    """Bar length of each count against the largest, in percent."""
    peak = rows.agg(F.max(count)).scalar()
    return rows.withColumn("share", F.floor(100 * F.col(count) / peak + 0.5).cast("bigint"))
