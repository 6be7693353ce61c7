"""Text expressions: number and duration wording, globs, literal regex alternatives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b\u00a0\ufeff"


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(col, F.lit(WHITESPACE))


def ends_with_any(col: Column, parts: str | list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col.endswith(p)
    return out


def strip_long(col: Column) -> Column:
    """``strip`` of a column of long texts: a trim notes the place of every character, so only text with white space at an end is trimmed."""
    return F.when(starts_with_any(col, list(WHITESPACE)) | ends_with_any(col, WHITESPACE), strip(col)).otherwise(col)


def number_text(x: Column) -> Column:
    """A number as text, whole values without a fraction."""
    x = x.cast("double")
    whole = (x == F.floor(x)) & (F.abs(x) < F.lit(1e15))
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def like_pattern(glob: str) -> str:
    """A ``*`` / ``?`` glob as an SQL LIKE pattern."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append("%")
        elif ch == "?":
            out.append("_")
        elif ch in "%_\\":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


def glob_match(col: Column, glob: str) -> Column:
    """Anchored, case-insensitive glob match."""
    return col.ilike(like_pattern(glob))


def any_of(words: list[str]) -> str:
    """A regex alternative over literal words."""
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col.startswith(p)
    return out


def contains_any(col: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col.contains(p)
    return out


def provider_in_name(name: Column, provider: Column) -> Column:
    """The provider keyword occurs in the network name as a whole word, in any case."""
    quoted = F.concat(F.lit(r"(?i)\b\Q"), provider, F.lit(r"\E\b"))
    return F.coalesce((name != "") & (provider != "") & F.regexp_like(name, quoted), F.lit(False))


def _sums_before(numbers: Column) -> Column:
    """Sum of the numbers before each; its cost is quadratic in their count."""
    state = lambda out, total: F.struct(out.alias("out"), total.alias("total"))
    none = state(F.array().cast("array<bigint>"), F.lit(0).cast("bigint"))
    return F.aggregate(numbers, none, lambda s, n: state(F.concat(s["out"], F.array(s["total"])), s["total"] + n))["out"]


def with_sums_before(rows: DataFrame, numbers: str, name: str, chunk: int = 256, levels: int = 2) -> DataFrame:
    """``rows`` with an array of the sums before each element of an array column, inside the row.

    The array is cut into chunks, and the sums of chunks are treated alike, ``levels`` times; so the cost is linear up to
    ``chunk`` ^ (``levels`` + 1) elements.
    """
    cut, whole, start = (f"{name}__{part}{levels}" for part in ("cut", "whole", "start"))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.size(numbers) / chunk).cast("int") - 1), lambda i: F.slice(numbers, i * chunk + 1, F.lit(chunk)))
    pieces = F.when(F.size(numbers) > 0, pieces).otherwise(F.array().cast("array<array<bigint>>"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, n: a + n)
    # one-row explodes, so that every step is computed once
    df = rows.withColumn(cut, F.explode(F.array(pieces))).withColumn(whole, F.explode(F.array(F.transform(cut, add))))
    df = with_sums_before(df, whole, start, chunk, levels - 1) if levels > 1 else df.withColumn(start, F.explode(F.array(_sums_before(F.col(whole)))))
    sums = F.flatten(F.zip_with(cut, start, lambda c, s: F.transform(_sums_before(c), lambda x: x + s)))
    return df.withColumn(name, F.explode(F.array(sums))).drop(cut, whole, start)
