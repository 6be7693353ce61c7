"""SQL text of number wording, for messages built as SQL expressions."""

from __future__ import annotations


def quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def integer(x: str) -> str:
    """Nearest integer as text, halves upward."""
    return f"cast(cast(floor(({x}) + 0.5D) AS bigint) AS string)"


def decimals(x: str, n: int) -> str:
    """Fixed decimals of the exact binary value.

    ``x * 10^n`` may round onto a half that the exact product misses; the error of the product, exact when
    ``x`` is split in two short halves, tells the side.
    """
    scale = f"{10 ** n}.0D"
    v = f"cast(({x}) AS double)"
    y = f"({v} * {scale})"
    high = f"cast(cast({v} AS float) AS double)"
    error = f"(({high} * {scale} - {y}) + ({v} - {high}) * {scale})"
    part = f"({y} - floor({y}))"
    up = f"CASE WHEN {part} > 0.5D OR ({part} = 0.5D AND {error} >= 0) THEN 1 ELSE 0 END"
    return f"format_string('%.{n}f', cast(floor({y}) + {up} AS double) / {scale})"


def short_decimals(x: str, n: int) -> str:
    """Fixed decimals without trailing zeros."""
    return f"regexp_replace({decimals(x, n)}, '\\\\.?0+$', '')"


def percent(x: str) -> str:
    """A 0..1 share as percent; two decimals where rounding would claim 0% or 100% falsely."""
    p = f"(({x}) * 100)"
    r = f"cast(floor({p} + 0.5D) AS bigint)"
    edge = f"(({r} = 100 AND {p} < 100) OR ({r} = 0 AND {p} > 0))"
    return f"CASE WHEN {edge} THEN concat({decimals(p, 2)}, '%') ELSE concat({r}, '%') END"


def duration(x: str) -> str:
    """Seconds as s / m / h / d text."""
    s = f"cast(({x}) AS double)"
    hours = f"CASE WHEN {s} % 3600 = 0 THEN {decimals(s + ' / 3600', 0)} ELSE {decimals(s + ' / 3600', 1)} END"
    return (
        f"CASE WHEN {s} <= 0 THEN '0s' WHEN {s} < 90 THEN concat({integer(s)}, 's') "
        f"WHEN {s} < 5400 THEN concat({integer(s + ' / 60')}, 'm') WHEN {s} < 172800 THEN concat({hours}, 'h') "
        f"ELSE concat({integer(s + ' / 86400')}, 'd') END"
    )
