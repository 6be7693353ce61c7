"""Raw text to typed values, with the reading rules of the log export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallscope.functions.text import strip

LEADING_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def to_number(v: Column) -> Column:
    """The number the text starts with; blank or bad text is 0."""
    digits = F.regexp_extract(strip(v), LEADING_NUMBER, 0)
    return F.coalesce(F.nullif(digits, F.lit("")).try_cast("double"), F.lit(0.0))


def to_bool(v: Column) -> Column:
    return F.coalesce(F.lower(strip(v)).isin("true", "1", "yes"), F.lit(False))


def to_time(v: Column) -> Column:
    """Epoch seconds (up to 10 digits), epoch milliseconds (more), or ISO text with Z, GMT or an offset."""
    s = strip(v)
    digits = s.try_cast("bigint")
    epoch = F.when(F.length(s) > 10, F.timestamp_millis(digits)).otherwise(F.timestamp_seconds(digits))
    # blank text is taken out first: a failing cast costs an exception per row
    iso = F.regexp_replace(F.nullif(s, F.lit("")), "GMT$", "Z")
    return F.when(s.rlike(r"^\d+$"), epoch).otherwise(iso.try_cast("timestamp"))
