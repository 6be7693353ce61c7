"""The first row of every group: ranks packed into one number, so that groups are hash aggregates, then a lookup of the rows.

A ``min_by`` or ``max_by`` over structs sorts all rows and carries whole rows through it. Here only numbers are aggregated;
wide columns are read for the chosen rows alone, and cross a shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP, HALF = 2 * 10**19, 2**63  # STEP is above every long that was made positive


def _number(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)" if n == STEP else "decimal(19,0)")


def _whole(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def packed(first: Column, second: Column) -> Column:
    """Two longs as one number that orders like both; null if one of them is. The first is less than 4.9 x 10^18 in size, else the job fails."""
    return (_whole(first) * F.lit(str(STEP)).cast("decimal(20,0)") + (_whole(second) + _number(HALF))).cast("decimal(38,0)")


def unpacked(both: Column) -> Column:
    """The two longs (as fields of a struct: first, second)."""
    low = F.pmod(both, _number(STEP))
    return F.struct(F.call_function("div", both - low, _number(STEP)).alias("first"), (low - _number(HALF)).cast("bigint").alias("second"))


def first_rows(rows: DataFrame, by: list[str], rank: Column, *aggregates: Column, tie: str | None = None) -> DataFrame:
    """The row with the least ``rank`` of every group, whole, with ``aggregates`` over the group (under names of their own).

    Rows without a rank are counted and never chosen; a group of such rows gives none. Where ranks may be equal, ``tie``
    decides (the smallest).
    """
    ranked = rows.withColumn("_rank", rank)
    best = ranked.groupBy(*by).agg(F.min("_rank").alias("_rank"), *aggregates)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    more = [f"b.{c}" for c in best.columns if c not in by and c != "_rank"]
    found = ranked.alias("r").join(best.alias("b"), [*same, F.col("r._rank") == F.col("b._rank")]).select(*[f"r.{c}" for c in rows.columns], *more)
    if tie is None:
        return found
    place = F.row_number().over(Window.partitionBy(*by).orderBy(tie))
    return found.withColumn("_place", place).where("_place = 1").drop("_place")
