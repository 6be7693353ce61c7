"""Exact quantiles of grouped values without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.session import stage


def _slot(value: Column) -> Column:
    """A coarse, order-keeping slot of a non-negative value: 64 slots per doubling."""
    return F.floor(F.log2(value.cast("double") + 1.0) * 64).cast("int")


def exact_quantiles(
    values: DataFrame, by: list[str], value: str, weight: str, probs: dict[str, float], counted: bool = False
) -> DataFrame:
    """Linear-interpolated quantiles of weighted non-negative values, plus their number as ``n``.

    Values are counted per distinct value first. A histogram of coarse slots then finds the slots that
    hold the wanted ranks, and only the distinct values of those slots are walked in order. ``counted``
    says that ``values`` already is a table with one row per distinct value.
    """
    if counted:
        counts = values.withColumnRenamed(weight, "w")
    else:
        counts = stage(values.groupBy(*by, value).agg(F.sum(weight).alias("w")), "quantile")
    counts = counts.withColumn("slot", _slot(F.col(value)))
    slots = counts.groupBy(*by, "slot").agg(F.sum("w").alias("w"))
    running = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*by)
    ranked = slots.withColumn("upto", F.sum("w").over(running)).withColumn("n", F.sum("w").over(whole))

    def rank(p: float, up: bool) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        return (F.ceil(at) if up else F.floor(at)).cast("bigint")

    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank(p, side == "hi").alias("rank"))
            for name, p in probs.items()
            for side in ("lo", "hi")
        ]
    )
    targets = (
        ranked.select(*by, "slot", "n", (F.col("upto") - F.col("w")).alias("before"), "upto", F.explode(wanted).alias("t"))
        .where((F.col("t.rank") >= F.col("before")) & (F.col("t.rank") < F.col("upto")))
        .select(*by, "slot", "n", "before", "t.*")
    )
    hit = counts.join(targets.select(*by, "slot").distinct(), [*by, "slot"], "left_semi")
    inner = Window.partitionBy(*by, "slot").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    walked = hit.withColumn("in_upto", F.sum("w").over(inner))
    found = walked.join(targets, [*by, "slot"]).where(
        (F.col("rank") < F.col("before") + F.col("in_upto")) & (F.col("rank") >= F.col("before") + F.col("in_upto") - F.col("w"))
    )
    pick = lambda name, side: F.max(
        F.when((F.col("name") == name) & (F.col("side") == side), F.col(value).cast("double"))
    )
    outs = []
    for name, p in probs.items():
        at = (F.max("n") - 1) * F.lit(p)
        lo, hi = pick(name, "lo"), pick(name, "hi")
        outs.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return found.groupBy(*by).agg(*outs, F.max("n").alias("n"))
