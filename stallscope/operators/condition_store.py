"""Condition results of cases kept as tables, so that a changed signature set costs its changed conditions only.

A run covers all cases and conditions it is given. ``cases`` and ``conditions`` name the run since which a case with these
signals, or a condition, has been there without a break; results carry the run that evaluated them. The result of a case and
a condition was evaluated in the later of their two runs, so that row, and no other, is the valid one. What left and came back
counts as new.

Every run writes a part of results, then its two lists; the list of conditions, written last, makes the run count. A run that
was lost before that is written over by the next. One writer at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallscope.operators import signature_match as sm
from stallscope.operators.case_signals import NUMBER_SIGNALS, TEXT_SIGNALS
from stallscope.session import complete_folders, remove_path

SIGNALS = [*NUMBER_SIGNALS, *TEXT_SIGNALS]
CASES = "case_id string, version string, since int"
RESULTS = "case_id string, condition_key string, matched boolean, observed_value string, run int"
KEYED = ["signal", "field", "operator", "want_num", "want_str"]


def condition_key():
    """Digest of what decides the result: field, operator and wanted value, not the description or the signature."""
    return F.sha2(F.to_json(F.struct("field", "operator", "want_num", "want_str")), 256)


def case_version():
    """Digest of all signals of a case."""
    return F.sha2(F.to_json(F.struct(*SIGNALS)), 256)


@dataclass
class Run:
    """Findings over all cases and signatures, and the rows that had to be evaluated for them."""

    number: int
    conditions: DataFrame
    findings: DataFrame
    evaluated: DataFrame


class ConditionStore:
    """Results in the folder ``path`` of the shared store."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[int]:
        return sorted(int(name.removeprefix("run=")) for name in complete_folders(self.spark, f"{self.path}/conditions"))

    def _list(self, name: str, schema: str, run: int | None) -> DataFrame:
        if run is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/run={run}")

    def rematch(self, signals: DataFrame, signatures: DataFrame) -> Run:
        """Evaluate what is new: new conditions on known cases, all conditions on new or changed cases.

        ``signals`` holds one row per case, and case ids are text. Equal conditions of several signatures are evaluated once.
        """
        done = self.runs()
        last, run = (done[-1], done[-1] + 1) if done else (None, 0)
        wanted = sm.condition_rows(signatures).withColumn("condition_key", condition_key())
        distinct = wanted.select("condition_key", *KEYED).distinct()
        old_conditions = self._list("conditions", "condition_key string, since int", last)
        old_cases = self._list("cases", CASES, last)
        conditions = distinct.join(old_conditions, "condition_key", "left").withColumn("since", F.coalesce("since", F.lit(run)))
        versions = signals.select("case_id", *SIGNALS).withColumn("version", case_version())
        cases = versions.join(old_cases, ["case_id", "version"], "left").withColumn("since", F.coalesce("since", F.lit(run)))
        fresh, known = F.col("since") == run, F.col("since") < run
        # Either side is filtered before the join, so no pair of a known case and a known condition is made.
        parts = [
            sm.signal_rows(cases.where(side)).join(conditions.where(other).select("condition_key", *KEYED), "signal")
            for side, other in ((known, fresh), (fresh, F.lit(True)))
        ]
        shown = sm.observed()
        rows = parts[0].unionByName(parts[1]).select("case_id", "condition_key", sm.holds().alias("matched"), shown.alias("observed_value"), F.lit(run).alias("run"))
        rows.write.mode("overwrite").parquet(f"{self.path}/results/part={run}")
        cases.select("case_id", "version", "since").write.mode("overwrite").parquet(f"{self.path}/cases/run={run}")
        conditions.select("condition_key", "since").write.mode("overwrite").parquet(f"{self.path}/conditions/run={run}")
        for gone in done[:-1]:  # the lists of the run before stay, for readers of its results
            for name in ("cases", "conditions"):
                remove_path(self.spark, f"{self.path}/{name}/run={gone}")
        results = self.results(run)
        matched = wanted.drop("signal", "operator", "want_num", "want_str").join(results, "condition_key")
        evaluated = self.spark.read.schema(RESULTS).parquet(f"{self.path}/results/part={run}")
        return Run(run, matched, sm.findings(matched, signatures), evaluated)

    def results(self, run: int) -> DataFrame:
        """The valid result of every case and condition of a run."""
        cases = self._list("cases", CASES, run).select("case_id", F.col("since").alias("case_since"))
        conditions = self._list("conditions", "condition_key string, since int", run).withColumnRenamed("since", "condition_since")
        parts = self.spark.read.schema(RESULTS).option("basePath", f"{self.path}/results").parquet(*[f"{self.path}/results/part={r}" for r in range(run + 1)])
        valid = F.col("run") == F.greatest("case_since", "condition_since")
        return parts.join(conditions, "condition_key").join(cases, "case_id").where(valid).select("case_id", "condition_key", "matched", "observed_value")
