"""Case and evidence tables on disk, and the sinks for findings and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallscope.operators.casebook import REPORT_ORDER


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return with_case_defaults(spark.read.parquet(path))


def with_case_defaults(cases: DataFrame) -> DataFrame:
    """Missing status is open, a missing title is the id."""
    return cases.withColumns(
        {"status": F.coalesce("status", F.lit("open")), "title": F.coalesce(F.nullif(F.col("title"), F.lit("")), "case_id")}
    )


def read_evidence(spark: SparkSession, path: str, now: Column | None = None) -> DataFrame:
    return with_evidence_defaults(spark.read.parquet(path), now)


def with_evidence_defaults(evidence: DataFrame, now: Column | None = None) -> DataFrame:
    """Text columns default to ''; a capture time that cannot be read becomes ``now``."""
    now = now if now is not None else F.lit(datetime.now(timezone.utc)).cast("timestamp")
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("evidence_id", "source", "file_path") if c in evidence.columns}
    return evidence.withColumns(texts).withColumn(
        "captured_at", F.coalesce(F.col("captured_at").cast("string").try_cast("timestamp"), now)
    )


def append_changes(changes: DataFrame, path: str) -> None:
    """Case and evidence updates are new rows; the current state is the latest of them."""
    changes.write.mode("append").parquet(path)


def write_findings(findings: DataFrame, path: str) -> None:
    """One folder per case."""
    findings.write.partitionBy("case_id").mode("append").parquet(path)


def write_case_reports(lines: DataFrame, path: str) -> None:
    """Report lines, one folder per case, in order.

    Rows are spread by range over the order columns, so a long report becomes several ordered files.
    """
    ordered = lines.repartitionByRange(*REPORT_ORDER).sortWithinPartitions(*REPORT_ORDER)
    ordered.select("case_id", F.col("line").alias("value")).write.partitionBy("case_id").mode("append").text(path)
