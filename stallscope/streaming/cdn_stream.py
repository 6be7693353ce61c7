"""Events that keep arriving: reduced per micro-batch, merged, and finished by the batch code.

Every micro-batch is reduced to the same partial frames as a batch run and written to a table keyed by
batch id. Reading merges the parts, so the metrics of a stream equal those of one batch over the same
events, and raw events are not read again. A batch that is run again replaces its own part.

``compact`` merges the parts of past days, one run for each day, so that a read costs one part a day and the batches
since. A manifest names the runs and the batches that they hold; it is a table of its own for each version, valid once
its write is committed, so a reader sees the old runs or the new ones and never both. Batches in a run are not read from
their own folders any more, so running one of them again changes nothing. What a manifest has replaced is removed by
the next compaction, after the readers of the one before.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stallscope.operators.cdn_metrics import (
    KEYS,
    PART_GROUPS,
    REUSED_PARTS,
    MetricParams,
    disposition,
    merge_part,
    metrics_from_parts,
    partials,
    slim_events,
)
from stallscope.session import complete_folders, remove_path, stage_all
from stallscope.sources.cdn_export import parse_lines


def export_stream(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Typed events of export files that appear in a folder; ``ord`` is set per batch."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    lines = reader.load(folder).select(F.col("_metadata.file_path").alias("source_file"), "value")
    return parse_lines(lines.withColumn("ord", F.lit(None).cast("bigint")))


MANIFEST = "run string, day string, first long, last long"


def today(_: int = 0) -> str:
    return datetime.now(timezone.utc).date().isoformat()


def write_partials(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
    day: Callable[[int], str] = today,
) -> DataStreamWriter:
    """Reduce every micro-batch and keep its parts under its batch id, and the ``day`` on which it came.

    Order of arrival is batch id, then row number in the batch; a part carries the number, its folder the batch. The events
    are dealt to all cores by that number, since a file of few row groups is read by as few tasks, and marked once for all parts.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        numbered = batch.withColumn("ord", F.monotonically_increasing_id()).repartition("ord")
        slim = slim_events(numbered, keys, params).persist()
        try:
            parts = partials(slim, keys, params)
            with ThreadPoolExecutor(len(parts)) as pool:  # side by side, so that their jobs share the cluster
                jobs = [pool.submit(part.write.mode("overwrite").parquet, f"{table}/{name}/batch_id={batch_id}") for name, part in parts.items()]
            for job in jobs:
                job.result()
            batch.sparkSession.createDataFrame([(day(batch_id),)], "day string").write.mode("overwrite").parquet(f"{table}/batches/batch_id={batch_id}")
        finally:
            slim.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def _versions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(name.removeprefix("v=")) for name in complete_folders(spark, f"{table}/manifest"))


def runs(spark: SparkSession, table: str, version: int | None = None) -> list[Row]:
    """The runs of the last manifest, or of a given one: a row for each day."""
    known = _versions(spark, table)
    version = (known or [0])[-1] if version is None else version
    return sorted(spark.read.schema(MANIFEST).parquet(f"{table}/manifest/v={version}").collect(), key=lambda r: r.first) if version in known else []


def _arrived(spark: SparkSession, table: str, name: str, merged: list[Row], first: int, last: int | None = None) -> DataFrame:
    """A part of the given runs, and of the batches from ``first`` on (up to ``last``) by their own folders."""
    batches = [int(b.removeprefix("batch_id=")) for b in complete_folders(spark, f"{table}/batches")]
    fresh = [f"{table}/{name}/batch_id={b}" for b in batches if b >= first and (last is None or b <= last)]
    found = [spark.read.parquet(*[f"{table}/runs/{name}/{r.run}" for r in merged])] if merged else []
    found += [spark.read.option("basePath", f"{table}/{name}").parquet(*fresh).withColumn("batch_id", F.col("batch_id").cast("long"))] if fresh else []
    return reduce(DataFrame.unionByName, found)


def arrived_parts(spark: SparkSession, table: str, keys: list[str] = KEYS) -> dict[str, DataFrame]:
    """The parts of all batches so far, merged."""
    merged = runs(spark, table)
    first = merged[-1].last + 1 if merged else 0
    return {name: merge_part(name, _arrived(spark, table, name, merged, first), keys, "batch_id") for name in PART_GROUPS}


def compact(spark: SparkSession, table: str, before: str | None = None, keys: list[str] = KEYS) -> int:
    """Merge the batches of every day before ``before`` (today) that aren't in a run yet; the number of days merged.

    One compaction runs at a time. Batch ids grow with the days.
    """
    merged, version = runs(spark, table), (_versions(spark, table) or [0])[-1]
    first = merged[-1].last + 1 if merged else 0
    batches = [int(b.removeprefix("batch_id=")) for b in complete_folders(spark, f"{table}/batches")]
    paths = [f"{table}/batches/batch_id={b}" for b in batches if b >= first]
    new = spark.read.option("basePath", f"{table}/batches").parquet(*paths).where(F.col("day") < (before or today())).orderBy("batch_id").collect() if paths else []
    added = []
    for day, rows in groupby(new, key=lambda r: r.day):
        ids = [r.batch_id for r in rows]
        same = [r for r in merged if r.day == day]
        run = Row(run=uuid.uuid4().hex, day=day, first=min([ids[0], *[r.first for r in same]]), last=ids[-1])
        with ThreadPoolExecutor(len(PART_GROUPS)) as pool:
            jobs = []
            for name in PART_GROUPS:
                part = merge_part(name, _arrived(spark, table, name, same, ids[0], ids[-1]), keys, "batch_id", keep_batch=True)
                jobs.append(pool.submit(part.write.parquet, f"{table}/runs/{name}/{run.run}"))
            for job in jobs:
                job.result()
        added.append(run)
    if not added:
        return 0
    kept = [r for r in merged if r.day not in {a.day for a in added}] + added
    rows = [(r.run, r.day, r.first, r.last) for r in kept]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/v={version + 1}")
    if version:  # what the manifest before this one had replaced
        old = {r.run for r in runs(spark, table, version - 1)} - {r.run for r in merged}
        gone = [f"{table}/{part}/batch_id={b}" for b in batches if b < first for part in ("batches", *PART_GROUPS)]
        for path in [*[f"{table}/runs/{name}/{run}" for run in old for name in PART_GROUPS], *gone, f"{table}/manifest/v={version - 1}"]:
            remove_path(spark, path)
    return len(added)


def stream_metrics(
    spark: SparkSession,
    table: str,
    baseline: DataFrame | None = None,
    keys: list[str] = KEYS,
    params: MetricParams = MetricParams(),
) -> DataFrame:
    """Metrics over everything that has arrived, equal to a batch run over the same events."""
    parts = arrived_parts(spark, table, keys)
    parts.update(stage_all({name: parts[name] for name in REUSED_PARTS}))
    return metrics_from_parts(parts, baseline, keys, params)


def minute_counts(stream: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Live counts per minute, service and disposition with a bound on late events."""
    tagged = stream.withColumn(
        "disposition", disposition(F.col("cache_status"), F.col("fastly_info_state"), F.col("response_x_cache"))
    )
    return (
        tagged.withWatermark("time_start", lateness)
        .groupBy(F.window("time_start", "1 minute"), "aem_service", "aem_tier", "disposition")
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status") == 429).alias("error429"))
    )
