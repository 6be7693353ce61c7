"""Thread dumps that keep arriving: parse new and rewritten files, forget deleted ones, run a query again.

A trigger writes a listing of the folder (addresses and modification times; no content) as a table and joins it with
the versions that were parsed. Files of an unknown version are read by a scan of the folder that skips, by modification
time, what is older or newer than all of them, and is joined with the listing. The threads that a query sees are those of
the versions in the listing, so a rewritten file counts as it is now and a deleted one not at all. The driver sees two
times, and no addresses.

A file rewritten between listing and scan is left to the next trigger. Threads are written before their versions, and a
trigger that is run again writes the same folders, so a trigger that fails half way leaves nothing wrong.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stallscope.operators.thread_query import ThreadQuery
from stallscope.sources.dumps import parse_threads

VERSION = ["dump_id", "dump_ord"]


def _plain(address: Column) -> Column:
    return F.regexp_replace(address, r"^(\w+):/+", "$1:/")


def _files(spark: SparkSession, folder: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """dump_id (address) and dump_ord (modification time) of every file; contents are not read."""
    return _files(spark, folder, glob).select(_plain(F.col("path")).alias("dump_id"), F.unix_micros("modificationTime").alias("dump_ord"))


def _stored(spark: SparkSession, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.parquet(table)
    except AnalysisException:  # nothing parsed yet
        return spark.createDataFrame([], schema)


def read_versions(spark: SparkSession, folder: str, files: DataFrame, glob: str | None = None) -> DataFrame | None:
    """The files of the listing ``files`` as dumps, content whole; None if it has no rows."""
    first, last = files.agg(F.timestamp_micros(F.min("dump_ord")), F.timestamp_micros(F.max("dump_ord"))).first()
    if first is None:
        return None
    near = _files(spark, folder, glob).where(F.col("modificationTime").between(first, last))  # pushed down to the scan
    dumps = near.select(_plain(F.col("path")).alias("dump_id"), F.unix_micros("modificationTime").alias("dump_ord"), F.decode("content", "UTF-8").alias("content"))
    return dumps.join(files.select(*VERSION), VERSION, "left_semi").withColumn("source_file", F.col("dump_id"))


def refresh(spark: SparkSession, folder: str, table: str, batch_id: int, glob: str | None = None) -> DataFrame:
    """Parse what is new, and return the threads of the files as they are now."""
    listed = f"{table}/listing/{batch_id % 2}"
    listing(spark, folder, glob).write.mode("overwrite").parquet(listed)
    now = spark.read.parquet(listed)
    known = _stored(spark, f"{table}/versions", "dump_id string, dump_ord bigint")
    changed = now.join(known, VERSION, "left_anti")
    dumps = read_versions(spark, folder, changed, glob)
    if dumps is not None:
        parse_threads(dumps).write.mode("overwrite").parquet(f"{table}/threads/batch_id={batch_id}")
        changed.select(*VERSION).write.mode("overwrite").parquet(f"{table}/versions/batch_id={batch_id}")
    threads = _stored(spark, f"{table}/threads", "dump_id string, dump_ord bigint, source_file string")
    return threads.join(now, VERSION, "left_semi")


def ticks(spark: SparkSession) -> DataFrame:
    """A stream that only paces the triggers."""
    return spark.readStream.format("rate").load()


def watch(
    spark: SparkSession, folder: str, table: str, checkpoint: str, query: ThreadQuery, deliver: Callable[[DataFrame, int], None], glob: str | None = None
) -> DataStreamWriter:
    """At every trigger bring the threads up to date, run the query over them and hand over the result.

    The processing-time trigger of the returned writer sets how often the folder is looked at.
    """

    def step(_: DataFrame, batch_id: int) -> None:
        deliver(query.run(refresh(spark, folder, table, batch_id, glob), order=("source_file", "ord")), batch_id)

    return ticks(spark).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
