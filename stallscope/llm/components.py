"""Connected components of an undirected graph, as joins and aggregates over staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallscope.session import Staging

HELD = 1 << 20  # links gathered before they are reduced to stars


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections as links from the smallest id of each group: one for each other id of the group."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        one, two = root[x], root[y]
        if (one == two).all():
            break
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while not np.array_equal(up := root[root], root):
            root = up
    other = root != np.arange(len(ids))
    return ids[root[other]], ids[other]


def forest(links: DataFrame) -> DataFrame:
    """``links`` (a, b, moved) with the links of each task replaced by stars; ``moved`` holds for a task as a whole."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, np.int64)
        rest: list[pa.RecordBatch] = []
        waiting, moved = 0, False

        def folded() -> tuple[np.ndarray, np.ndarray]:
            column = lambda k: np.concatenate([(a, b)[k], *[x.column(k).to_numpy() for x in rest]])
            return stars(column(0), column(1))

        for batch in batches:
            moved = moved or bool(batch.num_rows and batch.column(2).true_count)
            rest.append(batch)
            waiting += batch.num_rows
            if waiting > max(HELD, len(a)):
                (a, b), rest, waiting = folded(), [], 0
        a, b = folded()
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), moved))], ["a", "b", "moved"])

    return links.select("a", "b", "moved").mapInArrow(reduce, "a long, b long, moved boolean")


def components(links: DataFrame, staging: Staging, name: str) -> DataFrame:
    """id and component (the smallest id reachable) of every node of ``links`` (a, b; a link of a node to itself is none).

    Links become stars in every task, so that no more links leave a task than it has ids. Then each round hangs ids
    under the smallest of theirs (large star), and the others of an id's tops under its smallest (small star), until
    every id has one top, which has none. Paths halve in each round and links never grow in number. The minimum is
    combined before the shuffle; joins on a top of very many ids are left to Spark's skew handling. Each round is a
    table, so lost executors cost a read.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(False).alias("moved"))
    edges = staging.write(f"{name}-0", forest(ordered))
    turn = 0
    while True:
        top = edges.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("top"))
        hung = edges.join(top, "a", "left").select(F.coalesce("top", "a").alias("a"), "b", F.col("top").isNotNull().alias("moved"))
        least = hung.groupBy("b").agg(F.min("a").alias("top"))
        both = hung.join(least, "b")
        under = F.when(F.col("a") == F.col("top"), F.array(F.struct("b", "moved"))).otherwise(F.array(F.struct("b", "moved"), F.struct(F.col("a").alias("b"), F.lit(True).alias("moved"))))
        small = both.select(F.col("top").alias("a"), F.inline(under))
        turn += 1
        edges = staging.write(f"{name}-{turn}", forest(small))
        staging.drop(f"{name}-{turn - 1}")
        if edges.where("moved").isEmpty():
            break
    one = edges.groupBy("b").agg(F.min("a").alias("a"))
    return one.select(F.col("b").alias("id"), F.col("a").alias("component")).union(one.select("a").distinct().select(F.col("a").alias("id"), F.col("a").alias("component")))
