"""Source divergence audit: how far the sources of a language lie from each other and from the language, term by term.

Each language keeps the terms of at least ``least_docs`` of its documents. A group (language, source), and a language as
a whole, gives each kept term p = 1 + floor(10^9 (count + smooth) / (N + smooth V)), N its kept occurrences, V the kept
terms. Two sources differ by the sum of |p - q| over all kept terms.

Most counts are zero, so the sum is not taken term by term. With z a source's p at count zero:

    sum |p_a - p_b| = V |z_a - z_b| + one(a, b) + one(b, a) + both(a, b)
    one(a, b)  = sum over terms of a of |p_a - z_b| - |z_a - z_b|
    both(a, b) = sum over terms of both of |p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|

``one`` needs only how often each value p_a occurs. ``both`` comes from a frequent-pattern tree: a kept term is a row,
its nonzero (source, p) in the order of the sources; equal rows are one row with a multiplicity. Rows are range
partitioned and sorted, so a task meets its part of the tree in depth-first order: a node is the run of rows that share a
prefix, its multiplicity their sum, and the corrections of a node with all its ancestors are taken once, when the run
ends. A task holds one path of the tree and sums by pair, which it hands on when they are many.

All arithmetic is exact: decimals where 10^9 x count may pass 64 bits. Term counts are pre-aggregated in tasks. The result
has a row for each pair of sources of a language, as asked for; terms and documents are never paired.

Null text, language and source count as ''. Repeated rows are documents of their own. A group without terms, or a
language that keeps none, has its pairs (with value 0 if V = 0). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.llm.common import slices
from stallscope.session import Staging

SCALE = 1_000_000_000
HELD = 1 << 20  # pair sums gathered before they are added up
SALTS = 32  # parts of a language's values when they meet the sources


@dataclass(frozen=True)
class Audit:
    least_docs: int = 30
    smooth: int = 5
    top_terms: int = 50


def _letters() -> np.ndarray:
    """Of each byte: itself where it belongs to a term (A-Z in lower case), else a space."""
    out = np.full(256, 0x20, np.uint8)
    out[0x41:0x5B] = out[0x61:0x7B] = np.arange(0x61, 0x7B)
    out[0x80:] = np.arange(0x80, 0x100)
    return out


_OF_BYTE = _letters()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold the term)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            texts = part.column("text").cast(pa.large_string())
            texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # at offset 0, with its own bytes
            ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
            data = _OF_BYTE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]]
            lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data)))
            row, terms = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).dictionary_encode()
            names = terms.dictionary
            if not len(row):
                continue
            cell, n = np.unique(row * len(names) + terms.indices.to_numpy(), return_counts=True)
            groups = pa.StructArray.from_arrays([part.column("lang"), part.column("source")], ["lang", "source"])
            seen: dict = {}
            group = np.array([seen.setdefault((g["lang"], g["source"]), len(seen)) for g in groups.to_pylist()])
            key, at = np.unique(group[cell // len(names)] * len(names) + cell % len(names), return_inverse=True)
            sums, rows = np.zeros(len(key), np.int64), np.bincount(at)
            np.add.at(sums, at, n)
            term = names.take(pa.array(key % len(names)))
            lang, source = (pa.array([k[i] for k in seen], pa.string()).take(pa.array(key // len(names))) for i in (0, 1))
            out = pa.RecordBatch.from_arrays([lang, source, term.cast(pa.string()), pa.array(sums), pa.array(rows)], ["lang", "source", "term", "n", "docs"])
            yield out.filter(pc.not_equal(pc.binary_length(out.column("term")), 0))

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    found = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column, audit: Audit) -> Column:
    """1 + floor(SCALE (count + smooth) / (total + smooth terms)), exact."""
    whole = lambda c: c.cast("decimal(20,0)")
    upper = F.lit(SCALE).cast("decimal(10,0)") * (whole(count) + F.lit(audit.smooth).cast("decimal(4,0)"))
    lower = whole(total) + whole(terms) * F.lit(audit.smooth).cast("decimal(4,0)")
    return F.lit(1) + F.call_function("div", upper, lower)


class _Pairs:
    """Sums by pair of source numbers, added up whenever many are held."""

    def __init__(self) -> None:
        self.keys: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.held = 0

    def add(self, one: np.ndarray, other: np.ndarray, value: np.ndarray) -> None:
        self.keys.append(one << 32 | other)
        self.values.append(value)
        self.held += len(value)

    def summed(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, at = np.unique(np.concatenate(self.keys), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, at, np.concatenate(self.values))
        self.keys, self.values, self.held = [keys], [sums], len(keys)
        return keys, sums


class PatternTree:
    """Corrections of one language's rows, which come sorted: a path is held, and a node is settled when its rows end."""

    def __init__(self) -> None:
        self.pairs = _Pairs()
        self.path = np.zeros((0, 3), np.int64)  # source, p, z of the nodes down to the last row's
        self.times = np.zeros(0, np.int64)  # rows that end at or below a node, its settled children included

    def insert(self, items: np.ndarray, times: int) -> None:
        most = min(len(self.path), len(items))
        differ = np.flatnonzero((self.path[:most, :2] != items[:most, :2]).any(axis=1))
        self._settle(int(differ[0]) if len(differ) else most)
        self.path = np.concatenate([self.path, items[len(self.path) :]])
        self.times = np.concatenate([self.times, np.zeros(len(self.path) - len(self.times), np.int64)])
        self.times[-1:] += times

    def _settle(self, depth: int) -> None:
        """End all nodes below ``depth``: each meets its ancestors once, times its multiplicity."""
        if len(self.path) <= depth:
            return
        times = np.cumsum(self.times[depth:][::-1])[::-1]
        if depth:
            self.times[depth - 1] += times[0]
        s, p, z = self.path.T
        new = np.arange(depth, len(s))
        node = np.repeat(new, new)
        above = np.arange(len(node)) - np.repeat(np.cumsum(new) - new, new)
        pn, zn, pa_, za = p[node], z[node], p[above], z[above]
        value = np.abs(pn - pa_) - np.abs(pn - za) - np.abs(zn - pa_) + np.abs(zn - za)
        self.pairs.add(s[above], s[node], value * times[node - depth])
        self.path, self.times = self.path[:depth], self.times[:depth]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums by pair so far; they are handed on and start anew."""
        out, self.pairs = self.pairs.summed(), _Pairs()
        return out

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        self._settle(0)
        return self.taken()


def tree_corrections(rows: DataFrame) -> DataFrame:
    """lang, a, b (source numbers, a < b) and value: ``both`` of every pair, from term rows lang, items (sorted struct of i, p, z)."""
    patterns = rows.groupBy("lang", "items").agg(F.count(F.lit(1)).alias("times"))
    near = patterns.repartitionByRange("lang", "items").sortWithinPartitions("lang", "items")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, tree = None, PatternTree()

        def out(sums: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            keys, values = sums
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(values)], ["lang", "a", "b", "value"])

        for batch in batches:
            lists = batch.column("items")
            ends, flat = lists.offsets.to_numpy(), lists.values
            items = np.stack([flat.field(k).to_numpy() for k in range(3)], axis=1)
            for k, (of, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist(), strict=True)):
                if of != lang:
                    if lang is not None:
                        yield out(tree.close())
                    lang, tree = of, PatternTree()
                tree.insert(items[ends[k] : ends[k + 1]], times)
                if tree.pairs.held > HELD and len(tree.pairs.summed()[0]) > HELD // 2:
                    yield out(tree.taken())
        if lang is not None:
            yield out(tree.close())

    return near.select("lang", "items", "times").mapInArrow(walk, "lang string, a long, b long, value long")


def audit_sources(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows (each other source of the language, by falling distance) and ``term``
    rows (the ``top_terms`` terms that the source has most above the language)."""
    staging = Staging(docs.sparkSession, "divergence")
    counts = staging.write("counts", term_counts(docs))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all")).where(F.col("docs") >= audit.least_docs)
    kept = staging.write("kept", kept.select("lang", "term", "all"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    cells = staging.write("cells", counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"))

    # Every group that occurs, with its number among the sources of its language.
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "lang_total"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms"), audit)).otherwise(0)
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = staging.write("groups", groups.withColumn("z", zero).withColumn("i", number))

    valued = cells.join(groups, ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms"), audit), share(F.col("all"), F.col("lang_total"), F.col("terms"), audit)
    valued = staging.write("valued", valued.select("lang", "source", "term", "i", p.alias("p"), "z", q.alias("q")))

    best = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    above = above.withColumn("rank", best).where(F.col("rank") <= audit.top_terms)

    both = tree_corrections(valued.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("i", "p", "z"))).alias("items")))
    both = both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))

    # one(a, b): a language's values meet its sources in parts, so that a hot language isn't one key.
    salt = F.pmod(F.xxhash64("p"), F.lit(SALTS).cast("long"))
    often = valued.groupBy("lang", F.col("i").alias("a"), "p", "z").agg(F.count(F.lit(1)).alias("times")).withColumn("salt", salt)
    others = groups.select("lang", F.col("i").alias("b"), F.col("z").alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = often.join(others, ["lang", "salt"]).where("a <> b")
    one = met.groupBy("lang", "a", "b").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("y")) - F.abs(F.col("z") - F.col("y")))).alias("value"))

    turned = lambda x: x.union(x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    base = groups.select("lang", F.col("i").alias("a"), "terms", F.col("z").alias("x")).join(groups.select("lang", F.col("i").alias("b"), F.col("z").alias("y")), "lang").where("a <> b")
    base = base.select("lang", "a", "b", (F.col("terms") * F.abs(F.col("x") - F.col("y"))).alias("value"))
    sums = base.union(turned(one)).union(turned(both)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    name = lambda i, c: groups.select("lang", F.col("i").alias(i), F.col("source").alias(c))
    pairs = sums.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", best)
    return pairs.unionByName(above)
