"""Benchmark decontamination with SimHash windows and a multi-index on Hamming blocks.

Words have weights: their length in bytes, at most 8, so function words tell little. The SimHash of a run of words
is the sign, bit by bit, of the weighted sum of the words' hashes taken as +1 and -1.

1. Sizes. An item of L words is looked for in windows of the largest size of a geometric grid (steps of 1.4, at
   most 1024 words) that isn't above L. Four runs of that size, from the item's start to its end, are
   fingerprinted. So a handful of window sizes serves items of all lengths, and a passage that lost words at its
   ends keeps whole runs.
2. Windows. Every window of every size over each document's whole text is fingerprinted, from running sums of the
   weighted bits: the cost of a window doesn't depend on its size.
3. Multi-index. Fingerprints are cut in three blocks of 21 or 22 bits. Two that differ in at most ``radius`` = 8
   bits differ in at most two bits in some block, so a table of each block's values and their neighbours up to two
   bits away finds all fingerprints within the radius; full distances are then checked.
4. Proof. A match places the item on the document. The words there, as many as the item has, are compared with the
   item by weighted shingles: five words each, weighing the sum of their words, as multisets;
   sum of minima / sum of maxima >= ``similarity`` makes a hit.

Documents are never shuffled. The benchmark is a stated query set: it is taken in blocks of about
``items_per_block`` items, each with an index of its own that tasks hold; blocks follow each other in one pass.

Null or empty texts have no hits. Items of fewer words than a shingle, or null ones, are not looked for: such
sequences occur in clean text. Equal items are all reported. Rows stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import hash_words, mix64, slices, words_of

BLOCKS = ((0, 22), (22, 21), (43, 21))  # first bit and width
HEAVIEST = 8
TOGETHER, WIDEST = 4095, 1024  # words summed up at once: 16 a word at most stays below 2^16; words of the largest window
OFFSETS = 4  # runs of an item that are looked for


@dataclass(frozen=True)
class Match:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 8  # below 3 * len(BLOCKS), which the multi-index rests on
    step: float = 1.4
    items_per_block: int = 2_000


def grid_size(words: int, step: float) -> int:
    """The largest size of the grid 5, 7, 9, 13, 18, 25, ... that isn't above ``words``."""
    size = at = 5.0
    while int(at) <= min(words, WIDEST):
        size, at = int(at), max(at * step, at + 1)
    return int(size)


@dataclass(frozen=True)
class Words:
    """Words of several texts, one after another."""

    rows: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray


def weighted_words(texts: pa.Array) -> Words:
    rows, words = words_of(texts)
    return Words(rows, hash_words(words), np.minimum(pc.binary_length(words).to_numpy(zero_copy_only=False), HEAVIEST).astype(np.int16))


def window_prints(w: Words, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(size, first, SimHashes) of the windows that start at ``first`` and the words after it, a run at a time.

    Windows that span two texts are among them. In a run the weighted bits are summed up once for all sizes, four
    16-bit sums to a 64-bit number. Values are raised by ``HEAVIEST``, so sums never fall and never overflow.
    """
    n, widest = len(w.hashes), max(sizes)
    run = TOGETHER - widest + 1
    for a in range(0, n, run):
        b = min(a + TOGETHER, n)
        bits = np.unpackbits(mix64(w.hashes[a:b]).view(np.uint8).reshape(-1, 8), axis=1)
        weight = w.weights[a:b, None].astype(np.uint16)
        raised = bits * (2 * weight) + (HEAVIEST - weight)
        sums = np.zeros((16, b - a + 1), np.uint64)
        np.cumsum(np.ascontiguousarray(raised.view(np.uint64).T), axis=1, out=sums[:, 1:])
        lanes = sums.view(np.uint16).reshape(16, -1)
        for size in sizes:
            many = min(run, n - a, b - a - size + 1)
            if many > 0:
                positive = (lanes[:, 4 * size : 4 * (size + many)] > lanes[:, : 4 * many] + np.uint16(HEAVIEST * size)).view(np.uint8)
                prints = np.empty((many, 2), np.uint32)
                for half in (0, 1):
                    packed = positive[8 * half].copy()
                    for k in range(1, 8):
                        packed += positive[8 * half + k] * np.uint8(1 << k)
                    prints[:, half] = packed.view(np.uint32)
                yield size, a, prints.view(np.uint64).ravel()


@dataclass(frozen=True)
class SizeIndex:
    """Fingerprints of one window size: item, place of the run in it, and the multi-index."""

    prints: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    used: list[np.ndarray]  # for each block: which values have a list
    values: list[np.ndarray]  # those values, in order, ...
    owners: list[np.ndarray]  # ... and the fingerprints that have the value, or one up to two bits away


@dataclass(frozen=True)
class Index:
    ids: np.ndarray
    shingles: list[dict[int, tuple[int, int]]]  # of each item: shingle -> (count, weight)
    lengths: np.ndarray
    sizes: dict[int, SizeIndex]


def _block(prints: np.ndarray, k: int) -> np.ndarray:
    first, width = BLOCKS[k]
    return (prints >> np.uint64(first)).astype(np.uint32) & np.uint32((1 << width) - 1)


def _flips(width: int) -> np.ndarray:
    """All masks of at most two bits."""
    bits = np.uint32(1) << np.arange(width, dtype=np.uint32)
    two = (bits[:, None] | bits)[np.triu_indices(width, 1)]
    return np.r_[np.uint32(0), bits, two]


def size_index(prints: np.ndarray, item: np.ndarray, offset: np.ndarray) -> SizeIndex:
    used, values, owners = [], [], []
    for k, (_, width) in enumerate(BLOCKS):
        near = (_block(prints, k)[:, None] ^ _flips(width)).ravel()
        order = np.argsort(near, kind="stable")
        there = np.zeros(1 << width, bool)
        there[near] = True
        used.append(there)
        values.append(near[order])
        owners.append((order // len(_flips(width))).astype(np.int32))
    return SizeIndex(prints, item, offset, used, values, owners)


def weighted_shingles(hashes: np.ndarray, weights: np.ndarray, size: int) -> dict[int, tuple[int, int]]:
    out: dict[int, tuple[int, int]] = {}
    if len(hashes) < size:
        return out
    keys = np.zeros(len(hashes) - size + 1, np.uint64)
    for k in range(size):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(keys)])
    sums = np.convolve(weights.astype(np.int64), np.ones(size, np.int64), "valid")
    for key, weight in zip(keys.tolist(), sums.tolist(), strict=True):
        out[key] = (out.get(key, (0, 0))[0] + 1, weight)
    return out


def similarity(a: dict[int, tuple[int, int]], b: dict[int, tuple[int, int]]) -> float:
    both = sum(min(n, b[k][0]) * w for k, (n, w) in a.items() if k in b)
    total = sum(n * w for n, w in a.values()) + sum(n * w for n, w in b.values())
    return both / (total - both) if total else 0.0


def build_index(items: pa.Table, match: Match) -> Index | None:
    """The index of a block of items (item_id, text); None if none is long enough."""
    w = weighted_words(items.column("text").combine_chunks())
    lengths = np.bincount(w.rows, minlength=items.num_rows)
    ends = np.cumsum(lengths)
    grid = np.array([grid_size(n, match.step) if n >= match.shingle else 0 for n in lengths.tolist()])
    if not grid.any():
        return None
    sizes = {}
    for size in sorted(set(grid.tolist()) - {0}):
        runs = [(first, prints) for _, first, prints in window_prints(w, [size])]
        start = np.concatenate([first + np.arange(len(prints)) for first, prints in runs])
        item = w.rows[start]
        place, spare = start - (ends - lengths)[item], lengths[item] - size
        own = (grid[item] == size) & (place <= spare)
        # up to OFFSETS runs, evenly spaced, the first and the last among them
        step = np.maximum(1, -(-spare // (OFFSETS - 1)))
        own &= (place % step == 0) | (place == spare)
        prints = np.concatenate([prints for _, prints in runs])
        sizes[size] = size_index(prints[own], item[own], place[own])
    shingles = [weighted_shingles(w.hashes[e - n : e], w.weights[e - n : e], match.shingle) for e, n in zip(ends, lengths, strict=True)]
    return Index(items.column("item_id").to_numpy(), shingles, lengths, sizes)


def within_radius(index: SizeIndex, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All (window, fingerprint) pairs at most ``radius`` bits apart."""
    found = []
    for k in range(len(BLOCKS)):
        value = _block(prints, k)
        some = np.flatnonzero(np.take(index.used[k], value))
        if not len(some):
            continue
        first = np.searchsorted(index.values[k], value[some])
        n = np.searchsorted(index.values[k], value[some], side="right") - first
        window = np.repeat(some, n)
        within = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
        known = index.owners[k][np.repeat(first, n) + within]
        near = np.bitwise_count(prints[window] ^ index.prints[known]) <= radius
        found.append(window[near] * len(index.prints) + known[near])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // max(1, len(index.prints)), pairs % max(1, len(index.prints))


def hits_of(texts: pa.Array, index: Index, match: Match) -> list[dict[int, float]]:
    """For each text: number of the item in the index -> best similarity, of the items it contains."""
    out: list[dict[int, float]] = [{} for _ in range(len(texts))]
    w = weighted_words(texts)
    if not len(w.rows):
        return out
    first = np.searchsorted(w.rows, np.arange(len(texts)))
    last = np.searchsorted(w.rows, np.arange(len(texts)), side="right")
    for size, from_, prints in window_prints(w, list(index.sizes)):
        known = index.sizes[size]
        window, print_ = within_radius(known, prints, match.radius)
        at = window + from_
        inside = w.rows[at] == w.rows[at + size - 1]
        if not inside.any():
            continue
        at, print_ = at[inside], print_[inside]
        item, row = known.item[print_], w.rows[at]
        begin = np.clip(at - known.offset[print_], first[row], np.maximum(last[row] - index.lengths[item], first[row]))
        for r, i, b in np.unique(np.stack([row, item, begin], axis=1), axis=0).tolist():
            stop = min(b + int(index.lengths[i]), int(last[r]))
            s = similarity(index.shingles[i], weighted_shingles(w.hashes[b:stop], w.weights[b:stop], match.shingle))
            if s >= match.similarity and s > out[r].get(i, 0.0):
                out[r][i] = s
    return out


def indexes(benchmark: DataFrame, match: Match) -> Iterator[Index]:
    """One index for each block of items; the driver holds one block at a time."""
    items = benchmark.select("item_id", "text").where("text is not null")
    count = max(1, -(-items.count() // match.items_per_block))
    for k in range(count):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).orderBy("item_id", "text").toArrow()
        index = build_index(block, match) if block.num_rows else None
        if index:
            yield index


HITS = "array<struct<item_id:bigint,similarity:double>>"


def find_hits(docs: DataFrame, benchmark: DataFrame, match: Match = Match()) -> DataFrame:
    """doc_id and hits (item_id, similarity; by item) of every row."""
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64())]))
    found = docs.select("doc_id", "text", F.array().cast(HITS).alias("hits"))
    for index in indexes(benchmark, match):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # at most items_per_block items

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                new = hits_of(part.column("text"), shared.value, match)
                ids = shared.value.ids
                rows = [
                    sorted([*old, *({"item_id": int(ids[i]), "similarity": s} for i, s in n.items())], key=lambda h: (h["item_id"], -h["similarity"]))
                    for old, n in zip(part.column("hits").to_pylist(), new, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(rows, kind)], ["doc_id", "text", "hits"])

        found = found.mapInArrow(add, f"doc_id long, text string, hits {HITS}")
    return found.select("doc_id", "hits")


def contamination(docs: DataFrame, benchmark: DataFrame, match: Match = Match()) -> DataFrame:
    """doc_id, contaminated, n_items, items (numbers, comma-joined) and similarity (the best; 0 without) of every row."""
    ids = F.array_distinct(F.transform("hits", lambda h: h["item_id"]))
    return find_hits(docs, benchmark, match).select(
        "doc_id", (F.size("hits") > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), F.array_join(ids.cast("array<string>"), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("hits", lambda h: h["similarity"])), F.lit(0.0)).alias("similarity"),
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, match: Match = Match()) -> DataFrame:
    """The rows that contain no item."""
    for index in indexes(benchmark, match):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                yield part.filter(pa.array([not h for h in hits_of(part.column("text"), shared.value, match)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
