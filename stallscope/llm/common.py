"""What the training-data operators share: words, hashed splits, bounded slices of texts in tasks."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at once in a task, in bytes; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which may have no copy of it; once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="stallscope-code-")  # the driver's own; Spark serves the file from here
        context.addPyFile(shutil.make_archive(f"{folder}/stallscope", "zip", package.parent, package.name))
        _SHIPPED.add(context.applicationId)


def crc_part(key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs whose ``column`` holds about ``most`` bytes, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(int(np.searchsorted(ends, before + most, side="right")), start + 1)
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Free memory goes back to the machine: Python workers outlive their task and would keep it beside the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def words_of(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Of every word, in order: the number of its row, and the word (A-Z in lower case). A null text has none."""
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # a copy: Arrow's lower-casing is wrong on a cast slice
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)
    return pc.filter(rows, full).to_numpy(zero_copy_only=False), pc.filter(words, full)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_DRAW = np.random.default_rng(64)
_BYTE = _DRAW.integers(0, 2**64, 256, dtype=np.uint64)  # a value for each byte, and the powers of an odd number for its place
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(1023, np.uint64(0x9E3779B97F4A7C13))], dtype=np.uint64)
HASHED = 1 << 16  # words hashed at once


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's bytes and their places; words aren't empty."""
    if not len(words):
        return np.zeros(0, np.uint64)
    words = words.cast(pa.large_string())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)
    out = np.empty(len(words), np.uint64)
    for a in range(0, len(words), HASHED):
        part = ends[a : a + HASHED + 1]
        lengths = np.diff(part)
        place = np.arange(part[0], part[-1]) - np.repeat(part[:-1], lengths)
        power = _POWER[place % 1024] if lengths.max() <= 1024 else _POWER[place % 1024] ^ mix64(place // 1024)
        sums = np.add.reduceat(_BYTE[data[part[0] : part[-1]]] * power, part[:-1] - part[0])
        out[a : a + HASHED] = mix64(sums + lengths.astype(np.uint64))
    return out


def shingle_hashes(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every run of ``size`` words; a row with fewer words gives its whole sequence once."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    count = np.diff(np.r_[first, n])
    left = np.repeat(first + count, count) - np.arange(n)  # words from here to the end of the row
    start = (left >= size) | ((np.arange(n) == np.repeat(first, count)) & (left < size))
    at = np.flatnonzero(start)
    take = np.minimum(left[at], size)
    out = mix64(take.astype(np.uint64))
    for k in range(size):
        there = k < take
        step = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[np.minimum(at + k, n - 1)])
        out = np.where(there, step, out)
    return rows[at], out
