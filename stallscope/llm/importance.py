"""Importance resampling towards a target distribution, with bit-sliced bucket counts.

1. Features are all runs of 1 to ``longest`` consecutive words, joined by one space, repeats counted. A feature falls
   into the bucket crc32 modulo ``buckets``. The checksum of a run is put together from its words' checksums
   (appending bytes is linear over GF(2)), so runs are never built as strings.
2. Bucket counts of the corpus and of the target are summed in tasks, one row for each task. A bucket's gain is the
   scaled logarithm of its smoothed ratio; ``buckets`` numbers go to the driver, whatever the corpus holds.
3. A document's bucket counts are bit planes: plane i holds bit i of every count. The gains are bit planes too, one
   set for positive and one for negative gains. AND of two planes, population count and a shift by the sum of their
   places give the exact sum of gains over all features; its floored mean is the weight.
4. A Gumbel draw from a hash of the document number is added to the weight (which draws without replacement in
   proportion to exp(weight / 1000)), and the highest scores are drawn. Ranks come from a range-partitioned sort of
   numbers only: position in the partition plus the rows of those before it, so ties and repeated numbers can't pile
   up in one task.

A null text has no words, and a document without features weighs 0. Documents with fewer than ``least_words`` words
have a weight and a score, but are never drawn. A null document number hashes as the empty text and comes before all
others among ties. Repeated rows are documents of their own; those of one number and score take adjoining ranks. An
empty corpus gives an empty result; an empty target is a target without features. Other columns are ignored by
``ranked`` and carried along by ``resample``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.llm.common import slices
from stallscope.session import Staging

SHORT = 64  # bytes of a word, and the space before it, whose checksum is appended by table
ROWS = 256  # documents whose planes are built at once
POLYNOMIAL = 0xEDB88320  # of crc32


@dataclass(frozen=True)
class Draw:
    longest: int = 2  # words of a feature
    buckets: int = 10_000
    percent: int = 25  # of the documents with enough words
    least_words: int = 20
    seed: int = 7


def _word_bytes() -> np.ndarray:
    """Of each byte: itself where it belongs to a word (A-Z in lower case), else a space."""
    out = np.full(256, 0x20, np.uint8)
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    out[keep] = keep
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def _append_tables() -> np.ndarray:
    """[n][k][byte]: what byte k of a checksum becomes when n zero bytes are appended."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    out = np.empty((SHORT + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    for n in range(SHORT):
        out[n + 1] = step[out[n] & np.uint32(255)] ^ (out[n] >> np.uint32(8))
    return out


_OF_BYTE, _APPEND = _word_bytes(), _append_tables()


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Of every word, in order: the number of its row, and the word."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts, texts.slice(0, 0)])  # at offset 0, with its own bytes
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1]
    data = _OF_BYTE[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]]
    lists = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(data)))
    rows, words = pc.list_parent_indices(lists), pc.list_flatten(lists)
    full = pc.not_equal(pc.binary_length(words), 0)
    return pc.filter(rows, full).to_numpy(zero_copy_only=False), pc.filter(words, full).dictionary_encode()


def features(texts: pa.Array, draw: Draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of each row; and of every feature, its row and its bucket."""
    rows, words = split_words(texts)
    n_words = np.bincount(rows, minlength=len(texts))
    spelled = [w.as_py().encode() for w in words.dictionary]
    code = words.indices.to_numpy(zero_copy_only=False)
    if not len(code):
        return n_words, np.zeros(0, np.int64), np.zeros(0, np.int64)
    alone = np.array([zlib.crc32(w) for w in spelled], np.uint32)[code]
    after = np.array([zlib.crc32(b" " + w) for w in spelled], np.uint32)
    length = np.array([len(w) + 1 for w in spelled])
    at, sums = np.arange(len(code)), alone
    out_rows, out = [rows], [alone]
    for k in range(1, draw.longest):
        going = at + k < len(code)
        at, sums = at[going], sums[going]
        same = rows[at] == rows[at + k]
        at, sums = at[same], sums[same]
        last = code[at + k]
        by = np.minimum(length[last], SHORT)
        moved = _APPEND[by, 0, sums & np.uint32(255)]
        for byte in (1, 2, 3):
            moved = moved ^ _APPEND[by, byte, (sums >> np.uint32(8 * byte)) & np.uint32(255)]
        longer = moved ^ after[last]
        for i in np.flatnonzero(length[last] > SHORT):
            longer[i] = zlib.crc32(b" " + spelled[last[i]], int(sums[i]))
        sums = longer
        out_rows.append(rows[at])
        out.append(sums)
    return n_words, np.concatenate(out_rows), (np.concatenate(out) % np.uint32(draw.buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, draw: Draw = Draw()) -> np.ndarray:
    """Features of all texts by bucket: ``buckets`` numbers, summed by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for part in slices(batches, "text"):
            total += np.bincount(features(part.column("text"), draw)[2], minlength=draw.buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    out = np.zeros(draw.buckets, np.int64)
    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in rows.collect():  # at most draw.buckets rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 x the logarithm of each bucket's smoothed share in the target against the corpus, floored."""
    of_corpus, of_target = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * of_corpus / ((float(s) + 1) * of_target))) for s, t in zip(corpus, target, strict=True)], np.int64)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def gain_planes(gain: np.ndarray) -> np.ndarray:
    """[sign][place][word]: bit planes of the positive and of the negative gains."""
    sides = np.stack([np.maximum(gain, 0), np.maximum(-gain, 0)])
    places = max(1, int(sides.max(initial=0)).bit_length())
    return np.stack([_packed((sides >> i) & 1 == 1) for i in range(places)], axis=1)


def weighted_sums(rows: np.ndarray, bucket: np.ndarray, n_rows: int, planes: np.ndarray, draw: Draw) -> np.ndarray:
    """Exact sum of gains over the features of each row."""
    keys, counts = np.unique(rows * draw.buckets + bucket, return_counts=True)
    out = np.zeros(n_rows, np.int64)
    for start in range(0, n_rows, ROWS):
        some = slice(*np.searchsorted(keys, [start * draw.buckets, (start + ROWS) * draw.buckets]))
        at, n = keys[some] - start * draw.buckets, counts[some]
        here = min(ROWS, n_rows - start)
        for i in range(int(n.max(initial=0)).bit_length()):
            bits = np.zeros(here * draw.buckets, bool)
            bits[at[(n >> i) & 1 == 1]] = True
            plane = _packed(bits.reshape(here, draw.buckets))
            full = np.flatnonzero(plane.any(axis=1))  # high planes belong to few documents
            for sign, side in zip((1, -1), planes, strict=True):
                for j, of_gain in enumerate(side):
                    out[start + full] += sign * (np.bitwise_count(plane[full] & of_gain).sum(axis=1, dtype=np.int64) << (i + j))
    return out


def weights(docs: DataFrame, gain: np.ndarray, draw: Draw = Draw(), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, n_words, n_features and weight of every row."""
    planes = gain_planes(gain)  # buckets x places bits, shipped with the function

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            n_words, rows, bucket = features(part.column("text"), draw)
            n = np.bincount(rows, minlength=part.num_rows).astype(np.int64)
            mean = weighted_sums(rows, bucket, part.num_rows, planes, draw) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in keep], pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(mean)], [*keep, "n_words", "n_features", "weight"]
            )

    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(weigh, f"{types}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of a SHA-256 of seed and number."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def with_rank(scored: DataFrame, staging: Staging, drawn: int) -> DataFrame:
    """``scored`` with its rank by falling score, then number, where that is at most ``drawn``."""
    ordered = scored.orderBy(F.desc("score"), F.asc_nulls_first("doc_id"), F.monotonically_increasing_id())
    placed = staging.write("placed", ordered.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    share = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each partition of the sort
    before = share.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank)).drop("part", "place", "before")


def _scored(docs: DataFrame, target: DataFrame, draw: Draw, staging: Staging) -> DataFrame:
    gain = gains(bucket_counts(docs, draw), bucket_counts(target, draw))
    return staging.write("scored", weights(docs, gain, draw).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), draw.seed)))


def ranked(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (1, 2, 3 ... of those drawn, else null) of every row of ``docs``."""
    staging = Staging(docs.sparkSession, "importance")
    scored = _scored(docs, target, draw, staging)
    enough = F.col("n_words") >= draw.least_words
    drawn = draw.percent * scored.where(enough).count() // 100
    return with_rank(scored.where(enough), staging, drawn).unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """The drawn rows of ``docs`` themselves. Rows of one number are drawn together, by the best of their ranks."""
    chosen = ranked(docs, target, draw).where("rank is not null").select(F.col("doc_id").alias("chosen")).distinct()
    return docs.alias("d").join(chosen.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.chosen")), "left_semi")
