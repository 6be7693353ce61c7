"""Language ID with bit-sliced Bloom filters over character n-grams.

One Bloom filter per language, stored across: position p of all filters is one bit mask over the languages. A
look-up of an n-gram ANDs the masks at its ``hashes`` positions and so answers for all languages at once: the
bits that remain are the languages that (may) contain it. A text's n-grams are looked up once per distinct n-gram
of a slice of documents; the bits are counted per document and language. A filter of which a share f of the
positions is set answers yes by chance with probability f ** hashes; of ``n`` n-grams with ``c`` hits that leaves
(c - n f^h) / (1 - f^h) true ones. The language with most of them is the prediction, their share of the n-grams
the score.

Learning covers all training documents: n-gram counts of every language (counted per slice, then summed by
Spark). An n-gram enters a language's filter if it makes up at least ``min_share`` of the language's n-grams and
at least ``min_ratio`` of its largest share in any language. So a filter holds at most 1 / min_share n-grams per
length, however large the corpus, and the tables sent to the tasks are bounded by ``positions`` x languages / 8
bytes.

N-grams are runs of 1 to 3 characters of the lower-cased text with every run of non-letters as one blank; a blank
stands at either end only. A null text, or one without a letter, is ``und`` with score 0; so is any text when
nothing was learned. Equal counts go to the first language by code point. Rows stay as they are; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.llm.common import crc_part, mix64, slices
from stallscope.session import Staging

UNKNOWN = "und"
SIZES = (1, 2, 3)
BLANK = 0x20
SLICE = 1 << 20  # bytes of texts handled at once; a character takes some sixty bytes meanwhile
DENSE = 1 << 24  # n-gram numbers of a slice up to this many are counted in an array, others by sorting


@dataclass(frozen=True)
class Filters:
    positions: int = 1 << 20
    hashes: int = 3
    min_share: float = 1e-5
    min_ratio: float = 0.25
    max_languages: int = 4096


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letter_runs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and code point of every character that counts: letters, and one blank for each run of others.

    Every row with a letter starts and ends with a blank.
    """
    lowered = [(t or "").lower() for t in texts]
    lengths = np.array([len(t) for t in lowered], np.int64) + 2
    joined = "".join(f" {t} " for t in lowered)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), lengths)
    points = np.where(_letters()[points], points, BLANK)
    starts = np.zeros(len(points), bool)
    starts[np.r_[0, np.cumsum(lengths)[:-1]] if len(texts) else []] = True
    keep = (points != BLANK) | np.r_[True, points[:-1] != BLANK][: len(points)] | starts
    return rows[keep], points[keep]


def grams(rows: np.ndarray, points: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every n-gram of ``size`` characters: its row and number; and the keys that the numbers stand for.

    A key packs the code points, 21 bits each and none of them 0, so different n-grams have different keys.
    """
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = [points[k : k + n] for k in range(size)]
    inside = rows[:n] == rows[size - 1 :]
    for p in parts[1:-1]:
        inside &= p != BLANK
    if size == 1:
        inside &= parts[0] != BLANK
    elif size == 2:
        inside &= (parts[0] != BLANK) | (parts[1] != BLANK)
    at = np.flatnonzero(inside)
    alphabet = np.flatnonzero(np.bincount(points, minlength=1))
    code = np.zeros(alphabet[-1] + 1, np.int64)
    code[alphabet] = np.arange(len(alphabet))
    number = np.zeros(len(at), np.int64)
    for p in parts:
        number = number * len(alphabet) + code[p[at]]
    space = len(alphabet) ** size
    if space <= DENSE:
        used = np.flatnonzero(np.bincount(number, minlength=1))
        place = np.zeros(space, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        number = place[number]
    else:
        used, number = np.unique(number, return_inverse=True)
    keys, left = np.zeros(len(used), np.uint64), used.copy()
    for k in range(size):
        keys |= alphabet[left % len(alphabet)].astype(np.uint64) << np.uint64(21 * k)
        left //= len(alphabet)
    return rows[at], number, keys


def places(keys: np.ndarray, filters: Filters) -> np.ndarray:
    """Positions of each key: one row for each hash."""
    first = mix64(keys)
    step = mix64(first ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.vstack([(first + np.uint64(i) * step) % np.uint64(filters.positions) for i in range(filters.hashes)]).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n over all rows with a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            coded = part.column("lang").dictionary_encode()
            lang = coded.indices.to_numpy(zero_copy_only=False)
            rows, points = letter_runs(part.column("text").to_pylist())
            for size in SIZES:
                at, number, keys = grams(rows, points, size)
                table = np.zeros((len(coded.dictionary), len(keys)), np.int64)
                for k in range(len(coded.dictionary)):
                    table[k] = np.bincount(number[lang[at] == k], minlength=len(keys))
                which, gram = np.nonzero(table)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(which)), pa.array(keys[gram].astype(np.int64)), pa.array(table[which, gram])], ["lang", "gram", "n"]
                )

    known = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    return known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    masks: np.ndarray  # (words of 64 languages, positions)
    chance: np.ndarray  # of a hit without cause, by language


def learn(docs: DataFrame, filters: Filters = Filters()) -> Model:
    """The filters of all languages of ``docs`` (text, lang)."""
    staging = Staging(docs.sparkSession, "languages")
    counts = staging.write("grams", gram_counts(docs))
    rows = counts.groupBy("lang").agg(F.sum("n").alias("total")).limit(filters.max_languages + 1).collect()
    if len(rows) > filters.max_languages:
        raise ValueError(f"more than {filters.max_languages} languages")
    languages = sorted(r.lang for r in rows)
    masks = np.zeros((max(1, -(-len(languages) // 64)), filters.positions), np.uint64)
    if languages:
        numbered = {lang: i for i, lang in enumerate(languages)}
        totals = docs.sparkSession.createDataFrame([(r.lang, numbered[r.lang], float(r.total)) for r in rows], "lang string, bit int, total double")
        shares = counts.join(F.broadcast(totals), "lang").select("gram", "bit", (F.col("n") / F.col("total")).alias("share"))  # bounded by max_languages
        largest = F.max("share").over(Window.partitionBy("gram"))  # a group holds one row for each language
        entered = shares.where(F.col("share") >= filters.min_share).withColumn("largest", largest).where(F.col("share") >= filters.min_ratio * F.col("largest"))

        def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bit = b.column("bit").to_numpy(zero_copy_only=False).astype(np.int64)
                at = places(b.column("gram").to_numpy(zero_copy_only=False).astype(np.uint64), filters)
                for p in at:
                    mask = np.left_shift(np.uint64(1), (bit % 64).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array((bit // 64).astype(np.int32)), pa.array(p.astype(np.int32)), pa.array(mask.view(np.int64))], ["word", "position", "mask"])

        set_bits = entered.select("gram", "bit").mapInArrow(bits, "word int, position int, mask long").groupBy("word", "position").agg(F.bit_or("mask").alias("mask"))
        got = set_bits.toArrow()  # at most positions x words rows
        masks[got["word"].to_numpy(), got["position"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    fill = np.array([np.mean((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))])
    staging.close()
    return Model(languages, masks, fill**filters.hashes)


def decide(model: Model, texts: list[str | None], filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    rows, points = letter_runs(texts)
    hits, total = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    for size in SIZES:
        at, number, keys = grams(rows, points, size)
        masks = np.bitwise_and.reduce(model.masks[:, places(keys, filters)], axis=1) if len(keys) else np.zeros((model.masks.shape[0], 0), np.uint64)
        total += np.bincount(at, minlength=len(texts))
        for i in range(len(model.languages)):
            found = ((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(np.float64)
            hits[:, i] += np.bincount(at, weights=found[number], minlength=len(texts))
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    true = np.maximum(hits - total[:, None] * model.chance, 0) / (1 - model.chance)
    best = true.argmax(axis=1)
    score = np.clip(true[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
    lettered = total > 0
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, score, 0.0)


def predict(docs: DataFrame, model: Model, filters: Filters = Filters(), keep: float | None = None) -> DataFrame:
    """doc_id, lang_pred and score of every row; with ``keep``, instead the rows themselves that reach this score.

    Where no language was learned, nothing is rejected.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # positions x languages bits

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            lang, score = decide(shared.value, part.column("text").to_pylist(), filters)
            if keep is not None:
                yield part.filter(pa.array([x != UNKNOWN and s >= keep for x, s in zip(lang, score, strict=True)], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    if keep is not None:
        return docs.mapInArrow(decided, docs.schema) if model.languages else docs
    return docs.select("doc_id", "text").mapInArrow(decided, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return crc_part("doc_id", 4) == 2


def identify(docs: DataFrame, filters: Filters = Filters()) -> DataFrame:
    """doc_id, held_out, lang_pred and score: learned from the rows that aren't held out, predicted for all."""
    model = learn(docs.where(~held_out()), filters)
    return predict(docs, model, filters).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
