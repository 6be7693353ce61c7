"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

``P(w | v) = a(b) c(v w) / c(v) + b(b) c(w) / N + c(b) / (V + 1)``: maximum-likelihood estimates from the counts of
all training documents, mixed by weights that depend on how often the context v occurs (bucket b: powers of two).
The weights are learned by expectation-maximisation on a deleted fifth of the training documents: their
n-grams are predicted from the counts of the other four fifths. What EM sees of the deleted n-grams are
their numbers by bucket and by the sizes of the two estimates, in steps of 1/8 octave: a table with a fixed
bound, summed over the whole deleted part.

Tokens: words with A-Z in lower case, then one end of text. A text starts in a context of its own.

How counts meet documents without a row for each n-gram of each document:

1. Documents are packed into blocks of ``block_bytes`` of text (of one role: retained, deleted or test).
2. Each block sends its distinct n-grams once, as sorted 64-bit keys with counts, cut by key range; a row is a
   run of keys. The ranges grow in number with the corpus, so a range holds a bounded number of keys.
3. A range sums the counts of its n-grams over all blocks and answers every run with the totals, in its order.
4. Blocks and answers meet by block; a block's documents are scored from its own tokens and the totals.

Nothing is dropped or capped; a frequent n-gram costs one key per block. Keys of different n-grams are equal with
probability 2^-63 for each pair.

A null text is empty and has one token, the end. Rows stay as they are; other columns are ignored. An empty
training set gives uniform estimates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import crc_part, hash_words, mix64, slices, words_of
from stallscope.session import Staging

RETAINED, DELETED, TEST = 0, 1, 2
END, START = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)  # stand for hashes of words
STEPS = 8  # cells per octave of an estimate, in what EM sees
CELLS = 64 * STEPS
BUCKETS = 48


@dataclass(frozen=True)
class Interpolation:
    block_bytes: int = 4 << 20
    range_bytes: int = 8 << 20  # text for each key range: about a million keys
    rounds: int = 60


def role() -> Column:
    """Test: remainder 1 of five. Of the others, by the next digit of the same hash, one fifth is deleted."""
    return F.when(crc_part("doc_id", 5) == 1, TEST).when(F.floor(crc_part("doc_id", 1 << 32) / 5) % 5 == 0, DELETED).otherwise(RETAINED)


# Packing --------------------------------------------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes, plane by plane, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<u8").ravel()


def _pack_documents(parts: list[pa.RecordBatch]) -> bytes:
    import zstandard

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, parts[0].schema) as out:
        for p in parts:
            out.write_batch(p)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def _unpack_documents(data: bytes) -> pa.Table:
    import zstandard

    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()


def blocks(docs: DataFrame, settings: Interpolation) -> DataFrame:
    """block, role, n_bytes and the packed documents (doc_id, text)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {RETAINED: [], DELETED: [], TEST: []}
        number = TaskContext.get().partitionId() << 32

        def block(kind: int) -> pa.RecordBatch:
            nonlocal number
            parts, number = held[kind], number + 1
            held[kind] = []
            return pa.RecordBatch.from_pylist(
                [{"block": number, "role": kind, "n_bytes": sum(p.nbytes for p in parts), "documents": _pack_documents(parts)}], schema=shape
            )

        shape = pa.schema([("block", pa.int64()), ("role", pa.int32()), ("n_bytes", pa.int64()), ("documents", pa.binary())])
        for part in slices(batches, "text", settings.block_bytes // 8):
            for kind in held:
                some = part.filter(pa.compute.equal(part.column("role"), kind)).select(["doc_id", "text"])
                if some.num_rows:
                    held[kind].append(some)
                if sum(p.nbytes for p in held[kind]) >= settings.block_bytes:
                    yield block(kind)
        for kind in held:
            if held[kind]:
                yield block(kind)

    return docs.select("doc_id", "text", role().alias("role")).mapInArrow(pack, "block long, role int, n_bytes long, documents binary")


# N-grams of a block ---------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """The tokens of a block in order, and its distinct n-grams sorted by key."""

    doc: np.ndarray  # of each token: number of its document in the block
    word: np.ndarray  # places in ``keys``: of the token ...
    pair: np.ndarray  # ... of the bigram that ends with it ...
    context: np.ndarray  # ... and of the token before; -1 at the start of a text, whose context occurs once a text
    keys: np.ndarray
    counts: np.ndarray


def grams(texts: pa.ChunkedArray) -> Grams:
    rows, words = words_of(texts.combine_chunks())
    coded = words.dictionary_encode()
    end = len(coded.dictionary)
    hashes = np.r_[hash_words(coded.dictionary), END, START]
    lengths = np.bincount(rows, minlength=len(texts))
    word = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(lengths), end)
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    before = np.r_[end + 1, word[:-1]]
    before[np.r_[0, np.cumsum(lengths + 1)[:-1]]] = end + 1
    pairs, pair, pair_counts = np.unique(before * (end + 2) + word, return_inverse=True, return_counts=True)
    first, second = hashes[pairs // (end + 2)], hashes[pairs % (end + 2)]
    keys = np.r_[mix64(hashes[: end + 1]) & ~np.uint64(1), mix64(mix64(first) * np.uint64(0x9E3779B97F4A7C15) + second) | np.uint64(1)]
    order = np.argsort(keys, kind="stable")
    place = np.empty(len(keys), np.int64)
    place[order] = np.arange(len(keys))
    counts = np.r_[np.bincount(word, minlength=end + 1), pair_counts]
    context = np.where(before == end + 1, -1, place[np.minimum(before, end)])
    return Grams(doc, place[word], place[end + 1 + pair], context, keys[order], counts[order])


def key_runs(packed: DataFrame, bits: int) -> DataFrame:
    """block, role, range, keys and counts: the distinct n-grams of each block, cut by the keys' first ``bits``."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):  # one block at a time
                row = {name: batch.column(name)[n].as_py() for name in ("block", "role")}
                g = grams(_unpack_documents(batch.column("documents")[n].as_py()).column("text"))
                at = (g.keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(g.keys), np.int64)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                last = np.r_[first[1:], len(at)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [row["block"]] * len(first),
                        "role": pa.array([row["role"]] * len(first), pa.int32()),
                        "range": at[first],
                        "keys": [_pack(np.diff(g.keys[a:b], prepend=np.uint64(0))) for a, b in zip(first, last, strict=True)],
                        "counts": [_pack(g.counts[a:b]) for a, b in zip(first, last, strict=True)],
                    }
                )

    return packed.select("block", "role", "documents").mapInArrow(send, "block long, role int, range long, keys binary, counts binary")


ANSWER = "block long, role int, range long, seen binary, retained binary, types long, tokens long, retained_types long, retained_tokens long"


def totals(runs: DataFrame) -> DataFrame:
    """For every run the totals of its n-grams over all training blocks, and over the retained ones where a deleted
    block asks; and one row (block null) for each range with the numbers of words and word types."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        kind = np.repeat(table.column("role").to_numpy(), sizes)
        counts = np.concatenate([_unpack(c) for c in table.column("counts").to_pylist()]).astype(np.float64)
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        known = np.bincount(place, weights=np.where(kind == TEST, 0, counts))
        kept = np.bincount(place, weights=np.where(kind == RETAINED, counts, 0))
        ends = np.cumsum(sizes)
        parts = [place[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        words = (distinct & np.uint64(1)) == 0
        facts = [int((known[words] > 0).sum()), int(known[words].sum()), int((kept[words] > 0).sum()), int(kept[words].sum())]
        n = len(parts)
        roles = table.column("role").to_pylist()
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), None], pa.int64()),
                "role": pa.array([*roles, None], pa.int32()),
                "range": pa.array([*table.column("range").to_pylist(), None], pa.int64()),
                "seen": pa.array([*[_pack(known[p]) for p in parts], None], pa.binary()),
                "retained": pa.array([*[_pack(kept[p]) if r == DELETED else None for p, r in zip(parts, roles, strict=True)], None], pa.binary()),
                **{name: pa.array([*[None] * n, x], pa.int64()) for name, x in zip(("types", "tokens", "retained_types", "retained_tokens"), facts, strict=True)},
            }
        )

    return runs.groupBy("range").applyInArrow(add, ANSWER)


# Estimates and their mixture ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Estimates:
    """Of every token of a block: context bucket, bigram and unigram estimate."""

    bucket: np.ndarray
    bigram: np.ndarray
    unigram: np.ndarray


def estimates(g: Grams, seen: np.ndarray, tokens: int, texts: int) -> Estimates:
    """From the totals of the block's n-grams; ``texts``: how many texts were learned from."""
    context = np.where(g.context < 0, float(texts), seen[g.context])
    bigram = np.divide(seen[g.pair], context, out=np.zeros(len(context)), where=context > 0)
    bucket = np.minimum(np.floor(np.log2(np.maximum(context, 0.5))) + 1, BUCKETS - 1).astype(np.int64)
    return Estimates(bucket, bigram, seen[g.word] / max(tokens, 1))


def _cell(estimate: np.ndarray, uniform: float) -> np.ndarray:
    """0 for no estimate, else its size against the uniform one in steps of 1 / STEPS octave."""
    steps = np.round(np.log2(np.maximum(estimate, 1e-300) / uniform) * STEPS) + CELLS // 2
    return np.where(estimate > 0, np.clip(steps, 1, CELLS - 1), 0).astype(np.int64)


def mixture(cells: np.ndarray, rounds: int) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each bucket from rows (bucket, bigram cell, unigram cell, n)."""
    size = lambda c: np.where(c > 0, 2.0 ** ((c - CELLS // 2) / STEPS), 0.0)  # noqa: E731  against the uniform estimate
    out = np.full((BUCKETS, 3), np.nan)
    for b in range(BUCKETS):
        of = cells[cells[:, 0] == b]
        if not len(of):
            continue
        n, likely = of[:, 3].astype(float), np.stack([size(of[:, 1]), size(of[:, 2]), np.ones(len(of))], axis=1)
        w = np.array([0.0 if b == 0 else 0.4, 0.4, 0.2])
        w /= w.sum()
        for _ in range(rounds):
            share = likely * w
            share /= share.sum(axis=1, keepdims=True)
            w = (n @ share + np.array([0, 0, 0.5])) / (n.sum() + 0.5)  # the uniform part never vanishes
        out[b] = w
    learned = np.flatnonzero(~np.isnan(out[:, 0]))
    for b in range(BUCKETS):
        if np.isnan(out[b, 0]):  # nothing deleted falls here: as the nearest bucket, the smaller first
            out[b] = out[min(learned, key=lambda k: (abs(k - b), k))] if len(learned) else [0.0 if b == 0 else 0.3, 0.4, 0.3]
    out[0] = [0.0, out[0, 1] / (out[0, 1] + out[0, 2]), out[0, 2] / (out[0, 1] + out[0, 2])]
    return out


def _answers(answered: pa.Table, column: str) -> np.ndarray:
    rows = sorted(zip(answered.column("range").to_pylist(), answered.column(column).to_pylist(), strict=True))
    return np.concatenate([_unpack(x) for _, x in rows]).astype(np.float64)


def deleted_cells(packed: DataFrame, answered: DataFrame, facts: dict[str, int]) -> DataFrame:
    """bucket, bigram, unigram (cells) and n over all tokens of the deleted documents."""
    uniform = 1 / (facts["retained_types"] + 1)

    def count(block: pa.Table, answers: pa.Table) -> pa.Table:
        g = grams(_unpack_documents(block.column("documents")[0].as_py()).column("text"))
        e = estimates(g, _answers(answers, "retained"), facts["retained_tokens"], facts["retained_texts"])
        code = (e.bucket * CELLS + _cell(e.bigram, uniform)) * CELLS + _cell(e.unigram, uniform)
        cell, n = np.unique(code, return_counts=True)
        return pa.table({"bucket": cell // CELLS**2, "bigram": cell // CELLS % CELLS, "unigram": cell % CELLS, "n": n})

    both = packed.where(F.col("role") == DELETED).select("block", "documents").groupBy("block").cogroup(
        answered.where(F.col("role") == DELETED).select("block", "range", "retained").groupBy("block")
    )
    return both.applyInArrow(count, "bucket long, bigram long, unigram long, n long").groupBy("bucket", "bigram", "unigram").agg(F.sum("n").alias("n"))


def scored(packed: DataFrame, answered: DataFrame, facts: dict[str, int], weights: np.ndarray) -> DataFrame:
    types, tokens, texts = facts["types"], facts["tokens"], facts["texts"]

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _unpack_documents(block.column("documents")[0].as_py())
        g = grams(docs.column("text"))
        seen = _answers(answers, "seen")
        e = estimates(g, seen, tokens, texts)
        w = weights[e.bucket]
        likely = w[:, 0] * e.bigram + w[:, 1] * e.unigram + w[:, 2] / (types + 1)
        by_text = lambda x: np.bincount(g.doc, weights=x, minlength=docs.num_rows)
        own = seen[g.word]
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_tokens": np.bincount(g.doc, minlength=docs.num_rows),
                "n_known": by_text(own > 0).astype(np.int64),
                "base_score": by_text(np.log10((own + 0.5) / (tokens + 0.5 * (types + 1)))),
                "score": by_text(np.log10(likely)),
            }
        )

    both = packed.select("block", "documents").groupBy("block").cogroup(answered.where("block is not null").select("block", "range", "seen").groupBy("block"))
    return both.applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, settings: Interpolation = Interpolation()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    staging = Staging(docs.sparkSession, "lm")
    packed = staging.write("blocks", blocks(docs, settings))
    size = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first().n
    bits = max(0, int(np.ceil(np.log2(max(1, size / settings.range_bytes)))))
    answered = staging.write("answers", totals(key_runs(packed, bits)))
    names = ("types", "tokens", "retained_types", "retained_tokens")
    row = answered.where("block is null").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    texts = {r.role: r.n for r in docs.groupBy(role().alias("role")).agg(F.count(F.lit(1)).alias("n")).collect()}
    facts = {n: row[n] for n in names} | {"texts": texts.get(RETAINED, 0) + texts.get(DELETED, 0), "retained_texts": texts.get(RETAINED, 0)}
    cells = deleted_cells(packed, answered, facts).toPandas()  # at most BUCKETS x CELLS x CELLS rows
    weights = mixture(cells[["bucket", "bigram", "unigram", "n"]].to_numpy(), settings.rounds)
    return scored(packed, answered, facts, weights).select(
        "doc_id", (crc_part("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(facts["tokens"]).cast("long").alias("train_tokens"), "base_score", "score"
    )
