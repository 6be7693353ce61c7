"""Token counts: pieces of each distinct pre-token counted once, joined to the documents' pre-token frequencies.

A sentencepiece BPE vocabulary in which no piece holds a space mark after another character, and none holds a
line feed, never merges across those places. A text is therefore cut there into pre-tokens, and its number of
tokens is the sum over its distinct pre-tokens of (frequency in the text) x (pieces of the pre-token). The
distinct pre-tokens of a slice of documents are encoded once, then looked up by each document; no list of token
ids of a text is ever made. Nothing is shuffled, and a task holds one slice and a bounded table of counts.

Nulls and empty texts have 0 tokens. Rows stay as they are (repeated rows are counted each); other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stallscope.llm.common import slices

MODEL = "piece_bpe_32k.model"
MARK = "▁"  # the vocabulary's sign for a space
PRE_TOKEN = re.compile(f"[ {MARK}]+[^ {MARK}\n]*|[^ {MARK}\n]+|\n")
#: Pre-tokens whose counts a task remembers; beyond it the table starts anew, which costs time only.
REMEMBERED = 200_000


def load(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def check_cuts(processor) -> None:
    """Raise unless pieces respect the places where texts are cut."""
    for i in range(processor.get_piece_size()):
        piece = processor.id_to_piece(i)
        if "\n" in piece or MARK in piece.lstrip(MARK):
            raise ValueError(f"piece {piece!r} spans two pre-tokens; this vocabulary can't be counted by pre-token")


def pre_tokens(text: str) -> Counter:
    """Frequencies of the pre-tokens of a text; the library puts one space mark before a text that isn't empty."""
    return Counter(PRE_TOKEN.findall(MARK + text)) if text else Counter()


def pieces(processor, distinct: list[str]) -> list[int]:
    """Pieces of each pre-token. The line feed keeps the library's own space mark apart: it makes two pieces more."""
    return [len(ids) - 2 for ids in processor.encode(["\n" + x for x in distinct], num_threads=1)]


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, known = load(model), {}
        for part in slices(batches, "text"):
            frequencies = [pre_tokens(t or "") for t in part.column("text").to_pylist()]
            new = list({x for f in frequencies for x in f if x not in known})
            if len(known) + len(new) > REMEMBERED:
                known, new = {}, list({x for f in frequencies for x in f})
            known.update(zip(new, pieces(processor, new), strict=True))
            n = pa.array([sum(k * known[x] for x, k in f.items()) for f in frequencies], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64()), n, pc.greater(n, limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    check_cuts(load(model))
    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
