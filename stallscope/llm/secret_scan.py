"""Secret scans: three exact patterns, and dictionary-primed zstandard novelty for strings in sensitive places.

``assign``, ``access`` and ``hex`` are plain patterns. ``novel`` spans come from compression: a long run of
key characters after a word such as "key" or "auth" is compressed together with the text around it, by a
compressor primed with the corpus's own identifier parts. The bytes that the run adds, per character, are its
novelty: identifiers and words shared with the dictionary or the surroundings cost little, random strings cost
nearly their entropy.

The identifier dictionary covers the whole text of all documents: identifiers and their parts (words of camel, snake and
kebab case), by the number of documents that hold them outside candidates, plus the distinct candidates that hold a
part (so a secret in copies of a document raises nothing), and of these the ``DICTIONARY_PARTS`` most frequent. That is
a bounded report; candidates themselves are never cut. A string is an identifier if it is nearly all words.

Null texts count as empty. Rows stay as they are; other columns are ignored. Positions are code points, end
exclusive; spans are ordered by start, then kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import slices

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # a run of fewer characters fails as a whole, so the length may stand here
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"(?ai:secret|token|passw|pwd|(?:api|access|private|signing|encryption|ssh)[\x20_-]?key|credential|bearer|auth|signature)[^\n]{0,24}[\x20:=\"']$"
)
BEFORE = 48  # characters searched for a sensitive word
AROUND = 400  # characters on each side that prime the measure
LEVEL = 6
NOVELTY = 0.72  # bytes added per character
DICTIONARY_PARTS = 4000
PART = r"[A-Z][a-z]{3,63}|[a-z]{4,64}|[A-Z]{4,64}(?![a-z])"
PARTS = re.compile(PART)
IDENTIFIER = re.compile(r"[A-Za-z0-9_-]{6,}")
IN_PARTS = 0.8  # of an identifier's letters and digits, at least
LONGEST = 128  # characters; a longer identifier counts by its parts only
COUNTED = 100_000  # parts counted in a task before they are handed on

SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, place of the kind, end) of the three patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters close behind a sensitive word on the same line."""
    return [(m.start(), m.end()) for m in CANDIDATE.finditer(text) if SENSITIVE.search(text[max(0, m.start() - BEFORE) : m.start()])]


class Novelty:
    """Marginal compressed bytes per character, given identifiers and surroundings."""

    def __init__(self, identifiers: list[str]) -> None:
        import zstandard

        primer = " ".join(reversed(identifiers)).encode()  # the most frequent last, where references to them are shortest
        given = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
        if given:
            given.precompute_compress(level=LEVEL)
        options = {"dict_data": given} if given else {"level": LEVEL}
        self.compressor = zstandard.ZstdCompressor(write_checksum=False, write_content_size=False, **options)

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        size = lambda s: len(self.compressor.compress(s.encode("utf-8", "surrogatepass")))
        return (size(before + after + text[start:end]) - size(before + after)) / (end - start)


def spans(text: str, novelty: Novelty) -> list[tuple[int, int, str]]:
    """All spans; a candidate that a pattern has found already isn't reported twice."""
    found = base_spans(text)
    free = [c for c in candidates(text) if all(c[1] <= s or c[0] >= e for s, _, e in found)]
    return sorted(found + [(s, 3, e) for s, e in free if novelty(text, s, e) >= NOVELTY])


@lru_cache(1 << 16)
def _known_as(run: str) -> tuple[str, ...]:
    parts = PARTS.findall(run)
    if len(parts) < 2 and len(run) < 16 or sum(map(len, parts)) < IN_PARTS * (len(run) - run.count("_") - run.count("-")):
        return ()
    return (*parts, run.strip("_-")) if len(run) <= LONGEST else tuple(parts)


def identifiers(text: str) -> set[str]:
    """The identifiers of a text and their parts."""
    out: set[str] = set()
    for run in set(IDENTIFIER.findall(text)):
        out.update(_known_as(run) if len(run) <= LONGEST else _known_as.__wrapped__(run))
    return out


def identifier_parts(docs: DataFrame) -> DataFrame:
    """part, n: identifiers and their parts, by the documents that hold them outside candidates and the distinct candidates that hold them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[str] = set()
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            values = [pa.array([*found, *seen], pa.string()), pa.array([True] * len(found) + [False] * len(seen)), pa.array([1] * len(found) + list(seen.values()), pa.int64())]
            found.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(values, ["value", "candidate", "n"])

        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                at = candidates(text or "")
                found.update(text[s:e] for s, e in at)
                seen.update(identifiers(masked(text or "", at, " ")))
            if len(seen) > COUNTED:
                yield rows()
        yield rows()

    once = docs.select("text").mapInArrow(count, "value string, candidate boolean, n long").groupBy("candidate", "value").agg(F.sum("n").alias("n"))
    held = F.when(F.col("candidate"), F.array_distinct(F.regexp_extract_all("value", F.lit(PART), F.lit(0)))).otherwise(F.array("value"))
    parts = once.select(F.explode(held).alias("part"), F.when(F.col("candidate"), 1).otherwise(F.col("n")).alias("n"))
    return parts.groupBy("part").agg(F.sum("n").alias("n"))


def identifier_dictionary(docs: DataFrame, size: int = DICTIONARY_PARTS) -> list[str]:
    """The ``size`` most frequent identifiers and parts that occur twice at least, most frequent first."""
    top = identifier_parts(docs).where("n >= 2").orderBy(F.desc("n"), "part").limit(size)
    return [r.part for r in top.collect()]


def find_secrets(docs: DataFrame, identifiers: list[str] | None = None) -> DataFrame:
    """doc_id and spans (kind, start, end) of every row."""
    known = identifier_dictionary(docs) if identifiers is None else identifiers

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in slices(batches, "text"):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t or "", novelty)] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id long, spans {SPAN}")


def span_digest(found: DataFrame) -> DataFrame:
    """Per row of ``find_secrets``: counts by kind, digest of the pattern spans, all spans as text."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "novel"), line), ",")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"),
        F.array_join(F.transform("spans", line), ",").alias("spans"), count("novel"),
    )


def masked(text: str, found: list[tuple[int, int]], mask: str) -> str:
    """The text with every span (overlapping ones together) replaced."""
    out, at = [], 0
    for start, end in sorted(found):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, mask: str = "[secret]", identifiers: list[str] | None = None) -> DataFrame:
    """The documents with every reported span replaced by ``mask``; a null text stays null, other columns stay."""
    known = identifier_dictionary(docs) if identifiers is None else identifiers

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for part in slices(batches, "text"):
            texts = [t and masked(t, [(s, e) for s, _, e in spans(t, novelty)], mask) for t in part.column("text").to_pylist()]
            yield part.set_column(part.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(clean, docs.schema)


