"""Expressions over stack frames and thread names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.text import any_of, starts_with_any

REQUEST_PATH = r"\b" + any_of(fixed.HTTP_VERBS) + r"\s+(/\S*)"
REQUEST_START = r"\b" + any_of(fixed.HTTP_VERBS) + r"\s+/"
REQUEST_LINE = r"\b(" + any_of(fixed.HTTP_VERBS) + r")\s+(/[^\s?]*)"


def first_frame(frames: Column) -> Column:
    return F.coalesce(F.get(frames, F.lit(0)), F.lit(""))


def key_frame(frames: Column, jvm_prefixes: list[str]) -> Column:
    """First frame outside the JVM libraries, else the first frame, else ''."""
    own = F.filter(frames, lambda f: ~starts_with_any(f, jvm_prefixes))
    return F.coalesce(F.get(own, F.lit(0)), first_frame(frames))


def _segments(frame: Column) -> Column:
    return F.split(F.regexp_replace(frame, r"\(.*?\)$", ""), r"\.", -1)


def _last_capitalised(segments: Column) -> Column:
    """1-based position of the last segment that starts with A-Z, 0 when there is none."""
    marks = F.transform(segments, lambda s, i: F.when(s.rlike("^[A-Z]"), i + 1).otherwise(0))
    return F.coalesce(F.array_max(marks), F.lit(0))


def _join_first(segments: Column, n: Column) -> Column:
    return F.array_join(F.slice(segments, F.lit(1), F.greatest(n, F.lit(0))), ".")


def class_name(frame: Column) -> Column:
    seg = _segments(frame)
    cap = _last_capitalised(seg)
    return F.when(frame == "", F.lit("")).otherwise(_join_first(seg, F.when(cap > 0, cap).otherwise(F.size(seg) - 1)))


def package_name(frame: Column) -> Column:
    cls = class_name(frame)
    seg = F.split(cls, r"\.", -1)
    cap = _last_capitalised(seg)
    return F.when(frame == "", F.lit("")).when(cap > 0, _join_first(seg, cap - 1)).otherwise(cls)


def method_name(frame: Column) -> Column:
    return F.when(frame == "", F.lit("")).otherwise(F.element_at(_segments(frame), -1))


def request_url(name: Column) -> Column:
    """Path of the request line inside a thread name, null when there is none."""
    return F.nullif(F.regexp_extract(name, REQUEST_PATH, 1), F.lit(""))


def is_request(name: Column) -> Column:
    return name.rlike(REQUEST_START)


def url_pattern(frames: Column) -> Column:
    """``VERB /path`` of the first frame that holds one."""
    pattern = r"([A-Z]+)\s+(/[^\s]+)"
    found = F.filter(frames, lambda f: f.rlike(pattern))
    hit = F.get(found, F.lit(0))
    return F.concat_ws(" ", F.regexp_extract(hit, pattern, 1), F.regexp_extract(hit, pattern, 2))
