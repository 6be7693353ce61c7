"""Which strings of a group contain one another: candidates from an index of character grams, then the exact test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 8


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.xxhash64(F.substring(c, i, n))))


def contained_either_way(texts: DataFrame, patterns: DataFrame, by: list[str], n: int = GRAM) -> DataFrame:
    """Distinct pairs ``(*by, text, pattern)`` of which one contains the other (equal ones once).

    ``texts(*by, text)`` and ``patterns(*by, pattern)`` are names, such as frames and classes. What contains a string has all
    its grams, so the contained side looks for one gram of its own, the one with the least hash, among all grams of the other
    side: a join on group and gram, which spreads the strings of a hot group. Strings of fewer than ``n`` characters, the
    empty one included, have no gram and are compared within their group. Null strings and groups match nothing.
    """
    texts = texts.select(*by, "text").distinct().where("text IS NOT NULL")
    patterns = patterns.select(*by, "pattern").distinct().where("pattern IS NOT NULL")
    parts = []
    for outer, inner, a, b in ((texts, patterns, "text", "pattern"), (patterns, texts, "pattern", "text")):
        test = F.contains(F.col(a), F.col(b)) if a == "text" else F.contains(F.col(a), F.col(b)) & (F.col(a) != F.col(b))
        indexed = outer.where(F.length(a) >= n).withColumn("_gram", F.explode(_grams(F.col(a), n)))
        probes = inner.where(F.length(b) >= n).withColumn("_gram", F.array_min(_grams(F.col(b), n)))
        parts.append(indexed.join(probes, [*by, "_gram"]).where(test).select(*by, "text", "pattern"))
        parts.append(outer.join(inner.where(F.length(b) < n), by).where(test).select(*by, "text", "pattern"))
    return reduce(DataFrame.unionByName, parts)
