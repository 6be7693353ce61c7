"""MinHash near-duplicates with odd sketches.

A document's set is its distinct word shingles (as 64-bit hashes); documents with
100 * intersection >= ``percent`` * union are linked, and the connected groups are the result. Steps:

1. Signatures: ``bands`` x ``rows`` MinHash values, one key for each band, and an odd sketch: every (function,
   value) pair flips one of 512 bits, so the XOR of two sketches holds the parity of the samples in which the
   documents differ. With z bits set in it, similarity is about 1 + 512 / (4 k) ln(1 - 2 z / 512).
2. Classes: documents of the same set are one class, represented by the smallest number. Everything below works on
   representatives, so copies cost one row each.
3. Star round: in each bucket (documents that share a band key) every member is paired with the smallest number.
   Pairs whose sketches can't reach ``percent`` are dropped (``slack`` standard deviations are left). The others are
   confirmed on their full sets; confirmed links give components, and all close pairs together give clusters.
4. Buckets that hold several clusters: members outside the bucket's largest cluster are compared with those of
   other clusters by sketch, inside the join. One close pair joins two clusters; the others add nothing to step 5.
5. Clusters that hold several components (near copies a little under the threshold): members outside the largest
   component are compared with all members on full sets, block by block as matrix products; only links leave a
   block. Components are joined up.

So every two close members of a bucket end in one cluster, and all of a cluster is compared or linked already; no
group's pairs are ever rows. Two documents at the threshold miss all buckets with probability (1 - 0.8^rows)^bands
= 3e-6, and one pair is lost to the sketch with about 2e-8 (5.5 deviations). Joins of tables that grow with the
corpus are sort-merge joins at every size, which Spark splits where a key is frequent.

A document with fewer words than a shingle has the whole sequence as its only shingle. Without words or text the
set is empty and linked with nothing. Rows of the same number are one document; a null number is linked but can't
represent a group. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import hash_words, mix64, shingle_hashes, slices, words_of
from stallscope.llm.components import components
from stallscope.session import Staging

BITS = 512
LONGS = BITS // 64
SKETCH = [f"s{i}" for i in range(LONGS)]
BLOCK = 150_000  # shingles of each side of a block
CELLS = 8_000_000  # of a matrix


@dataclass(frozen=True)
class Near:
    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    slack: float = 5.5
    seed: int = 6

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    @property
    def most_bits(self) -> int:
        """Bits that may differ between the sketches of two documents at the threshold."""
        j = self.percent / 100
        differ = 2 * self.samples * (1 - j)
        mean = BITS / 2 * (1 - math.exp(-2 * differ / BITS))
        fold = BITS / 4 * (1 - math.exp(-4 * differ / BITS))  # variance of the folding, then of the sampling
        sample = 4 * self.samples * j * (1 - j) * math.exp(-4 * differ / BITS)
        return math.ceil(mean + self.slack * math.sqrt(fold + sample))


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles of each text, ordered by both."""
    rows, words = words_of(texts)
    at, shingles = shingle_hashes(rows, hash_words(words), size)
    order = np.lexsort((shingles, at))
    at, shingles = at[order], shingles[order]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (shingles[1:] != shingles[:-1])
    return at[new], shingles[new]


def min_hashes(at: np.ndarray, shingles: np.ndarray, near: Near) -> np.ndarray:
    """Smallest value of every hash function (columns) over each row's shingles (``at`` is ordered)."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    draw = np.random.default_rng(near.seed)
    odd = draw.integers(0, 2**63, near.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = draw.integers(0, 2**63, near.samples, dtype=np.uint64)
    out = np.empty((len(first), near.samples), np.uint32)
    for i in range(near.samples):
        out[:, i] = np.minimum.reduceat(((shingles * odd[i] + add[i]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def band_keys(values: np.ndarray, near: Near) -> np.ndarray:
    keys = np.empty((len(values), near.bands), np.uint64)
    for b in range(near.bands):
        key = np.full(len(values), b + 1, np.uint64)
        for v in values[:, b * near.rows : (b + 1) * near.rows].T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + v.astype(np.uint64))
        keys[:, b] = key
    return keys


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    out = np.zeros((len(values), LONGS), np.uint64)
    here = np.arange(len(values))
    for i, v in enumerate(values.T):
        bit = mix64(v.astype(np.uint64) | np.uint64((i + 1) << 32)) % np.uint64(BITS)
        out[here, (bit // np.uint64(64)).astype(np.int64)] ^= np.uint64(1) << (bit % np.uint64(64))
    return out


def signatures(docs: DataFrame, near: Near) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (which name the set), bands, and the sketch s0..s7 of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = lambda x: pa.array(x.view(np.int64))
        for part in slices(batches, "text"):
            at, shingles = shingle_sets(part.column("text"), near.shingle)
            n = np.bincount(at, minlength=part.num_rows).astype(np.int64)
            full = np.flatnonzero(n)
            sums, xors = np.zeros(part.num_rows, np.uint64), np.zeros(part.num_rows, np.uint64)
            bands = np.zeros((part.num_rows, near.bands), np.uint64)
            sketch = np.zeros((part.num_rows, LONGS), np.uint64)
            if len(at):
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                sums[full] = np.add.reduceat(mix64(shingles), first)
                xors[full] = np.bitwise_xor.reduceat(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)), first)
                values = min_hashes(at, shingles, near)
                bands[full], sketch[full] = band_keys(values, near), odd_sketches(values)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * near.bands), longs(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), longs(sums), longs(xors), listed, *[longs(np.ascontiguousarray(s)) for s in sketch.T]],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands", *SKETCH],
            )

    schema = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return docs.select("doc_id", "text").mapInArrow(sign, schema)


def may_reach(near: Near, a: str, b: str) -> Column:
    """Whether two signatures leave room for the threshold: by their sizes, and by the bits in which sketches differ."""
    n, m = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH])
    return (100 * F.least(n, m) >= near.percent * F.greatest(n, m)) & (differ <= near.most_bits)


def full_sets(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """rep and its set (sorted hashes, 8 bytes each) of the documents in ``ids`` (rep)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            at, shingles = shingle_sets(part.column("text"), near.shingle)
            ends = np.searchsorted(at, np.arange(part.num_rows + 1))
            sets = [shingles[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(sets, pa.binary())], ["rep", "set"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(ids.hint("merge"), "rep", "left_semi")
    return texts.mapInArrow(cut, "rep long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Those of the pairs (a, b) whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            linked = []
            for one, two in zip(part.column("set_a"), part.column("set_b"), strict=True):
                x, y = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= near.percent * (len(x) + len(y) - both) > 0)
            yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    one, two = sets.select(F.col("rep").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("rep").alias("b"), F.col("set").alias("set_b"))
    joined = pairs.hint("merge").join(one, "a").hint("merge").join(two, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(check, "a long, b long")


def _matrix(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(columns)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(columns, s)
        at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == s)] if len(columns) else at[:0]
        out[i, at] = 1
    return out


def block_links(x: list[np.ndarray], x_component: np.ndarray, y: list[np.ndarray], y_component: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Of every x, one linked y in each other component that has any: (place of x, place of y).

    Intersections of all x and y are one product of 0/1 matrices over the shingles that occur on both sides.
    """
    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    if not len(shared):
        return []
    out, rows = [], max(1, CELLS // len(shared))
    sizes_y = np.array([len(s) for s in y])
    for b in range(0, len(y), rows):
        right = _matrix(y[b : b + rows], shared).T
        for a in range(0, len(x), rows):
            left = x[a : a + rows]
            both = _matrix(left, shared) @ right
            union = np.array([len(s) for s in left])[:, None] + sizes_y[None, b : b + rows] - both
            hit = (100 * both >= near.percent * union) & (x_component[a : a + rows, None] != y_component[None, b : b + rows])
            for i in np.flatnonzero(hit.any(axis=1)):
                at = np.flatnonzero(hit[i])
                _, first = np.unique(y_component[b + at], return_index=True)
                out += [(a + int(i), b + int(at[k])) for k in first]
    return out


def cross_links(clusters: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between different components inside a cluster; ``clusters``: rep, n_shingles, cluster, component.

    Members outside a cluster's largest component are compared with all its members, block by block. Blocks hold
    about ``BLOCK`` shingles, so a task's size doesn't depend on the cluster's, and only links leave it.
    """
    share = clusters.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("shingles"))
    size = share.groupBy("cluster").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("components"), F.sum("shingles").alias("all")).where("components > 1")
    main = share.join(size, "cluster").where("n = most").groupBy("cluster", "all").agg(F.min("component").alias("main"), F.max("shingles").alias("_m"))
    main = main.join(share.select("cluster", F.col("component").alias("main"), F.col("shingles").alias("in_main")), ["cluster", "main"])
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    plan = main.select("cluster", "main", blocks(F.col("all")).alias("n_y"), blocks(F.col("all") - F.col("in_main")).alias("n_x"))
    rows = clusters.join(plan, "cluster").hint("merge").join(sets, "rep")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = rows.where("component <> main").select("cluster", own("n_x").alias("i"), each("n_y").alias("j"), F.lit(True).alias("is_x"), "rep", "component", "set")
    right = rows.select("cluster", each("n_x").alias("i"), own("n_y").alias("j"), F.lit(False).alias("is_x"), "rep", "component", "set")

    def compare(part: pa.Table) -> pa.Table:
        rep, component = part.column("rep").to_numpy(), part.column("component").to_numpy()
        sets = [np.frombuffer(b.as_buffer(), np.uint64) for b in part.column("set")]
        is_x = part.column("is_x").to_numpy()
        x, y = np.flatnonzero(is_x), np.flatnonzero(~is_x)
        found = block_links([sets[k] for k in x], component[x], [sets[k] for k in y], component[y], near) if len(x) and len(y) else []
        a, b = rep[x[[i for i, _ in found]]] if found else rep[:0], rep[y[[k for _, k in found]]] if found else rep[:0]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return left.union(right).groupBy("cluster", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest number of its group) and kept (it is that number) of every row."""
    staging = Staging(docs.sparkSession, "near")
    signed = staging.write("signatures", signatures(docs, near))
    full = signed.where("n_shingles > 0")
    classes = staging.write("classes", full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")))
    reps = full.join(classes.where("rep is not null").withColumnRenamed("rep", "doc_id").hint("merge"), ["set_a", "set_b", "doc_id"], "left_semi")
    known = staging.write("known", reps.select(F.col("doc_id").alias("rep"), "n_shingles", *SKETCH, "bands"))
    members = known.select(F.explode("bands").alias("band"), "rep")
    known = known.drop("bands")

    # Star round: every member of a bucket against its smallest number.
    buckets = members.groupBy("band").agg(F.min("rep").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = staging.write("shared", members.hint("merge").join(buckets, "band"))
    sets = staging.write("sets", full_sets(docs, shared.select("rep").distinct(), near))
    pairs = shared.where("rep <> centre").select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct()
    close = pairs.hint("merge").join(known.alias("l"), F.col("a") == F.col("l.rep")).hint("merge").join(known.alias("r"), F.col("b") == F.col("r.rep"))
    close = staging.write("close", close.where(may_reach(near, "l", "r")).select("a", "b").distinct())
    links = staging.write("links", confirm(close, sets, near))
    clusters = components(close, staging, "clusters")

    # Buckets that hold several clusters: sketches across them are compared inside the join.
    placed = shared.select("band", "rep").hint("merge").join(clusters.withColumnRenamed("id", "rep"), "rep", "left").select("band", "rep", F.coalesce("component", "rep").alias("cluster"))
    placed = staging.write("placed", placed)
    share = placed.groupBy("band", "cluster").agg(F.count(F.lit(1)).alias("n"))
    size = share.groupBy("band").agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("clusters")).where("clusters > 1")
    main = share.join(size, "band").where("n = most").groupBy("band").agg(F.min("cluster").alias("main"))
    rest = staging.write("rest", placed.hint("merge").join(main, "band").hint("merge").join(known, "rep"))
    across = (F.col("l.band") == F.col("r.band")) & (F.col("l.cluster") != F.col("r.cluster")) & ((F.col("r.cluster") == F.col("r.main")) | (F.col("l.rep") < F.col("r.rep")))
    more = rest.where("cluster <> main").alias("l").hint("merge").join(rest.alias("r"), across & may_reach(near, "l", "r"))
    more = staging.write("more", more.select(F.least("l.cluster", "r.cluster").alias("a"), F.greatest("l.cluster", "r.cluster").alias("b")).distinct())
    staging.drop("shared", "placed", "rest")
    if not more.isEmpty():
        clusters = components(close.union(more), staging, "all-clusters")

    # Clusters that hold several components: compared whole, block by block.
    groups = components(links, staging, "groups")
    named = clusters.withColumnRenamed("component", "cluster").hint("merge").join(groups, "id", "left").select(F.col("id").alias("rep"), "cluster", F.coalesce("component", "id").alias("component"))
    inside = staging.write("inside", named.hint("merge").join(known.select("rep", "n_shingles"), "rep").distinct())
    found = staging.write("found", cross_links(inside, sets, near))
    if not found.isEmpty():
        groups = components(links.union(found), staging, "all-groups")
    staging.drop("sets", "close", "inside")

    of_rows = signed.select("doc_id", "n_shingles", "set_a", "set_b").hint("merge").join(classes, ["set_a", "set_b"], "left")
    rep = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    final = of_rows.select("doc_id", "n_shingles", rep.alias("id")).hint("merge").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return final.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
