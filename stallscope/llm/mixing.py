"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Targets. A source's share of the mix follows its weight, but stops at ``repeats`` times its size; the excess
   is shared again by weight among the others, until none is above (``targets``).
2. Blocks. A hash deals each source's documents into blocks of about ``block_size``. A source with a target above
   its size takes all blocks once for every whole pass, and a part of them once more. Blocks are taken in a
   permuted order (by a hash of source, pass and block); one that doesn't fit is skipped. Where the small documents
   of the skipped blocks can't fill the gap, skipped blocks with large ones are placed first. The gap that is left is
   filled with documents of the skipped blocks, ``edge_blocks`` of a source at a time, until none of them fits.
3. Splitting tree. The taken blocks of each source are an exact quota. A binary tree splits the quotas of all
   sources among the output shards: at each node the left half's share of every source is one multivariate
   hypergeometric draw, so each shard gets the blocks of a random partition without anybody drawing block by
   block. A shard then owns a run of each source's permuted blocks; runs of different shards are disjoint.
4. Inside a shard, documents are ordered by a hash.

All draws come from ``seed`` and from keys, never from row order, so reruns agree. The driver holds the
sources' sizes and the quotas of sources x shards. Sources are a key of the configuration, as weights are given
for each; ``max_sources`` states the bound, and more of them raise an error.

Nulls: a null source is a source (last in order), a null text has size 0, a null document number counts as one
more key. Documents of size 0 are never needed for a target and are taken with their block. Repeated rows are
documents of their own, and those of the same number are taken together. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.llm.common import WORD
from stallscope.session import Staging


SMALL = 0.001  # of a target: documents up to this size bring a source as near to it


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by the place of the source in code-point order, repeating
    total: float = 1.5  # size of the mix as a share of all sizes
    repeats: float = 2.0  # most a source, and a document, is taken
    shard_size: int = 16_000_000  # of the mix; the number of shards is the next power of two
    shard_parts: int = 16  # partitions of a shard
    block_size: int = 250_000  # of documents of one source ...
    least_blocks: int = 512  # ... of which it has this many at least, or one for each document
    edge_blocks: int = 16  # blocks of a source whose documents fill the last gap to the target at once
    seed: int = 20
    max_sources: int = 100_000


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, repeats: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``repeats`` x size, the excess shared again by weight."""
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    left = total
    while open_:
        share = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] > repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = repeats * sizes[i]
        left -= sum(out[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows): exact column sums, shards of equal size but for one block."""
    level = [quotas.astype(np.int64)]
    depth = 0
    while len(level) < shards:
        below = []
        for node, q in enumerate(level):
            draw = np.random.default_rng([seed, depth, node])
            left = draw.multivariate_hypergeometric(q, int(q.sum()) // 2, method="marginals") if q.sum() else q
            below += [left, q - left]
        level, depth = below, depth + 1
    return np.vstack(level)


def _hash(seed: int, *keys: Column) -> Column:
    return F.xxhash64(F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\x00null")) for k in keys])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _same(*names: str) -> list[Column]:
    return [F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) for n in names]


def fitting(size: np.ndarray, order: np.ndarray, need: float) -> tuple[np.ndarray, float]:
    """Of ``order``, what fits one after another into ``need``, going on past what doesn't; and what is left."""
    taken, left = [order[:0]], need
    while len(order := order[size[order] <= left]):
        upto = np.cumsum(size[order])
        n = np.searchsorted(upto, left, side="right")
        taken.append(order[:n])
        left -= float(upto[n - 1])
        order = order[n:][size[order[n:]] > 0]
    return np.concatenate(taken), left


def choose(size: np.ndarray, small: np.ndarray, need: float) -> tuple[np.ndarray, float]:
    """Blocks for ``need``, in order, and what is left: a part that the small documents of the other blocks (``small`` is
    their size) fill, if any order with large blocks first leads there."""
    every = np.arange(len(size))
    best = fitting(size, every, need)
    miss = lambda x: x[1] - (small.sum() - small[x[0]].sum())
    front: list[int] = []
    for block in np.setdiff1d(np.flatnonzero(size <= need), best[0]):
        if miss(best) <= need * SMALL:
            break
        first = [*front, block]
        if size[first].sum() <= need:
            trial = fitting(size, np.r_[first, np.delete(every, first)], need)
            if miss(trial) < miss(best):
                best, front = trial, first
    return best


def _choose(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one source and pass by rank: those taken, then at the edge the others in permuted order."""
    blocks = blocks.sort_values(["key", "block"], ignore_index=True)
    taken, left = choose(blocks["size"].to_numpy(), blocks["small"].to_numpy(), float(blocks["need"].iloc[0]))
    blocks = blocks.iloc[np.r_[taken, np.setdiff1d(np.arange(len(blocks)), taken)].astype(int)]
    rank = np.arange(len(blocks))
    return blocks.assign(rank=rank, at_edge=rank >= len(taken), opens=rank == len(taken), need=left)[["source", "block", "pass", "rank", "at_edge", "opens", "need", "least"]]


def _fill(edge: pd.DataFrame) -> pd.DataFrame:
    """Of the documents at one source's edge, in permuted order, those that still fit, and the smallest that doesn't.
    Rows of one number go together."""
    docs = edge.groupby(["key", "doc_id"], dropna=False, as_index=False)["size"].sum().sort_values(["key", "doc_id"], ignore_index=True)
    taken, left = fitting(docs["size"].to_numpy(), np.arange(len(docs)), float(edge["need"].iloc[0]))
    beyond = docs[docs["size"] > 0].drop(index=taken, errors="ignore").sort_values(["size", "key"]).iloc[:1]
    out = pd.concat([docs.loc[taken].assign(fits=True), beyond.assign(fits=False)])
    return out.assign(source=edge["source"].iloc[0], need=left, rank=edge["rank"].max())[["source", "doc_id", "size", "fits", "need", "rank"]]


def plan_mix(sized: DataFrame, mix: Mix, staging: Staging) -> DataFrame:
    """Per row of ``sized`` (doc_id, source, size): source_size, target, and copies as an array of shards.

    ``sized`` should be a staged table: it is read three times, and once more for every further turn of the edge.
    """
    spark = sized.sparkSession
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).limit(mix.max_sources + 1).collect()
    if len(rows) > mix.max_sources:
        raise ValueError(f"more than {mix.max_sources} sources")
    rows = sorted(rows, key=lambda r: (r.source is None, r.source or ""))
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(rows))]
    total = mix.total * sum(r["size"] for r in rows)
    wanted = targets([r["size"] for r in rows], weights, total, mix.repeats)
    blocks = [max(1, min(r.docs, max(mix.least_blocks, -(-r["size"] // mix.block_size)))) for r in rows]
    sources = spark.createDataFrame(
        [(r.source, int(r["size"]), float(t), int(b)) for r, t, b in zip(rows, wanted, blocks, strict=True)], "source string, source_size long, target double, blocks long"
    )
    # The table of sources is bounded by max_sources.
    known = sized.alias("l").join(F.broadcast(sources.alias("r")), _same("source")).select("l.*", "r.source_size", "r.target", "r.blocks")
    dealt = known.withColumn("block", F.pmod(_hash(mix.seed, F.col("source"), F.col("doc_id")), F.col("blocks"))).drop("blocks")

    # Blocks in permuted order, one row for each pass; those that are not taken are the edge.
    small, some = F.when(F.col("size") <= F.col("target") * SMALL, F.col("size")).otherwise(0), F.when(F.col("size") > 0, F.col("size"))
    by_block = dealt.groupBy("source", "block", "source_size", "target").agg(F.sum("size").alias("size"), F.sum(small).alias("small"), F.min(some).alias("least"))
    last_pass = F.greatest(F.lit(0), F.ceil(F.col("target") / F.greatest("source_size", F.lit(1))) - 1)
    passes = by_block.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), last_pass))).withColumn("need", F.col("target") - F.col("pass") * F.col("source_size"))
    ordered = passes.where("need > 0").withColumn("key", _hash(mix.seed + 1, F.col("source"), F.col("block"), F.col("pass")))
    ranks = "source string, block long, pass long, rank long, at_edge boolean, opens boolean, need double, least long"
    taken = staging.write("taken", ordered.groupBy("source", "pass").applyInPandas(_choose, ranks))

    # Exact quotas (the edge counts as one block), the splitting tree, and each shard's run of each source's blocks.
    placed_blocks = taken.where(~F.col("at_edge") | F.col("opens"))
    quotas = sorted(placed_blocks.groupBy("source", "pass").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda q: (q.source is None, q.source or "", q["pass"]))
    shards = 1 << max(0, int(np.ceil(np.log2(max(1.0, total / mix.shard_size)))))
    split = split_quotas(np.array([q.n for q in quotas], np.int64), shards, mix.seed)
    shard, key = np.nonzero(split)
    first = (split.cumsum(axis=0) - split)[shard, key]
    runs = spark.createDataFrame(
        pd.DataFrame({"source": [quotas[k].source for k in key], "pass": [quotas[k]["pass"] for k in key], "shard": shard, "first": first, "n": split[shard, key]}),
        "source string, pass long, shard int, first long, n long",
    ).select("source", "pass", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("rank"))
    placed = placed_blocks.alias("l").join(runs.alias("r"), _same("source", "pass", "rank")).select("l.source", "l.block", "l.pass", "l.at_edge", "r.shard")
    whole = placed.where("not at_edge").groupBy("source", "block").agg(F.array_sort(F.collect_list("shard")).alias("copies"))

    # The edge, a source has one at most: what still fits of the documents of a few blocks, then of the next that hold one
    # that fits, until there is none; and one more document where that ends nearer the target.
    at_edge, filled = taken.where("at_edge and least is not null"), []
    near = at_edge
    while True:
        turn = F.row_number().over(Window.partitionBy("source").orderBy("rank"))
        near = near.select("source", "block", "need", "rank").withColumn("turn", turn).where(F.col("turn") <= mix.edge_blocks)
        edge = dealt.alias("l").join(near.alias("r"), _same("source", "block"))
        edge = edge.select(F.col("l.doc_id").cast("string"), "l.source", "l.size", "r.need", "r.rank", _hash(mix.seed + 2, F.col("l.source"), F.col("l.doc_id")).alias("key"))
        fits = edge.groupBy("source").applyInPandas(_fill, "source string, doc_id string, size long, fits boolean, need double, rank long")
        filled.append(staging.write(f"filled{len(filled)}", fits))
        state = filled[-1].groupBy("source").agg(F.min("need").alias("need"), F.max("rank").alias("rank"))
        near = at_edge.alias("l").join(state.alias("r"), [*_same("source"), F.col("l.rank") > F.col("r.rank"), F.col("l.least") <= F.col("r.need")])
        near = near.select("l.source", "l.block", "r.need", "l.rank")
        if near.isEmpty():
            break
    fits = reduce(DataFrame.unionByName, filled)
    last = fits.groupBy("source").agg(F.min("need").alias("need"), F.min_by(F.struct("doc_id", "size"), F.when(~F.col("fits"), F.struct("size", "doc_id"))).alias("more"))
    more = last.where(F.col("more.size") < 2 * F.col("need")).select("source", "more.doc_id")
    some = fits.where("fits").select("source", "doc_id").unionByName(more).withColumn("doc_id", F.col("doc_id").cast("long"))
    some = some.alias("l").join(F.broadcast(placed.where("at_edge").limit(mix.max_sources)).alias("r"), _same("source")).select("l.source", "l.doc_id", "r.shard")

    full = dealt.alias("l").join(whole.alias("r"), _same("source", "block"), "left").select("l.*", F.coalesce("r.copies", F.array().cast("array<int>")).alias("copies"))
    both = full.alias("l").join(some.alias("r"), _same("source", "doc_id"), "left")
    copies = F.when(F.col("r.shard").isNull(), F.col("l.copies")).otherwise(F.concat(F.col("l.copies"), F.array("r.shard")))
    return both.select("l.doc_id", "l.source", "l.size", "l.source_size", "l.target", copies.alias("copies"))


def sized_documents(docs: DataFrame, size: Callable[[Column], Column] = word_count) -> DataFrame:
    return docs.select("doc_id", "source", size(F.col("text")).alias("size"))


def mix_report(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken (size x copies) of every document."""
    staging = Staging(docs.sparkSession, "mix")
    planned = plan_mix(staging.write("sized", sized_documents(docs)), mix, staging)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("copies")).alias("taken"))


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixed corpus: a row for each copy of each document taken, with its shard, in shuffled order in each shard.

    A shard is ordered by a hash of document and copy. Its rows lie in ``shard_parts`` partitions, each an equal range of
    that hash, so a task sorts a part of a shard only. ``mix_copy`` and ``mix_shard`` follow the columns of ``docs``
    and take the place of columns of these names.
    """
    staging = Staging(docs.sparkSession, "mix")
    planned = plan_mix(staging.write("sized", sized_documents(docs)), mix, staging)
    # Rows of one number and source share their copies; repeated rows must not multiply each other.
    copies = planned.where(F.size("copies") > 0).groupBy("doc_id", "source").agg(F.first("copies").alias("_copies"))
    joined = docs.alias("l").join(copies.alias("r"), _same("doc_id", "source"))
    own = [F.col(f"l.`{c}`") for c in docs.columns if c.lower() not in ("mix_copy", "mix_shard")]
    rows = joined.select(*own, F.posexplode("r._copies").alias("mix_copy", "mix_shard"))
    place = _hash(mix.seed + 3, F.col("doc_id"), F.col("mix_copy"))
    part = F.floor((F.shiftright(place, 32) + (1 << 31)) * mix.shard_parts / (1 << 32)).cast("int")
    return rows.repartition("mix_shard", part).sortWithinPartitions("mix_shard", place)
