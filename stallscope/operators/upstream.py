"""Does a host lead to a known content network? CNAME records as data, no live lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.session import Staging


def known_provider(host: Column, suffixes: list[tuple[str, str]] = fixed.CDN_SUFFIXES) -> Column:
    """Provider of the first suffix the host equals or ends with; null when there is none.

    The list of suffixes is a fixed table, so the lookup is an expression and needs no join.
    """
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    out = F.lit(None).cast("string")
    for suffix, provider in reversed(suffixes):
        out = F.when((h == suffix) | h.endswith("." + suffix), provider).otherwise(out)
    return out


def suffix_candidates(host: Column) -> Column:
    """The host and every parent domain of it, for an equi-join against a suffix table of any size."""
    labels = F.split(F.regexp_replace(F.lower(host), r"\.$", ""), r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def match_suffixes(hosts: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Provider per host from a suffix table ``(suffix, provider, ord)``, lowest ``ord`` first.

    "Ends with a suffix" becomes equality with one of the few parent domains of the host.
    """
    pairs = hosts.select(host, F.explode(suffix_candidates(F.col(host))).alias("suffix"))
    hit = pairs.join(suffixes, ["suffix"])
    return hit.groupBy(host).agg(F.min_by("provider", "ord").alias("provider"))


def first_targets(cnames: DataFrame) -> DataFrame:
    """One row per host with its first target (least ``ord``, then the smaller target)."""
    least = cnames.groupBy("host").agg(F.min("ord").alias("ord"))
    return cnames.join(least, ["host", "ord"]).groupBy("host").agg(F.min("target").alias("target"))


def resolve_upstream(hosts: DataFrame, cnames: DataFrame, hops: int = fixed.MAX_CNAME_HOPS) -> DataFrame:
    """Walk the CNAME chain of every host: ``(hostname, chain, provider)`` for those that reach a known network.

    ``hosts(host)``, ``cnames(host, target, ord)``; the first target of a host is followed, at most
    ``hops`` steps. Each step is one join of the hosts still under way with the first targets, both tables;
    the walk ends when no host is under way.
    """
    staging = Staging(hosts.sparkSession, "upstream")
    first = staging.write("first", first_targets(cnames))
    walk = hosts.select(F.trim("host").alias("hostname")).where("hostname <> ''").distinct().select(
        "hostname",
        F.col("hostname").alias("current"),
        F.array().cast("array<string>").alias("chain"),
        known_provider(F.col("hostname")).alias("provider"),
    )
    step = first.select(F.col("host").alias("current"), F.col("target").alias("next"))
    steps = [staging.write("step-0", walk)]
    for n in range(1, hops):
        under_way = steps[-1].where("provider IS NULL")
        moved = under_way.join(step, "current").select(  # a host without a further record never matches
            "hostname", F.col("next").alias("current"), F.concat("chain", F.array("next")).alias("chain"), known_provider(F.col("next")).alias("provider")
        )
        steps.append(staging.write(f"step-{n}", moved))
        if steps[-1].where("provider IS NULL").isEmpty():
            break
    found = [s.where("provider IS NOT NULL").select("hostname", "chain", "provider") for s in steps]
    return reduce(DataFrame.unionByName, found)


# All hosts at once -----------------------------------------------------------------------------------


def _follow(rows: DataFrame, key: str, steps: DataFrame, hot_rows: int) -> DataFrame:
    """``rows`` with the columns of the one step whose ``host`` their ``key`` names; rows without a step go.

    A target that many hosts share would put all their rows into one task: keys of more than ``hot_rows`` rows are dealt
    to parts of about that many, and only their steps are repeated, once a part.
    """
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    hot = counted.where(F.col("_n") > hot_rows).select("_key", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, F.col(key) == F.col("_key"), "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int"))
    right = steps.join(hot, F.col("host") == F.col("_key"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    on = (F.col(f"l.{key}") == F.col("r.host")) & (F.col("l._part") == F.col("r._part"))
    taken = [F.col(f"r.{c}").alias(f"next_{c}") for c in steps.columns if c != "host"]
    return left.alias("l").join(right.alias("r"), on).select(*[F.col(f"l.{c}").alias(c) for c in rows.columns], *taken)


def jump_tables(first: DataFrame, staging: Staging, hops: int, hot_rows: int) -> list[DataFrame]:
    """Pointer doubling: table j leads from a host over 2^j records, or to the first known network before that.

    Rows ``(host, to, len, provider)``. Table j joins table j - 1 to itself, so that 4 rounds cover 10 hops. A host whose
    path ends without a known network has no row; one that comes back to itself is on a cycle and goes as well.
    """
    start = first.where(known_provider(F.col("host")).isNull()).select(
        "host", F.col("target").alias("to"), F.lit(1).alias("len"), known_provider(F.col("target")).alias("provider")
    )
    jumps = [staging.write("jump-0", start)]
    while 2 ** (len(jumps) - 1) < hops - 1:
        last = jumps[-1]
        under_way = last.where("provider IS NULL AND to <> host")
        if under_way.isEmpty():
            break
        moved = _follow(under_way, "to", last, hot_rows).select(
            "host", F.col("next_to").alias("to"), (F.col("len") + F.col("next_len")).alias("len"), F.col("next_provider").alias("provider")
        )
        jumps.append(staging.write(f"jump-{len(jumps)}", last.where("provider IS NOT NULL").unionByName(moved)))
    return jumps


def resolve_upstream_all(hosts: DataFrame, cnames: DataFrame, hops: int = fixed.MAX_CNAME_HOPS, hot_rows: int = 1_000_000) -> DataFrame:
    """The rows of :func:`resolve_upstream`, for host tables of about the size of the record table.

    Lengths and networks come from :func:`jump_tables`, without chains. Chains are rebuilt for the hosts that reach a known
    network only: one row per position, which takes the jumps of its binary digits. :func:`resolve_upstream` walks the asked
    hosts alone, one join a hop, and is the better one where they are few.
    """
    staging = Staging(hosts.sparkSession, "upstream-all")
    jumps = jump_tables(staging.write("first", first_targets(cnames)), staging, hops, hot_rows)
    asked = staging.write("asked", hosts.select(F.trim("host").alias("hostname")).where("hostname <> ''").distinct())
    own = known_provider(F.col("hostname"))
    known = asked.where(own.isNotNull()).select("hostname", F.array().cast("array<string>").alias("chain"), own.alias("provider"))
    reached = jumps[-1].where(F.col("provider").isNotNull() & (F.col("len") <= hops - 1)).select(F.col("host").alias("hostname"), "len", "provider")
    places = asked.join(reached, "hostname").select("hostname", "provider", F.explode(F.sequence(F.lit(1), "len")).alias("place"), F.col("hostname").alias("current"))
    places = staging.write("places", places)
    for j, jump in enumerate(jumps):
        takes = F.col("place").bitwiseAND(F.lit(1 << j)) != 0
        exact = jump.where(F.col("len") == 1 << j).select("host", "to")
        moved = _follow(places.where(takes), "current", exact, hot_rows).select("hostname", "provider", "place", F.col("next_to").alias("current"))
        places = staging.write(f"places-{j}", places.where(~takes).unionByName(moved))
    in_order = F.sort_array(F.collect_list(F.struct("place", "current")))
    chains = places.groupBy("hostname", "provider").agg(in_order.alias("c"))
    return known.unionByName(chains.select("hostname", F.col("c.current").alias("chain"), "provider"))
