"""The untyped record of an event: a map of keys to texts, whatever the shape of its JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.functions.text import strip

KV_ENTRY = r"^([A-Za-z0-9_.-]+):\s?(?s:(.*))$"
ENTRY = "struct<key:string,value:variant>"
MEMBER = "named_struct('key', concat(e.key, '.', x.key), 'value', x.value)"


def members(v: str) -> str:
    """SQL: the members of a variant as entries; null where it is no object."""
    return f"map_entries(CAST(CASE WHEN schema_of_variant({v}) LIKE 'OBJECT%' THEN {v} END AS map<string,variant>))"


def nesting(json: Column) -> Column:
    """How deep objects lie in each other, strings aside; 1 at least."""
    bare = F.regexp_replace(F.regexp_replace(json, r"(?s)\\.", ""), r'"[^"]*+"', "")
    marks = F.filter(F.split(F.regexp_replace(bare, r"[^{}]", ""), ""), lambda c: c != "")
    state = lambda now, most: F.struct(now.alias("now"), most.alias("most"))
    step = lambda s, c: state(s["now"] + F.when(c == "{", 1).otherwise(-1), F.greatest(s["most"], s["now"] + 1))
    return F.greatest(F.lit(1), F.coalesce(F.aggregate(marks, state(F.lit(0), F.lit(0)), step)["most"], F.lit(1)))


def texts(entries: str, rank: int) -> str:
    """SQL: entries as (key, rank, place, text); null values are left out, the elements of a list are joined by commas."""
    item = "CASE WHEN v IS NULL OR is_variant_null(v) THEN '' ELSE CAST(v AS string) END"
    listed = f"array_join(transform(CAST(e.value AS array<variant>), v -> {item}), ',')"
    text = f"CASE WHEN schema_of_variant(e.value) LIKE 'ARRAY%' THEN {listed} ELSE CAST(e.value AS string) END"
    known = f"filter({entries}, e -> NOT is_variant_null(e.value))"
    return f"transform({known}, (e, i) -> named_struct('key', e.key, 'rank', {rank}, 'place', i, 'text', {text}))"


def block_entries(block: Column, rank: int) -> Column:
    """The lines of a key-value block as (key, rank, place, text); the value of a collapsed object is empty."""
    lines = F.filter(F.transform(F.split(block, "\n"), strip), lambda line: line.rlike(KV_ENTRY))

    def entry(line: Column, i: Column) -> Column:
        value = strip(F.regexp_extract(line, KV_ENTRY, 2))
        text = F.when(value.startswith("{"), F.lit("")).otherwise(value)
        return F.struct(F.regexp_extract(line, KV_ENTRY, 1).alias("key"), F.lit(rank).alias("rank"), i.alias("place"), text.alias("text"))

    return F.transform(lines, entry)


def with_raw(records: DataFrame, text: str = "value", name: str = "raw") -> DataFrame:
    """``records`` with the record in the column ``text`` as a map of keys to texts, under ``name``.

    An object under ``result`` is the record itself. Members of ``_raw`` come first: a JSON object, flattened to dotted
    keys at any depth, else the lines of a key-value block. Explicit members win over them. Null members are left out,
    numbers and flags become text, lists their elements joined by commas, nested explicit objects JSON text. A text
    that is no JSON object is a block itself; null text gives an empty map. An object that repeats a key, or is too large
    for a variant (128 MiB), is read by its top level only: nested objects stay JSON text, and the last of its equal keys counts.
    """
    held = [f"{name}__{c}" for c in "vokdjes"]
    v, o, k, d, j, e, s = held

    def once(df: DataFrame, column: str, what: Column | str) -> DataFrame:
        """A one-row explode, so that the value is computed once for all that read it."""
        return df.withColumn(column, F.explode(F.array(F.expr(what) if isinstance(what, str) else what)))

    def entries(json: str, variant: str) -> str:
        top = f"transform(map_entries(from_json({json}, 'map<string,string>')), e -> named_struct('key', e.key, 'value', to_variant_object(array(e.value))))"
        first = f"transform({top}, e -> named_struct('key', e.key, 'value', variant_get(e.value, '$[0]', 'variant')))"
        return f"coalesce({members(variant)}, {first})"

    df = once(records, v, f"try_parse_json(CASE WHEN ltrim({text}) LIKE '{{%' THEN {text} END)")
    inner = f"try_variant_get({v}, '$.result', 'variant')"
    df = once(df, o, f"coalesce({members(inner)}, {entries(f'CASE WHEN ltrim({text}) LIKE "{{%" THEN {text} END', v)})")
    raw = f"try_element_at(filter({o}, e -> e.key = '_raw' AND schema_of_variant(e.value) = 'STRING'), -1)"
    df = once(df, k, f"CASE WHEN {o} IS NULL THEN {text} ELSE CAST({raw}.value AS string) END")
    df = once(df, j, f"try_parse_json(CASE WHEN ltrim({k}) LIKE '{{%' THEN {k} END)")
    df = once(df, d, nesting(F.col(k)))
    df = once(df, e, entries(f"CASE WHEN ltrim({k}) LIKE '{{%' THEN {k} END", j))
    flat = f"aggregate(sequence(1, {d}), CAST({e} AS array<{ENTRY}>), (held, n) -> flatten(transform(held, e -> coalesce(transform({members('e.value')}, x -> {MEMBER}), array(e)))))"
    pairs = "array<struct<key:string,rank:int,place:int,text:string>>"
    kv = F.coalesce(block_entries(F.col(k), 0), F.array()).cast(pairs)
    nested = F.coalesce(F.expr(f"CAST({texts(flat, 0)} AS {pairs})"), kv)
    own = F.expr(f"CAST(coalesce({texts(f"filter({o}, e -> e.key <> '_raw')", 1)}, array()) AS {pairs})")
    df = once(df, s, F.array_sort(F.concat(nested, own)))
    last = F.filter(s, lambda x, i: F.coalesce(F.get(F.col(s), i + 1)["key"] != x["key"], F.lit(True)))
    return df.withColumn(name, F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"], x["text"])))).drop(*held)
