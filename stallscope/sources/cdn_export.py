"""Access-log exports: event lines, whole JSON documents, key-value blocks.

Every shape is turned into the same record struct and then into one typed event table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallscope.functions import fixed
from stallscope.functions.convert import to_bool, to_number, to_time
from stallscope.functions.text import ends_with_any, starts_with_any, strip, strip_long
from stallscope.session import Staging
from stallscope.sources.raw_record import with_raw
from stallscope.sources.split_json import read_records

FIELDS = [*fixed.CDN_FIELDS, "request_via"]
_text = lambda names: [T.StructField(n, T.StringType()) for n in names]
EVENT = T.StructType(_text([*FIELDS, "_raw"]))
LINE = T.StructType([*EVENT.fields, *_text(["lastrow", "preview", "_corrupt_record"]), T.StructField("result", EVENT)])
WRAPPER = T.StructType([T.StructField("results", T.ArrayType(LINE)), T.StructField("result", T.ArrayType(LINE))])
RAW_EVENT = T.StructType([*_text(FIELDS), T.StructField("xdata", T.StructType(_text(["request_via"])))])
RAW_EVENT_OR_NOT = T.StructType([*RAW_EVENT.fields, *_text(["_corrupt_record"])])
GLUED = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|(\}\s*+)(?=\{)'  # a string, or a brace that another object follows at once
LAST_OF_COMMA = ",\u0085\u2028\u2029"  # trimmed text ends in one of these if it ends in a comma, also before the line ends that a trim leaves
WHOLE_FILES = 1 << 60  # where the numbers of events from whole files start
LARGE = 64 << 20  # larger files without objects are left out of the read for records by their addresses; smaller ones are read, and give none
JSON_OPTIONS = {"columnNameOfCorruptRecord": "_corrupt_record"}


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with their file and a number that grows along each file; files split over many tasks."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("ord"), "value"
    )


def read_whole(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.monotonically_increasing_id().alias("ord"), "value"
    )


# One line of a block: a key with a value that is no collapsed object, else anything.
KV_KEY = r"[\w.-]+"
_BLANKS = r"[ \t\x0B\f\r]*"
KV_LINE = rf"(?md)^{_BLANKS}(?:({KV_KEY}):(?!{_BLANKS}\{{){_BLANKS}(.*\S|){_BLANKS}|.*)\n?"
KV_START = rf"^{_BLANKS}({KV_KEY}):"
KV_COLLAPSED = rf"{KV_START}{_BLANKS}\{{"
# What a line holds where an object starts, and what a text starts with that is a JSON value.
OBJECT_IN_LINE = r"""\{[ \t\r]*(?:["'}]|$)"""
_LITERAL = r"[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|INF|Infinity)"
JSON_START = rf"""^(?:\{{[ \t\r]*["'}}]|\[[ \t\r]*(?:$|[\[\]{{"']|{_LITERAL}[ \t\r]*(?:[,\]]|$)))"""
MAY_BE_OBJECT = r"""^\{[ \t\r\n]*+["'}]"""  # what no JSON object is without; a parse that fails costs an exception


def has_kv_lines(text: Column) -> Column:
    return text.rlike(rf"(?md)^[^\S\n]*{KV_KEY}:")


def kv_json(text: Column) -> Column:
    """A key-value block as JSON text: lines become members, other lines members without a name.

    Of repeated keys a parse keeps the last, as the block does; collapsed objects are left out.
    """
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = F.when(text.contains("\\") | text.contains('"'), escaped).otherwise(text)  # to look is a fraction of the cost to replace
    return F.concat(F.lit("{"), F.regexp_replace(escaped, KV_LINE, '"$1":"$2",'), F.lit('"":""}'))


def _records(lines: DataFrame, rec: Column) -> DataFrame:
    """Unwrap ``result`` and fill absent fields from ``_raw``, JSON or key-value.

    Trim, parse and the choice between both readings are one-row explodes, so that each is done once: a parse that stands in
    conditions too is done again for each of them, and one that stands in a projection for every field taken from it. What is
    no JSON object is read as a block; only text that starts as an object can is tried as JSON first.
    """
    keep = [c for c in lines.columns if not c.startswith("_")]
    wrapped = rec["result"].isNotNull()
    own = [F.when(wrapped, rec["result"][f]).otherwise(rec[f]).alias(f"own{i}") for i, f in enumerate([*FIELDS, "_raw"])]
    options = {"allowUnquotedControlChars": "true", "columnNameOfCorruptRecord": "_corrupt_record"}
    raw, tried = F.col("_w"), F.col("_o")
    as_object = F.when(raw.startswith("{") & raw.rlike(MAY_BE_OBJECT), F.from_json(raw, RAW_EVENT_OR_NOT, options))
    block = F.from_json(kv_json(raw), RAW_EVENT_OR_NOT, options)
    inner = F.when(tried.isNotNull() & tried["_corrupt_record"].isNull(), tried).otherwise(block)
    base = lines.select(*keep, *own).withColumn("_w", F.explode(F.array(strip_long(F.col(f"own{len(FIELDS)}")))))
    base = base.withColumn("_o", F.explode(F.array(as_object))).withColumn("_j", F.explode(F.array(inner)))

    def merged(i: int, name: str) -> Column:
        dotted = [F.col("_j.xdata.request_via")] if name == "xdata.request_via" else []
        return F.coalesce(F.col(f"own{i}"), F.col("_j")[name], *dotted).alias(name)

    return base.select(*keep, F.struct(*[merged(i, f) for i, f in enumerate(FIELDS)]).alias("rec"))


def typed_events(records: DataFrame) -> DataFrame:
    """Typed event columns from the raw text record in ``rec``."""
    text = lambda f: strip(F.coalesce(F.col("rec")[f], F.lit("")))
    as_is = lambda f: F.coalesce(F.col("rec")[f], F.lit(""))
    keep = [c for c in records.columns if c != "rec"]
    trimmed = [
        "server_region", "server_hostname", "bot_name", "client_ip", "client_as_number", "client_as_name",
        "fetch_action", "cache_location", "content_type", "ddos_action", "ddos_rule", "malicious_flags", "deny_reason",
        "geo_country_code", "aem_service", "aem_tier", "origin_host", "original_x_forwarded_for", "response_vary",
    ]
    via = F.coalesce(F.col("rec")["xdata.request_via"], F.col("rec")["request_via"], F.lit(""))
    return records.select(
        *keep,
        to_time(F.col("rec.time_start")).alias("time_start"),
        *[as_is(f).alias(f) for f in ("url", "request_user_agent", "fetch_surrogate_control", "fetch_cache_control")],
        *[F.upper(text(f)).alias(f) for f in ("cache_status", "fastly_info_state", "response_x_cache")],
        text("server_datacenter").alias("pop"),
        *[text(f).alias(f) for f in trimmed],
        *[to_number(F.col("rec")[f]).cast("int").alias(f) for f in ("status", "origin_status")],
        *[to_number(F.col("rec")[f]).alias(f) for f in ("response_age", "response_ttl")],
        *[to_bool(F.col("rec")[f]).alias(f) for f in ("is_cacheable", "shielding_used")],
        strip(via).alias("request_via"),
    )


def _objects(line: Column) -> Column:
    """The objects of a line, one after another with or without a comma; a parse of the line would give the first alone."""
    marked = F.regexp_replace(line, GLUED, "$1$2\x01")  # no JSON text holds this character; behind strings it is taken out again
    apart = F.replace(F.replace(marked, F.lit('"\x01'), F.lit('"')), F.lit("\x01"), F.lit(","))
    listed = F.concat(F.lit("["), F.when(line.rlike(r"\}\s*\{"), apart).otherwise(line), F.lit("]"))
    texts = F.when(line.rlike(r"\}\s*,?\s*\{"), F.from_json(listed, "array<string>"))
    return F.when(F.size(texts) > 1, texts).otherwise(F.array(line))


def parse_lines(lines: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Typed events of one-event-per-line text; blank, bracket, broken and marker lines are dropped.

    A line of several objects gives an event for each, all with the columns of their line.
    With ``keep_raw``, ``raw`` holds the whole untyped record (see ``with_raw``).
    """
    # one-row explodes: filters on the text or the record would otherwise be pushed below what makes them, and repeat it
    trimmed = F.col("_s")
    bare = F.when(ends_with_any(trimmed, LAST_OF_COMMA), F.regexp_replace(trimmed, r",\s*$", "")).otherwise(trimmed)
    cleaned = lines.withColumn("_s", F.explode(F.array(strip_long(F.col("value"))))).withColumn("_l", F.explode(F.array(bare))).where(F.col("_l").startswith("{"))
    cleaned = cleaned.withColumn("_t", F.explode(_objects(F.col("_l")))).drop("_s", "_l").where(F.col("_t").startswith("{") & ~F.col("_t").rlike(r"^\{\s*\}$"))
    cleaned = with_raw(cleaned, "_t") if keep_raw else cleaned
    parsed = cleaned.withColumn("_r", F.explode(F.array(F.from_json("_t", LINE, JSON_OPTIONS)))).where(
        F.col("_r").isNotNull() & F.col("_r._corrupt_record").isNull()
    )
    r = F.col("_r")
    marker = r["result"].isNull() & (r["lastrow"].isNotNull() | r["preview"].isNotNull()) & r["url"].isNull() & r[
        "cache_status"
    ].isNull()
    events = _records(parsed.where(~marker), F.col("_r"))
    return typed_events(events.drop("value"))


def parse_documents(docs: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Typed events of whole texts: JSON array, wrapper object, single object, event lines, key-value block.

    With ``keep_raw``, ``raw`` holds the whole untyped record (see ``with_raw``).
    """
    text = strip_long(F.col("value"))
    pieces = F.filter(F.transform(F.split("_t", "\n", -1), strip), lambda l: l != "")
    line_like = lambda l: l.startswith("{") & l.endswith("}")
    by_line = (F.size("_l") > 1) & F.forall("_l", line_like)
    cut = (
        docs.withColumn("_t", F.explode(F.array(text)))
        .where(F.col("_t") != "")
        .withColumn("_l", pieces)
        .withColumn("_p", F.explode(F.when(by_line, F.col("_l")).otherwise(F.array("_t"))))
        .drop("_t", "_l", "value")
    )
    p = F.col("_p")
    parsed = (
        cut.withColumn("_a", F.when(p.startswith("["), F.from_json(p, T.ArrayType(LINE))))
        .withColumn("_w", F.when(p.startswith("{"), F.from_json(p, WRAPPER)))
        .withColumn("_o", F.when(p.startswith("{"), F.from_json(p, LINE, JSON_OPTIONS)))
    )
    single = F.when(F.col("_o").isNotNull() & F.col("_o._corrupt_record").isNull(), F.array("_o"))
    no_text = F.lit(None).cast("string")
    block = F.struct(
        *[(p if f.name == "_raw" else no_text.cast(f.dataType) if f.name != "result" else F.lit(None).cast(EVENT)).alias(f.name)
          for f in LINE.fields]
    )
    has_pairs = has_kv_lines(p)
    rows = F.coalesce(F.col("_a"), F.col("_w.results"), F.col("_w.result"), single, F.when(has_pairs, F.array(block)))
    keep = [c for c in docs.columns if c != "value"]
    if not keep_raw:
        events = parsed.select(*keep, F.posexplode(rows).alias("pos", "_r")).where(F.col("_r").isNotNull())
        return typed_events(_records(events, F.col("_r")))
    # The texts of the same rows (a list of texts keeps its elements as they are written), then their records, then the parse.
    listed = F.from_json(F.when(p.startswith("{"), p), "struct<results array<string>, result array<string>>")
    texts = F.coalesce(F.from_json(F.when(p.startswith("["), p), "array<string>"), listed["results"], listed["result"])
    found = cut.withColumn("_x", texts).select(*keep, "_p", F.col("_x").isNull().alias("_own"), F.posexplode(F.coalesce("_x", F.array("_p"))).alias("pos", "_x"))
    found = with_raw(found.where(F.col("_x").isNotNull()), "_x").withColumn("_o", F.explode(F.array(F.when(F.col("_x").startswith("{"), F.from_json("_x", LINE, JSON_OPTIONS)))))
    one = F.when(F.col("_o").isNotNull() & F.col("_o._corrupt_record").isNull(), F.col("_o")).when(F.col("_own") & has_pairs, block)
    found = found.withColumn("_r", F.explode(F.array(one))).where(F.col("_r").isNotNull())
    return typed_events(_records(found, F.col("_r")))


def _file(path: Column) -> Column:
    """An address in the one form of its spellings."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def _shapes(lines: DataFrame) -> DataFrame:
    """file, size, objects (whether a JSON object may lie in it) and shape of every file whose lines are given.

    A file of ``lines`` has an object on each; the text of a ``json`` file may start with a JSON value; a ``block`` has a line with
    a key. The others, without a shape, hold no event.
    """
    s, keyed = F.col("_s"), F.col("_k")
    lines = lines.withColumn("_s", F.explode(F.array(strip_long(F.col("value"))))).where(s != "").withColumn("_k", F.explode(F.array(F.col("value").rlike(KV_START))))
    first = lambda found: F.min(F.when(found, F.col("ord")))
    brace = s == "{"
    marks = lines.groupBy("file").agg(
        F.max("size").alias("size"), F.bool_or(s.contains("{") & s.rlike(OBJECT_IN_LINE)).alias("objects"), F.bool_or(keyed).alias("keys"),
        F.bool_and(s.startswith("{") & s.endswith("}")).alias("each"), F.count("*").alias("n"), F.min("ord").alias("first"),
        first(keyed | s.rlike(KV_START)).alias("key"),  # the file is trimmed, and so is its first line
        first(starts_with_any(s, list("{[")) & s.rlike(JSON_START)).alias("json"), first(brace).alias("brace"), first(~brace).alias("other"), first(starts_with_any(s, list("\"'}"))).alias("member"),
    )
    starts = lambda c: F.coalesce(F.col("first") == F.col(c), F.lit(False))
    json = starts("json") | (starts("brace") & F.coalesce(F.col("other") == F.col("member"), F.lit(False)))
    shape = F.when(F.col("each") & (F.col("n") > 1), "lines").when(json, F.when(F.col("objects") | F.col("keys"), "json")).when(F.col("keys") | starts("key"), "block")
    return marks.select("file", "size", "objects", shape.alias("shape"))


def _texts(lines: DataFrame, shapes: DataFrame, keep_raw: bool) -> DataFrame:
    """source_file, ord and value: texts that ``parse_documents`` reads as it would read the whole files of these lines.

    Of a block, however large, only the lines that can matter are put together: the first and the last of the file and of every
    key, since of repeated keys the last counts. Without ``keep_raw`` only the keys of an event count, all others as one.
    """
    rows = lines.join(shapes.select("file", "shape"), "file").withColumn("_k", F.explode(F.array(F.regexp_extract("value", KV_START, 1))))
    key, collapsed = F.col("_k"), F.col("value").rlike(KV_COLLAPSED)
    if keep_raw:
        kind = F.concat_ws(":", collapsed.cast("string"), key, F.regexp_extract(strip(F.col("value")), KV_START, 1))
    else:
        kind = F.when(key.isin(FIELDS) & ~collapsed, key).when(key != "", ":").otherwise("")
    in_json = F.col("shape") == "json"
    kept = rows.where(in_json | ((F.col("shape") == "block") & (strip(F.col("value")) != "")))
    line = F.struct("ord", "value")
    kept = kept.groupBy("source_file", F.when(in_json, F.col("ord").cast("string")).otherwise(kind)).agg(F.min(line).alias("a"), F.max(line).alias("z"))
    both = F.when(F.col("a.ord") == F.col("z.ord"), F.array("a")).otherwise(F.array("a", "z"))
    whole = kept.groupBy("source_file").agg(F.min("a.ord").alias("ord"), F.array_join(F.sort_array(F.flatten(F.collect_list(both)))["value"], "\n").alias("value"))
    return rows.where("shape = 'lines'").select("source_file", "ord", "value").unionByName(whole)


def read_export(spark: SparkSession, paths: str | list[str], keep_raw: bool = False) -> DataFrame:
    """Events of export files of any shape and size.

    Files are read line by line, split over many tasks, and parsed once. Only files that gave no event that way are
    read again: those that may hold an object as records of a document that may lie on one line (``read_records``, split over many
    tasks too), and what is left by its shape: a key-value block of any size is reduced to the lines that count in it (``_texts``).
    The files are found by joins of a listing without contents with the files of the events; the driver sees the first and last
    address of a rest, to skip files, and those of ``LARGE`` files without an object, but no listing. Events of later readings
    come after the others in ``ord``.
    """
    staging = Staging(spark, "export")
    events = staging.write("lines", parse_lines(read_lines(spark, paths), keep_raw))
    listing = staging.write("listing", spark.read.format("binaryFile").load(paths).select(_file(F.col("_metadata.file_path")).alias("file")))
    address = _file(F.col("_metadata.file_path"))

    def without(files: DataFrame, known: DataFrame) -> DataFrame:
        return files.join(known.select(_file(F.col("source_file")).alias("file")).distinct(), "file", "left_anti")

    def ends(files: DataFrame) -> tuple[str | None, str | None]:
        return files.agg(F.min("file"), F.max("file")).first()

    def only(rows: DataFrame, files: DataFrame) -> DataFrame:
        return rows.withColumn("file", _file(F.col("source_file"))).join(files.select("file"), "file", "left_semi")

    def lines_of(files: DataFrame) -> DataFrame:
        first, last = ends(files)
        read = spark.read.option("lineSep", "\n").text(paths).where(address.between(first, last))
        size = F.col("_metadata.file_size").alias("size")
        return only(read.select(F.col("_metadata.file_path").alias("source_file"), size, F.monotonically_increasing_id().alias("ord"), "value"), files)

    left = staging.write("no-lines", without(listing, events))
    if left.isEmpty():
        return events
    shapes = staging.write("shapes", _shapes(lines_of(left)))
    held = shapes.where("objects")
    first, last = ends(held)
    if first is not None:
        between = address.between(first, last)
        passed = [r.file for r in shapes.where(~F.col("objects") & (F.col("size") > LARGE) & F.col("file").between(first, last)).select("file").collect()]
        keep = between & ~address.isin(passed) if passed else between
        found = parse_lines(only(read_records(spark, paths, keep), held).drop("file"), keep_raw)
        found = staging.write("documents", found.withColumn("ord", F.col("ord") + F.lit(WHOLE_FILES)).select(*events.columns))
        events, shapes = events.unionByName(found), without(shapes, found)
    left = staging.write("no-records", shapes.where("shape IS NOT NULL"))
    if left.isEmpty():
        return events
    texts = parse_documents(_texts(lines_of(left), left, keep_raw), keep_raw).drop("pos").withColumn("ord", F.col("ord") + F.lit(2 * WHOLE_FILES))
    return events.unionByName(texts.select(*events.columns))


def read_documents(spark: SparkSession, paths: str | list[str], keep_raw: bool = False) -> DataFrame:
    """Events of files known to hold JSON documents, also of one line beyond what a row can hold."""
    return parse_lines(read_records(spark, paths), keep_raw)


def save_raw(lines: DataFrame, path: str) -> None:
    """Keep the raw lines so that the analysis can be run again."""
    lines.select("value").write.text(path)
