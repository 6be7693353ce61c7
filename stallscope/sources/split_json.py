"""Records of JSON documents of any size: one array, a wrapper of one, or objects one after another, on any number of lines.

A file is read in pieces that end at ``}``, split over many tasks like lines. Whether a ``}`` ends a record depends on
the text before it: whether that is inside a string, and how many braces and brackets are open. Both are sums, so each
block (a file split) is summed for both cases, outside and inside a string, and a prefix over the blocks of a file says
which case holds and how deep it starts. No row holds more than a record, no task more than a block; a record that
crosses blocks is put together from one part of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallscope.functions.text import strip
from stallscope.session import Staging

WRAPPED = r'(?s)^\s*\{.*"results?"\s*:\s*\['
ELEMENTS = r'(?s)^(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"{]++)*+'  # what may stand before an object in a list
STRINGS = r'(?s)"[^"]*+(?:"|\z)'  # what lies inside strings, in a text without escapes that starts outside
CASES = (0, 1)  # a block starts outside, or inside, a string


def _pieces(spark: SparkSession, paths: str | list[str], keep: Column | None) -> DataFrame:
    """file, block (start of the split), n (order in it), value (text up to a brace, which is cut off) and what sums need."""
    read = spark.read.option("lineSep", "}").text(paths)
    read = read.where(keep) if keep is not None else read
    pieces = read.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("n"), "value",
    )
    # Of two marks one is inside where the other is outside, so one text without its strings serves both cases.
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    pieces = pieces.withColumn("plain", F.explode(F.array(plain)))
    pieces = pieces.withColumn("quotes", _count("plain", '"')).withColumn("bare", F.explode(F.array(F.regexp_replace("plain", STRINGS, ""))))
    opened = lambda text: _count(text, "[") + _count(text, "{") - _count(text, "]")
    outside = {0: opened("bare"), 1: opened("plain") - opened("bare")}
    for case in CASES:  # braces opened less closed, where the piece starts outside or inside a string
        closes = F.when((F.col("quotes") + case) % 2 == 0, 1).otherwise(0)
        pieces = pieces.withColumn(f"opens{case}", outside[case] - closes)
    return pieces.drop("plain", "bare")


def _count(text: str, mark: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit("")))


def _walked(pieces: DataFrame) -> DataFrame:
    """Pieces with, for both cases of their block: whether they end inside a string, and the depth after their brace."""
    here = Window.partitionBy("file", "block").orderBy("n")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = pieces.withColumn("before", F.sum("quotes").over(upto) - F.col("quotes"))
    for case in CASES:
        inside = (F.col("before") + case) % 2 == 1
        out = out.withColumn(f"opens_{case}", F.when(inside, F.col("opens1")).otherwise(F.col("opens0")))
        out = out.withColumn(f"after{case}", F.sum(f"opens_{case}").over(upto)).withColumn(f"ends{case}", (F.col("before") + F.col("quotes") + case) % 2 == 1)
    return out


def _blocks(walked: DataFrame, heads: DataFrame, staging: Staging) -> DataFrame:
    """file, block, case, depth (at its start), base (the depth between records), open (a record is under way), closed (whether
    the file ends with a brace) and last (the last piece of the file)."""
    narrow = staging.write("narrow", walked.select("file", "block", "size", "n", "quotes", F.octet_length("value").alias("bytes"), *[f"{c}{k}" for c in ("opens_", "after", "ends") for k in CASES]))
    sums = narrow.groupBy("file", "block", "size").agg(
        F.sum("quotes").alias("quotes"), *[F.sum(f"opens_{k}").alias(f"opens{k}") for k in CASES], F.sum(F.col("bytes") + 1).alias("bytes"), F.max("n").alias("n")
    )
    file = Window.partitionBy("file")
    past = file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    states = sums.withColumn("case", (F.coalesce(F.sum("quotes").over(past), F.lit(0)) % 2).cast("int"))
    states = states.withColumn("opens", F.when(F.col("case") == 1, F.col("opens1")).otherwise(F.col("opens0")))
    states = states.withColumn("depth", F.coalesce(F.sum("opens").over(past), F.lit(0)))
    states = states.withColumn("last", F.when(F.col("block") == F.max("block").over(file), F.col("n")))
    states = states.withColumn("closed", F.sum("bytes").over(file) == F.col("size"))
    states = states.join(heads, "file").select("file", "block", "case", "depth", "base", "closed", "last")
    ends = narrow.join(states, ["file", "block"]).groupBy("file", "block").agg(F.max(_record_end()).alias("some_end"))
    states = states.join(ends, ["file", "block"]).withColumn("open", (F.col("depth") > F.col("base")) | (F.col("case") == 1))
    starts = F.last(F.when(~F.col("open") | F.col("some_end"), F.col("block")), ignorenulls=True).over(past)  # where the record under way began
    return staging.write("blocks", states.withColumn("began", F.when(F.col("open"), starts)).drop("some_end"))


def _record_end() -> Column:
    chosen = lambda c: F.when(F.col("case") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    cut_off = ~F.col("closed") & F.col("last").eqNullSafe(F.col("n"))
    return ~chosen("ends") & (F.col("depth") + chosen("after") == F.col("base")) & ~cut_off


def read_records(spark: SparkSession, paths: str | list[str], keep: Column | None = None) -> DataFrame:
    """source_file, ord (grows along each file) and value (the text of one object) of every record.

    In a file that starts with ``[`` or a wrapper (an object whose ``results`` or ``result`` is a list) the records are the
    objects of the list, else the objects of the file. What lies between records is left out, and so is an object that isn't
    closed. ``keep`` is a condition on the files, on columns of ``_metadata``. The text is read twice and shuffled once.
    """
    staging = Staging(spark, "split")
    pieces = _pieces(spark, paths, keep)
    first = pieces.where("block = 0").groupBy("file").agg(F.min("n").alias("n"))
    heads = pieces.where("block = 0").join(first, ["file", "n"], "left_semi")
    kind = F.when(strip(F.col("value")).startswith("["), 1).when(F.col("value").rlike(WRAPPED), 2).otherwise(0)
    heads = staging.write("heads", heads.select("file", kind.alias("base")))
    blocks = _blocks(_walked(pieces), heads, staging)

    walked = _walked(pieces).select("file", "block", "n", "value", *[f"{c}{k}" for c in ("after", "ends") for k in CASES])
    marked = walked.join(blocks, ["file", "block"]).withColumn("end", _record_end())
    here = Window.partitionBy("file", "block").orderBy("n")
    number = F.count_if("end").over(here) - F.col("end").cast("int")  # records that ended before this piece
    text = F.concat("value", F.when(~F.col("closed") & F.col("last").eqNullSafe(F.col("n")), "").otherwise("}"))
    marked = marked.select("file", "block", "n", text.alias("value"), number.alias("number"), "end", "open", "began", "base")
    joined = lambda order: F.array_join(F.sort_array(F.collect_list(F.struct(order, "value")))["value"], "")
    parts = marked.groupBy("file", "block", "number", "open", "began", "base").agg(joined("n").alias("value"), F.min("n").alias("ord"), F.max("end").alias("end"))
    goes_on = F.col("open") & (F.col("number") == 0)
    parts = staging.write("parts", parts.withColumn("began", F.when(goes_on, F.col("began")).otherwise(F.col("block"))).withColumn("goes_on", goes_on))
    crossing = parts.where("goes_on OR NOT end").groupBy("file", "began", "base").agg(
        joined("block").alias("value"), F.min(F.when(~F.col("goes_on"), F.col("ord"))).alias("ord"), F.max("end").alias("end"), F.min(F.when(~F.col("goes_on"), F.col("number"))).alias("number")
    )
    whole = parts.where("NOT goes_on AND end").select("file", "ord", "value", F.col("block").alias("began"), "number", "base")
    found = whole.unionByName(crossing.where("end").select("file", "ord", "value", "began", "number", "base"))
    head = (F.col("base") == 2) & (F.col("began") == 0) & (F.col("number") == 0)
    inner = F.when(head, F.regexp_replace("value", WRAPPED, "")).otherwise(F.col("value"))
    found = found.select(F.col("file").alias("source_file"), "ord", F.regexp_replace(inner, ELEMENTS, "").alias("value"))
    return found.where(F.col("value") != "")
