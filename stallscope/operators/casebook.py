"""Case and evidence tables: lists, current state from change rows, search, discovery, reports."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions import fixed
from stallscope.functions.text import with_sums_before
from stallscope.operators.evidence import discovered_type

CASE_FIELDS = ["title", "status", "notes", "resolution", "resolved_by"]


# Lists ------------------------------------------------------------------------------------------------


def newest_first(cases: DataFrame) -> DataFrame:
    return cases.orderBy(F.desc("updated_at"), "case_id")


def filter_cases(cases: DataFrame, resolved: bool = False, text: str = "") -> DataFrame:
    """Open or resolved cases whose id or title holds the text, in any case."""
    status = F.col("status") == "resolved"
    rows = cases.where(status if resolved else ~status)
    q = text.lower()
    return rows.where(F.lower("case_id").contains(q) | F.lower("title").contains(q)) if q else rows


def closed_list(cases: DataFrame, text: str = "", limit: int = fixed.CLOSED_CASES_LIMIT) -> DataFrame:
    """Resolved cases, newest first; only the first ``limit`` unless a text is searched."""
    rows = newest_first(filter_cases(cases, resolved=True, text=text))
    return rows if text else rows.limit(limit)


def hidden_closed(cases: DataFrame, limit: int = fixed.CLOSED_CASES_LIMIT) -> DataFrame:
    """How many resolved cases the short list leaves out."""
    n = filter_cases(cases, resolved=True).agg(F.count("*").alias("n"))
    return n.select(F.greatest(F.col("n") - limit, F.lit(0)).alias("hidden"))


def default_case(cases: DataFrame) -> DataFrame:
    """The open case with the latest update."""
    return newest_first(cases.where("status = 'open'")).limit(1)


def first_root_wins(cases: DataFrame) -> DataFrame:
    """One row per case id, from the first root (lowest ``root_ord``) that holds it."""
    w = Window.partitionBy("case_id").orderBy("root_ord")
    return cases.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


# Change rows ------------------------------------------------------------------------------------------


def current_cases(changes: DataFrame) -> DataFrame:
    """Current state of every case from change rows ``(case_id, updated_at, seq, <fields>)``.

    A change row carries the fields it sets and null elsewhere; per field the latest setting wins. Reopening
    a case changes its status only: resolution and resolver stay on record.
    """
    at = F.struct("updated_at", "seq")
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in CASE_FIELDS]
    rows = changes.groupBy("case_id").agg(
        F.min("updated_at").alias("created_at"), F.max("updated_at").alias("updated_at"), *latest
    )
    return rows.withColumns({"status": F.coalesce("status", F.lit("open")), "title": F.coalesce("title", "case_id")})


def current_evidence(changes: DataFrame) -> DataFrame:
    """Evidence still attached: the last action per evidence id is no removal."""
    latest = Window.partitionBy("case_id", "evidence_id").orderBy(F.desc("updated_at"), F.desc("seq"))
    last = changes.withColumn("_rn", F.row_number().over(latest)).where("_rn = 1").drop("_rn")  # the rank limit applies before the shuffle
    return last.where("action <> 'remove'")


# Files ------------------------------------------------------------------------------------------------


def untracked_files(files: DataFrame, evidence: DataFrame) -> DataFrame:
    """Files of case folders that no evidence row tracks or has stored; notes (``.md``) are skipped."""
    known = evidence.select(F.explode(F.array("file_path", "stored_path")).alias("file_path")).where(
        F.col("file_path").isNotNull()
    )
    name = F.regexp_extract("file_path", r"([^/]+)$", 1)
    found = files.where(~F.lower("file_path").endswith(".md")).join(known, "file_path", "left_anti")
    return found.select(
        "case_id",
        F.concat(F.lit("disk-"), name).alias("evidence_id"),
        name.alias("source"),
        discovered_type(name).alias("type"),
        "file_path",
    )


def drop_missing(evidence: DataFrame, files: DataFrame) -> DataFrame:
    """Leave out evidence whose file is gone and whose content is not stored."""
    has_text = F.coalesce(F.col("content") != "", F.lit(False))
    no_path = F.coalesce(F.col("file_path") == "", F.lit(True))
    looked_up = evidence.where(~no_path & ~has_text).join(files.select("file_path"), "file_path", "left_semi")  # blank paths meet no join
    return evidence.where(no_path | has_text).unionByName(looked_up)


def referenced_files(notes: Column) -> Column:
    """Base names of files that notes link to as ``](./path)``."""
    paths = F.regexp_extract_all(notes, F.lit(r"\]\(\.[/\\]([^)]+)\)"), F.lit(1))
    return F.array_distinct(F.transform(paths, lambda p: F.regexp_extract(p, r"([^/]+)/*$", 1)))


# Search -----------------------------------------------------------------------------------------------


def search(evidence: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Non-overlapping, case-insensitive hits per evidence row: their number and character offsets."""
    q = query.lower()
    if not q:
        raise ValueError("search needs a text")
    parts = F.split(F.lower(F.col(text)), re.escape(q), -1)
    lengths = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: (F.length(p) + len(q)).cast("bigint"))
    rows = evidence.where(F.lower(F.col(text)).contains(q)).withColumn("_steps", F.explode(F.array(lengths)))
    # a hit begins where the steps before it end, and the text before it: its own step less the query
    rows = with_sums_before(rows, "_steps", "_before")
    offsets = F.zip_with("_before", "_steps", lambda before, step: (before + step - len(q)).cast("int"))
    return rows.withColumn("offsets", offsets).drop("_steps", "_before").withColumn("hits", F.size("offsets").cast("bigint")).select(*evidence.columns, "hits", "offsets")


def hit_counts(evidence: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Hits per evidence row by length difference; rows without a hit count 0."""
    low, q = F.lower(F.coalesce(F.col(text), F.lit(""))), query.lower()
    n = (F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / F.lit(len(q))
    return evidence.withColumn("hits", n.cast("bigint"))


def search_totals(evidence: DataFrame, query: str, text: str = "content") -> DataFrame:
    """Hits per case over all its evidence."""
    counted = hit_counts(evidence, query, text)
    return counted.groupBy("case_id").agg(F.sum("hits").alias("hits"), F.count_if(F.col("hits") > 0).alias("items"))


# Timeline and report ----------------------------------------------------------------------------------


def _label() -> Column:
    clock = F.date_format("captured_at", "HH'h'mm")
    kind = F.lit(fixed.EVIDENCE_LABELS["generic"])
    for t, text in fixed.EVIDENCE_LABELS.items():
        kind = F.when(F.col("type") == t, text).otherwise(kind)
    return F.concat(kind, F.lit(" at "), clock)


def timeline(evidence: DataFrame) -> DataFrame:
    """One line per evidence row, in the order in which the case lists it."""
    clock = F.date_format("captured_at", "HH'h'mm")
    return evidence.select(
        "case_id", "ord", "captured_at", F.concat(F.lit("- "), clock, F.lit(" — "), _label()).alias("line")
    )


def _safe_name() -> Column:
    raw = F.concat_ws("-", F.col("type"), F.date_format("captured_at", "HH'h'mm"))
    return F.lower(F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9-]", "-"), "-+", "-"))


def case_report_lines(
    cases: DataFrame, evidence: DataFrame, findings: DataFrame, finding_evidence: DataFrame
) -> DataFrame:
    """Report of every case as ordered lines ``(case_id, section, a, b, c, line)``.

    Lines stay rows: a case with very many dumps or evidence lines is a larger part of the table, not a
    larger string in one task. Write them sorted by the order columns.
    """
    zero = F.lit(0).cast("bigint")
    day = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    resolved = F.col("status") == "resolved"
    in_work = F.lit("_Investigation in progress_")

    def block(rows: DataFrame, section: int, lines: Column, a: Column = zero, b: Column = zero) -> DataFrame:
        return rows.select(
            "case_id", F.lit(section).alias("section"), a.alias("a"), b.alias("b"), F.posexplode(lines).alias("c", "line")
        )

    lit = F.lit
    # Front matter, headings and link forms of a report.
    head = F.array(
        lit("---"), F.concat(lit("case_id: "), "case_id"), F.concat(lit('title: "'), "title", lit('"')),
        F.concat(lit("created: "), day), F.concat(lit("status: "), "status"), lit("tags: [incident]"), lit("---"), lit(""),
        F.concat(lit("# "), "case_id", lit(" — "), "title"), lit(""), lit("## Summary"),
        F.when(resolved & (F.coalesce("resolution", lit("")) != ""), F.col("resolution")).otherwise(in_work),
        lit(""), lit("## Evidence"),
    )
    shot = F.concat(lit("- ![["), _safe_name(), lit(".png]] — "), _label())
    ext = F.when(F.col("type") == "log-export", ".log").otherwise(".txt")
    item = F.concat(lit("- [["), _safe_name(), ext, lit("]] — "), _label())
    listed = evidence.withColumn("_l", F.when(F.col("type") == "screenshot", shot).otherwise(item))
    rank = F.col("rank").cast("bigint")
    step = lambda p, x: F.concat(lit(p), x)
    found = findings.select(
        "case_id", "rank", "signature_id",
        F.concat(lit("### ["), F.upper("confidence"), lit("] "), "signature_name").alias("_h"),
        F.concat(lit("Signature: [["), "signature_id", lit("]]")).alias("_s"),
        F.concat(
            F.array(lit(""), lit("**Next Steps:**")), F.transform("next_steps", lambda x: step("- [ ] ", x)),
            F.when(
                F.size("related_signatures") > 0,
                F.array(lit(""), F.concat(lit("**Related:** "), F.array_join(F.transform("related_signatures", lambda x: F.concat(lit("[["), x, lit("]]"))), ", "))),
            ).otherwise(F.array().cast("array<string>")),
            F.array(lit("")),
        ).alias("_n"),
    )
    lines = finding_evidence.join(findings.select("case_id", "signature_id", "rank"), ["case_id", "signature_id"])
    parts = [
        block(cases, 0, head),
        block(listed, 1, F.array("_l"), F.col("ord")),
        block(cases, 2, F.array(lit(""))),
        block(findings.select("case_id").distinct(), 3, F.array(lit("## Findings"), lit(""))),
        block(found, 4, F.array("_h", "_s", lit(""), lit("**Evidence:**")), rank, zero),
        lines.select(
            "case_id", lit(4).alias("section"), rank.alias("a"), lit(1).cast("bigint").alias("b"),
            lit(0).alias("c"),  # these lines are in order by their pos
            F.concat(lit("- "), "line").alias("line"), "pos",
        ),
        block(found, 4, F.col("_n"), rank, lit(2).cast("bigint")),
        block(cases, 5, F.array(lit("## Timeline"))),
        timeline(evidence).select("case_id", lit(6).alias("section"), F.col("ord").alias("a"), zero.alias("b"), lit(0).alias("c"), "line"),
        block(cases, 7, F.array(lit(""), lit("## Resolution"))),
        block(
            cases, 8,
            F.when(
                resolved,
                F.array(F.concat(lit("**Resolved by:** "), F.coalesce("resolved_by", lit("Unknown"))), lit(""), F.coalesce("resolution", lit(""))),
            ).otherwise(F.array(lit("_Not yet resolved_"))),
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


REPORT_ORDER = ["case_id", "section", "a", "b", "pos", "c"]


def top_findings_per_case(findings: DataFrame) -> DataFrame:
    return findings.where("rank = 1")


def case_overview(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Cases with their best finding, if any."""
    best = top_findings_per_case(findings).select("case_id", "signature_id", "confidence")
    return cases.join(best, ["case_id"], "left")
