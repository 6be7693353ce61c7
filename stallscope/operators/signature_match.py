"""Match the signals of every case against every signature and write the evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallscope.functions.frames import REQUEST_LINE
from stallscope.functions.text import number_text
from stallscope.operators.case_signals import NUMBER_SIGNALS, TEXT_SIGNALS
from stallscope.operators.containment import contained_either_way
from stallscope.operators.dump_signals import KEYS

UNKNOWN = "(unknown)"


def signal_rows(signals: DataFrame) -> DataFrame:
    """Case signals as rows ``(case_id, signal, num, str)``, plus one row that stands for any unknown name."""
    number = lambda c: F.struct(
        F.lit(c).alias("signal"), F.col(c).cast("double").alias("num"), F.lit(None).cast("string").alias("str")
    )
    text = lambda c: F.struct(
        F.lit(c).alias("signal"), F.lit(None).cast("double").alias("num"), F.col(c).alias("str")
    )
    none = F.struct(
        F.lit(UNKNOWN).alias("signal"), F.lit(None).cast("double").alias("num"), F.lit(None).cast("string").alias("str")
    )
    rows = F.array(*[number(c) for c in NUMBER_SIGNALS], *[text(c) for c in TEXT_SIGNALS], none)
    return signals.select("case_id", F.inline(rows))


def condition_rows(signatures: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per condition; signatures rank by ``order`` (their id unless given)."""
    rank = order if order is not None else F.col("id")
    known = [*NUMBER_SIGNALS, *TEXT_SIGNALS]
    return signatures.select(
        F.col("id").alias("signature_id"), rank.alias("sig_ord"), F.posexplode("conditions").alias("cond_ord", "c")
    ).select(
        "signature_id",
        "sig_ord",
        "cond_ord",
        F.col("c.field").alias("field"),
        F.when(F.col("c.field").isin(known), F.col("c.field")).otherwise(UNKNOWN).alias("signal"),
        F.col("c.operator").alias("operator"),
        F.col("c.value.num").alias("want_num"),
        F.col("c.value.str").alias("want_str"),
        F.col("c.description").alias("description"),
    )


def _as_number(num: Column, text: Column) -> Column:
    """Number of a union value: text counts when it is a number, blank text is 0."""
    t = F.trim(text)
    return F.coalesce(num, F.when(t == "", F.lit(0.0)).otherwise(t.try_cast("double")))


def holds() -> Column:
    """The condition test over the columns of a joined signal and condition."""
    n, t = _as_number(F.col("num"), F.col("str")), _as_number(F.col("want_num"), F.col("want_str"))
    shown = F.coalesce("str", number_text(F.col("num")))
    wanted = F.coalesce("want_str", number_text(F.col("want_num")))
    same = F.when(F.col("num").isNotNull(), F.col("num") == F.col("want_num")).otherwise(
        F.col("str") == F.col("want_str")
    )
    op = F.col("operator")
    test = (
        F.when(op == "gt", n > t)
        .when(op == "gte", n >= t)
        .when(op == "lt", n < t)
        .when(op == "lte", n <= t)
        .when(op == "eq", same)
        .when(op == "contains", F.contains(shown, wanted))
        .when(op == "matches", F.regexp_like(shown, wanted))
    )
    return F.coalesce(test & (F.col("signal") != UNKNOWN), F.lit(False))


def observed() -> Column:
    """The signal as evidence shows it."""
    return F.when(F.col("signal") == UNKNOWN, "N/A").otherwise(F.coalesce("str", number_text(F.col("num"))))


def evaluate_conditions(signals: DataFrame, signatures: DataFrame, order: Column | None = None) -> DataFrame:
    """Every condition of every signature on every case, with the observed value."""
    joined = signal_rows(signals).join(condition_rows(signatures, order), ["signal"])
    return joined.select(
        "case_id", "signature_id", "sig_ord", "cond_ord", "field", "description",
        holds().alias("matched"), observed().alias("observed_value"),
    )


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, "high").when(score >= 0.5, "medium").otherwise("low")


def score_findings(conditions: DataFrame) -> DataFrame:
    """Findings with a score above zero, best first per case."""
    item = F.struct("cond_ord", "field", "description", "observed_value")
    matched = F.sort_array(F.collect_list(F.when(F.col("matched"), item)))
    unmatched = F.sort_array(F.collect_list(F.when(~F.col("matched"), F.struct("cond_ord", "field", "description"))))
    scored = (
        conditions.groupBy("case_id", "signature_id", "sig_ord")
        .agg(
            F.avg(F.col("matched").cast("double")).alias("confidence_score"),
            matched.alias("matched_conditions"),
            unmatched.alias("unmatched_conditions"),
        )
        .where(F.col("confidence_score") > 0)
    )
    w = Window.partitionBy("case_id").orderBy(F.desc("confidence_score"), "sig_ord")
    return scored.withColumn("confidence", confidence(F.col("confidence_score"))).withColumn(
        "rank", F.row_number().over(w)
    )


# Evidence beyond the condition lines ----------------------------------------------------------------


def _reading_order() -> Column:
    return F.struct("dump_ord", (-F.col("count")).alias("neg_count"), "first_ord", "ord")


def _first_lines(rows: DataFrame, by: list[str], n: int, order: list, item: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    kept = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return kept.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_rn", item))).alias("_l")).select(
        *by, F.transform("_l", lambda x: x[item]).alias("items")
    )


def _names_line(n_raw: Column, names: Column) -> Column:
    more = F.when(n_raw > 20, "+").otherwise("")
    size = F.size(names).cast("string")
    return F.concat(F.lit("Affected thread names ("), size, more, F.lit("): "), F.array_join(names, ", "))


def stuck_frame_lines(signals: DataFrame, fps: DataFrame, members: DataFrame) -> DataFrame:
    """Names of threads whose key frame contains, or is contained in, the stuck frame of the case."""
    wanted = signals.where(F.col("suspiciousTimedWaitingKeyFrame") != "").select(
        "case_id", F.col("suspiciousTimedWaitingKeyFrame").alias("pattern")
    )
    frame = F.when(F.col("key_frame") != "", F.col("key_frame")).otherwise(F.col("top_frame"))
    framed = fps.select(*KEYS, "signature", "count", "first_ord", frame.alias("text"))
    fitting = contained_either_way(framed, wanted, ["case_id"]).select("case_id", "text")
    alike = framed.join(fitting, ["case_id", "text"], "left_semi").select(*KEYS, "signature", "count", "first_ord")
    by_name = (
        members.join(alike, [*KEYS, "signature"])
        .groupBy("case_id", "name")
        .agg(F.count("*").alias("n"), F.min(_reading_order()).alias("first"))
    )
    raw = by_name.groupBy("case_id").agg(F.sum("n").alias("n_raw"))
    names = _first_lines(by_name, ["case_id"], 20, ["first"], "name")
    return names.join(raw, "case_id").select(
        "case_id",
        F.lit("suspiciousTimedWaitingKeyFrame").alias("field"),
        F.lit(0).cast("bigint").alias("line_group"),
        F.lit(0).alias("line_ord"),
        _names_line(F.col("n_raw"), F.col("items")).alias("line"),
    )


def hot_path_lines(dominant: DataFrame, members: DataFrame) -> DataFrame:
    """Key frame and first names of the largest RUNNABLE dominant stack."""
    best = dominant.where(F.col("state") == "RUNNABLE").groupBy("case_id").agg(
        F.min_by(F.struct("dump_id", "dump_ord", "signature", "count", "key_frame", "top_frame"), F.col("rank")).alias("b")
    ).select("case_id", "b.*")
    rows = members.join(best.select(*KEYS, "signature"), [*KEYS, "signature"], "left_semi")
    names = _first_lines(rows, ["case_id"], 20, ["ord"], "name")
    frame = F.when(F.col("key_frame") != "", F.col("key_frame")).otherwise(F.col("top_frame"))
    listed = F.coalesce("items", F.array().cast("array<string>"))
    lines = F.array(
        F.concat(F.lit("Hot code path: "), frame),
        _names_line(F.when(F.size(listed) > 0, F.col("count")).otherwise(0), listed),
    )
    return best.join(names, "case_id", "left").select(
        "case_id",
        F.lit("dominantActiveFingerprintCount").alias("field"),
        F.lit(0).cast("bigint").alias("line_group"),
        F.posexplode(lines).alias("line_ord", "line"),
    )


def monitor_class_lines(signals: DataFrame, monitors: DataFrame) -> DataFrame:
    """Per dump, the first monitor whose class fits the busiest class of the case: holder and waiters."""
    wanted = signals.where(F.col("topBlockedMonitorClass") != "").select(
        "case_id", F.col("topBlockedMonitorClass").alias("pattern")
    )
    item = F.struct("lock_holder_thread", "waiting_thread_count", "waiting_thread_names")
    fitting = contained_either_way(monitors.select("case_id", F.col("monitor_class").alias("text")), wanted, ["case_id"])
    per_dump = (
        monitors.join(fitting.select("case_id", F.col("text").alias("monitor_class")), ["case_id", "monitor_class"], "left_semi")
        .groupBy(*KEYS)
        .agg(F.min_by(item, F.col("first_ord")).alias("m"))
    )
    names = F.array_join(F.slice("m.waiting_thread_names", 1, 15), ", ")
    waiting = F.concat(F.lit("Waiting threads ("), F.col("m.waiting_thread_count").cast("string"), F.lit("): "), names)
    lines = F.array_compact(F.array(F.concat(F.lit("Lock holder: "), F.col("m.lock_holder_thread")), waiting))
    return per_dump.select(
        "case_id",
        F.lit("topBlockedMonitorClass").alias("field"),
        F.col("dump_ord").cast("bigint").alias("line_group"),
        F.posexplode(lines).alias("line_ord", "line"),
    )


def request_urls(fps: DataFrame, members: DataFrame) -> DataFrame:
    """Requests per verb and path, query string cut, over the threads of all dumps of a case."""
    verb, path = F.regexp_extract("name", REQUEST_LINE, 1), F.regexp_extract("name", REQUEST_LINE, 2)
    named = members.where(F.col("name").rlike(REQUEST_LINE)).withColumn("url", F.concat_ws(" ", verb, path))
    sized = named.join(fps.select(*KEYS, "signature", "count", "first_ord"), [*KEYS, "signature"])
    return sized.groupBy("case_id", "url").agg(F.count("*").alias("threads"), F.min(_reading_order()).alias("first"))


def request_url_lines(urls: DataFrame) -> DataFrame:
    line = F.concat(F.lit("  "), F.col("threads").cast("string"), F.lit(" threads — "), F.col("url"))
    top = _first_lines(urls.withColumn("line", line), ["case_id"], 5, [F.desc("threads"), "first"], "line")
    return top.select(
        "case_id",
        F.lit("activeRequestThreadCount").alias("field"),
        F.lit(0).cast("bigint").alias("line_group"),
        F.posexplode(F.concat(F.array(F.lit("Top requested URLs:")), F.col("items"))).alias("line_ord", "line"),
    )


def blocked_info_lines(monitors: DataFrame) -> DataFrame:
    """Monitors of the first dump that has any: at most five, with holder and first waiters."""
    earliest = monitors.groupBy("case_id").agg(F.min("dump_ord").alias("dump_ord"))
    holder = F.coalesce(F.concat(F.lit(" | lock held by: "), F.col("lock_holder_thread")), F.lit(""))
    line = F.concat(
        F.col("waiting_thread_count").cast("string"), F.lit(" threads waiting on "), F.col("monitor_class"), holder,
        F.lit(" — "), F.array_join(F.slice("waiting_thread_names", 1, 10), ", "),
    )
    rows = monitors.join(earliest, ["case_id", "dump_ord"], "left_semi").withColumn("line", line)
    top = _first_lines(rows, ["case_id"], 5, ["first_ord"], "line")
    fields = F.explode(F.array(F.lit("blockedThreadCount"), F.lit("synchronizedBlockedMonitorCount")))
    zero = F.lit(0).cast("bigint").alias("line_group")
    rows = top.select("case_id", zero, F.posexplode("items").alias("line_ord", "line"))
    return rows.select("case_id", fields.alias("field"), "line_group", "line_ord", "line")


def evidence_lines(
    signals: DataFrame, dominant: DataFrame, fps: DataFrame, members: DataFrame, monitors: DataFrame
) -> DataFrame:
    """Lines that a matched condition on a field adds, one row each: ``(case_id, field, line)`` in order.

    Lines stay rows because their number grows with the dumps of a case.
    """
    active = signals.where(F.col("activeRequestThreadCount") > 0).select("case_id")
    parts = [
        stuck_frame_lines(signals, fps, members),
        hot_path_lines(dominant, members),
        monitor_class_lines(signals, monitors),
        request_url_lines(request_urls(fps, members)).join(active, "case_id", "left_semi"),
        blocked_info_lines(monitors),
    ]
    return reduce(DataFrame.unionByName, parts)


def finding_evidence(conditions: DataFrame, extra_lines: DataFrame) -> DataFrame:
    """Evidence of every finding as ordered rows: condition lines first, then what each matched field adds.

    Sort by ``(case_id, signature_id, pos)`` to read it.
    """
    matched = conditions.where("matched")
    zero = F.lit(0).cast("bigint")
    place = lambda part, group, at: F.struct(
        F.lit(part).alias("part"), F.col("cond_ord"), group.alias("line_group"), at.alias("line_ord")
    ).alias("pos")
    base = matched.select(
        "case_id", "signature_id", place(0, zero, F.lit(0)),
        F.concat("description", F.lit(": "), "observed_value").alias("line"),
    )
    added = matched.join(extra_lines, ["case_id", "field"]).select(
        "case_id", "signature_id", place(1, F.col("line_group"), F.col("line_ord")), "line"
    )
    return base.unionByName(added)


def findings(conditions: DataFrame, signatures: DataFrame) -> DataFrame:
    """Ranked findings with name, next steps and related signatures."""
    about = signatures.select(
        F.col("id").alias("signature_id"),
        F.col("name").alias("signature_name"),
        F.col("nextSteps").alias("next_steps"),
        F.col("relatedSignatures").alias("related_signatures"),
    )
    return score_findings(conditions).join(about, ["signature_id"]).select(
        "case_id", "rank", "signature_id", "signature_name", "confidence", "confidence_score",
        "matched_conditions", "unmatched_conditions", "next_steps", "related_signatures",
    )
