"""Dump text to findings, for all cases in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.operators import case_signals as cs
from stallscope.operators import dump_signals as ds
from stallscope.operators import signature_match as sm
from stallscope.operators.evidence import route
from stallscope.session import Staging, stage, stage_all
from stallscope.sources.dumps import parse_threads


@dataclass
class IncidentFrames:
    """The frames of an analysis, from per-dump to per-case."""

    dump_signals: DataFrame
    fingerprints: DataFrame
    members: DataFrame
    monitors: DataFrame
    case_signals: DataFrame


def analyse_dumps(dumps: DataFrame, cases: DataFrame | None = None) -> IncidentFrames:
    """Parse once, keep the threads as a table, derive every signal from it."""
    slim = stage(parse_threads(dumps).drop("monitor_lines", "top_frame", "key_frame", "nid", "elapsed"), "threads")
    return derive_signals(dumps, slim, cases)


def derive_signals(dumps: DataFrame, threads: DataFrame, cases: DataFrame | None = None) -> IncidentFrames:
    """Signals from thread rows that are already a table; fingerprints and monitors feed several branches."""
    facts = stage(ds.dump_facts(dumps), "dumps")
    signals = ds.dump_signals(facts, threads)
    members = ds.fingerprint_members(threads)
    reduced = stage_all({"fingerprints": ds.fingerprints(threads, facts), "monitors": ds.blocked_monitors(threads)})
    fps, monitors = reduced["fingerprints"], reduced["monitors"]
    return IncidentFrames(signals, fps, members, monitors, cs.case_signals(signals, fps, members, monitors, cases))


def match_cases(frames: IncidentFrames, signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings of every case, and their evidence as ordered rows."""
    signals = stage(frames.case_signals, "case-signals")
    dominant = cs.dominant_fingerprints(cs.largest_fingerprints(frames.fingerprints))
    lines = sm.evidence_lines(signals, dominant, frames.fingerprints, frames.members, frames.monitors)
    conditions = sm.evaluate_conditions(signals, signatures)
    return sm.findings(conditions, signatures), sm.finding_evidence(conditions, lines)


@dataclass
class EvidenceFrames:
    """What evidence leads to: its routing, the counts of each case, findings and their evidence rows."""

    routed: DataFrame
    inputs: DataFrame
    findings: DataFrame
    finding_evidence: DataFrame


def analyse_evidence(evidence: DataFrame, signatures: DataFrame, now: Column | None = None) -> EvidenceFrames:
    """Evidence rows ``(case_id, evidence_id, ord, name, content)`` to findings, for all cases in one job.

    Type and capture time, dumps among them to threads and signals, matching per case. Dumps of a case are in the
    order in which they were added. A thread dump without any thread counts as a parse error of its case.
    """
    staging = Staging(evidence.sparkSession, "evidence")
    routed = staging.write("routed", route(evidence, now))
    dumps = routed.where("type = 'thread-dump'").select(
        "case_id", F.concat_ws("/", F.col("case_id").cast("string"), F.col("evidence_id").cast("string")).alias("dump_id"), F.col("ord").alias("dump_ord"), "content"
    )
    threads = staging.write("threads", parse_threads(dumps).drop("monitor_lines", "top_frame", "key_frame", "nid", "elapsed"))
    frames = derive_signals(dumps, threads)
    unread = dumps.select("case_id", "dump_id").join(threads.select("dump_id").distinct(), "dump_id", "left_anti")
    found, lines = match_cases(frames, signatures)
    return EvidenceFrames(routed, cs.input_counts(routed, unread), found, lines)


def rematch(case_signals: DataFrame, signatures: DataFrame) -> DataFrame:
    """Scores of all stored cases against a changed signature set, without touching the dumps."""
    return sm.score_findings(sm.evaluate_conditions(case_signals, signatures))


def signature_frequency(findings: DataFrame) -> DataFrame:
    """In how many cases each signature was found."""
    return findings.groupBy("signature_id").agg(F.countDistinct("case_id").alias("cases"))
