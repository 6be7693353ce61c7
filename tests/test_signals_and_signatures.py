"""Case signals and signature matching on built dumps."""

import pytest
from pyspark.sql import functions as F

from stallscope.operators import case_signals as cs
from stallscope.operators import dump_signals as ds
from stallscope.operators import signature_match as sm
from stallscope.plans.incident import analyse_dumps, match_cases, rematch, signature_frequency
from stallscope.sources import signatures as sg
from stallscope.sources.dumps import parse_threads


def block(name, state, frames=(), lock=None, park=None, held=None):
    out = [f'"{name}" #1', f"   java.lang.Thread.State: {state}"]
    out += [f"\tat {f}" for f in frames[:1]]
    if lock:
        out.append(f"\t- waiting to lock <{lock}> (a com.acme.Lock)")
    if park:
        out.append(f"\t- parking to wait for  <{park}> (a com.acme.Sync)")
    if held:
        out.append(f"\t- locked <{held}> (a com.acme.Lock)")
    return "\n".join(out + [f"\tat {f}" for f in frames[1:]])


def dump(*blocks):
    return "\n\n".join(blocks)


HOT = ["com.acme.Search.run(Search.java:1)"]
STUCK = ["jdk.internal.misc.Unsafe.park(Native Method)", "com.acme.db.Conn.take(Conn.java:5)"]
IDLE = ["jdk.internal.misc.Unsafe.park(Native Method)", "java.util.concurrent.LinkedBlockingQueue.take(Q.java:1)"]


@pytest.fixture(scope="module")
def analysed(spark):
    one = [block(f"hot-{i}", "RUNNABLE", HOT) for i in range(4)]
    stuck = [block(f"db-{i}", "TIMED_WAITING", STUCK) for i in range(3)]
    idle = [block(f"idle-{i}", "TIMED_WAITING", IDLE) for i in range(9)]
    blocked = [block(f"b-{i}", "BLOCKED", ["com.acme.Lock.enter(Lock.java:3)"], lock="0xaa") for i in range(25)]
    parked = [block(f"w-{i}", "WAITING", ["com.acme.Sync.hold(Sync.java:3)"], park="0xbb") for i in range(5)]
    owner = [block("owner", "RUNNABLE", ["com.acme.Own.go(Own.java:1)"], held="0xaa")]
    urls = [block(f"1.1.1.1 [{i}] GET /p{'a' if i < 3 else 'b'}?x={i} HTTP/1.1", "RUNNABLE", ["com.acme.Web.get(Web.java:9)"]) for i in range(4)]
    big = [block(f"t-{i}", "RUNNABLE") for i in range(501)]
    many = [block(f"m-{i}", "RUNNABLE", ["com.acme.Many.x(Many.java:1)"]) for i in range(51)]
    io = [block(f"io-{i}", "RUNNABLE", ["java.net.Socket.read(Socket.java:1)"]) for i in range(2)]
    rows = [
        ("main", "d1", 1, dump(*one, *stuck, *idle, *blocked, *parked, *owner, *urls)),
        ("main", "d2", 2, dump(*one, *one, *stuck, *blocked[:3], *owner)),
        ("big", "d1", 1, dump(*big)),
        ("many", "d1", 1, dump(*many)),
        ("io", "d1", 1, dump(*io, block("x", "RUNNABLE"))),
        ("hole", "d1", 1, "3XMTHREADINFO none"),
        ("hole", "d2", 2, dump(*io)),
    ]
    dumps = spark.createDataFrame(rows, "case_id string, dump_id string, dump_ord bigint, content string")
    cases = spark.createDataFrame([(c,) for c in ("main", "big", "many", "io", "hole", "empty")], "case_id string")
    return analyse_dumps(dumps, cases)


@pytest.fixture(scope="module")
def signals(analysed):
    return {r.case_id: r for r in analysed.case_signals.collect()}


def test_counts(signals):
    m = signals["main"]
    assert (m.totalThreadCount, m.blockedThreadCount, m.waitingThreadCount, m.timedWaitingThreadCount) == (51, 25, 5, 12)
    assert m.avgThreadCount == (51 + 15) / 2
    assert m.activeRequestThreadCount == 4
    assert signals["big"].threadCountAnomaly == 1 and m.threadCountAnomaly == 0
    assert signals["io"].ioSaturationDetected == 1 and m.ioSaturationDetected == 0
    # a dump without threads leaves the mean undefined
    assert signals["hole"].ioSaturationDetected == 0 and signals["hole"].ioThreadCount == 2


def test_empty_case_is_all_zero(signals):
    e = signals["empty"]
    assert all(e[c] == 0 for c in cs.NUMBER_SIGNALS) and all(e[c] == "" for c in cs.TEXT_SIGNALS)


def test_fingerprint_signals(signals):
    m = signals["main"]
    assert m.dominantFingerprintCount == 25 and m.dominantFingerprintRatio == 25 / 51
    # the largest RUNNABLE instance, also without the rule on several dumps
    assert m.dominantActiveFingerprintCount == 8
    assert signals["many"].dominantFingerprintCount == 51
    assert signals["io"].dominantFingerprintCount == 0 and signals["io"].dominantActiveFingerprintCount == 2


def test_monitor_and_wait_signals(signals):
    m = signals["main"]
    assert (m.maxBlockedOnSingleMonitor, m.topBlockedMonitorClass) == (25, "com.acme.Lock")
    assert (m.persistentBlockedMonitors, m.blockedMonitorCount, m.synchronizedBlockedMonitorCount) == (1, 2, 1)
    assert (m.suspiciousTimedWaitingCount, m.suspiciousTimedWaitingKeyFrame) == (3, "com.acme.db.Conn.take(Conn.java:5)")


def test_ranked_lists(analysed):
    dom = cs.dominant_fingerprints(cs.largest_fingerprints(analysed.fingerprints)).where("case_id = 'main'").orderBy("rank")
    assert [(r["count"], r.dump_id) for r in dom.collect()][:3] == [(25, "d1"), (8, "d2"), (3, "d2")]
    stuck = cs.stuck_stacks(cs.dominant_fingerprints(cs.largest_fingerprints(analysed.fingerprints))).where("case_id = 'main'")
    assert [r.display_frame for r in stuck.orderBy("place").collect()] == ["com.acme.Lock.enter(Lock.java:3)", "com.acme.db.Conn.take(Conn.java:5)"]
    top = cs.top_monitors(cs.case_monitors(analysed.monitors)).where("case_id = 'main'").orderBy("rank").collect()
    assert [(r.monitor_address, r.waiting_thread_count, r.lock_holder_thread) for r in top] == [("0xaa", 25, "owner"), ("0xbb", 5, None)]


def sig(sid, *conditions):
    conds = [(f, op, (float(v), None) if isinstance(v, (int, float)) else (None, v), f"{f} {op}") for f, op, v in conditions]
    return (sid, sid.upper(), "", "1", conds, [], ["do it"], ["x"])


def matrix(spark, signatures, **values):
    base = {**{c: 0.0 for c in cs.NUMBER_SIGNALS}, **{c: "" for c in cs.TEXT_SIGNALS}, **values}
    row = spark.createDataFrame([("c", *base.values())], ["case_id", *base])
    return rematch(row, spark.createDataFrame(signatures, sg.SIGNATURE))


def test_operators(spark):
    tests = [
        (("gcThreadCount", "gt", 20), False), (("gcThreadCount", "gte", 20), True), (("gcThreadCount", "lt", 21), True),
        (("gcThreadCount", "lte", 19), False), (("gcThreadCount", "eq", 20), True), (("gcThreadCount", "eq", "20"), False),
        (("gcThreadCount", "gte", "15"), True), (("gcThreadCount", "contains", 2), True), (("gcThreadCount", "contains", ".0"), False),
        (("gcThreadCount", "matches", "^2\\d$"), True), (("topBlockedMonitorClass", "contains", "Lock"), True),
        (("topBlockedMonitorClass", "contains", "lock"), False), (("topBlockedMonitorClass", "matches", "(?i)LOCK$"), True),
        (("topBlockedMonitorClass", "matches", "^Lock"), False), (("topBlockedMonitorClass", "eq", "a.Lock"), True),
        (("topBlockedMonitorClass", "gt", 0), False), (("nothing", "gte", 0), False), (("dominantFingerprints", "gte", 0), False),
        (("suspiciousTimedWaitingKeyFrame", "gte", 0), True), (("gcThreadCount", "between", 1), False),
    ]
    rows = matrix(spark, [sig("all", *[t for t, _ in tests])], gcThreadCount=20.0, topBlockedMonitorClass="a.Lock").collect()
    assert [c.cond_ord for c in rows[0].matched_conditions] == [i for i, (_, ok) in enumerate(tests) if ok]
    shown = {c.cond_ord: c.observed_value for c in rows[0].matched_conditions}
    assert shown[1] == "20" and shown[10] == "a.Lock"


def test_scores_and_order(spark):
    yes, no = ("gcThreadCount", "gte", 1), ("gcThreadCount", "gt", 99)
    rows = matrix(
        spark,
        [sig("b-high", yes, yes, yes, yes, no), sig("a-high", yes), sig("c-medium", yes, no), sig("d-low", yes, no, no), sig("none", no), sig("empty")],
        gcThreadCount=5.0,
    ).orderBy("rank")
    assert [(r.signature_id, r.confidence) for r in rows.collect()] == [
        ("a-high", "high"), ("b-high", "high"), ("c-medium", "medium"), ("d-low", "low"),
    ]


def test_findings_with_evidence(spark, analysed):
    custom = spark.createDataFrame(
        [
            sig("stuck", ("suspiciousTimedWaitingKeyFrame", "matches", "Conn")),
            sig("hot", ("dominantActiveFingerprintCount", "gte", 8)),
            sig("lock", ("topBlockedMonitorClass", "contains", "Lock")),
            sig("thread-lock-contention", ("blockedThreadCount", "gte", 20)),
            sig("urls", ("activeRequestThreadCount", "gte", 1)),
        ],
        sg.SIGNATURE,
    )
    signatures = sg.overlay(sg.bundled_signatures(spark), custom)
    assert signatures.count() == 7
    found, evidence = match_cases(analysed, signatures)
    main = {r.signature_id: r for r in found.where("case_id = 'main'").collect()}
    assert set(main) == {"stuck", "hot", "lock", "thread-lock-contention", "urls"}
    assert main["stuck"].signature_name == "STUCK" and main["stuck"].next_steps == ["do it"]
    lines = {}
    for r in evidence.where("case_id = 'main'").orderBy("signature_id", "pos").collect():
        lines.setdefault(r.signature_id, []).append(r.line)
    assert lines["stuck"] == [
        "suspiciousTimedWaitingKeyFrame matches: com.acme.db.Conn.take(Conn.java:5)",
        "Affected thread names (3): db-0, db-1, db-2",
    ]
    assert lines["hot"][1:] == ["Hot code path: com.acme.Search.run(Search.java:1)", "Affected thread names (8): hot-0, hot-1, hot-2, hot-3, hot-0, hot-1, hot-2, hot-3"]
    assert lines["lock"][1] == "Lock holder: owner" and lines["lock"][2].startswith("Waiting threads (25): b-0, b-1")
    assert lines["lock"][3:] == ["Lock holder: owner", "Waiting threads (3): b-0, b-1, b-2"]
    assert lines["thread-lock-contention"][1].startswith("25 threads waiting on com.acme.Lock | lock held by: owner — b-0")
    assert lines["thread-lock-contention"][2] == "5 threads waiting on com.acme.Sync — w-0, w-1, w-2, w-3, w-4"
    assert lines["urls"][1:] == ["Top requested URLs:", "  3 threads — GET /pa", "  1 threads — GET /pb"]
    frequency = {r.signature_id: r.cases for r in signature_frequency(found).collect()}
    assert frequency["hot"] == 2 and frequency["lock"] == 1


def test_large_signature_table_joins_without_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = matrix(spark, [sig("a", ("gcThreadCount", "gte", 1), ("nope", "gt", 1))], gcThreadCount=3.0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [(r.signature_id, r.confidence_score) for r in rows] == [("a", 0.5)]


def test_signature_folder(spark, tmp_path):
    folder = str(tmp_path / "sigs")
    assert sg.read_signatures(spark, folder).count() == 0
    sg.append_signatures(sg.bundled_signatures(spark), folder)
    sg.append_signatures(spark.createDataFrame([sig("mine", ("gcThreadCount", "eq", "x"))], sg.SIGNATURE), folder)
    back = {r.id: r for r in sg.read_signatures(spark, folder).collect()}
    assert set(back) == {"gc-pressure", "servlet-pool-saturation", "thread-lock-contention", "mine"}
    assert back["gc-pressure"].conditions[0].value.num == 15.0 and back["mine"].conditions[0].value.str == "x"
    assert sg.read_signatures(spark, folder).where(F.size("nextSteps") == 0).count() == 0


def test_firsts_are_hash_aggregates(spark):
    """Groups aggregate numbers only; the rows that are chosen are looked up, ties and extreme ranks included."""
    import random

    from pyspark.sql import functions as F
    from stallscope.functions.firsts import first_rows, packed, unpacked

    rnd = random.Random(2)
    edge = [0, 1, -1, 2**62, -(2**62)]
    rows = [(rnd.choice([None, "a", "b", "c"]), rnd.choice(edge), rnd.choice([*edge, 2**63 - 1, -(2**63)]), f"t{rnd.randrange(9)}") for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, x bigint, y bigint, t string")
    both = df.select("x", "y", unpacked(packed(F.col("x"), F.col("y"))).alias("u")).collect()
    assert all((r.u.first, r.u.second) == (r.x, r.y) for r in both)
    got = first_rows(df, ["k"], packed(F.col("x"), F.col("y")), F.count("*").alias("n"), tie="t")
    want = {k: min((r[1:] for r in rows if r[0] == k)) for k in {r[0] for r in rows}}
    assert {r.k: (r.x, r.y, r.t) for r in got.collect()} == want and sum(r.n for r in got.collect()) == 300
    threads = parse_threads(spark.createDataFrame([("c", "d", 1, "x")], "case_id string, dump_id string, dump_ord bigint, content string"))
    fps, monitors = ds.fingerprints(threads), ds.blocked_monitors(threads)
    for frame in (fps, cs.largest_fingerprints(fps), ds.lock_holders(threads), cs.case_monitors(monitors)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_containment_both_ways(spark):
    """The gram index against plain Python: empty, short, equal, repeated, null and long strings, a hot group."""
    import random

    from stallscope.operators.containment import contained_either_way

    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("ab.é") for _ in range(n))
    long = [word(rnd.choice([0, 3, 7, 8, 9, 20, 60])) for _ in range(60)]
    texts = [(rnd.choice(["hot", "hot", "a", None]), t) for t in [*long, *long, *[t[2:-3] for t in long], None]]
    patterns = [(g, p) for g in ("hot", "a", "alone", None) for p in [*long[:20], *[t[1:-1] for t in long[20:40]], long[50] + "x", None]]
    got = contained_either_way(
        spark.createDataFrame(texts, "g string, text string"), spark.createDataFrame(patterns, "g string, pattern string"), ["g"]
    ).collect()
    pairs = {(g, t, p) for g, t in texts for h, p in patterns if g == h and None not in (g, t, p) and (t in p or p in t)}
    assert len(got) == len(pairs) > 100 and {tuple(r) for r in got} == pairs


def test_condition_store(spark, tmp_path):
    """Runs with changed, removed and returning conditions and cases: findings as if all was evaluated, and only new work done."""
    from stallscope.operators.condition_store import ConditionStore

    def cases(**gc):
        names = [*cs.NUMBER_SIGNALS, *cs.TEXT_SIGNALS]
        rows = [(c, *[float(n) if s == "gcThreadCount" else 0.0 for s in cs.NUMBER_SIGNALS], "", "a.Lock") for c, n in gc.items()]
        return spark.createDataFrame(rows, ", ".join(["case_id string", *[f"{n} {'double' if n in cs.NUMBER_SIGNALS else 'string'}" for n in names]]))

    one, two, lock = ("gcThreadCount", "gte", 1), ("gcThreadCount", "gte", 2), ("topBlockedMonitorClass", "contains", "Lock")
    steps = [  # cases, signatures, rows to evaluate
        (cases(x=1, y=2), [sig("s", one, lock), sig("t", one, ("nope", "gt", 1))], 2 * 3),
        (cases(x=1, y=2), [sig("s", two, lock), sig("t", one, ("nope", "gt", 1))], 2 * 1),  # one condition changed
        (cases(x=1, y=2), [sig("renamed", lock, two), sig("t", one)], 0),  # known conditions, other signatures
        (cases(x=1, y=2, z=3), [sig("s", lock)], 1),  # a new case; two conditions leave
        (cases(x=5, y=2, z=3), [sig("s", lock, two)], 2 + 2),  # x changed: both; y, z: the one that came back
        (cases(y=2), [sig("s", lock, two), sig("again", lock, lock)], 0),
        (cases(x=5, y=2), [sig("s", lock, two)], 2),  # x came back
        (cases(), [sig("s", lock)], 0),
        (cases(x=5), [], 0),
    ]
    store = ConditionStore(spark, str(tmp_path / "store"))
    for n, (signals, signatures, evaluated) in enumerate(steps):
        sigs = spark.createDataFrame(signatures, sg.SIGNATURE)
        if n == 4:  # a run that was lost before it counted
            cases(x=9).selectExpr("case_id", "'k' AS condition_key", "true AS matched", "'' AS observed_value", "4 AS run").write.parquet(str(tmp_path / "store/results/part=4"))
        run = store.rematch(signals, sigs)
        assert (run.number, run.evaluated.count()) == (n, evaluated)
        seen = lambda df: sorted(map(str, df.select("case_id", "rank", "signature_id", "confidence_score", "matched_conditions", "unmatched_conditions").collect()))
        assert seen(run.findings) == seen(rematch(signals, sigs))
    assert len(store.runs()) == 2
