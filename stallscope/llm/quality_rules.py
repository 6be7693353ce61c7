"""Quality by weak supervision, in DataFrame functions only.

Rules look at counts of a text and vote good (1), bad (-1) or abstain (0). Nobody says which rule is right:
expectation-maximisation over the corpus's vote patterns estimates for each rule how often it votes good and bad on
good and on bad documents, and the share of good documents. A document's verdict is the posterior probability of good
given its votes, so a rule that is often outvoted weighs little and no single rule has a veto.

The corpus goes into the estimate as counts of vote patterns, of which there are at most 3 to the number of
rules (``RULES``), whatever its size. The counts of the text, all in one pass over its words:

- ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` as the names say,
- ``n_repeat_words``: words inside 5-word windows that occur twice or more in the text. Windows are compared by
  hash, and those whose hash repeats by their words.

A null text has no words. A text without words fails the base rules. Repeated rows count as often as they are
there; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallscope.llm.common import WORD
from stallscope.session import Staging

WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"
PLAIN = r"^[(\"']*\p{L}[\p{L}'’-]*[.,;:!?)\"']*$"  # letters with the usual marks around them
GOOD, BAD, ABSTAIN = 1, -1, 0

# Stop words: a few of the commonest function words of each language.
STOP_WORDS = "the of and to in is that it for der die und das von den ist de la que el en los y le les et des est".split()


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, else bad where ``bad`` holds, else abstains."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


NEVER = F.lit  # a rule that only objects says NEVER(False) for good

RULES: tuple[Rule, ...] = (
    Rule("length", lambda: F.col("n_words").between(50, 100_000), lambda: F.col("n_words") < 10),
    Rule("word length", lambda: NEVER(False), lambda: ~_share("word_chars").between(2.5, 14.0)),
    Rule("symbols", lambda: NEVER(False), lambda: _share("n_symbols") > 0.1),
    Rule("plain words", lambda: _share("n_plain_words") >= 0.9, lambda: _share("n_plain_words") < 0.6),
    Rule("repeated lines", lambda: NEVER(False), lambda: _share("n_dup_lines", "n_lines") > 0.2),
    Rule("repeated words", lambda: NEVER(False), lambda: _share("n_repeat_words") > 0.15),
    Rule("stop words", lambda: _share("n_stop_words") >= 0.06, lambda: (_share("n_stop_words") < 0.02) & (F.col("n_words") >= 30)),
    Rule("capitals", lambda: NEVER(False), lambda: _share("n_capitals", "word_chars") > 0.3),
    Rule("exclamations", lambda: NEVER(False), lambda: _share("n_exclamations") > 0.1),
    Rule("sentences", lambda: _share("n_sentences").between(1 / 40, 1 / 3), lambda: (_share("n_sentences") < 1 / 100) & (F.col("n_words") >= 20)),
)
ROUNDS = 30
# Where the estimate starts: the share of good documents; how often a rule votes good and bad on good and on bad ones.
FIRST_SHARE = 0.8
FIRST_VOTES = {"good_good": 0.6, "good_bad": 0.02, "bad_good": 0.3, "bad_bad": 0.3}
WEIGHT = 2.0  # imaginary documents at these values, which keep every estimate inside (0, 1)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row, whatever the optimizer does."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more, from the array of a text's words."""
    last = F.size(words) - WINDOW
    window = lambda i: [words[i + k] for k in range(WINDOW)]
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*window(i)))

    def twins(pairs: Column) -> Column:
        """Positions of those pairs (value, position), sorted, that share their value with a neighbour."""
        near = lambda p, i: (
            (F.get(pairs, i - 1)["v"] == p["v"]) & (i > 0) | F.coalesce(F.get(pairs, i + 1)["v"] == p["v"], F.lit(False))
        )
        return F.transform(F.filter(pairs, near), lambda p: p["i"])

    keyed = lambda value: lambda x, i: F.struct(value(x, i).alias("v"), i.alias("i"))
    by_hash = lambda h: bind(F.sort_array(F.transform(h, keyed(lambda x, i: x))), twins)
    exact = lambda at: bind(
        F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("v"), i.alias("i")))), lambda p: F.sort_array(twins(p))
    )
    covered = lambda at: F.when(F.size(at) == 0, 0).otherwise(
        F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    )
    count = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(bind(bind(by_hash(h), exact), covered)))
    return F.when(last < 1, 0).otherwise(count).cast("long")


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every row's whole text."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), 0)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    of_words = bind(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit(PLAIN)))).cast("long").alias("n_plain_words"),
        ),
    )
    of_lines = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.select(
        "doc_id", of_words.alias("_w"), of_lines.alias("_l"), F.length(F.regexp_replace(text, F.lit(r"[\x20\x09-\x0D]+"), F.lit(""))).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"), count(r"\p{Lu}").alias("n_capitals"), count(r"!").alias("n_exclamations"),
        count(r"[.?!](?=[\x20\x09-\x0D]|$)").alias("n_sentences"),
    )
    return counted.select("doc_id", "_w.*", "_l.*", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_sentences")


def votes(rules: tuple[Rule, ...] = RULES) -> Column:
    return F.array(*[F.when(r.good(), F.lit(GOOD)).when(r.bad(), F.lit(BAD)).otherwise(F.lit(ABSTAIN)) for r in rules])


def _posterior(state: Column, vote: Column, rules: int) -> Column:
    """Probability of good given the votes: prior odds times one factor for each rule; abstaining tells something too."""
    logit = F.log(state["share"] / (1 - state["share"]))
    for r in range(rules):
        s = state["rules"][r]
        logit = logit + (
            F.when(vote[r] == GOOD, F.log(s["good_good"] / s["bad_good"])).when(vote[r] == BAD, F.log(s["good_bad"] / s["bad_bad"]))
            .otherwise(F.log((1 - s["good_good"] - s["good_bad"]) / (1 - s["bad_good"] - s["bad_bad"])))
        )
    return 1 / (1 + F.exp(-logit))


def estimate(patterns: Column, rules: int, rounds: int = ROUNDS) -> Column:
    """The state after ``rounds`` of expectation-maximisation over an array of (votes, n).

    ``share``: of good documents. ``rules``: for each rule how often it votes good and bad on good documents
    (``good_good``, ``good_bad``) and on bad ones (``bad_good``, ``bad_bad``); else it abstains.
    """
    start = F.struct(*[F.lit(v).alias(k) for k, v in FIRST_VOTES.items()])
    first = F.struct(F.lit(FIRST_SHARE).alias("share"), F.array_repeat(start, rules).alias("rules"))

    def total(rows: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, p: a + value(p))

    def again(state: Column, _: Column) -> Column:
        weighed = F.transform(
            patterns, lambda p: bind(_posterior(state, p["votes"], rules), lambda q: F.struct(p["votes"].alias("votes"), (p["n"] * q).alias("good"), (p["n"] * (1 - q)).alias("bad")))
        )

        def step(rows: Column) -> Column:
            sums = F.struct(*[total(rows, lambda p, side=side: p[side]).alias(side) for side in ("good", "bad")])

            def rule(r: Column, n: Column) -> Column:
                rate = lambda side, vote: (
                    (total(rows, lambda p: F.when(p["votes"][r] == vote, p[side]).otherwise(0.0)) + WEIGHT * FIRST_VOTES[f"{side}_{'good' if vote == GOOD else 'bad'}"])
                    / (n[side] + WEIGHT)
                )
                return F.struct(
                    rate("good", GOOD).alias("good_good"), rate("good", BAD).alias("good_bad"), rate("bad", GOOD).alias("bad_good"), rate("bad", BAD).alias("bad_bad")
                )

            return bind(
                sums,
                lambda n: F.struct(
                    ((n["good"] + WEIGHT * FIRST_SHARE) / (n["good"] + n["bad"] + WEIGHT)).alias("share"),
                    F.transform(F.sequence(F.lit(0), F.lit(rules - 1)), lambda r: rule(r, n)).alias("rules"),
                ),
            )

        return bind(weighed, step)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, again)


def pattern_probabilities(counted: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """votes, n, posterior and the estimate of every vote pattern: at most 3 ** rules rows."""
    patterns = counted.groupBy(votes(rules).alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    gathered = patterns.agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"))
    learned = gathered.select("patterns", estimate(F.col("patterns"), len(rules)).alias("estimate"))
    each = learned.select("estimate", F.explode("patterns").alias("p"))
    return each.select("p.votes", "p.n", "estimate", _posterior(F.col("estimate"), F.col("p.votes"), len(rules)).alias("quality"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """Counts, base_failed, kept and quality (the posterior) of every row."""
    counted = Staging(docs.sparkSession, "quality").write("counts", text_counts(docs))
    learned = pattern_probabilities(counted, rules).select(F.col("votes").alias("_votes"), "quality")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The patterns are bounded by the rules: 3 ** 10 rows at most.
    known = counted.withColumn("_mine", votes(rules)).join(F.broadcast(learned), F.col("_mine") == F.col("_votes"), "left")
    return known.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("quality") >= least)).alias("kept"), "quality",
    )
