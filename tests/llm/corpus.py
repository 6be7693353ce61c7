"""Small corpora for the tests: plain ones, and one that holds every awkward row."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SYLLABLES = {
    "en": "the and ing tion er re th at on en ou ha st es nd to".split(),
    "de": "der die und sch ein keit ung lich be ver ge zu heit ach tz pf".split(),
    "fr": "le la les eau eux que tre ment ion oi elle ai re pa vi ch".split(),
}


def words(rng, lang, n):
    s = SYLLABLES[lang]
    return ["".join(rng.choice(s) for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(n)]


def prose(rng, lang="en", n=80):
    out = words(rng, lang, n)
    return " ".join(w.capitalize() + "." if i % 9 == 0 else w for i, w in enumerate(out))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        text = prose(rng, lang, rng.randint(30, 120))
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 0.5, True) for r in rows], SCHEMA + ", spans string, size int, score double, kept boolean")


def awkward(seed=2):
    """Nulls in every column, empty and very long texts, repeated rows, ties; ``frame`` adds columns with names of results."""
    rng = random.Random(seed)
    rows = documents(seed, 24)
    long = prose(rng, "en", 40_000)
    same = rows[3]
    return [
        *rows, same, same, (100, same[1], None, "s1", 3), (101, None, "en", "s1", None), (102, "", "de", None, 0), (103, " \t\n ", None, "s2", 4), (104, long, "en", "s0", len(long)),
        (None, prose(rng), "en", "s0", 1), (None, None, None, None, None), (105, "x" * 200_000, "en", "s3", 200_000), (106, "Wort", "de", "s3", 4), (107, "12 34 !!", "fr", "s3", 8),
        (108, "a\x00b \U0001f600 é ß z", "fr", "s2", 9),
    ]


def tokens(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
