"""Importance resampling, WARC bundles and the source audit against plain versions."""

import base64
import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from stallscope.llm import divergence, importance, warc

# Importance resampling ------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest=2):
    w = WORD.findall((text or "").translate(corpus.LOWER))
    return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_ranked(docs, target, draw=importance.Draw()):
    bucket = lambda f: zlib.crc32(f.encode()) % draw.buckets
    seen = [plain_features(t, draw.longest) for _, t in docs]
    s, t = Counter(bucket(f) for _, fs in seen for f in fs), Counter(bucket(f) for x in target for f in plain_features(x, draw.longest)[1])
    of_s, of_t = sum(s.values()) + draw.buckets, sum(t.values()) + draw.buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t)))
    rows = []
    for (doc_id, _), (n, fs) in zip(docs, seen, strict=True):
        weight = sum(gain(bucket(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    enough = sorted((r for r in rows if r[1] >= draw.least_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = enough[: draw.percent * len(enough) // 100]
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)] + [(*r, None) for r in enough[len(drawn) :]] + [(*r, None) for r in rows if r[1] < draw.least_words])


def test_features_without_building_them():
    rng = random.Random(3)
    texts = ["The quick-brown Fox é", None, "", "a  b\x00c", "x" * 100 + " " + "y" * 200 + " Zed " + "é" * 40]
    texts += [" ".join(rng.choice(["a", "bb", "C3", "über", "x" * 62, "x" * 63, "x" * 64, "x" * 65]) for _ in range(200)) for _ in range(4)]
    n_words, rows, bucket = importance.features(pa.array(texts), importance.Draw(longest=3))
    plain = [plain_features(t, 3) for t in texts]
    assert n_words.tolist() == [n for n, _ in plain]
    assert Counter(zip(rows.tolist(), bucket.tolist(), strict=True)) == Counter((i, zlib.crc32(f.encode()) % 10_000) for i, (_, fs) in enumerate(plain) for f in fs)


def test_planes_give_exact_sums():
    rng = np.random.default_rng(1)
    draw = importance.Draw(buckets=1001)
    rows = np.sort(rng.integers(0, 600, 50_000))
    bucket = np.where(rng.random(50_000) < 0.3, 7, rng.integers(0, 1001, 50_000))
    for gain in (rng.integers(-9000, 9000, 1001), np.zeros(1001, np.int64), np.full(1001, -1)):
        want = np.zeros(600, np.int64)
        np.add.at(want, rows, gain[bucket])
        assert importance.weighted_sums(rows, bucket, 600, importance.gain_planes(gain), draw).tolist() == want.tolist()


def test_ranks_against_a_plain_version(spark):
    rows = corpus.awkward() + corpus.documents(8, 150) + [(400 + i, "the same words for ever and ever " * 5, "en", "s0", 1) for i in range(40)]
    target = [corpus.prose(random.Random(5), "en", 60), None, "", "the same words for ever"]
    bench = spark.createDataFrame([(i, t, 0) for i, t in enumerate(target)], "item_id long, text string, weight int")
    for draw in (importance.Draw(), importance.Draw(percent=100, least_words=1, seed=9, longest=3, buckets=97)):
        got = importance.ranked(corpus.frame(spark, rows), bench, draw).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
        assert Counter(tuple(r) for r in got.collect()) == plain_ranked([r[:2] for r in rows], target, draw)
    chosen = {r[0] for r in plain_ranked([r[:2] for r in rows], target) if r[5]}
    drawn = importance.resample(corpus.frame(spark, rows).withColumn("chosen", F.lit(1)), bench)
    assert drawn.columns[-1] == "chosen" and Counter(r.doc_id for r in drawn.collect()) == Counter(r[0] for r in rows if r[0] in chosen)


def test_empty_tables_and_one_number_for_all(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.ranked(corpus.empty(spark), none).collect() == [] and importance.resample(corpus.empty(spark), none).collect() == []
    same = [(None, "w " * 30, "en", "s", 1)] * 2000  # a third of a table may have one number: the sort still deals it
    got = importance.ranked(corpus.frame(spark, same).repartition(16), none)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 501))


# WARC -----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


def pages(n=60):
    rng = random.Random(4)
    rows = [(i, f"http://x.example/{i}?a=%20b", f"<p>{corpus.prose(rng, 'en', rng.randint(1, 200))}</p> \U0001f600\r\n\r\n") for i in range(n)]
    rows += [(100 + i, "http://copy", rows[i % 3][2]) for i in range(30)]
    rows += [(-1, None, rows[1][2]), (200, "", None), (201, "u\r\nWARC-Type: x", ""), (None, "n", rows[5][2]), (None, None, "alone"), (None, "again", "alone"), (202, "long", "é" * 300_000), rows[7], (203, "tiny", "a"), (204, "tiny", "a")]
    return rows


def plain_warc(rows, least=0):
    first = defaultdict(list)
    for i, _, html in rows:
        if i is not None:
            first[html or ""].append(i)
    out = []
    for i, url, html in rows:
        data = (html or "").encode()
        least_id = min(first[html or ""]) if first[html or ""] and len(data) >= least else None
        revisit = least_id is not None and i != least_id
        of = base64.b32encode(hashlib.sha1(data).digest()).decode()
        url = url and re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)
        out.append((f"<urn:page:{'' if i is None else i}:{of}>", i, url, "revisit" if revisit else "response", of, len(data), least_id if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("bundle", [warc.Bundle(), warc.Bundle(frame_bytes=5000, bundle_bytes=2000, least_revisit=2)])
def test_pages_come_back(spark, bundle):
    rows = pages()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", sha1 string, first int").repartition(3)
    index, records, folder = warc.archive(frame, bundle)
    assert Counter(tuple(r) for r in records.collect()) == plain_warc(rows, bundle.least_revisit)
    texts = {(r[0], r[2] or "") for r in rows}
    fetched = warc.fetch(index.where("page_id is null or page_id % 3 = 0"), folder).collect()
    assert Counter(r.page_id for r in fetched) == Counter(r[0] for r in rows if r[0] is None or r[0] % 3 == 0)
    assert all((r.page_id, r.html) in texts for r in fetched if r.html is not None)
    assert {r.page_id for r in fetched if r.html is None} == {r[1] for r in plain_warc(rows, bundle.least_revisit) if r[3] == "revisit"} & {r.page_id for r in fetched}
    if bundle.frame_bytes == 5000:
        assert index.select("bundle").distinct().count() > 3
        frames = index.groupBy("bundle", "frame").agg(F.sum("record_bytes").alias("n"), F.count(F.lit(1)).alias("records")).collect()
        assert len(frames) > 8 and all(r.n <= 5000 or r.records == 1 for r in frames)


def test_a_bundle_is_plain_zstandard(spark):
    index, _, folder = warc.archive(spark.createDataFrame(pages(), PAGES).coalesce(1), warc.Bundle(frame_bytes=8000))
    (name,) = {r.bundle for r in index.collect()}
    data = open(f"{folder.removeprefix('file:')}/{name}", "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    found = list(warc.parse(whole))
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and len(found) == len(pages())
    table = warc.read_seek_table(pa.BufferReader(data))
    full = {k: sum(f[2] for f in table[:k]) for k in range(len(table))}
    at = {(full[r.frame] + r.record_start, r.record_bytes, r.record_id) for r in index.collect()}
    assert at == {(start, size, p.fields["warc-record-id"]) for start, size, p in found}
    name, bad = warc.record(5, "u", b"payload", None, warc.Bundle())
    with pytest.raises(ValueError, match="urn:page:5"):
        next(warc.parse(bad.replace(b"payload\r", b"pAyload\r")))[2].row()
    with pytest.raises(ValueError, match="not a seekable"):
        warc.read_seek_table(pa.BufferReader(b"\0" * 20))


def test_no_pages(spark):
    index, records, _ = warc.archive(spark.createDataFrame([], PAGES))
    assert index.collect() == [] and records.collect() == []


# Source audit ---------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(docs, least, top=50):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = TERM.findall((text or "").translate(corpus.LOWER))
        groups.add((lang or "", source or ""))
        counts[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        p = {}
        for s in [s for g, s in groups if g == lang] + [None]:
            c = counts[lang, s] if s is not None else sum((counts[g] for g in groups if g[0] == lang), Counter())
            n = sum(c[t] for t in kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}
        for s in p:
            if s is None:
                continue
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o not in (s, None))
            term = sorted((p[None][t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])[:top]
            out += [(lang, s, kind, item, -v, k + 1) for kind, found in (("pair", pair), ("term", term)) for k, (v, item) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_audit_against_a_plain_version(spark, least):
    rows = corpus.awkward() + corpus.documents(9, 120) + [(500, "only here", "xx", "a", 1), (501, None, "xx", "b", 1), (502, "", "yy", None, 1)]
    rows += [(600 + i, "the ing " * (1 + i % 3), "en", f"s{i % 7}", 1) for i in range(60)]
    got = divergence.audit_sources(corpus.frame(spark, rows), divergence.Audit(least_docs=least, top_terms=7))
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit([r[1:4] for r in rows], least, 7)


def test_tree_settles_every_node_once():
    rng = random.Random(6)
    rows = Counter(tuple((s, rng.choice((3, 5, 90)), s % 4) for s in sorted(rng.sample(range(9), rng.randint(1, 9)))) for _ in range(400))
    tree, want = divergence.PatternTree(), Counter()
    for items, times in sorted(rows.items()):
        tree.insert(np.array(items), times)
        for j, (b, p, z) in enumerate(items):
            for a, q, y in items[:j]:
                want[a << 32 | b] += times * (abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y))
    keys, values = tree.close()
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == dict(want) and len(tree.path) == 0


def test_shares_are_exact_and_nothing_gives_nothing(spark):
    cases = [(0, 0, 1), (10**13, 3 * 10**13 + 1, 10**6), (2**53 + 1, 2**62, 7), (1, 2**62, 10**9)]
    frame = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in frame.select(divergence.share(F.col("c"), F.col("n"), F.col("v"), divergence.Audit())).collect()]
    assert got == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]
    assert divergence.audit_sources(corpus.empty(spark)).collect() == []
    plan = divergence.tree_corrections(spark.createDataFrame([], "lang string, items array<struct<i:long,p:long,z:long>>"))
    assert plan.collect() == []
