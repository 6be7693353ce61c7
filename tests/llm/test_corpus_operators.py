"""Operators over the whole corpus: language model, near-duplicates, mixing, components."""

import math
import random
import zlib
from collections import Counter, defaultdict

import corpus
import numpy as np
import pytest

from stallscope.llm import interpolated_lm, mixing, odd_sketch
from stallscope.llm.components import components
from stallscope.session import Staging


def by_row(df):
    return [r.asDict() for r in df.collect()]


# Language model -------------------------------------------------------------------------------------------------


def lm_by_hand(rows, weights, cell_weights=None):
    tokens = {r[0]: [*corpus.tokens(r[1]), None] for r in rows}
    train = [i for i in tokens if zlib.crc32(str("" if i is None else i).encode()) % 5 != 1]
    uni, pair, context = Counter(), Counter(), Counter()
    for i in train:
        uni.update(tokens[i])
        pair.update(zip(["<s>", *tokens[i]], tokens[i], strict=False))
        context.update(["<s>", *tokens[i][:-1]])
    n, v, out = sum(uni.values()), len(uni), {}
    for i, t in tokens.items():
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)
        score = 0.0
        for a, b in zip(["<s>", *t], t, strict=False):
            c = context[a]
            w = weights[min(math.floor(math.log2(max(c, 0.5))) + 1, interpolated_lm.BUCKETS - 1)]
            score += math.log10(w[0] * (pair[a, b] / c if c else 0) + w[1] * uni[b] / n + w[2] / (v + 1))
        out[i] = (len(t), sum(uni[x] > 0 for x in t), base, score)
    return n, out


@pytest.mark.parametrize("settings", [interpolated_lm.Interpolation(), interpolated_lm.Interpolation(block_bytes=9000, range_bytes=7000)])
def test_scores_equal_counts_by_hand(spark, monkeypatch, settings):
    rows = [r for k, r in enumerate(corpus.awkward() + [(500 + r[0], *r[1:]) for r in corpus.documents(4, 60)]) if not (r[0] is None and r[1] is None) and k not in (24, 25)]
    kept = {}
    plain = interpolated_lm.mixture
    monkeypatch.setattr(interpolated_lm, "mixture", lambda *a: kept.setdefault("w", plain(*a)))
    got = by_row(interpolated_lm.score_documents(corpus.frame(spark, rows), settings))
    n, want = lm_by_hand(rows, kept["w"])
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    for r in got:
        length, known, base, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (length, known, n)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        assert r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 5 == 1)


def test_repeated_rows_and_empty_tables_are_scored(spark):
    rows = corpus.documents(4, 10)
    got = by_row(interpolated_lm.score_documents(corpus.frame(spark, [*rows, rows[0], rows[0], (77, None, None, None, None)])))
    assert sorted(r["doc_id"] for r in got) == sorted([*range(10), 0, 0, 77]) and {r["n_tokens"] for r in got if r["doc_id"] == 77} == {1}
    assert interpolated_lm.score_documents(corpus.empty(spark)).collect() == []


def test_mixture_is_the_maximum_of_the_deleted_likelihood():
    rng = np.random.default_rng(2)
    half = interpolated_lm.CELLS // 2
    cells = np.array([[5, half + rng.integers(10, 90), half + rng.integers(-10, 60), rng.integers(1, 50)] for _ in range(40)] + [[5, 0, half + 5, 200], [5, 0, 0, 90]])
    w = interpolated_lm.mixture(cells, 400)[5]
    size = lambda c: np.where(c > 0, 2.0 ** ((c - half) / interpolated_lm.STEPS), 0)
    like = lambda x: (cells[:, 3] * np.log(x[0] * size(cells[:, 1]) + x[1] * size(cells[:, 2]) + x[2])).sum()
    assert w.sum() == pytest.approx(1) and (w > 0).all()
    for _ in range(200):
        other = np.abs(w + rng.normal(0, 0.02, 3))
        assert like(other / other.sum()) <= like(w) + 0.2


def test_a_model_of_the_language_beats_the_base_on_held_out_text(spark):
    rng = random.Random(3)
    follow = {a: rng.choices("abcdefgh", k=3) for a in "abcdefgh"}
    rows = []
    for i in range(300):
        w = ["a"]
        for _ in range(60):
            w.append(rng.choice(follow[w[-1]]))
        rows.append((i, " ".join(w), "en", "s", 1))
    got = [r for r in by_row(interpolated_lm.score_documents(corpus.frame(spark, rows))) if r["held_out"]]
    tokens = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / tokens > sum(r["base_score"] for r in got) / tokens + 0.2


# Near-duplicates ------------------------------------------------------------------------------------------------


def sets_of(rows, size):
    out = {}
    for r in rows:
        w = corpus.tokens(r[1])
        out.setdefault(r[0], set()).update({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    return out


def groups_of(sets, percent=80):
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_corpus(seed, n=40):
    """Groups of copies, of near copies around the threshold, and chains of them."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        w = corpus.words(rng, rng.choice(("en", "de")), rng.randint(3, 120))
        for _ in range(rng.choice((1, 1, 2, 5))):
            rows.append(" ".join(w) if rng.random() < 0.5 else "\n".join(w).upper())
            if rng.random() < 0.8:  # the next one differs from this one
                for _ in range(rng.randint(0, max(1, len(w) // 12))):
                    w[rng.randrange(len(w))] = rng.choice(("the", "new", f"n{rng.random()}"))
    rng.shuffle(rows)
    return [(i, t, "en", "s", 1) for i, t in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_brute_force(spark, size):
    rows = [r for r in corpus.awkward() if r[0] is not None] + [(1000 + r[0], *r[1:]) for r in near_corpus(size)]
    sets = sets_of(rows, size)
    want = groups_of(sets)
    got = by_row(odd_sketch.near_duplicates(corpus.frame(spark, rows), odd_sketch.Near(shingle=size)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((r[0], len(sets[r[0]]), want[r[0]], want[r[0]] == r[0]) for r in rows)
    assert len(set(want.values())) < len(want) - 20


def test_a_large_group_of_near_copies_without_its_pairs(spark):
    """Near copies of one text, many of them below the threshold against each other: the links still join them."""
    rng = random.Random(8)
    base = corpus.words(rng, "en", 100)
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        rows.append((i, " ".join(w), "en", "s", 1))
    rows += [(1000 + i, "one and the same line of text", "en", "s", 1) for i in range(200)] + [(2000, None, None, None, None), (None, None, None, None, None)]
    want = groups_of(sets_of([r for r in rows if r[0] is not None], 2))
    got = {r["doc_id"]: r for r in by_row(odd_sketch.near_duplicates(corpus.frame(spark, rows), odd_sketch.Near(shingle=2)))}
    assert {i: r["component_id"] for i, r in got.items() if i is not None} == want and got[None]["kept"] is False
    assert odd_sketch.near_duplicates(corpus.empty(spark)).collect() == []


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(4)
    near = odd_sketch.Near()
    for j in (0.8, 0.9, 0.97):
        n = 1000
        one = rng.integers(0, 2**63, n).astype(np.uint64)
        other = one.copy()
        swap = round(n * (1 - j) / (1 + j))
        other[:swap] = rng.integers(0, 2**63, swap).astype(np.uint64)
        at = np.r_[np.zeros(n, np.int64), np.ones(n, np.int64)]
        x, y = odd_sketch.odd_sketches(odd_sketch.min_hashes(at, np.r_[one, other], near))
        z = int(np.bitwise_count(x ^ y).sum())
        estimate = 1 + odd_sketch.BITS / (4 * near.samples) * math.log(1 - 2 * z / odd_sketch.BITS)
        assert abs(estimate - j) < 0.15 and z <= near.most_bits


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, 200 + i) for i in range(50)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    links += [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long"), Staging(spark, "t"), "c").collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        assert got[start] == min(seen)
    assert set(got) == set(near)


# Mixing ---------------------------------------------------------------------------------------------------------


def test_targets_are_water_filled():
    sizes, weights = [100, 10, 50, 0, 1000], [3, 1, 2, 3, 1]
    got = mixing.targets(sizes, weights, 900, 2)
    assert sum(got) == pytest.approx(900) and all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
    open_ = [t / w for t, s, w in zip(got, sizes, weights, strict=True) if t < 2 * s - 1e-9]
    assert max(open_) == pytest.approx(min(open_)) and all(2 * s / w <= open_[0] + 1e-9 for s, w, t in zip(sizes, weights, got, strict=True) if t >= 2 * s - 1e-9)
    assert mixing.targets([], [], 0, 2) == [] and mixing.targets([0], [1], 0, 2) == [0]


def test_splitting_tree_keeps_quotas_and_is_hypergeometric():
    quotas = np.array([40, 7, 0, 130])
    got = mixing.split_quotas(quotas, 8, 1)
    assert got.sum(axis=0).tolist() == quotas.tolist() and set(got.sum(axis=1)) <= {22, 23} and (got >= 0).all()
    first = np.array([mixing.split_quotas(quotas, 2, s)[0] for s in range(600)])
    mean, n = quotas / 2, quotas.sum()
    spread = 88 * (quotas / n) * (1 - quotas / n) * (n - 88) / (n - 1)
    assert np.abs(first.mean(axis=0) - mean).max() < 0.6 and np.abs(first.var(axis=0)[[0, 1, 3]] / spread[[0, 1, 3]] - 1).max() < 0.25


def mixed_rows(spark, n=900):
    rng = random.Random(4)
    rows = [(i, corpus.prose(rng, "en", rng.choice((5, 40, 200))), "en", rng.choice(["a", "b", "c", "c", "c", "c", None, "é"]), 1) for i in range(n)]
    return rows, corpus.frame(spark, rows)


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    rows, docs = mixed_rows(spark)
    got = by_row(mixing.mix_report(docs))
    size = {r[0]: len(corpus.tokens(r[1])) for r in rows}
    source = {r[0]: r[3] for r in rows}
    total = Counter()
    for i, s in source.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weights = [(3, 1, 2)[k % 3] for k in range(len(order))]
    want = dict(zip(order, mixing.targets([total[s] for s in order], weights, 1.5 * sum(size.values()), 2), strict=True))
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[source[r["doc_id"]]] and r["target"] == pytest.approx(want[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 0.005 * want[s] for s in order)
    again = by_row(mixing.mix_report(docs.repartition(5, "text")))
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


@pytest.mark.parametrize("seed", [1, 5, 20])
def test_one_long_document_costs_no_source_its_target(spark, seed):
    rng = np.random.default_rng(3)
    size = [30_000, *rng.integers(20, 180, 600).tolist()]  # a third of its source; the others are blocks of two documents
    size += rng.integers(20, 180, 2000).tolist()
    rows = [(i, "a" if i <= 600 else "b", n) for i, n in enumerate(size)]
    sized = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(4)
    for total in (0.75, 1.5):
        mix = mixing.Mix(weights=(float(sum(size[:601])), float(sum(size[601:]))), total=total, seed=seed, least_blocks=100)
        planned = mixing.plan_mix(sized, mix, Staging(spark, "test")).collect()
        for s in "ab":
            of = [r for r in planned if r.source == s]
            assert len(of) == sum(r[1] == s for r in rows) and abs(sum(r["size"] * len(r.copies) for r in of) - of[0].target) <= 0.005 * of[0].target


def test_blocks_that_do_not_fit_are_skipped():
    size = np.array([5, 90, 5, 80, 5, 0])
    assert [(x.tolist(), left) for x, left in (mixing.fitting(size, np.arange(6), 16.0), mixing.fitting(size, np.arange(6), 98.0))] == [([0, 2, 4, 5], 1.0), ([0, 1], 3.0)]
    assert mixing.choose(size, np.zeros(6), 90.0)[1] == 0


def test_documents_are_drawn_into_shards(spark):
    rows, docs = mixed_rows(spark, 600)
    mix = mixing.Mix(shard_size=8000)
    report = {r["doc_id"]: r for r in by_row(mixing.mix_report(docs, mix))}
    got = by_row(mixing.mix_documents(docs, mix))
    assert list(got[0]) == [*docs.columns, "mix_copy", "mix_shard"]
    copies = Counter(r["doc_id"] for r in got)
    assert all(copies[i] * r["size"] == r["taken"] for i, r in report.items() if r["size"]) and len({(r["doc_id"], r["mix_copy"]) for r in got}) == len(got)
    shards = Counter()
    for r in got:
        shards[r["mix_shard"]] += report[r["doc_id"]]["size"]
    mean = sum(shards.values()) / len(shards)
    assert len(shards) == 16 and all(0.6 * mean < n < 1.4 * mean for n in shards.values())
    by_source = Counter((r["mix_shard"], r["source"]) for r in got)
    assert all(by_source[k, "c"] > 5 for k in shards)


def test_mix_of_awkward_rows(spark):
    rows = corpus.awkward()
    got = by_row(mixing.mix_report(corpus.frame(spark, rows)))
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(r["taken"] <= 2 * r["size"] for r in got)
    written = by_row(mixing.mix_documents(corpus.frame(spark, rows)))
    assert all(n <= 2 * k for n, k in ((v, Counter(r[0] for r in rows)[i]) for i, v in Counter(r["doc_id"] for r in written).items()))
    assert mixing.mix_report(corpus.empty(spark)).collect() == [] and mixing.mix_documents(corpus.empty(spark)).collect() == []
