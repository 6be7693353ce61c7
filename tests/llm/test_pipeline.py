"""The pipeline against brute force, stage by stage and as a whole."""

import random
from collections import Counter

import corpus
import pytest
from test_corpus_operators import groups_of, sets_of
from test_row_operators import plain_spans

import corpus_pipeline as pipeline
from stallscope.llm import mixing


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with documents and benchmark, and what was planted."""
    rng = random.Random(21)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, corpus.prose(rng, "en", 40)) for i in range(6)]
    rows, planted = [], {"rejected": set(), "contaminated": set(), "secret": set()}
    for i, (_, text, lang, source, _) in enumerate(corpus.documents(22, 120)):
        if i % 20 == 3:
            text = "123 456 !! ... 789"
            planted["rejected"].add(i)
        elif i % 20 == 5:
            text = f"{text} {items[i // 20][1]} {text[:40]}"
            planted["contaminated"].add(i)
        elif i % 20 == 7:
            text = f'{text} token = "{rng.randbytes(20).hex()}" {text[:30]}'
            planted["secret"].add(i)
        rows.append((i, text, lang if i % 9 else None, source, len(text)))
    for i in range(30):  # exact and near copies; the copy has the larger number
        w = rows[(i * 4) % 120][1].split(" ")
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        rows.append((200 + i, " ".join(w), "en", "s0", 1))
    rows += [(300, None, "en", "s1", None), (301, "", None, None, 0), rows[0], (None, corpus.prose(rng, "de", 60), "de", None, 9), (302, "x" * 100_000 + " the end of it", "en", "s2", 1)]
    # Columns with names that stages use themselves.
    spark.createDataFrame([(*r, f"own {r[0]}", f"place {r[0]}", -5) for r in rows], corpus.SCHEMA + ", number string, Place string, mix_shard int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items, planted


def test_stages_one_after_another(spark, made, tmp_path):
    folder, rows, items, planted = made
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns or name == "mix" and docs.columns == [*columns[:-1], "mix_copy", "mix_shard"]
        assert all(r.number == f"own {r.doc_id}" and r.Place == f"place {r.doc_id}" and (r.mix_shard == -5) == (name != "mix") for r in docs.collect())
        seen[name] = [tuple(r) for r in docs.collect()]
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "secrets", "mix"]

    rejected = planted["rejected"] | {300, 301}
    kept = [r for r in rows if r[0] not in rejected]
    assert Counter(r[:5] for r in seen["language"]) == Counter(kept)

    groups = groups_of(sets_of([r for r in kept if r[0] is not None], 5))
    first = {i for i, g in groups.items() if i == g} | {None}
    assert Counter(r[0] for r in seen["near_duplicates"]) == Counter(first) and len(first) < len({r[0] for r in kept}) - 15

    clean = first - planted["contaminated"]
    assert {r[0] for r in seen["decontaminate"]} == clean
    texts = {r[0]: r[1] for r in rows}
    for r in seen["secrets"]:
        spans = plain_spans(texts[r[0]])
        assert (r[1] == texts[r[0]]) == (spans == "") and plain_spans(r[1]) == "" and r[4] == len(r[1])
    assert {r[0] for r in seen["secrets"]} == clean and {r[0] for r in seen["secrets"] if "[secret]" in r[1]} == planted["secret"] & clean

    size = {r[0]: len(corpus.tokens(r[1])) for r in seen["secrets"]}
    source = {r[0]: r[3] for r in seen["secrets"]}
    total, taken = Counter(), Counter()
    for i, s in source.items():
        total[s] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([total[s] for s in order], [(3, 1, 2)[k % 3] for k in range(len(order))], 1.5 * sum(size.values()), 2), strict=True))
    for r in seen["mix"]:
        taken[r[3]] += size[r[0]]
    assert max(Counter(r[0] for r in seen["mix"]).values()) <= 2
    assert all(abs(taken[s] - want[s]) <= max(size[i] for i in source if source[i] == s) / 2 + 1 for s in order)  # whole documents only


def test_run_is_the_stages_and_agrees_with_itself(spark, made):
    folder, *_ = made
    one, two = pipeline.run(spark, folder), pipeline.run(spark, folder)
    rows = Counter(tuple(r) for r in one.collect())
    assert rows == Counter(tuple(r) for r in two.collect()) and sum(rows.values()) > 80
    assert pipeline.CHECKS["pipeline"] == (pipeline.run, pipeline.ORACLE_SQL) and len(pipeline.CHECKS) >= 11


def test_empty_tables_go_through(spark, tmp_path):
    corpus.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
