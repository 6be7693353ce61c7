"""Documents of one line and any size give the events of their lines, however the file is split."""

import json
import random

import builders as b
import pytest
from test_streaming import raw

from stallscope.sources import cdn_export as ce
from stallscope.sources import split_json

SPLITS = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def split(spark):
    """Sets the bytes of a file split for the test."""
    before = {k: spark.conf.get(k) for k in (SPLITS, COST)}

    def to(n):
        spark.conf.set(SPLITS, str(n))
        spark.conf.set(COST, "0")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def records(n, seed=1):
    rnd = random.Random(seed)
    odd = ["plain", 'quote " and \\ and }{][', "ends with \\", "{", "}]", "é\U0001f600\n", '\\"}', ""]
    return [{"i": i, "s": rnd.choice(odd) * rnd.randint(0, 3), "o": {"l": [1, {"x": rnd.choice(odd)}, []], "e": {}}, rnd.choice(odd): None} for i in range(n)]


@pytest.mark.parametrize("size", [37, 100, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 1])
def test_records_whatever_the_split(spark, split, tmp_path, size, indent):
    recs = records(60 if size < 100 else 200)
    text = json.dumps(recs, indent=indent)
    docs = {
        "array.json": text, "results.json": '{"preview": false, "results" : ' + text + ', "more": {"a": [1]}}', "result.json": '{"result":' + text + "}\n",
        "objects.json": "".join(json.dumps(r, indent=indent) for r in recs), "lines.json": "\n".join(json.dumps(r) for r in recs) + "\n",
        "odd.json": '[1, "a{b}", null, ' + text[1:-1] + ', "}"]', "cut.json": text[:-3], "none.json": "", "words.json": "no { records [ here", "empty.json": "[]",
    }
    for name, doc in docs.items():
        (tmp_path / name).write_text(doc)
    split(size)
    got = {}
    rows = split_json.read_records(spark, str(tmp_path)).orderBy("source_file", "ord").collect()
    for r in rows:
        got.setdefault(r.source_file.rsplit("/", 1)[-1], []).append(json.loads(r.value))
    want = dict.fromkeys(("array.json", "results.json", "result.json", "objects.json", "lines.json", "odd.json"), recs) | {"cut.json": recs[:-1]}
    assert got == want


def test_a_large_array_is_read_by_several_tasks(spark, split, tmp_path):
    rows = b.service(b.across_pops(20) + b.bots_on_cold_pop(15), "one") * 20
    events = [raw(r) for r in rows]
    (tmp_path / "array").mkdir()
    (tmp_path / "array" / "a.json").write_text(json.dumps(events))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(map(json.dumps, events)))
    split(50_000)
    found = split_json.read_records(spark, str(tmp_path / "array"))
    pieces = spark.read.option("lineSep", "}").text(str(tmp_path / "array"))
    assert pieces.rdd.getNumPartitions() > 4
    plain = lambda df: sorted(map(str, df.drop("source_file", "ord").collect()))
    assert plain(ce.parse_lines(found)) == plain(ce.parse_lines(ce.read_lines(spark, str(tmp_path / "lines"))))


def test_braces_are_counted_without_a_function_of_every_part(spark, tmp_path):
    (tmp_path / "a.json").write_text('["a{\\"b}", {"i": "[x"}, {}]')
    pieces = split_json._pieces(spark, str(tmp_path), None)
    assert "lambda" not in pieces._jdf.queryExecution().optimizedPlan().toString()
