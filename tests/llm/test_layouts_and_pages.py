"""Chat formatting and HTML extraction."""

import hashlib
import json
import random

import corpus
import pytest
from pyspark.sql import functions as F

from stallscope.llm import chat_format, html_text
from stallscope.llm.html_text import main_text

# Chats ----------------------------------------------------------------------------------------------------------

RECORDS = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"messages": []}, []),
    ({"chat": {"messages": [{"content": "a", "role": "system"}]}}, [("system", "a")]),
    ([{"role": "user", "content": None}, {"role": "assistant", "content": 3}], [("user", ""), ("assistant", "3")]),
    ([{"role": "user", "content": "x"}, {"role": "assistant", "content": 3}], None),  # mixed types have no tree of ours
    ([{"role": "user", "content": "x"}], [("user", "x")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": "c"}]}, [("user", "a"), ("assistant", "b"), ("tool", "c")]),
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"completion": None, "prompt": "p"}, [("user", "p"), ("assistant", "")]),
    ({"prompt": "p", "response": "r", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"instruction": "i", "input": "more", "output": "o"}, [("user", "i\n\nmore"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"question": "q", "answer": "a", "context": ""}, [("user", "q"), ("assistant", "a")]),
    ({"question": "q", "answer": "a", "context": "c"}, [("system", "c"), ("user", "q"), ("assistant", "a")]),
    ({"unknown": 1}, None),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(98, "no json"), (99, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, payload string, turns string, _record int")
    got = {r.conv_id: None if r.turns is None else [tuple(t) for t in r.turns] for r in chat_format.canonical_turns(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(RECORDS)} | {98: None, 99: None}


def test_fingerprints_ignore_types_and_order(spark):
    pairs = [('{"b":1,"a":{"c":[{"d":"x"}]}}', '{"a":{"c":[{"d":2.5},{"d":7.25}]},"b":true}'), ('{"a":[]}', '{"a":[1]}')]
    df = spark.createDataFrame(pairs, "x string, y string").select(*[chat_format.fingerprint(F.parse_json(c)).alias(c) for c in ("x", "y")])
    same = [r.x == r.y for r in df.collect()]
    assert same == [True, False]
    assert len({x.fingerprint for x in chat_format.LAYOUTS}) == len(chat_format.LAYOUTS)


def conversations(rng, n=60):
    bits = ["<|im_start|>", "<|im_end|>", "\n", "<", "|", "\\", "<\\|", "é", "\U0001f600", " ", "text", '"', "\t", "$1", "\x01"]
    rows = []
    for c in range(n):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 3, ["user", "we\nird\\n|", "assistant"], ["assistant"]])
        for t, role in enumerate(roles):
            rows.append((c, t, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) if rng.random() < 0.95 else None))
    return rows


def test_formatting_reads_back_exactly(spark):
    rng = random.Random(3)
    rows = [*conversations(rng), (None, None, None, None), (70, 1, "user", "same"), (70, 1, "user", "same"), (71, 0, "user", "x" * 100_000), (71, 1, "assistant", "<|" * 50_000)]
    df = spark.createDataFrame([(*r, "y", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, payload int")
    canonical = chat_format.canonical_turns(chat_format.conversation_records(df))
    formatted = chat_format.format_chats(canonical).cache()
    texts = {r.conv_id: r for r in formatted.collect()}
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.read_back(formatted)).collect()}
    by_conv = {}
    for c, t, role, text in rows:
        by_conv.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by_conv)
    assert len({r.layout for r in canonical.collect()}) >= 5
    for c, turns in by_conv.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert g.formatted_chars == len(texts[c].formatted) == sum(x.before + x.loss + x.after for x in texts[c].loss_runs)
        assert texts[c].formatted.count("<|im_start|>") == len(turns) == texts[c].formatted.count("<|im_end|>\n")


def test_formatting_is_native_and_takes_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = chat_format.chat_digest(chat_format.read_back(chat_format.format_chats(chat_format.canonical_turns(chat_format.conversation_records(none)))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.collect() == [] and "Python" not in plan and "Arrow" not in plan


def test_long_records_are_read(spark):
    one = F.repeat(F.lit('a"\\é'), 5_500_000)  # a text of 22 million characters; and 15 texts of 10 million, 150 MB as a whole
    rows = spark.range(1).select(F.lit(0).alias("conv_id"), F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role"), one.alias("text"))
    many = spark.range(15).select(F.lit(1).alias("conv_id"), F.col("id").cast("int").alias("turn"), F.lit("assistant").alias("role"), F.repeat(F.lit("0123456789"), 1_000_000).alias("text"))
    records = chat_format.conversation_records(rows.unionByName(many))
    canonical = chat_format.canonical_turns(records)
    got = {r.conv_id: r for r in chat_format.chat_digest(chat_format.read_back(chat_format.format_chats(canonical))).collect()}
    for c, turns in {0: [("user", 'a"\\é' * 5_500_000), ("assistant", 'a"\\é' * 5_500_000)], 1: [("assistant", "0123456789" * 1_000_000)] * 15}.items():
        said, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_outlines_have_the_fingerprint_and_texts_of_their_records(spark):
    texts = [json.dumps(r) for r, _ in RECORDS] + ['{"messages": [{"role": "a", "content": "\\ud83d\\u00e9\\\\\\""} , {"content": "x", "role": "b"}]}']
    broken = ["no json", '{"prompt": "p\n", "completion": "c"}', '{"prompt": "\\x", "completion": "c"}', '{"prompt": "p", "completion": "c', '{"prompt": "p\\" x \\" \t", "completion": ","}']
    df = spark.createDataFrame([(t,) for t in texts + broken], "payload string")
    both = df.select("payload", chat_format.fingerprint(F.try_parse_json("payload")).alias("a"), chat_format._outline_print(F.col("payload")).alias("b"))
    for r in both.collect():
        assert r.a == r.b and (r.a is None) == (r.payload in broken)
    for x in chat_format.LAYOUTS:
        of = [chat_format._turns(v, F.col("payload"), x) for v in (F.try_parse_json("payload"), F.lit(None).cast("variant"))]
        mine = both.where(F.col("a") == x.fingerprint).select(of[0].alias("x"), of[1].alias("y"))
        assert all(r.x == r.y for r in mine.collect())


# Pages ----------------------------------------------------------------------------------------------------------

LONG = "The first of the paragraphs is long enough to be decided by the words that are in it, and it is in the article for that."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<", ""),
        (f"<nav><a href=/>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; Me and the others</footer>", f"Title\n{LONG}\nShort."),
        (f"<article><p>a &amp; b &lt;i&gt; \n\t c&nbsp;d</p><p>{LONG}</p></article>", f"a & b <i> c d\n{LONG}"),
        (f"<article><p>one <b>two<i>three</b>four<br>five</p><p>{LONG}", f"one twothreefour five\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><p>End</p></article>", f"{LONG}\nEnd"),
        (f"<body><script>var x = '<p>{LONG}</p>';</script><style>p {{}}</style><p>{LONG}</p><!-- <p>no</p> --><form><p>{LONG}</p></form></body>", LONG),
        (f"<div id=cookie-notice><p>{LONG}</p></div><main><p>{LONG}</main><aside>{LONG}</aside>", LONG),
        (f"<header><p>{LONG}</p></header><article><header><h1>Kept</h1></header><p>{LONG}</p></article>", f"Kept\n{LONG}"),
        (f"<div class=sidebar>{LONG}</div><article>{LONG}<div class=ad>Buy it</div><div style='display: none'>{LONG}</div></article>", LONG),
        (f"<p>{LONG}</p><p>between</p><p>{LONG}</p><ul><li><a>one link</a><li><a>another link</a></ul><p>after</p>", f"{LONG}\nbetween\n{LONG}"),
        ("<article><p>x > y & 1 < 2</p></article>", "x > y & 1 < 2"),
        ("<article><p title=\"a>b\" data-x='<p>'>inside</p></article>", "inside"),
        ("<article><p>Only short text.", "Only short text."),
        ("<article><textarea>typed</textarea><select><option>A<option>B</select><button>Go</button><p>Text", "Text"),
        (f"</div></p><article></section><p>{LONG}</span></article></article>", LONG),
        (f"<article><p>{LONG}</p><script>never closed <p>lost", LONG),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_short_blocks_take_the_label_of_the_nearer_neighbour():
    blocks = [html_text.Block(0, False, [t], k) for t, k in ((LONG, 0), ("near good", 0), ("mid", 0), ("near bad", 0), ("a link " * 20, 140))]
    assert html_text.labels(blocks, html_text.Rules()) == [True, True, False, False, False]
    assert html_text.labels(blocks[1:4], html_text.Rules()) == [False] * 3
    inside = [html_text.Block(1, False, ["short"], 0)]
    assert html_text.labels(inside, html_text.Rules()) == [True]


def test_pages_of_the_table(spark):
    rng = random.Random(2)
    rows = []
    want = {}
    for i in range(40):
        paragraphs = [corpus.prose(rng, rng.choice(("en", "de", "fr")), rng.choice((2, 30, 300))) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{p}</p>" if rng.random() < 0.7 else f"<p>{p}" for p in paragraphs)
        rows.append((i, f"u{i}", f"<html><nav><ul><li><a href=x>{corpus.prose(rng, 'en', 3)}</a></ul></nav><article>{body}</article><footer>{corpus.prose(rng)}</footer>", "t"))
        want[i] = "\n".join(paragraphs)
    rows += [(40, None, None, None), (41, "u", "", "t"), (None, "u", "<article><p>" + "long text " * 30_000, "t")]
    want |= {40: "", 41: "", None: ("long text " * 30_000).strip()}
    df = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string, text string")
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows) + 1 and {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(df.limit(0)).collect() == []


@pytest.mark.parametrize("piece", ["<", "<a", '<a "', "<p>", "<svg>", "<!--", "&", "<div class='", "</", "<script>"])
def test_broken_pages_take_linear_time(piece):
    import time

    start = time.perf_counter()
    main_text("<article>" + piece * 30_000)
    assert time.perf_counter() - start < 5
