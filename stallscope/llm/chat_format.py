"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is JSON of any layout. Its fingerprint is a hash of the tree of its nested field paths (types and order
left out); a declarative mapping for that fingerprint says where the turns are. Canonical turns go through one
template, ``<|im_start|>role\\ntext<|im_end|>\\n``, and come with a run-length loss mask.

Control strings inside roles and texts are escaped reversibly: ``<`` followed by any number of backslashes and
``|`` gets one backslash more, so no ``<|`` remains; reading back takes one away. In roles, backslashes and line
feeds are escaped too. ``read_back`` needs nothing but the formatted text and its mask.

Null texts and roles are empty texts. A record that no variant holds (a string of over 20 million characters, or over
128 MiB) takes its fingerprint from its outline, the record without what its strings say, and its texts from
``from_json``; numbers in it are texts as the record writes them. A record must fit one value of Spark (2 GiB), and
so must its formatted text. An outline that no variant holds, without its repeats, raises an error. A record of an
unknown layout, or one that is no JSON, keeps its row with null results. An empty turn list gives an empty text.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"
SCALAR = r": (?:STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|DATE|TIMESTAMP|TIMESTAMP_NTZ|BINARY|UUID)(?=[,>])"
# Possessive, so that Java's matcher needs no stack for a long string; what isn't a JSON string stays and fails to parse.
_STRING = r'[^"\\\x00-\x1f]*+(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*+)*+'
SAID = rf'("{_STRING}"\s*+:)|(")' + _STRING + '(")'
REPEATED = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"
LONG_OUTLINE = 32 << 20  # characters; a variant holds any shorter outline


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: in a list of objects, or in fields that follow each other.

    ``tree`` lists nested field paths the way ``schema_of_variant`` nests them, without types. ``roles``
    renames roles. ``fields`` are (role, path) pairs in turn order; an empty text of an ``optional`` path gives
    no turn. ``joined`` paths are appended to the field before them after a blank line, unless empty.
    """

    name: str
    tree: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    roles: dict[str, str] = field(default_factory=dict)
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = frozenset()
    joined: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.tree.encode()).hexdigest()


SHAREGPT_ROLES = {"human": "user", "gpt": "assistant"}
LAYOUTS: tuple[Layout, ...] = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages"),
    Layout("no messages", "OBJECT<messages: ARRAY<VOID>>", "messages"),
    Layout("nested messages", "OBJECT<chat: OBJECT<messages: ARRAY<OBJECT<content, role>>>>", "chat.messages"),
    Layout("bare messages", "ARRAY<OBJECT<content, role>>", ""),
    Layout("shared", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value", SHAREGPT_ROLES),
    Layout("nothing shared", "OBJECT<conversations: ARRAY<VOID>>", "conversations", "from", "value"),
    Layout("prompt, completion", "OBJECT<completion, prompt>", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt, response", "OBJECT<prompt, response>", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system, prompt, response", "OBJECT<prompt, response, system>", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction, output", "OBJECT<instruction, output>", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        "instruction, input, output", "OBJECT<input, instruction, output>", fields=(("user", "instruction"), ("assistant", "output")), joined={"instruction": "input"}
    ),
    Layout(
        "question, answer, context", "OBJECT<answer, context, question>", fields=(("system", "context"), ("user", "question"), ("assistant", "answer")),
        optional=frozenset(["context"]),
    ),
)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once for each row, whatever the optimizer does."""
    return F.transform(F.array(value), use)[0]


def field_tree(record: Column) -> Column:
    """The nested field paths of a variant, without types."""
    return F.regexp_replace(F.schema_of_variant(record), F.lit(SCALAR), F.lit(""))


def fingerprint(record: Column) -> Column:
    return F.sha2(field_tree(record), 256)


def outline(payload: Column) -> Column:
    """JSON with empty strings for its string values and one object for a run of equal ones: it has the same field tree."""
    return F.regexp_replace(F.regexp_replace(payload, F.lit(SAID), F.lit("$1$2$3")), F.lit(REPEATED), F.lit("$1"))


def _outline_print(payload: Column) -> Column:
    """The fingerprint of a record that no variant holds; null where it is no JSON."""
    lost = lambda o, v: v.isNull() & (F.length(o) > LONG_OUTLINE) & F.get_json_object(o, "$").isNotNull()
    error = F.raise_error(F.lit("the outline of a record is too long for a variant")).cast("string")
    return bind(outline(payload), lambda o: bind(F.try_parse_json(o), lambda v: F.when(lost(o, v), error).otherwise(fingerprint(v))))


def _read(payload: Column, path: str, kind: str) -> Column:
    """What lies at a path of JSON of any length."""
    names = path.split(".") if path else []
    for name in reversed(names):
        kind = f"struct<`{name}`:{kind}>"
    value = F.from_json(payload, kind, {"maxStringLen": str(2**31 - 1)})
    for name in names:
        value = value[name]
    return value


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(record: Column, payload: Column, layout: Layout) -> Column:
    get = lambda path, kind: F.when(record.isNotNull(), F.try_variant_get(record, f"$.{path}" if path else "$", kind)).otherwise(_read(payload, path, kind))
    if layout.turns is not None:
        listed = get(layout.turns, f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>")
        renamed = lambda r: F.coalesce(*[F.when(r == F.lit(a), F.lit(b)) for a, b in layout.roles.items()], r)
        return F.transform(listed, lambda t: _turn(renamed(t[layout.role]), t[layout.text]))
    turns = []
    for role, path in layout.fields:
        text = F.coalesce(get(path, "string"), F.lit(""))
        if path in layout.joined:
            more = F.coalesce(get(layout.joined[path], "string"), F.lit(""))
            text = F.when(more == "", text).otherwise(F.concat(text, F.lit("\n\n"), more))
        turn = _turn(F.lit(role), text)
        turns.append(F.when(text != "", turn) if path in layout.optional else turn)
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, key: str = "conv_id", payload: str = "payload") -> DataFrame:
    """key, layout and turns of every record; layout and turns are null where no mapping has its fingerprint."""
    parsed = records.select(F.col(key), F.col(payload).alias("_payload"), F.try_parse_json(F.col(payload)).alias("_record"))
    found = F.when(F.col("_record").isNotNull(), fingerprint(F.col("_record"))).otherwise(_outline_print(F.col("_payload")))
    known = parsed.select(key, "_payload", "_record", found.alias("_print"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in reversed(layouts):
        hit = F.col("_print") == x.fingerprint
        layout = F.when(hit, F.lit(x.name)).otherwise(layout)
        turns = F.when(hit, _turns(F.col("_record"), F.col("_payload"), x)).otherwise(turns)
    return known.select(key, layout.alias("layout"), turns.cast(TURNS).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<(\\*)\|"), F.lit(r"<\\$1|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"<\\(\\*)\|"), F.lit(r"<$1|"))


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    pieces = F.split(unescape(role), r"\\\\", -1)  # at escaped backslashes; what is left of a backslash starts a line feed
    return F.array_join(F.transform(pieces, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def format_chats(turns: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """key, formatted and loss_runs of canonical turns.

    ``loss_runs`` holds, for each turn, its characters before the part under the loss, the characters under it
    (the text of ``learn`` turns, else 0), and those after it.
    """
    written = F.transform(
        F.col("turns"),
        lambda t: F.struct((t["role"] == learn).alias("learn"), F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("text")),
    )
    runs = lambda t: F.struct(
        F.when(t["learn"], F.length(t["head"])).otherwise(F.length(t["head"]) + F.length(t["text"]) + len(END)).alias("before"),
        F.when(t["learn"], F.length(t["text"])).otherwise(0).alias("loss"),
        F.when(t["learn"], F.lit(len(END))).otherwise(0).alias("after"),
    )
    made = bind(
        written,
        lambda w: F.struct(
            F.array_join(F.transform(w, lambda t: F.concat(t["head"], t["text"], F.lit(END))), "").alias("formatted"), F.transform(w, runs).alias("loss_runs")
        ),
    )
    return turns.select(key, made.alias("_made")).select(key, "_made.formatted", "_made.loss_runs")


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns and loss_texts (texts under the mask, in order), from the formatted text and the mask alone."""
    parts = F.split(F.col("formatted"), r"<\|im_start\|>")
    turns = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.left(p, F.length(p) - len(END)))
    turn = lambda b: F.struct(
        _unescape_role(F.substring_index(b, "\n", 1)).alias("role"), unescape(F.substring(b, F.instr(b, "\n") + 1, F.length(b))).alias("text")
    )
    whole = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda p: F.concat(F.lit(START), p))
    under = F.filter(
        F.zip_with(whole, F.col("loss_runs"), lambda p, r: F.when(r["after"] > 0, unescape(F.substring(p, r["before"] + 1, r["loss"])))),
        lambda x: x.isNotNull(),
    )
    return formatted.select(key, F.transform(turns, turn).alias("turns"), under.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_digest(back: DataFrame, key: str = "conv_id") -> DataFrame:
    """Counts and digests of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        key, F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


# The conversations table as records of many layouts -------------------------------------------------------------


def conversation_records(rows: DataFrame) -> DataFrame:
    """conv_id and payload: each conversation of a (conv_id, turn, role, text) table as JSON.

    The layout follows the roles, and the number of the conversation among layouts that hold the same. Turns are
    ordered by turn, then role and text; a null turn comes first, null texts and roles are empty.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    grouped = grouped.select("conv_id", "_turns", F.transform("_turns", lambda t: t["role"]).alias("_roles"), F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3)).alias("_n"))
    text = lambda k, name: F.col("_turns")[k]["text"].alias(name)
    back = {b: a for a, b in SHAREGPT_ROLES.items()}
    shared = lambda t: F.struct(
        F.coalesce(*[F.when(t["role"] == a, F.lit(b)) for a, b in back.items()], t["role"]).alias("from"), t["text"].alias("value")
    )
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    messages = F.to_json(F.struct(F.transform("_turns", message).alias("messages")))
    pair = F.col("_roles") == F.array(F.lit("user"), F.lit("assistant"))
    led = F.col("_roles") == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    plain = F.forall("_roles", lambda r: r.isin("system", "user", "assistant"))
    payload = (
        F.when(pair & (F.col("_n") == 0), F.to_json(F.struct(text(0, "prompt"), text(1, "completion"))))
        .when(pair & (F.col("_n") == 1), F.to_json(F.struct(text(0, "instruction"), text(1, "output"))))
        .when(led & (F.col("_n") == 0), F.to_json(F.struct(text(0, "system"), text(1, "prompt"), text(2, "response"))))
        .when(plain & (F.col("_n") == 1), F.to_json(F.struct(F.transform("_turns", shared).alias("conversations"))))
        .when(F.col("_n") == 2, F.to_json(F.struct(F.struct(F.transform("_turns", message).alias("messages")).alias("chat"))))
        .otherwise(messages)
    )
    return grouped.select("conv_id", payload.alias("payload"))
