"""Chat formatting: conversations rendered by a compiled template, with loss spans, and read back without loss.

Turns go in order of turn, nulls first, ties by role and text. A null text or role is empty; a role other than user,
assistant and system is written out. Control strings inside texts and roles are escaped reversibly. Repeated rows are
turns of their own. A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.template import compile_template

# The strings that structure a conversation.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}<s>"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% elif m.role == 'system' %}<<SYS>>{{ m.text | escape }}<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}{% endif %}"
    "</s>{% endfor %}"
)
_CODES = {c: "\\" + chr(ord("a") + i) for i, c in enumerate(CONTROL)} | {"\\": "\\\\"}
_STRINGS = {v: k for k, v in _CODES.items()}
_FIND = re.compile("|".join(re.escape(c) for c in sorted(_CODES, key=len, reverse=True)))
_CODED = re.compile(r"\\[a-h\\]")
_TURN = re.compile(r"<s>(.*?)</s>", re.S)
FORMATTED = "conv_id long, formatted string, loss array<struct<start:long,end:long>>"


def escape(text: str | None) -> str:
    """No control string is left in the result: each becomes a backslash and a letter, a backslash two."""
    return _FIND.sub(lambda m: _CODES[m[0]], text or "")


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: _STRINGS[m[0]], text)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, formatted, loss: one row per conversation.

    Conversations are dealt by id and rendered as their sorted rows stream by; a task holds one at a time.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        key, messages, any_rows = None, [], False

        def out() -> dict:
            text, spans = render(messages=messages)
            return {"conv_id": key, "formatted": text, "loss": [{"start": a, "end": b} for a, b in spans]}

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
            rows = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if any_rows and c != key:
                    rows.append(out())
                    messages = []
                key, any_rows = c, True
                messages.append({"role": role or "", "text": text or ""})
            yield pa.RecordBatch.from_pylist(rows, schema)
        if any_rows:
            yield pa.RecordBatch.from_pylist([out()], schema)

    c = conversations.select("conv_id", "turn", "role", "text")
    dealt = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED.replace("long", kind, 1))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """role and text of every turn of a formatted conversation."""
    out = []
    for body in _TURN.findall(formatted):
        if body.startswith("[INST] "):
            role, text = "user", body[7:-8]
        elif body.startswith("<<SYS>>"):
            role, text = "system", body[7:-8]
        elif body.startswith("[ROLE]"):
            role, _, text = body[6:].partition("[/ROLE]")
        else:
            role, text = "assistant", body
        out.append((unescape(role), unescape(text)))
    return out


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, turns, chars, loss, size = [], [], [], [], []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                found = read_turns(text)
                learnt = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                n.append(len(found))
                turns.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in found).encode()).hexdigest())
                chars.append(len(learnt))
                loss.append(hashlib.sha256(learnt.encode()).hexdigest())
                size.append(len(text))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return read_back(format_conversations(c.unionByName(own)))
