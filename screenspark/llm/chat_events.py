"""Chat formatting from event logs.

Method: event-sourced reconstruction.  A log holds, for each conversation, events
in sequence: ``message`` (opens a message), ``delta`` (adds streamed text),
``edit`` (replaces the text) and ``regenerate`` (empties the message and drops
the messages opened after it before this event).  Logs are partitioned by
conversation, sorted by sequence, folded into final messages and rendered.

A long conversation is folded in parts by ranges of its message numbers; all that
a part needs to know of the earlier ones is the last regeneration among them.
Tasks stream over sorted rows and hold one message at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from screenspark.llm.batches import map_batches
from screenspark.plans.staging import stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of chat templates, none of which may stand in a rendered text.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
_HEADS = "".join(sorted({c[0] for c in CONTROL}))
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"(?<=[{re.escape(_HEADS)}])\\*(?={_TAILS})")
_ESCAPED = re.compile(rf"(?<=[{re.escape(_HEADS)}])\\+(?={_TAILS})")
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)
#: Messages of a part, by number, and characters of one output row.
PART_MESSAGES = 1024
ROW_CHARS = 1_000_000


def escape(text: str) -> str:
    """Break every control string by one more backslash after its first character."""
    return _PLAIN.sub(lambda m: m[0] + "\\", text) if any(c in text for c in _HEADS) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][1:], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn, and where its text starts and stops in it."""
    head = f"{TURN}{escape(role)}{TEXT}"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered string."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


FORMATTED = [
    StructField("part", LongType()), StructField("row", IntegerType()), StructField("formatted", StringType()),
    StructField("loss", ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))),
]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _messages(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, part, role, text) of the final messages of sorted events."""
    where = now = None  # the open message: [number, role, pieces of text]
    cut = None
    for conv, part, target, kind, seq, role, text in rows:
        if (conv, part) != where or now is not None and target != now[0] or kind == "message":
            if now is not None and now[1] is not None:
                yield *where, now[1], "".join(now[2])
            now = None
        if (conv, part) != where:
            where, cut = (conv, part), None
        if kind == "carry":
            cut = seq
        elif kind == "message":
            dropped = cut is not None and seq is not None and seq < cut
            now = [target, None if dropped else role or "", [text or ""]]
        elif now is not None and kind == "delta":
            now[2].append(text or "")
        elif now is not None and kind == "edit":
            now[2] = [text or ""]
        elif kind == "regenerate":
            if now is not None:
                now[2] = []
            if seq is not None and (cut is None or seq > cut):
                cut = seq
    if now is not None and now[1] is not None:
        yield *where, now[1], "".join(now[2])


def format_conversations(events: DataFrame, trained_roles: tuple[str, ...] = ("assistant",), part_messages: int = PART_MESSAGES) -> DataFrame:
    """Rendered conversations of an event log.

    ``events`` has ``conv_id, seq, target, kind, role, text``; ``target`` is the
    number (opening ``seq``) of the message that an event belongs to.  Returns
    ``conv_id, part, row, formatted, loss``: in order of part and row, the strings
    of a conversation follow each other; ``loss`` has the character spans of the
    texts of ``trained_roles``.  A null text or role is empty; a null number
    comes first; messages of one number stand in order of role and text; events
    of a message that was never opened are left out.  Repeated ``message`` rows are
    messages of their own.  An empty log gives no rows.
    """
    base = events.select("conv_id", F.coalesce(F.floor(F.col("target") / part_messages), F.lit(-(2**62))).cast("long").alias("part"), "target", F.col("kind").cast("string").alias("kind"), "seq", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    redone = base.filter("kind = 'regenerate'").groupBy("conv_id", "part").agg(F.max("seq").alias("seq"))
    parts = base.select("conv_id", "part").distinct().join(redone.select("conv_id").distinct(), "conv_id", "left_semi")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.join(redone, ["conv_id", "part"], "left").withColumn("seq", F.max("seq").over(before)).filter("seq IS NOT NULL")
    carry = carry.select("conv_id", "part", F.lit(None).cast("long").alias("target"), F.lit("carry").alias("kind"), "seq", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    order = F.when(F.col("kind") == "carry", 0).otherwise(1)
    opens = F.when(F.col("kind") == "message", 0).otherwise(1)
    rows = base.unionByName(carry).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", order, F.col("target").asc_nulls_first(), F.col("seq").asc_nulls_first(), opens, "kind", "role", "text")
    schema = StructType([base.schema["conv_id"], *FORMATTED])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out: dict = {n: [] for n in names}
        held = 0
        where, row, strings, spans, size = None, 0, [], [], 0

        def flush():
            for n, v in zip(names, (*where, row, "".join(strings), spans), strict=True):
                out[n].append(v)

        for conv, part, role, text in _messages(_rows(batches)):
            if strings and ((conv, part) != where or size >= ROW_CHARS):
                flush()
                row, held, strings, spans, size = row + 1, held + size, [], [], 0
                if held >= 4 * ROW_CHARS:
                    yield out
                    out, held = {n: [] for n in names}, 0
            if (conv, part) != where:
                where, row = (conv, part), 0
            string, start, stop = render(role, text)
            if role in trained_roles:
                spans.append({"start": size + start, "stop": size + stop})
            strings.append(string)
            size += len(string)
        if strings:
            flush()
        yield out

    return map_batches(rows, run, schema)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A log with one ``message`` event for each row of ``conv_id, turn, role, text``."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("target"), F.lit("message").alias("kind"), "role", "text")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of rendered conversations, read from their strings and loss spans.

    Each task streams over the rows of its conversations in order and keeps two
    hash states; a digest of a whole conversation cannot be put together from
    digests of its parts.
    """
    schema = StructType([formatted.schema["conv_id"], StructField("n_turns", LongType()), StructField("turns_sha256", StringType()), StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = schema.names
        out: dict = {n: [] for n in names}
        state = None

        def done():
            for n, v in zip(names, (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]), strict=True):
                out[n].append(v)

        for conv, _, _, text, loss in _rows(batches):
            if state is None or state[0] != conv:
                if state is not None:
                    done()
                    if len(out["conv_id"]) >= 10_000:
                        yield out
                        out = {n: [] for n in names}
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            for span in loss:
                said = unescape(text[span["start"] : span["stop"]])
                state[3] += len(said)
                state[4].update(said.encode())
            state[5] += len(text)
        if state is not None:
            done()
        yield out

    return map_batches(formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part", "row"), run, schema)


def written_conversations(conversations: DataFrame) -> DataFrame:
    """Conversations rendered, written to the shared folder and read back."""
    return stage(format_conversations(conversation_events(conversations)), "formatted")
