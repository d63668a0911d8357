"""Chat formatting from event logs.

A conversation is a log of events: whole messages, streamed deltas, edits, regenerations and
deletions. Events are partitioned by conversation and ordered by sequence number; each message's
events fold into its final text; messages render, in the order in which they began, to one segment
each. Segments of a conversation, put one after another, are its formatted text, so that a very long
conversation stays many rows and no task holds it whole.

Control strings inside roles and texts are escaped, so that the formatted text can be read back:
``<`` and ``[`` at the start of a control string become ``\\(`` and ``\\{``, a backslash becomes two.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import prepare, table

START, BODY, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings of this template and of other common ones that a text must not smuggle in.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPES = {"\\": "\\\\", "<": "\\(", "[": "\\{"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}
_TO_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\[\\({]")
_SEGMENT = re.compile(re.escape(START) + r"(.*?)\n(.*)" + re.escape(END), re.S)
#: What an event of a log does to its message.
KINDS = ("message", "delta", "edit", "regenerate", "delete")


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _UNESCAPES[m[0]], text)


def role_field(role: str) -> str:
    """A role on one line, still reversible: a line break is written as backslash, n."""
    return escape(role).replace("\n", "\\n")


def read_role(field: str) -> str:
    return re.sub(r"\\[\\({n]", lambda m: "\n" if m[0] == "\\n" else _UNESCAPES[m[0]], field)


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, message, seq (where it began), role, text of every message that is left.

    events: conv_id, seq, message (an id inside its conversation), kind of KINDS, role, text. Within a
    message, in order of seq: ``message`` and ``edit`` set the text, ``delta`` adds to it, ``regenerate``
    sets it to its text (null: empty) and so drops what was streamed, ``delete`` removes the message until it is set or added to again.
    The role is the first one given. Null texts are empty; events that tie in seq apply in the order of
    KINDS, then text; a null seq comes first. Grouping is by message, so a long conversation is spread.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    step = F.struct("seq", order.alias("o"), F.coalesce("text", F.lit("")).alias("text"), "kind", "role")
    folded = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(step)).alias("log"))
    first_role = F.try_element_at(F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull()), F.lit(1))
    text: Column = F.aggregate(
        "log",
        F.lit(None).cast("string"),
        lambda a, e: F.when(e["kind"] == "delete", F.lit(None).cast("string")).when(e["kind"] == "delta", F.concat(F.coalesce(a, F.lit("")), e["text"])).otherwise(e["text"]),
    )
    return folded.select("conv_id", "message", F.array_min(F.transform("log", lambda e: e["seq"])).alias("seq"), F.coalesce(first_role, F.lit("")).alias("role"), text.alias("text")).where("text is not null")


def render_messages(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, seq, message, segment string, loss_start int, loss_end int (code points of the segment; null: no loss).

    The loss mask covers exactly the escaped text of messages of ``trained_role``. Rows of a
    conversation are together in one partition, in order of seq, then message.
    """
    prepare(messages.sparkSession)

    @F.pandas_udf("segment string, loss_start int, loss_end int")
    def render(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = []
        for r, t in zip(role, text, strict=True):
            head, body = START + role_field(r) + BODY, escape(t)
            trained = r == trained_role
            rows.append((head + body + END, len(head) if trained else None, len(head) + len(body) if trained else None))
        return pd.DataFrame(rows, columns=["segment", "loss_start", "loss_end"]).astype({"loss_start": "Int32", "loss_end": "Int32"})

    ordered = messages.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message")
    return ordered.withColumn("r", render("role", "text")).select("conv_id", "seq", "message", "r.*")


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation from render_messages' rows: digests of what its formatted text says.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed of each turn), loss_chars and
    loss_sha256 (the unescaped text under the loss mask), formatted_chars. Goes through each partition's
    rows in their order and keeps only running digests.
    """
    fields = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, done, columns = None, [], [f.split()[0] for f in fields.split(", ")]

        def close() -> None:
            if state:
                done.append((state["conv"], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"]))

        for batch in batches:
            for conv, segment, start, end in zip(*(batch[c].astype(object).where(batch[c].notna(), None) for c in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or state["conv"] != conv:
                    close()
                    state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
                role, text = _SEGMENT.fullmatch(segment).groups()
                state["turns"].update(f"{read_role(role)}\n{unescape(text)}\n".encode())
                state["n"] += 1
                state["chars"] += len(segment)
                if start is not None:
                    learnt = unescape(segment[int(start) : int(end)])
                    state["loss_n"] += len(learnt)
                    state["loss"].update(learnt.encode())
            yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})
            done.clear()
        close()
        yield pd.DataFrame(done, columns=columns).astype({"conv_id": "Int64"})

    return segments.select("conv_id", "segment", "loss_start", "loss_end").mapInPandas(run, fields)


def events_of_turns(turns: DataFrame) -> DataFrame:
    """Rows of a finished conversation (conv_id, turn, role, text) as events: one whole message each.

    Rows are numbered by turn, then role, then text; repeated rows are turns of their own.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    return turns.withColumn("seq", number).select("conv_id", F.col("seq").cast("long").alias("seq"), F.col("seq").cast("long").alias("message"), F.lit("message").alias("kind"), role.alias("role"), text.alias("text"))


def op6_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return read_back(render_messages(fold_messages(events_of_turns(turns))))
