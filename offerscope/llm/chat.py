"""Chat formatting from an event log.

Events (conv_id, turn, seq, kind, role, text) are dealt by conversation, sorted by turn and sequence, and
folded as a stream, so one open turn is all that is held in memory:

* ``message``     opens a turn with a role and a first text
* ``delta``       appends streamed text
* ``edit``        replaces the text of the turn
* ``regenerate``  starts the turn's text again and discards what earlier events did to later turns
* ``retract``     removes the turn

Each final message is rendered as ``### role: text</turn>`` and a line end. A backslash is put before
every backslash, before ``#`` that follows ``#``, before the slash of ``</turn>`` and, in roles, before a
colon. So no control string occurs inside a message, and dropping these backslashes restores it.

Defined results: null text and role count as empty; a null turn comes first; finished rows with the same
turn are ordered by role and text and each is a turn of its own; a delta or an edit of a turn that is
not open is ignored; a conversation of which every turn is retracted has no row; an empty log gives none.
A conversation's hash is a chain over its turns, so one conversation is folded by one task, as a stream.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from offerscope.llm.common import Batches, batches_of, table

OPEN, CLOSE = "### ", "</turn>\n"
DELTA_CHARS = 400
_CONTROL = re.compile(r"\\|(?<=#)#|(?<=<)/(?=turn>)")
_ROLE_CONTROL = re.compile(r"\\|:|(?<=#)#|(?<=<)/(?=turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_EVENT = ("turn", "seq", "kind", "role", "text")


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn and the span of its text within it, in code points."""
    head = f"{OPEN}{escape(role, _ROLE_CONTROL)}: "
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def read_back(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn."""
    head = _HEAD.match(formatted)
    return unescape(head[1]), unescape(formatted[head.end():formatted.index(CLOSE, head.end())])


def messages_as_events(rows: DataFrame) -> DataFrame:
    """Finished messages as the log that would have streamed them: an opening and deltas of bounded size."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = clean.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long"))
    last = F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / DELTA_CHARS).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(F.col("text"), i * DELTA_CHARS + 1, F.lit(DELTA_CHARS)))
    opened = placed.select("conv_id", "turn", "role", F.posexplode(parts).alias("seq", "text"))
    first = F.col("seq") == 0
    return opened.select("conv_id", "turn", F.col("seq").cast("long").alias("seq"), F.when(first, "message").otherwise("delta").alias("kind"),
                         F.when(first, F.col("role")).alias("role"), "text")


class Fold:
    """One conversation while its events pass in order of turn and sequence."""

    def __init__(self):
        self.turn, self.open, self.role, self.parts = None, False, "", []
        self.cut = self.later_cut = None

    def take(self, turn, seq: int, kind: str, role: str | None, text: str | None) -> tuple | None:
        """Apply an event; returns (turn, role, text) of the message before if this one begins another."""
        done = None
        if turn != self.turn:
            done = self.finish()
            self.turn, self.cut = turn, self.later_cut
        if self.cut is not None and seq < self.cut:
            return done  # an earlier turn was regenerated after this
        if kind == "delta":
            if self.open:
                self.parts.append(text or "")
        elif kind == "retract":
            self.open = False
        elif kind in ("message", "regenerate") or kind == "edit" and self.open:
            self.open, self.parts = True, [text or ""]
            if role is not None or kind == "message":
                self.role = role or ""
            if kind == "regenerate":
                self.later_cut = max(seq, self.later_cut if self.later_cut is not None else seq)
        elif kind != "edit":
            raise ValueError(f"unknown event {kind!r}")
        return done

    def finish(self) -> tuple | None:
        done = (self.turn, self.role, "".join(self.parts)) if self.open else None
        self.open, self.role, self.parts = False, "", []
        return done


def format_events(events: DataFrame) -> DataFrame:
    """Rendered turns: conv_id, turn, role, formatted, and where the text stands in ``formatted``
    (text_start, text_end); in order of turn within a conversation, which is whole in one partition."""
    dealt = events.select("conv_id", *_EVENT).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")

    def folded(batches: Batches):
        fold, conversation, begun = Fold(), None, False
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", *_EVENT)]
            for conv, *event in zip(*columns, strict=True):
                if not begun or conv != conversation:
                    if begun and (done := fold.finish()):
                        out.append((conversation, *done))
                    fold, conversation, begun = Fold(), conv, True
                if done := fold.take(*event):
                    out.append((conversation, *done))
            yield rendered(out)
        if begun and (done := fold.finish()):
            yield rendered([(conversation, *done)])

    def rendered(rows: list[tuple]) -> pa.RecordBatch:
        turns = [render(role, text) for _, _, role, text in rows]
        return batches_of({
            "conv_id": ([r[0] for r in rows], pa.int64()), "turn": ([r[1] for r in rows], pa.int64()), "role": ([r[2] for r in rows], pa.string()),
            "formatted": ([t[0] for t in turns], pa.string()), "text_start": ([t[1] for t in turns], pa.int64()), "text_end": ([t[2] for t in turns], pa.int64())})

    return dealt.mapInArrow(folded, "conv_id long, turn long, role string, formatted string, text_start long, text_end long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from rendered turns in the order that ``format_events`` leaves them."""

    def read(batches: Batches):
        conversation, state = None, None

        def row() -> tuple:
            return conversation, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "formatted", "text_start", "text_end")]
            for conv, formatted, start, end in zip(*columns, strict=True):
                if state is None or conv != conversation:
                    if state is not None:
                        out.append(row())
                    conversation, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_back(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == "assistant":
                    learnt = unescape(formatted[start:end])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(formatted)
            yield digest_batch(out)
        if state is not None:
            yield digest_batch([row()])

    kinds = (("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()))

    def digest_batch(rows: list[tuple]) -> pa.RecordBatch:
        return batches_of({name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

    return turns.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = r"\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_events(messages_as_events(rows)))


_ESCAPES = """(length(t) + (length(t) - length(replace(t, '\\', '')))
 + (length(t) - length(replace(t, '#', ''))) - len(regexp_extract_all(t, '#+'))
 + (length(t) - length(replace(t, '</turn>', ''))) // 7)"""

ORACLE = {"op3_chat_format": f"""
WITH rows AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
 CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(length(role) + 14 + {_ESCAPES}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""}

QUERIES = {"op3_chat_format": op3_chat_format}
