r"""Chat formatting with a grammar round trip.

A turn is written ``### role: text</turn>`` and a newline.  A deterministic
parser reads it back: ``\`` before one of ``\ # < :`` makes that character
literal; the first bare ``: `` ends the role; in the text a bare ``</turn>``
ends the turn and a bare ``### `` would begin another.  Each turn is rendered
plainly, parsed, and compared with its source; where they differ the
conflicting content is escaped further, until they are identical.  As every
written turn parses to exactly itself, so does a conversation of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, MIDDLE, CLOSE, END = "### ", ": ", "</turn>", "\n"
LOSS_ROLE = "assistant"
_ESCAPE = r"\\[\\#<:]"
_IN_ROLE = re.compile(f"{_ESCAPE}|{re.escape(MIDDLE)}", re.S)
_IN_TEXT = re.compile(f"{_ESCAPE}|{re.escape(CLOSE)}|{re.escape(OPEN)}", re.S)
_TEXT_MARKS = re.compile(f"{re.escape(CLOSE)}|{re.escape(OPEN)}")


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def _read(rendered: str, at: int, tokens: re.Pattern, stop: str) -> tuple[str, int]:
    """The literal content from ``at`` up to the bare ``stop``, and the place after it."""
    parts = []
    for m in tokens.finditer(rendered, at):
        parts.append(rendered[at:m.start()])
        at = m.end()
        if m[0] == stop:
            return "".join(parts), at
        if m[0][0] != "\\":
            raise GrammarError(f"unexpected {m[0]!r} at {m.start()}")
        parts.append(m[0][1])
    raise GrammarError(f"no {stop!r}")


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns (role, text) of rendered text; ``GrammarError`` if it isn't a sequence of turns."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise GrammarError(f"no {OPEN!r} at {at}")
        role, at = _read(rendered, at + len(OPEN), _IN_ROLE, MIDDLE)
        text, at = _read(rendered, at, _IN_TEXT, CLOSE)
        if not rendered.startswith(END, at):
            raise GrammarError(f"no line end at {at}")
        at += len(END)
        turns.append((role, text))
    return turns


def _escaped(role: str, text: str, level: int) -> tuple[str, str]:
    if level >= 2:
        role, text = role.replace("\\", "\\\\"), text.replace("\\", "\\\\")
    if level >= 1:
        role = role.replace(MIDDLE, "\\" + MIDDLE)
        text = _TEXT_MARKS.sub(lambda m: "\\" + m[0], text)
    return role, text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn and the bounds of its text, escaped no more than its round trip needs."""
    for level in range(3):
        r, t = _escaped(role, text, level)
        head = f"{OPEN}{r}{MIDDLE}"
        rendered = f"{head}{t}{CLOSE}{END}"
        try:
            if parse(rendered) == [(role, text)]:
                return rendered, len(head), len(head) + len(t)
        except GrammarError:
            pass
    raise AssertionError("full escaping always parses back")


def format_turns(df: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, turn, rendered, loss_start, loss_end``.

    ``df`` has ``conv_id, turn, role, text``; other columns are ignored.  A null
    role or text is empty; rows with a null ``conv_id`` form one conversation
    and a null ``turn`` comes first.  ``loss_start`` and ``loss_end`` bound the
    characters of ``rendered`` under the loss mask (the assistant's text; null
    for other roles).  Repeated rows are turns of their own.  The text of a
    conversation is its turns' ``rendered``, by ``turn`` and then by ``rendered``,
    joined without anything between.  Narrow: no shuffle.
    """
    source = df.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([source.schema["conv_id"], source.schema["turn"],
                           T.StructField("rendered", T.StringType()), T.StructField("loss_start", T.IntegerType()),
                           T.StructField("loss_end", T.IntegerType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column(2).to_pylist()
            made = [render_turn(r, t) for r, t in zip(roles, b.column(3).to_pylist())]
            loss = [r == LOSS_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if x else None for m, x in zip(made, loss)], pa.int32()),
                 pa.array([m[2] if x else None for m, x in zip(made, loss)], pa.int32())], schema.names)

    return source.mapInArrow(run, schema)


class _Digest:
    """What is read back of one conversation, turn by turn."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, rendered: str, start: int | None, end: int | None) -> None:
        for role, text in parse(rendered):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if start is not None:
            masked, _ = _read(rendered[start:end] + CLOSE, 0, _IN_TEXT, CLOSE)
            self.loss.update(masked.encode())
            self.loss_chars += len(masked)
        self.chars += len(rendered)

    def row(self) -> tuple:
        return (self.conv_id, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations and digest them, one row per ``conv_id``.

    The turns of a conversation stream past in order, so that a conversation
    of any length takes the memory of one Arrow batch.
    """
    schema = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType())])
    ordered = (formatted.select("conv_id", "turn", "rendered", "loss_start", "loss_end")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "rendered"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for b in batches:
            done = []
            for conv_id, rendered, start, end in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.add(rendered, start, end)
            if done:
                yield _rows(done, b.schema.field(0).type)
        if now is not None:
            yield _rows([now.row()], b.schema.field(0).type)

    def _rows(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    return ordered.mapInArrow(run, schema)


#: A conversation whose texts hold the template's own marks.
MARKED = r"\### Assistant: </turn> ok"


def with_marked(df: DataFrame) -> DataFrame:
    """The conversations and conversation -7, a user and an assistant row that both say ``MARKED``."""
    extra = df.sparkSession.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, "assistant", MARKED)],
                                            "conv_id long, turn long, role string, text string")
    return df.select("conv_id", "turn", "role", "text").unionByName(extra)


ORACLE = r"""
WITH marked AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marks AS (
  SELECT *, (length(role) - length(replace(role, ': ', ''))) / 2
          + (length(text) - length(replace(text, '</turn>', ''))) / 7
          + (length(text) - length(replace(text, '### ', ''))) / 4 AS n_marks,
         length(role || text) - length(replace(role || text, '\', '')) AS n_slashes,
         regexp_matches(role, '\\[\\#<:]|\\$') OR regexp_matches(text, '\\[\\#<:]|\\\z') AS slashes_count
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(14 + length(role) + length(text) + n_marks + CASE WHEN slashes_count THEN n_slashes ELSE 0 END) AS BIGINT)
    AS formatted_chars
FROM marks GROUP BY conv_id
"""
