"""Chat formatting from an event log.

An event is (conv_id, turn, seq, kind, role, text) and, where several messages may be
written in one turn, the ``message`` it belongs to. ``message`` as a kind states a
text, ``delta`` adds streamed text to it, ``edit`` replaces it, ``regenerate`` empties
it so that later deltas write it anew. The log arrives in any order. It is partitioned
by conversation and turn and sorted by sequence within a message, so that the events
of a message follow each other and a fold keeps one message, however long the
conversation is. A second event of kind ``message`` begins a message of its own, and
later events go to the latest.

Final messages are rendered as pieces of the formatted text, each with the span of
its characters under the loss mask: joined in order of turn, message and part they are
a conversation's text. A control string inside a text is escaped: a backslash becomes
two, a control string becomes a backslash and its letter, so that a text never holds a
control string and the escape is reversible.

``read_back`` parses stored pieces again with nothing but the template, in whatever
order they are read. Digests are updated piece by piece; only they need a conversation
in one task, as a stream.

Defined results: a null text is empty, a null role is ``user``; a delta, edit or
regenerate without a message starts one; events with equal seq are ordered by kind,
role and text; repeated rows are events of their own. A message is held whole, however
long. An empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiteloom.llm.common import small_batches

BEGIN, END = "<s>", "</s>"
OPEN, CLOSE = "[INST]", "[/INST]"
#: Control strings of the template, each with the letter that stands for it in a text.
LETTERS = {"</s>": "e", "<s>": "b", "[/INST]": "c", "[INST]": "o", "<<SYS>>": "y", "<</SYS>>": "z", "\\": "\\"}
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(LETTERS, key=len, reverse=True)))
_BACK = {letter: c for c, letter in LETTERS.items()}
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(BEGIN) + r"(.*?)" + re.escape(OPEN) + r"(.*?)" + re.escape(CLOSE) + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + LETTERS[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _BACK[m[1]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message's piece of the formatted text, and its loss span (empty but for the assistant)."""
    head, body = f"{BEGIN}{escape(role)}{OPEN}", escape(text)
    start = len(head)
    return f"{head}{body}{CLOSE}{END}\n", start, start + (len(body) if role == "assistant" else 0)


def parse(piece: str) -> tuple[str, str]:
    """Role and text of a piece."""
    found = _TURN.fullmatch(piece)
    if not found:
        raise ValueError("not a piece of this template")
    return unescape(found[1]), unescape(found[2])


class Fold:
    """Folds events, in order of conversation, turn, message and sequence, into final messages."""

    def __init__(self):
        self.at: tuple | None = None
        self.part, self.role, self.parts = 0, "user", []

    def _done(self) -> Iterator[tuple]:
        if self.at is not None:
            yield (*self.at, self.part, *render(self.role, "".join(self.parts)))

    def add(self, at: tuple, kind: str, role: str | None, text: str | None) -> Iterator[tuple]:
        """Take one event of (conv_id, turn, message); yields the piece before it once that is final."""
        if self.at != at or kind == "message":
            yield from self._done()
            self.part = self.part + 1 if self.at == at else 0
            self.at, self.role, self.parts = at, role or "user", []
        if kind in ("edit", "regenerate"):
            self.parts = []
        if kind != "regenerate":
            self.parts.append(text or "")
        if kind != "message" and role:
            self.role = role

    def close(self) -> Iterator[tuple]:
        yield from self._done()
        self.at = None


PIECES = "conv_id long, turn long, message string, part int, piece string, loss_from int, loss_to int"
ORDER = ["conv_id", "turn", "message", "part"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]


def _batch_of(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = Fold()
    for batch in batches:
        rows: list[tuple] = []
        for conv, turn, message, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.extend(fold.add((conv, turn, message), kind, role, text))
        yield _batch_of(rows, _KINDS, PIECES)
    yield _batch_of(list(fold.close()), _KINDS, PIECES)


def format_events(events: DataFrame) -> DataFrame:
    """PIECES of every conversation, by one exchange on conversation and turn."""
    small_batches(events.sparkSession)
    kind = F.array_position(F.array(*[F.lit(k) for k in ("message", "edit", "regenerate", "delta")]), F.col("kind"))
    message = F.coalesce(F.col("message").cast("string"), F.lit("")) if "message" in events.columns else F.lit("")
    log = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), message.alias("message"),
        F.col("seq").cast("long").alias("seq"), "kind", "role", "text", kind.alias("order"),
    )
    laid = log.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "message", "seq", "order", "role", "text")
    return laid.select("conv_id", "turn", "message", "kind", "role", "text").mapInArrow(_format, PIECES)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None

    def row() -> tuple:
        n, turns, chars, loss, size = state
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        rows = []
        for conv_id, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv_id != conv:
                if state is not None:
                    rows.append(row())
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse(piece)
            loss = unescape(piece[a:b])
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(piece)
        yield _batch_of(rows, kinds, DIGESTS)
    yield _batch_of([row()] if state is not None else [], kinds, DIGESTS)


def read_back(pieces: DataFrame) -> DataFrame:
    """DIGESTS of each conversation, parsed from the pieces that ``format_events`` returned."""
    small_batches(pieces.sparkSession)
    laid = pieces.repartition("conv_id").sortWithinPartitions(*ORDER)
    return laid.select("conv_id", "piece", "loss_from", "loss_to").mapInArrow(_digest, DIGESTS)


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of writing the messages of (conv_id, turn, role, text) rows.

    An assistant's message is begun, streamed in part, regenerated and streamed in three
    deltas; others are begun with their first characters and edited. The final texts are
    the rows' texts. Rows of one turn are ordered by role and md5 of the text.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")

    def event(seq: int, kind: str, role: Column, said: Column | None) -> Column:
        return F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), (F.lit(None).cast("string") if said is None else said).alias("text"))

    none, role = F.lit(None).cast("string"), F.col("role")
    streamed = F.array(
        event(0, "message", role, F.lit("")), event(1, "delta", none, F.left(text, F.lit(8))), event(2, "regenerate", none, None),
        event(3, "delta", none, F.substr(text, F.lit(1), third)), event(4, "delta", none, F.substr(text, third + 1, third)), event(5, "delta", none, F.substr(text, 2 * third + 1, third)),
    )
    edited = F.array(event(0, "message", role, F.left(text, F.lit(8))), event(1, "edit", none, text))
    # the row number only tells rows apart that are equal, so any numbers do
    numbered = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("row"))
    message = F.concat_ws(" ", role, F.md5(text), F.col("row"))
    log = numbered.select("conv_id", "turn", message.alias("message"), F.explode(F.when(role == "assistant", streamed).otherwise(edited)).alias("event"))
    return log.select("conv_id", "turn", "message", "event.*")
