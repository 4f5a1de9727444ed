"""Chat formatting from event logs of conversations."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.tables import column, map_arrow

#: Kinds of events: a message is begun with a role, grows by deltas, may have its text replaced by an edit,
#: and is begun anew by a regeneration, which also takes back every later message.
EVENTS = ("begin", "delta", "edit", "regenerate")
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
LOSS_ROLE = "assistant"
#: What a text may hold of the template; each gets a backslash before it, as has every backslash.
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### ([^\\:]*(?:\\.[^\\:]*)*): ([^\\<]*(?:(?:\\.|<(?!/turn>))[^\\<]*)*)</turn>\n", re.DOTALL)

EVENT_SCHEMA = "conv_id bigint, seq bigint, kind string, message bigint, role string, text string"
SCHEMA = "conv_id bigint, formatted string, mask array<struct<start: bigint, end: bigint>>"


def escape(text: str, role: bool = False) -> str:
    return (_ROLE_CONTROL if role else _CONTROL).sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(messages: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the loss mask: where the texts of the assistant lie, in code points."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role, True)}{AFTER_ROLE}", escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn, read back from a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


class Log:
    """The messages of one conversation, folded from its events in their order.

    Events of a null or unknown kind say nothing and are passed over. A null message is one message of its own,
    which stands before all others.
    """

    def __init__(self) -> None:
        self.messages: dict[float, tuple[str, list[str]]] = {}

    def add(self, kind: str | None, message: int | None, role: str | None, text: str | None) -> None:
        message = -math.inf if message is None else message
        if kind == "begin":
            self.messages[message] = (role or "", [text or ""])
        elif kind == "delta":
            # A delta before its beginning, which a torn log may hold, begins a message too.
            self.messages.setdefault(message, (role or "", []))[1].append(text or "")
        elif kind == "edit":
            before = self.messages.get(message, (role or "", []))[0]
            self.messages[message] = (role if role is not None else before, [text or ""])
        elif kind == "regenerate":
            before = self.messages.get(message, (role or "", []))[0]
            for later in [m for m in self.messages if m > message]:
                del self.messages[later]
            self.messages[message] = (role if role is not None else before, [text or ""])

    def final(self) -> list[tuple[str, str]]:
        return [(role, "".join(parts)) for _, (role, parts) in sorted(self.messages.items())]


def turn_events(rows: DataFrame) -> DataFrame:
    """A log of (conv_id, turn, role, text) rows, one message each: it begins empty and gets its text as deltas.

    Rows are numbered by turn; rows of the same turn by role and text, and a null turn comes first. A text
    comes as two deltas, so that the fold is the same as for streamed logs.
    """
    half = (F.char_length("text") / 2).cast("int")
    text = F.coalesce(column(rows, "text", "string"), F.lit("")).alias("text")
    base = rows.select(column(rows, "conv_id", "bigint"), column(rows, "turn", "bigint"), column(rows, "role", "string"), text)
    events = F.array(
        F.struct(F.lit(0).alias("step"), F.lit("begin").alias("kind"), F.lit("").alias("part")),
        F.struct(F.lit(1).alias("step"), F.lit("delta").alias("kind"), F.substr("text", F.lit(1), half).alias("part")),
        F.struct(F.lit(2).alias("step"), F.lit("delta").alias("kind"), F.substr("text", half + 1).alias("part")),
    )
    # Rows that are alike in everything stand next to each other, and their copies are told apart by number.
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    numbered = base.withColumn("message", F.row_number().over(order).cast("bigint"))
    numbered = numbered.withColumn("e", F.explode(events))
    return numbered.select(
        "conv_id", (F.col("message") * 3 + F.col("e.step")).alias("seq"), F.col("e.kind").alias("kind"), "message", "role",
        F.col("e.part").alias("text"),
    )


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) per conversation of an event log (conv_id, seq, kind, message, role, text).

    The log is partitioned by conversation and sorted by sequence (ties by message, kind and text), and each
    task folds one event after the other, holding one conversation's final messages: that much goes into one
    row of the result in any case. Null texts and roles are empty, a null conv_id is a conversation of its
    own, and an empty log gives no row.
    """
    own = events.select(*(column(events, *f.split()) for f in EVENT_SCHEMA.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log, done, size = None, None, [], 0
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("conv_id", "kind", "message", "role", "text")]
            for conv, kind, message, role, text in zip(*columns):
                if log is None or conv != now:
                    if log is not None:
                        done.append((now, *render(log.final())))
                        size += len(done[-1][1])
                    if size > 4_000_000:
                        yield _batch(done)
                        done, size = [], 0
                    now, log = conv, Log()
                log.add(kind, message, role, text)
        if log is not None:
            done.append((now, *render(log.final())))
        if done:
            yield _batch(done)

    sorted_log = own.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "message", "kind", "text")
    return map_arrow(sorted_log, run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    mask = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([r[1] for r in rows], pa.string()),
            pa.array([[{"start": a, "end": b} for a, b in r[2]] for r in rows], mask),
        ],
        names=["conv_id", "formatted", "mask"],
    )


DIGEST_SCHEMA = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: their turns, and the texts under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, mask in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "mask"))):
                turns = parse(text)
                loss = [unescape(text[m["start"] : m["end"]]) for m in mask]
                of_turns = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append(
                    (conv, len(turns), _sha(of_turns), sum(map(len, loss)), _sha("".join(loss)), len(text))
                )
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
                names = [f.split()[0] for f in DIGEST_SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)

    return map_arrow(formatted, run, DIGEST_SCHEMA)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
