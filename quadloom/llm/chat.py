"""Chat formatting from an event log.

A conversation is logged as events: ``message`` opens a message, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` drops what was
streamed so far and starts again with the event's text, ``delete`` removes it.
Events are folded message by message in sequence order (so a conversation that
holds a third of all rows is spread over tasks), and the final messages are
rendered in the order in which they opened.

The template is ``<s>ROLE\\nTEXT</s>`` for each turn. Control strings inside
roles and texts are escaped: a backslash is doubled, and a backslash goes
behind the first character of each control string; both are undone on reading.
The loss mask covers the assistant's texts, as code point spans.

Rendering streams over a sorted partition and gives a row for each segment of
about ``SEGMENT`` characters, so no conversation has to fit in memory.

Defined cases: a null text is empty, a null role is the empty role; a null
conv_id is a conversation of its own; a second ``message`` event under one
message id opens another message; equal sequence numbers go by role, then
text; an event for a message that is not open is ignored, save that ``delta``,
``edit`` and ``regenerate`` open it; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
SEGMENT = 1 << 20
_CONTROL = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ").")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\") if "\\" in text else text
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\x00")


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "\x00" else m[1], role)


def parse(formatted: str):
    """Yields (role, text, start, end) of each turn; the span is the escaped text's."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith("<s>", at):
            raise ValueError(f"no turn begins at {at}")
        head = formatted.index("\n", at)
        end = formatted.index("</s>", head + 1)
        yield unescape_role(formatted[at + 3 : head]), unescape(formatted[head + 1 : end]), head + 1, end
        at = end + 4


def _fold(batches):
    """Rows (conv_id, message, seq, kind, role, text), sorted: final messages (conv_id, seq, role, text)."""
    key, now = None, None
    for batch in batches:
        out = []
        for conv, message, seq, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv, message) or kind == "message":
                if now is not None:
                    out.append((key[0], now[0], now[1], "".join(now[2])))
                key, now = (conv, message), None
            if kind == "delete":
                now = None
            elif now is None:
                now = [seq, role or "", [text or ""]]
            elif kind == "delta":
                now[2].append(text or "")
            else:  # edit, regenerate
                now[2] = [text or ""]
        if out:
            yield _messages(out)
    if now is not None:
        yield _messages([(key[0], now[0], now[1], "".join(now[2]))])


def _messages(rows):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["conv_id", "seq", "role", "text"])


def _render(segment: int):
    def run(batches):
        key, parts, size, number, spans = (), [], 0, 0, []

        def close():
            row = pa.RecordBatch.from_pydict(
                {"conv_id": [key[0]], "segment": [number], "formatted": ["".join(parts)], "loss_starts": [[a for a, _ in spans]], "loss_ends": [[b for _, b in spans]]},
                pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64()))]),
            )
            return row

        for batch in batches:
            for conv, _, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if key and (key[0] != conv or size >= segment):
                    yield close()
                    number = number + 1 if key[0] == conv else 0
                    parts, size, spans = [], 0, []
                key = (conv,)
                head, body = f"<s>{escape_role(role)}\n", escape(text)
                if role == "assistant":
                    spans.append((size + len(head), size + len(head) + len(body)))
                parts += head, body, "</s>"
                size += len(head) + len(body) + 4
        if key:
            yield close()

    return run


FORMATTED = "conv_id long, segment long, formatted string, loss_starts array<long>, loss_ends array<long>"


def format_events(events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows (conv_id, segment, formatted, loss_starts, loss_ends) of ``events`` (conv_id, message, seq, kind, role, text)."""
    spark = events.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("message").cast("long").alias("message"), F.col("seq").cast("long").alias("seq"), "kind", "role", "text")
    log = log.repartition(n, "conv_id", "message").sortWithinPartitions("conv_id", "message", "seq", "role", "text")
    final = log.mapInArrow(_fold, "conv_id long, seq long, role string, text string")
    final = final.repartition(n, "conv_id").sortWithinPartitions("conv_id", "seq", "role", "text")
    return final.mapInArrow(_render(segment), FORMATTED)


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """The log of plain turn rows: each opens its own message."""
    return conversations.select("conv_id", F.col("turn").alias("message"), F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def turns_as_streamed(conversations: DataFrame) -> DataFrame:
    """A log in which plain turn rows come about as in a live chat: half of them are streamed, with a wrong draft that is
    regenerated in two deltas, the others are sent wrong and edited. Folding it gives back the turns.

    Each row is a message of its own, so rows that share a turn stay apart; a null turn comes before all others.
    """
    text = F.coalesce("text", F.lit(""))
    half = (F.length(text) / 2).cast("int")
    first, rest = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    wrong = F.lit("I think that this draft is wrong")

    def event(k, kind, what):
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), what.alias("text"))

    streamed = F.array(event(0, "message", wrong), event(1, "delta", wrong), event(2, "regenerate", first), event(3, "delta", rest))
    edited = F.array(event(0, "message", wrong), event(1, "edit", text))
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 58))).alias("turn"), "role", "text", F.monotonically_increasing_id().alias("message"))
    events = F.when(F.pmod(F.col("message"), F.lit(2)) == 0, streamed).otherwise(edited)
    return rows.select("conv_id", "message", "turn", "role", F.explode(events).alias("e")).select("conv_id", "message", (F.col("turn") * 8 + F.col("e.k")).alias("seq"), "e.kind", "role", "e.text")


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches):
    """Reads rendered segments back, in order."""
    key, state = (), None

    def row():
        return pa.RecordBatch.from_pydict(
            {"conv_id": [key[0]], "n_turns": [state[0]], "turns_sha256": [state[1].hexdigest()], "loss_chars": [state[2]], "loss_sha256": [state[3].hexdigest()], "formatted_chars": [state[4]]},
            pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]),
        )

    for batch in batches:
        for conv, _, formatted, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv,):
                if key:
                    yield row()
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, _, _ in parse(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in zip(starts, ends):
                masked = unescape(formatted[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
    if key:
        yield row()


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted output says, read from it; takes the rows as ``format_events`` leaves them."""
    return formatted.mapInArrow(_digest, DIGEST)
