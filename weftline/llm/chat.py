"""Chat formatting from event logs.

A log holds events (conv_id, seq, kind, turn, role, text) of these kinds:

* ``message``: the message at ``turn`` is this text, whatever was there;
* ``delta``: this text is added to the end of the message at ``turn``;
* ``edit``: the text of the message at ``turn`` is replaced;
* ``regenerate``: the messages at ``turn`` and after it are withdrawn.

Logs are partitioned by conversation and sorted by sequence. Window functions
drop the events that later ones undo; what is left is sorted by turn and
sequence and folded as a stream, so that a task holds one message at a time,
however long the conversation. Each message is rendered as

    <s>[role]\\n text </s>\\n

without the blanks. In texts and roles ``&``, ``<`` and ``[`` become entities,
so no control string can begin inside them; in roles also ``]`` and a newline.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_TURN = re.compile(r"<s>\[([^\]]*)\]\n([^<]*)</s>\n")


def escape(text: str, role: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    return text.replace("]", "&#93;").replace("\n", "&#10;") if role else text


def unescape(text: str) -> str:
    return text.replace("&#10;", "\n").replace("&#93;", "]").replace("&#91;", "[").replace("&lt;", "<").replace("&amp;", "&")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def live_events(events: DataFrame) -> DataFrame:
    """The events that make up the final messages, in columns conv_id, seq, turn, role, text.

    Ties in seq are taken in the order of kind, turn, role and text. A null
    text is empty; events with an unknown kind or a null turn are left out.
    """
    known = events.where(F.col("kind").isin("message", "delta", "edit", "regenerate") & F.col("turn").isNotNull())
    order = [F.col(c).asc_nulls_first() for c in ("seq", "kind", "turn", "role", "text")]
    known = known.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    kept = known.withColumn("cut", cut).where((F.col("kind") != "regenerate") & (F.col("cut").isNull() | (F.col("turn") < F.col("cut"))))
    same = Window.partitionBy("conv_id", "turn")
    set_at = F.max(F.when(F.col("kind").isin("message", "edit"), F.col("at"))).over(same)
    # an edit may leave out the role: the message keeps the one it had last
    role = F.last("role", ignorenulls=True).over(same.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    kept = kept.withColumns({"set_at": set_at, "role": role}).where(F.col("set_at").isNull() | (F.col("at") >= F.col("set_at")))
    return kept.select("conv_id", F.col("at").alias("seq"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _render(batches):
    """Messages from live events in the order of conv_id, turn, seq."""
    key, role, pieces = None, "", []

    def flush(out):
        if key is not None:
            text, head = escape("".join(pieces)), f"<s>[{escape(role, True)}]\n"
            out.append((key[0], key[1], role, f"{head}{text}</s>\n", len(head) if role == "assistant" else None, len(text) if role == "assistant" else None))

    for batch in batches:
        out = []
        for conv, turn, r, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if (conv, turn) != key:
                flush(out)
                key, role, pieces = (conv, turn), r, []
            pieces.append(text)
        yield _rows(out)
    out = []
    flush(out)
    yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "turn", "role", "formatted", "loss_start", "loss_length"])


def format_chats(events: DataFrame) -> DataFrame:
    """One row per final message, sorted by conv_id and turn in each partition: conv_id, turn, role, formatted, loss_start, loss_length.

    The formatted conversation is its rows' texts in order. The loss mask
    covers an assistant's text: its start and length in the row, in code
    points. A null conv_id is a conversation of its own; a log without events
    gives no rows. A conversation's events are ordered in one task, which holds
    one message at a time.
    """
    live = live_events(events).withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))
    ordered = live.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    return ordered.mapInArrow(_render, "conv_id long, turn long, role string, formatted string, loss_start long, loss_length long")


def as_events(conversations: DataFrame) -> DataFrame:
    """Message events from rows (conv_id, turn, role, text); rows with the same turn are turns of their own, by role and text."""
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    return conversations.select("conv_id", "turn", "role", "text").withColumn("turn", number).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def as_streamed_events(conversations: DataFrame) -> DataFrame:
    """The log that a chat would have left behind: each text comes as a draft that is withdrawn, then in two deltas, or as a message that is edited.

    An assistant's turn begins with a delta of another text; a regeneration
    takes it back. Others are sent with the first half of the text, and the
    edit brings the whole. What is folded from it is what as_events() says.
    """
    rows = as_events(conversations)
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    none = F.lit(None).cast("string")
    said = F.array(event("delta", F.reverse("text")), event("regenerate", none), event("delta", first), event("delta", second))
    sent = F.array(event("message", first), event("edit", F.col("text")))
    each = rows.select("conv_id", "turn", "role", F.posexplode(F.when(F.col("role") == "assistant", said).otherwise(sent)).alias("i", "e"))
    return each.select("conv_id", (F.col("turn") * 4 + F.col("i")).alias("seq"), "e.kind", "turn", "role", "e.text")


def _digests(batches):
    key, state = None, None

    def row():
        return (key[0], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"])

    for batch in batches:
        out = []
        for conv, text, start, length in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_length")), strict=True):
            if key is None or key[0] != conv:
                if key is not None:
                    out.append(row())
                key, state = (conv,), {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "chars": 0}
            for role, said in parse(text):
                state["n"] += 1
                state["turns"].update(f"{role}\n{said}\n".encode())
            if start is not None:
                masked = unescape(text[start : start + length])
                state["loss"].update(masked.encode())
                state["loss_n"] += len(masked)
            state["chars"] += len(text)
        yield _digest_rows(out)
    yield _digest_rows([row()] if key is not None else [])


def _digest_rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(messages: DataFrame) -> DataFrame:
    """What format_chats() holds for each conversation, read back from the formatted texts; takes its partitions as they are. No messages give no rows."""
    return messages.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
