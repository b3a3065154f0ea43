"""Chat formatting from event logs.

A log has one row for each event of a conversation: whole messages, streamed deltas, edits
and regenerations.  The events of one message are folded into its final text; messages are
rendered in order with a turn template, and every control string inside a text is escaped
reversibly, so that a text can never open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
EVENTS = ("message", "delta", "edit", "regenerate", "delete")
_ESCAPED = re.compile(r"\\(.)", re.S)
_PIECE = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\n\Z", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left: ``\\`` becomes ``\\\\`` and ``<|`` becomes ``<\\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, position, message_id, role, text: the final messages of a log.

    events: conv_id, seq, message_id, kind, role, text.  ``message`` and ``edit`` set a
    message's text, ``regenerate`` empties it (its deltas follow), ``delta`` adds to it,
    ``delete`` removes the message.  Events are taken by (seq, kind, text); a message stands
    where its first event stood and has the role of its first event that names one.  Null
    texts are empty.  Events that repeat exactly count each time.  The fold keys on the
    message, so a very long conversation is folded in as many groups as it has messages.
    """
    own = Window.partitionBy("conv_id", "message_id")
    e = events.select("conv_id", "seq", "message_id", "kind", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    e = e.withColumn("set_at", F.max(F.when(F.col("kind").isin("message", "edit", "regenerate", "delete"), F.struct("seq", "kind", "text"))).over(own))
    now = F.struct("seq", "kind", "text")
    part = F.when(F.col("set_at").isNull() | (now > F.col("set_at")), F.when(F.col("kind") == "delta", F.struct("seq", "text")))
    folded = e.groupBy("conv_id", "message_id").agg(
        F.min("seq").alias("position"),
        F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))["role"].alias("role"),
        F.max("set_at").alias("set_at"),
        F.array_sort(F.collect_list(part)).alias("deltas"),
    )
    base = F.when(F.col("set_at")["kind"].isin("message", "edit"), F.col("set_at")["text"]).otherwise(F.lit(""))
    text = F.concat(base, F.array_join(F.transform("deltas", lambda d: d["text"]), ""))
    folded = folded.where(F.col("set_at").isNull() | (F.col("set_at")["kind"] != "delete"))
    return folded.select("conv_id", "position", "message_id", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        pieces, begin, end = [], [], []
        for role, text in zip(roles, texts, strict=True):
            head, body = f"{OPEN}{_escape_role(role)}\n", escape(text)
            pieces.append(f"{head}{body}{CLOSE}\n")
            begin.append(len(head) if role == "assistant" else 0)
            end.append(len(head) + len(body) if role == "assistant" else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(pieces, pa.string()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
            names=["conv_id", "position", "formatted", "loss_from", "loss_to"],
        )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, position, formatted, loss_from, loss_to: one rendered piece for each message.

    A conversation's formatted text is its pieces in order of position.  The loss mask is
    the code points from loss_from to loss_to of a piece: the (escaped) text of an assistant
    message.  ``position`` must order the messages of a conversation.
    """
    thin = messages.select("conv_id", "position", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    position = thin.schema["position"].dataType.simpleString()
    return thin.mapInArrow(_render, f"conv_id {thin.schema['conv_id'].dataType.simpleString()}, position {position}, formatted string, loss_from long, loss_to long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> one digest row a conversation; only hashes and counts are held."""
    conv, state, out = None, None, []
    for batch in batches:
        for c, piece, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if state is None or c != conv:
                if state is not None:
                    out.append((conv, state))
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            found = _PIECE.match(piece)
            if not found:
                raise ValueError(f"conversation {c}: a piece is not of the template")
            state[0] += 1
            state[1].update(f"{_unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
            loss = unescape(piece[a:b])
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(piece)
        if len(out) > 5000:
            yield _digests(out)
            out = []
    if state is not None:
        out.append((conv, state))
    yield _digests(out)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    cols = [[c for c, _ in rows], *([s[k].hexdigest() if k in (1, 3) else s[k] for _, s in rows] for k in range(5))]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars from rendered pieces.

    Pieces are partitioned by conversation, sorted and streamed, so a conversation of any
    length is digested without being held.
    """
    rows = pieces.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss_from", "loss_to", "position")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "position").select("conv_id", "formatted", "loss_from", "loss_to")
    return rows.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as a log of events whose fold gives the turns again.

    An assistant's turn was streamed: a draft in two deltas, a regeneration, then the text in
    three deltas.  A user's turn was a message of its first half that was edited.  Any other
    turn is one message.  Turns are ordered by (turn, role, text); rows that repeat exactly
    are messages of their own.  Null texts are empty, null conv_ids are one conversation, an
    empty table gives an empty log.
    """
    n = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("at", F.row_number().over(n))
    size = F.length("text")
    third = F.floor(size / 3).cast("int")
    part = lambda begin, length: F.substring("text", begin, length)
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    half = part(F.lit(1), F.floor(size / 2).cast("int"))
    streamed = F.array(
        event("delta", half), event("delta", F.reverse(half)), event("regenerate", F.lit("")),
        event("delta", part(F.lit(1), third)), event("delta", part(third + 1, third)), event("delta", part(2 * third + 1, size)),
    )
    edited = F.array(event("message", half), event("edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("role") == "user", edited).otherwise(F.array(event("message", F.col("text"))))
    each = rows.select("conv_id", "turn", "at", "role", F.posexplode(events).alias("step", "e"))
    return each.select("conv_id", F.struct("turn", "at", "step").alias("seq"), F.struct("turn", "at").alias("message_id"), "e.kind", "role", "e.text")
