"""Repair of damaged conversations by a rank-compressed dynamic programme.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Each row is edited by one
macro: a run of up to two inserted turns, then the row itself kept (K), given another role
(R) or deleted (D).  The nine macros are words of a prefix-free code over D < I < K < R, so
audits of equally many rows compare like their words, one after the other.  The programme
therefore never compares audit strings: each state's best audit is an integer, its *rank*
among the states of the layer, and (rank of the parent, word) orders the next layer.
Parent pointers give the string back in the end.

Ranks and cost differences stay small, so a layer's step is looked up in a cache.  A
conversation may be cut anywhere: the programme runs from every state in which a piece may
begin, with ranks across them all, and pieces are composed like rows.  Rows are dealt by
ranges of (conversation, turn), so a very long conversation is spread over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.shared import written

#: States: nothing put out yet, after a system turn, after a user's, after an assistant's.
EMPTY, SYSTEM, USER, ASSISTANT = STATES = range(4)
WORDS = sorted("I" * r + e for r in range(3) for e in "DKR")
INSERT, RENAME, REMOVE, TRUNCATED = 5, 1, 2, 5
#: Cost and length of the inserts after the last row, from each state.
ENDINGS = {EMPTY: (0, 0), SYSTEM: (2 * INSERT, 2), USER: (INSERT, 1), ASSISTANT: (0, 0)}
FINE, CUT, GONE = range(3)
NEXT = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Rows (with copies) of a piece of a conversation at most: its pointers are held while it is open.
PIECE = 1 << 15
LONGEST = (1 << 63) - 1
SPACE = " \t\n\x0b\x0c\r"

PIECES = (
    "conv_id long, part int, piece int, at long, role string, text string, copies long, "
    "costs array<long>, ranks array<int>, audits array<string>, stats array<long>, ends array<string>"
)
PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state, word, next state, cost) of a row with this role initial and fault."""
    out = []
    for state in STATES:
        for w, word in enumerate(WORDS):
            here, cost = state, INSERT * (len(word) - 1)
            for _ in word[:-1]:
                here = NEXT[here]
            if word[-1] == "D":
                out.append((state, w, here, cost + REMOVE))
            elif fault != GONE:
                cost += TRUNCATED * (fault == CUT)
                if word[-1] == "R":
                    out.append((state, w, NEXT[here], cost + RENAME))
                elif initial == "s" and here == EMPTY:
                    out.append((state, w, SYSTEM, cost))
                elif initial == {USER: "u", ASSISTANT: "a"}[NEXT[here]]:
                    out.append((state, w, NEXT[here], cost))
    return out


MOVES = {(i, f): _moves(i, f) for i in ("s", "u", "a", "") for f in (FINE, CUT, GONE)}
Layer = tuple[tuple[int, int] | None, ...]


def opened(starts: tuple[int, ...]) -> Layer:
    """Layer of no rows: (cost, rank) by 4 * start + state, None where a state can't be reached."""
    return tuple((0, 0) if k // 4 == k % 4 and k % 4 in starts else None for k in range(16))


def _ranked(best: list[tuple | None]) -> list[tuple[int, int] | None]:
    """(cost, order key, ...) -> (cost, rank of the key)."""
    order = {key: r for r, key in enumerate(sorted({b[1] for b in best if b}))}
    return [(b[0], order[b[1]]) if b else None for b in best]


@lru_cache(1 << 16)
def step(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, bytes]:
    """(cost of all, next layer above that cost, parent pointers: 9 * state + word, or 255)."""
    best: list[tuple | None] = [None] * 16
    for start in range(0, 16, 4):
        for state, w, to, cost in MOVES[initial, fault]:
            if now := layer[start + state]:
                found = (now[0] + cost, (now[1], w), 9 * state + w)
                if best[start + to] is None or found < best[start + to]:
                    best[start + to] = found
    base = min(b[0] for b in best if b)
    ranked = _ranked([b and (b[0] - base, b[1]) for b in best])
    return base, tuple(ranked), bytes(b[2] if b else 255 for b in best)


class Piece:
    """A run of a conversation's rows in order; only pointers and counts are held."""

    def __init__(self, conv, piece: int, starts: tuple[int, ...]):
        self.conv, self.piece, self.layer = conv, piece, opened(starts)
        self.cost, self.at = 0, 0
        self.runs: list[tuple[bytes, int, int]] = []  # pointers, equal layers in a row, cost of each
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, initial: str, blank: bool, repeated: bool, cut: bool, copies: int) -> None:
        """One row and its equal copies, in order."""
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - (not repeated)
        fault = GONE if blank or repeated else CUT if cut else FINE
        self.truncated += fault == CUT
        pair = (self.last or "") + initial
        self.illegal += (self.last is not None and pair not in LEGAL) + (copies - 1)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        kind = initial if initial in ("s", "u", "a") else ""
        self._run(kind, fault)
        left = copies - 1
        while left:
            before, n = self.layer, len(self.runs)
            self._run(kind, GONE)
            left -= 1
            if self.layer == before and left:  # so are all the layers of the copies that follow
                pointers, _, base = self.runs[n]
                self.runs[n] = (pointers, 1 + left, base)
                self.cost += base * left
                left = 0
        self.at += 1

    def _run(self, kind: str, fault: int) -> None:
        base, self.layer, pointers = step(self.layer, kind, fault)
        self.cost += base
        self.runs.append((pointers, 1, base))

    def audit(self, k: int) -> str | None:
        """The best audit from start k // 4 to state k % 4."""
        if self.layer[k] is None:
            return None
        start, state, words = k - k % 4, k % 4, []
        for pointers, times, _ in reversed(self.runs):
            while times:
                before, w = divmod(pointers[start + state], 9)
                n = times if before == state else 1
                words.append(WORDS[w] * n)
                state, times = before, times - n
        return "".join(reversed(words))

    def row(self, part: int) -> tuple:
        costs = [None if x is None else self.cost + x[0] for x in self.layer]
        ranks = [None if x is None else x[1] for x in self.layer]
        stats = [self.low, self.high, self.turns, self.blank, self.duplicate, self.truncated, self.illegal]
        return (self.conv, part, self.piece, -1, None, None, None, costs, ranks, [self.audit(k) for k in range(16)], stats, [self.first, self.last])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, initial, blank, repeated, cut, copies) with their piece, and one row for each piece."""
    part, now, piece = TaskContext.get().partitionId(), None, 0
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string())]

    def closed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=PIECE_NAMES)

    for batch in batches:
        places, done = [], []
        for conv, turn, initial, blank, repeated, cut, copies in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6, 7, 8)), strict=True):
            if now is None or now.conv != conv or len(now.runs) >= PIECE:
                # a conversation that follows another one in this task begins here
                starts = (EMPTY,) if now is not None and now.conv != conv else STATES
                if now is not None:
                    done.append(now.row(part))
                now, piece = Piece(conv, piece, starts), piece + 1
            places.append((now.piece, now.at))
            now.add(turn, initial, blank, repeated, cut, copies)
        n = len(places)
        own = [batch.column(0), pa.array([part] * n, kinds[1]), pa.array([p for p, _ in places], kinds[2]), pa.array([a for _, a in places], kinds[3])]
        yield pa.RecordBatch.from_arrays([*own, batch.column(2), batch.column(3), batch.column(8), *(pa.nulls(n, t) for t in kinds[7:])], names=PIECE_NAMES)
        if done:
            yield closed(done)
    if now is not None:
        yield closed([now.row(part)])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Piece rows in order -> (part, piece, pick: 4 * start + end, tail: inserts after the last row, stats: of the conversation, with its last piece)."""
    conv, pieces = None, []
    names, kinds = ["part", "piece", "pick", "tail", "stats"], [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pieces and row[0] != conv:
                out += _conversation(pieces)
                pieces = []
            conv = row[0]
            pieces.append(row)
        if out:
            yield batch_of(out)
    if pieces:
        yield batch_of(_conversation(pieces))


def _conversation(pieces: list[tuple]) -> list[tuple]:
    """The pieces of one conversation (conv_id, part, piece, costs, ranks, stats, ends) composed: the best (start, end) of each, and totals."""
    layer: list[tuple[int, int] | None] = [(0, 0), None, None, None]
    parents = []
    for _, _, _, costs, ranks, _, _ in pieces:
        best: list[tuple | None] = [None] * 4
        for start, now in enumerate(layer):
            for end in STATES if now else ():
                if costs[4 * start + end] is not None:
                    found = (now[0] + costs[4 * start + end], (now[1], ranks[4 * start + end]), start)
                    if best[end] is None or found < best[end]:
                        best[end] = found
        layer = _ranked(best)
        parents.append([b and b[2] for b in best])
    cost, _, tail, end = min((now[0] + ENDINGS[s][0], now[1], ENDINGS[s][1], s) for s, now in enumerate(layer) if now)
    out = []
    for (_, part, piece, *_), starts in zip(reversed(pieces), reversed(parents), strict=True):
        out.append((part, piece, 4 * starts[end] + end, 0 if out else tail, None))
        end = starts[end]
    low = high = last = None
    turns, blank, duplicate, truncated, illegal = 0, 0, 0, 0, 0
    for *_, (first, now, n, *counts), (begin, finish) in pieces:
        if n:
            turns += n - (first == high)
            low, high = first if low is None else low, now
        blank, duplicate, truncated = blank + counts[0], duplicate + counts[1], truncated + counts[2]
        illegal += counts[3] + (last is not None and last + begin not in LEGAL)
        last = finish
    gaps = 0 if low is None else high - low + 1 - turns
    out[0] = (*out[0][:4], [min(gaps, LONGEST), blank, duplicate, truncated, illegal, cost])
    return out


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits of pieces, each before its rows, in order -> one row a conversation; texts are hashed as they come."""
    conv, state, out = None, None, []
    for batch in batches:
        for c, role, text, copies, audit, stats in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if state is None or c != conv:
                if state is not None:
                    out.append((conv, *state.end()))
                conv, state = c, _Telling()
            if audit is not None:
                state.open(audit, stats)
            else:
                for _ in range(copies):
                    state.row(role, text)
        if len(out) > 2000:
            yield _results(out)
            out = []
    if state is not None:
        out.append((conv, *state.end()))
    if out:
        yield _results(out)


class _Telling:
    """The edits of one conversation carried out; what is put out is hashed."""

    def __init__(self):
        self.audits, self.words, self.at, self.state = [], "", 0, EMPTY
        self.stats, self.hash, self.some = None, hashlib.sha256(), False

    def _put(self, role: str | None, text: str) -> None:
        self.state = NEXT[self.state] if role is None or role[0] != "s" or self.state != EMPTY else SYSTEM
        line = f"{ROLE[self.state] if role is None else role}:{text}"
        self.hash.update(("\n" + line if self.some else line).encode())
        self.some = True

    def _inserts(self) -> None:
        while self.words[self.at : self.at + 1] == "I":
            self._put(None, "")
            self.at += 1

    def open(self, audit: str, stats) -> None:
        self.words, self.at = audit, 0
        self.audits.append(audit)
        self.stats = stats or self.stats

    def row(self, role: str, text: str) -> None:
        self._inserts()
        edit = self.words[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else None, text)

    def end(self) -> tuple:
        self._inserts()
        return self.stats, "".join(self.audits), self.hash.hexdigest()


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _results(rows: list[tuple]) -> pa.RecordBatch:
    conv, stats, audits, marks = zip(*rows, strict=True)
    counts = [pa.array([s[i] for s in stats], pa.int64()) for i in range(len(COUNTS))]
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), *counts, pa.array(audits), pa.array(marks)], names=["conv_id", *COUNTS, "audit", "repaired_sha256"])


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows after damage, equal ones counted.

    By crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 gives it the role user.  A
    null is one space, in the key as in role and text; conv_id and turn stay null.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _shown(F.col("role")).alias("role"), _shown(F.col("text")).alias("text"))
    rows = rows.withColumn("kind", F.crc32(F.concat(_shown(F.col("conv_id")), F.lit(":"), _shown(F.col("turn")))) % 20).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    rows: conv_id, turn, role, text, copies (equal rows counted), without null role or text.
    Rows are taken by turn (nulls first), then role and text; null conv_ids are a
    conversation.  A row's first fault counts: blank (no word), duplicate (role and text of
    an earlier row, further copies), truncated (its last character that is no white space is
    none of ``.!?``).  Edits: keep 0, another role 1, delete 2 (blank and duplicate rows
    must go), insert 5; a truncated row that stays adds 5.  ``audit`` holds the cheapest
    edits' initials, the ASCII-least of equal cost.  A role that does not begin with s, u or
    a can't be kept, an empty one neither.  gaps are cut to a long.  An empty table gives an
    empty result.
    """
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    end = F.rtrim("text", F.lit(SPACE))
    rows = written(rows, "damaged").withColumns({"end": F.right(end, F.lit(1)), "mark": mark, "when": F.struct(F.col("turn").isNotNull().alias("some"), "turn")})
    first = rows.where("end != ''").groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min("when").alias("first"))
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    rows = rows.select(
        "conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), (F.col("end") == "").alias("blank"),
        F.coalesce((F.col("end") != "") & (F.col("when") > F.col("first")), F.lit(False)).alias("repeated"), (~F.col("end").isin(".", "!", "?")).alias("cut"), "copies",
    )
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = written(dealt.mapInArrow(_cut, PIECES), "pieces")
    pieces = found.where("at = -1")
    light = pieces.select("conv_id", "part", "piece", "costs", "ranks", "stats", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    picks = light.mapInArrow(_chosen, "part int, piece int, pick int, tail int, stats array<long>")
    audit = F.concat(F.element_at("audits", F.col("pick") + 1), F.repeat(F.lit("I"), F.col("tail")))
    heads = pieces.drop("stats").join(picks, ["part", "piece"]).select("conv_id", "part", "piece", "at", "role", "text", "copies", audit.alias("audit"), "stats")
    lines = found.where("at >= 0").select("conv_id", "part", "piece", "at", "role", "text", "copies", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("array<long>").alias("stats"))
    told = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece", "at").select("conv_id", "role", "text", "copies", "audit", "stats")
    return told.mapInArrow(_told, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``repair`` of the damaged table; a conversation without rows after damage has zeros, an empty audit and the hash of nothing.

    conversations: conv_id, turn, role, text; other columns are ignored, rows may repeat.
    """
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "c")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COUNTS]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
