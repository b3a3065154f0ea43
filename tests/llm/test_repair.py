"""op13 against enumeration of all edits on small conversations, and against a plain programme over strings on whole tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pyarrow.parquet as pq
import pytest

from palimpsest.llm import queries as Q
from palimpsest.llm import repair as R

LEGAL = re.compile("(s?(ua)+)?")
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows: list[tuple]) -> dict:
    out: dict = {}
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        at = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        at.extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return {c: sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, x in out.items()}


def faults(rows: list[tuple]) -> list[str]:
    seen, out = set(), []
    for _, role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def apply(audit: str, rows: list[tuple]) -> list[str] | None:
    """role:text of what an audit leaves, None if it is not legal."""
    out, left = [], list(rows)
    for e in audit:
        expected = lambda: "user" if not out or out[-1][0][0] in "sa" else "assistant"
        if e == "I":
            out.append((expected(), ""))
            continue
        _, role, text = left.pop(0)
        if e == "K":
            out.append((role or "?", text))
        elif e == "R":
            out.append((expected(), text))
    return [f"{r}:{t}" for r, t in out] if not left and LEGAL.fullmatch("".join(r[0] for r, _ in out)) else None


def cost_of(audit: str, faults: list[str]) -> int | None:
    total, left = 5 * audit.count("I"), list(faults)
    for e in audit.replace("I", ""):
        f = left.pop(0)
        if e != "D" and f in ("blank", "duplicate"):
            return None
        total += {"K": 0, "R": 1, "D": 2}[e] + 5 * (e != "D" and f == "truncated")
    return total


def enumerated(rows: list[tuple]) -> tuple[int, str]:
    f, best = faults(rows), None
    for words in product(R.WORDS, repeat=len(rows)):
        for tail in ("", "I", "II"):
            audit = "".join(words) + tail
            cost = cost_of(audit, f)
            if cost is not None and (best is None or (cost, audit) < best) and apply(audit, rows) is not None:
                best = cost, audit
    return best


def plain(rows: list[tuple]) -> tuple[int, str]:
    """The programme with strings: after each row, the best (cost, audit) of each state."""
    best = {R.EMPTY: (0, "")}
    for (_, role, _), f in zip(rows, faults(rows)):
        now: dict = {}
        for s, (c, a) in best.items():
            fault = R.GONE if f in ("blank", "duplicate") else R.CUT if f else R.FINE
            for state, w, to, cost in R.MOVES[role[:1] if role[:1] in ("s", "u", "a") else "", fault]:
                if state == s and (to not in now or (c + cost, a + R.WORDS[w]) < now[to]):
                    now[to] = c + cost, a + R.WORDS[w]
        best = now
    return min((c + R.ENDINGS[s][0], a + "I" * R.ENDINGS[s][1]) for s, (c, a) in best.items())


def wanted(rows: list[tuple], solve=plain) -> dict:
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    for conv, own in damage(rows).items():
        if not own:
            continue
        f, (cost, audit) = faults(own), solve(own)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        text = "\n".join(apply(audit, own))
        out[conv] = (gaps, *(f.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df) -> dict:
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, audit string")


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01"])
def test_op13(spark, name):
    t = pq.read_table(f"/root/testdata/{name}/conversations.parquet").to_pydict()
    assert got(Q.op13_conversation_repair(spark, f"/root/testdata/{name}")) == wanted(list(zip(*(t[c] for c in ("conv_id", "turn", "role", "text")))))


def mixed(rng: random.Random, convs: range, longest: int) -> list[tuple]:
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None]
    texts = ["Yes.", "No!", "cut", "", None, " \t", "Why?"]
    return [(c, rng.choice([t, t, t, t + 5, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Row {c} {t}.") for c in convs for t in range(rng.randrange(1, longest + 1))]


def test_all_edits(spark):
    """Every edit sequence of conversations of up to three rows after damage."""
    rows = [r for r in mixed(random.Random(3), range(150), 3)]
    small = {c for c, own in damage(rows).items() if len(own) <= 3}
    rows = [r for r in rows if r[0] in small]
    assert got(R.repair_conversations(table(spark, rows))) == wanted(rows, enumerated)


def test_pieces(spark, monkeypatch):
    """Conversations cut into pieces, null ids, repeats of whole rows: as without cuts."""
    rng = random.Random(4)
    rows = mixed(rng, range(30), 60) + [(None, t, r, x) for _, t, r, x in mixed(rng, range(3), 40)]
    rows += [(77, 3, "user", "Again.")] * 500 + [(77, t, "assistant", f"No {t}.") for t in range(900)]
    want = wanted(rows)
    assert got(R.repair_conversations(table(spark, rows).repartition(5))) == want

    # pieces of 7 rows composed as a task would
    monkeypatch.setattr(R, "PIECE", 7)
    for own in damage(rows).values():
        if own:
            pieces, now = [], R.Piece(0, 0, R.STATES)
            for (t, role, text), f in zip(own, faults(own)):
                if len(now.runs) >= R.PIECE:
                    pieces.append(now)
                    now = R.Piece(0, len(pieces), R.STATES)
                now.add(t, role[:1], f == "blank", f == "duplicate", f == "truncated", 1)
            out = R._conversation([tuple(p.row(0)[i] for i in (0, 1, 2, 7, 8, 10, 11)) for p in [*pieces, now]])
            audit = "".join(p.audit(o[2]) + "I" * o[3] for p, o in zip([*pieces, now], reversed(out)))
            assert (out[0][4][5], audit) == plain(own)


def test_edges(spark):
    rows = [(1, 0, "user", None), (2, None, None, None), (None, 0, "", "Empty role."), (3, 0, "user", "x" * 200_000 + "."), (4, 9, "system", "Only system.")]
    assert got(R.repair_conversations(table(spark, rows))) == wanted(rows)
    assert R.repair_conversations(table(spark, rows).limit(0)).count() == 0
