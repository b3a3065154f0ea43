"""Line differences of two versions (J13): a longest common subsequence in linear space, and the patch applied again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of all of a and each prefix of b, with one row held."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def common_lines(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence of two arrays of numbers, in order (divide and conquer on a)."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        if j - i == 1:
            at = np.flatnonzero(b[k:m] == a[i])
            if len(at):
                found.append((i, k + int(at[0])))
            continue
        middle = (i + j) // 2
        total = _lengths(a[i:middle], b[k:m]) + _lengths(a[middle:j][::-1], b[k:m][::-1])[::-1]
        cut = k + int(total.argmax())
        todo += [(i, middle, k, cut), (middle, j, cut, m)]
    return sorted(found)


def lines_of(text: str) -> list[str]:
    """Lines at \\n; the last one ends there too, for a clean difference."""
    return text.split("\n")[: -1 if text.endswith("\n") else None] if text else []


def hunks(a: list[str], b: list[str], context: int = 3) -> list[tuple[int, int, int, int, list[str]]]:
    """(first of a, lines of a, first of b, lines of b, marked lines): changes with ``context`` equal lines around; places count from 0."""
    numbers: dict[str, int] = {}
    x, y = (np.array([numbers.setdefault(line, len(numbers)) for line in side], np.int64) for side in (a, b))
    steps, i, k = [], 0, 0
    for p, q in [*common_lines(x, y), (len(a), len(b))]:
        steps += [("-", j, k) for j in range(i, p)] + [("+", p, j) for j in range(k, q)]
        if p < len(a):
            steps.append((" ", p, q))
        i, k = p + 1, q + 1
    changed = [n for n, s in enumerate(steps) if s[0] != " "]
    groups: list[list[int]] = []
    for n in changed:
        if groups and n - context <= groups[-1][1] + context:
            groups[-1][1] = n
        else:
            groups.append([n, n])
    out = []
    for first, last in groups:
        part = steps[max(0, first - context) : last + context + 1]
        marked = [s + (b[q] if s == "+" else a[p]) for s, p, q in part]
        out.append((part[0][1], sum(s[0] != "+" for s in marked), part[0][2], sum(s[0] != "-" for s in marked), marked))
    return out


def unified(old: str, new: str, from_name: str, to_name: str, context: int = 3) -> str:
    """A unified difference; empty for equal lines."""
    found = hunks(lines_of(old), lines_of(new), context)
    if not found:
        return ""
    out = [f"--- {from_name}", f"+++ {to_name}"]
    span = lambda first, n: f"{first + (n > 0)}" if n == 1 else f"{first + (n > 0)},{n}"
    for i, n, k, m, marked in found:
        out += [f"@@ -{span(i, n)} +{span(k, m)} @@", *marked]
    return "\n".join(out) + "\n"


def patched(old: str, patch: str) -> list[str]:
    """The lines that a unified difference makes of ``old``; raises where it does not fit."""
    lines, out, at = lines_of(old), [], 0
    for line in patch.split("\n")[2:-1] if patch else []:
        if line.startswith("@@ "):
            first, _, n = line.split()[1][1:].partition(",")
            start = int(first) - (n != "0")
            out += lines[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            if lines[at] != line[1:]:
                raise ValueError(f"line {at + 1} is not what the patch says")
            if line[0] == " ":
                out.append(lines[at])
            at += 1
    return out + lines[at:]


def version_diffs(versions: DataFrame, pairs: DataFrame, context: int = 3) -> DataFrame:
    """(memory_id, version_a, version_b, patch, n_removed, n_added) of asked pairs.

    versions: memory_id, version, content; pairs: memory_id, version_a, version_b.  A pair
    with an unknown version has a null patch and null counts.  Null contents are empty.
    Lines are compared whole; a task holds the two texts of one pair at a time.
    """
    own = versions.select("memory_id", "version", F.coalesce("content", F.lit("")).alias("content"))
    asked = pairs.select("memory_id", "version_a", "version_b").distinct()
    both = asked.join(own.toDF("memory_id", "version_a", "old"), ["memory_id", "version_a"], "left").join(own.toDF("memory_id", "version_b", "new"), ["memory_id", "version_b"], "left")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("memory_id", "version_a", "version_b")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, old, new in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)), strict=True):
                if old is None or new is None:
                    out.append((None, None, None))
                    continue
                patch = unified(old, new, f"v{a}", f"v{b}", context)
                body = patch.split("\n")[2:]
                out.append((patch, sum(x[:1] == "-" for x in body), sum(x[:1] == "+" for x in body)))
            patches, gone, more = zip(*out) if out else ((), (), ())
            columns = [*(batch.column(k) for k in range(3)), pa.array(patches, pa.string()), pa.array(gone, pa.int64()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["memory_id", "version_a", "version_b", "patch", "n_removed", "n_added"])

    rows = both.select("memory_id", "version_a", "version_b", "old", "new")
    return rows.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", patch string, n_removed long, n_added long")
