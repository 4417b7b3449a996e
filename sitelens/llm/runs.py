"""Operator 11, periodic runs of words: harmonic grid probing.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are the same) and length >= max(SHORTEST, POWER * q).  For each period p
only the grid points 0, p, 2p, ... are probed, so that all periods of a text of n
words cost about n ln n probes: a run as long as that covers POWER - 1 grid points
in a row whose word equals the one at the next grid point.  Points that pass (and
agree half a period further on) are extended both ways by comparing slices of
doubling length.  Grid points inside a run that was found already, with the same
period or a divisor of it, are skipped: the stretch that they would be extended to
is that run.  A stretch found again with a multiple of its period is not a new run.

Probes are made for at most PROBES grid points at a time, whatever the length of
the text; words are numbered within their text.  Texts are independent: no shuffle.

Defined results: null and empty texts and texts of white space have no words and
no runs; repeated rows are each searched; extra columns pass through, those named
like a computed one are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Shortest run in words, and in periods.
SHORTEST = 6
POWER = 4
#: Grid points probed at a time.
PROBES = 1 << 20
#: First slice compared in an extension; later ones double.
SLICE = 32


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """For how many places from the start two arrays of like length agree, slice by slice."""
    at, size, n = 0, SLICE, len(a)
    while at < n:
        differ = a[at : at + size] != b[at : at + size]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = at + size, 2 * size
    return n


def _periods(first: int, last: int, n: int) -> int:
    """The last period whose grid, with those of all periods from ``first``, has at most PROBES points; ``first`` at least."""
    p, points = first, (n - 1) // first
    while p < last and points + (n - 1) // (p + 1) <= PROBES:
        p += 1
        points += (n - 1) // p
    return p


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of an array of word numbers, by start, then period."""
    n, longest = len(words), len(words) // POWER
    found: dict[tuple[int, int], int] = {}
    # per word: the end and the period of a found run that covers it
    ends, periods = np.zeros(n, np.int64), np.ones(n, np.int64)
    p0 = 1
    while p0 <= longest and n >= SHORTEST:
        p1 = _periods(p0, longest, n)
        each = np.arange(p0, p1 + 1)
        points = (n - 1) // each
        p = np.repeat(each, points)
        at = p * (np.arange(len(p)) - np.repeat(np.cumsum(points) - points, points))
        same = words[at] == words[at + p]
        row = POWER - 1
        passed = np.ones(max(len(p) - row + 1, 0), bool)
        for k in range(row):
            passed &= same[k : k + len(passed)]
        passed &= p[: len(passed)] == p[row - 1 :]
        on = np.flatnonzero(passed)
        at, p = at[on], p[on]
        half = at + p // 2
        on = (words[half] == words[half + p]) & (words[half + p] == words[half + 2 * p]) & ~((ends[at] > at + row * p) & (p % periods[at] == 0))
        last_p = last_end = 0
        for q, i in zip(p[on].tolist(), at[on].tolist()):
            if (q == last_p and i < last_end) or (ends[i] > i + row * q and q % periods[i] == 0):
                continue
            last_p, last_end = q, i + _agree(words[i : n - q], words[i + q :])
            start = i - _agree(words[:i][::-1], words[q : i + q][::-1])
            end = last_end + q
            if end - start >= max(SHORTEST, POWER * q) and found.setdefault((start, end), q) == q:
                inside = slice(start, end)
                longer = ends[inside] < end
                ends[inside][longer], periods[inside][longer] = end, q
        p0 = p1 + 1
    return sorted((start, end - start, q) for (start, end), q in found.items())


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers, equal where the words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        steps[start + q] += 1
        steps[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0)]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    best = None
    for run in runs:  # in the order of start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


_RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
RESULT = StructType([StructField("runs", ArrayType(_RUN)), StructField("strongest", _RUN), StructField("collapsed", StringType()), StructField("runs_sha256", StringType()), StructField("collapsed_sha256", StringType())])
_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _named(run: tuple[int, int, int] | None) -> dict | None:
    return None if run is None else {"start": run[0], "length": run[1], "period": run[2]}


def _searched(text: str | None, keep_text: bool) -> dict:
    # white space of the word rule is the ASCII white space at which bytes split
    words = (text or "").encode().split()
    runs = find_runs(numbered(words))
    kept = b" ".join(collapse(words, runs))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return {
        "runs": [_named(r) for r in runs],
        "strongest": _named(strongest(runs)),
        "collapsed": kept.decode() if keep_text else None,
        "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(kept).hexdigest(),
    }


def periodic_runs(text: Column, keep_text: bool = True) -> Column:
    """(runs, strongest, collapsed, runs_sha256, collapsed_sha256) of a text column; ``collapsed`` is null without ``keep_text``."""

    kind = pa.struct([("runs", pa.list_(_ARROW)), ("strongest", _ARROW), ("collapsed", pa.string()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([_searched(t.as_py(), keep_text) for t in texts], kind)

    return run(text)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the runs of ``text``, the strongest of them, and the text with every run cut to one period."""
    free = next(n for k in range(len(docs.columns) + 1) if (n := f"_found{k}") not in docs.columns)
    out = docs.withColumn(free, periodic_runs(F.col("text")))
    return out.withColumns({c: F.col(f"{free}.{c}") for c in ("runs", "strongest", "collapsed")}).drop(free)


def with_period(doc_id: Column, text: Column) -> Column:
    """The registered query's texts: a tenth of the documents, by crc32 of doc_id, repeat a stretch of words from some word to the end.

    Texts of other documents, of null ids and without words are as they were.
    """
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = g % n
    p = F.floor((n - a) / (3 + g % 8)) + 1
    stretch = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(stretch, times)), F.lit(1), (n - a).cast("int"))
    edited = F.concat_ws(" ", F.slice(words, F.lit(1), a.cast("int")), tail)
    return F.when((h % 10 == 0) & (n > 0), edited).otherwise(text)
