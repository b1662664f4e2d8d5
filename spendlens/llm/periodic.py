"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run of period q and at least four times that length holds each of its words four times or
more. So a word that is rarer than that in a segment of a text is in no run there, and the
segment falls apart at it; in the smaller parts further words are too rare, until every
part is stable. All segments of a chunk of texts are split together, one sort per round.
What survives is scanned lag by lag: at lag q the words at multiples of q are compared with
their successors, since a run puts three equal neighbours among them; the few places that
pass are compared word by word. A segment of m words costs about m log m comparisons.

Texts stay in their partition: one pass over the rows, no shuffle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import binary_array, bounded_batches, column_bytes, ragged, row_chunks
from ._words import IS_SPACE, joined_words, word_dictionary, word_spans

REPEATS = 4  # a run is at least this many times its period long
SHORTEST = 6  # and has at least this many words

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def frequent_segments(ids: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST):
    """(start, end) of the longest stretches in which every word occurs ``repeats`` times
    within the stretch; ``bounds`` are the rows. Stretches under ``shortest`` words go."""
    lo, hi = bounds[:-1], bounds[1:]
    found = []
    n_words = int(ids.max()) + 1 if len(ids) else 1
    while True:
        long = hi - lo >= shortest
        lo, hi = lo[long], hi[long]
        if not len(lo):
            break
        size = hi - lo
        pos = ragged(lo, size)
        seg = np.repeat(np.arange(len(lo)), size)
        _, of, count = np.unique(seg * n_words + ids[pos], return_inverse=True, return_counts=True)
        keep = count[of] >= repeats
        stable = np.logical_and.reduceat(keep, np.cumsum(size) - size)
        found.append(np.stack([lo[stable], hi[stable]]))
        keep &= ~stable[seg]  # only what was cut is looked at again
        first, last = keep.copy(), keep.copy()
        first[1:] &= ~keep[:-1] | (seg[1:] != seg[:-1])
        last[:-1] &= ~keep[1:] | (seg[1:] != seg[:-1])
        lo, hi = pos[first], pos[last] + 1
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def _agreeing(x: np.ndarray, q: int, at: int, step: int) -> int:
    """How many places from ``at`` on, going by ``step`` (1 or -1), hold x[i] == x[i + q]."""
    done, width = 0, 64
    while True:
        if step > 0:
            a, b = at + done, min(at + done + width, len(x) - q)
            same = x[a:b] == x[a + q : b + q]
        else:
            a, b = max(0, at - done - width + 1), at - done + 1
            same = (x[a:b] == x[a + q : b + q])[::-1]
        if b <= a:
            return done
        wrong = np.flatnonzero(~same)
        if len(wrong):
            return done + int(wrong[0])
        done += b - a
        width *= 2


def segment_runs(x: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the words ``x``, periods ascending."""
    m, runs = len(x), []
    known = np.zeros((3, 0), np.int64)  # start, end, period of the runs so far

    def add(start: int, length: int, q: int) -> None:
        nonlocal known
        runs.append((start, length, q))
        known = np.append(known, [[start], [start + length], [q]], axis=1)

    def inside(lo: int, hi: int, q: int) -> int:
        """End of a known run that holds the words from lo to hi and has a period dividing q, or 0."""
        held = (known[0] <= lo) & (known[1] >= hi) & (q % known[2] == 0)
        return int(known[1][held].max()) if held.any() else 0

    apart = repeats - 1  # equal neighbours that a run has at distance q
    for q in range(1, m // repeats + 1):
        need = max(shortest, repeats * q)
        if need > m:
            break
        if q < 3 or apart < 3:
            same = np.zeros(m - q + 2, bool)
            same[1:-1] = x[:-q] == x[q:]
            edge = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                if b - a + q >= need and not inside(a, b + q, q):
                    add(a, b - a + q, q)
            continue
        sample = x[::q]
        same = sample[1:] == sample[:-1]
        three = same[:-2] & same[1:-1] & same[2:]
        if not three.any():
            continue
        at = np.flatnonzero(three) * q
        for part in (2, 3, 5, 7):  # two places between the samples at a time
            more = at + q // part
            at = at[(x[more] == x[more + q]) & (x[more + q] == x[more + 2 * q])]
        reach = 0
        for j in at.tolist():
            if j < reach:
                continue
            end = inside(j, j + 3 * q + 1, q)
            if end:
                reach = end - q
                continue
            if not (x[j : j + 2 * q + 1] == x[j + q : j + 3 * q + 1]).all():
                continue
            reach = j + _agreeing(x, q, j, 1)
            start = j + 1 - _agreeing(x, q, j, -1)
            if reach - start + q >= need:
                add(start, reach - start + q, q)
    return runs


def chunk_runs(ids: np.ndarray, bounds: np.ndarray, repeats: int = REPEATS, shortest: int = SHORTEST):
    """(row, start in the row, length, period) of all runs, by row, start and period."""
    out = []
    for lo, hi in zip(*frequent_segments(ids, bounds, repeats, shortest).tolist()):
        out += [(lo + s, n, q) for s, n, q in segment_runs(ids[lo:hi], repeats, shortest)]
    if not out:
        return np.zeros((4, 0), np.int64)
    start, length, period = np.array(out, np.int64).T
    row = np.searchsorted(bounds, start, "right") - 1
    start = start - bounds[row]
    order = np.lexsort((period, start, row))
    return np.stack([row, start, length, period])[:, order]


def replay(bounds: np.ndarray, h: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """For every word the word that it becomes: in rows whose ``h`` ends in 0, the words from
    the ``h // 10 % n``-th on repeat a period that ``h`` chooses."""
    index = np.arange(bounds[-1])
    n = np.diff(bounds)
    for r in np.flatnonzero(valid & (h % 10 == 0) & (n > 0)).tolist():
        g, size = int(h[r]) // 10, int(n[r])
        a = g % size
        p = 1 + (size - a) // (3 + g % 8)
        index[bounds[r] + a : bounds[r + 1]] = bounds[r] + a + np.arange(size - a) % p
    return index


def periodic_runs(
    docs: DataFrame,
    *,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    replay_col: str | None = None,
    repeats: int = REPEATS,
    shortest: int = SHORTEST,
    names: tuple[str, str, str] = ("n_words", "runs", "collapsed"),
) -> DataFrame:
    """The columns of ``keep``, n_words, runs and collapsed of every row.

    Words are runs of bytes other than blank and 9 to 13. A run is a longest stretch of words
    with smallest period q that is at least ``repeats * q`` and ``shortest`` words long;
    ``runs`` lists them by start, then period. ``collapsed`` (binary) has the words joined by
    one blank, but those that a run holds after its first period. ``replay_col`` names a long
    column by which words are repeated first (see ``replay``; null: not).

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Words are
    compared whole and exactly. Repeated rows give repeated rows; other columns are not read,
    whatever their names. A very long text is one chunk of its own.
    """
    if repeats < 2 or shortest < 2:
        raise ValueError("a run has at least two periods and two words")
    bounded_batches(docs)
    keep = list(keep)
    h = F.col(f"`{replay_col}`").cast("long") if replay_col else F.lit(None).cast("long")
    frame = docs.select(*[F.col(f"`{c}`") for c in keep], h.alias("__h"), F.col(f"`{text_col}`").alias("__text"))
    ddl = ", ".join(
        [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
        + [f"`{names[0]}` bigint", f"`{names[1]}` {RUNS}", f"`{names[2]}` binary"]
    )

    def chunk(data, offsets, seed, valid):
        starts, ends, bounds = word_spans(data, offsets, ~IS_SPACE[data])
        ids, _ = word_dictionary(data, starts, ends)
        index = replay(bounds, seed, valid)
        row, start, length, period = chunk_runs(ids[index], bounds, repeats, shortest)
        depth = np.zeros(len(index) + 1, np.int64)  # runs over each word, their first periods left out
        np.add.at(depth, bounds[row] + start + period, 1)
        np.add.at(depth, bounds[row] + start + length, -1)
        kept = np.cumsum(depth)[:-1] == 0
        at = index[kept]
        text, text_offsets = joined_words(data, starts[at], ends[at], np.append(0, np.cumsum(kept))[bounds])
        flat = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"])
        per_row = np.bincount(row, minlength=len(offsets) - 1)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(per_row)), pa.int32()), flat)
        return [pa.array(np.diff(bounds), pa.int64()), lists, binary_array(text, text_offsets)]

    def run(batches):
        for batch in batches:
            column = batch.column(len(keep))
            seed, valid = column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            data, offsets = column_bytes(batch.column(len(keep) + 1))
            for lo, hi in row_chunks(offsets):
                part = data[offsets[lo] : offsets[hi]]
                made = chunk(part, offsets[lo : hi + 1] - offsets[lo], seed[lo:hi], valid[lo:hi])
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(kept + made, [*keep, *names])

    return frame.mapInArrow(run, ddl)


def strongest_run(runs: Column | str) -> Column:
    """The run of the greatest length / period, exactly; ties by start, then period; null
    where there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    mine = lambda r, best: r["length"] * best["period"]
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(best.isNull() | (mine(r, best) > best["length"] * r["period"]), r).otherwise(best),
    )


def brute_force_runs(words: list, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """All runs by comparing every word at every lag, for tests."""
    out, spans = [], set()
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(shortest, repeats * q) and (i, length) not in spans:
                spans.add((i, length))
                out.append((i, length, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length / period; ties by start, then period (for tests)."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
