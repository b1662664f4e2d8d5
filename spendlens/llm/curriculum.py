"""Mixing sources to target weights along a curriculum whose weights change over time.

Each source has a weight schedule over training time 0 to 1, linear between its knots. The
integral of a schedule is the source's weight; the words of all sources are shared out by
weight, no source beyond ``max_epochs`` times its own words. A source's schedule integral,
scaled to its target, is its cumulative demand for words: D(t) words are wanted by time t.
The source's documents, in an order fixed by a hash of their ids and repeated as often as
needed, fill that demand one after another, so the place of a document in this stream is a
number of words x, and D inverted at x is its training position. Documents range-sorted by
position make the training order.

Running sums stay distributed: a source is cut into slices of its hash range by its number
of rows, sums run inside a slice and over the slices' totals, so no source meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.folds import row_index
from ..session import checkpointed
from ._bytes import column_bytes, row_chunks, with_text_columns
from ._words import IS_SPACE, word_spans

#: Schedules of the sources in code-point order, repeating: their integrals are 5, 2 and 1.
SCHEDULES = (((0.0, 7.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
MAX_EPOCHS = 3
SLICE_ROWS = 8_192
SEED = 42

Schedule = Sequence[tuple[float, float]]
PLAYS = "array<struct<epoch:int,words:bigint,position:double>>"


def integrals(schedule: Schedule) -> list[float]:
    """Integral of a schedule from its first knot to each knot."""
    if len(schedule) < 2 or schedule[0][0] != 0 or schedule[-1][0] != 1:
        raise ValueError("a schedule has knots from time 0 to time 1")
    total = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        if t1 <= t0 or w0 < 0 or w1 < 0:
            raise ValueError("times of a schedule rise and weights are not negative")
        total.append(total[-1] + (t1 - t0) * (w0 + w1) / 2)
    return total


def time_of(share: Column, schedule: Schedule) -> Column:
    """The time by which ``share`` (0 to 1) of the schedule's integral has passed."""
    done = integrals(schedule)
    y = share * F.lit(done[-1])
    out = F.lit(1.0)
    for i in reversed(range(len(schedule) - 1)):
        (t0, w0), (t1, w1) = schedule[i], schedule[i + 1]
        z = y - F.lit(done[i])
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * z, F.lit(0.0)))
        step = F.coalesce(F.try_divide(F.lit(2.0) * z, F.lit(w0) + root), F.lit(0.0))
        here = F.least(F.lit(t0) + F.greatest(step, F.lit(0.0)), F.lit(t1))
        out = here if i == len(schedule) - 2 else F.when(y < F.lit(done[i + 1]), here).otherwise(out)
    return out


def sized(docs: DataFrame, *, text_col: str, keep: Sequence[str], name: str) -> DataFrame:
    """The columns of ``keep`` and the number of words of every row (null: 0)."""

    def run(column):
        data, offsets = column_bytes(column)
        counts = [np.zeros(0, np.int64)]
        for lo, hi in row_chunks(offsets):
            part = data[offsets[lo] : offsets[hi]]
            _, _, bounds = word_spans(part, offsets[lo : hi + 1] - offsets[lo], ~IS_SPACE[part])
            counts.append(np.diff(bounds))
        return [pa.array(np.concatenate(counts), pa.int64())]

    return with_text_columns(docs, text_col, keep, [(name, "bigint")], run)


def source_targets(rows: DataFrame, schedules: Sequence[Schedule], max_epochs: int) -> DataFrame:
    """(__name, __rows, __have, __kind, __target) of every source of rows (__name, __size).

    Sources in code-point order, null last, take the schedules in turn. All words are shared
    by weight; a share above ``max_epochs`` times the source's words stops there, and what it
    leaves is shared again by weight among the others, until none is above.
    """
    mass = F.element_at(F.array(*[F.lit(integrals(s)[-1]) for s in schedules]), F.col("__kind") + 1)
    per = rows.groupBy("__name").agg(F.count("*").alias("__rows"), F.sum("__size").alias("__have"))
    per = row_index(per, [F.col("__name").asc_nulls_last()], "__i")
    per = per.withColumn("__kind", (F.col("__i") % len(schedules)).cast("int")).withColumn("__mass", mass)
    per = checkpointed(per.withColumn("__cap", F.col("__have") * max_epochs).drop("__i"))
    exact = F.col("__mass").cast("decimal(28,9)")
    total = per.agg(F.sum("__have")).first()[0] or 0
    level, full = 0.0, None
    while total:
        over = F.col("__mass") * F.lit(level) > F.col("__cap")
        n, used, free = per.agg(F.count_if(over), F.sum(F.when(over, F.col("__cap"))), F.sum(F.when(~over, exact))).first()
        if n == full or not free:
            break
        full, level = n, (total - int(used or 0)) / float(free)
    target = F.least(F.col("__mass") * F.lit(level), F.col("__cap").cast("double"))
    return per.select("__name", "__rows", "__have", "__kind", target.alias("__target"))


def assign(
    docs: DataFrame,
    schedules: Sequence[Schedule] = SCHEDULES,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] = ("doc_id",),
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The columns of ``keep``, size, source_size, target and plays of every row.

    size: words of the text (null: 0). source_size and target: words of the row's source and
    those that the mix takes of it. plays: one (epoch, words, position) for each time the
    document is played, in order; the last document of a source's demand is cut where the
    demand ends, so the words of a source sum to its target, rounded. A document without words
    has no plays. Nulls in the source make a source of their own; a null id has an order of
    its own. Rows that share an id follow each other by size. An empty table, or one without
    words, gives targets of 0. Columns outside ``keep`` are not read. Equal input gives equal
    plays, however it is partitioned.
    """
    keep = list(keep)
    if max_epochs < 1 or slice_rows < 1 or not schedules:
        raise ValueError("need a schedule, an epoch and a row to a slice")
    named = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col(f"`{id_col}`").cast("string").alias("__id"),
        F.col(f"`{source_col}`").cast("string").alias("__source"),
        F.col(f"`{text_col}`").alias("__body"),
    )
    rows = checkpointed(sized(named, text_col="__body", keep=[*keep, "__id", "__source"], name="__size"))
    per = source_targets(rows.select(F.col("__source").alias("__name"), "__size"), schedules, max_epochs)
    per = checkpointed(per.withColumn("__slices", F.ceil(F.col("__rows") / slice_rows).cast("long")))
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("__id", F.lit("null"))).cast("binary"))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    rows = rows.join(per, F.col("__source").eqNullSafe(F.col("__name"))).drop("__name").withColumn("__key", digest)
    rows = rows.withColumn("__slice", F.floor(at * F.col("__slices") / F.lit(float(1 << 32))).cast("long"))
    group = [F.col("__source"), F.col("__slice")]
    inside = W.partitionBy(*group).orderBy("__key", "__id", "__size").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = rows.groupBy(*group).agg(F.sum("__size").alias("__sum"))
    over = W.partitionBy("__source").orderBy("__slice").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = totals.select(
        F.col("__source").alias("__s"), F.col("__slice").alias("__k"), (F.sum("__sum").over(over) - F.col("__sum")).alias("__before")
    )
    rows = rows.withColumn("__run", F.sum("__size").over(inside) - F.col("__size"))
    rows = rows.join(totals, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__slice") == F.col("__k")))
    first = F.col("__before") + F.col("__run")
    wanted = F.round("__target").cast("long")

    def play(k: Column) -> Column:
        x = k * F.col("__have") + first
        share = F.try_divide(x, F.col("__target"))
        position = F.coalesce(*[F.when(F.col("__kind") == i, time_of(share, s)) for i, s in enumerate(schedules)])
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("__size"), wanted - x))
        return F.struct(k.cast("int").alias("epoch"), words.alias("words"), position.alias("position"))

    plays = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), play), lambda p: p["words"] > 0)
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.col("__size").alias("size"),
        F.col("__have").alias("source_size"),
        F.col("__target").alias("target"),
        plays.cast(PLAYS).alias("plays"),
    )


def training_order(assigned: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row (columns of ``keep``, epoch, words, position) for each play, range-sorted by
    position, then by the columns of ``keep`` and the epoch."""
    plays = assigned.select(*[F.col(f"`{c}`") for c in keep], F.inline("plays"))
    return plays.orderBy("position", *[F.col(f"`{c}`") for c in keep], "epoch")


def words_taken(plays: Column | str = "plays") -> Column:
    """Words of all plays of a document."""
    return F.aggregate(plays, F.lit(0).cast("long"), lambda n, p: n + p["words"])
