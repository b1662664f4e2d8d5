"""Exact quantiles with linear interpolation by radix selection.

``percentile`` in Spark merges a map of every distinct value into one final task, and a
sort moves every value. Here no value moves. The bits of a double, order-preserved (all
flipped if negative, else the sign bit), are four digits of 16 bits:

1. the values (with their keys or columns, and weight) are written once where they are;
2. a pass counts, in every task, the first digits of each key's values; the counts are
   summed, and the running sum over a key's digits tells for each wanted rank which digit
   its value has, and the rank among the values with that digit;
3. three more passes count the next digits of only the values that agree with a wanted
   value so far, and after the fourth the value of every wanted rank is known in full;
4. the ranks that the interpolation needs, ``floor(h)`` and ``floor(h)+1`` with
   ``h = (n-1)p``, are combined as NumPy does (``lerp``).

What is exchanged is counts: at most 65536 for each wanted rank and task, however many rows
a key has. The wanted ranks (keys x probabilities) travel with the tasks, so their number is
checked; with more than ``MAX_TARGETS`` the values are range-sorted instead (``ranked_values``).

The result equals pandas/NumPy ``quantile`` with linear interpolation bit for bit.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed


#: Wanted ranks (keys x probabilities x 2) that are sent to the tasks.
MAX_TARGETS = 20_000
DIGIT_BITS = 16
PASSES = 4


def to_long(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), name: str = "column_name") -> DataFrame:
    """Stack numeric ``columns`` into ``(keys..., column, value)``, nulls removed."""
    cells = F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())


def value_counts(long: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """``(keys, value, cnt)``; with ``weight``, rows already carry a count."""
    cnt = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    return long.groupBy(*keys, "value").agg(cnt.alias("cnt"))


def _bucket_count(df: DataFrame, buckets: int | None) -> int:
    if buckets:
        return buckets
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """Linear interpolation as NumPy computes it (so results equal pandas' linear
    quantile to the last bit): ``a + (b-a)t`` below one half, ``b - (b-a)(1-t)`` from it."""
    d = b - a
    return F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t)


def _targets(per_key: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``(keys, p, _h, _lo, _hi)``: the 0-based ranks linear interpolation reads,
    ``floor(h)`` and ``floor(h)+1`` with ``h = (n-1)p`` (one rank when ``h`` is whole)."""
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    h = (F.col("n") - 1).cast("double") * F.col("p")
    return (
        per_key.select(*keys, "n", F.explode(p_arr).alias("p"))
        .select(*keys, "p", h.alias("_h"))
        .withColumn("_lo", F.floor("_h").cast("bigint"))
        .withColumn("_hi", F.when(F.col("_h") > F.col("_lo"), F.col("_lo") + 1).otherwise(F.col("_lo")))
    )


def ranked_values(
    long: DataFrame,
    keys: Sequence[str],
    buckets: int | None = None,
    probs: Sequence[float] | None = None,
    weight: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Distinct values per key with their rank interval ``[rank_lo, rank_hi)`` in the
    sorted multiset, and the per-key totals ``(keys, n)``.

    Values are sorted by range partitioning; a range's totals and their running sum give
    the rank its values start at. With ``probs``, only the ranges holding a rank those
    quantiles read are ranked, about ``2 * len(probs)`` per key. ``buckets`` is the
    number of ranges (default: the session's shuffle partitions)."""
    keys = list(keys)
    # The only pass over the input: distinct values with counts, range-partitioned on
    # (keys, value), each row with its range. Everything after reads this table.
    b = _bucket_count(long, buckets)
    spread = value_counts(long, keys, weight).repartitionByRange(b, *keys, "value")
    vc = checkpointed(spread.withColumn("_bucket", F.spark_partition_id()))

    totals = vc.groupBy(*keys, "_bucket").agg(F.sum("cnt").alias("_btotal"))
    by_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    # Small frame (keys + ranges rows): a window over it is cheap.
    totals = totals.select(
        *keys,
        "_bucket",
        "_btotal",
        (F.sum("_btotal").over(by_key.orderBy("_bucket")) - F.col("_btotal")).alias("_offset"),
        F.sum("_btotal").over(by_key).alias("n"),
    )
    per_key = totals.select(*keys, "n").distinct()
    if probs is not None:
        t, bt = _targets(per_key, keys, probs).alias("t"), totals.alias("b")
        cond = [F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys] + [
            F.col("b._offset") <= F.col("t._hi"),
            F.col("t._lo") < F.col("b._offset") + F.col("b._btotal"),
        ]
        needed = t.join(bt, cond).select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b._bucket")).distinct()
        vc = vc.join(needed, [*keys, "_bucket"], "left_semi")
    in_bucket = W.partitionBy(*keys, "_bucket").orderBy("value").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = vc.withColumn("_run", F.sum("cnt").over(in_bucket)).join(
        totals.select(*keys, "_bucket", "_offset"), [*keys, "_bucket"]
    )
    ranked = ranked.select(
        *keys,
        "value",
        (F.col("_offset") + F.col("_run") - F.col("cnt")).alias("rank_lo"),
        (F.col("_offset") + F.col("_run")).alias("rank_hi"),
    )
    return ranked, per_key


def order_bits(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles; -0 counts as 0, NaN as the greatest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits.view(np.uint64) ^ np.where(bits < 0, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1 << 63))


def from_order_bits(bits: np.ndarray) -> np.ndarray:
    """The doubles of ``order_bits``."""
    bits = np.asarray(bits, np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(bits & sign, bits ^ sign, ~bits).view(np.float64)


def _digit_counts(spool: DataFrame, n_columns: int, wanted: tuple[np.ndarray, np.ndarray], done: int) -> DataFrame:
    """(target, digit, n): for each wanted (group, leading digits), ascending, the weight of
    the group's values with those digits, by their next digit.

    ``spool`` has (__group, __weight, then ``n_columns`` columns of doubles); the values of
    column j belong to group ``__group * n_columns + j``."""
    shared = spool.sparkSession.sparkContext.broadcast(wanted)
    shift = np.uint64(64 - DIGIT_BITS * (done + 1))

    def run(batches):
        groups, prefixes = shared.value
        heads = np.unique(prefixes)
        # one number for a group and its leading digits, ascending as the targets are
        targets = groups * np.int64(len(heads) + 1) + np.searchsorted(heads, prefixes)
        held, size = [], 0

        def summed():
            key = np.concatenate([k for k, _ in held])
            n = np.concatenate([n for _, n in held])
            key, at = np.unique(key, return_inverse=True)
            return key, np.bincount(at, n, len(key)).astype(np.int64)

        def batch_of(key, n):
            return pa.RecordBatch.from_arrays(
                [pa.array(key >> DIGIT_BITS), pa.array((key & 0xFFFF).astype(np.int32)), pa.array(n)], ["target", "digit", "n"]
            )

        for batch in batches:
            base = batch.column(0).to_numpy()
            weight = batch.column(1).to_numpy()
            for j in range(n_columns):
                column = batch.column(2 + j)
                valid = column.is_valid().to_numpy(zero_copy_only=False)
                group = base[valid] * n_columns + j
                digits = order_bits(column.drop_null().to_numpy()) >> shift
                prefix = digits >> np.uint64(DIGIT_BITS) if done else np.zeros(len(digits), np.uint64)
                w = weight[valid]
                head = np.searchsorted(heads, prefix)
                number = group * np.int64(len(heads) + 1) + np.minimum(head, len(heads) - 1)
                at = np.minimum(np.searchsorted(targets, number), len(targets) - 1)
                hit = (targets[at] == number) & (heads[np.minimum(head, len(heads) - 1)] == prefix)
                key = at[hit].astype(np.int64) << DIGIT_BITS | (digits[hit] & np.uint64(0xFFFF)).astype(np.int64)
                if len(key):
                    key, inverse = np.unique(key, return_inverse=True)
                    held.append((key, np.bincount(inverse, w[hit], len(key)).astype(np.int64)))
                    size += len(key)
            if size > 4_000_000:
                key, n = summed()
                held, size = [(key, n)], len(key)
                if size > 2_000_000:  # still many: hand them on, Spark sums them
                    yield batch_of(key, n)
                    held, size = [], 0
        if held:
            yield batch_of(*summed())

    counts = spool.mapInArrow(run, "target long, digit int, n long")
    return counts.groupBy("target", "digit").agg(F.sum("n").alias("n"))


def _select_ranks(spool: DataFrame, n_columns: int, groups: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The value of each wanted (group, 0-based rank)."""
    prefix = np.zeros(len(groups), np.uint64)
    left = ranks.copy()
    spark = spool.sparkSession
    for done in range(PASSES):
        pairs = np.stack([groups.astype(np.uint64), prefix])
        distinct, of = np.unique(pairs, axis=1, return_inverse=True)
        counts = _digit_counts(spool, n_columns, (distinct[0].astype(np.int64), distinct[1]), done)
        ask = spark.createDataFrame(
            pa.table({"i": np.arange(len(of)), "target": of.astype(np.int64), "rank": left})
        )  # at most MAX_TARGETS rows
        run = W.partitionBy("target").orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)
        counts = counts.withColumn("upto", F.sum("n").over(run))
        inside = (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))
        hit = counts.join(F.broadcast(ask), "target").where(inside).select("i", "digit", (F.col("upto") - F.col("n")).alias("before"))
        found = hit.toArrow().sort_by("i")
        prefix = prefix << np.uint64(DIGIT_BITS) | found.column("digit").to_numpy().astype(np.uint64)
        left = left - found.column("before").to_numpy()
    return from_order_bits(prefix)


def _radix_quantiles(spool: DataFrame, n_columns: int, totals: dict[int, int], probs: Sequence[float]) -> list[tuple]:
    """(group, p, h, value at floor(h), value at the next rank) of every group and p."""
    rows = [(g, float(p), (n - 1) * float(p)) for g, n in totals.items() for p in probs]
    if not rows:
        return []
    lo = np.array([int(h) for _, _, h in rows])
    hi = np.array([int(h) + (h > int(h)) for _, _, h in rows])
    group = np.array([g for g, _, _ in rows])
    found = _select_ranks(spool, n_columns, np.concatenate([group, group]), np.concatenate([lo, hi]))
    return [(g, p, h, float(a), float(b)) for (g, p, h), a, b in zip(rows, found[: len(rows)], found[len(rows) :])]


def _interpolated(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys..., p, q)`` of rows ``(keys..., p, _h, _a, _b)``."""
    t = F.col("_h") - F.floor("_h").cast("double")
    return df.select(*keys, "p", lerp(F.col("_a"), F.col("_b"), t).alias("q"))


def quantiles(
    long: DataFrame,
    probs: Sequence[float],
    keys: Sequence[str] = (),
    weight: str | None = None,
    max_targets: int = MAX_TARGETS,
    written: bool = False,
) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per ``keys``:
    rows ``(keys..., p, q)`` for every key with at least one value. ``weight``
    names a column of row multiplicities (input already reduced to value counts).
    A null key is a key like any other; rows without value or of weight 0 count for nothing.

    Radix selection while the wanted ranks number at most ``max_targets``, else by sorting.
    ``written`` says that ``long`` is a checkpoint, which is not written again."""
    keys, weights = list(keys), F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    value = F.col("value").cast("double")
    spool = long.select(*keys, weights.alias("__weight"), value.alias("value"))
    spool = spool.where(F.col("value").isNotNull() & (F.col("__weight") > 0))
    spool = spool if written else checkpointed(spool)
    totals = checkpointed(spool.groupBy(*keys).agg(F.sum("__weight").alias("n")).where("n > 0"))
    if totals.count() * len(probs) * 2 > max_targets:
        return _sorted_quantiles(spool, probs, keys, "__weight")
    # At most max_targets groups: numbered in one task and sent to all.
    numbered = totals.withColumn("__group", F.row_number().over(W.orderBy(*keys) if keys else W.orderBy(F.lit(0))).cast("bigint") - 1)
    numbered = checkpointed(numbered)
    if keys:
        on = None
        for k in keys:
            same = F.col(f"s.{k}").eqNullSafe(F.col(f"g.{k}"))
            on = same if on is None else on & same
        spool = spool.alias("s").join(F.broadcast(numbered.alias("g")), on)
        spool = spool.select("g.__group", "s.__weight", "s.value")
    else:
        spool = spool.select(F.lit(0).cast("bigint").alias("__group"), "__weight", "value")
    found = _radix_quantiles(spool, 1, {r["__group"]: r["n"] for r in numbered.collect()}, probs)
    rows = long.sparkSession.createDataFrame(found, "__group bigint, p double, _h double, _a double, _b double")
    return _interpolated(rows.join(numbered.drop("n"), "__group"), keys)


def spooled(df: DataFrame, columns: Sequence[str], weight: str | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Numeric columns side by side, as ``spooled_quantiles`` reads them, written once;
    ``extra`` columns follow."""
    weights = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    cells = [F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]
    return checkpointed(df.select(F.lit(0).cast("bigint").alias("__group"), weights.alias("__weight"), *cells, *extra))


def spooled_quantiles(
    spool: DataFrame, columns: Sequence[str], probs: Sequence[float], totals: Sequence[int | None] | None = None
) -> DataFrame:
    """``(column_name, p, q)`` from a spool of the columns; ``totals`` may give each column's
    weight of values, where it is known already."""
    names = [f"c{j}" for j in range(len(columns))]
    spool = spool.select("__group", "__weight", *names).where("__weight > 0")
    if totals is None:
        totals = tuple(spool.agg(*[F.sum(F.when(F.col(c).isNotNull(), F.col("__weight"))) for c in names]).first())
    found = _radix_quantiles(spool, len(names), {j: int(n) for j, n in enumerate(totals) if n}, probs)
    named = [(columns[j], *rest) for j, *rest in found]
    rows = spool.sparkSession.createDataFrame(named, "column_name string, p double, _h double, _a double, _b double")
    return _interpolated(rows, ["column_name"])


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    weight: str | None = None,
) -> DataFrame:
    """Quantiles of several numeric columns at once: ``(column_name, p, q)``. The columns stay
    side by side; no row is multiplied by their number."""
    return spooled_quantiles(spooled(df, columns, weight), list(columns), probs)


def _sorted_quantiles(long: DataFrame, probs: Sequence[float], keys: list[str], weight: str, buckets: int | None = None) -> DataFrame:
    """``quantiles`` by range-sorting the distinct values, for any number of keys: the two
    order statistics per (key, p) are found by one join of the ranked values with the
    target table on the keys plus a rank-range condition, and combined by one aggregate."""
    ranked, per_key = ranked_values(long, keys, buckets, probs, weight)
    targets = _targets(per_key, keys, probs).alias("t")
    r = ranked.alias("r")
    cond = [F.col(f"t.{k}") == F.col(f"r.{k}") for k in keys] + [
        F.col("r.rank_lo") <= F.col("t._hi"),
        F.col("t._lo") < F.col("r.rank_hi"),
    ]
    rlo, rhi, value = F.col("r.rank_lo"), F.col("r.rank_hi"), F.col("r.value")
    lo, hi = F.col("t._lo"), F.col("t._hi")
    group = [F.col(f"t.{k}").alias(k) for k in keys] + [F.col(f"t.{c}").alias(c) for c in ("p", "_h", "_lo")]
    hits = targets.join(r, cond).groupBy(*group).agg(
        F.max(F.when((rlo <= lo) & (lo < rhi), value)).alias("_a"),
        F.max(F.when((rlo <= hi) & (hi < rhi), value)).alias("_b"),
    )
    t = F.col("_h") - F.col("_lo").cast("double")
    return hits.select(*keys, "p", lerp(F.col("_a"), F.col("_b"), t).alias("q"))


def approx_column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = 10000
) -> DataFrame:
    """Bounded-memory alternative (``percentile_approx``), one aggregate."""
    long = to_long(df, columns)
    agg = long.groupBy("column_name").agg(F.percentile_approx("value", list(probs), accuracy).alias("_qs"))
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    return agg.select("column_name", F.inline(F.arrays_zip(p_arr.alias("p"), F.col("_qs").alias("q"))))


def pivot_probs(q: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """``(keys, p, q)`` -> one row per key with a column per probability."""
    aggs: list[Column] = [F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n) for p, n in names.items()]
    return q.groupBy(*keys).agg(*aggs)
