"""Exact k-nearest-neighbour imputation (O-29, O-30) without an all-pairs join.

Semantics (as the common KNN imputer defines them): for a row missing column c,
donors are rows with c present; the distance to a donor is the Euclidean distance
over the coordinates present in both, scaled by sqrt(n_columns / n_common); the
imputed value is the plain mean of c over the k nearest donors with a defined
distance (fewer if fewer exist); with no defined distance at all, the column mean.
Ties at the k-th distance are broken by the donor's values (nulls first).

Plan:

* rows collapse to distinct vectors with their multiplicity (a product repeated
  on a million sales rows is one donor row with weight 10^6);
* the donors of each null pattern are split by a tree of medians (of a sample of bounded
  size) into leaves of about ``LEAF`` vectors; a leaf's box and weight are taken from all
  its donors. The table of leaves is bounded (``MAX_LEAVES``) and sent to the tasks;
* every (incomplete vector, missing column) is a task. A box bounds the distance to its
  donors from below and above, over the coordinates that the task has in common with the
  leaf's pattern. The leaf of the least lower bound is searched first; its k-th distance,
  or the upper bounds of the nearest boxes with k donors, limits the search;
* then all leaves whose lower bound is within the limit are searched, no others. Two passes,
  exact for any data: no donor outside them can be among the nearest k;
* leaves with many donors or many visitors are searched in slices by several tasks, and each
  returns the nearest k of its slice.

Nothing is joined but visitors and donors of the same leaf, and no cell spans the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

K_NEIGHBOURS = 5
LEAF = 512  # distinct donor vectors of a leaf, about
MAX_LEAVES = 1 << 14
SAMPLE = 1 << 17  # donors that the medians are taken from, at most about
SLICE = 4096  # donors and visitors of a leaf that meet in one task, about
_ROUNDING = 1e-12


def median_tree(x: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """Splits (dimension, value) of a tree of ``depth`` levels in breadth-first order: the
    widest dimension at its median; (-1, 0) where nothing can be split."""
    splits, level = [], [x]
    for _ in range(depth):
        following = []
        for part in level:
            dim, cut = -1, 0.0
            if len(part) > 1:
                spread = part.max(axis=0) - part.min(axis=0)
                dim = int(spread.argmax())
                cut = float(np.median(part[:, dim]))
                if not spread[dim] > 0:
                    dim, cut = -1, 0.0
            low = part[:, dim] < cut if dim >= 0 else np.ones(len(part), bool)
            splits.append((dim, cut))
            following += [part[low], part[~low]]
        level = following
    return splits


def tree_leaves(x: np.ndarray, splits: list[tuple[int, float]], depth: int) -> np.ndarray:
    """Leaf number (0 to 2^depth - 1) of every row."""
    node = np.zeros(len(x), np.int64)
    dims, cuts = np.array([d for d, _ in splits] or [-1]), np.array([c for _, c in splits] or [0.0])
    for _ in range(depth):
        dim = dims[node]
        right = (dim >= 0) & (x[np.arange(len(x)), np.maximum(dim, 0)] >= cuts[node])
        node = 2 * node + 1 + right
    return node - (2**depth - 1)


def _values(batch, names: Sequence[str]) -> np.ndarray:
    """(rows, columns) doubles of the named columns, NaN for null."""
    return np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names], axis=1)


def _grown(donors: DataFrame, m: int, sizes: dict[int, int], leaf: int) -> dict[int, tuple]:
    """For each null pattern (dimensions, splits, depth, number of its first leaf)."""
    total = sum(sizes.values())
    names = [f"_v{j}" for j in range(m)]
    share = min(1.0, SAMPLE / max(1, total))
    some = donors.where(F.pmod(F.xxhash64(*names), F.lit(1 << 20)) < int(share * (1 << 20))).toArrow() if share < 1 else donors.toArrow()
    x = _values(some, names)
    pattern = some.column("_pat").to_numpy()
    trees, first = {}, 0
    for p, n in sorted(sizes.items()):
        dims = [j for j in range(m) if p >> j & 1]
        room = max(1, MAX_LEAVES * n // max(1, total))
        depth = 0
        while 2 ** (depth + 1) <= room and n > leaf << depth:
            depth += 1
        trees[p] = (dims, median_tree(x[pattern == p][:, dims], depth), depth, first)
        first += 2**depth
    return trees


class _Leaves:
    """Boxes, weights and null patterns of the leaves, with the distance bounds to them."""

    def __init__(self, rows: list, m: int, k: int):
        self.m, self.k = m, k
        self.leaf = np.array([r["leaf"] for r in rows], np.int64)
        self.pattern = np.array([r["_pat"] for r in rows], np.int64)
        self.weight = np.array([r["weight"] for r in rows], np.int64)
        at = lambda r, x: np.nan if r[x] is None else r[x]
        self.low = np.array([[at(r, f"lo{j}") for j in range(m)] for r in rows]).reshape(-1, m)
        self.high = np.array([[at(r, f"hi{j}") for j in range(m)] for r in rows]).reshape(-1, m)

    def bounds(self, x: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, leaves) least and greatest distance of any donor; infinite where a leaf has no
        ``target`` or nothing in common."""
        least, most = np.zeros((len(x), len(self.leaf))), np.zeros((len(x), len(self.leaf)))
        common = np.zeros((len(x), len(self.leaf)), np.int64)
        for j in range(self.m):
            r = x[:, j, None]
            both = ~np.isnan(r) & ~np.isnan(self.low[:, j])
            out = np.where(both, np.maximum(np.maximum(self.low[:, j] - r, r - self.high[:, j]), 0.0), 0.0)
            far = np.where(both, np.maximum(np.abs(r - self.low[:, j]), np.abs(r - self.high[:, j])), 0.0)
            least += out * out
            most += far * far
            common += both
        usable = (common > 0) & ((self.pattern >> target & 1) == 1)
        scale = self.m / np.maximum(common, 1)
        inf = np.float64(np.inf)
        return np.where(usable, np.sqrt(scale * least), inf), np.where(usable, np.sqrt(scale * most), inf)

    def first(self, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The leaf to search first, by place: the least lower bound, ties by the upper one."""
        near = least == least.min(axis=1, keepdims=True)
        return np.where(near, most, np.inf).argmin(axis=1)

    def limit(self, most: np.ndarray) -> np.ndarray:
        """A distance within which k donors are known to lie (infinite if there are fewer)."""
        order = np.argsort(most, axis=1, kind="stable")
        far = np.take_along_axis(most, order, 1)
        weight = np.where(np.isfinite(far), self.weight[order], 0).cumsum(axis=1)
        enough = weight >= self.k
        at = enough.argmax(axis=1)
        return np.where(enough.any(axis=1), far[np.arange(len(far)), at], np.inf)


def _visits(tasks: DataFrame, shared, m: int, again: bool) -> DataFrame:
    """(_rid, _t, _pat, _r0.., leaf) of the leaf that a task searches first; or, ``again``, of
    all others within its limit (column _limit: the k-th distance that the first one gave)."""
    names = [f"_r{j}" for j in range(m)]
    kept = ["_rid", "_t", "_pat", *names]

    def run(batches):
        leaves = shared.value
        block = max(1, 2_000_000 // max(1, len(leaves.leaf)))
        for batch in batches:
            targets = batch.column("_t").to_numpy()
            for t in np.unique(targets):
                rows = np.flatnonzero(targets == t)
                for a in range(0, len(rows), block):
                    some = rows[a : a + block]
                    part = batch.take(pa.array(some))
                    least, most = leaves.bounds(_values(part, names), int(t))
                    reached = np.isfinite(least).any(axis=1)
                    first = leaves.first(least, most)
                    if again:
                        limit = np.minimum(leaves.limit(most), part.column("_limit").fill_null(np.inf).to_numpy(zero_copy_only=False))
                        go = (least * (1 - _ROUNDING) <= limit[:, None] * (1 + _ROUNDING)) & np.isfinite(least)
                        go[np.arange(len(some)), first] = False
                        row, at = np.nonzero(go)
                    else:
                        row, at = np.flatnonzero(reached), first[reached]
                    out = part.select(kept).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(leaves.leaf[at])], [*kept, "leaf"])

    ddl = "_rid bigint, _t int, _pat int, " + ", ".join(f"{n} double" for n in names) + ", leaf bigint"
    return tasks.mapInArrow(run, ddl)


def _nearest(visits: DataFrame, placed: DataFrame, sizes: DataFrame, m: int, k: int) -> DataFrame:
    """(_rid, _t, dist, mult, val, d0..): of every leaf visited, the nearest donors with a
    weight of k in all (ties by the donor's values, nulls first), per slice of the leaf."""
    visitors = visits.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("rs"))
    slices = sizes.join(visitors, "leaf")  # a row per leaf
    left = visits.join(slices, "leaf").withColumn("r", F.pmod(F.xxhash64("_rid", "_t"), F.col("rs")).cast("int"))
    left = left.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("ds") - 1))).drop("rs", "ds")
    names = [f"_v{j}" for j in range(m)]
    right = placed.join(slices, "leaf").withColumn("d", F.pmod(F.xxhash64(*names), F.col("ds")).cast("int"))
    right = right.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rs") - 1))).drop("rs", "ds")

    def search(visit, donor):
        out = []
        if visit.num_rows and donor.num_rows:
            y, weight = _values(donor, names), donor.column("mult").to_numpy()
            ties = np.where(np.isnan(y), -np.inf, y)
            order = np.lexsort(ties.T[::-1])  # by the donors' values; a stable sort keeps it
            y, weight = y[order], weight[order]
            x, rid, target = _values(visit, [f"_r{j}" for j in range(m)]), visit.column("_rid").to_numpy(), visit.column("_t").to_numpy()
            for a in range(0, len(x), max(1, 500_000 // len(y))):
                b = min(len(x), a + max(1, 500_000 // len(y)))
                total, common = np.zeros((b - a, len(y))), np.zeros((b - a, len(y)), np.int64)
                for j in range(m):
                    gap = x[a:b, j, None] - y[:, j]
                    both = ~np.isnan(gap)
                    total += np.where(both, gap * gap, 0.0)
                    common += both
                usable = (common > 0) & ~np.isnan(y[:, target[a:b]].T)
                dist = np.where(usable, np.sqrt(float(m) / np.maximum(common, 1) * total), np.inf)
                near = np.argsort(dist, axis=1, kind="stable")[:, : max(1, k)]
                d = np.take_along_axis(dist, near, 1)
                before = np.cumsum(weight[near], axis=1) - weight[near]
                row, col = np.nonzero(np.isfinite(d) & (before < k))
                at = near[row, col]
                out.append((rid[a:b][row], target[a:b][row], d[row, col], weight[at], y[at]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int64), np.zeros((0, m))]
        arrays = [pa.array(parts[0]), pa.array(parts[1], pa.int32()), pa.array(parts[2]), pa.array(parts[3])]
        arrays += [pa.array(parts[4][:, j], mask=np.isnan(parts[4][:, j])) for j in range(m)]
        return pa.table(arrays, ["_rid", "_t", "dist", "mult", *[f"d{j}" for j in range(m)]])

    ddl = "_rid bigint, _t int, dist double, mult bigint, " + ", ".join(f"d{j} double" for j in range(m))
    keys = ["leaf", "d", "r"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, ddl)


def knn_impute(
    df: DataFrame, columns: Sequence[str], k: int = K_NEIGHBOURS, weight: str | None = None, leaf: int = LEAF
) -> DataFrame:
    """``df`` with nulls in ``columns`` replaced by the k-NN estimate. ``weight`` names a
    column of row multiplicities (each copy is a donor)."""
    cols = list(columns)
    m = len(cols)
    full = 2**m - 1
    v = [F.col(f"_v{j}") for j in range(m)]
    pattern = sum((F.when(v[j].isNotNull(), 1 << j).otherwise(0) for j in range(m)), F.lit(0))

    # Distinct vectors with multiplicity: the donor table and the receiver table.
    copies = F.sum(weight).cast("bigint") if weight else F.count(F.lit(1))
    vecs = df.select(*([weight] if weight else []), *[F.col(c).cast("double").alias(f"_v{j}") for j, c in enumerate(cols)])
    donors = checkpointed(vecs.groupBy(*[f"_v{j}" for j in range(m)]).agg(copies.alias("mult")))
    donors = donors.withColumn("_pat", pattern)

    means = [F.sum(v[j] * F.col("mult")) / F.sum(F.when(v[j].isNotNull(), F.col("mult"))) for j in range(m)]
    stats = donors.agg(*[c.alias(f"mean{j}") for j, c in enumerate(means)]).first()  # one row: column means

    receivers = donors.where(F.col("_pat") != full).select(*[f"_v{j}" for j in range(m)], "_pat")
    receivers = checkpointed(receivers.withColumn("_rid", F.monotonically_increasing_id()))
    missing = F.array(*[F.when(v[j].isNull(), F.lit(j)) for j in range(m)])
    tasks = receivers.select(
        "_rid",
        F.explode(F.filter(missing, lambda x: x.isNotNull())).alias("_t"),
        F.col("_pat").cast("int").alias("_pat"),
        *[v[j].alias(f"_r{j}") for j in range(m)],
    )

    sizes = {r["_pat"]: r["n"] for r in donors.where("_pat > 0").groupBy("_pat").agg(F.count(F.lit(1)).alias("n")).collect()}
    trees = _grown(donors.where("_pat > 0"), m, sizes, leaf)  # at most MAX_LEAVES and a leaf per pattern
    shared_trees = df.sparkSession.sparkContext.broadcast(trees)
    names = [f"_v{j}" for j in range(m)]

    def place(batches):
        for batch in batches:
            x, pattern = _values(batch, names), batch.column("_pat").to_numpy()
            at = np.zeros(len(x), np.int64)
            for p in np.unique(pattern):
                dims, splits, depth, first = shared_trees.value[int(p)]
                rows = np.flatnonzero(pattern == p)
                at[rows] = first + tree_leaves(x[rows][:, dims], splits, depth)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "leaf"])

    ddl = ", ".join(f"{n} double" for n in names)
    present = donors.where("_pat > 0").select(*names, "mult", F.col("_pat").cast("int").alias("_pat"))
    placed = checkpointed(present.mapInArrow(place, f"{ddl}, mult bigint, _pat int, leaf bigint"))
    boxes = placed.groupBy("leaf", "_pat").agg(
        F.sum("mult").alias("weight"),
        F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("ds"),
        *[F.min(v[j]).alias(f"lo{j}") for j in range(m)],
        *[F.max(v[j]).alias(f"hi{j}") for j in range(m)],
    )
    boxes = checkpointed(boxes)
    rows = boxes.collect()
    order = [F.col("dist")] + [F.col(f"d{j}").asc_nulls_first() for j in range(m)]
    run = W.partitionBy("_rid", "_t").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    if rows:
        shared = df.sparkSession.sparkContext.broadcast(_Leaves(rows, m, k))
        slices = boxes.select("leaf", "ds")
        one = checkpointed(_nearest(_visits(tasks, shared, m, again=False), placed, slices, m, k))
        # at most k rows for each (task, slice of its leaf)
        kth = one.withColumn("_cum", F.sum("mult").over(run)).where(F.col("_cum") >= k).groupBy("_rid", "_t").agg(F.min("dist").alias("_limit"))
        limited = tasks.join(kth, ["_rid", "_t"], "left")
        two = _nearest(_visits(limited, shared, m, again=True), placed, slices, m, k)
        ranked = one.unionAll(two).withColumn("_before", F.sum("mult").over(run) - F.col("mult"))
        take = F.greatest(F.least(F.col("mult"), F.lit(k) - F.col("_before")), F.lit(0))
        value = F.element_at(F.array(*[F.col(f"d{j}") for j in range(m)]), F.col("_t") + 1)
        solved = ranked.where(F.col("_before") < k).groupBy("_rid", "_t").agg((F.sum(take * value) / F.sum(take)).alias("_imp"))
    else:
        solved = df.sparkSession.createDataFrame([], "_rid bigint, _t int, _imp double")
    means = F.array(*[F.lit(stats[f"mean{j}"]).cast("double") for j in range(m)])
    per_task = tasks.select("_rid", "_t").join(solved, ["_rid", "_t"], "left").select(
        "_rid", "_t", F.coalesce(F.col("_imp"), F.element_at(means, F.col("_t") + 1)).alias("_imp")
    )
    wide = per_task.groupBy("_rid").agg(
        *[F.max(F.when(F.col("_t") == j, F.col("_imp"))).alias(f"_i{j}") for j in range(m)]
    )
    imputed = receivers.join(wide, "_rid").select(
        *[F.col(f"_v{j}").alias(f"_k{j}") for j in range(m)],
        *[F.coalesce(F.col(f"_v{j}"), F.col(f"_i{j}")).alias(f"_n{j}") for j in range(m)],
    )
    # O-30: assign back by the vector itself (null-safe), not by row position.
    cond = None
    for j, c in enumerate(cols):
        e = df[c].cast("double").eqNullSafe(imputed[f"_k{j}"])
        cond = e if cond is None else cond & e
    joined = df.join(imputed, cond, "left")
    out = [
        F.coalesce(F.col(f"_n{cols.index(c)}"), F.col(c).cast("double")).alias(c) if c in cols else F.col(c)
        for c in df.columns
    ]
    return joined.select(*out)
