"""Profiling and descriptive statistics: O-02, O-18, O-19, O-22..28, O-47..51.

Each function returns a small DataFrame (one row per column, bin or group); the
work is aggregates that combine map-side, so nothing passes whole through one
task or the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpointed
from . import quantiles as Q

# Fixed defaults of the source: IQR limits at 25/75 for capping, 20/80 for the
# outlier check, 1.5 IQR, profile quantiles, histogram bins, density grid points.
IQR_FACTOR = 1.5
CAP_QUANTILES = (0.25, 0.75)
CHECK_QUANTILES = (0.20, 0.80)
PROFILE_QUANTILES = (0.0, 0.05, 0.50, 0.95, 0.99, 1.0)
HIST_BINS = 30
KDE_GRID = 200

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def _unpivot(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One wide row with ``<col>__<field>`` -> one row per column."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}__{f}").alias(f) for f in fields]) for c in columns
    ]
    return row.select(F.inline(F.array(*structs)))


# ---------------------------------------------------------------- previews


def preview(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """O-02: first ``n`` and last ``n`` rows in ``order_by`` order (Spark rows have
    no inherent order, so the key is explicit), tagged ``part`` = head / tail.
    Each side is a distributed top-k (TakeOrderedAndProject)."""
    head = df.orderBy(*[F.col(c).asc_nulls_first() for c in order_by]).limit(n)
    tail = df.orderBy(*[F.col(c).desc_nulls_last() for c in order_by]).limit(n)
    return head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))


# ---------------------------------------------------------------- outliers


def outlier_limits(
    df: DataFrame,
    columns: Sequence[str],
    lower_q: float = CAP_QUANTILES[0],
    upper_q: float = CAP_QUANTILES[1],
    exact: bool = True,
    wide: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """O-19: ``low = q1 - 1.5 IQR``, ``up = q3 + 1.5 IQR`` per column (linear
    quantiles). Long ``(column_name, q1, q3, iqr, low_limit, up_limit)``, or one wide row
    with ``<col>__low`` / ``<col>__up`` when ``wide``. ``weight`` (exact limits only) names a column of
    row multiplicities."""
    probs = [lower_q, upper_q]
    if weight and not exact:
        raise ValueError("weights need exact quantiles")
    if exact:
        qs = Q.column_quantiles(df, columns, probs, weight=weight)
    else:
        qs = Q.approx_column_quantiles(df, columns, probs)
    long = _iqr_limits(qs, lower_q, upper_q)
    if not wide:
        return long
    aggs: list[Column] = []
    for c in columns:
        aggs.append(F.max(F.when(F.col("column_name") == c, F.col("low_limit"))).alias(f"{c}__low"))
        aggs.append(F.max(F.when(F.col("column_name") == c, F.col("up_limit"))).alias(f"{c}__up"))
    return long.agg(*aggs)


def _iqr_limits(qs: DataFrame, lower_q: float, upper_q: float) -> DataFrame:
    """``(column_name, p, q)`` -> ``(column_name, q1, q3, iqr, low_limit, up_limit)``."""
    p = Q.pivot_probs(qs, ["column_name"], {lower_q: "q1", upper_q: "q3"})
    iqr = F.col("q3") - F.col("q1")
    return p.select(
        "column_name",
        "q1",
        "q3",
        iqr.alias("iqr"),
        (F.col("q1") - IQR_FACTOR * iqr).alias("low_limit"),
        (F.col("q3") + IQR_FACTOR * iqr).alias("up_limit"),
    )


def outlier_check(
    df: DataFrame,
    columns: Sequence[str],
    lower_q: float = CHECK_QUANTILES[0],
    upper_q: float = CHECK_QUANTILES[1],
    exact: bool = True,
    weight: str | None = None,
) -> DataFrame:
    """O-18: does any value lie outside the limits (20/80 by default)?
    ``(column_name, low_limit, up_limit, n_outliers, has_outlier)``.

    Exact: one pass over ``df`` into materialised ``(column, value, count)`` rows;
    the limits and the outlier counts both read that table. Approximate: the limits
    are one scalar-subquery row and the counts one aggregate pass over ``df``."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, low_limit double, up_limit double, "
                                               "n_outliers bigint, has_outlier boolean")
    if exact:
        long = Q.to_long(df, columns, [weight] if weight else ())
        vc = checkpointed(Q.value_counts(long, ["column_name"], weight))
        qs = Q.quantiles(vc, [lower_q, upper_q], keys=["column_name"], weight="cnt", written=True)
        lim = _iqr_limits(qs, lower_q, upper_q).select("column_name", "low_limit", "up_limit")
        v = F.col("value")
        outside = (v > F.col("up_limit")) | (v < F.col("low_limit"))
        # One row per column: a proven bound, safe to broadcast.
        counts = vc.join(F.broadcast(lim), "column_name").groupBy("column_name").agg(
            F.sum(F.when(outside, F.col("cnt")).otherwise(F.lit(0).cast("bigint"))).alias("n_outliers")
        )
        # Every requested column gets a row, also one without values (null limits, 0).
        names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
        out = names.join(lim, "column_name", "left").join(counts, "column_name", "left").select(
            "column_name",
            "low_limit",
            "up_limit",
            F.coalesce(F.col("n_outliers"), F.lit(0).cast("bigint")).alias("n_outliers"),
        )
        return out.withColumn("has_outlier", F.col("n_outliers") > 0)
    lim = outlier_limits(df, columns, lower_q, upper_q, exact=exact, wide=True, weight=weight)
    s = lim.select(F.struct(*[F.col(c) for c in lim.columns]).alias("s")).scalar()
    counts = df.agg(
        *[
            F.count_if((F.col(c) > s[f"{c}__up"]) | (F.col(c) < s[f"{c}__low"])).alias(f"{c}__n_outliers")
            for c in columns
        ],
        *[s[f"{c}__low"].alias(f"{c}__low_limit") for c in columns],
        *[s[f"{c}__up"].alias(f"{c}__up_limit") for c in columns],
    )
    out = _unpivot(counts, columns, ["low_limit", "up_limit", "n_outliers"])
    return out.withColumn("has_outlier", F.col("n_outliers") > 0)


# ---------------------------------------------------------------- column classes


def column_classes(df: DataFrame, cat_th: int = 10, car_th: int = 20) -> DataFrame:
    """O-22: classify columns as the source's helper does.

    string -> categorical, unless it has more than ``car_th`` distinct values
    (cardinal); numeric with fewer than ``cat_th`` distinct values -> categorical
    (``num_but_cat``); other numeric -> numeric; anything else -> other.
    Distinct counts ignore nulls and come from one aggregate.
    """
    fields = df.schema.fields
    counts = df.agg(*[F.count_distinct(F.col(f.name)).alias(f"{f.name}__n_unique") for f in fields])
    rows = []
    for f in fields:
        kind = (
            "string"
            if isinstance(f.dataType, T.StringType)
            else "numeric"
            if isinstance(f.dataType, NUMERIC)
            else "other"
        )
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("dtype"),
                F.lit(kind).alias("_kind"),
                F.col(f"{f.name}__n_unique").alias("n_unique"),
            )
        )
    out = counts.select(F.inline(F.array(*rows)))
    n, kind = F.col("n_unique"), F.col("_kind")
    cls = (
        F.when((kind == "string") & (n > car_th), "cardinal")
        .when(kind == "string", "categorical")
        .when((kind == "numeric") & (n < cat_th), "categorical")
        .when(kind == "numeric", "numeric")
        .otherwise("other")
    )
    return out.select(
        "column_name",
        "dtype",
        "n_unique",
        cls.alias("class"),
        ((kind == "numeric") & (n < cat_th)).alias("num_but_cat"),
    )


def class_lists(classes: DataFrame) -> dict[str, list[str]]:
    """Small metadata (one row per column) as the three lists of the source."""
    rows = classes.collect()
    return {
        "cat_cols": [r["column_name"] for r in rows if r["class"] == "categorical"],
        "num_cols": [r["column_name"] for r in rows if r["class"] == "numeric"],
        "cat_but_car": [r["column_name"] for r in rows if r["class"] == "cardinal"],
    }


def column_class_summary(df: DataFrame, cat_th: int = 10, car_th: int = 20) -> DataFrame:
    """O-23: observations, variables and the sizes of the four lists."""
    classes = column_classes(df, cat_th, car_th)
    n_rows = df.select(F.count(F.lit(1))).scalar()
    return classes.agg(
        n_rows.alias("observations"),
        F.lit(len(df.columns)).cast("bigint").alias("variables"),
        F.count_if(F.col("class") == "categorical").alias("cat_cols"),
        F.count_if(F.col("class") == "numeric").alias("num_cols"),
        F.count_if(F.col("class") == "cardinal").alias("cat_but_car"),
        F.count_if(F.col("num_but_cat")).alias("num_but_cat"),
    )


# ---------------------------------------------------------------- nulls, shape, types


def null_counts(df: DataFrame) -> DataFrame:
    """O-24: ``(column_name, n_null)`` from one aggregate."""
    cols = df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__n_null") for c in cols])
    return _unpivot(wide, cols, ["n_null"])


def quantile_profile(
    df: DataFrame, columns: Sequence[str] | None = None, probs: Sequence[float] = PROFILE_QUANTILES
) -> DataFrame:
    """O-27: quantiles of every numeric column, one row per column, a column per
    probability (``q_0``, ``q_0_05``, ...)."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    qs = Q.column_quantiles(df, cols, probs)
    return Q.pivot_probs(qs, ["column_name"], {p: prob_name(p) for p in probs})


def prob_name(p: float) -> str:
    return "q_" + (f"{p:g}".replace(".", "_"))


def table_profile(df: DataFrame, probs: Sequence[float] = PROFILE_QUANTILES) -> DataFrame:
    """O-25, O-26, O-28: shape, type, null count and quantiles per column. The frame is read
    once: its numeric columns and whether the others are null are written, one aggregate over
    them gives rows and nulls, and the quantiles read them."""
    numeric = numeric_columns(df)
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    others = [(i, name) for i, name, _ in fields if name not in numeric]
    spool = Q.spooled(df, numeric, extra=[F.col(f"`{name}`").isNull().alias(f"n{i}") for i, name in others])
    counts = spool.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col(f"c{j}").isNull()).alias(f"c{j}") for j in range(len(numeric))],
        *[F.count_if(f"n{i}").alias(f"n{i}") for i, _ in others],
    ).first()  # one row
    nulls = {c: counts[f"c{j}"] for j, c in enumerate(numeric)} | {name: counts[f"n{i}"] for i, name in others}
    types = df.sparkSession.createDataFrame(
        [(i, name, kind, counts["n"], len(fields), nulls[name]) for i, name, kind in fields],
        "position int, column_name string, dtype string, n_rows bigint, n_columns bigint, n_null bigint",
    )
    qs = Q.spooled_quantiles(spool, numeric, probs, [counts["n"] - nulls[c] for c in numeric])
    qp = Q.pivot_probs(qs, ["column_name"], {p: prob_name(p) for p in probs})
    return types.join(qp, "column_name", "left").select(*types.columns, *[prob_name(p) for p in probs])


# ---------------------------------------------------------------- distributions


def _column_stats(vc: DataFrame) -> DataFrame:
    """Count, range and sample variance per column from its ``(value, cnt)`` rows, the
    variance around the mean in a second pass (no cancellation)."""
    value, cnt = F.col("value"), F.col("cnt")
    first = vc.groupBy("column_name").agg(
        F.sum("cnt").alias("n"),
        F.min("value").alias("vmin"),
        F.max("value").alias("vmax"),
        (F.sum(value * cnt) / F.sum("cnt")).alias("_mean"),
    )
    # One row per column: a proven bound, safe to broadcast.
    dev = vc.join(F.broadcast(first.select("column_name", "_mean")), "column_name")
    ss = dev.groupBy("column_name").agg(F.sum(cnt * (value - F.col("_mean")) * (value - F.col("_mean"))).alias("_ss"))
    var = F.try_divide(F.col("_ss"), (F.col("n") - 1).cast("double"))
    return first.join(F.broadcast(ss), "column_name").select("column_name", "n", "vmin", "vmax", var.alias("var"))


def _edges(stats: DataFrame) -> DataFrame:
    """Histogram range: [min, max], widened by 0.5 on both sides when constant."""
    const = F.col("vmax") == F.col("vmin")
    return stats.withColumn("lo", F.when(const, F.col("vmin") - 0.5).otherwise(F.col("vmin"))).withColumn(
        "hi", F.when(const, F.col("vmax") + 0.5).otherwise(F.col("vmax"))
    )


def histogram(
    df: DataFrame, columns: Sequence[str], bins: int = HIST_BINS, weight: str | None = None
) -> DataFrame:
    """O-47: equal-width bins over [min, max] per column, last bin right-closed,
    empty bins included: ``(column_name, bin, bin_start, bin_end, count)``."""
    long = Q.to_long(df, columns, [weight] if weight else ())
    edges = _edges(long.groupBy("column_name").agg(F.min("value").alias("vmin"), F.max("value").alias("vmax")))
    scale = F.lit(float(bins)) / (F.col("hi") - F.col("lo"))
    idx = F.least(F.floor((F.col("value") - F.col("lo")) * scale), F.lit(bins - 1)).cast("bigint")
    # One row per column: a proven bound, safe to broadcast.
    bounds = F.broadcast(edges.select("column_name", "lo", "hi"))
    counts = long.join(bounds, "column_name").groupBy("column_name", idx.alias("bin")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("count")
    )
    grid = edges.select(
        "column_name", "lo", "hi", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    )
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        (F.col("lo") + width * F.col("bin")).alias("bin_start"),
        (F.col("lo") + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
    )


def kde_curve(
    df: DataFrame,
    columns: Sequence[str],
    grid: int = KDE_GRID,
    bins: int = HIST_BINS,
    digits: int = 6,
    weight: str | None = None,
) -> DataFrame:
    """O-48: Gaussian kernel density per column on ``grid`` points over [min, max],
    Scott bandwidth ``sd * n^(-1/5)``, scaled to the count histogram
    (``density * n * bin width``): ``(column_name, point, x, density)``.

    Values are first reduced to distinct ``(value, cnt)``; each distinct value then
    adds its kernel to every grid point (a fixed fan-out of ``grid``), summed with
    map-side partial aggregation, so only ``grid`` rows per column and task shuffle.
    """
    long = Q.to_long(df, columns, [weight] if weight else ())
    vc = checkpointed(Q.value_counts(long, ["column_name"], weight))
    stats = _column_stats(vc).where(F.col("n") > 1)
    h = F.sqrt("var") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    step = (F.col("vmax") - F.col("vmin")) / F.lit(float(grid - 1))
    params = stats.select(
        "column_name", "n", "vmin", "vmax", h.alias("bw"), step.alias("step"),
        ((F.col("vmax") - F.col("vmin")) / F.lit(float(bins))).alias("binw"),
    )
    pts = vc.join(F.broadcast(params), "column_name").select(
        "column_name", "value", "cnt", "bw", "vmin", "step",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("point"),
    )
    x = F.col("vmin") + F.col("step") * F.col("point")
    z = (x - F.col("value")) / F.col("bw")
    contrib = F.col("cnt") * F.exp(F.lit(-0.5) * z * z)
    sums = pts.groupBy("column_name", "point").agg(F.sum(contrib).alias("_k"))
    norm = F.col("bw") * F.lit(math.sqrt(2 * math.pi)) * F.col("n")
    return sums.join(F.broadcast(params), "column_name").select(
        "column_name",
        "point",
        F.round(F.col("vmin") + F.col("step") * F.col("point"), digits).alias("x"),
        F.round(F.col("_k") / norm * F.col("n") * F.col("binw"), digits).alias("density"),
    )


DENSITY_CELLS = 4096
DENSITY_REACH = 8.0


def binned_density(
    df: DataFrame,
    columns: Sequence[str],
    grid: int = KDE_GRID,
    bins: int = HIST_BINS,
    weight: str | None = None,
    cells: int = DENSITY_CELLS,
    reach: float = DENSITY_REACH,
) -> DataFrame:
    """O-48 at a cost that does not depend on the number of distinct values: the curve of
    ``kde_curve`` with an ``error_bound``, ``(column_name, point, x, density, error_bound)``.

    Every value gives its weight to the two ends of its cell of [min, max] by nearness, so
    at most ``cells + 1`` weights per column are exchanged; each adds its kernel to the
    points within ``reach`` bandwidths. A kernel (height 1, curvature at most 1 / bandwidth²)
    is off by at most (cell / bandwidth)² / 8 from being interpolated over a cell and by
    exp(-reach² / 2) from being cut off.
    """
    columns = list(columns)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    wide = checkpointed(df.select(w.alias("w"), *[F.col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)]))
    first = wide.agg(*[a for j in range(len(columns)) for a in _moments(f"c{j}")]).first()  # one row
    stats = []
    for j, c in enumerate(columns):
        n, lo, hi, mean = (first[f"c{j}__{x}"] for x in ("n", "lo", "hi", "mean"))
        if n and n > 1 and hi > lo:
            stats.append((j, c, n, lo, hi, mean))
    if not stats:
        return df.sparkSession.createDataFrame([], "column_name string, point bigint, x double, density double, error_bound double")
    around = [F.sum(F.col("w") * F.pow(F.col(f"c{j}") - F.lit(mean), F.lit(2.0))).alias(f"c{j}") for j, _, _, _, _, mean in stats]
    squares = wide.agg(*around).first()
    rows = []
    for j, c, n, lo, hi, _ in stats:
        bw = math.sqrt(squares[f"c{j}"] / (n - 1)) * n**-0.2
        cell = (hi - lo) / cells
        scale = (hi - lo) / bins / (bw * math.sqrt(2 * math.pi))
        rows.append((j, c, lo, hi, bw, cell, scale, n * scale * ((cell / bw) ** 2 / 8 + math.exp(-reach * reach / 2))))
    # One row per column: a proven bound, safe to broadcast.
    params = F.broadcast(df.sparkSession.createDataFrame(rows, "j int, column_name string, lo double, hi double, bw double, cell double, scale double, error_bound double"))
    values = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"c{j}").alias("v")) for j, *_ in rows])
    at = F.least((F.col("v") - F.col("lo")) / F.col("cell"), F.lit(float(cells)))
    left = F.least(F.floor(at), F.lit(cells - 1)).cast("bigint")
    long = wide.select("w", F.inline(values)).where("v is not null").join(params.select("j", "lo", "cell"), "j")
    ends = long.select("j", "w", left.alias("left"), (at - left).alias("part"))
    # both ends of a cell come from one row per cell: the weight and its moment in the cell
    per_cell = ends.groupBy("j", "left").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("part")).alias("m"))
    nodes = per_cell.select("j", F.inline(F.array(F.struct(F.col("left").alias("node"), (F.col("w") - F.col("m")).alias("w")), F.struct((F.col("left") + 1).alias("node"), F.col("m").alias("w")))))
    nodes = nodes.groupBy("j", "node").agg(F.sum("w").alias("w")).join(params, "j")
    step = (F.col("hi") - F.col("lo")) / F.lit(float(grid - 1))
    place = F.col("lo") + F.col("cell") * F.col("node")
    low = F.greatest(F.ceil((place - F.lit(reach) * F.col("bw") - F.col("lo")) / step), F.lit(0))
    high = F.least(F.floor((place + F.lit(reach) * F.col("bw") - F.col("lo")) / step), F.lit(grid - 1))
    near = nodes.where(low <= high).select("j", "w", place.alias("place"), "bw", "lo", step.alias("step"), F.explode(F.sequence(low, high)).alias("point"))
    z = (F.col("lo") + F.col("step") * F.col("point") - F.col("place")) / F.col("bw")
    sums = near.groupBy("j", "point").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("k"))
    points = params.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(grid - 1).cast("bigint"))).alias("point"))
    return points.join(sums, ["j", "point"], "left").select(
        "column_name",
        "point",
        (F.col("lo") + step * F.col("point")).alias("x"),
        (F.coalesce("k", F.lit(0.0)) * F.col("scale")).alias("density"),
        "error_bound",
    )


def _moments(c: str) -> list[Column]:
    """Weight, range and weighted mean of a column of a frame with weights ``w``."""
    x, w = F.col(c), F.when(F.col(c).isNotNull(), F.col("w"))
    return [
        F.sum(w).alias(f"{c}__n"),
        F.min(x).alias(f"{c}__lo"),
        F.max(x).alias(f"{c}__hi"),
        F.try_divide(F.sum(w * x), F.sum(w)).alias(f"{c}__mean"),
    ]


def correlation_matrix(
    df: DataFrame, columns: Sequence[str], digits: int = 6, weight: str | None = None
) -> DataFrame:
    """O-49: Pearson correlation, pairwise-complete over nulls, long form
    ``(column_a, column_b, corr)`` for every ordered pair.

    One pass: every row is expanded to one ``(pair, x, y)`` row per column pair
    (a fixed fan-out), rows with a null in the pair are dropped, and a group-by on
    the pair keeps three streaming moments (covariance and both variances) with
    map-side partial aggregation. A narrow aggregate per pair stays code-generated,
    unlike one very wide aggregate over all pairs. A constant column gives null.
    With ``weight`` (row multiplicities) the moments are weighted sums around the means."""
    cols = list(columns)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    long = df.select(*([weight] if weight else []), F.inline(cells)).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if weight:
        w = F.col(weight)
        means = long.groupBy("pair").agg(
            *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in "xy"],
            *[(F.min(c) == F.max(c)).alias(f"const_{c}") for c in "xy"],
        )  # one row per column pair: a proven bound, safe to broadcast
        dx = F.when(F.col("const_x"), 0.0).otherwise(F.col("x") - F.col("mx"))
        dy = F.when(F.col("const_y"), 0.0).otherwise(F.col("y") - F.col("my"))
        mom = long.join(F.broadcast(means), "pair").groupBy("pair").agg(
            F.sum(w * dx * dy).alias("cxy"), F.sum(w * dx * dx).alias("vx"), F.sum(w * dy * dy).alias("vy")
        )
    else:
        mom = long.groupBy("pair").agg(
            F.covar_samp("x", "y").alias("cxy"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy")
        )
    r = F.try_divide(F.col("cxy"), F.sqrt(F.col("vx") * F.col("vy")))
    corr = F.round(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)), digits)
    first = F.array(*[F.lit(a) for a, _ in pairs])
    second = F.array(*[F.lit(b) for _, b in pairs])
    idx = F.col("pair") + 1
    both = mom.select(
        F.explode(
            F.array(
                F.struct(F.element_at(first, idx).alias("column_a"), F.element_at(second, idx).alias("column_b")),
                F.struct(F.element_at(second, idx).alias("column_a"), F.element_at(first, idx).alias("column_b")),
            )
        ).alias("p"),
        corr.alias("corr"),
    ).select("p.column_a", "p.column_b", "corr")
    return both.distinct()


def boxplot_stats(df: DataFrame, value: str = "freight_value", group: str = "customer_state") -> DataFrame:
    """O-50: per group median, quartiles, whiskers (most extreme values within
    1.5 IQR of the quartiles) and the count of values beyond them."""
    # The values are written where they are and read by every pass; none is exchanged.
    long = checkpointed(df.select(F.col(group), F.col(value).cast("double").alias("value")).where(F.col("value").isNotNull()))
    qs = Q.quantiles(long, [0.25, 0.5, 0.75], keys=[group], written=True)
    box = Q.pivot_probs(qs, [group], {0.25: "q1", 0.5: "median", 0.75: "q3"})
    iqr = F.col("q3") - F.col("q1")
    box = box.withColumn("_lo", F.col("q1") - IQR_FACTOR * iqr).withColumn("_hi", F.col("q3") + IQR_FACTOR * iqr)
    box = checkpointed(box)
    limits = box.select(F.col(group).alias("_g"), "_lo", "_hi")
    if box.count() <= Q.MAX_TARGETS:  # else Spark chooses the join
        limits = F.broadcast(limits)
    v = F.col("value")
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    stats = long.join(limits, F.col(group).eqNullSafe(F.col("_g"))).groupBy(F.col(group).alias("_g")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
    )
    joined = box.drop("_lo", "_hi").join(stats, F.col(group).eqNullSafe(F.col("_g")))
    return joined.drop("_g")


def summary_stats(
    df: DataFrame, columns: Sequence[str], digits: int = 6, weight: str | None = None
) -> DataFrame:
    """O-51: mean, min and max per column, one aggregate."""
    cols = list(columns)

    def mean(c: Column) -> Column:
        if not weight:
            return F.avg(c)
        return F.try_divide(F.sum(c * F.col(weight)), F.sum(F.when(c.isNotNull(), F.col(weight))))

    aggs: list[Column] = []
    for c in cols:
        aggs += [
            F.round(mean(F.col(c)), digits).alias(f"{c}__mean"),
            F.min(F.col(c).cast("double")).alias(f"{c}__min"),
            F.max(F.col(c).cast("double")).alias(f"{c}__max"),
        ]
    return _unpivot(df.agg(*aggs), cols, ["mean", "min", "max"])
