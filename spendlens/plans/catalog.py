"""Registry of the operator queries: for each name a Spark plan over the driver's
tables (``(spark, sf_dir) -> DataFrame``) and, where SQL can state it, the DuckDB
oracle text. ``__spark_entry__`` exposes both.

Every query reads the whole tables; the only limits are where the operator itself
is a top-k or a preview.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import assemble, clean, features, profile, rank
from ..sources.fixtures import TEST_CUTOFF, fixture_tables
from . import oracle as O
from . import pipeline

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _t(spark: SparkSession, sf_dir: str):
    return fixture_tables(spark, sf_dir)


def _sales(spark, sf_dir, weighted=True) -> DataFrame:
    return pipeline.cleaned_sales(_t(spark, sf_dir), weighted)


def _features(spark, sf_dir) -> DataFrame:
    return pipeline.train_features(_t(spark, sf_dir), TEST_CUTOFF)


def _modeling(spark, sf_dir) -> DataFrame:
    return pipeline.modeling_frame(_t(spark, sf_dir), TEST_CUTOFF)


KEY = features.KEY

# ------------------------------------------------------------------ sources


@register(
    "scan_tables",
    O.sql(
        """
select 'customers' as table_name, count(*) as n_rows, cast(3 as bigint) as n_columns from cv_customers
union all select 'orders', count(*), 7 from cv_orders
union all select 'payments', count(*), 4 from cv_payments
union all select 'items', count(*), 5 from cv_items
union all select 'products', count(*), 9 from cv_products
union all select 'categories', count(*), 2 from cv_categories""",
        upto=None,
    ),
)
def q_scan_tables(spark, sf_dir):
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns")
        )
        for name, df in _t(spark, sf_dir).as_dict().items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PREVIEW_KEYS = ["order_id", "order_item_id", "product_id", "payment_sequential", "price", "freight_value"]


@register(
    "preview_head_tail",
    O.sql(
        """
(select *, 'head' as part from sales_fanout
 order by order_id, order_item_id, product_id, payment_sequential, price nulls first, freight_value limit 3)
union all
(select *, 'tail' as part from sales_fanout
 order by order_id desc, order_item_id desc, product_id desc, payment_sequential desc,
          price desc nulls last, freight_value desc limit 3)""",
        upto="sales_fanout",
    ),
)
def q_preview(spark, sf_dir):
    return profile.preview(assemble.denormalize(_t(spark, sf_dir)), PREVIEW_KEYS, 3)


@register(
    "model_sample",
    O.sql(
        f"""
select customer_unique_id, recency, frequency, monetary, avg_order_value, total_items, avg_item_price,
       category_count, tenure_days, purchase_interval, is_repeat_customer, actual_cltv,
       round(cltv_log, 6) as cltv_log
from modeling order by customer_unique_id limit 10"""
    ),
)
def q_model_sample(spark, sf_dir):
    m = _modeling(spark, sf_dir).orderBy(KEY).limit(10)
    return m.withColumn("cltv_log", F.round("cltv_log", 6))


# ------------------------------------------------------------------ columns and rows


@register("drop_columns", O.sql("select * exclude (product_category_name) from sales_fanout", upto="sales_fanout"))
def q_drop_columns(spark, sf_dir):
    return clean.drop_columns(assemble.denormalize(_t(spark, sf_dir)), ["product_category_name"])


@register(
    "total_price",
    O.sql(
        """
select order_id, order_item_id, product_id, payment_sequential, price, price * order_item_id as total_price
from sales_fanout""",
        upto="sales_fanout",
    ),
)
def q_total_price(spark, sf_dir):
    df = clean.with_total_price(assemble.denormalize(_t(spark, sf_dir)))
    return df.select("order_id", "order_item_id", "product_id", "payment_sequential", "price", "total_price")


@register(
    "null_price_rows",
    O.sql(
        """
select order_id, order_item_id, product_id, payment_sequential, price, freight_value, customer_unique_id
from sales_fanout where price is null""",
        upto="sales_fanout",
    ),
)
def q_null_price_rows(spark, sf_dir):
    df = clean.null_rows(assemble.denormalize(_t(spark, sf_dir)), "price", n=None)
    return df.select(
        "order_id", "order_item_id", "product_id", "payment_sequential", "price", "freight_value", KEY
    )


@register("dropna_subset", O.sql("select * from clean_sales", upto="clean_sales"))
def q_dropna_subset(spark, sf_dir):
    return _sales(spark, sf_dir, weighted=False)


@register(
    "cutoff_split",
    O.sql(
        f"""
select order_id, order_item_id, product_id, payment_sequential, customer_unique_id, order_purchase_timestamp,
       total_price, case when order_purchase_timestamp < {O.CUTOFF_SQL} then 'train' else 'test' end as side
from clean_sales where order_purchase_timestamp is not null""",
        upto="clean_sales",
    ),
)
def q_cutoff_split(spark, sf_dir):
    sales = _sales(spark, sf_dir, weighted=False)
    train, test = features.cutoff_split(sales, TEST_CUTOFF)
    cols = ["order_id", "order_item_id", "product_id", "payment_sequential", KEY, features.TS, "total_price"]
    return train.select(*cols, F.lit("train").alias("side")).unionByName(
        test.select(*cols, F.lit("test").alias("side"))
    )


# ------------------------------------------------------------------ joins


@register("denormalized", O.sql("select * from sales_fanout", upto="sales_fanout"))
def q_denormalized(spark, sf_dir):
    return assemble.denormalize(_t(spark, sf_dir))


@register(
    "payment_fanout",
    O.sql(
        """
select o.order_id, count(distinct p.payment_sequential) as payment_rows,
       count(distinct i.order_item_id || '/' || i.product_id) as item_keys,
       count(*) as fanout_rows
from cv_orders o join cv_payments p on o.order_id = p.order_id join cv_items i on o.order_id = i.order_id
join cv_customers c on c.customer_id = o.customer_id
join cv_products pr on i.product_id = pr.product_id
group by o.order_id""",
        upto=None,
    ),
)
def q_payment_fanout(spark, sf_dir):
    """Rows each order contributes to the fan-out frame: payments x items, against
    the compact frame (one row per item, ``payment_rows`` multiplicity)."""
    ws = assemble.weighted_sales(_t(spark, sf_dir))
    return ws.groupBy("order_id").agg(
        F.max("payment_rows").alias("payment_rows"),
        F.count_distinct(F.concat_ws("/", "order_item_id", "product_id")).alias("item_keys"),
        F.sum("payment_rows").alias("fanout_rows"),
    )


@register(
    "category_left_join",
    O.sql(
        """
select pr.product_id, pr.product_category_name, cat.product_category_name_english
from cv_products pr
left join cv_categories cat on pr.product_category_name is not distinct from cat.product_category_name""",
        upto=None,
    ),
)
def q_category_left_join(spark, sf_dir):
    t = _t(spark, sf_dir)
    return assemble._with_categories(t.products, t.categories).select(
        "product_id", "product_category_name", "product_category_name_english"
    )


# ------------------------------------------------------------------ features

FEATURE_SQL = "select {cols} from features"


@register("reference_date", O.sql("select max(order_purchase_timestamp) as reference_date from train", upto="train"))
def q_reference_date(spark, sf_dir):
    train, _ = features.cutoff_split(_sales(spark, sf_dir), TEST_CUTOFF)
    return spark.range(1).select(features.reference_date(train).alias("reference_date"))


def _feature_query(name: str, cols: list[str]):
    @register(name, O.sql(FEATURE_SQL.format(cols=", ".join([KEY, *cols])), upto="features"))
    def q(spark, sf_dir):
        return pipeline.train_features(_t(spark, sf_dir), TEST_CUTOFF, wanted=cols)

    return q


_feature_query("rfm", ["recency", "frequency", "monetary", "avg_order_value"])
_feature_query("basket_features", ["total_items", "avg_item_price", "category_count"])
_feature_query("tenure", ["tenure_days"])
_feature_query("purchase_interval", ["purchase_interval"])
_feature_query("repeat_flag", ["is_repeat_customer"])
_feature_query("customer_features", list(features.FEATURES))


@register("realized_value", O.sql("select * from realized", upto="realized"))
def q_realized_value(spark, sf_dir):
    _, test = features.cutoff_split(_sales(spark, sf_dir), TEST_CUTOFF)
    return features.realized_value(test, "payment_rows")


@register(
    "modeling_frame",
    O.sql(
        """
select * exclude (cltv_log), round(cltv_log, 6) as cltv_log from modeling"""
    ),
)
def q_modeling_frame(spark, sf_dir):
    return _modeling(spark, sf_dir).withColumn("cltv_log", F.round("cltv_log", 6))


# ------------------------------------------------------------------ scalar functions


@register(
    "parse_timestamp",
    """
select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_text,
       strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') as parsed
from events""",
)
def q_parse_timestamp(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return ev.select("event_id", text.alias("ts_text"), S.parse_timestamp(text).alias("parsed"))


@register(
    "elapsed_days",
    """
select user_id, min(ts) as first_ts, max(ts) as last_ts,
       date_sub('day', min(ts), max(ts)) as tenure_days,
       date_sub('day', max(ts), (select max(ts) from events)) as recency_days,
       count(*) as n_events
from events where user_id is not null group by user_id""",
)
def q_elapsed_days(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    agg = ev.groupBy("user_id").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_events")
    )
    ref = agg.select(F.max("last_ts")).scalar()
    return agg.where(F.col("user_id").isNotNull()).select(
        "user_id",
        "first_ts",
        "last_ts",
        S.elapsed_days("first_ts", "last_ts").alias("tenure_days"),
        S.elapsed_days(F.col("last_ts"), ref).alias("recency_days"),
        "n_events",
    )


@register(
    "log_target",
    O.sql(
        """
select customer_unique_id, actual_cltv, round(ln(1 + actual_cltv), 6) as cltv_log,
       round(exp(ln(1 + actual_cltv)) - 1, 4) as back_transformed
from modeling"""
    ),
)
def q_log_target(spark, sf_dir):
    m = _modeling(spark, sf_dir)
    return m.select(
        KEY,
        "actual_cltv",
        F.round("cltv_log", 6).alias("cltv_log"),
        F.round(S.from_log_target("cltv_log"), 4).alias("back_transformed"),
    )


# ------------------------------------------------------------------ ranking


@register(
    "top_customers",
    O.sql(
        """
select customer_unique_id, monetary,
       row_number() over (order by monetary desc, customer_unique_id) as rank
from features order by monetary desc, customer_unique_id limit 100""",
        upto="features",
    ),
)
def q_top_customers(spark, sf_dir):
    return rank.top_n(_features(spark, sf_dir), "monetary", 100, KEY)


# Window helper re-exported for the flagship query.
__all__ = ["QUERIES", "ORACLE"]


# ------------------------------------------------------------------ cleaning and profiling

# Product columns as the source classifies them (cat_th=10, car_th=15): every
# numeric column; the photo count (6 values) counts as categorical, the id as cardinal.
CAT_TH, CAR_TH = 10, 15


def _num_cols(t) -> list[str]:
    """The source's ``num_cols`` of the products table (small metadata: one row per
    product column)."""
    return profile.class_lists(profile.column_classes(t.products, CAT_TH, CAR_TH))["num_cols"]


NUM_COLS_SQL = [
    "product_name_lenght",
    "product_description_lenght",
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
]


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


def _limits_sql(lq: float, uq: float) -> str:
    """Two quantiles of every column, from one pass that sorts each column once."""
    lists = ", ".join(f"list_sort(list({c}) filter (where {c} is not null)) as {c}" for c in NUM_COLS_SQL)
    cells = ", ".join(
        f"{{'column_name': '{c}', 'q1': {O.list_quantile(c, lq)}, 'q3': {O.list_quantile(c, uq)}}}" for c in NUM_COLS_SQL
    )
    return f"select unnest([{cells}], recursive := true) from (select {lists} from profiled)"


LIMITS_BODY = """
select column_name, q1, q3, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as low_limit, q3 + 1.5 * (q3 - q1) as up_limit
from qs"""


@register("outlier_thresholds", O.sql(LIMITS_BODY, upto="profiled", extra={"qs": _limits_sql(0.25, 0.75)}))
def q_outlier_thresholds(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.outlier_limits(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


@register(
    "outlier_check",
    O.sql(
        """
select l.column_name, l.low_limit, l.up_limit, n.n_outliers, n.n_outliers > 0 as has_outlier
from lim l join counts n on l.column_name = n.column_name""",
        upto="profiled",
        extra={
            "qs": _limits_sql(0.2, 0.8),
            "lim": LIMITS_BODY,
            "counts": _union(
                [
                    f"""select '{c}' as column_name, count(*) filter (where s.{c} > l.up_limit or s.{c} < l.low_limit)
  as n_outliers from profiled s, (select * from lim where column_name = '{c}') l"""
                    for c in NUM_COLS_SQL
                ]
            ),
        },
    ),
)
def q_outlier_check(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.outlier_check(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


def _winsor_sql() -> str:
    sel = ",\n".join(
        f"""case when s.{c} < l.{c}__low then l.{c}__low when s.{c} > l.{c}__up then l.{c}__up
     else s.{c} end as {c}"""
        for c in NUM_COLS_SQL
    )
    return f"""
select s.order_id, s.order_item_id, s.product_id, s.payment_sequential, {sel}
from profiled s, lim_row l"""


def _lim_row_sql() -> str:
    """All limits as one row, so that the cap reads one small table."""
    cols = ", ".join(
        f"max(case when column_name = '{c}' then {v}_limit end) as {c}__{v}" for c in NUM_COLS_SQL for v in ("low", "up")
    )
    return f"select {cols} from lim"


@register(
    "winsorize",
    O.sql(_winsor_sql(), upto="profiled", extra={"qs": _limits_sql(0.25, 0.75), "lim": LIMITS_BODY, "lim_row": _lim_row_sql()}),
)
def q_winsorize(spark, sf_dir):
    t = _t(spark, sf_dir)
    cols = _num_cols(t)
    capped = pipeline.capped_products(t, cols).drop("sales_rows")
    keys = ["order_id", "order_item_id", "product_id", "payment_sequential"]
    return pipeline.sales_with_products(t, capped).select(*keys, *cols)


@register(
    "outlier_check_capped",
    O.sql(
        """
select l.column_name, l.low_limit, l.up_limit, n.n_outliers, n.n_outliers > 0 as has_outlier
from lim2 l join counts n on l.column_name = n.column_name""",
        upto="profiled",
        extra={
            "qs": _limits_sql(0.25, 0.75),
            "lim": LIMITS_BODY,
            "lim_row": _lim_row_sql(),
            "wins": _winsor_sql(),
            "qs2": _limits_sql(0.2, 0.8).replace("from profiled", "from wins"),
            "lim2": LIMITS_BODY.replace("from qs", "from qs2"),
            "counts": _union(
                [
                    f"""select '{c}' as column_name, count(*) filter (where s.{c} > l.up_limit or s.{c} < l.low_limit)
  as n_outliers from wins s, (select * from lim2 where column_name = '{c}') l"""
                    for c in NUM_COLS_SQL
                ]
            ),
        },
    ),
)
def q_outlier_check_capped(spark, sf_dir):
    """The outlier check repeated on the capped columns."""
    t = _t(spark, sf_dir)
    cols = _num_cols(t)
    return profile.outlier_check(pipeline.capped_products(t, cols), cols, weight="sales_rows")


@register(
    "semi_join_sales",
    O.sql(
        """
select c.customer_unique_id, o.order_id, i.order_item_id, i.product_id, i.price
from cv_customers c join cv_orders o on c.customer_id = o.customer_id
join cv_items i on o.order_id = i.order_id join cv_products pr on i.product_id = pr.product_id
left join cv_categories cat on pr.product_category_name is not distinct from cat.product_category_name
where exists (select 1 from cv_payments p where p.order_id = o.order_id)""",
        upto=None,
    ),
)
def q_semi_join_sales(spark, sf_dir):
    """The join without the payment fan-out."""
    df = assemble.denormalize(_t(spark, sf_dir), payment_fanout=False)
    return df.select(KEY, "order_id", "order_item_id", "product_id", "price")


@register(
    "fill_delivery_dates",
    O.sql(
        """
select order_id, order_item_id, product_id, payment_sequential,
       order_delivered_carrier_date, order_delivered_customer_date,
       cast(order_delivered_carrier_date is null as integer) as order_delivered_carrier_date_missing,
       coalesce(strftime(order_delivered_carrier_date, '%Y-%m-%d %H:%M:%S'), '0') as order_delivered_carrier_date_filled,
       cast(order_delivered_customer_date is null as integer) as order_delivered_customer_date_missing,
       coalesce(strftime(order_delivered_customer_date, '%Y-%m-%d %H:%M:%S'), '0')
         as order_delivered_customer_date_filled
from profiled""",
        upto="profiled",
    ),
)
def q_fill_delivery_dates(spark, sf_dir):
    df = clean.fill_delivery_dates(pipeline.profiled_sales(_t(spark, sf_dir)))
    keep = ["order_id", "order_item_id", "product_id", "payment_sequential"]
    dates = [c for c in df.columns if c.startswith("order_delivered_")]
    return df.select(*keep, *dates)


PRODUCT_TYPES = [
    ("product_id", "string"),
    ("product_category_name", "string"),
    ("product_name_lenght", "double"),
    ("product_description_lenght", "double"),
    ("product_photos_qty", "double"),
    ("product_weight_g", "double"),
    ("product_length_cm", "double"),
    ("product_height_cm", "double"),
    ("product_width_cm", "double"),
]


def _classes_sql() -> str:
    rows = _union(
        [
            f"select '{c}' as column_name, '{d}' as dtype, count(distinct {c}) as n_unique, "
            f"'{'string' if d == 'string' else 'numeric'}' as kind from cv_products"
            for c, d in PRODUCT_TYPES
        ]
    )
    return f"""
select column_name, dtype, n_unique,
       case when kind = 'string' and n_unique > {CAR_TH} then 'cardinal'
            when kind = 'string' then 'categorical'
            when n_unique < {CAT_TH} then 'categorical'
            else 'numeric' end as class,
       kind = 'numeric' and n_unique < {CAT_TH} as num_but_cat
from ({rows}) x"""


@register("column_classes", O.sql(_classes_sql(), upto=None))
def q_column_classes(spark, sf_dir):
    return profile.column_classes(_t(spark, sf_dir).products, CAT_TH, CAR_TH)


@register(
    "column_class_summary",
    O.sql(
        """
select (select count(*) from cv_products) as observations, cast(9 as bigint) as variables,
       count(*) filter (where class = 'categorical') as cat_cols,
       count(*) filter (where class = 'numeric') as num_cols,
       count(*) filter (where class = 'cardinal') as cat_but_car,
       count(*) filter (where num_but_cat) as num_but_cat
from classes""",
        upto=None,
        extra={"classes": _classes_sql()},
    ),
)
def q_column_class_summary(spark, sf_dir):
    return profile.column_class_summary(_t(spark, sf_dir).products, CAT_TH, CAR_TH)


FANOUT_TYPES = [
    ("customer_id", "string"),
    ("customer_unique_id", "string"),
    ("customer_state", "string"),
    ("order_id", "string"),
    ("order_status", "string"),
    ("order_purchase_timestamp", "timestamp_ntz"),
    ("order_approved_at", "timestamp_ntz"),
    ("order_delivered_carrier_date", "timestamp_ntz"),
    ("order_delivered_customer_date", "timestamp_ntz"),
    ("payment_sequential", "int"),
    ("payment_installments", "int"),
    ("payment_value", "double"),
    ("order_item_id", "int"),
    ("product_id", "string"),
    ("price", "double"),
    ("freight_value", "double"),
    ("product_category_name", "string"),
    ("product_name_lenght", "double"),
    ("product_description_lenght", "double"),
    ("product_photos_qty", "double"),
    ("product_weight_g", "double"),
    ("product_length_cm", "double"),
    ("product_height_cm", "double"),
    ("product_width_cm", "double"),
    ("product_category_name_english", "string"),
]
FANOUT_NUMERIC = [c for c, d in FANOUT_TYPES if d in ("bigint", "int", "double")]
PROBS = profile.PROFILE_QUANTILES


def _nulls_sql() -> str:
    return _union(
        [f"select '{c}' as column_name, count(*) filter (where {c} is null) as n_null from profiled" for c, _ in FANOUT_TYPES]
    )


@register("null_counts", O.sql(_nulls_sql(), upto="profiled"))
def q_null_counts(spark, sf_dir):
    return profile.null_counts(pipeline.profiled_sales(_t(spark, sf_dir)))


def _qprofile_sql(cols) -> str:
    return _union(
        [
            f"select '{c}' as column_name, "
            + ", ".join(f"{O.np_quantile(c, p)} as {profile.prob_name(p)}" for p in PROBS)
            + " from profiled"
            for c in cols
        ]
    )


@register("quantile_profile", O.sql(_qprofile_sql(FANOUT_NUMERIC), upto="profiled"))
def q_quantile_profile(spark, sf_dir):
    return profile.quantile_profile(pipeline.profiled_sales(_t(spark, sf_dir)))


def _table_profile_sql() -> str:
    types = _union(
        [f"select {i} as position, '{c}' as column_name, '{d}' as dtype" for i, (c, d) in enumerate(FANOUT_TYPES)]
    )
    qcols = ", ".join(f"q.{profile.prob_name(p)}" for p in PROBS)
    return f"""
select t.position, t.column_name, t.dtype, (select count(*) from profiled) as n_rows,
       cast({len(FANOUT_TYPES)} as bigint) as n_columns, n.n_null, {qcols}
from ({types}) t join nulls n on t.column_name = n.column_name left join qp q on t.column_name = q.column_name"""


@register(
    "table_profile",
    O.sql(_table_profile_sql(), upto="profiled", extra={"nulls": _nulls_sql(), "qp": _qprofile_sql(FANOUT_NUMERIC)}),
)
def q_table_profile(spark, sf_dir):
    return profile.table_profile(pipeline.profiled_sales(_t(spark, sf_dir)))


def _long_sql() -> str:
    return _union(
        [f"select '{c}' as column_name, cast({c} as double) as value from profiled where {c} is not null" for c in NUM_COLS_SQL]
    )


HIST_SQL = f"""
select g.column_name, g.bin, g.lo + (g.hi - g.lo) / {profile.HIST_BINS} * g.bin as bin_start,
       g.lo + (g.hi - g.lo) / {profile.HIST_BINS} * (g.bin + 1) as bin_end,
       coalesce(c.count, 0) as count
from (select e.*, b.bin from edges e, (select unnest(range(0, {profile.HIST_BINS})) as bin) b) g
left join (
  select l.column_name,
         least(cast(floor((l.value - e.lo) * ({float(profile.HIST_BINS)} / (e.hi - e.lo))) as integer),
               {profile.HIST_BINS - 1}) as bin,
         count(*) as count
  from long l join edges e on l.column_name = e.column_name group by all) c
on g.column_name = c.column_name and g.bin = c.bin"""

EDGES_SQL = """
select column_name, case when max(value) = min(value) then min(value) - 0.5 else min(value) end as lo,
       case when max(value) = min(value) then max(value) + 0.5 else max(value) end as hi
from long group by column_name"""


@register("histogram", O.sql(HIST_SQL, upto="profiled", extra={"long": _long_sql(), "edges": EDGES_SQL}))
def q_histogram(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.histogram(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


KDE_SQL = f"""
select p.column_name, g.point, round(p.vmin + p.step * g.point, 6) as x,
       round(sum(v.cnt * exp(-0.5 * ((p.vmin + p.step * g.point - v.value) / p.bw)
                                  * ((p.vmin + p.step * g.point - v.value) / p.bw)))
             / (p.bw * sqrt(2 * pi()) * p.n) * p.n * p.binw, 6) as density
from params p join vc v on p.column_name = v.column_name,
     (select unnest(range(0, {profile.KDE_GRID})) as point) g
group by p.column_name, g.point, p.vmin, p.step, p.bw, p.n, p.binw"""

KDE_PARAMS = f"""
select column_name, count(*) as n, min(value) as vmin, max(value) as vmax,
       sqrt(var_samp(value)) * pow(cast(count(*) as double), -0.2) as bw,
       (max(value) - min(value)) / {float(profile.KDE_GRID - 1)} as step,
       (max(value) - min(value)) / {float(profile.HIST_BINS)} as binw
from long group by column_name having count(*) > 1"""


@register(
    "kde_curve",
    O.sql(
        KDE_SQL,
        upto="profiled",
        extra={
            "long": _long_sql(),
            "params": KDE_PARAMS,
            "vc": "select column_name, value, count(*) as cnt from long group by column_name, value",
        },
    ),
)
def q_kde_curve(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.kde_curve(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


def _corr_sql() -> str:
    parts = []
    for a in NUM_COLS_SQL:
        for b in NUM_COLS_SQL:
            parts.append(f"select '{a}' as column_a, '{b}' as column_b, round(corr({a}, {b}), 6) as corr from profiled")
    return _union(parts)


@register("correlation_matrix", O.sql(_corr_sql(), upto="profiled"))
def q_correlation_matrix(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.correlation_matrix(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


BOX_SQL = f"""
select b.customer_state, b.q1, b.median, b.q3, count(*) as n,
       min(case when s.freight_value between b.lo and b.hi then s.freight_value end) as whisker_low,
       max(case when s.freight_value between b.lo and b.hi then s.freight_value end) as whisker_high,
       count(*) filter (where not (s.freight_value between b.lo and b.hi)) as n_fliers
from profiled s join (
  select customer_state, q1, median, q3, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi
  from (select customer_state, {O.np_quantile("freight_value", 0.25)} as q1,
               {O.np_quantile("freight_value", 0.5)} as median, {O.np_quantile("freight_value", 0.75)} as q3
        from profiled where freight_value is not null group by customer_state) x) b
on s.customer_state = b.customer_state
where s.freight_value is not null
group by b.customer_state, b.q1, b.median, b.q3"""


@register("boxplot_stats", O.sql(BOX_SQL, upto="profiled"))
def q_boxplot_stats(spark, sf_dir):
    return profile.boxplot_stats(pipeline.profiled_sales(_t(spark, sf_dir)))


def _summary_sql() -> str:
    return _union(
        [
            f"select '{c}' as column_name, round(avg({c}), 6) as mean, cast(min({c}) as double) as min, "
            f"cast(max({c}) as double) as max from profiled"
            for c in NUM_COLS_SQL
        ]
    )


@register("summary_stats", O.sql(_summary_sql(), upto="profiled"))
def q_summary_stats(spark, sf_dir):
    t = _t(spark, sf_dir)
    return profile.summary_stats(pipeline.product_sales(t), _num_cols(t), weight="sales_rows")


# ------------------------------------------------------------------ folds, top-N overlap, metrics

from ..functions.scalars import hash_sql  # noqa: E402
from ..operators import folds, metrics  # noqa: E402

SPLIT_SQL = f"case when {hash_sql('customer_unique_id', 42)} % 10000 < 2000 then 'test' else 'train' end"
FOLD_SQL = f"cast({hash_sql('customer_unique_id', 42, 9)} % 5 as integer)"


@register("train_test_split", O.sql(f"select customer_unique_id, {SPLIT_SQL} as split from modeling"))
def q_train_test_split(spark, sf_dir):
    return folds.train_test_split(_modeling(spark, sf_dir)).select(KEY, "split")


@register("kfold_assign", O.sql(f"select customer_unique_id, {FOLD_SQL} as fold from modeling"))
def q_kfold_assign(spark, sf_dir):
    return folds.kfold_assign(_modeling(spark, sf_dir)).select(KEY, "fold")


@register(
    "kfold_contiguous",
    O.sql("select customer_unique_id, cast(ntile(3) over (order by customer_unique_id) as integer) as fold from modeling"),
)
def q_kfold_contiguous(spark, sf_dir):
    return folds.kfold_contiguous(_modeling(spark, sf_dir).select(KEY)).select(KEY, "fold")


@register(
    "top_n_overlap",
    O.sql(
        """
select 100 as top_n, count(*) as overlap from (
  (select customer_unique_id from modeling order by actual_cltv desc, customer_unique_id limit 100)
  intersect
  (select customer_unique_id from modeling order by monetary desc, customer_unique_id limit 100)) x"""
    ),
)
def q_top_n_overlap(spark, sf_dir):
    """True top-100 by realised value against the top-100 by past spend."""
    return rank.top_n_overlap(_modeling(spark, sf_dir), "actual_cltv", "monetary", 100, KEY)


@register(
    "top_n_overlap_by_fold",
    O.sql(
        f"""
select fold, cast(overlap as double) as overlap, avg(cast(overlap as double)) over () as mean_overlap
from per_fold""",
        extra={
            "f": f"""select customer_unique_id, actual_cltv, monetary, {FOLD_SQL} as fold,
  row_number() over (partition by {FOLD_SQL} order by actual_cltv desc, customer_unique_id) as rt,
  row_number() over (partition by {FOLD_SQL} order by monetary desc, customer_unique_id) as rp
from modeling""",
            "per_fold": "select fold, count(*) filter (where rt <= 100 and rp <= 100) as overlap from f group by fold",
        },
    ),
)
def q_top_n_overlap_by_fold(spark, sf_dir):
    df = folds.kfold_assign(_modeling(spark, sf_dir))
    return rank.top_n_overlap_by_fold(df, "actual_cltv", "monetary", "fold", 100, KEY)


@register(
    "regression_metrics",
    O.sql(
        f"""
select count(*) as n, round(sqrt(avg((cltv_log - p) * (cltv_log - p))), 6) as rmse,
       round(1 - sum((cltv_log - p) * (cltv_log - p))
                 / sum((cltv_log - (select avg(cltv_log) from h)) * (cltv_log - (select avg(cltv_log) from h))), 6) as r2,
       round(avg(abs(cltv_log - p)), 6) as mae
from h""",
        extra={"h": f"select cltv_log, ln(1 + monetary) as p from modeling where {SPLIT_SQL} = 'test'"},
    ),
)
def q_regression_metrics(spark, sf_dir):
    """Holdout metrics of a SQL-defined predictor (``log1p(monetary)``)."""
    mf = folds.train_test_split(_modeling(spark, sf_dir))
    hold = mf.where(F.col("split") == "test").select("cltv_log", S.log_target("monetary").alias("prediction"))
    m = metrics.regression_metrics(hold)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("rmse", "r2", "mae")])


# ------------------------------------------------------------------ models and attribution (rows-only checks)

from ..operators import explain, model, tuning  # noqa: E402

PRESETS = model.PRESETS
BOOSTED = PRESETS["boosted"]


def _prepared(spark, sf_dir) -> DataFrame:
    return model.prepare(_modeling(spark, sf_dir))


def _fitted(spark, sf_dir, preset: model.Preset):
    """The model on the training split, and the whole modelling frame."""
    frame = _prepared(spark, sf_dir)
    split = folds.train_test_split(frame)
    return model.fit(split.where(F.col("split") == "train"), preset), frame


@register("fit_linear")
def q_fit_linear(spark, sf_dir):
    return model.coefficients(spark, _fitted(spark, sf_dir, PRESETS["linear"])[0])


@register("fit_forest")
def q_fit_forest(spark, sf_dir):
    return model.importances(spark, _fitted(spark, sf_dir, PRESETS["forest"])[0])


@register("fit_boosted")
def q_fit_boosted(spark, sf_dir):
    return model.importances(spark, _fitted(spark, sf_dir, BOOSTED)[0])


@register("fit_boosted_deep")
def q_fit_boosted_deep(spark, sf_dir):
    return model.importances(spark, _fitted(spark, sf_dir, PRESETS["boosted_deep"])[0])


@register("score_customers")
def q_score_customers(spark, sf_dir):
    scored = model.score(*_fitted(spark, sf_dir, PRESETS["forest"]))
    return scored.select(KEY, "actual_cltv", "cltv_log", "prediction", "predicted_cltv")


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    return model.model_comparison(_prepared(spark, sf_dir))


@register("cv_rmse")
def q_cv_rmse(spark, sf_dir):
    return model.cv_rmse(_prepared(spark, sf_dir), PRESETS["forest"])


@register("grid_search")
def q_grid_search(spark, sf_dir):
    """All 192 points; one call scores the next parameter set at full size (three fits of 500
    rounds, two points) and finds those of earlier calls in the session's shared folder."""
    frame = _prepared(spark, sf_dir)
    store = tuning.default_store(frame)
    tuning.tune(frame, BOOSTED, store, max_shapes=1)
    return tuning.tuning_table(frame, BOOSTED, store)


@register("tuned_top_customers")
def q_tuned_top_customers(spark, sf_dir):
    """The best point so far (the first is scored if none is), refitted on all rows."""
    frame = _prepared(spark, sf_dir)
    best = tuning.tuned_model(frame, BOOSTED, tuning.default_store(frame))
    return tuning.top_customers(best, frame)


@register("out_of_fold")
def q_out_of_fold(spark, sf_dir):
    return model.out_of_fold(_prepared(spark, sf_dir), PRESETS["forest"])


@register("out_of_fold_overlap")
def q_out_of_fold_overlap(spark, sf_dir):
    """Per fold, the realised top 100 against the top 100 of held-out predictions."""
    scored = model.out_of_fold(_prepared(spark, sf_dir), PRESETS["forest"])
    return rank.top_n_overlap_by_fold(scored, "actual_cltv", "pred_cltv", "fold", 100, KEY)


@register("shap_values")
def q_shap_values(spark, sf_dir):
    fitted, frame = _fitted(spark, sf_dir, PRESETS["forest"])
    return explain.shap_values(frame, fitted)


@register("shap_importance")
def q_shap_importance(spark, sf_dir):
    return explain.shap_importance(q_shap_values(spark, sf_dir))


@register("shap_dependence")
def q_shap_dependence(spark, sf_dir):
    fitted, frame = _fitted(spark, sf_dir, PRESETS["forest"])
    return explain.shap_dependence(explain.shap_interactions(frame, fitted, "recency"), "recency")


# ------------------------------------------------------------------ k-NN imputation

from ..operators import impute  # noqa: E402

KNN_COLS = ["product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm"]


def _knn_sql() -> str:
    v = [f"v{j}" for j in range(4)]
    both = [f"(r.{x} is not null and d.{x} is not null)" for x in v]
    ss = " + ".join(f"(case when {b} then (r.{x} - d.{x}) * (r.{x} - d.{x}) else 0.0 end)" for b, x in zip(both, v))
    p = " + ".join(f"(case when {b} then 1 else 0 end)" for b in both)
    target_present = " or ".join(f"(t.t = {j} and d.{x} is not null)" for j, x in enumerate(v))
    tval = "case " + " ".join(f"when t.t = {j} then d.{x}" for j, x in enumerate(v)) + " end"
    mean = "case " + " ".join(
        f"when tk.t = {j} then (select sum(v{j} * mult) / sum(case when v{j} is not null then mult end) from vecs)"
        for j in range(4)
    ) + " end"
    keys = ", ".join(f"{c} as v{j}" for j, c in enumerate(KNN_COLS))
    ctes = {
        "qs": _limits_sql(0.25, 0.75),
        "lim": LIMITS_BODY,
        "lim_row": _lim_row_sql(),
        "wins": _winsor_sql(),
        "vecs": f"select {keys}, count(*) as mult from wins group by all",
        "rec": "select v0, v1, v2, v3 from vecs where v0 is null or v1 is null or v2 is null or v3 is null",
        "tasks": """select * from (select *, unnest([case when v0 is null then 0 end, case when v1 is null then 1 end,
  case when v2 is null then 2 end, case when v3 is null then 3 end]) as t from rec) where t is not null""",
        "cand": f"""select t.v0 as r0, t.v1 as r1, t.v2 as r2, t.v3 as r3, t.t, d.mult, {tval} as val,
  d.v0 as d0, d.v1 as d1, d.v2 as d2, d.v3 as d3,
  sqrt(cast(4 as double) / ({p.replace('r.', 't.')}) * ({ss.replace('r.', 't.')})) as dist
from tasks t join vecs d on ({target_present}) and ({p.replace('r.', 't.')}) > 0""",
        "ranked": """select *, sum(mult) over (partition by r0, r1, r2, r3, t
    order by dist, d0 nulls first, d1 nulls first, d2 nulls first, d3 nulls first
    rows between unbounded preceding and current row) as cum from cand""",
        "per_task": """select r0, r1, r2, r3, t,
  sum(greatest(least(mult, 5 - (cum - mult)), 0) * val) / sum(greatest(least(mult, 5 - (cum - mult)), 0)) as imp
from ranked group by r0, r1, r2, r3, t""",
        "filled": f"""select tk.v0, tk.v1, tk.v2, tk.v3, tk.t, coalesce(p.imp, {mean}) as imp
from tasks tk left join per_task p
  on tk.v0 is not distinct from p.r0 and tk.v1 is not distinct from p.r1
 and tk.v2 is not distinct from p.r2 and tk.v3 is not distinct from p.r3 and tk.t = p.t""",
        "imputed": """select v0, v1, v2, v3,
  coalesce(v0, max(case when t = 0 then imp end)) as n0, coalesce(v1, max(case when t = 1 then imp end)) as n1,
  coalesce(v2, max(case when t = 2 then imp end)) as n2, coalesce(v3, max(case when t = 3 then imp end)) as n3
from filled group by v0, v1, v2, v3""",
    }
    sel = ", ".join(
        f"round(coalesce(i.n{j}, w.{c}), 6) as {c}" for j, c in enumerate(KNN_COLS)
    )
    on = " and ".join(f"w.{c} is not distinct from i.v{j}" for j, c in enumerate(KNN_COLS))
    body = f"""
select w.order_id, w.order_item_id, w.payment_sequential, {sel}
from wins w left join imputed i on {on}"""
    return O.sql(body, upto="profiled", extra=ctes)


@register("knn_impute", _knn_sql())
def q_knn_impute(spark, sf_dir):
    t = _t(spark, sf_dir)
    capped = pipeline.capped_products(t, _num_cols(t))
    done = impute.knn_impute(capped, KNN_COLS, weight="sales_rows").drop("sales_rows")
    return pipeline.sales_with_products(t, done).select(
        "order_id", "order_item_id", "payment_sequential", *[F.round(c, 6).alias(c) for c in KNN_COLS]
    )
