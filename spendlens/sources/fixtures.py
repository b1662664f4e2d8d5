"""The driver's generated tables seen in the shape of the six source tables.

The generated data has no payments, no nulls and no outliers in the columns the
model reads, so key-modulo rules derive them. The rules are fixed values of the
test setup (see FIXTURES.md). ``fixture_tables`` builds them with the DataFrame API;
``FIXTURE_SQL`` holds the same derivation as SQL text for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Tables, spread

RAW_TABLES = ("customer", "nation", "orders", "lineitem", "part")
# Key each scan is spread on when the file is narrower than the cluster. The
# dimension tables are included: when AQE broadcasts the (measured-small) fact
# sides, a dimension becomes the streamed side and must not be a single task.
SPREAD_KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey"],
    "part": ["p_partkey"],
}

# Test cutoff for the generated data (orders span 1995-01-01 .. 2001-08-01).
TEST_CUTOFF = "2000-01-01"


_RAW: dict[tuple, dict[str, DataFrame]] = {}


def read_raw(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The driver's tables as parquet scans. The DataFrame objects (plans, not
    data) are reused per session and folder, so schema discovery runs once."""
    base = sf_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, base)
    if key not in _RAW:
        raw = {n: spark.read.parquet(f"{base}/{n}.parquet") for n in RAW_TABLES}
        _RAW[key] = {n: spread(df, SPREAD_KEYS[n]) if n in SPREAD_KEYS else df for n, df in raw.items()}
    return _RAW[key]


def _keep_unless(cond: Column, value: Column) -> Column:
    return F.when(~cond, value)


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    raw = read_raw(spark, sf_dir)
    c, n, o, li, p = (raw[k] for k in RAW_TABLES)

    customers = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        (F.col("c_custkey") - F.col("c_custkey") % 2).cast("bigint").cast("string").alias("customer_unique_id"),
        F.col("n_name").alias("customer_state"),
    )

    ts = F.col("o_orderdate")
    orders = o.select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderstatus").alias("order_status"),
        F.when(F.col("o_orderkey") % 211 != 0, ts).alias("order_purchase_timestamp"),
        F.when(F.col("o_orderkey") % 50 != 0, ts).alias("order_approved_at"),
        F.when(F.col("o_orderstatus") != "P", ts).alias("order_delivered_carrier_date"),
        F.when(F.col("o_orderstatus") == "F", ts).alias("order_delivered_customer_date"),
    )

    # One payment row per order, a second one for every fifth order.
    def _pay(seq: int, paid: DataFrame) -> DataFrame:
        return paid.select(
            F.col("o_orderkey").cast("string").alias("order_id"),
            F.lit(seq).alias("payment_sequential"),
            (1 + F.col("o_orderkey") % 6).cast("int").alias("payment_installments"),
            (F.col("o_totalprice") / 2).alias("payment_value"),
        )

    payments = _pay(1, o).unionByName(_pay(2, o.where(F.col("o_orderkey") % 5 == 0)))

    items = li.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.when(F.col("l_quantity") != 50, F.col("l_extendedprice")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).cast("double").alias("freight_value"),
    )

    k = F.col("p_partkey")
    text_null = k % 37 == 0
    products = p.select(
        k.cast("string").alias("product_id"),
        F.when(k % 31 != 0, F.col("p_name")).alias("product_category_name"),
        _keep_unless(text_null, F.length("p_name") + k % 40).cast("double").alias("product_name_lenght"),
        _keep_unless(text_null, 100 + k * 7 % 900).cast("double").alias("product_description_lenght"),
        _keep_unless(text_null, 1 + k % 6).cast("double").alias("product_photos_qty"),
        F.when(k % 97 == 0, F.lit(None))
        .when(k % 53 == 0, F.lit(40000))
        .otherwise(F.col("p_size") * 100 + k % 90)
        .cast("double")
        .alias("product_weight_g"),
        F.when((k % 97 == 0) | (k % 89 == 0), F.lit(None))
        .when(k % 59 == 0, F.lit(900))
        .otherwise(10 + k * 13 % 60)
        .cast("double")
        .alias("product_length_cm"),
        _keep_unless((k % 97 == 0) | (k % 83 == 0), 2 + k * 11 % 40).cast("double").alias("product_height_cm"),
        _keep_unless(k % 97 == 0, 6 + k * 17 % 50).cast("double").alias("product_width_cm"),
    )

    categories = (
        p.where(~F.col("p_name").startswith("red "))
        .select(
            F.col("p_name").alias("product_category_name"),
            F.upper("p_name").alias("product_category_name_english"),
        )
        .distinct()
    )
    return Tables(customers, orders, payments, items, products, categories)


# The same derivation as SQL (DuckDB and Spark SQL), used as CTEs by the oracle.
FIXTURE_SQL: dict[str, str] = {
    "cv_customers": """
select cast(c_custkey as varchar) as customer_id,
       cast(cast(c_custkey - c_custkey % 2 as bigint) as varchar) as customer_unique_id,
       n_name as customer_state
from customer join nation on c_nationkey = n_nationkey""",
    "cv_orders": """
select cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id, o_orderstatus as order_status,
       case when o_orderkey % 211 <> 0 then o_orderdate end as order_purchase_timestamp,
       case when o_orderkey % 50 <> 0 then o_orderdate end as order_approved_at,
       case when o_orderstatus <> 'P' then o_orderdate end as order_delivered_carrier_date,
       case when o_orderstatus = 'F' then o_orderdate end as order_delivered_customer_date
from orders""",
    "cv_payments": """
select cast(o_orderkey as varchar) as order_id, 1 as payment_sequential,
       cast(1 + o_orderkey % 6 as int) as payment_installments, o_totalprice / 2 as payment_value
from orders
union all
select cast(o_orderkey as varchar) as order_id, 2 as payment_sequential,
       cast(1 + o_orderkey % 6 as int) as payment_installments, o_totalprice / 2 as payment_value
from orders where o_orderkey % 5 = 0""",
    "cv_items": """
select cast(l_orderkey as varchar) as order_id, l_linenumber as order_item_id,
       cast(l_partkey as varchar) as product_id,
       case when l_quantity <> 50 then l_extendedprice end as price,
       cast(l_extendedprice * l_tax as double) as freight_value
from lineitem""",
    "cv_products": """
select cast(p_partkey as varchar) as product_id,
       case when p_partkey % 31 <> 0 then p_name end as product_category_name,
       cast(case when p_partkey % 37 <> 0 then length(p_name) + p_partkey % 40 end as double) as product_name_lenght,
       cast(case when p_partkey % 37 <> 0 then 100 + p_partkey * 7 % 900 end as double) as product_description_lenght,
       cast(case when p_partkey % 37 <> 0 then 1 + p_partkey % 6 end as double) as product_photos_qty,
       cast(case when p_partkey % 97 = 0 then null when p_partkey % 53 = 0 then 40000
                 else p_size * 100 + p_partkey % 90 end as double) as product_weight_g,
       cast(case when p_partkey % 97 = 0 or p_partkey % 89 = 0 then null when p_partkey % 59 = 0 then 900
                 else 10 + p_partkey * 13 % 60 end as double) as product_length_cm,
       cast(case when p_partkey % 97 = 0 or p_partkey % 83 = 0 then null
                 else 2 + p_partkey * 11 % 40 end as double) as product_height_cm,
       cast(case when p_partkey % 97 = 0 then null
                 else 6 + p_partkey * 17 % 50 end as double) as product_width_cm
from part""",
    "cv_categories": """
select distinct p_name as product_category_name, upper(p_name) as product_category_name_english
from part where p_name not like 'red %'""",
}


def with_fixture_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a query with the fixture views (and further named CTEs, in order)."""
    parts = [f"{name} as ({sql}\n)" for name, sql in FIXTURE_SQL.items()]
    for name, sql in (extra or {}).items():
        parts.append(f"{name} as materialized ({sql}\n)")
    return "with " + ",\n".join(parts) + "\n" + body
