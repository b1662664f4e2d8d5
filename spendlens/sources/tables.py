"""The six input tables of the customer-value model and how they are read.

CSV files carry a header row; types are declared, never inferred, so a scan of many
files does not need an extra pass and a malformed value fails the job (``FAILFAST``)
the way a strict parser would.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STR, DBL, INT, TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Fixed column names of the source data (misspellings "..._lenght" are part of it).
SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", STR), ("customer_unique_id", STR), ("customer_zip_code_prefix", STR),
        ("customer_city", STR), ("customer_state", STR),
    ),
    "orders": _schema(
        ("order_id", STR), ("customer_id", STR), ("order_status", STR),
        ("order_purchase_timestamp", TS), ("order_approved_at", TS),
        ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
        ("order_estimated_delivery_date", TS),
    ),
    "payments": _schema(
        ("order_id", STR), ("payment_sequential", INT), ("payment_type", STR),
        ("payment_installments", INT), ("payment_value", DBL),
    ),
    "items": _schema(
        ("order_id", STR), ("order_item_id", INT), ("product_id", STR), ("seller_id", STR),
        ("shipping_limit_date", TS), ("price", DBL), ("freight_value", DBL),
    ),
    "products": _schema(
        ("product_id", STR), ("product_category_name", STR), ("product_name_lenght", DBL),
        ("product_description_lenght", DBL), ("product_photos_qty", DBL), ("product_weight_g", DBL),
        ("product_length_cm", DBL), ("product_height_cm", DBL), ("product_width_cm", DBL),
    ),
    "categories": _schema(("product_category_name", STR), ("product_category_name_english", STR)),
}

# Fixed file names of the public source data set, one CSV per table.
CSV_FILES: dict[str, str] = {
    "customers": "olist_customers_dataset.csv",
    "orders": "olist_orders_dataset.csv",
    "payments": "olist_order_payments_dataset.csv",
    "items": "olist_order_items_dataset.csv",
    "products": "olist_products_dataset.csv",
    "categories": "product_category_name_translation.csv",
}

TABLE_NAMES = tuple(SCHEMAS)


@dataclass(frozen=True)
class Tables:
    """The six relational inputs; any DataFrames with the columns of ``SCHEMAS``."""

    customers: DataFrame
    orders: DataFrame
    payments: DataFrame
    items: DataFrame
    products: DataFrame
    categories: DataFrame

    def as_dict(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in TABLE_NAMES}


def read_tables(
    spark: SparkSession,
    base_dir: str,
    fmt: str = "csv",
    files: dict[str, str] | None = None,
    mode: str = "FAILFAST",
) -> Tables:
    """O-01: scan the six tables from ``base_dir``.

    ``fmt='csv'`` reads header CSVs with the declared schema; ``fmt='parquet'`` reads
    ``<table>.parquet`` (schema from the files, column pruning and filter pushdown
    reach the scan either way).
    """
    base = base_dir.rstrip("/")
    out = {}
    for name in TABLE_NAMES:
        if fmt == "csv":
            path = f"{base}/{(files or CSV_FILES)[name]}"
            out[name] = (
                spark.read.schema(SCHEMAS[name])
                .option("header", True)
                .option("mode", mode)
                .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
                .csv(path)
            )
        elif fmt == "parquet":
            path = f"{base}/{(files or {}).get(name, name + '.parquet')}"
            out[name] = spark.read.parquet(path)
        else:
            raise ValueError(f"unsupported format {fmt!r}")
    return Tables(**out)


CORRUPT = "_corrupt_record"


def read_with_quarantine(
    spark: SparkSession, base_dir: str, files: dict[str, str] | None = None, header: bool = True
) -> tuple[Tables, DataFrame, DataFrame]:
    """O-01 for files that may be damaged: the six CSV tables without their bad rows, the bad
    rows ``(table_name, file_name, record, reason)``, and rows per file
    ``(table_name, file_name, n_rows, n_good, n_bad)``.

    A row is bad if it has too few or too many fields or a field that is no value of its
    column's type. The reason names the first such column, or the number of fields. Every
    column is parsed whatever is selected, so a row is good or bad for all readers alike.
    """
    base = base_dir.rstrip("/")
    good, bad, counts = {}, None, None
    for name in TABLE_NAMES:
        schema = SCHEMAS[name]
        raw = (
            spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, STR)]))
            .option("header", header)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .csv(f"{base}/{(files or CSV_FILES)[name]}")
        )
        raw = raw.select("*", F.col("_metadata.file_name").alias("_file"))
        # A column that nobody selects is not parsed and can't be bad: the test reads them all.
        every = F.hash(*[F.col(f.name) for f in schema.fields]).bitwiseAND(F.lit(0)) == 0
        wrong = F.col(CORRUPT).isNotNull() & every
        good[name] = raw.where(F.col(CORRUPT).isNull() & every).drop(CORRUPT, "_file")
        rows = raw.where(wrong).select(
            F.lit(name).alias("table_name"), F.col("_file").alias("file_name"), F.col(CORRUPT).alias("record"), _reason(schema).alias("reason")
        )
        per_file = raw.groupBy(F.lit(name).alias("table_name"), F.col("_file").alias("file_name")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(CORRUPT).isNull() & every).alias("n_good"), F.count_if(wrong).alias("n_bad")
        )
        bad = rows if bad is None else bad.unionAll(rows)
        counts = per_file if counts is None else counts.unionAll(per_file)
    return Tables(**good), bad, counts


def _reason(schema: T.StructType) -> Column:
    """Why the text of a record does not fit the schema."""
    n = len(schema.fields)
    names = [f"f{i}" for i in range(n + 1)]
    fields = F.from_csv(F.col(CORRUPT), ", ".join(f"{x} string" for x in names), {"mode": "PERMISSIVE"})
    n_fields = sum((fields[x].isNotNull().cast("int") for x in names), F.lit(0))
    found = None
    for x, f in zip(names, schema.fields):
        if isinstance(f.dataType, T.StringType):
            continue
        fits = fields[x].isNull() | fields[x].try_cast(f.dataType).isNotNull()
        text = F.lit(f"{f.name} is no {f.dataType.simpleString()}")
        found = F.when(~fits, text) if found is None else found.when(~fits, text)
    shape = F.when(fields[names[n]].isNotNull(), F.lit(f"more than {n} fields"))
    shape = shape.when(n_fields < n, F.lit(f"fewer than {n} fields")).otherwise(F.lit("unreadable"))
    return F.coalesce(F.when(fields[names[n]].isNotNull(), shape), found, shape) if found is not None else shape


def spread(df: DataFrame, keys: list[str] | tuple[str, ...] = (), min_partitions: int | None = None) -> DataFrame:
    """Give a scan at least ``min_partitions`` (default: the cluster's parallelism).

    A table stored as one file with one row group is read by one task, and every
    narrow operator after it (joins against broadcast sides, projections, partial
    aggregates) runs in that task. When the scan is narrower than the cluster, it is
    hash-partitioned on ``keys`` (no sort, unlike a round-robin split, and already
    laid out for a join on that key); when it is already wide (the normal case for
    large inputs) nothing changes. Filters and column pruning still reach the scan.
    """
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n, *keys) if keys else df.repartition(n)
    return df


def write_tables(tables: Tables, base_dir: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """The only sink: each table as parquet (or header CSV) under ``base_dir``."""
    base = base_dir.rstrip("/")
    for name, df in tables.as_dict().items():
        if fmt == "csv":
            df.write.mode(mode).option("header", True).option(
                "timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"
            ).csv(f"{base}/{CSV_FILES[name]}")
        else:
            df.write.mode(mode).parquet(f"{base}/{name}.parquet")
