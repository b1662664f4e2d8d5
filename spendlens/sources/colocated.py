"""Orders, payments and items stored in buckets of the order id (O-13..15).

The three fact tables are written once, each hash-bucketed and sorted by ``order_id`` into
the same number of buckets, orders together with their customer. A join on ``order_id`` then
meets bucket by bucket: no exchange of facts, in any later query.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from ..operators import assemble
from .tables import Tables

FACTS = ("orders", "payments", "items")


def _table_name(base: str, name: str) -> str:
    return f"colocated_{hashlib.md5(base.encode()).hexdigest()[:12]}_{name}"


def _create(spark: SparkSession, base: str, name: str, columns: str, buckets: int) -> str:
    table = _table_name(base, name)
    spark.sql(f"drop table if exists {table}")  # an external table: its files stay
    spark.sql(
        f"create table {table} ({columns}) using parquet clustered by (order_id) "
        f"sorted by (order_id) into {int(buckets)} buckets location '{base}/{name}'"
    )
    return table


def write_colocated(t: Tables, base_dir: str, buckets: int) -> None:
    """Write the facts of ``t`` under ``base_dir``, in ``buckets`` buckets each, and their layout.
    Files are laid out by bucket first, so each bucket is one file, not one for each task."""
    base = base_dir.rstrip("/")
    frames = {"orders": t.orders.join(t.customers, "customer_id"), "payments": t.payments, "items": t.items}
    spark = t.orders.sparkSession
    layout = []
    for name, df in frames.items():
        writer = df.repartition(buckets, "order_id").write.mode("overwrite").format("parquet")
        table = _table_name(base, name)
        spark.sql(f"drop table if exists {table}")
        writer.bucketBy(buckets, "order_id").sortBy("order_id").option("path", f"{base}/{name}").saveAsTable(table)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        layout.append((name, columns, buckets))
    spark.createDataFrame(layout, "name string, columns string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{base}/layout")


def read_colocated(spark: SparkSession, base_dir: str) -> dict[str, DataFrame]:
    """The stored facts by name, in this session's catalog with their buckets (also where
    another session wrote them)."""
    base = base_dir.rstrip("/")
    layout = spark.read.parquet(f"{base}/layout").collect()  # a row per table
    return {r["name"]: spark.table(_create(spark, base, r["name"], r["columns"], r["buckets"])) for r in layout}


def denormalize_colocated(t: Tables, facts: dict[str, DataFrame], payment_fanout: bool = True) -> DataFrame:
    """``assemble.denormalize`` over stored facts: the joins on ``order_id`` need no exchange.
    ``t`` gives the dimensions and the order of the columns."""
    return assemble.denormalize(t, payment_fanout, facts)
