"""SQL building blocks for the DuckDB oracle of every registered query.

Each oracle is plain SQL over the driver's tables: the fixture CTEs (the six
source tables), then CTEs that restate the reference semantics row by row (the
literal payment fan-out, the row drops, the cutoff split). The Spark side runs the
library's own plans; agreement of the two is the correctness check.
"""

from __future__ import annotations

from ..sources.fixtures import TEST_CUTOFF, with_fixture_ctes

CUTOFF_SQL = f"cast('{TEST_CUTOFF}' as timestamp)"

FANOUT_COLUMNS = """c.customer_id, c.customer_unique_id, c.customer_state,
       o.order_id, o.order_status, o.order_purchase_timestamp, o.order_approved_at,
       o.order_delivered_carrier_date, o.order_delivered_customer_date,
       p.payment_sequential, p.payment_installments, p.payment_value,
       i.order_item_id, i.product_id, i.price, i.freight_value,
       pr.product_category_name, pr.product_name_lenght, pr.product_description_lenght,
       pr.product_photos_qty, pr.product_weight_g, pr.product_length_cm, pr.product_height_cm,
       pr.product_width_cm, cat.product_category_name_english"""

SALES_FANOUT = f"""
select {FANOUT_COLUMNS}
from cv_customers c
join cv_orders o on c.customer_id = o.customer_id
join cv_payments p on o.order_id = p.order_id
join cv_items i on o.order_id = i.order_id
join cv_products pr on i.product_id = pr.product_id
left join cv_categories cat on pr.product_category_name is not distinct from cat.product_category_name"""

PROFILED = "select * from sales_fanout where order_purchase_timestamp is not null"

CLEAN_SALES = """
select *, price * order_item_id as total_price
from sales_fanout
where order_purchase_timestamp is not null
  and product_name_lenght is not null and product_description_lenght is not null
  and product_photos_qty is not null and product_category_name_english is not null
  and order_approved_at is not null"""

TRAIN = f"select * from clean_sales where order_purchase_timestamp < {CUTOFF_SQL}"
TEST = f"select * from clean_sales where order_purchase_timestamp >= {CUTOFF_SQL}"

FEATURES = """
select customer_unique_id,
       date_sub('day', max(order_purchase_timestamp),
                (select max(order_purchase_timestamp) from train)) as recency,
       count(distinct order_purchase_timestamp) as frequency,
       cast(coalesce(sum(cast(total_price as decimal(18,4))), 0) as double) as monetary,
       cast(coalesce(sum(cast(total_price as decimal(18,4))), 0) as double)
         / count(distinct order_purchase_timestamp) as avg_order_value,
       count(order_item_id) as total_items,
       case when count(price) > 0
            then cast(sum(cast(price as decimal(18,4))) as double) / cast(count(price) as double) end
         as avg_item_price,
       count(distinct product_category_name_english) as category_count,
       date_sub('day', min(order_purchase_timestamp), max(order_purchase_timestamp)) as tenure_days,
       case when count(*) > 1
            then cast(date_sub('day', min(order_purchase_timestamp), max(order_purchase_timestamp)) as double)
                 / cast(count(*) - 1 as double)
            else 0.0 end as purchase_interval,
       cast(count(distinct order_purchase_timestamp) > 1 as integer) as is_repeat_customer
from train
where customer_unique_id is not null
group by customer_unique_id
having count(distinct order_purchase_timestamp) > 0"""

REALIZED = """
select customer_unique_id,
       cast(coalesce(sum(cast(total_price as decimal(18,4))), 0) as double) as actual_cltv
from test where customer_unique_id is not null group by customer_unique_id"""

MODELING = """
select f.*, r.actual_cltv, ln(1 + r.actual_cltv) as cltv_log
from features f join realized r on f.customer_unique_id = r.customer_unique_id
where r.actual_cltv > 0"""

STAGES = {
    "sales_fanout": SALES_FANOUT,
    "profiled": PROFILED,
    "clean_sales": CLEAN_SALES,
    "train": TRAIN,
    "test": TEST,
    "features": FEATURES,
    "realized": REALIZED,
    "modeling": MODELING,
}


def sql(body: str, upto: str | None = "modeling", extra: dict[str, str] | None = None) -> str:
    """Oracle text: fixture CTEs, pipeline stages up to ``upto``, extra CTEs, body."""
    ctes: dict[str, str] = {}
    if upto:
        for name, text in STAGES.items():
            ctes[name] = text
            if name == upto:
                break
    ctes.update(extra or {})
    return with_fixture_ctes(body, ctes)


def list_quantile(v: str, p: float) -> str:
    """``np_quantile`` of a sorted list without nulls."""
    h = f"((cast(len({v}) as double) - 1) * {float(p)!r})"
    lo = f"cast(floor({h}) as bigint)"
    a, b = f"{v}[{lo} + 1]", f"{v}[least({lo} + 2, len({v}))]"
    t = f"({h} - floor({h}))"
    return f"(case when {t} >= 0.5 then {b} - ({b} - {a}) * (1 - {t}) else {a} + ({b} - {a}) * {t} end)"


def np_quantile(x: str, p: float) -> str:
    """Aggregate SQL for a linear quantile computed as NumPy does (order statistics
    from the sorted list, then ``a + (b-a)t`` or ``b - (b-a)(1-t)``)."""
    v = f"list_sort(list({x}) filter (where {x} is not null))"
    n = f"count({x})"
    h = f"((cast({n} as double) - 1) * {float(p)!r})"
    lo = f"cast(floor({h}) as bigint)"
    a = f"{v}[{lo} + 1]"
    b = f"{v}[least({lo} + 2, {n})]"
    t = f"({h} - floor({h}))"
    return f"(case when {t} >= 0.5 then {b} - ({b} - {a}) * (1 - {t}) else {a} + ({b} - {a}) * {t} end)"
