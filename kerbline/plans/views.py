"""Adapter views: the domain's tables read out of the driver's tables, in Spark and, for the checks, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.vocab import CLASSES, ORDER_STATUSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index.cast("int") + 1)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One defect an order: place, class, severity, dates, sightings and repair."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("last_ship"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    g = F.floor(cust / 2)
    lat = F.lit(46700000) + ((g * 37) % 1000) * 100 + (cust % 2) * 250 + (key % 7) * 10
    lon = F.lit(23500000) + ((g * 91) % 1500) * 100 + (key % 5) * 10
    first = F.col("o_orderdate").cast("date")
    fixed = F.when(key % 101 != 0, F.col("o_orderstatus") == "F")
    return o.select(
        key.alias("id"), (lat / 1e6).alias("latitude"), (lon / 1e6).alias("longitude"), pick(CLASSES, cust % 10).alias("damage_type"),
        F.when(key % 17 != 0, 6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("severity"), ((key % 1000) / 1000).alias("confidence"),
        first.alias("first_detected"), F.coalesce(F.col("last_ship").cast("date"), first).alias("last_detected"), F.coalesce("n", F.lit(1)).alias("detection_count"),
        fixed.alias("is_fixed"), F.when(fixed, F.date_add(first, (key % 60).cast("int"))).alias("fixed_on"), F.trunc(first, "month").alias("survey_date"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("city"), F.floor(F.greatest("c_acctbal", F.lit(0.0))).cast("long").alias("points_total"))


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("work_order_id"), pick(ORDER_STATUSES, F.col("s_suppkey") % 6).alias("status"), F.abs("s_acctbal").alias("cost_estimate_ron"))


def work_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("work_order_id"), F.col("l_orderkey").alias("detection_id")).distinct()


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").alias("box_id"), F.col("l_partkey").alias("part"), pick(CLASSES, F.col("l_partkey") % 10).alias("class_name"),
        F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("depth_norm"), (F.col("l_quantity") * 40).alias("surface_area_px"), (F.col("l_tax") * 25).alias("interior_contrast"),
        (F.col("l_extendedprice") / 1000).alias("edge_sharpness"), ((F.col("l_partkey") % 100) / 100).alias("confidence"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sightings and votes of devices at a few hundred places."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind = F.when(F.col("event_type") == "signup", "confirm").when(F.col("event_type") == "error", "dispute").otherwise("sighting")
    lat = F.lit(46700000) + (F.col("k") % 10) * 10000 + (F.col("user_id") % 8) * 1000 + (F.col("event_id") % 11) * 10
    lon = F.lit(23500000) + F.floor(F.col("k") / 10) * 10000
    return e.select(
        F.col("event_id").alias("report_id"), F.col("ts").alias("created_at"), F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), "user_id", kind.alias("kind"),
        (F.col("k") * 8 + F.col("user_id") % 8).cast("long").alias("event_id"), (lat / 1e6).alias("latitude"), (lon / 1e6).alias("longitude"), pick(CLASSES, F.col("k") % 10).alias("damage_type"),
        F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), (1 + F.col("event_id") % 5).cast("int").alias("severity"),
    )


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: The same views as common table expressions of DuckDB.
DUCK = {
    "v_detections": f"""v_detections as (
  select o_orderkey as id, (46700000 + (((o_custkey // 2) * 37) % 1000) * 100 + (o_custkey % 2) * 250 + (o_orderkey % 7) * 10) / 1e6 as latitude,
    (23500000 + (((o_custkey // 2) * 91) % 1500) * 100 + (o_orderkey % 5) * 10) / 1e6 as longitude, {_list(CLASSES)}[o_custkey % 10 + 1] as damage_type,
    case when o_orderkey % 17 <> 0 then 6 - cast(left(o_orderpriority, 1) as integer) end as severity, (o_orderkey % 1000) / 1000 as confidence,
    cast(o_orderdate as date) as first_detected, coalesce(cast(last_ship as date), cast(o_orderdate as date)) as last_detected, coalesce(n, 1) as detection_count,
    case when o_orderkey % 101 <> 0 then o_orderstatus = 'F' end as is_fixed,
    case when o_orderkey % 101 <> 0 and o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 60 as integer) end as fixed_on,
    cast(date_trunc('month', o_orderdate) as date) as survey_date
  from orders left join (select l_orderkey, count(*) as n, max(l_shipdate) as last_ship from lineitem group by l_orderkey) on o_orderkey = l_orderkey)""",
    "v_users": "v_users as (select c_custkey as user_id, n_name as city, cast(floor(greatest(c_acctbal, 0.0)) as bigint) as points_total from customer join nation on c_nationkey = n_nationkey)",
    "v_work_orders": f"v_work_orders as (select s_suppkey as work_order_id, {_list(ORDER_STATUSES)}[s_suppkey % 6 + 1] as status, abs(s_acctbal) as cost_estimate_ron from supplier)",
    "v_items": "v_items as (select distinct l_suppkey as work_order_id, l_orderkey as detection_id from lineitem)",
    "v_boxes": f"""v_boxes as (
  select l_orderkey as frame_id, l_linenumber as box_id, l_partkey as part, {_list(CLASSES)}[l_partkey % 10 + 1] as class_name, least(l_discount * 10, 1.0) as depth_norm,
    l_quantity * 40 as surface_area_px, l_tax * 25 as interior_contrast, l_extendedprice / 1000 as edge_sharpness, (l_partkey % 100) / 100 as confidence from lineitem)""",
    "v_reports": f"""v_reports as (
  select event_id as report_id, ts as created_at, 'dev-' || user_id as device_id, user_id, case event_type when 'signup' then 'confirm' when 'error' then 'dispute' else 'sighting' end as kind,
    k * 8 + user_id % 8 as event_id, (46700000 + (k % 10) * 10000 + (user_id % 8) * 1000 + (event_id % 11) * 10) / 1e6 as latitude, (23500000 + (k // 10) * 10000) / 1e6 as longitude,
    {_list(CLASSES)}[k % 10 + 1] as damage_type, least(value / 500, 1.0) as confidence, cast(1 + event_id % 5 as integer) as severity
  from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))""",
}


def duck(*names: str, body: str) -> str:
    """DuckDB SQL over these views; body may go on with further common table expressions."""
    glue = "" if body.lstrip().lower().startswith("select") else ","
    return "with " + ",\n".join(DUCK[n] for n in names) + glue + "\n" + body
