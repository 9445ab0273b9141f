"""Smaller operators: guards, schedules, splits, theta joins against small sides, merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline.functions import geo
from kerbline.operators import assistant, spatial, statistics
from kerbline.plans import views as V
from kerbline.plans.queries_detections import det, metres
from kerbline.plans.registry import query
from kerbline.plans.views import duck

_TOPIC = "|".join(w for w in assistant.TOPIC_WORDS if len(w) >= 4)
_SHORT = ", ".join(f"'{w}'" for w in assistant.TOPIC_WORDS)
# DuckDB's patterns look nowhere ahead: the last one is taken apart by hand
_INJECTED = " or ".join(f"regexp_matches(q, '{p}')" for p in assistant.INJECTION if "(?!" not in p)
_INJECTED += r" or regexp_matches(q, 'act\s+as\s+(a|an)\s\s') or len(list_filter(regexp_extract_all(q, 'act\s+as\s+(?:a|an)\s\S{1,4}'), lambda x: not regexp_matches(x, '\s(road|city)$'))) > 0"


@query("flt_18_guard", f"with t as (select doc_id, lower(substr(trim(text), 1, 500)) as q from documents) select doc_id, case when length(q) = 0 then 'empty' when {_INJECTED} then 'injection' when len(list_filter(regexp_extract_all(q, '[a-z]+'), lambda w: w in ({_SHORT}) or regexp_matches(w, '^({_TOPIC})'))) > 0 or regexp_matches(q, 'work order|sign in|log in') or regexp_matches(q, '\\bs[1-5]\\b') then 'ok' else 'offTopic' end as verdict from t")
def flt_18(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", assistant.verdict(F.col("text")).alias("verdict"))


def _has(words) -> str:
    return "(" + " or ".join(f"contains(q, '{w}')" for w in words) + ")"


_KINDS = " ".join(f"when {' and '.join(map(_has, groups))} then '{name}'" for name, groups in assistant.INTENTS)


@query("ret_06_intents", f"with t as (select doc_id, ' ' || lower(trim(text)) || ' ' as q from documents) select doc_id, case when regexp_matches(q, '\\bs\\s*[1-5]\\b') then 'severity' {_KINDS} end as intent from t")
def ret_06(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", assistant.intent(F.col("text")).alias("intent"))


@query("ret_04_gates", "with s as (select event_id, (event_id % 70) / 2000.0 as score from events) select event_id, case when event_id % 11 > 0 and score / (2.0::double / 61) >= 0.55 then 'answer' when event_id % 11 > 0 and score / (2.0::double / 61) >= 0.28 then 'hedge' else 'refuse' end as gate from s")
def ret_04(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", assistant.gate(F.when(F.col("event_id") % 11 > 0, (F.col("event_id") % 70) / 2000.0)).alias("gate"))


_SAYS = ", ".join(f"'{k}': '{v}'" for k, v in assistant.SYNONYMS.items())


@query("sc_str_05_synonyms", f"with d as (select p_partkey, ['a broken', 'Pay for holes and a hole', 'no match at all', 'TOWN council photo'][p_partkey % 4 + 1] || ' ' || p_type as q from part), m as (select p_partkey, q, list_distinct(list_filter(list_transform(regexp_extract_all(lower(q), '[a-z]+'), lambda w: map {{{_SAYS}}}[w]), lambda x: x is not null)) as more from d) select p_partkey, array_to_string(list_sort(string_split(q || case when len(more) > 0 then ' ' || array_to_string(more, ' ') else '' end, ' ')), ' ') as words from m")
def sc_str_05(spark, sf):
    p = V.table(spark, sf, "part")
    q = F.concat(V.pick(("a broken", "Pay for holes and a hole", "no match at all", "TOWN council photo"), F.col("p_partkey") % 4), F.lit(" "), F.col("p_type"))
    return p.select("p_partkey", F.array_join(F.array_sort(F.split(assistant.expanded(q), " ")), " ").alias("words"))


@query("jn_11_points_in_reach", det(f"h as (select n_nationkey as h, 46.70 + n_nationkey * 0.004 as la, 23.50 + n_nationkey * 0.006 as lo from nation) select id, h from v_detections, h where {metres('latitude', 'longitude', 'la', 'lo')} <= 300"))
def jn_11(spark, sf):
    k = F.col("n_nationkey")
    h = V.table(spark, sf, "nation").select(k.alias("h"), (46.70 + k * 0.004).alias("lat"), (23.50 + k * 0.006).alias("lon"))
    d = V.detections(spark, sf).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return spatial.within(d, h, 300).select("l.id", "r.h")


@query("jn_12_nearest_place", det(f"h as (select n_nationkey as h, 46.70 + n_nationkey * 0.004 as la, 23.50 + n_nationkey * 0.006 as lo from nation), d as (select id, h, round({metres('latitude', 'longitude', 'la', 'lo')}, 3) as m from v_detections, h) select id, h from (select *, row_number() over (partition by id order by m, h) as r from d) where r = 1"))
def jn_12(spark, sf):
    k = F.col("n_nationkey")
    h = V.table(spark, sf, "nation").select(k.alias("id"), (46.70 + k * 0.004).alias("lat"), (23.50 + k * 0.006).alias("lon"))
    d = V.detections(spark, sf).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return spatial.nearest_of_all(d, h).select("id", F.col("target_id").alias("h"))


@query("jn_16_schema_codes", "select p_partkey as source, min(p_partkey) over (partition by p_brand, p_type) as target from part")
def jn_16(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    codes = p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("target"))
    return p.withColumnRenamed("p_partkey", "source").join(codes, ["p_brand", "p_type"]).select("source", "target")


@query("agg_20_breakdown", det("select count(*) filter (where latitude > 46.75) as north, count(*) filter (where severity is null) as unrated, count(*) filter (where is_fixed is null) as unknown, count(*) as total from v_detections"))
def agg_20(spark, sf):
    return V.detections(spark, sf).agg(F.count_if(F.col("latitude") > 46.75).alias("north"), F.count_if(F.col("severity").isNull()).alias("unrated"), F.count_if(F.col("is_fixed").isNull()).alias("unknown"), F.count("*").alias("total"))


@query("agg_23_mean_per_class", "select l_suppkey % 5 as experiment, l_partkey % 10 as class, round(avg(l_discount), 9) as mean from lineitem group by all")
def agg_23(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("experiment"), (F.col("l_partkey") % 10).alias("class")).agg(F.round(F.avg("l_discount"), 9).alias("mean"))


@query("agg_39_mean_rates", "select l_suppkey % 7 as experiment, round(avg(l_discount), 9) as p, round(avg(l_tax), 9) as r from lineitem group by 1")
def agg_39(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("experiment")).agg(F.round(F.avg("l_discount"), 9).alias("p"), F.round(F.avg("l_tax"), 9).alias("r"))


@query("agg_43_ids_by_variant", "select p_brand, list(p_partkey order by p_partkey) as parts from part group by p_brand")
def agg_43(spark, sf):
    return V.table(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("parts"))


@query("agg_44_winner", "select p_brand, p_partkey, p_retailprice from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as r from part) where r = 1")
def agg_44(spark, sf):
    best = V.table(spark, sf, "part").groupBy("p_brand").agg(F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("b"))
    return best.select("p_brand", (-F.col("b.k")).alias("p_partkey"), "b.p_retailprice")


@query("flt_19_expired", "select event_id from events where event_type = 'click' and ts < timestamp '2024-01-10'")
def flt_19(spark, sf):
    return V.table(spark, sf, "events").where("event_type = 'click' and ts < timestamp_ntz '2024-01-10'").select("event_id")


@query("win_12_train_val", "with g as (select o_orderkey as group_id, o_orderpriority as stratum, row_number() over w - 1 as i, count(*) over (partition by o_orderpriority) as n from orders window w as (partition by o_orderpriority order by md5(cast(o_orderkey as varchar)), o_orderkey)) select group_id, case when i < case when n >= 2 and round(n * 0.8) >= n then n - 1 else round(n * 0.8) end then 'train' else 'val' end as split from g")
def win_12(spark, sf):
    g = statistics.placed(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("stratum")))
    train = F.round(F.col("n") * 0.8)
    train = F.when((F.col("n") >= 2) & (train >= F.col("n")), F.col("n") - 1).otherwise(train)
    return g.select("group_id", F.when(F.col("i") < train, "train").otherwise("val").alias("split"))


@query("win_18_ablations", "with m as (select l_suppkey % 4 as e, l_partkey % 10 as class, avg(l_discount) as v from lineitem group by all) select m.e, m.class, round(m.v - b.v, 9) as delta from m join m b on b.class = m.class and b.e = 0 where m.e > 0")
def win_18(spark, sf):
    m = V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 4).alias("e"), (F.col("l_partkey") % 10).alias("class")).agg(F.avg("l_discount").alias("v"))
    base = m.where("e = 0").select("class", F.col("v").alias("b"))
    return m.where("e > 0").join(base, "class").select("e", "class", F.round(F.col("v") - F.col("b"), 9).alias("delta"))


@query("wr_07_promoted", duck("v_reports", body="e as (select event_id, count(distinct device_id) filter (where kind <> 'dispute') as s, max(confidence) as c, min(created_at) as first_seen from v_reports group by event_id) select 1000000 + event_id as id, coalesce(c, 0.5) as confidence, greatest(s, 1) as detection_count, cast(first_seen as date) as first_detected from e where s >= 3"))
def wr_07(spark, sf):
    e = V.reports(spark, sf).groupBy("event_id").agg(F.countDistinct(F.when(F.col("kind") != "dispute", F.col("device_id"))).alias("s"), F.max("confidence").alias("c"), F.min("created_at").alias("first_seen"))
    return e.where("s >= 3").select((F.col("event_id") + 1000000).alias("id"), F.coalesce("c", F.lit(0.5)).alias("confidence"), F.greatest("s", F.lit(1)).cast("long").alias("detection_count"), F.col("first_seen").cast("date").alias("first_detected"))


@query("sc_geo_04_dms", "select p_partkey, round((case when p_partkey % 2 = 0 then -1 else 1 end) * (p_size + (p_partkey % 60) / 60 + (p_partkey % 59) / 3600), 9) as degrees from part")
def sc_geo_04(spark, sf):
    k = F.col("p_partkey")
    return V.table(spark, sf, "part").select("p_partkey", F.round(geo.dms(F.col("p_size"), k % 60, k % 59, F.when(k % 2 == 0, "S").otherwise("N")), 9).alias("degrees"))


@query("sc_dt_05_lenient_times", "select o_orderkey, o_orderdate as t from orders")
def sc_dt_05(spark, sf):
    """Each date is written in one of four forms and read back."""
    from kerbline.sources.tracks import when

    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    text = F.when(k % 4 == 0, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).when(k % 4 == 1, F.date_format(d, "yyyy/MM/dd HH:mm:ss")).when(k % 4 == 2, F.date_format(d, "dd.MM.yyyy HH:mm:ss")).otherwise(F.unix_seconds(d).cast("string"))
    return V.table(spark, sf, "orders").select("o_orderkey", when(text).cast("timestamp_ntz").alias("t"))


@query("sc_dt_08_sampling", "select n_nationkey, i, (i + 0.5::double) / 8 as middle from nation, range(8) t(i)")
def sc_dt_08(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return n.select("n_nationkey", F.col("i").cast("long").alias("i"), ((F.col("i") + 0.5) / 8).alias("middle"))


@query("sc_str_06_djb2", "select p_partkey, list_reduce(list_prepend(5381::bigint, list_transform(string_split(p_brand, ''), lambda c: ascii(c)::bigint)), lambda h, c: (h * 33 + c) % 4294967296) as h from part")
def sc_str_06(spark, sf):
    chars = F.split("p_brand", "")
    return V.table(spark, sf, "part").select("p_partkey", F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)) % 4294967296).alias("h"))


@query("sc_arr_01_positions", "select l_orderkey, list_position(list(l_partkey order by l_linenumber, l_partkey), max(l_partkey)) as at from lineitem group by l_orderkey")
def sc_arr_01(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("p"), F.max("l_partkey").alias("m"))
    return g.select("l_orderkey", F.array_position(F.transform("p", lambda x: x["l_partkey"]), F.col("m")).alias("at"))


@query("sc_arr_03_bounds", det("select damage_type, min(latitude) as y0, min(longitude) as x0, max(latitude) as y1, max(longitude) as x1 from v_detections group by damage_type"))
def sc_arr_03(spark, sf):
    return V.detections(spark, sf).groupBy("damage_type").agg(F.min("latitude").alias("y0"), F.min("longitude").alias("x0"), F.max("latitude").alias("y1"), F.max("longitude").alias("x1"))


@query("sc_cond_07_precedence", "select coalesce(a.k, b.k) as k, coalesce(a.s, case b.s when 'P' then 'initialising' else b.s end, 'none') as status from (select o_custkey as k, max(o_orderstatus) as s from orders where o_orderkey % 3 = 0 group by 1) a full join (select o_custkey as k, max(o_orderstatus) as s from orders where o_orderkey % 3 = 1 group by 1) b on a.k = b.k")
def sc_cond_07(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    a, b = (o.where(f"o_orderkey % 3 = {r}").groupBy("k").agg(F.max("o_orderstatus").alias(n)) for r, n in ((0, "a"), (1, "b")))
    return a.join(b, "k", "full").select("k", F.coalesce("a", F.when(F.col("b") == "P", "initialising").otherwise(F.col("b")), F.lit("none")).alias("status"))


@query("sc_cond_08_drift", "select l_orderkey, sum(l_extendedprice) > 1.35 * (sum(l_quantity) * 1500) as drifted from lineitem group by l_orderkey")
def sc_cond_08(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.sum("l_extendedprice") > 1.35 * (F.sum("l_quantity") * 1500)).alias("drifted"))


@query("stat_09_registry_problems", "select 'no order' as problem, count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders) union all select 'no lines', count(*) from orders where o_orderkey not in (select l_orderkey from lineitem)")
def stat_09(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    a = li.join(o, "k", "left_anti").agg(F.lit("no order").alias("problem"), F.count("*").alias("n"))
    return a.unionByName(o.join(li, "k", "left_anti").agg(F.lit("no lines").alias("problem"), F.count("*").alias("n")))


@query("win_17_anchors", "select p_partkey, p_size, p_retailprice, max(p_retailprice) over (partition by p_size) as anchor from part")
def win_17(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.max("p_retailprice").over(Window.partitionBy("p_size")).alias("anchor"))


@query("wr_12_item_edit", duck("v_items", body="kept as (select work_order_id, detection_id from v_items where work_order_id = 3 and detection_id % 2 = 0), added as (select 3 as work_order_id, o_orderkey as detection_id from orders where o_orderkey % 500 = 1 and o_orderkey not in (select detection_id from kept)) select * from kept union all select * from added"))
def wr_12(spark, sf):
    kept = V.work_order_items(spark, sf).where("work_order_id = 3 and detection_id % 2 = 0")
    added = V.table(spark, sf, "orders").where("o_orderkey % 500 = 1").select(F.lit(3).cast("long").alias("work_order_id"), F.col("o_orderkey").alias("detection_id")).join(kept.select("detection_id"), "detection_id", "left_anti")
    return kept.unionByName(added)


@query("sc_dt_06_clock_shift", "select event_id, case when abs(d - round(d / 3600) * 3600) < 45 then cast(round(d / 3600) as bigint) end as hours from (select event_id, value * 97 as d from events)")
def sc_dt_06(spark, sf):
    d = F.col("value") * 97
    return V.table(spark, sf, "events").select("event_id", F.when(F.abs(d - F.round(d / 3600) * 3600) < 45, F.round(d / 3600).cast("long")).alias("hours"))
