"""Queries: boxes in their JSON forms, depth and shape, estimates, text forms, datasets, experiments and jobs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from kerbline.functions import rules
from kerbline.operators import experiments, similarity
from kerbline.plans import views as V
from kerbline.plans.queries_joins import _PHASH, phashes
from kerbline.plans.registry import query
from kerbline.plans.views import duck
from kerbline.sources import labels

_KIND = "(l_partkey + l_linenumber) % 6"


def _boxes(spark, sf):
    """Boxes of lineitem as JSON texts in six forms."""
    li = V.table(spark, sf, "lineitem").withColumn("k", (F.col("l_partkey") + F.col("l_linenumber")) % 6)
    n, s = F.col("l_linenumber").cast("string"), F.format_string
    severity = (
        F.when(F.col("k") == 0, s('"severity": {"severity_level": "S%s", "severity_confidence": %s}', n, F.col("l_discount").cast("string"))).when(F.col("k") == 1, s('"severity": %s', n))
        .when(F.col("k") == 2, s('"severity": "S%s"', n)).when(F.col("k") == 3, s('"severity": "%s"', n)).when(F.col("k") == 4, F.lit('"severity": {"level": "", "severity": "S4"}')).otherwise(F.lit('"x": 1'))
    )
    depth = F.when(F.col("k") % 2 == 0, s('"depth": {"depth_norm": %s}, "depth_estimate_cm": 9', F.col("l_tax").cast("string"))).otherwise(s('"depth_estimate_cm": %s, "depth_confidence": 0.5', F.col("l_tax").cast("string")))
    shape = F.when(F.col("k") % 3 == 0, s('"geometry": {"surface_area_px": 0, "surface_area_cm2": %s, "mask_compactness": 0.25}', F.col("l_quantity").cast("string"))).when(F.col("k") % 3 == 1, s('"geometry": {"surface_area_px": %s, "edge_sharpness": "7.5"}', F.col("l_quantity").cast("string"))).otherwise(F.lit('"geometry": 3'))
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit("{"), severity, F.lit(", "), depth, F.lit(", "), shape, F.lit("}")).alias("box"))


@query("sc_sev_08_box_forms", f"""with b as (select *, {_KIND} as k from lineitem), s as (select *, case k when 0 then l_linenumber when 1 then greatest(1, least(5, l_linenumber)) when 2 then l_linenumber when 3 then l_linenumber when 4 then 4 else 1 end as v from b)
select l_orderkey, l_linenumber, 'S' || case when v between 1 and 5 then v else 1 end as level, cast(case when v between 1 and 5 then v else 1 end as integer) as value, case when k = 0 then cast(l_discount as double) else 1.0 end as severity_confidence,
  cast(l_tax as double) as depth, case when k % 2 = 0 then 1.0 else 0.5 end as depth_confidence, case when k % 3 in (0, 1) then cast(l_quantity as double) else 0 end as area, case when k % 3 = 1 then 7.5 else 0.0 end as sharpness, case when k % 3 = 0 then 0.25 else 0.0 end as compactness from s""")
def sc_sev_08(spark, sf):
    v = F.parse_json("box")
    x = _boxes(spark, sf).select("l_orderkey", "l_linenumber", rules.severity_of(v).alias("s"), rules.depth_of(v).alias("d"), rules.geometry_of(v).alias("g"))
    return x.select("l_orderkey", "l_linenumber", "s.level", "s.value", F.col("s.confidence").alias("severity_confidence"), "d.depth", F.col("d.confidence").alias("depth_confidence"), "g.area", "g.sharpness", "g.compactness")


@query("sc_sev_09_depth", "with f as (select l_suppkey, min(l_quantity)::double as low, max(l_quantity)::double as high from lineitem group by 1), r as (select l_suppkey, l_linenumber, avg(l_quantity)::double as mean, stddev_pop(l_quantity) as dev from lineitem group by 1, 2) select l_suppkey, l_linenumber, round(1 - least(case when mean > 0 then dev / mean else 0 end, 1), 4) as confidence, round((mean - low) / case when high > low then high - low else 1 end, 4) as norm from r join f using (l_suppkey)")
def sc_sev_09(spark, sf):
    """Regions are the lines of a supplier with one number, frames all lines of a supplier, depths quantities."""
    li = V.table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_quantity").cast("double").alias("d"))
    region = li.groupBy("l_suppkey", "l_linenumber").agg(F.avg("d").alias("mean"), F.stddev_pop("d").alias("dev"), F.min("d").alias("lo"), F.max("d").alias("hi"))
    frame = region.groupBy("l_suppkey").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    x = region.join(frame, "l_suppkey")
    return x.select("l_suppkey", "l_linenumber", rules.depth_confidence(F.col("mean"), F.col("dev")).alias("confidence"), rules.depth_norm(F.col("mean"), F.col("low"), F.col("high")).alias("norm"))


@query("sc_sev_10_cascade", """with x as (select l_orderkey, l_linenumber, l_orderkey % 7 = 0 as dark, case when l_linenumber % 3 > 0 then l_discount * 10 end as mask, (l_partkey % 10) / 10 as crop, case when l_suppkey % 4 > 0 then least(greatest(least(l_quantity * 1000 / 307200.0, 1.0) * (0.5 + 0.5 * l_tax), 0), 1) end as proxy from lineitem),
c as (select *, case when dark then (case when proxy is not null then 'geometry_proxy' end) when coalesce(mask, crop) >= 0.4 then (case when mask is not null then 'mask_region' else 'central_crop' end) when proxy is not null then 'geometry_proxy' when mask is not null then 'mask_region' else 'central_crop' end as method from x)
select l_orderkey, l_linenumber, method, round(case method when 'geometry_proxy' then proxy when 'mask_region' then 0.7 when 'central_crop' then 0.3 end, 6) as depth from c""")
def sc_sev_10(spark, sf):
    li = V.table(spark, sf, "lineitem")
    light = F.when(F.col("l_orderkey") % 7 == 0, "low_light").otherwise("normal")
    mask = F.when(F.col("l_linenumber") % 3 > 0, F.struct(F.lit(0.7).alias("depth"), (F.col("l_discount") * 10).alias("confidence")))
    crop = F.struct(F.lit(0.3).alias("depth"), ((F.col("l_partkey") % 10) / 10).alias("confidence"))
    proxy = F.when(F.col("l_suppkey") % 4 > 0, rules.depth_proxy(F.col("l_quantity") * 1000, F.col("l_tax"), F.lit(307200.0)))
    return li.select("l_orderkey", "l_linenumber", rules.depth_choice(light, mask, crop, proxy).alias("x")).select("l_orderkey", "l_linenumber", "x.method", F.round("x.depth", 6).alias("depth"))


_COMPACT = f"4 * {math.pi!r} * p_size / nullif(power(p_retailprice / 50, 2), 0)"


@query("sc_sev_11_shape", f"with c as (select p_partkey, {_COMPACT} as c from part), d as (select *, greatest(least(c, 1.0), 0.01) as h from c) select p_partkey, round(c, 6) as compactness, round(((4 - 2 * h) - sqrt((2 * h - 4) * (2 * h - 4) - 4 * h * h)) / (2 * h), 6) as axis_ratio from d")
def sc_sev_11(spark, sf):
    p = V.table(spark, sf, "part").withColumn("c", rules.compactness(F.col("p_size"), F.col("p_retailprice") / 50))
    return p.select("p_partkey", F.round("c", 6).alias("compactness"), F.round(rules.axis_ratio(F.col("c")), 6).alias("axis_ratio"))


@query("sc_math_05_gpu_hours", "select s_suppkey, case when s_suppkey % 30 = 0 then 0.25 else round(((least(s_suppkey % 9, s_suppkey % 30) * 357.5::double + (s_suppkey % 30 - least(s_suppkey % 9, s_suppkey % 30)) * 546.7::double) * (960.0::double * 640 / (640 * 640)) + 430) * 3 / 3600, 2) end as hours from supplier")
def sc_math_05(spark, sf):
    k = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select("s_suppkey", rules.gpu_hours(k % 30, F.lit(960.0), F.lit(640), k % 9, F.lit(3)).alias("hours"))


@query("sc_math_08_search_space", "select p_partkey, round(log10(p_retailprice), 8) as encoded, round(power(10.0::double, least(greatest(p_size / 10.0 - 4, -3), -1)), 10) as decoded from part")
def sc_math_08(spark, sf):
    return V.table(spark, sf, "part").select("p_partkey", F.round(rules.encoded(F.col("p_retailprice"), True), 8).alias("encoded"), F.round(rules.decoded(F.col("p_size") / 10.0 - 4, 1e-3, 1e-1, True), 10).alias("decoded"))


@query("sc_cond_06_batch", "select p_partkey, cast(case when p_size % 5 = 0 then p_size else greatest(2, floor(case when p_size < 3.5 then 2 when p_size < 6 then 4 when p_size < 12 then 8 when p_size < 26 then 16 when p_size < 48 then 24 else 32 end * least(1.0, power(640.0 / (320 * (1 + p_partkey % 4)), 2)))) end as integer) as batch from part")
def sc_cond_06(spark, sf):
    size = F.col("p_size")
    return V.table(spark, sf, "part").select("p_partkey", rules.batch_size(F.when(size % 5 == 0, size), size, 320 * (1 + F.col("p_partkey") % 4)).alias("batch"))


@query("sc_dt_07_ages", "with s as (select event_id, case when event_id % 50 > 0 then (event_id * event_id) % 200000 - 30 end as s from events) select event_id, case when s is null then '—' when s < 60 then greatest(s, 0) || 's ago' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h ago' else s // 86400 || 'd ago' end as ago, case when s is null or s < 0 then '—' when s < 60 then s || 's' else s // 60 || 'm ' || s % 60 || 's' end as duration from s")
def sc_dt_07(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 50 > 0, (F.col("event_id") * F.col("event_id")) % 200000 - 30).alias("s"))
    return e.select("event_id", rules.ago(F.col("s")).alias("ago"), rules.duration(F.col("s")).alias("duration"))


@query("sc_dt_09_deadline", "with d as (select o_orderkey, case o_orderkey % 4 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%Y-%m-%d') || ' 07:30' when 2 then strftime(o_orderdate, '%Y-%m-%d') || 'T21:05' end as t, cast(o_orderdate as timestamp) as d from orders) select o_orderkey, case o_orderkey % 4 when 0 then d when 1 then d + interval '450 minutes' when 2 then d + interval '1265 minutes' else timestamp '2024-01-01' + case when o_orderkey % 8 = 3 then interval '5 hours' else interval '72 hours' end end as deadline from d")
def sc_dt_09(spark, sf):
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey")
    text = F.when(k % 4 == 0, day).when(k % 4 == 1, F.concat(day, F.lit(" 07:30"))).when(k % 4 == 2, F.concat(day, F.lit("T21:05")))
    hours = F.when(k % 8 == 3, 5)
    return V.table(spark, sf, "orders").select("o_orderkey", rules.deadline(text, F.lit("2024-01-01").cast("timestamp"), hours).cast("timestamp_ntz").alias("deadline"))


@query("sc_str_08_countries", """with p as (select o_orderkey, case o_orderkey % 6 when 0 then '/data/x/Czech Republic_txt/valid/images/a.jpg' when 1 then '/tmp/src/images/china-motorbike_txt_valid__abc.jpg' when 2 then 'images/Norway_train__b.jpg' when 3 then '/data/japan_txt/india.jpg' when 4 then 'United-States_txt.png' else '/data/atlantis/c.jpg' end as path from orders)
select o_orderkey, case o_orderkey % 6 when 0 then 'czech' when 1 then 'china' when 2 then 'norway' when 3 then 'japan' when 4 then 'usa' else 'unknown' end as country from p""")
def sc_str_08(spark, sf):
    paths = ("/data/x/Czech Republic_txt/valid/images/a.jpg", "/tmp/src/images/china-motorbike_txt_valid__abc.jpg", "images/Norway_train__b.jpg", "/data/japan_txt/india.jpg", "United-States_txt.png", "/data/atlantis/c.jpg")
    return V.table(spark, sf, "orders").select("o_orderkey", rules.country_of(V.pick(paths, F.col("o_orderkey") % 6)).alias("country"))


@query("sc_str_11_formats", "select p_partkey, case when p_partkey % 9 > 0 then format('{:,}', cast(floor(p_retailprice * 1000 + 0.5) as bigint)) || ' RON' else '—' end as money, format('{:.1f}%', round(p_size * 1.25::double / 100 * 100, 1)) as share, replace(replace('<' || p_type || ' & \"x\">', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;').replace('\"', '&quot;') as html from part")
def sc_str_11(spark, sf):
    p = V.table(spark, sf, "part")
    text = F.concat(F.lit("<"), F.col("p_type"), F.lit(' & "x">'))
    return p.select("p_partkey", rules.money(F.when(F.col("p_partkey") % 9 > 0, F.col("p_retailprice") * 1000)).alias("money"), rules.percent(F.col("p_size") * 1.25 / 100, 1).alias("share"), rules.escaped(text).alias("html"))


@query("sc_geo_10_sun", """with a as (select *, fmod(t / 86400, 365.2425) as day, fmod(t, 86400) as s from (select event_id, epoch(ts) as t, (event_id % 120 - 60)::double as lat, (event_id % 300 - 150)::double as lon from events)),
g as (select *, 2 * pi() / 365 * (floor(day) + (s / 3600 - 12) / 24) as g from a),
m as (select *, 229.18::double * (0.000075::double + 0.001868::double * cos(g) - 0.032077::double * sin(g) - 0.014615::double * cos(2 * g) - 0.040849::double * sin(2 * g)) as eq,
  0.006918::double - 0.399912::double * cos(g) + 0.070257::double * sin(g) - 0.006758::double * cos(2 * g) + 0.000907::double * sin(2 * g) - 0.002697::double * cos(3 * g) + 0.00148::double * sin(3 * g) as d from g)
select event_id, round(degrees(asin(sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * cos(radians((s / 60 + eq + 4 * lon) / 4 - 180)))), 6) as elevation from m""")
def sc_geo_10(spark, sf):
    e = V.table(spark, sf, "events")
    lat, lon = (F.col("event_id") % 120 - 60).cast("double"), (F.col("event_id") % 300 - 150).cast("double")
    return e.select("event_id", F.round(rules.sun_elevation(lat, lon, F.unix_micros(F.col("ts").cast("timestamp")) / 1e6), 6).alias("elevation"))


@query("prj_06_host_paths", "select doc_id, case when doc_id % 3 = 0 then '/mnt/store/' || source || '/' || doc_id when doc_id % 3 = 1 then '/mnt/store' else '/app/database/' || source end as path from documents")
def prj_06(spark, sf):
    d, k = V.table(spark, sf, "documents"), F.col("doc_id") % 3
    inside = F.when(k == 0, F.concat_ws("/", F.lit("/app/data"), "source", F.col("doc_id").cast("string"))).when(k == 1, "/app/data").otherwise(F.concat(F.lit("/app/database/"), F.col("source")))
    return d.select("doc_id", rules.host_path(inside, "/app/data", "/mnt/store").alias("path"))


@query("prj_07_flattened", "select doc_id, unnest(['lang', 'body.source', 'body.text.head']) as name, unnest([lang, source, left(text, 480)]) as value from documents")
def prj_07(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.struct("source", F.struct(F.col("text").alias("head")).alias("text")).alias("body"))
    return experiments.flattened(d, "doc_id")


_IMAGES = "i as (select distinct l_orderkey as image_id, case when l_partkey % 50 = 0 then 9 else l_partkey % 4 end as class_id from lineitem where l_orderkey % 10 < 7)"


@query("set_07_oversample", f"with {_IMAGES}, h as (select class_id, count(*) as have from i group by 1), m as (select class_id, have, cast((select max(have) from h) * 0.3 as bigint) - have as need from h), c as (select class_id, have, unnest(range(1, need + 1)) as copy from m where need > 0), n as (select *, row_number() over (partition by class_id order by image_id) - 1 as nth from i) select c.class_id, copy, image_id from c join n on n.class_id = c.class_id and nth = cast('0x' || substr(md5(c.class_id || ':' || copy), 1, 8) as bigint) % have".replace("cast((select max(have) from h) * 0.3 as bigint)", "cast(floor((select max(have) from h) * 0.3) as bigint)"))
def set_07(spark, sf):
    """Training images are orders of seven tenths, with the classes of their parts; one class is rare."""
    part = F.when(F.col("l_partkey") % 50 == 0, 9).otherwise(F.col("l_partkey") % 4)
    return experiments.oversampled(V.table(spark, sf, "lineitem").where("l_orderkey % 10 < 7").select(F.col("l_orderkey").alias("image_id"), part.cast("long").alias("class_id")))


_GROUPS = "g as (select o_orderkey as group_id, o_orderpriority as stratum, case o_custkey % 3 when 0 then 'japan' when 1 then 'norway' else 'usa' end as country, o_orderkey % 4 + 1 as n_images from orders)"


def _groups(spark, sf):
    country = V.pick(("japan", "norway", "usa"), F.col("o_custkey") % 3)
    return V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("stratum"), country.alias("country"), (F.col("o_orderkey") % 4 + 1).alias("n_images"))


@query("stat_08_country_out", f"with {_GROUPS}, p as (select group_id, row_number() over (partition by stratum order by md5(cast(group_id as varchar)), group_id) - 1 as i, count(*) over (partition by stratum) as n from g where country <> 'norway') select group_id, case when n >= 2 and i < greatest(1, least(round(n * 0.15), n - 1)) then 'val' else 'train' end as split from p union all select group_id, 'test' from g where country = 'norway'")
def stat_08(spark, sf):
    return experiments.country_split(_groups(spark, sf), "norway")


@query("stat_08_matched_control", f"with {_GROUPS}, p as (select group_id, row_number() over (partition by stratum order by md5(cast(group_id as varchar)), group_id) - 1 as i, count(*) over (partition by stratum) as n, (select sum(n_images) filter (where country = 'norway') / sum(n_images) from g) as f from g) select group_id, i < case when n >= 3 then greatest(1, least(round(n * f), n - 2)) else round(n * f) end as held from p")
def stat_08_control(spark, sf):
    g = _groups(spark, sf)
    return experiments.matched_holdout(g, g.where("country = 'norway'").agg(F.sum("n_images")).first()[0])


@query("win_14_schedule", """with recursive j as (select s_nationkey as queue, s_suppkey as job_id, 0.5::double + s_suppkey % 7 as hours, row_number() over (partition by s_nationkey order by s_suppkey) as i from supplier),
w as (select queue, job_id, i, 0.0::double as starts, hours as finishes, hours <= 12 as fits, case when hours <= 12 then hours else 0.0::double end as clock from j where i = 1
  union all select j.queue, j.job_id, j.i, clock, clock + hours, clock + hours <= 12, case when clock + hours <= 12 then clock + hours else clock end from w join j on j.queue = w.queue and j.i = w.i + 1)
select queue, job_id, starts, finishes, fits from w""")
def win_14(spark, sf):
    s = V.table(spark, sf, "supplier").select(F.col("s_nationkey").cast("long").alias("queue"), F.col("s_suppkey").cast("long").alias("job_id"), F.col("s_suppkey").alias("position"), (0.5 + F.col("s_suppkey") % 7).cast("double").alias("hours"))
    return experiments.scheduled(s, 12.0)


@query("flt_16_motion", """with recursive f as (select user_id as stream_id, event_id as frame_id, value as a, (event_id % 97)::double as b, row_number() over (partition by user_id order by event_id) as i from events),
w as (select stream_id, frame_id, i, a as la, b as lb, true as passed from f where i = 1
  union all select f.stream_id, f.frame_id, f.i, case when (abs(a - la) + abs(b - lb)) / 2 >= 60 then a else la end, case when (abs(a - la) + abs(b - lb)) / 2 >= 60 then b else lb end, (abs(a - la) + abs(b - lb)) / 2 >= 60 from w join f on f.stream_id = w.stream_id and f.i = w.i + 1)
select stream_id, frame_id from w where passed""")
def flt_16(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").cast("long").alias("stream_id"), F.col("event_id").cast("long").alias("frame_id"), F.array(F.col("value").cast("double"), (F.col("event_id") % 97).cast("double")).alias("pixels"))
    return experiments.moved(e, 60.0)


@query("flt_11_dark_frames", "select l_orderkey, round(avg(l_quantity), 6) as brightness from lineitem group by 1 having avg(l_quantity) >= 15")
def flt_11(spark, sf):
    """Frames (orders) whose mean brightness is not below 15."""
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_quantity"), 6).alias("brightness")).where("brightness >= 15")


_AP = "p as (select case when o_custkey % 2 = 0 then 'base' else 'new' end as experiment, o_orderpriority as class_name, o_totalprice as ap from orders where not (o_custkey % 2 = 1 and o_orderpriority = '5-LOW'))"


@query("stat_06_head_to_head", f"with {_AP}, a as (select class_name, avg(ap) as a from p where experiment = 'base' group by 1), b as (select class_name, avg(ap) as b from p where experiment = 'new' group by 1), d as (select *, b - a as delta from a full join b using (class_name)) select count(a) as n_baseline, count(b) as n_challenger, count(delta) as n_shared, count(*) filter (where delta > 0) as n_better, case when count(a) = count(b) then round(avg(b) - avg(a), 6) end as aggregate_delta, round(avg(delta), 6) as shared_delta, max_by(class_name, delta) as best_class, min_by(class_name, delta) as worst_class, count(a) <> count(b) as suppressed, case when count(delta) = 0 then 'nothing shared' when abs(case when count(a) = count(b) then avg(b) - avg(a) else avg(delta) end) < 100 then 'below noise' when case when count(a) = count(b) then avg(b) - avg(a) else avg(delta) end > 0 then 'better' else 'not better' end as verdict from d")
def stat_06(spark, sf):
    """Two experiments over the priorities of orders, one of them without the lowest."""
    o = V.table(spark, sf, "orders").where("not (o_custkey % 2 = 1 and o_orderpriority = '5-LOW')")
    per = o.select(F.when(F.col("o_custkey") % 2 == 0, "base").otherwise("new").alias("experiment"), F.col("o_orderpriority").alias("class_name"), F.col("o_totalprice").cast("double").alias("ap"))
    return experiments.compared(per, "base", "new", 100.0)


@query("st_16_job_states", "with s as (select l_orderkey as job_id, max(epoch(l_shipdate)) as sign from lineitem group by 1) select o_orderkey as job_id, case when o_orderstatus in ('O', 'P') and epoch(timestamp '1998-01-01') - greatest(epoch(o_orderdate), coalesce(sign, 0)) > 7200 then 'stale' when o_orderstatus = 'O' then 'pending' when o_orderstatus = 'P' then 'running' else 'complete' end as state from orders left join s on job_id = o_orderkey")
def st_16(spark, sf):
    """Orders are jobs, and shipped lines their signs of life."""
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("complete")

    def seconds(c: str):
        return F.unix_timestamp(F.col(c).cast("timestamp")).cast("double")

    jobs = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), status.alias("status"), seconds("o_orderdate").alias("t"))
    signs = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), seconds("l_shipdate").alias("t"))
    return experiments.active_jobs(jobs, signs, 883612800.0)


@query("src_28_next_job", "select o_orderkey as job_id from orders where o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1")
def src_28(spark, sf):
    jobs = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("complete").alias("status"), F.col("o_orderdate").alias("t"))
    return experiments.next_job(jobs).select("job_id")


@query("stat_10_class_lists", "select p_partkey, case p_partkey % 4 when 0 then 'match' when 1 then 'reordered' when 2 then 'subset' else 'foreign' end as outcome from part")
def stat_10(spark, sf):
    lists = (("Crack", "pothole", "Rutting"), ("rutting", "crack", "pothole"), ("pothole",), ("pothole", "kerb"))
    declared = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in lists)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", experiments.class_check(declared, ["crack", "pothole", "rutting"]).alias("outcome"))


@query("prj_05_canonical_names", "select p_partkey, case p_partkey % 3 when 0 then ['pothole', 'crack'] when 1 then ['pothole', 'pothole'] else ['D00', 'kerb'] end as names from part")
def prj_05(spark, sf):
    """Two lists that are known throughout, and one with a foreign name, which stays as it is."""
    lists = (("D40", "Crack"), ("pothole", "d40"), ("D00", "kerb"))
    declared = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in lists)), (F.col("p_partkey") % 3 + 1).cast("int"))
    return V.table(spark, sf, "part").select("p_partkey", labels.canonical(declared, {"D00": "crack", "D40": "pothole"}).alias("names"))


_FOLDERS = "im as (select 'set/' || l_suppkey % 60 as folder, l_orderkey as stem from lineitem), lb as (select 'set/' || l_suppkey % 60 as folder, l_orderkey as stem from lineitem where l_linenumber < 1 + l_suppkey % 4)"


def _folders(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("folder", F.concat(F.lit("set/"), (F.col("l_suppkey") % 60).cast("string")))
    return li.select("folder", F.col("l_orderkey").cast("string").alias("stem")), li.where("l_linenumber < 1 + l_suppkey % 4").select("folder", F.col("l_orderkey").cast("string").alias("stem"))


@query("src_22_best_folders", f"with {_FOLDERS} select folder, count(distinct stem) filter (where (folder, stem) in (select folder, stem from lb)) as matches, count(*) as images from im group by folder having matches > 0 order by matches desc, folder limit 40")
def src_22(spark, sf):
    return experiments.best_folders(*_folders(spark, sf))


@query("src_23_merged_view", f"with {_FOLDERS} select replace(folder, '/', '_') || '__' || stem as name, folder, cast(stem as varchar) as stem from im where (folder, stem) in (select folder, stem from lb)")
def src_23(spark, sf):
    return experiments.merged_view(*_folders(spark, sf))


@query("jn_19_split_leaks", "with " + _PHASH + ", s as (select h, case doc_id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split, min(doc_id) as id from h where doc_id in (select doc_id from w) group by all) select a.split as split_a, b.split as split_b, count(*) as pairs, count(*) filter (where a.h = b.h) as equal, min(a.id) as first_a, min(b.id) as first_b from s a join s b on a.split < b.split and bit_count(xor(cast(a.h as bit), cast(b.h as bit))) <= 4 group by all")
def jn_19(spark, sf):
    split = V.pick(("train", "val", "test"), F.col("doc_id") % 3)
    return similarity.split_leaks(phashes(spark, sf).select(F.col("doc_id").alias("id"), "h", split.alias("split")), 4)
