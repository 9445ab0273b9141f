"""Further queries: smaller operators of the inventory, the survey pipeline, research tables and the assistant."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geo, scoring
from kerbline.operators import detections as D
from kerbline.operators import routes, spatial
from kerbline.plans import views as V
from kerbline.plans.queries_detections import _GRID, bands, det, metres, scored
from kerbline.plans.registry import query
from kerbline.plans.views import duck
from kerbline.sources import labels, tracks


@query("src_02_chunks", "select o_orderkey % 15 as chunk, count(*) as n, min(o_orderkey) as first_key from orders group by 1")
def src_02(spark, sf):
    return V.table(spark, sf, "orders").groupBy((F.col("o_orderkey") % 15).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("src_16_first_success", "with r as (select l_orderkey as file, l_linenumber, l_linenumber % 3 as priority from lineitem), m as (select *, min(priority) over (partition by file) as best from r) select cast(file as varchar) as file, ['exif', 'text', 'sensor'][priority + 1] as strategy, count(*) as n from m where priority = best group by all")
def src_16(spark, sf):
    """Three readings of the same files, each giving rows of some."""
    li = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_shipdate").alias("time"), F.col("l_tax").alias("lat"), F.col("l_discount").alias("lon"), (F.col("l_linenumber") % 3).alias("k"))
    got = tracks.first_success([(name, li.where(F.col("k") == i)) for i, name in enumerate(("exif", "text", "sensor"))])
    return got.groupBy("file", "strategy").agg(F.count("*").alias("n"))


@query("src_26_long_metrics", "select s_suppkey, 'balance' as metric, s_acctbal as value from supplier where s_acctbal > 0 union all select s_suppkey, 'nation', s_nationkey from supplier")
def src_26(spark, sf):
    s = V.table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return s.unpivot("s_suppkey", ["balance", "nation"], "metric", "value").where("value is not null")


@query("snk_03_features", det("select id, 'Point' as kind, longitude, latitude from v_detections"))
def snk_03(spark, sf):
    d = V.detections(spark, sf).select("id", "latitude", "longitude")
    x = F.from_json("feature", "geometry struct<type: string, coordinates: array<double>>, properties struct<id: long>")
    return labels.geojson(d, "latitude", "longitude").select(x.alias("x")).select("x.properties.id", F.col("x.geometry.type").alias("kind"), F.col("x.geometry.coordinates")[0].alias("longitude"), F.col("x.geometry.coordinates")[1].alias("latitude"))


@query("snk_10_repeat_names", "select 'train' as split, cast(l_partkey as varchar) as image, case when r > 1 then l_partkey || '__dup' || (r - 1) else cast(l_partkey as varchar) end as name from (select *, row_number() over (partition by l_partkey) as r from lineitem)")
def snk_10(spark, sf):
    return labels.materialised(V.table(spark, sf, "lineitem").select(F.lit("train").alias("split"), F.col("l_partkey").cast("string").alias("image")))


@query("snk_05_stage_documents", "select s_nationkey as run, count(*) as n, round(max(s_acctbal), 2) as top, list(s_suppkey order by s_suppkey) as frames from supplier group by 1")
def snk_05(spark, sf):
    """Stage artefacts as JSON and read again: a header of statistics and the list of frames."""
    s = V.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run"), F.col("s_suppkey").alias("frame_id"), F.col("s_acctbal").cast("double").alias("score"))
    made = labels.stage_documents(s, "run", {"n": F.count("*"), "top": F.max("score")})
    x = F.from_json("document", "stats struct<n: long, top: double>, frames array<struct<frame_id: long, score: double>>")
    return made.select("run", x.alias("x")).select("run", "x.stats.n", F.round("x.stats.top", 2).alias("top"), F.col("x.frames.frame_id").alias("frames"))


@query("snk_11_last_epochs", "select l_orderkey as run, max(l_linenumber) as epoch, max({'e': l_linenumber, 'v': l_quantity}).v as value from lineitem group by 1")
def snk_11(spark, sf):
    """The last row of each run's sheet."""
    m = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_quantity").alias("value"))
    return labels.last_rows(m, "run", "epoch")


@query("agg_27_class_histogram", "with f as (select distinct o_custkey % 5 as folder, o_orderkey as file from orders where o_orderkey in (select l_orderkey from lineitem)), k as (select * from (select *, row_number() over (partition by folder order by file) as r from f) where r <= 100) select folder, l_linenumber as class_id, count(*) as n from k join lineitem on l_orderkey = file group by all")
def agg_27(spark, sf):
    """Classes in the first hundred label files of each folder, by name."""
    o = V.table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("folder"), F.col("o_orderkey").alias("file"))
    boxes = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("class_id")).join(o, "file")
    return labels.class_histogram(boxes, 100)


@query("flt_12_valid_fixes", duck("v_reports", body="select count(*) as n, count(*) filter (where longitude between -180 and 180 and latitude between -90 and 90 and not (latitude = 0 and longitude = 0)) as valid from v_reports"))
def flt_12(spark, sf):
    r = V.reports(spark, sf)
    return r.agg(F.count("*").alias("n"), F.count_if(geo.valid(F.col("latitude"), F.col("longitude"))).alias("valid"))


@query("flt_13_median_filter", duck("v_reports", body=f"a as (select user_id, report_id, latitude as lat, longitude as lon, count(*) over (partition by user_id) as n, row_number() over (partition by user_id order by latitude, report_id) as i, row_number() over (partition by user_id order by longitude, report_id) as j from v_reports), m as (select *, max(case when i = n // 2 + 1 then lat end) over (partition by user_id) as ml, max(case when j = n // 2 + 1 then lon end) over (partition by user_id) as mo from a), k as (select *, {metres('lat', 'lon', 'ml', 'mo', 6371.0088)} <= 4 as near from m) select report_id from (select *, bool_or(near) over (partition by user_id) as any_near from k) where n < 4 or near or not any_near"))
def flt_13(spark, sf):
    fixes = V.reports(spark, sf).select(F.col("user_id").alias("track_id"), F.col("report_id").alias("fix_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return D.median_geofilter(fixes, 4.0).select(F.col("fix_id").alias("report_id"))


@query("flt_17_stride", "select event_id from events where event_id % 5 = 0")
def flt_17(spark, sf):
    return V.table(spark, sf, "events").where(F.pmod("event_id", F.lit(5)) == 0).select("event_id")


@query("flt_21_prune", det("select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey in (select id from v_detections where severity = 5) or not exists (select 1 from v_detections where severity = 5)"))
def flt_21(spark, sf):
    keep = V.detections(spark, sf).where("severity = 5").select(F.col("id").alias("l_orderkey"))
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    none = keep.limit(1).agg(F.count("*") == 0).scalar()
    return li.join(keep, "l_orderkey", "left_semi").unionByName(li.where(none))


@query("prj_03_nested", duck("v_boxes", body="select frame_id, count(*) as boxes, list(box_id order by box_id, part, confidence)[1] as first_box from v_boxes group by frame_id"))
def prj_03(spark, sf):
    nested = V.boxes(spark, sf).groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "part", "confidence"))).alias("boxes"))
    return nested.select("frame_id", F.size("boxes").cast("long").alias("boxes"), F.col("boxes")[0]["box_id"].alias("first_box"))


@query("prj_04_class_remap", duck("v_boxes", body="select case when class_name in ('longitudinal_crack', 'transverse_crack', 'alligator_crack') then 0 when class_name = 'pothole' then 1 else 2 end as class_id, count(*) as n from v_boxes where class_name not in ('manhole_cover', 'lane_line_blur') group by 1"))
def prj_04(spark, sf):
    mapping = [(c, 0 if c.endswith("l_crack") or c in ("transverse_crack", "alligator_crack") else 1 if c == "pothole" else 2) for c in vocab.CLASSES if c not in ("manhole_cover", "lane_line_blur")]
    table = spark.createDataFrame(mapping, "class_name string, class_id int")
    return V.boxes(spark, sf).join(F.broadcast(table), "class_name").groupBy("class_id").agg(F.count("*").alias("n"))


@query("jn_15_lookup", "select count(*) as n, count(o_orderkey) as matched from lineitem left join (select o_orderkey from orders where o_orderstatus = 'F') on l_orderkey = o_orderkey")
def jn_15(spark, sf):
    o = V.table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return V.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").agg(F.count("*").alias("n"), F.count("o_orderkey").alias("matched"))


@query("jn_20_head_to_head", "with m as (select l_suppkey % 2 as e, l_partkey % 10 as class, avg(l_discount) as v from lineitem group by all) select a.class, round(b.v - a.v, 9) as delta from m a join m b using (class) where a.e = 0 and b.e = 1")
def jn_20(spark, sf):
    m = V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("e"), (F.col("l_partkey") % 10).alias("class")).agg(F.avg("l_discount").alias("v"))
    a, b = m.where("e = 0").select("class", F.col("v").alias("va")), m.where("e = 1").select("class", F.col("v").alias("vb"))
    return a.join(b, "class").select("class", F.round(F.col("vb") - F.col("va"), 9).alias("delta"))


@query("jn_21_shared_keys", "select l_partkey from lineitem group by l_partkey having count(distinct l_suppkey % 2) = 2")
def jn_21(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.countDistinct(F.col("l_suppkey") % 2).alias("n")).where("n = 2").select("l_partkey")


@query("agg_16_removed_per_class", det("select damage_type, count(*) filter (where r = 1) as kept, count(*) filter (where r > 1) as removed from (select *, row_number() over (partition by latitude, longitude order by confidence desc, id) as r from v_detections) group by damage_type"))
def agg_16(spark, sf):
    r = F.row_number().over(Window.partitionBy("latitude", "longitude").orderBy(F.desc("confidence"), "id"))
    return V.detections(spark, sf).withColumn("r", r).groupBy("damage_type").agg(F.count_if(F.col("r") == 1).alias("kept"), F.count_if(F.col("r") > 1).alias("removed"))


@query("agg_19_class_hits", duck("v_boxes", body="select class_name, count(*) as boxes, count(distinct frame_id) as frames, round(100 * count(distinct frame_id) / (select count(distinct frame_id) from v_boxes), 6) as percent from v_boxes group by class_name"))
def agg_19(spark, sf):
    b = V.boxes(spark, sf)
    return b.groupBy("class_name").agg(F.count("*").alias("boxes"), F.countDistinct("frame_id").alias("frames")).withColumn("percent", F.round(100 * F.col("frames") / b.agg(F.countDistinct("frame_id")).scalar(), 6))


@query("agg_24_noise_floor", "select round(max(sd), 9) as noise from (select stddev_samp(l_discount) as sd from lineitem group by l_suppkey having count(*) > 1)")
def agg_24(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.stddev_samp("l_discount").alias("sd"), F.count("*").alias("n")).where("n > 1")
    return g.agg(F.round(F.max("sd"), 9).alias("noise"))


@query("agg_25_class_per_split", duck("v_boxes", body="select frame_id % 3 as split, class_name, count(*) as n from v_boxes group by all"))
def agg_25(spark, sf):
    return V.boxes(spark, sf).groupBy((F.col("frame_id") % 3).alias("split"), "class_name").agg(F.count("*").alias("n"))


@query("agg_26_country_shares", "select n_name, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from customer join nation on c_nationkey = n_nationkey group by n_name")
def agg_26(spark, sf):
    c = V.users(spark, sf).groupBy(F.col("city").alias("n_name")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / c.agg(F.sum("n")).scalar(), 9))


@query("agg_41_separation", "select o_orderpriority, min(o_totalprice) as least, max(o_totalprice) as most, round(median(o_totalprice), 6) as middle, (list(o_totalprice order by o_totalprice))[cast(floor(0.95 * count(*)) as bigint) + 1] as p95 from orders group by o_orderpriority")
def agg_41(spark, sf):
    """p95 is by index: the value at floor(0.95 n), found by its rank."""
    w = Window.partitionBy("o_orderpriority")
    o = V.table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", (F.row_number().over(w.orderBy("o_totalprice")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    at = F.max(F.when(F.col("i") == F.floor(F.lit(0.95) * F.col("n")), F.col("o_totalprice")))
    return o.groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.round(F.percentile("o_totalprice", 0.5), 6).alias("middle"), at.alias("p95"))


@query("agg_42_merged_ids", "with s as (select 0 as source, o_orderkey as id from orders union all select 1, c_custkey from customer), o as (select source, coalesce(sum(n) over (order by source rows between unbounded preceding and 1 preceding), 0) as base from (select source, count(*) as n from s group by source)) select source, cast(id + base as bigint) as new_id from s join o using (source)")
def agg_42(spark, sf):
    s = V.table(spark, sf, "orders").select(F.lit(0).alias("source"), F.col("o_orderkey").alias("id"))
    s = s.unionByName(V.table(spark, sf, "customer").select(F.lit(1).alias("source"), F.col("c_custkey").alias("id")))
    n = s.groupBy("source").agg(F.count("*").alias("n"))  # a row for each source
    base = n.select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return s.join(F.broadcast(base), "source").select("source", (F.col("id") + F.col("base")).alias("new_id"))


@query("win_10_rarest_class", duck("v_boxes", body="f as (select class_name, count(*) as freq from v_boxes group by all) select frame_id, class_name as stratum from (select frame_id, class_name, row_number() over (partition by frame_id order by freq, class_name) as r from v_boxes join f using (class_name)) where r = 1"))
def win_10(spark, sf):
    b = V.boxes(spark, sf).select("frame_id", "class_name")
    f = b.groupBy("class_name").agg(F.count("*").alias("freq"))
    return b.join(F.broadcast(f), "class_name").groupBy("frame_id").agg(F.min(F.struct("freq", "class_name")).alias("b")).select("frame_id", F.col("b.class_name").alias("stratum"))


@query("win_13_majority", duck("v_boxes", body="n as (select frame_id, class_name, count(*) as n from v_boxes group by all) select frame_id, class_name from (select *, row_number() over (partition by frame_id order by n desc, class_name) as r from n) where r = 1"))
def win_13(spark, sf):
    n = V.boxes(spark, sf).groupBy("frame_id", "class_name").agg(F.count("*").alias("n"))
    return n.groupBy("frame_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "class_name")).alias("b")).select("frame_id", "b.class_name")


@query("win_15_latest_signal", duck("v_reports", body="select user_id, event_id, max(created_at) as latest from v_reports group by all"))
def win_15(spark, sf):
    return V.reports(spark, sf).groupBy("user_id", "event_id").agg(F.max("created_at").alias("latest"))


@query("win_16_hash_split", "with o as (select o_orderkey, row_number() over (order by md5(cast(o_orderkey as varchar)), o_orderkey) as i, count(*) over () as n from orders) select o_orderkey, case when i <= n * 70 // 100 then 'train' when i <= n * 85 // 100 then 'val' else 'test' end as split from o")
def win_16(spark, sf):
    """A place in hash order is the rank within one of 4096 prefixes plus the rows of the prefixes before: no global sort."""
    o = V.table(spark, sf, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("h")).withColumn("prefix", F.substring("h", 1, 3))
    n = o.groupBy("prefix").agg(F.count("*").alias("n"))
    at = n.select("prefix", (F.sum("n").over(Window.orderBy("prefix")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))  # 4096 rows
    i = F.row_number().over(Window.partitionBy("prefix").orderBy("h", "o_orderkey")) + F.col("before")
    ranked = o.join(F.broadcast(at), "prefix").select("o_orderkey", "total", i.alias("i"))
    return ranked.select("o_orderkey", F.when(F.expr("i <= total * 70 div 100"), "train").when(F.expr("i <= total * 85 div 100"), "val").otherwise("test").alias("split"))


@query("tk_05_triage", duck("v_reports", body="c as (select event_id, count(distinct device_id) filter (where kind <> 'dispute') as s, max(created_at) as latest from v_reports group by event_id) select event_id, case when s >= 3 then 2 when s >= 2 then 1 else 0 end as tier, latest from c order by tier desc, latest desc, event_id limit 40"))
def tk_05(spark, sf):
    c = V.reports(spark, sf).groupBy("event_id").agg(F.countDistinct(F.when(F.col("kind") != "dispute", F.col("device_id"))).alias("s"), F.max("created_at").alias("latest"))
    tier = F.when(F.col("s") >= 3, 2).when(F.col("s") >= 2, 1).otherwise(0)
    return c.select("event_id", tier.alias("tier"), "latest").orderBy(F.desc("tier"), F.desc("latest"), "event_id").limit(40)


@query("tk_06_latest", duck("v_reports", body="select report_id, created_at from v_reports order by created_at desc, report_id desc limit 1000"))
def tk_06(spark, sf):
    return V.reports(spark, sf).select("report_id", "created_at").orderBy(F.desc("created_at"), F.desc("report_id")).limit(1000)


@query("tk_07_feed", duck("v_reports", body="select report_id, created_at, kind, (select count(*) from v_reports where user_id = 9 and kind = 'sighting') as unread from v_reports where user_id = 9 order by created_at desc, report_id desc limit 20"))
def tk_07(spark, sf):
    mine = V.reports(spark, sf).where("user_id = 9")
    unread = mine.agg(F.count_if(F.col("kind") == "sighting")).scalar()
    return mine.orderBy(F.desc("created_at"), F.desc("report_id")).limit(20).select("report_id", "created_at", "kind", unread.alias("unread"))


@query("tk_08_top_classes", det("select damage_type, count(*) as n from v_detections group by damage_type order by n desc, damage_type limit 6"))
def tk_08(spark, sf):
    return V.detections(spark, sf).groupBy("damage_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "damage_type").limit(6)


@query("set_04_week_keys", det("select distinct week from (select cast(date_trunc('week', first_detected) as date) as week from v_detections union select cast(date_trunc('week', fixed_on) as date) from v_detections where fixed_on is not null)"))
def set_04(spark, sf):
    d = V.detections(spark, sf)
    a, b = d.select(F.trunc("first_detected", "week").alias("week")), d.where("fixed_on is not null").select(F.trunc("fixed_on", "week").alias("week"))
    return a.union(b).distinct()


@query("wr_01_upsert")
def wr_01(spark, sf):
    d = V.detections(spark, sf).where("severity is not null").select("id", "latitude", "longitude", "damage_type", "severity", "confidence", F.col("first_detected").alias("day"))
    placed = spatial.clusters(d, 2)
    seq = (F.datediff("day", F.lit("1990-01-01")).cast("long") * 10_000_000_000 + F.col("id")).alias("seq")
    return routes.upserted(placed.select(F.col("cluster_id").alias("place"), "damage_type", seq, "id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "severity", "confidence", F.when(F.col("id") % 3 > 0, F.concat(F.lit("crop-"), F.col("id").cast("string"))).alias("crop"), "day"))


@query("wr_03_counters", "select c_custkey, coalesce(n, 0) + c_nationkey as frames from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey")
def wr_03(spark, sf):
    n = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return V.table(spark, sf, "customer").join(n, "c_custkey", "left").select("c_custkey", (F.coalesce("n", F.lit(0)) + F.col("c_nationkey")).alias("frames"))


@query("wr_09_cascade", "select l_orderkey, l_partkey, case when l_suppkey <= 10 then null else l_suppkey end as l_suppkey from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def wr_09(spark, sf):
    gone = V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    kept = V.table(spark, sf, "lineitem").join(gone, "l_orderkey", "left_anti")
    return kept.select("l_orderkey", "l_partkey", F.when(F.col("l_suppkey") > 10, F.col("l_suppkey")).alias("l_suppkey"))


@query("wr_10_evidence_path", det("select id, 'processed/' || substr(sha1(damage_type || ':' || id), 1, 16) || '.jpg' as path from v_detections"))
def wr_10(spark, sf):
    return V.detections(spark, sf).select("id", F.concat(F.lit("processed/"), F.substring(F.sha1(F.concat_ws(":", "damage_type", "id")), 1, 16), F.lit(".jpg")).alias("path"))


@query("sc_geo_06_cells", det(f"select id, cast(floor(latitude / ({500 / vocab.METRES_PER_DEGREE!r})) as bigint) as y from v_detections"))
def sc_geo_06(spark, sf):
    return V.detections(spark, sf).select("id", F.floor(F.col("latitude") / geo.metres_to_lat(500)).alias("y"))


@query("sc_geo_07_bins", det("select round(cast(latitude as decimal(12,6)), 3) as y, round(cast(longitude as decimal(12,6)), 3) as x, count(*) as n from v_detections group by all"))
def sc_geo_07(spark, sf):
    return V.detections(spark, sf).groupBy(F.round(F.col("latitude").cast("decimal(12,6)"), 3).alias("y"), F.round(F.col("longitude").cast("decimal(12,6)"), 3).alias("x")).agg(F.count("*").alias("n"))


@query("sc_sev_05_confidence", duck("v_boxes", body="select frame_id, box_id, part, round(0.5::double + 0.5::double * depth_norm, 4) as proxy, round(least(0.6::double + 0.4::double * depth_norm, 1.0), 4) as measured from v_boxes"))
def sc_sev_05(spark, sf):
    d = F.col("depth_norm")
    return V.boxes(spark, sf).select("frame_id", "box_id", "part", F.round(0.5 + 0.5 * d, 4).alias("proxy"), F.round(F.least(0.6 + 0.4 * d, F.lit(1.0)), 4).alias("measured"))


@query("sc_sev_13_lighting", "select p_partkey, case when p_size * 5 >= 100 then 'daylight' when p_size * 5 >= 50 then 'overcast' else 'low_light' end as lighting from part")
def sc_sev_13(spark, sf):
    v = F.col("p_size") * 5
    return V.table(spark, sf, "part").select("p_partkey", F.when(v >= 100, "daylight").when(v >= 50, "overcast").otherwise("low_light").alias("lighting"))


@query("sc_sev_14_jolts", "select event_id, greatest(0.3, least(0.9, value / 25)) as confidence, case when value > 20 then 4 when value > 14 then 3 else 2 end as severity from events")
def sc_sev_14(spark, sf):
    v = F.col("value")
    return V.table(spark, sf, "events").select("event_id", F.greatest(F.lit(0.3), F.least(F.lit(0.9), v / 25)).alias("confidence"), F.when(v > 20, 4).when(v > 14, 3).otherwise(2).alias("severity"))


@query("sc_math_03_f1", "select l_suppkey, case when p + r > 0 then round(2 * p * r / (p + r), 9) else 0 end as f1 from (select l_suppkey, avg(l_discount) as p, avg(l_tax) as r from lineitem group by 1)")
def sc_math_03(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.avg("l_discount").alias("p"), F.avg("l_tax").alias("r"))
    return g.select("l_suppkey", F.when(F.col("p") + F.col("r") > 0, F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 9)).otherwise(0.0).alias("f1"))


@query("sc_math_04_boxes", "select p_partkey, round(log2(p_size / (p_partkey % 7 + 1)), 9) as log_ratio, (p_size * (p_partkey % 7 + 1)) / 409600 as share from part")
def sc_math_04(spark, sf):
    h = F.col("p_partkey") % 7 + 1
    return V.table(spark, sf, "part").select("p_partkey", F.round(F.log2(F.col("p_size") / h), 9).alias("log_ratio"), (F.col("p_size") * h / 409600).alias("share"))


@query("sc_dt_03_window", "select event_id from events where ts >= timestamp '2024-01-20' - interval 6 hours and ts < timestamp '2024-01-20' + interval 2 days")
def sc_dt_03(spark, sf):
    return V.table(spark, sf, "events").where("ts >= timestamp_ntz '2024-01-20' - interval 6 hours and ts < timestamp_ntz '2024-01-20' + interval 2 days").select("event_id")


@query("sc_dt_04_night", "select event_id, hour(ts + interval 2 hours) >= 22 or hour(ts + interval 2 hours) < 5 as night from events")
def sc_dt_04(spark, sf):
    """Local hours in Bucharest; the test data lie in winter, two hours ahead of UTC."""
    h = F.hour(F.convert_timezone(F.lit("UTC"), F.lit("Europe/Bucharest"), F.col("ts")))
    return V.table(spark, sf, "events").select("event_id", ((h >= 22) | (h < 5)).alias("night"))


@query("sc_str_02_stems", "select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda w: regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, 'ies$', 'y'), 'ings?$', ''), 'ed$', ''), 's$', '')))) as stems from documents")
def sc_str_02(spark, sf):
    def stem(w):
        for pattern, to in (("ies$", "y"), ("ings?$", ""), ("ed$", ""), ("s$", "")):
            w = F.regexp_replace(w, pattern, to)
        return w

    d = V.table(spark, sf, "documents")
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))
    return d.select("doc_id", F.array_sort(F.array_distinct(F.transform(words, stem))).alias("stems"))


@query("sc_str_09_job_ids", "select o_orderkey, regexp_full_match(strftime(o_orderdate, '%Y%m%d') || '_' || (o_orderkey % 1000000), '\\d{8}_\\d{6}') as ok from orders")
def sc_str_09(spark, sf):
    job = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), (F.col("o_orderkey") % 1000000).cast("string"))
    return V.table(spark, sf, "orders").select("o_orderkey", job.rlike(r"^\d{8}_\d{6}$").alias("ok"))


@query("sc_cond_05_crossings", duck("v_reports", body="s as (select event_id, device_id, min(created_at) as first_support from v_reports where kind <> 'dispute' group by all), r as (select *, row_number() over (partition by event_id order by first_support, device_id) as k from s) select event_id, device_id, case when k <= 2 and (select count(*) from r x where x.event_id = r.event_id) >= 2 then 10 else 0 end + case when k <= 3 and (select count(*) from r x where x.event_id = r.event_id) >= 3 then 15 else 0 end as points from r"))
def sc_cond_05(spark, sf):
    """Supporters at the moment an event is confirmed or verified get its points."""
    s = V.reports(spark, sf).where("kind != 'dispute'").groupBy("event_id", "device_id").agg(F.min("created_at").alias("first_support"))
    w = Window.partitionBy("event_id")
    r = s.withColumn("k", F.row_number().over(w.orderBy("first_support", "device_id"))).withColumn("n", F.count("*").over(w))
    confirmed = F.when((F.col("k") <= 2) & (F.col("n") >= 2), vocab.POINTS["event_confirmed"]).otherwise(0)
    verified = F.when((F.col("k") <= 3) & (F.col("n") >= 3), vocab.POINTS["event_verified"]).otherwise(0)
    return r.select("event_id", "device_id", (confirmed + verified).alias("points"))


@query("stat_02_permutation", """with s as (select p_brand, avg(p_size) as x, avg(p_retailprice) as y from part group by 1),
r as (select row_number() over (order by p_brand) - 1 as i, rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from s),
d as (select p, ry, row_number() over (partition by p order by md5(p || ':' || i), i) - 1 as j from r, range(1000) t(p)),
h as (select p, abs(corr(rx, d.ry)) as rho from d join r on r.i = d.j group by p), o as (select abs(corr(rx, ry)) as seen from r)
select (count(*) filter (where rho >= seen - 1e-12) + 1) / (count(*) + 1) as p_value, round(max(seen), 9) as rho from h, o""")
def stat_02(spark, sf):
    """Mean size against mean price of the brands of parts, by rank."""
    from kerbline.operators import statistics

    means = V.table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_size").alias("x"), F.avg("p_retailprice").alias("y")).withColumn("g", F.lit(1))
    at = statistics.placed_by(means, "p_brand")
    ranked = at.join(statistics.ranks(means, "g", "x").select("x", F.col("r").alias("rx")), "x").join(statistics.ranks(means, "g", "y").select("y", F.col("r").alias("ry")), "y")
    return statistics.permutation_p(ranked.select("i", "rx", "ry")).withColumn("rho", F.round("rho", 9))


@query("stat_07_medians", "select round(median(l_extendedprice) filter (where l_returnflag = 'A'), 6) as a, round(median(l_extendedprice) filter (where l_returnflag = 'R'), 6) as r from lineitem")
def stat_07(spark, sf):
    from kerbline.operators import statistics

    flagged = V.table(spark, sf, "lineitem").where("l_returnflag in ('A', 'R')")
    m = statistics.medians(flagged, "l_returnflag", "l_extendedprice")

    def of(flag: str):
        return F.round(F.max(F.when(F.col("l_returnflag") == flag, F.col("median"))), 6)

    return m.agg(of("A").alias("a"), of("R").alias("r"))


@query("stat_11_fingerprint", "select l_orderkey, sha256(string_agg(l_partkey || ':' || l_quantity::integer, ',' order by l_partkey, l_quantity)) as digest from lineitem group by l_orderkey")
def stat_11(spark, sf):
    part = F.array_sort(F.collect_list(F.struct("l_partkey", F.col("l_quantity").cast("int").alias("q"))))
    g = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(part.alias("p"))
    return g.select("l_orderkey", F.sha2(F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["l_partkey"], x["q"])), ","), 256).alias("digest"))


@query("opt_01_tours")
def opt_01(spark, sf):
    """A tour for each work order."""
    items = V.work_order_items(spark, sf)
    stops = items.join(V.detections(spark, sf), F.col("detection_id") == F.col("id")).select(F.col("work_order_id").alias("order_id"), F.col("id").alias("stop_id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return routes.planned(stops)


@query("opt_05_averaged_weights", "select i, round(avg(v), 6) as mean from (select unnest(embedding) as v, unnest(range(64)) as i from embeddings) group by i")
def opt_05(spark, sf):
    e = V.table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.avg("v"), 6).alias("mean"))


@query("tk_10_owner_lists", "select s_suppkey, s_name from supplier order by s_name desc, s_suppkey limit 30 offset 10")
def tk_10(spark, sf):
    return V.table(spark, sf, "supplier").orderBy(F.desc("s_name"), "s_suppkey").offset(10).limit(30).select("s_suppkey", "s_name")


@query("agg_45_manifest", "select o_orderstatus, count(*) filter (where o_orderpriority like '1%') as p1, count(*) filter (where o_orderpriority like '2%') as p2, count(*) as total from orders group by o_orderstatus")
def agg_45(spark, sf):
    o = V.table(spark, sf, "orders").groupBy("o_orderstatus")
    return o.agg(F.count_if(F.col("o_orderpriority").startswith("1")).alias("p1"), F.count_if(F.col("o_orderpriority").startswith("2")).alias("p2"), F.count("*").alias("total"))


@query("sc_sev_04_levels", duck("v_boxes", body="select frame_id, box_id, part, case when depth_norm >= 0.75 then 'Emergency closure' when depth_norm >= 0.55 then 'Urgent repair' when depth_norm >= 0.35 then 'Priority repair' when depth_norm >= 0.15 then 'Schedule maintenance' else 'Monitor' end as action from v_boxes"))
def sc_sev_04(spark, sf):
    return V.boxes(spark, sf).select("frame_id", "box_id", "part", scoring.action(scoring.level(F.col("depth_norm"))).alias("action"))


@query("snk_02_quality_export", det(_GRID + f"select lat, lon, score, {bands('score', vocab.QUALITY_BANDS)} as band, n, worst from grid"))
def snk_02(spark, sf):
    return D.quality_grid(V.detections(spark, sf), vocab.AS_OF).select("lat", "lon", "score", "band", "n", "worst")


@query("tk_09_priority_pages", det("select id from (select id, round(coalesce(severity, 1) * ln(coalesce(detection_count, 1) + 1), 4) as p from v_detections) order by p desc, id limit 10 offset 40"))
def tk_09(spark, sf):
    return D.page(scored(spark, sf), "nonsense", 10, 5).select("id")


@query("flt_20_codes", "select o_orderkey from orders where o_orderstatus = 'O' and o_orderdate + interval 30 days > timestamp '2001-06-01'")
def flt_20(spark, sf):
    """Codes that are neither claimed nor expired."""
    return V.table(spark, sf, "orders").where("o_orderstatus = 'O' and o_orderdate + interval 30 days > timestamp_ntz '2001-06-01'").select("o_orderkey")


@query("agg_47_staged", "select p_partkey, coalesce(n, 0) as n_staged, n is null as missing from part left join (select l_partkey, count(*) as n from lineitem where l_returnflag = 'R' group by 1) on l_partkey = p_partkey")
def agg_47(spark, sf):
    n = V.table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return V.table(spark, sf, "part").join(n, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n_staged"), F.col("n").isNull().alias("missing"))


@query("sc_str_10_safe_paths", "select p_partkey, regexp_full_match(path, '[^/].*\\.jpg') and path not like '%..%' as safe from (select p_partkey, case p_partkey % 4 when 0 then '/' when 1 then '../' else '' end || p_brand || case p_partkey % 3 when 0 then '.png' else '.jpg' end as path from part)")
def sc_str_10(spark, sf):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 4 == 0, "/").when(k % 4 == 1, "../").otherwise(""), "p_brand", F.when(k % 3 == 0, ".png").otherwise(".jpg"))
    return V.table(spark, sf, "part").select("p_partkey", (path.rlike(r"^[^/].*\.jpg$") & ~path.contains("..")).alias("safe"))
