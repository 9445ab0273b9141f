"""Queries that join: work orders, users, spatial and similarity joins, as-of joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import scoring
from kerbline.operators import similarity, spatial, statistics
from kerbline.plans import views as V
from kerbline.plans.queries_detections import case, det, metres
from kerbline.plans.registry import query
from kerbline.plans.views import duck


@query("jn_01_order_items", duck("v_detections", "v_items", body="select work_order_id, id, damage_type, severity from v_items join v_detections on detection_id = id"))
def jn_01(spark, sf):
    items = V.work_order_items(spark, sf)
    return items.join(V.detections(spark, sf), F.col("detection_id") == F.col("id")).select("work_order_id", "id", "damage_type", "severity")


@query("jn_02_leaderboard", duck("v_users", body="select u.user_id, u.city, u.points_total, count(o_orderkey) as reports from v_users u join orders on o_custkey = u.user_id where points_total > 0 group by all"))
def jn_02(spark, sf):
    n = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("reports"))
    return V.users(spark, sf).where("points_total > 0").join(n, "user_id").select("user_id", "city", "points_total", "reports")


@query("jn_03_recent_events", duck("v_reports", body="t as (select event_id, max(created_at) as latest from v_reports where user_id = 7 group by event_id order by latest desc, event_id limit 50) select event_id, latest, count(*) as reports from v_reports join t using (event_id) group by all"))
def jn_03(spark, sf):
    r = V.reports(spark, sf)
    top = r.where("user_id = 7").groupBy("event_id").agg(F.max("created_at").alias("latest")).orderBy(F.desc("latest"), "event_id").limit(50)
    return r.join(top, "event_id").groupBy("event_id", "latest").agg(F.count("*").alias("reports"))


@query("jn_04_counts_or_zero", duck("v_work_orders", "v_items", body="select w.work_order_id, w.status, coalesce(n, 0) as items from v_work_orders w left join (select work_order_id, count(*) as n from v_items group by all) using (work_order_id)"))
def jn_04(spark, sf):
    n = V.work_order_items(spark, sf).groupBy("work_order_id").agg(F.count("*").alias("n"))
    return V.work_orders(spark, sf).join(n, "work_order_id", "left").select("work_order_id", "status", F.coalesce("n", F.lit(0)).alias("items"))


_NEAR = f"""p as (select id, latitude, longitude, damage_type, cast(floor(latitude * 2000) as bigint) as y, cast(floor(longitude * 1000) as bigint) as x from v_detections),
q as (select p.*, y + dy as ny, x + dx as nx from p, (values (-1), (0), (1)) a(dy), (values (-1), (0), (1)) b(dx)),
near as (select q.id as a, p.id as b, q.damage_type = p.damage_type as same, {metres('q.latitude', 'q.longitude', 'p.latitude', 'p.longitude')} as m from q join p on p.y = q.ny and p.x = q.nx)
"""


@query("jn_05_nearest_same_kind", det(_NEAR + "select a as id, b as target_id, round(m, 6) as metres from (select *, row_number() over (partition by a order by round(m, 6), b) as r from near where same and a <> b and m <= 25) where r = 1"))
def jn_05(spark, sf):
    d = V.detections(spark, sf).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("damage_type").alias("kind"))
    return spatial.nearest_other(d, 25)


@query("jn_07_density", det(_NEAR + "select a as id, count(*) - 1 as surrounding_density from near where m <= 50 group by a"))
def jn_07(spark, sf):
    return spatial.density(V.detections(spark, sf).select("id", "latitude", "longitude"), 50).select("id", "surrounding_density")


@query("jn_08_links", det(_NEAR + "select count(*) as links, count(distinct a) as linked from near where m <= 2 and a <> b"))
def jn_08(spark, sf):
    return spatial.link_counts(V.detections(spark, sf), 2)


_TRACK = """fixes as (select user_id as track_id, epoch(ts) as t, any_value((46700000 + (event_id * 37) % 90000) / 1e6) as lat, any_value((23500000 + (event_id * 91) % 90000) / 1e6) as lon
  from (select *, row_number() over (partition by user_id, ts order by event_id) as r from events) where r = 1 group by all),
frames as (select user_id as track_id, user_id * 100 + i as frame_id, epoch(timestamp '2024-01-01') + i * 27000.5::double as t from (select distinct user_id from events), range(100) x(i)),
b as (select frames.*, (select max(t) from fixes f where f.track_id = frames.track_id and f.t <= frames.t) as t0, (select min(t) from fixes f where f.track_id = frames.track_id and f.t >= frames.t) as t1 from frames),
m as (select b.*, x.lat as lat0, x.lon as lon0, y.lat as lat1, y.lon as lon1, case when t1 > t0 then (b.t - t0) / (t1 - t0) else 0.0::double end as s from b left join fixes x on x.track_id = b.track_id and x.t = t0 left join fixes y on y.track_id = b.track_id and y.t = t1)
"""


def _track(spark, sf):
    e = V.table(spark, sf, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    at = e.select(
        F.col("user_id").alias("track_id"), seconds.alias("t"), "event_id", ((F.lit(46700000) + (F.col("event_id") * 37) % 90000) / 1e6).alias("lat"), ((F.lit(23500000) + (F.col("event_id") * 91) % 90000) / 1e6).alias("lon")
    )
    fixes = at.groupBy("track_id", "t").agg(F.min_by(F.struct("lat", "lon"), "event_id").alias("p")).select("track_id", "t", "p.lat", "p.lon")
    frames = e.select("user_id").distinct().select(F.col("user_id").alias("track_id"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    return frames.select("track_id", (F.col("track_id") * 100 + F.col("i")).alias("frame_id"), (F.lit(1704067200.0) + F.col("i") * 27000.5).alias("t")), fixes


@query("jn_09_interpolated", "with " + _TRACK + "select track_id, frame_id, round(lat0 + (lat1 - lat0) * s, 7) as lat, round(lon0 + (lon1 - lon0) * s, 7) as lon from m")
def jn_09(spark, sf):
    out = spatial.interpolate(*_track(spark, sf))
    return out.select("track_id", "frame_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("jn_10_clamped", "with " + _TRACK + "select track_id, frame_id, round(coalesce(lat0 + (lat1 - lat0) * s, lat0, lat1), 7) as lat, round(coalesce(lon0 + (lon1 - lon0) * s, lon0, lon1), 7) as lon from m")
def jn_10(spark, sf):
    out = spatial.interpolate(*_track(spark, sf), clamp=True)
    return out.select("track_id", "frame_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query("jn_13_has_vote", duck("v_reports", body="select report_id from v_reports r where kind = 'dispute' and exists (select 1 from v_reports c where c.event_id = r.event_id and c.device_id = r.device_id and c.kind = 'confirm')"))
def jn_13(spark, sf):
    r = V.reports(spark, sf)
    votes = r.where("kind = 'confirm'").select("event_id", "device_id").distinct()
    return r.where("kind = 'dispute'").join(votes, ["event_id", "device_id"], "left_semi").select("report_id")


@query("jn_14_missing", duck("v_detections", "v_items", body="select work_order_id, detection_id from v_items where detection_id not in (select id from v_detections where severity >= 3)"))
def jn_14(spark, sf):
    """For each work order its items that no defect of severity 3 or more answers to."""
    wanted = V.work_order_items(spark, sf)
    there = V.detections(spark, sf).where("severity >= 3").select(F.col("id").alias("detection_id"))
    return wanted.join(there, "detection_id", "left_anti")


@query("jn_17_supporters", duck("v_reports", "v_users", body="select distinct r.event_id, u.user_id, u.city from v_reports r join v_users u using (user_id) where kind <> 'dispute'"))
def jn_17(spark, sf):
    r = V.reports(spark, sf).where("kind != 'dispute'").select("event_id", "user_id").distinct()
    return r.join(V.users(spark, sf), "user_id").select("event_id", "user_id", "city")


#: 64-bit hash of a text: bit i says whether bucket i holds more words than bucket i + 1, of 65 buckets.
_PHASH = """w as (select doc_id, cast('0x' || substr(md5(lower(unnest(regexp_extract_all(text, '\\S+')))), 1, 8) as bigint) % 65 as b from documents),
c as (select doc_id, b, count(*) as n from w group by all),
bits as (select d.doc_id, i, coalesce(x.n, 0) > coalesce(y.n, 0) as bit from documents d cross join range(64) r(i) left join c x on x.doc_id = d.doc_id and x.b = i left join c y on y.doc_id = d.doc_id and y.b = i + 1),
h as (select doc_id, string_agg(case when bit then '1' else '0' end, '' order by i desc) as h from bits group by doc_id)
"""


def phashes(spark, sf):
    words = V.table(spark, sf, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^\t\n\f\r ]+"), F.lit(0))).alias("w"))
    low = F.lower(F.translate("w", "\u03a3\u0130", "\u03c3i"))  # letter by letter: no final sigma, no dot that combines
    bucket = (F.conv(F.substring(F.md5(low), 1, 8), 16, 10).cast("long") % 65).cast("int")
    counts = words.groupBy("doc_id", bucket.alias("b")).agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    n = [F.coalesce(F.element_at("m", F.lit(i)), F.lit(0)) for i in range(65)]
    bits = F.concat(*(F.when(n[i] > n[i + 1], "1").otherwise("0") for i in reversed(range(64))))
    return counts.select("doc_id", bits.alias("bits"), similarity.packed(bits).alias("h"))


@query("sc_math_06_hash", "with " + _PHASH + "select doc_id, h as bits from h where doc_id in (select doc_id from w)")
def sc_math_06(spark, sf):
    return phashes(spark, sf).select("doc_id", "bits")


@query("jn_18_hamming", "with " + _PHASH + "select a.doc_id as id, min(b.doc_id) filter (where a.h = b.h) as class_id, count(*) - 1 as links, count(*) filter (where a.h = b.h) - 1 as copies from h a join h b on bit_count(xor(cast(a.h as bit), cast(b.h as bit))) <= 2 where a.doc_id in (select doc_id from w) and b.doc_id in (select doc_id from w) group by a.doc_id")
def jn_18(spark, sf):
    return similarity.hamming_links(phashes(spark, sf).select(F.col("doc_id").alias("id"), "h"), 2)


@query("cl_03_duplicate_groups", ("with " + _PHASH + """, g as (select h, min(doc_id) as low from h where doc_id in (select doc_id from w) group by h),
e as (select a.low as a, b.low as b from g a join g b on bit_count(xor(cast(a.h as bit), cast(b.h as bit))) <= 2), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
r as (select a, min(b) as group_id from reach group by a), o as (select doc_id as id, group_id from h join g using (h) join r on r.a = g.low)
select id, group_id, count(*) over (partition by group_id) as group_size from o""").replace("with ", "with recursive ", 1))
def cl_03(spark, sf):
    return similarity.duplicate_groups(phashes(spark, sf).select(F.col("doc_id").alias("id"), "h"), 2)


@query("cl_01_dbscan", det(_NEAR + ", e as (select distinct a, b from near where m <= 2), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b) select a as id, count(*) as cluster_size, min(b) as first_member from reach group by a").replace("with ", "with recursive ", 1))
def cl_01(spark, sf):
    c = spatial.clusters(V.detections(spark, sf).select("id", "latitude", "longitude", "confidence"), 2)
    size = c.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), F.min("id").alias("first_member"))
    return c.join(size, "cluster_id").select("id", "cluster_size", "first_member")


@query("cl_02_representatives", det(_NEAR + """, e as (select distinct a, b from near where m <= 2), reach(a, b) as (select a, b from e union select r.a, e.b from reach r join e on e.a = r.b),
c as (select a as id, min(b) as c from reach group by a), k as (select id, count(*) over (partition by c) as cluster_size, row_number() over (partition by c order by confidence desc, id) > 1 as is_duplicate from c join v_detections using (id))
select id, cluster_size, is_duplicate from k""").replace("with ", "with recursive ", 1))
def cl_02(spark, sf):
    c = spatial.clusters(V.detections(spark, sf).select("id", "latitude", "longitude", "confidence"), 2)
    return spatial.representatives(c, F.col("confidence")).select("id", "cluster_size", "is_duplicate")


@query("sc_sev_03_box_scores", duck("v_boxes", body=f"""s as (select *, round(least(depth_norm, 1.0), 4) as s1, round(least(surface_area_px / 1000.0::double, 1.0), 4) as s2, round(least(interior_contrast / 2.0::double, 1.0), 4) as s3, round(least(edge_sharpness / 60.0::double, 1.0), 4) as s4 from v_boxes)
select class_name, count(*) as n, round(avg({' + '.join(f"{case('class_name', {c: w[i] for c, w in vocab.SIGNAL_WEIGHTS.items()}, 0.25)}::double * s{i + 1}" for i in range(4))}), 3) as mean_raw from s group by class_name"""))
def sc_sev_03(spark, sf):
    b = V.boxes(spark, sf)
    raw = scoring.raw_score(F.col("class_name"), F.col("depth_norm"), F.col("surface_area_px"), F.col("interior_contrast"), F.col("edge_sharpness"))
    return b.groupBy("class_name").agg(F.count("*").alias("n"), F.round(F.avg(raw), 3).alias("mean_raw"))


@query("flt_10_thresholds", duck("v_boxes", body="select class_name, count(*) as kept from v_boxes where confidence >= case when class_name = 'lane_line_blur' then 0.5 else 0.35 end group by class_name"))
def flt_10(spark, sf):
    threshold = scoring.chosen(F.col("class_name"), vocab.THRESHOLDS, vocab.DEFAULT_THRESHOLD)
    return V.boxes(spark, sf).where(F.col("confidence") >= threshold).groupBy("class_name").agg(F.count("*").alias("kept"))


@query("agg_11_validation", duck("v_reports", body="select event_id, count(distinct device_id) filter (where kind <> 'dispute') as supporters, count(distinct device_id) filter (where kind = 'dispute') as disputers, count_if(kind = 'sighting') as sightings from v_reports group by event_id"))
def agg_11(spark, sf):
    kind = F.col("kind")
    return V.reports(spark, sf).groupBy("event_id").agg(
        F.countDistinct(F.when(kind != "dispute", F.col("device_id"))).alias("supporters"), F.countDistinct(F.when(kind == "dispute", F.col("device_id"))).alias("disputers"), F.count_if(kind == "sighting").alias("sightings")
    )


@query("agg_12_last_hour", duck("v_reports", body="select count(*) as reports, count(distinct device_id) as devices, count(distinct event_id) as events from v_reports where created_at >= timestamp '2024-01-15 11:00:00' and created_at < timestamp '2024-01-15 12:00:00'"))
def agg_12(spark, sf):
    r = V.reports(spark, sf).where("created_at >= timestamp_ntz '2024-01-15 11:00:00' and created_at < timestamp_ntz '2024-01-15 12:00:00'")
    return r.agg(F.count("*").alias("reports"), F.countDistinct("device_id").alias("devices"), F.countDistinct("event_id").alias("events"))


@query("sc_cond_02_status", duck("v_reports", body="c as (select event_id, count(distinct device_id) filter (where kind <> 'dispute') as s, count(distinct device_id) filter (where kind = 'dispute') as d from v_reports group by event_id) select event_id, case when s >= 3 then 'verified' when s >= 2 then 'confirmed' else 'unverified' end as status, d >= greatest(2, s) as removed from c"))
def sc_cond_02(spark, sf):
    c = agg_11(spark, sf)
    status = F.when(F.col("supporters") >= 3, "verified").when(F.col("supporters") >= 2, "confirmed").otherwise("unverified")
    return c.select("event_id", status.alias("status"), (F.col("disputers") >= F.greatest(F.lit(2), F.col("supporters"))).alias("removed"))


@query("win_02_city_rank", duck("v_users", body="select user_id, city, rank() over (order by points_total desc) as rank, rank() over (partition by city order by points_total desc) as city_rank from v_users"))
def win_02(spark, sf):
    """Competition ranks without one task for all users or for a city: users are counted by points, and the counts above are added up."""
    u = V.users(spark, sf)
    down = -F.col("points_total")
    every = statistics.running(u.groupBy("points_total").agg(F.count("*").alias("n")), [], down).select("points_total", (F.col("before") + 1).alias("rank"))
    own = statistics.running(u.groupBy("city", "points_total").agg(F.count("*").alias("n")), ["city"], down).select("city", "points_total", (F.col("before") + 1).alias("city_rank"))
    return u.join(every, "points_total").join(own, ["city", "points_total"]).select("user_id", "city", "rank", "city_rank")


@query("win_03_leaderboard", duck("v_users", body="select user_id, points_total, row_number() over (order by points_total desc, user_id) as position from v_users order by points_total desc, user_id limit 50"))
def win_03(spark, sf):
    top = V.users(spark, sf).orderBy(F.desc("points_total"), "user_id").limit(50)
    return top.select("user_id", "points_total", F.row_number().over(Window.orderBy(F.desc("points_total"), "user_id")).cast("long").alias("position"))


@query("win_04_streaks", duck("v_reports", body="d as (select distinct user_id, cast((created_at at time zone 'UTC') at time zone 'Europe/Bucharest' as date) as day from v_reports), i as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as island from d), n as (select user_id, island, count(*) as streak, max(day) as last_day from i group by all) select user_id, max(streak) as best_streak, max_by(streak, last_day) as current_streak from n group by user_id"))
def win_04(spark, sf):
    """Runs of local days."""
    local = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), "Europe/Bucharest")
    d = V.reports(spark, sf).select("user_id", local.cast("date").alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    n = d.withColumn("island", island).groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.max("day").alias("last_day"))
    return n.groupBy("user_id").agg(F.max("streak").alias("best_streak"), F.max_by("streak", "last_day").alias("current_streak"))


@query("win_05_newest", duck("v_reports", body="select report_id, user_id from (select *, row_number() over (partition by user_id order by created_at desc, report_id desc) as r from v_reports) where r <= 20"))
def win_05(spark, sf):
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("report_id"))
    return V.reports(spark, sf).withColumn("r", F.row_number().over(w)).where("r <= 20").select("report_id", "user_id")


@query("win_06_changes", duck("v_reports", body="select report_id from (select *, lag(latitude) over w as pl, lag(longitude) over w as po from v_reports window w as (partition by user_id order by created_at, report_id)) where pl is null or pl <> latitude or po <> longitude"))
def win_06(spark, sf):
    w = Window.partitionBy("user_id").orderBy("created_at", "report_id")
    r = V.reports(spark, sf).select("*", F.lag("latitude").over(w).alias("pl"), F.lag("longitude").over(w).alias("po"))
    return r.where("pl is null or pl != latitude or po != longitude").select("report_id")


@query("win_07_legs", duck("v_reports", body=f"l as (select *, coalesce({metres('lag(latitude) over w', 'lag(longitude) over w', 'latitude', 'longitude', 6371.0088)}, 0) as km from v_reports window w as (partition by user_id order by created_at, report_id)) select report_id, round(km, 5) as leg_km, round(sum(km) over (partition by user_id order by created_at, report_id), 5) as total_km from l"))
def win_07(spark, sf):
    from kerbline.functions.geo import haversine_m

    w = Window.partitionBy("user_id").orderBy("created_at", "report_id")
    km = F.coalesce(haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"), 6371.0088), F.lit(0.0))
    legs = V.reports(spark, sf).withColumn("km", km)
    return legs.select("report_id", F.round("km", 5).alias("leg_km"), F.round(F.sum("km").over(w.rowsBetween(Window.unboundedPreceding, 0)), 5).alias("total_km"))


@query("win_08_tied_ranks", "select s_nationkey, s_suppkey, rank() over w + (count(*) over (partition by s_nationkey, floor(s_acctbal / 1000)) - 1) / 2 as fractional_rank from supplier window w as (partition by s_nationkey order by floor(s_acctbal / 1000))")
def win_08(spark, sf):
    s = V.table(spark, sf, "supplier").withColumn("v", F.floor(F.col("s_acctbal") / 1000))
    ranks = statistics.ranks(s, "s_nationkey", "v")
    return s.join(ranks, ["s_nationkey", "v"]).select("s_nationkey", "s_suppkey", F.col("r").alias("fractional_rank"))


@query("win_09_running_best", duck("v_reports", body="select report_id, max(confidence) over (partition by user_id order by created_at, report_id) as best from v_reports"))
def win_09(spark, sf):
    w = Window.partitionBy("user_id").orderBy("created_at", "report_id").rowsBetween(Window.unboundedPreceding, 0)
    return V.reports(spark, sf).select("report_id", F.max("confidence").over(w).alias("best"))


@query("win_19_held_heading", duck("v_reports", body="select report_id, last_value(case when kind = 'sighting' then severity end ignore nulls) over (partition by user_id order by created_at, report_id) as held from v_reports"))
def win_19(spark, sf):
    w = Window.partitionBy("user_id").orderBy("created_at", "report_id").rowsBetween(Window.unboundedPreceding, 0)
    return V.reports(spark, sf).select("report_id", F.last(F.when(F.col("kind") == "sighting", F.col("severity")), ignorenulls=True).over(w).alias("held"))
