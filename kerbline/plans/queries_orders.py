"""Named queries over work orders, clocks, guards and rankings with their full rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.operators import detections as D
from kerbline.operators import orders, sampling
from kerbline.plans import views as V
from kerbline.plans.queries_streams import _LIFE, _classed
from kerbline.plans.queries_more import _live
from kerbline.plans.registry import query
from kerbline.plans.views import duck
from kerbline.streaming import lifecycle

_CHANGES = "c as (select work_order_id, case work_order_id % 3 when 0 then 'repaired' when 1 then 'verified' else 'in_progress' end as \"to\" from v_work_orders)"
_REOPENED = "is_fixed and last_detected > fixed_on"


def _asked(spark, sf):
    k = F.col("work_order_id")
    return V.work_orders(spark, sf).select(k, F.when(k % 3 == 0, "repaired").when(k % 3 == 1, "verified").otherwise("in_progress").alias("status"))


@query("wr_08_transitions", duck("v_detections", "v_items", "v_work_orders", body=f"""{_CHANGES},
b as (select work_order_id, list_sort(list(detection_id)) as ids from v_items join v_detections on id = detection_id where {_REOPENED} group by work_order_id)
select work_order_id, case when "to" = 'verified' and ids is not null then status else "to" end as status, "to" = 'verified' and ids is not null as refused, case when "to" = 'verified' then ids end as reopened_ids
from c join v_work_orders using (work_order_id) left join b using (work_order_id) where "to" <> status"""))
def wr_08(spark, sf):
    """Orders that are to be repaired, verified or taken up again, and which of them are refused."""
    return orders.transitions(V.work_orders(spark, sf), V.work_order_items(spark, sf), V.detections(spark, sf), _asked(spark, sf), D.reopened())


@query("wr_08_fixed_items", duck("v_detections", "v_items", "v_work_orders", body=f"""{_CHANGES}, d as (select distinct detection_id from v_items join c using (work_order_id) join v_work_orders using (work_order_id) where "to" = 'repaired' and status <> 'repaired')
select id, case when detection_id is not null then true else is_fixed end as is_fixed, case when detection_id is not null then date '{vocab.AS_OF}' else fixed_on end as fixed_on from v_detections left join d on detection_id = id"""))
def wr_08_items(spark, sf):
    d, items = V.detections(spark, sf), V.work_order_items(spark, sf)
    made = orders.transitions(V.work_orders(spark, sf), items, d, _asked(spark, sf), D.reopened())
    return orders.repaired(d, items, made, F.lit(vocab.AS_OF)).select("id", "is_fixed", "fixed_on")


@query("wr_12_item_edits", """with i as (select distinct l_suppkey as w, l_orderkey as d from lineitem), o as (select w, d, row_number() over (partition by w order by d) - 1 as s from i),
l as (select * from o where (d + w) % 3 <> 0), m as (select w, max(s) as last from l group by w),
a as (select s_suppkey as w, k * 7 + s_suppkey as d, min(k) as p from supplier, range(12) t(k) group by all),
f as (select a.*, row_number() over (partition by w order by p, d) as n from a where d in (select o_orderkey from orders) and not exists (select 1 from l where l.w = a.w and l.d = a.d))
select w as work_order_id, d as detection_id, s as sort_order from l union all select w, d, coalesce(last, -1) + n from f left join m using (w)""")
def wr_12(spark, sf):
    """A third of the items of every order goes, and up to twelve defects are added to each."""
    from pyspark.sql import Window

    items = V.work_order_items(spark, sf).withColumn("sort_order", (F.row_number().over(Window.partitionBy("work_order_id").orderBy("detection_id")) - 1).cast("long"))
    removed = items.where("(detection_id + work_order_id) % 3 = 0").select("work_order_id", "detection_id")
    k = F.col("position")
    added = V.work_orders(spark, sf).select("work_order_id", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("position")).withColumn("detection_id", k * 7 + F.col("work_order_id"))
    return orders.edited(items, V.detections(spark, sf).select("id"), removed, added)


@query("wr_07_promotions", _LIFE + """select 1000000 + event_id as id, confidence, detection_count, first_detected, cast('2024-01-01'::timestamp + to_seconds(cast(floor(t) as bigint) - 1704067200) as date) as last_detected
from (select event_id, t from life where action = 'promoted') join (
  select told as event_id, max(confidence) filter (where w.action in ('created', 'merged')) as confidence, count(*) filter (where w.action in ('created', 'merged')) as detection_count, min(created_at)::date as first_detected
  from w join v_reports r on r.report_id = w.report_id where w.action is not null group by told) using (event_id)""")
def wr_07(spark, sf):
    """Events that operators promoted, as the defects they become; the event is closed with it."""
    return lifecycle.promotions(lifecycle.life(_classed(_live(spark, sf)))).withColumn("id", F.col("id") + 1_000_000)


@query("agg_46_guards", """select 'keys' as guard, o_custkey as id, count(*) filter (where o_orderstatus = 'O') >= 3 as refused from orders group by o_custkey
union all select 'last admin', c_custkey, count(*) over (partition by c_nationkey) < 2 from customer where c_acctbal > 9000""")
def agg_46(spark, sf):
    """No more than three active keys for a user, and no nation without its last admin: customers of over 9000 stand for admins."""
    keys = V.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg((F.count_if(F.col("o_orderstatus") == "O") >= 3).alias("refused"))
    admins = orders.last_of_kind(V.table(spark, sf, "customer"), "c_nationkey", "c_custkey", F.col("c_acctbal") > 9000)
    return keys.select(F.lit("keys").alias("guard"), "id", "refused").unionByName(admins.select(F.lit("last admin").alias("guard"), F.col("c_custkey").alias("id"), "refused"))


@query("win_17_ranked_runs", """with r as (select l_partkey as run_id, count(distinct l_suppkey % 7) as classes, round(avg(l_quantity), 6) as mean from lineitem group by l_partkey)
select run_id, classes, mean, row_number() over (order by classes desc, mean desc, run_id) as position, max(mean) over (partition by classes) as anchor from r""")
def win_17(spark, sf):
    """Parts as runs, with the suppliers' numbers as classes."""
    r = V.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("run_id")).agg(F.countDistinct(F.col("l_suppkey") % 7).alias("classes"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    return orders.ranked_runs(r)


_ALIGN = """v as (select event_id as video_id, user_id, event_id % 900 as duration_s, case event_id % 6 when 0 then b when 1 then b - 7200 - event_id % 60 when 2 then b + event_id % 900 + 10800 * 20 when 3 then b - 3000 else b - 86400 * 3 - event_id % 100 * 97 end as start_s,
  b as begin_s, e as end_s, event_id % 6 >= 4 and event_id % 4 = 0 as same from events join (select user_id, floor(min(epoch(ts))) as b, floor(max(epoch(ts))) as e from events group by user_id) using (user_id))"""


@query("sc_dt_06_alignment", f"""with {_ALIGN}, h as (select *, round_even((start_s - begin_s) / 3600, 0) as h1, round_even((start_s - duration_s - begin_s) / 3600, 0) as h2 from v),
r as (select *, case when start_s between begin_s and end_s then 'inside' when same then 'embedded' when abs(start_s - begin_s - h1 * 3600) < 45 then 'start stamp' when abs(start_s - duration_s - begin_s - h2 * 3600) < 45 then 'end stamp' else 'unresolved' end as rule from h)
select video_id, case rule when 'embedded' then begin_s when 'start stamp' then start_s - h1 * 3600 when 'end stamp' then start_s - duration_s - h2 * 3600 else start_s end as start_s, rule, cast(case rule when 'start stamp' then h1 when 'end stamp' then h2 end as bigint) as hours from r""")
def sc_dt_06(spark, sf):
    """Recordings of all users against their tracks, with clocks that are wrong in several ways."""
    e = V.table(spark, sf, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("s"))
    tracks = e.groupBy(F.col("user_id").alias("track_id")).agg(F.min("s").alias("begin_s"), F.max("s").alias("end_s")).withColumn("stem", F.concat(F.lit("t"), F.col("track_id").cast("string")))
    i, b = F.col("event_id"), F.col("begin_s")
    v = e.join(tracks, F.col("user_id") == F.col("track_id"))
    start = F.when(i % 6 == 0, b).when(i % 6 == 1, b - 7200 - i % 60).when(i % 6 == 2, b + i % 900 + 10_800 * 20).when(i % 6 == 3, b - 3000).otherwise(b - 86_400 * 3 - i % 100 * 97)
    stem = F.when((i % 6 >= 4) & (i % 4 == 0), F.col("stem")).otherwise("other")
    videos = v.select(i.alias("video_id"), stem.alias("stem"), "track_id", start.alias("start_s"), (i % 900).cast("double").alias("duration_s"))
    return orders.aligned(videos, tracks)


@query("sc_math_02_rounding", "select p_partkey, round_even(p_size / 4 + p_partkey % 8 / 8, 0) as half_even, round(p_size / 4 + p_partkey % 8 / 8) as half_away, round_even((p_partkey % 1000) / 8, 2) as cents from part")
def sc_math_02(spark, sf):
    """Both ways to round halves, of numbers that often are halves."""
    x = F.col("p_size") / 4 + F.col("p_partkey") % 8 / 8
    return V.table(spark, sf, "part").select("p_partkey", F.bround(x).alias("half_even"), F.round(x).alias("half_away"), F.bround(F.col("p_partkey") % 1000 / 8, 2).alias("cents"))


@query("sc_dt_08_grid", """with v as (select c_custkey as video_id, (c_custkey % 90 / 4)::double as duration_s, greatest(1 / (1 + c_custkey % 5)::double, 0.3::double) as step from customer)
select video_id, i, i * step as t from (select *, unnest(range(cast(ceil(duration_s / step) as bigint) + 1)) as i from v where duration_s > 0) where i * step < duration_s""")
def sc_dt_08_grid(spark, sf):
    """Frames of a recording for each customer, of up to 22 seconds and one to five a second, at least 0.3 seconds apart."""
    k = F.col("c_custkey")
    return sampling.grid(V.table(spark, sf, "customer").select(k.alias("video_id"), (k % 90 / 4).alias("duration_s"), (1 + k % 5).alias("fps")), 0.3)


@query("sc_dt_08_middles", "select c_custkey as video_id, i, (i + 0.5::double) / n * (c_custkey % 90 / 4)::double as t from (select c_custkey, c_custkey % 7 as n, unnest(range(c_custkey % 7)) as i from customer)")
def sc_dt_08_middles(spark, sf):
    k = F.col("c_custkey")
    return sampling.middles(V.table(spark, sf, "customer").select(k.alias("video_id"), (k % 90 / 4).alias("duration_s"), (k % 7).alias("n")))
