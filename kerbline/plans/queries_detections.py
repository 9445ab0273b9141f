"""Queries on the inventory: filters, summaries, grids, rankings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import scoring
from kerbline.operators import detections as D
from kerbline.plans import views as V
from kerbline.plans.registry import query
from kerbline.plans.views import duck

AS_OF = vocab.AS_OF
DAY = f"date '{AS_OF}'"


def case(column: str, values: dict, other: object) -> str:
    return f"case {column} " + " ".join(f"when {k!r} then {v}" for k, v in values.items()) + f" else {other} end"


def bands(column: str, table) -> str:
    return "case " + " ".join(f"when {column} >= {floor} then '{name}'" for name, floor in table) + " else 'E' end"


def det(body: str) -> str:
    return duck("v_detections", body=body)


PRIORITY = "round(coalesce(severity, 1) * ln(coalesce(detection_count, 1) + 1), 4)"


def mean_degrees(c: str) -> str:
    return f"((2 * sum(cast(round({c} * 1e6) as bigint)) + count(*)) // (2 * count(*))) / 1e6"


def scored(spark, sf):
    return V.detections(spark, sf).withColumn("priority_score", scoring.priority_v2(F.col("severity"), F.col("detection_count")))


@query("src_01_scan", det("select id, latitude, longitude, damage_type, severity, confidence, first_detected, last_detected, detection_count, is_fixed, fixed_on, survey_date from v_detections"))
def src_01(spark, sf):
    return V.detections(spark, sf)


@query("flt_01_conjunction", det("select id, severity, last_detected from v_detections where damage_type = 'pothole' and severity >= 2 and severity <= 4 and last_detected >= date '1996-01-01' and last_detected <= date '2000-12-31'"))
def flt_01(spark, sf):
    return D.select(V.detections(spark, sf), "pothole", 2, 4, dt.date(1996, 1, 1), dt.date(2000, 12, 31)).select("id", "severity", "last_detected")


@query("flt_02_box", det("select id, latitude, longitude from v_detections where longitude between 23.52 and 23.58 and latitude between 46.71 and 46.76"))
def flt_02(spark, sf):
    return D.in_box(V.detections(spark, sf), 23.52, 46.71, 23.58, 46.76).select("id", "latitude", "longitude")


HAVERSINE = "2 * {r} * asin(sqrt(least(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2), 1.0)))"


def metres(a: str, c: str, b: str, d: str, r: float = vocab.EARTH_M) -> str:
    return HAVERSINE.format(a=a, b=b, c=c, d=d, r=r)


@query("flt_03_radius", det(f"select id, round(m, 3) as metres from (select id, {metres('latitude', 'longitude', '46.75', '23.57')} as m from v_detections) where m <= 900"))
def flt_03(spark, sf):
    return D.in_radius(V.detections(spark, sf), 46.75, 23.57, 900).select("id", F.round("metres", 3).alias("metres"))


@query("flt_04_lookup", det("select id, damage_type, severity from v_detections where id = 42"))
def flt_04(spark, sf):
    return V.detections(spark, sf).where("id = 42").select("id", "damage_type", "severity")


@query("flt_05_in_list", det("select id, damage_type from v_detections where id in (select detection_id from v_items join v_work_orders using (work_order_id) where status = 'open')").replace("with ", "with " + V.DUCK["v_items"] + ", " + V.DUCK["v_work_orders"] + ", ", 1))
def flt_05(spark, sf):
    open_orders = V.work_orders(spark, sf).where("status = 'open'")
    wanted = V.work_order_items(spark, sf).join(open_orders, "work_order_id", "left_semi").select(F.col("detection_id").alias("id"))
    return V.detections(spark, sf).join(wanted, "id", "left_semi").select("id", "damage_type")


@query("flt_06_null_logic", det("select count(*) as total, count_if(is_fixed is null) as unknown, count_if(is_fixed = false) as strictly_open, count(*) - count_if(is_fixed) as not_fixed, count_if(severity is null) as unrated, count_if(severity is not null) as rated from v_detections"))
def flt_06(spark, sf):
    c = F.col
    return V.detections(spark, sf).agg(
        F.count("*").alias("total"), F.count_if(c("is_fixed").isNull()).alias("unknown"), F.count_if(~c("is_fixed")).alias("strictly_open"),
        F.count_if(~F.coalesce("is_fixed", F.lit(False))).alias("not_fixed"), F.count_if(c("severity").isNull()).alias("unrated"), F.count_if(c("severity").isNotNull()).alias("rated"),
    )


@query("flt_07_same_ignoring_case", duck("v_users", body="select user_id, city from v_users where lower(city) = lower('NATION_3') or lower(city) = lower('nation_7')"))
def flt_07(spark, sf):
    return V.users(spark, sf).where(F.lower("city").isin("nation_3", "nation_7"))[["user_id", "city"]]


@query("flt_08_ilike", duck("v_users", body="select user_id, city from v_users where city ilike 'nation_1%'"))
def flt_08(spark, sf):
    return V.users(spark, sf).where(F.col("city").ilike("nation_1%"))[["user_id", "city"]]


@query("flt_09_reopened", det("select id, fixed_on, last_detected from v_detections where is_fixed and last_detected > fixed_on"))
def flt_09(spark, sf):
    return V.detections(spark, sf).where(D.reopened()).select("id", "fixed_on", "last_detected")


@query("flt_14_zone", det("select id from v_detections where damage_type in ('pothole', 'rutting') and (severity is null or severity in (3, 4, 5)) and not coalesce(is_fixed, false) and latitude between 46.7 and 46.76 and longitude between 23.5 and 23.6"))
def flt_14(spark, sf):
    d = D.in_box(V.detections(spark, sf), 23.5, 46.7, 23.6, 46.76)
    return d.where(F.col("damage_type").isin("pothole", "rutting") & (F.col("severity").isNull() | F.col("severity").isin(3, 4, 5)) & ~F.coalesce("is_fixed", F.lit(False))).select("id")


@query("flt_15_declutter", det("select id, severity from v_detections where (select count(*) from v_detections) <= 3000 or severity >= 3"))
def flt_15(spark, sf):
    d = V.detections(spark, sf)
    return d.where((d.agg(F.count("*")).scalar() <= 3000) | (F.col("severity") >= 3)).select("id", "severity")


@query("prj_01_public_columns", det("select id, latitude, longitude, damage_type, severity, last_detected, coalesce(is_fixed and last_detected > fixed_on, false) as reopened, detection_count > 1 as has_evidence from v_detections"))
def prj_01(spark, sf):
    d = V.detections(spark, sf)
    return d.select("id", "latitude", "longitude", "damage_type", "severity", "last_detected", D.reopened().alias("reopened"), (F.col("detection_count") > 1).alias("has_evidence"))


@query("agg_01_city_stats", det("select count(*) as total, max(survey_date) as last_survey, count_if(survey_date = (select max(survey_date) from v_detections)) as today, round(avg(severity), 2) as avg_severity, round(avg(confidence), 3) as avg_confidence, count_if(severity >= 4) as critical, count_if(is_fixed) as fixed from v_detections"))
def agg_01(spark, sf):
    return D.city_stats(V.detections(spark, sf))


@query("agg_02_by_type", det("select damage_type, count(*) as n from v_detections group by damage_type"))
def agg_02(spark, sf):
    return V.detections(spark, sf).groupBy("damage_type").agg(F.count("*").alias("n"))


@query("agg_03_by_severity", det("select severity, count(*) as n from v_detections where severity is not null group by severity order by severity"))
def agg_03(spark, sf):
    return V.detections(spark, sf).where("severity is not null").groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity")


@query("agg_04_operations", det("select round(avg(fixed_on - first_detected), 1) as avg_days_to_fix, count_if(is_fixed) as fixed, count_if(not coalesce(is_fixed, false)) as open, count_if(is_fixed and last_detected > fixed_on) as reopened, count_if(is_fixed = false and severity >= 4) as open_critical from v_detections"))
def agg_04(spark, sf):
    return V.detections(spark, sf).agg(
        F.round(F.avg(F.datediff("fixed_on", "first_detected")), 1).alias("avg_days_to_fix"), F.count_if("is_fixed").alias("fixed"), F.count_if(~F.coalesce("is_fixed", F.lit(False))).alias("open"),
        F.count_if(D.reopened()).alias("reopened"), F.count_if(~F.col("is_fixed") & (F.col("severity") >= 4)).alias("open_critical"),
    )


@query(
    "agg_05_weekly_trend",
    det(
        """a as (select cast(date_trunc('week', first_detected) as date) as week, count(*) as new_count from v_detections where first_detected >= date '2001-07-01' - 84 group by 1),
b as (select cast(date_trunc('week', fixed_on) as date) as week, count(*) as fixed_count from v_detections where fixed_on >= date '2001-07-01' - 84 group by 1)
select week, coalesce(new_count, 0) as new_count, coalesce(fixed_count, 0) as fixed_count from a full join b using (week)"""
    ),
)
def agg_05(spark, sf):
    return D.weekly_trend(V.detections(spark, sf), dt.date(2001, 7, 1))


@query("agg_06_budget", duck("v_work_orders", body="select round(sum(cost_estimate_ron), 2) as total, round(sum(cost_estimate_ron) filter (status in ('open', 'scheduled', 'in_progress')), 2) as active, round(sum(cost_estimate_ron) filter (status in ('repaired', 'verified')), 2) as done, count_if(status = 'open') as open, count_if(status = 'cancelled') as cancelled from v_work_orders"))
def agg_06(spark, sf):
    def of(*s):
        return F.round(F.sum(F.when(F.col("status").isin(*s), F.col("cost_estimate_ron"))), 2)

    w = V.work_orders(spark, sf)
    return w.agg(
        F.round(F.sum("cost_estimate_ron"), 2).alias("total"), of("open", "scheduled", "in_progress").alias("active"), of("repaired", "verified").alias("done"),
        F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") == "cancelled").alias("cancelled"),
    )


_GRID = f"""cells as (
  select cast(floor(latitude / ({120 / vocab.METRES_PER_DEGREE!r})) as bigint) as y, cast(floor(longitude / (120.0::double / ({vocab.METRES_PER_DEGREE}::double * greatest(cos(radians((select avg(latitude) from v_detections))), 0.1)))) as bigint) as x,
    {mean_degrees('latitude')} as lat, {mean_degrees('longitude')} as lon, count(*) as n, max(severity) as worst,
    sum({case('severity', vocab.QUALITY_WEIGHTS, 1.0)}::double * exp(-greatest({DAY} - last_detected, 0) / 180.0::double) * case when is_fixed then 0.2::double else 1.0::double end) as penalty
  from v_detections group by 1, 2),
grid as (select y, x, lat, lon, cast(least(greatest(round(100 * exp(-penalty / 8.0::double)), 0), 100) as integer) as score, n, worst from cells)
"""


@query("agg_07_rqi_grid", det(_GRID + f"select *, {bands('score', vocab.QUALITY_BANDS)} as band from grid"))
def agg_07(spark, sf):
    return D.quality_grid(V.detections(spark, sf), AS_OF)


@query("agg_08_heat", det(f"select round(cast(latitude as decimal(12,6)), 4) as lat_bin, round(cast(longitude as decimal(12,6)), 4) as lon_bin, round(sum(severity * ln(detection_count + 1)), 6) as weight, {mean_degrees('latitude')} as lat, {mean_degrees('longitude')} as lon, count(*) as n from v_detections where severity is not null group by 1, 2"))
def agg_08(spark, sf):
    return D.heat(V.detections(spark, sf), 20_000)


@query("agg_09_landing", det(f"s as (select count(*) as total, count_if(is_fixed) as fixed, count_if(severity >= 4) as critical, round(avg(severity), 2) as avg_severity from v_detections), t as (select *, cast(round(100 * exp(-avg_severity * (0.4::double + 0.6::double * (total - fixed) / total) / 3.2::double)) as integer) as score from s) select *, {bands('score', vocab.LANDING_BANDS)} as grade from t"))
def agg_09(spark, sf):
    s = V.detections(spark, sf).agg(F.count("*").alias("total"), F.count_if("is_fixed").alias("fixed"), F.count_if(F.col("severity") >= 4).alias("critical"), F.round(F.avg("severity"), 2).alias("avg_severity"))
    share = 0.4 + 0.6 * (F.col("total") - F.col("fixed")) / F.col("total")
    s = s.withColumn("score", F.round(100 * F.exp(-F.col("avg_severity") * share / 3.2)).cast("int"))
    return s.withColumn("grade", scoring.banded(F.col("score"), vocab.LANDING_BANDS))


@query("agg_10_public_stats", det("select 'type' as kind, damage_type as key, count(*) as n from v_detections group by all union all select 'severity', cast(severity as varchar), count(*) from v_detections where severity is not null group by all union all select 'total', '', count(*) from v_detections union all select 'open', '', count(*) - count_if(is_fixed) from v_detections"))
def agg_10(spark, sf):
    d = V.detections(spark, sf)
    sets = d.groupingSets([[F.col("damage_type")], [F.col("severity")], []], F.col("damage_type"), F.col("severity")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("is_fixed").alias("fixed")
    )
    kind = F.when(F.col("g") == 1, "type").when(F.col("g") == 2, "severity").otherwise("total")
    key = F.when(F.col("g") == 1, F.col("damage_type")).when(F.col("g") == 2, F.col("severity").cast("string")).otherwise("")
    rows = F.when(F.col("g") == 3, F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("key"), F.col("n").alias("n")), F.struct(F.lit("open").alias("kind"), F.lit("").alias("key"), (F.col("n") - F.col("fixed")).alias("n"))))
    rows = rows.otherwise(F.array(F.struct(kind.alias("kind"), key.alias("key"), F.col("n").alias("n"))))
    return sets.where("g != 2 or severity is not null").select(F.inline(rows))


@query("agg_15_best_of_place", det("select id, latitude, longitude from (select *, row_number() over (partition by latitude, longitude order by confidence desc, id) as r from v_detections) where r = 1"))
def agg_15(spark, sf):
    d = V.detections(spark, sf)
    best = d.groupBy("latitude", "longitude").agg(F.max(F.struct("confidence", (-F.col("id")).alias("id"))).alias("b"))
    return best.select((-F.col("b.id")).alias("id"), "latitude", "longitude")


@query("agg_28_pivot", det("select damage_type, " + ", ".join(f"count_if(severity = {s}) as s{s}" for s in range(1, 6)) + ", count(severity) as total from v_detections group by damage_type order by total desc, damage_type limit 8"))
def agg_28(spark, sf):
    p = V.detections(spark, sf).groupBy("damage_type").pivot("severity", [1, 2, 3, 4, 5]).count().na.fill(0)
    p = p.select("damage_type", *(F.col(str(s)).alias(f"s{s}") for s in range(1, 6)))
    return p.withColumn("total", sum((F.col(f"s{s}") for s in range(2, 6)), F.col("s1"))).orderBy(F.desc("total"), "damage_type").limit(8)


@query("agg_29_timeline", det("select last_detected, count(*) as total, count_if(severity >= 4) as critical from v_detections group by last_detected"))
def agg_29(spark, sf):
    return V.detections(spark, sf).groupBy("last_detected").agg(F.count("*").alias("total"), F.count_if(F.col("severity") >= 4).alias("critical"))


@query("agg_30_zone_stats", det("select count(*) as n, count_if(severity >= 4) as critical, round(avg(coalesce(severity, 0)), 6) as avg_severity, round(avg(confidence), 6) as avg_confidence from v_detections where latitude between 46.7 and 46.76"))
def agg_30(spark, sf):
    return V.detections(spark, sf).where(F.col("latitude").between(46.7, 46.76)).agg(
        F.count("*").alias("n"), F.count_if(F.col("severity") >= 4).alias("critical"), F.round(F.avg(F.coalesce("severity", F.lit(0))), 6).alias("avg_severity"), F.round(F.avg("confidence"), 6).alias("avg_confidence")
    )


@query("agg_31_confidence_bins", det("select b.bin, count(v.bin) as n from (values ('20-40'), ('40-60'), ('60-80'), ('80-100')) b(bin) left join (select case when confidence < 0.4 then '20-40' when confidence < 0.6 then '40-60' when confidence < 0.8 then '60-80' else '80-100' end as bin from v_detections where damage_type = 'pothole') v using (bin) group by b.bin"))
def agg_31(spark, sf):
    c = F.col("confidence")
    of = F.when(c < 0.4, "20-40").when(c < 0.6, "40-60").when(c < 0.8, "60-80").otherwise("80-100")
    n = V.detections(spark, sf).where("damage_type = 'pothole'").groupBy(of.alias("bin")).agg(F.count("*").alias("n"))
    bins = spark.createDataFrame([("20-40",), ("40-60",), ("60-80",), ("80-100",)], "bin string")
    return bins.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("agg_32_grid_summary", det(_GRID + f"select count(*) as cells, round(avg(score), 6) as mean_score, " + ", ".join(f"count_if({bands('score', vocab.QUALITY_BANDS)} = '{b}') as band_{b.lower()}" for b in "ABCDE") + " from grid"))
def agg_32(spark, sf):
    g = D.quality_grid(V.detections(spark, sf), AS_OF)
    return g.agg(F.count("*").alias("cells"), F.round(F.avg("score"), 6).alias("mean_score"), *(F.count_if(F.col("band") == b).alias(f"band_{b.lower()}") for b in "ABCDE"))


@query("agg_33_budget_plan", det(f"u as (select sum({case('damage_type', vocab.REPAIR_COST, 700)}) / count(*) as unit from v_detections) select severity, count(*) as sites, round(any_value(unit) * {case('severity', vocab.COST_FACTOR, 1.0)}, 4) as unit_cost, cast(floor(count(*) * 40 / 100 + 0.5) as bigint) as planned from v_detections, u where severity is not null group by severity, unit"))
def agg_33(spark, sf):
    d = V.detections(spark, sf)
    unit = d.agg(F.sum(scoring.chosen(F.col("damage_type"), vocab.REPAIR_COST, vocab.OTHER_COST)) / F.count("*")).scalar()
    by = d.where("severity is not null").groupBy("severity").agg(F.count("*").alias("sites"))
    return by.select("severity", "sites", F.round(unit * scoring.chosen(F.col("severity"), vocab.COST_FACTOR, 1.0), 4).alias("unit_cost"), F.floor(F.col("sites") * 40 / 100 + 0.5).alias("planned"))


@query("agg_34_backlog", det(f"select cast(floor(sum({case('damage_type', vocab.REPAIR_COST, 700)}) * {case('greatest(1, least(5, cast(floor(avg(severity) + 0.5) as integer)))', vocab.COST_FACTOR, 1.0)}::double * ((count(*) - count_if(is_fixed)) / count(*)) + 0.5) as bigint) as backlog_ron from v_detections"))
def agg_34(spark, sf):
    s = V.detections(spark, sf).agg(F.sum(scoring.chosen(F.col("damage_type"), vocab.REPAIR_COST, vocab.OTHER_COST)).alias("full"), F.floor(F.avg("severity") + 0.5).cast("int").alias("s"), F.count("*").alias("n"), F.count_if("is_fixed").alias("fixed"))
    factor = scoring.chosen(F.greatest(F.lit(1), F.least(F.lit(5), F.col("s"))), vocab.COST_FACTOR, 1.0)
    return s.select(F.floor(F.col("full") * factor * ((F.col("n") - F.col("fixed")) / F.col("n")) + 0.5).alias("backlog_ron"))


@query("agg_35_repair_costs", det(f"select id, cast(floor({case('damage_type', vocab.REPAIR_COST, 700)} * {case('severity', vocab.COST_FACTOR, 1.0)}::double + 0.5) as bigint) as cost from v_detections where severity is not null"))
def agg_35(spark, sf):
    return V.detections(spark, sf).where("severity is not null").select("id", scoring.repair_cost(F.col("damage_type"), F.col("severity")).alias("cost"))


@query("agg_36_shares", det("select damage_type, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as percent from v_detections group by damage_type"))
def agg_36(spark, sf):
    by = V.detections(spark, sf).groupBy("damage_type").agg(F.count("*").alias("n"))
    return by.select("damage_type", "n", F.round(100 * F.col("n") / by.agg(F.sum("n")).scalar(), 6).alias("percent"))


@query("win_01_priority_rank", det(f"select id, priority_score, row_number() over (order by priority_score desc, id) as position from (select id, {PRIORITY} as priority_score from v_detections where severity is not null) order by priority_score desc, id limit 200"))
def win_01(spark, sf):
    top = scored(spark, sf).where("severity is not null").orderBy(F.desc("priority_score"), "id").limit(200)
    return top.select("id", "priority_score", F.row_number().over(Window.orderBy(F.desc("priority_score"), "id")).alias("position"))


@query("tk_01_page", det(f"select id, priority_score, severity from (select *, {PRIORITY} as priority_score from v_detections) order by severity desc nulls last, id limit 50 offset 100"))
def tk_01(spark, sf):
    return D.page(scored(spark, sf), "severity", 50, 3).select("id", "priority_score", "severity")


@query("tk_02_top_priority", det(f"select id, {PRIORITY} as priority_score from v_detections where severity is not null order by priority_score desc, id limit 25"))
def tk_02(spark, sf):
    return scored(spark, sf).where("severity is not null").orderBy(F.desc("priority_score"), "id").limit(25).select("id", "priority_score")


@query("tk_03_nearby_top", det(f"select id, priority_score from (select *, {PRIORITY} as priority_score, {metres('latitude', 'longitude', '46.75', '23.57')} as m from v_detections) where m <= 1500 order by priority_score desc, id limit 20"))
def tk_03(spark, sf):
    return D.in_radius(scored(spark, sf), 46.75, 23.57, 1500).orderBy(F.desc("priority_score"), "id").limit(20).select("id", "priority_score")


@query("tk_04_newest", det("select id, fixed_on from v_detections order by fixed_on desc nulls last, id desc limit 8"))
def tk_04(spark, sf):
    return V.detections(spark, sf).orderBy(F.desc_nulls_last("fixed_on"), F.desc("id")).limit(8).select("id", "fixed_on")


@query("sc_sev_06_priorities", det(f"select id, round({case('severity', vocab.PRIORITY_WEIGHTS, 0.25)}::double * ln(detection_count + 1), 6) as v1, {PRIORITY} as v2 from v_detections"))
def sc_sev_06(spark, sf):
    s, n = F.col("severity"), F.col("detection_count")
    return V.detections(spark, sf).select("id", scoring.priority_v1(s, n).alias("v1"), scoring.priority_v2(s, n).alias("v2"))


@query("sc_sev_07_deterioration", det("select id, round((severity - 1) / 5.0::double / greatest(last_detected - first_detected, 1), 6) as rate from v_detections where severity is not null"))
def sc_sev_07(spark, sf):
    days = F.greatest(F.datediff("last_detected", "first_detected"), F.lit(1))
    return V.detections(spark, sf).where("severity is not null").select("id", F.round((F.col("severity") - 1) / 5.0 / days, 6).alias("rate"))


@query("sc_dt_01_weeks", det("select cast(date_trunc('week', first_detected) as date) as week, count(*) as n from v_detections group by 1"))
def sc_dt_01(spark, sf):
    return V.detections(spark, sf).groupBy(F.trunc("first_detected", "week").alias("week")).agg(F.count("*").alias("n"))


@query("sc_dt_02_ages", det(f"select id, {DAY} - last_detected as days, {DAY} - 30 <= last_detected as recent from v_detections"))
def sc_dt_02(spark, sf):
    return V.detections(spark, sf).select("id", F.datediff(F.lit(AS_OF), "last_detected").cast("long").alias("days"), (F.col("last_detected") >= F.lit(AS_OF - dt.timedelta(days=30))).alias("recent"))


@query("set_06_survey_days", det("select distinct survey_date from v_detections where is_fixed"))
def set_06(spark, sf):
    return V.detections(spark, sf).where("is_fixed").select("survey_date").distinct()


@query("snk_01_csv_rows", det("select id, round(latitude, 6) as latitude, round(longitude, 6) as longitude, damage_type, coalesce(cast(severity as varchar), '') as severity, round(confidence, 4) as confidence from v_detections"))
def snk_01(spark, sf):
    return V.detections(spark, sf).select("id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"), "damage_type", F.coalesce(F.col("severity").cast("string"), F.lit("")).alias("severity"), F.round("confidence", 4).alias("confidence"))
