"""Queries: statistics, retrieval, sets, writes, text functions, live reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.operators import retrieval, statistics, writes
from kerbline.plans import views as V
from kerbline.plans.queries_detections import det, metres
from kerbline.plans.registry import query
from kerbline.plans.views import duck
from kerbline.streaming import live


@query("agg_13_items_per_order", duck("v_items", body="select work_order_id, count(*) as items from v_items group by work_order_id"))
def agg_13(spark, sf):
    return V.work_order_items(spark, sf).groupBy("work_order_id").agg(F.count("*").alias("items"))


@query("agg_14_next_position", "select l_orderkey, coalesce(max(l_linenumber), -1) + 1 as next_position from lineitem group by l_orderkey")
def agg_14(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg((F.coalesce(F.max("l_linenumber"), F.lit(-1)) + 1).alias("next_position"))


@query("agg_17_level_shares", duck("v_boxes", body="select case when depth_norm >= 0.75 then 'S5' when depth_norm >= 0.55 then 'S4' when depth_norm >= 0.35 then 'S3' when depth_norm >= 0.15 then 'S2' else 'S1' end as level, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as percent from v_boxes group by 1"))
def agg_17(spark, sf):
    from kerbline.functions.scoring import level

    by = V.boxes(spark, sf).groupBy(level(F.col("depth_norm")).alias("level")).agg(F.count("*").alias("n"))
    return by.select("level", "n", F.round(100 * F.col("n") / by.agg(F.sum("n")).scalar(), 6).alias("percent"))


@query("agg_18_worst_per_frame", duck("v_boxes", body="select frame_id, max(confidence) as worst, count(*) as boxes from v_boxes group by frame_id"))
def agg_18(spark, sf):
    return V.boxes(spark, sf).groupBy("frame_id").agg(F.max("confidence").alias("worst"), F.count("*").alias("boxes"))


@query("agg_21_box_geometry", duck("v_boxes", body="select class_name, count(*) as n, round(median(edge_sharpness), 6) as median_ratio, round(quantile_cont(edge_sharpness, 0.1), 6) as p10, round(quantile_cont(edge_sharpness, 0.9), 6) as p90, round(100 * avg(case when surface_area_px < 400 then 1.0 else 0.0 end), 6) as small_percent from v_boxes group by class_name"))
def agg_21(spark, sf):
    p = F.percentile("edge_sharpness", F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("p")
    g = V.boxes(spark, sf).groupBy("class_name").agg(F.count("*").alias("n"), p, F.round(100 * F.avg(F.when(F.col("surface_area_px") < 400, 1.0).otherwise(0.0)), 6).alias("small_percent"))
    return g.select("class_name", "n", F.round(F.col("p")[0], 6).alias("median_ratio"), F.round(F.col("p")[1], 6).alias("p10"), F.round(F.col("p")[2], 6).alias("p90"), "small_percent")


@query("agg_22_run_summary", "select l_suppkey % 20 as experiment, count(*) as n, round(avg(l_discount), 9) as mean, round(coalesce(stddev_samp(l_discount), 0), 9) as sd, min(l_discount) as least, max(l_discount) as most, bool_or(l_returnflag = 'R') as any_dirty from lineitem group by 1")
def agg_22(spark, sf):
    g = V.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("experiment"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 9).alias("mean"), F.round(F.coalesce(F.stddev_samp("l_discount"), F.lit(0.0)), 9).alias("sd"), F.min("l_discount").alias("least"), F.max("l_discount").alias("most"), F.bool_or(F.col("l_returnflag") == "R").alias("any_dirty"))


@query("agg_37_orders_by_status", duck("v_work_orders", body="select status, count(*) as n, min(work_order_id) as first_order from v_work_orders group by status"))
def agg_37(spark, sf):
    return V.work_orders(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.min("work_order_id").alias("first_order"))


@query("agg_38_best_row", "select l_suppkey, max_by(l_orderkey, l_extendedprice * 1e9 + l_orderkey) as best_order, max(l_extendedprice) as best from lineitem group by l_suppkey")
def agg_38(spark, sf):
    return V.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.max_by("l_orderkey", F.col("l_extendedprice") * 1e9 + F.col("l_orderkey")).alias("best_order"), F.max("l_extendedprice").alias("best"))


@query("agg_40_rollup", "select o_orderpriority as stage, o_orderstatus as status, count(*) as n from orders group by rollup (o_orderpriority, o_orderstatus)")
def agg_40(spark, sf):
    return V.table(spark, sf, "orders").rollup(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("stat_01_spearman", "r as (select l_returnflag as g, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2 as rx, rank() over (partition by l_returnflag order by l_discount) + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2 as ry from lineitem) select g, count(*) as n, round(corr(rx, ry), 8) as rho from r group by g".replace("r as", "with r as", 1))
def stat_01(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_discount")
    return statistics.spearman(li, "g", "l_quantity", "l_discount").select("g", "n", F.round("rho", 8).alias("rho"))


_FLIPS = """with d as (select cast(row_number() over (order by p_type) - 1 as integer) as i, avg(case when p_size % 2 = 0 then p_retailprice end) - avg(case when p_size % 2 = 1 then p_retailprice end) as diff from part group by p_type),
f as (select m, abs(sum(case when (m >> i) & 1 = 1 then -diff else diff end)) as s from d, range(64) t(m) group by m)
select (select count(*) from d) as n_pairs, round((select avg(diff) from d), 6) as mean_difference, count(*) filter (where s >= abs((select sum(diff) from d)) - 1e-12) / count(*) as p_value, pow(2.0::double, -5) as min_achievable_p, false as underpowered from f"""


@query("stat_03_sign_flips", _FLIPS)
def stat_03(spark, sf):
    p = V.table(spark, sf, "part")
    even = F.col("p_size") % 2 == 0
    pairs = p.groupBy(F.col("p_type").alias("pair_id")).agg((F.avg(F.when(even, F.col("p_retailprice"))) - F.avg(F.when(~even, F.col("p_retailprice")))).alias("diff"))
    return statistics.sign_flips(pairs).withColumn("mean_difference", F.round("mean_difference", 6))


@query("stat_04_bootstrap", """with v as (select row_number() over (order by p_brand) - 1 as i, avg(p_retailprice) as v, count(*) over () as n from part group by p_brand),
d as (select b, cast('0x' || substr(md5(b || ':' || j), 1, 8) as bigint) % (select count(*) from v) as i from range(1000) t(b), (select i as j from v)),
m as (select b, avg(v) as m from d join v using (i) group by b) select round(quantile_cont(m, 0.025), 6) as low, round(quantile_cont(m, 0.975), 6) as high from m""")
def stat_04(spark, sf):
    """The mean price of the brands of parts."""
    means = V.table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"))
    got = statistics.bootstrap_mean(statistics.placed_by(means, "p_brand").select("i", "v"))
    return got.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("stat_05_effect_size", "select l_returnflag, round(avg(l_discount - l_tax) / stddev_samp(l_discount - l_tax), 8) as d from lineitem group by l_returnflag")
def stat_05(spark, sf):
    diff = F.col("l_discount") - F.col("l_tax")
    return V.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(diff) / F.stddev_samp(diff), 8).alias("d"))


@query("win_11_split", "with g as (select o_orderkey as group_id, o_orderpriority as stratum, row_number() over (partition by o_orderpriority order by md5(cast(o_orderkey as varchar)), o_orderkey) - 1 as i, count(*) over (partition by o_orderpriority) as n from orders) select group_id, stratum, case when i < round(n * 0.70) then 'train' when i < round(n * 0.70) + case when n >= 3 and round(n * 0.70) + round(n * 0.15) >= n then greatest(0, n - round(n * 0.70) - 1) else round(n * 0.15) end then 'val' else 'test' end as split from g")
def win_11(spark, sf):
    return statistics.stratified_split(V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("group_id"), F.col("o_orderpriority").alias("stratum")))


_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
_BM25 = f"""with q as (select item_id as query_id, unnest(list_distinct({_WORDS})) as word from benchmark where item_id % 20 = 0),
d as (select doc_id as id, {_WORDS} as w, len({_WORDS}) as len from documents),
t as (select count(*) as n, avg(len) as avg_len from d),
p as (select id, len, word, count(*) as tf from (select id, len, unnest(w) as word from d) where word in (select word from q) group by all),
f as (select word, count(*) as df from p group by word),
s as (select query_id, id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))), 6) as score from p join q using (word) join f using (word), t group by all),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
"""


def _queries(spark, sf):
    return V.table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


@query("ret_01_bm25", _BM25 + "select query_id, id, score, rank from r where rank <= 6")
def ret_01(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, _queries(spark, sf))


_FUZZY = """with q as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as w from benchmark where item_id % 20 = 0),
d as (select doc_id as id, regexp_extract_all(lower(text), '[a-z]+') as w, len(regexp_extract_all(lower(text), '[a-z]+')) as len from documents),
t as (select count(*) as n, avg(len) as avg_len from d),
tf as (select id, len, word, count(*) as tf from (select id, len, unnest(w) as word from d) group by all),
v as (select distinct word from tf), u as (select distinct w from q),
m as (select w, word, greatest(case when word = w then 1.0::double when starts_with(word, w) then 0.375::double * length(w) / (length(w) + 0.3::double * (length(word) - length(w))) else 0 end,
  case when word <> w and abs(length(word) - length(w)) <= 2 and levenshtein(w, word) <= least(2, round(length(w) * 0.2::double)) then 0.45::double * length(w) / (length(w) + levenshtein(w, word)) else 0 end) as weight from u, v),
a as (select query_id, word, max(weight) as weight from q join m using (w) where weight > 0 group by all),
f as (select word, count(*) as df from tf group by word),
s as (select query_id, id, round(sum(weight * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))), 6) as score from tf join a using (word) join f using (word), t group by all),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
"""


@query("ret_01_fuzzy", _FUZZY + "select query_id, id, score, rank from r where rank <= 6")
def ret_01_fuzzy(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.bm25(docs, _queries(spark, sf), fuzzy=True)


@query("ret_01_fields", """with q as (select item_id as query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) as word from benchmark where item_id % 20 = 0),
x as (select doc_id as id, 'title' as field, 3.0::double as boost, regexp_extract_all(lower(coalesce(left(text, 60), '')), '[a-z]+') as w from documents union all select doc_id, 'text', 1.0, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') from documents
  union all select doc_id, 'tags', 2.0, regexp_extract_all(lower(coalesce(right(text, 40), '')), '[a-z]+') from documents),
d as (select *, len(w) as len from x), t as (select field, count(*) as n, avg(len) as avg_len from d group by field),
p as (select id, field, boost, len, word, count(*) as tf from (select id, field, boost, len, unnest(w) as word from d) where word in (select word from q) group by all),
f as (select field, word, count(*) as df from p group by all),
s as (select query_id, id, round(sum(boost * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / avg_len))), 6) as score from p join q using (word) join f using (field, word) join t using (field) group by all),
r as (select *, row_number() over (partition by query_id order by score desc, id) as rank from s)
select query_id, id, score, rank from r where rank <= 6""")
def ret_01_fields(spark, sf):
    """Documents with their beginning as title and their end as tags."""
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 60).alias("title"), "text", F.expr("right(text, 40)").alias("tags"))
    return retrieval.bm25_fields(docs, _queries(spark, sf))


_COS = "round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6)"
_DENSE = f"""x as (select vec_id as id, cast(embedding as double[]) as v from embeddings), c as (select a.id as query_id, b.id, {_COS.replace('(q', '(a.v').replace(' q)', ' a.v)').replace('(v', '(b.v').replace(' v)', ' b.v)')} as score from x a, x b where a.id % 20 = 0),
k as (select *, row_number() over (partition by query_id order by score desc, id) as rank from c)
"""


def _dense(spark, sf):
    x = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.dense(x, x.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))


@query("ret_02_dense", "with " + _DENSE + "select query_id, id, score, rank from k where rank <= 6")
def ret_02(spark, sf):
    return _dense(spark, sf)


@query("ret_03_fused", _BM25.rstrip() + ",\n" + _DENSE + ", u as (select query_id, id, rank from r where rank <= 6 union all select query_id, id, rank from k where rank <= 6) select query_id, id, round(sum(1.0::double / (60 + rank)), 9) as score from u group by all")
def ret_03(spark, sf):
    docs = V.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.fused(retrieval.bm25(docs, _queries(spark, sf)), _dense(spark, sf))


@query("ret_05_grounding", """with a as (select conv_id, arg_min_null(text, turn) filter (where role = 'assistant') as answer, arg_min_null(text, turn) filter (where role = 'user') as context from conversations where role in ('assistant', 'user') group by conv_id having count(distinct role) = 2),
s as (select conv_id, context, unnest(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(answer, '\\s+', ' ', 'g'), '([.!?]) ', '\\1\n', 'g'), '\n'), lambda x: length(trim(x)) > 0)) as s from a),
k as (select conv_id, list_distinct(regexp_extract_all(lower(context), '[a-z]+')) as known, list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda w: length(w) >= 3) as own, regexp_extract_all(context, '\\d+(?:[.,]\\d+)?') as numbers, regexp_extract_all(s, '\\d+(?:[.,]\\d+)?') as said from s),
g as (select conv_id, len(list_filter(said, lambda n: not list_contains(numbers, n))) = 0 and (len(own) = 0 or len(list_filter(own, lambda w: list_contains(known, w))) >= 0.42::double * len(own)) as keep from k)
select conv_id as answer_id, count(*) filter (where keep) as kept, count(*) filter (where not keep) as dropped from g group by conv_id""")
def ret_05(spark, sf):
    c = V.table(spark, sf, "conversations")
    a = c.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    u = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("context"))
    return retrieval.grounded(a.join(u, "conv_id").select(F.col("conv_id").alias("answer_id"), "answer", "context"))


@query("set_01_union", "select o_orderkey as id, 'order' as source from orders union all select l_orderkey, 'line' from lineitem")
def set_01(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("source"))
    return o.unionByName(V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("source")))


@query("set_02_intersect", "select o_custkey as k from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'P'")
def set_02(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "k")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'P'").select("k"))


@query("set_03_except", "select c_custkey as k from customer except select o_custkey from orders where o_orderstatus = 'P'")
def set_03(spark, sf):
    return V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(V.table(spark, sf, "orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_05_first_per_spot", det("select id from (select id, row_number() over (partition by round(cast(latitude as decimal(12,6)), 4), round(cast(longitude as decimal(12,6)), 4) order by id) as r from v_detections) where r = 1"))
def set_05(spark, sf):
    spot = [F.round(F.col(c).cast("decimal(12,6)"), 4).alias(c) for c in ("latitude", "longitude")]
    return V.detections(spark, sf).select("id", *spot).groupBy("latitude", "longitude").agg(F.min("id").alias("id")).select("id")


@query("wr_02_append_arrays", "with a as (select o_custkey as k, list(o_orderkey order by o_orderkey) as v from orders where o_orderkey % 2 = 0 group by 1), b as (select o_custkey as k, list(o_orderkey order by o_orderkey) as v from orders where o_orderkey % 2 = 1 group by 1) select k, coalesce(a.v, []) || coalesce(b.v, []) as v from a full join b using (k)")
def wr_02(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    a, b = (o.where(c).groupBy("k").agg(F.array_sort(F.collect_list("o_orderkey")).alias("v")) for c in ("o_orderkey % 2 = 0", "o_orderkey % 2 = 1"))
    return writes.arrays_merged(a, b, "k", "v")


@query("wr_04_ledger", "with l as (select distinct user_id, event_type as reason from events where event_id % 3 = 0), n as (select distinct user_id, event_type as reason from events where event_id % 3 > 0) select user_id, reason, 'old' as origin from l union all select user_id, reason, 'new' from n where not exists (select 1 from l where l.user_id = n.user_id and l.reason = n.reason)")
def wr_04(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("reason"))
    ledger = e.where("event_id % 3 = 0").select("user_id", "reason", F.lit("old").alias("origin")).distinct()
    return writes.ledger_append(ledger, e.where("event_id % 3 > 0").select("user_id", "reason", F.lit("new").alias("origin")), "user_id", "reason")


@query("wr_05_bulk_delete", det("select id from v_detections where survey_date not in (date '1999-01-01', date '2000-06-01')"))
def wr_05(spark, sf):
    gone = spark.createDataFrame([(dt.date(1999, 1, 1),), (dt.date(2000, 6, 1),)], "survey_date date")
    return writes.deleted(V.detections(spark, sf), gone, "survey_date").select("id")


@query("wr_06_mark_read", "select event_id, user_id = 7 or event_id % 11 = 0 as seen from events")
def wr_06(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "user_id", F.lit(False).alias("seen"))
    return writes.marked(e, "seen", True, (F.col("user_id") == 7) | (F.col("event_id") % 11 == 0)).select("event_id", "seen")


@query("wr_08_repaired_orders", duck("v_detections", "v_items", "v_work_orders", body="select id, coalesce(is_fixed, false) or id in (select detection_id from v_items join v_work_orders using (work_order_id) where status = 'repaired') as is_fixed from v_detections"))
def wr_08(spark, sf):
    done = V.work_orders(spark, sf).where("status = 'repaired'").join(V.work_order_items(spark, sf), "work_order_id").select(F.col("detection_id").alias("id")).distinct().withColumn("done", F.lit(True))
    return V.detections(spark, sf).join(done, "id", "left").select("id", (F.coalesce("is_fixed", F.lit(False)) | F.coalesce("done", F.lit(False))).alias("is_fixed"))


@query("wr_11_usage", "select c_custkey, c_nationkey + count(o_orderkey) as uses from customer left join orders on o_custkey = c_custkey group by c_custkey, c_nationkey")
def wr_11(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("uses"))
    return writes.counted_up(c, V.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "uses")


@query("wr_13_partial_update", "select s_suppkey, case when s_suppkey % 3 = 0 and s_suppkey % 2 = 0 then 'renamed' else s_name end as s_name, s_acctbal from supplier")
def wr_13(spark, sf):
    s = V.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patch = s.where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "renamed").alias("s_name"))
    return writes.patched(s, patch, "s_suppkey")


@query("sc_str_03_sentences", "select doc_id, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.!?]) ', '\\1\n', 'g'), '\n'), lambda x: length(trim(x)) > 0)) as sentences from documents")
def sc_str_03(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.size(retrieval.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("sc_str_04_numbers", "select doc_id, len(regexp_extract_all(text, '\\d+(?:[.,]\\d+)?')) as numbers from documents")
def sc_str_04(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))).cast("long").alias("numbers"))


@query("sc_str_07_digests", "select doc_id, sha256(text) as sha256, md5(text) as md5 from documents")
def sc_str_07(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@query("sc_math_07_cosine", "with " + _DENSE + "select query_id, max(score) as best, min(score) as worst from k where id <> query_id group by query_id")
def sc_math_07(spark, sf):
    x = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieval.extremes(x, x.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")))


_BADGE = " union all ".join(f"select user_id, '{b}' as badge from c where {rule}" for b, rule in vocab.BADGES)


@query("sc_cond_04_badges", "with c as (select user_id, count(*) as reports_total, count(*) filter (where event_type = 'signup') as confirmed_total, count(*) filter (where event_type = 'error') as verified_total, count(*) filter (where event_type = 'purchase') as fixed_total, count(distinct cast(ts as date)) as current_streak_days from events group by user_id) " + _BADGE)
def sc_cond_04(spark, sf):
    def n(kind: str):
        return F.count_if(F.col("event_type") == kind)

    c = V.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("reports_total"), n("signup").alias("confirmed_total"), n("error").alias("verified_total"), n("purchase").alias("fixed_total"), F.countDistinct(F.col("ts").cast("date")).alias("current_streak_days"))
    badges = F.array_compact(F.array(*(F.when(F.expr(rule), name) for name, rule in vocab.BADGES)))
    return c.select("user_id", F.explode(badges).alias("badge"))


def _live(spark, sf):
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    return V.reports(spark, sf).withColumn("t", seconds).withColumnRenamed("event_id", "place")


_SECONDS = "epoch(created_at)"


@query("st_01_changelog")
def st_01(spark, sf):
    return live.changelog(live.placed(_live(spark, sf))).drop("place")


@query("st_02_changelog_stream")
def st_02(spark, sf):
    """The same from a stream over the events, run until all that is there has been read."""
    schema = V.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return live.run_available(live.changelog_stream(_reports_of(stream)), "live").drop("batch")


def _reports_of(events):
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "confirm").when(F.col("event_type") == "error", "dispute").otherwise("sighting")
    e = events.withColumn("k", k)
    lat = F.lit(46700000) + (F.col("k") % 10) * 10000 + (F.col("user_id") % 8) * 1000 + (F.col("event_id") % 11) * 10
    lon = F.lit(23500000) + F.floor(F.col("k") / 10) * 10000
    return e.select(
        F.col("event_id").alias("report_id"), (F.col("k") * 8 + F.col("user_id") % 8).cast("long").alias("place"), kind.alias("kind"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"),
        F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), (lat / 1e6).alias("latitude"), (lon / 1e6).alias("longitude"), F.least(F.col("value") / 500, F.lit(1.0)).alias("confidence"), (1 + F.col("event_id") % 5).cast("int").alias("severity"),
    )


@query("st_06_cooldown", duck("v_reports", body=f"""h as (select *, epoch(created_at) as t, row_number() over (partition by device_id, damage_type order by created_at, report_id) as i from v_reports),
w as (select device_id, damage_type, report_id, i, t as lt, latitude as la, longitude as lo, true as sent from h where i = 1
  union all select h.device_id, h.damage_type, h.report_id, h.i, case when keep then h.t else lt end, case when keep then h.latitude else la end, case when keep then h.longitude else lo end, keep
  from w join h on h.device_id = w.device_id and h.damage_type = w.damage_type and h.i = w.i + 1, lateral (select not (h.t - lt < 86400 and {metres('la', 'lo', 'h.latitude', 'h.longitude')} < 20) as keep))
select report_id from w where sent""").replace("with ", "with recursive ", 1))
def st_06(spark, sf):
    return live.cooled(_live(spark, sf), 3600 * 24, 20)


@query("st_08_tumbling", "select time_bucket(interval '1 hour', ts) as start, count(*) as n, max(value) as peak from events group by 1")
def st_08(spark, sf):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return V.table(spark, sf, "events").groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "peak")


_LIMIT = duck("v_reports", body="""h as (select device_id as key, report_id as hit_id, epoch(created_at) as t, row_number() over (partition by device_id order by created_at, report_id) as i from v_reports),
w as (select key, hit_id, i, t as start, 1 as n, true as allowed from h where i = 1
  union all select h.key, h.hit_id, h.i, case when h.t - start > {window} then h.t else start end, {n}, {allowed} from w join h on h.key = w.key and h.i = w.i + 1)
select key, hit_id, allowed from w""").replace("with ", "with recursive ", 1)


@query("st_09_rate_limit", _LIMIT.format(window=86400, n="case when h.t - start > 86400 then 1 else n + 1 end", allowed="h.t - start > 86400 or n < 2"))
def st_09(spark, sf):
    hits = _live(spark, sf).select(F.col("device_id").alias("key"), F.col("report_id").alias("hit_id"), "t")
    return live.limited(hits, 86_400.0, 2)


@query("st_11_budget", _LIMIT.format(window=259200, n="case when h.t - start > 259200 then 1 when n < 3 then n + 1 else n end", allowed="h.t - start > 259200 or n < 3"))
def st_11(spark, sf):
    """A budget of three in three days for each device; what is rejected does not count."""
    hits = _live(spark, sf).select(F.col("device_id").alias("key"), F.col("report_id").alias("hit_id"), "t")
    return live.limited(hits, 259_200.0, 3, count_rejected=False)


@query("st_10_lockout", duck("v_reports", body="""h as (select device_id as key, report_id as hit_id, epoch(created_at) as t, kind <> 'confirm' as failed, row_number() over (partition by device_id order by created_at, report_id) as i from v_reports),
w as (select key, hit_id, i, t as last_t, case when failed then t end as start, case when failed then 1 else 0 end as n, -1e18::double as locked, false as refused, false as locks from h where i = 1
  union all select h.key, h.hit_id, h.i, h.t, case when r then start when not failed then null when c >= 3 then null when n = 0 or start is null or h.t - start > 172800 then h.t else start end,
    case when r then n when not failed then 0 when c >= 3 then 0 else c end, case when not r and failed and c >= 3 then h.t + 86400 else locked end, r, not r and failed and c >= 3
  from w join h on h.key = w.key and h.i = w.i + 1, lateral (select h.t < locked as r, case when start is null or h.t - start > 172800 then 1 else n + 1 end as c))
select key, hit_id, refused, locks from w""").replace("with ", "with recursive ", 1))
def st_10(spark, sf):
    """Three failures within two days of the first lock a device for a day; a confirmation is the success."""
    a = _live(spark, sf).select(F.col("device_id").alias("key"), F.col("report_id").alias("hit_id"), "t", (F.col("kind") != "confirm").alias("failed"))
    return live.locked_out(a, 172_800.0, 3, 86_400.0)


@query("st_13_touch", duck("v_reports", body="r as (select 'dev-' || c_custkey as device_id, c_custkey % 3 > 0 as is_active from customer where c_custkey % 2 = 0) select device_id, case when is_active then 'touched' when not is_active then 'rejected' else 'allowed' end as verdict, case when is_active then max(epoch(created_at)) end as last_seen, case when is_active then count(*) filter (where kind = 'sighting') end as reports from v_reports left join r using (device_id) group by device_id, is_active"))
def st_13(spark, sf):
    """Every second customer has paired a device, and every third of those gave it up."""
    c = V.table(spark, sf, "customer").where("c_custkey % 2 = 0")
    paired = c.select(F.concat(F.lit("dev-"), F.col("c_custkey").cast("string")).alias("device_id"), (F.col("c_custkey") % 3 > 0).alias("is_active"))
    return live.touched(_live(spark, sf).select("device_id", "t", (F.col("kind") == "sighting").alias("counted")), paired)


@query("st_07_jolts", duck("v_reports", body="""m as (select device_id, report_id as motion_id, epoch(created_at) + report_id % 13 as t, 6 + report_id % 7 as jolt from v_reports),
f as (select device_id, report_id as fix_id, epoch(created_at) as t, case when report_id % 5 > 0 then report_id % 9 end as speed from v_reports),
n as (select m.*, (select max((f.t, f.fix_id)) from f where f.device_id = m.device_id and f.t <= m.t) as fx from m where jolt >= 9),
j as (select n.device_id, motion_id, n.t, fx[2] as fix_id from n join f on f.fix_id = fx[2] where n.t - f.t <= 10 and (speed is null or speed >= 2.5)),
h as (select *, row_number() over (partition by device_id order by t, motion_id) as i from j),
w as (select device_id, motion_id, fix_id, i, t as lt, true as hit from h where i = 1 union all select h.device_id, h.motion_id, h.fix_id, h.i, case when h.t - lt >= 8 then h.t else lt end, h.t - lt >= 8 from w join h on h.device_id = w.device_id and h.i = w.i + 1)
select device_id, motion_id, fix_id from w where hit""").replace("with ", "with recursive ", 1).replace("fx[2]", "fx.fix_id").replace("max((f.t, f.fix_id))", "max({'t': f.t, 'fix_id': f.fix_id})"))
def st_07(spark, sf):
    """A report is a fix, and a motion some seconds later."""
    r = _live(spark, sf)
    m = r.select("device_id", F.col("report_id").alias("motion_id"), (F.col("t") + F.col("report_id") % 13).alias("t"), (6 + F.col("report_id") % 7).cast("double").alias("jolt"))
    f = r.select("device_id", F.col("report_id").alias("fix_id"), "t", F.when(F.col("report_id") % 5 > 0, (F.col("report_id") % 9).cast("double")).alias("speed"))
    return live.jolts(m, f)


@query("st_15_alerts")
def st_15(spark, sf):
    r = _live(spark, sf)
    return live.alerts(r.select("device_id", F.col("report_id").alias("row_id"), "t", F.col("place").alias("event_id")), 3600.0)


@query("st_04_sweep", duck("v_reports", body="a as (select event_id as place, max({'t': epoch(created_at), 'r': report_id}) as last, (select max(epoch(created_at)) from v_reports) as now from v_reports where kind = 'sighting' group by event_id) select place, last.r as report_id, now - last.t > 259200 as expired from a"))
def st_04(spark, sf):
    """Which places have let their events expire when the last report came in: sightings open or extend them."""
    r = _live(spark, sf)
    now = r.agg(F.max("t")).first()[0]
    opened = r.where("kind = 'sighting'").select("report_id", "place", F.lit("merged").alias("action"))
    return live.sweep(r, opened, now)


@query("st_18_windows_of_stream", "select time_bucket(interval '1 day', ts) as start, count(*) as n from events group by 1")
def st_18(spark, sf):
    """Daily counts from a stream with a watermark; the last update of a window counts."""
    stream = spark.readStream.schema(V.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    by = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").groupBy(F.window("at", "1 day").alias("w")).agg(F.count("*").alias("n"))
    kept = live.run_available(by, "windows", "update")
    return kept.groupBy("w").agg(F.max_by("n", "batch").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("st_12_sliding", "with w as (select time_bucket(interval '15 minutes', ts) - k * interval '15 minutes' as start from events, range(4) t(k)) select start, count(*) as n from w group by 1")
def st_12(spark, sf):
    """Counts of an hour, every quarter of an hour, from a stream; the last update of a window counts."""
    stream = spark.readStream.schema(V.table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    by = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day").groupBy(F.window("at", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n"))
    kept = live.run_available(by, "sliding", "update")
    return kept.groupBy("w").agg(F.max_by("n", "batch").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
