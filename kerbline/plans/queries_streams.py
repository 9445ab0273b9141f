"""Named queries over streams and what streams keep, each against the SQL of the same rules over the table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline import session, vocab
from kerbline.plans import views as V
from kerbline.plans.queries_more import _live, _reports_of
from kerbline.plans.registry import oracle, query
from kerbline.plans.views import duck
from kerbline.session import scratch_dir
from kerbline.streaming import ingest, lifecycle, live, written


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark, sf) -> DataFrame:
    """The reports as a stream over the events."""
    schema = V.table(spark, sf, "events").schema
    return _reports_of(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf))


def _classed(r: DataFrame) -> DataFrame:
    """Reports with what operators do among them, and the class of their place."""
    i = F.col("report_id")
    kind = F.when(i % 29 == 0, "resolve").when(i % 31 == 0, "dismiss").when(i % 37 == 0, "promote").otherwise(F.col("kind"))
    return r.withColumn("kind", kind)


# ---------------------------------------------------------------- the life of events

_CLOSINGS = "case h.kind when 'resolve' then 'resolved' when 'dismiss' then 'dismissed' else 'promoted' end"
_LIFE = duck("v_reports", body=f"""h as (select event_id as place, report_id, epoch(created_at) as t, device_id, case when report_id % 29 = 0 then 'resolve' when report_id % 31 = 0 then 'dismiss' when report_id % 37 = 0 then 'promote' else kind end as kind, row_number() over (partition by event_id order by created_at, report_id) as i from v_reports),
w as (
  select distinct place, 0::bigint as i, null::bigint as ev, null::double as until, []::varchar[] as yes, []::varchar[] as no, null::bigint as report_id, null::double as t, null::varchar as action, null::bigint as told, 0::bigint as ny, 0::bigint as nn,
    null::bigint as over_id, null::double as over_t, 0::bigint as over_y, 0::bigint as over_n from h
  union all
  select h.place, h.i, case when not gone then id end, case when c.action in ('created', 'merged', 'confirmed') then h.t + {live.TTL_S} else w.until end, yes1, no1, h.report_id, h.t, c.action, id, len(yes1), len(no1),
    case when live is null then w.ev end, w.until, len(w.yes), len(w.no)
  from w join h on h.place = w.place and h.i = w.i + 1,
    lateral (select case when w.until >= h.t then w.ev end as live) a,
    lateral (select case when h.kind = 'sighting' then coalesce(live, h.report_id) else live end as id, case when live is null then []::varchar[] else w.yes end as y, case when live is null then []::varchar[] else w.no end as n) b,
    lateral (select case when h.kind in ('sighting', 'confirm') and id is not null then list_distinct(list_append(y, h.device_id)) else y end as yes1, case when h.kind = 'dispute' and id is not null then list_distinct(list_append(n, h.device_id)) else n end as no1) v,
    lateral (select case when id is null then null when h.kind = 'sighting' then case when live is null then 'created' else 'merged' end when h.kind = 'confirm' then 'confirmed'
      when h.kind = 'dispute' then case when len(no1) >= greatest({live.LEAST_DISPUTES}, len(yes1)) then 'removed' else 'disputed' end else {_CLOSINGS} end as action) c,
    lateral (select coalesce(c.action in ('removed', 'resolved', 'dismissed', 'promoted'), true) as gone) g
),
ends as (select *, floor(until * 1000) < (select floor(max(t) * 1000) - 1000 from h) as expired from w where ev is not null qualify i = (select max(i) from h where h.place = w.place)),
life as (
  select told as event_id, report_id, t, action, ny as supporters, nn as disputers from w where action is not null
  union all select over_id, null, over_t, 'expired', over_y, over_n from w where over_id is not null
  union all select ev, null, until, 'expired', len(yes), len(no) from ends where expired
)
""").replace("with ", "with recursive ", 1)
_LIFE = _LIFE.replace("where ev is not null qualify i = (select max(i) from h where h.place = w.place)", "join (select place as last_place, max(i) as last_i from h group by place) on last_place = place and last_i = i where ev is not null")
_TOLD = ("event_id", "report_id", "t", "action", "supporters", "disputers")


def _told(life: DataFrame) -> DataFrame:
    return life.select(*_TOLD[:4], *(F.col(c).cast("long").alias(c) for c in _TOLD[4:]))


@query("st_05_lifecycle", _LIFE + "select * from life")
def st_05(spark, sf):
    """What became of every event: a row for each report, vote and closing that found one, and for each that expired."""
    return _told(lifecycle.life(_classed(_live(spark, sf))))


@query("st_04_expiry_stream", _LIFE + "select * from life")
def st_04(spark, sf):
    """The same from a stream, whose timers tell what has expired."""
    return _told(live.run_available(lifecycle.life_stream(_classed(_stream(spark, sf))), "life"))


@query("snk_08_feed", _LIFE + "select ev as event_id, len(yes) as supporters, len(no) as disputers from ends where not expired")
def snk_08(spark, sf):
    """What a client sees that connects after the first batch of a feed and reads on."""
    life = session.written(lifecycle.life(_classed(_live(spark, sf))), "life")  # folded once for all batches
    feed = written.Feed(spark, _folder(spark, "feed"))
    begin = life.agg(F.min("t")).first()[0] or 0.0
    for n in range(3):
        batch = F.least(F.floor((F.col("t") - begin) / (10 * 86400)), F.lit(2))
        feed.each(life.where(batch == n), n)
    seen = written.viewed(feed.connect(0).unionByName(feed.after(0).drop("batch")))
    return seen.select("event_id", F.col("supporters").cast("long").alias("supporters"), F.col("disputers").cast("long").alias("disputers"))


@query("st_19_view_of_changes", """with m as (select case when event_id % 2500 < 3 then event_id - event_id % 2500 else event_id end as seq, event_id % 2500 < 3 as hello, event_type = 'error' as gone, event_id * 7 % 500 as id, value from events),
b as (select id, max({'seq': seq, 'gone': gone and not hello, 'hello': hello, 'value': value}) as m, min({'seq': seq, 'up': not hello and not gone}) as f, (select max(seq) from m where hello) as start from m group by id)
select id as event_id, m.value as value, f.up as is_new from b where m.seq >= start and (m.hello or not m.gone)""")
def st_19(spark, sf):
    """Messages of events: now and then a snapshot of three, else upserts and removals."""
    i = F.col("event_id")
    hello = i % 2500 < 3
    kind = F.when(hello, written.HELLO).when(F.col("event_type") == "error", written.REMOVED).otherwise(written.UPSERT)
    messages = V.table(spark, sf, "events").select(F.when(hello, i - i % 2500).otherwise(i).alias("seq"), kind.alias("type"), (i * 7 % 500).alias("event_id"), "value")
    return written.viewed(messages).drop("seq")


# ---------------------------------------------------------------- counters, sendings and alerts on a stream


def _hits(r: DataFrame) -> DataFrame:
    return r.select(F.col("device_id").alias("key"), F.col("report_id").alias("hit_id"), "t", (F.col("kind") != "confirm").alias("failed"))


@query("st_09_rate_limit_stream", oracle("st_09_rate_limit"))
def st_09(spark, sf):
    return live.run_available(live.limited(_hits(_stream(spark, sf)), 86_400.0, 2), "limit").drop("batch")


@query("st_11_budget_stream", oracle("st_11_budget"))
def st_11(spark, sf):
    return live.run_available(live.limited(_hits(_stream(spark, sf)), 259_200.0, 3, count_rejected=False), "budget").drop("batch")


@query("st_10_lockout_stream", oracle("st_10_lockout"))
def st_10(spark, sf):
    return live.run_available(live.locked_out(_hits(_stream(spark, sf)), 172_800.0, 3, 86_400.0), "lockout").drop("batch")


@query("st_06_cooldown_stream", oracle("st_06_cooldown"))
def st_06(spark, sf):
    r = _stream(spark, sf)
    kind = V.pick(vocab.CLASSES, F.floor(F.col("place") / 8) % 10)
    return live.run_available(live.cooled(r.withColumn("damage_type", kind), 3600 * 24, 20), "cooldown").drop("batch")


# ---------------------------------------------------------------- late rows, standing, ingestion

_WINDOW_S, _LATENESS_S, _BATCH_S, _JITTER_S = 3600, 86_400, 5 * 86_400, 200_000


def _arrivals(spark, sf) -> list[DataFrame]:
    """Events in batches by when they arrived, up to two days after they happened."""
    e = V.table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    arrived = F.unix_seconds("at") + F.col("event_id") * 7919 % _JITTER_S
    e = e.withColumn("n", F.floor(arrived / _BATCH_S))
    return [e.where(F.col("n") == n).select("event_id", "at", "value") for (n,) in sorted(e.select("n").distinct().collect())]  # one batch for five days


@query("st_18_late_rows", f"""with a as (select *, floor(epoch(ts)) + event_id * 7919 % {_JITTER_S} as arrived, cast(floor(epoch(ts) / {_WINDOW_S}) * {_WINDOW_S} as bigint) as start from events),
b as (select *, floor(arrived / {_BATCH_S}) as n from a), newest as (select n, max(epoch_us(ts)) as newest from b group by n),
marks as (select n, max(newest) over (order by n rows between unbounded preceding and 1 preceding) - {_LATENESS_S} * 1000000::bigint as mark from newest),
j as (select start, value, coalesce((start + {_WINDOW_S}) * 1000000::bigint <= mark, false) as late from b join marks using (n))
select start, count(*) filter (where not late) as n, sum(value) filter (where not late) as total, count(*) filter (where late) as late from j group by start""")
def st_18(spark, sf):
    """Hours of events that come late, with the rows that came too late for them."""
    w = written.Windows(spark, _folder(spark, "windows"), _WINDOW_S, _LATENESS_S)
    for n, batch in enumerate(_arrivals(spark, sf)):
        w.each(batch, n)
    late = w.late().groupBy((F.floor(F.unix_seconds("at") / _WINDOW_S) * _WINDOW_S).alias("s")).agg(F.count("*").alias("late"))
    totals = w.totals().select(F.unix_seconds("start").alias("start"), "n", "total")
    return totals.join(late, F.col("start") == F.col("s"), "full").select(F.coalesce("start", "s").alias("start"), F.coalesce("n", F.lit(0)).alias("n"), "total", F.coalesce("late", F.lit(0)).alias("late"))


_REASONS = {"signup": "event_confirmed", "error": "event_verified", "purchase": "event_fixed"}
_LOCAL = "(ts at time zone 'UTC') at time zone 'Europe/Bucharest'"


@query("st_17_standing", f"""with l as (select distinct user_id, case event_type {' '.join(f"when '{k}' then '{v}'" for k, v in _REASONS.items())} end as reason, event_id % 50 as ref from events where event_type in ({', '.join(f"'{k}'" for k in _REASONS)})),
p as (select user_id, sum(case reason {' '.join(f"when '{k}' then {v}" for k, v in vocab.POINTS.items())} end) as points_total, count(*) filter (where reason = 'event_confirmed') as confirmed_total, count(*) filter (where reason = 'event_verified') as verified_total, count(*) filter (where reason = 'event_fixed') as fixed_total from l group by user_id),
r as (select user_id, {_LOCAL} as loc from events where event_type not in ({', '.join(f"'{k}'" for k in _REASONS)})),
c as (select user_id, count(*) as reports_total, bool_or(hour(loc) >= 22 or hour(loc) < 5) as night from r group by user_id),
d as (select distinct user_id, cast(loc as date) as day from r), i as (select *, day - cast(row_number() over (partition by user_id order by day) as integer) as island from d),
n as (select user_id, island, count(*) as streak, max(day) as last_day from i group by all), s as (select user_id, max(streak) as best_streak_days, max_by(streak, last_day) as current_streak_days from n group by user_id),
u as (select user_id, coalesce(reports_total, 0) as reports_total, coalesce(points_total, 0) as points_total, coalesce(confirmed_total, 0) as confirmed_total, coalesce(verified_total, 0) as verified_total, coalesce(fixed_total, 0) as fixed_total, coalesce(current_streak_days, 0) as current_streak_days, coalesce(best_streak_days, 0) as best_streak_days, coalesce(night, false) as night
  from (select distinct user_id from events) left join p using (user_id) left join c using (user_id) left join s using (user_id))
select user_id, reports_total, cast(points_total as bigint) as points_total, confirmed_total, verified_total, fixed_total, current_streak_days, best_streak_days,
  list_filter([{', '.join(f"case when {rule} then '{name}' end" for name, rule in vocab.BADGES)}, case when night then 'night_reporter' end], lambda x: x is not null) as badges from u""")
def st_17(spark, sf):
    """Points, streaks and badges from three batches, of which the second comes twice."""
    e = V.table(spark, sf, "events")
    earned = F.col("event_type").isin(*_REASONS)
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in _REASONS.items() for x in kv)), F.when(earned, F.col("event_type")))
    deeds = e.select("event_id", "user_id", F.when(~earned, F.col("ts").cast("timestamp")).alias("report_at"), reason.alias("reason"), F.when(earned, F.col("event_id") % 50).alias("ref_id"))
    s = written.Standing(spark, _folder(spark, "standing"), vocab.POINTS, vocab.BADGES)
    for number, part in ((0, 0), (1, 1), (1, 1), (2, 2)):
        s.each(deeds.where(F.col("event_id") % 3 == part).drop("event_id"), number)
    return s.view()


_FAULTS = 9


@query("src_29_ingestion", f"""with e as (select event_id, event_id % {_FAULTS} as f, 46 + event_id % 64 / 64 as lat, event_id % 180 + 0.5 as lon from events)
select event_id, case when f not in (1, 2, 8) then lat end as latitude, case f when 3 then lon + 100 when 8 then null else lon end as longitude, case when f = 8 then null when f <> 4 then cast(event_id % 5 + 1 as integer) end as severity, case when f not in (5, 8) then 'dev-' || event_id end as device_id,
  case when f = 1 then 'latitude is missing' when f = 2 then 'latitude is no double' when f = 3 and lon + 100 > 180 then 'longitude is too great' when f = 4 then 'severity is no int' when f = 5 then 'device_id is no string' when f = 6 then 'note is too long' when f = 8 then 'no object' else '' end as problems from e""")
def src_29(spark, sf):
    """A JSON record for each event, some with faults, read against the rules."""
    e = V.table(spark, sf, "events")
    i = F.col("event_id")
    f, lat, lon = i % _FAULTS, 46 + i % 64 / 64, i % 180 + 0.5
    device = F.when(f == 5, i.cast("string")).otherwise(F.concat(F.lit('"dev-'), i.cast("string"), F.lit('"')))
    fields = F.concat_ws(
        ", ", F.concat(F.lit('"device_id": '), device), F.when(f != 1, F.concat(F.lit('"latitude": '), F.when(f == 2, F.lit('"north"')).otherwise(lat.cast("string")))),
        F.concat(F.lit('"longitude": '), F.when(f == 3, lon + 100).otherwise(lon).cast("string")), F.concat(F.lit('"severity": '), F.when(f == 4, F.lit("2.5")).otherwise((i % 5 + 1).cast("string"))),
        F.lit('"damage_type": "pothole"'), F.when(f == 6, F.concat(F.lit('"note": "'), F.repeat(F.lit("n"), 281), F.lit('"'))),
    )
    lines = e.select("event_id", F.when(f == 8, F.concat(F.lit("["), fields)).otherwise(F.concat(F.lit("{"), fields, F.lit("}"))).alias("value"))
    out = ingest.checked(lines)
    return out.select("event_id", "latitude", "longitude", "severity", "device_id", F.array_join("problems", "; ").alias("problems"))
