"""What a stream keeps equals what a table gives, however the stream is cut into batches, and batches that come again change nothing."""

import datetime as dt
import json
import math
import os
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.streaming import ingest, lifecycle, live, written

SCHEMA = "place long, report_id long, kind string, t double, device_id string, latitude double, longitude double, confidence double, severity int"
KINDS = ["sighting", "confirm", "dispute", "resolve", "dismiss", "promote"]


def reports(n=300, seed=1, days=30, places=5):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, days * 86400, n)).round(3)
    kinds = rng.choice(KINDS, n, p=[0.45, 0.2, 0.23, 0.04, 0.04, 0.04])
    return [
        (int(rng.integers(0, places)), i, str(kinds[i]), float(t[i]), f"d{rng.integers(0, 6)}", 46.0 + float(rng.integers(0, 3)) * 1.5e-4, 23.0, float(rng.random()), int(rng.integers(1, 6)))
        for i in range(n)
    ]


def cut(rows, parts, seed):
    rng = np.random.default_rng(seed)
    edges = [0, *sorted(rng.choice(np.arange(1, len(rows)), parts - 1, replace=False).tolist()), len(rows)]
    return [rows[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def stream_of(spark, folder, parts, schema):
    """A stream with a batch for each part."""
    names = [c.split()[0] for c in schema.split(", ")]
    os.makedirs(folder, exist_ok=True)
    for i, part in enumerate(parts):
        frame = pd.DataFrame(part, columns=names)
        for c in schema.split(", "):
            if c.endswith((" int", " long")):
                frame[c.split()[0]] = frame[c.split()[0]].astype("Int32" if c.endswith(" int") else "Int64")
        frame.to_parquet(f"{folder}/{i:03}.parquet", coerce_timestamps="us" if "timestamp" in schema else None)
        os.utime(f"{folder}/{i:03}.parquet", (1e9 + i, 1e9 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ------------------------------------------------ the life of events


def slow_life(rows, eager, lateness=1.0):
    """The rules once more, place by place, without the library."""
    now = math.floor(max(r[3] for r in rows) * 1000) - round(lateness * 1000)
    out, by = [], defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        by[r[0]].append(r)
    for place, own in by.items():
        active = {}

        def tell(name, e, report, t, action):
            yes = len(e["yes"])
            out.append((place, name, report, t, action, yes, len(e["no"]), "verified" if yes >= 3 else "confirmed" if yes >= 2 else "unverified"))  # noqa: B023

        def sweep(over):
            for name in sorted((n for n, e in active.items() if over(e["until"])), key=lambda n: (active[n]["until"], n)):  # noqa: B023
                tell(name, active[name], None, active[name]["until"], "expired")  # noqa: B023
                del active[name]  # noqa: B023

        grace = 0 if eager else 72 * 3600
        for _, report, kind, t, device, lat, _, _, _ in own:
            sweep(lambda until: until < t if kind == "sighting" else until + grace < t)  # noqa: B023
            near = sorted((abs(e["lat"] - lat), i, n) for i, (n, e) in enumerate(active.items()))
            name = near[0][2] if near and near[0][0] * 111_195 <= 25 else None
            if kind == "sighting":
                action = "merged" if name is not None else "created"
                name = report if name is None else name
                e = active.setdefault(name, {"lat": lat, "yes": set(), "no": set()})
                e["until"] = t + 72 * 3600
                e["yes"].add(device)
                tell(name, e, report, t, action)
            elif name is not None:
                e = active[name]
                action = {"confirm": "confirmed", "dispute": "disputed", "resolve": "resolved", "dismiss": "dismissed", "promote": "promoted"}[kind]
                if kind == "confirm":
                    e["yes"].add(device)
                    e["until"] = t + 72 * 3600
                if kind == "dispute":
                    e["no"].add(device)
                    action = "removed" if len(e["no"]) >= max(2, len(e["yes"])) else action
                tell(name, e, report, t, action)
                if action in lifecycle.GONE:
                    del active[name]
        sweep(lambda until: math.floor((until + grace) * 1000) < now)
    return sorted(out, key=repr)


@pytest.mark.parametrize("eager", [True, False])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_life_of_events(spark, tmp_path, eager, parts):
    rows = reports(seed=parts)
    table = lifecycle.life(spark.createDataFrame(rows, SCHEMA), eager)
    want = slow_life(rows, eager)
    assert rows_of(table.select("place", "event_id", "report_id", "t", "action", "supporters", "disputers", "status")) == want
    actions = {w[4] for w in want}
    assert {"created", "merged", "confirmed", "disputed", "removed", "resolved", "dismissed", "promoted", "expired"} <= actions
    stream = stream_of(spark, tmp_path / "in", cut(rows, parts, 7), SCHEMA)
    assert rows_of(live.run_available(lifecycle.life_stream(stream, eager), "life").drop("batch")) == rows_of(table)


def test_lazy_events_are_revived(spark):
    day = 86400.0
    rows = [(1, 1, "sighting", 0.0, "a", 46.0, 23.0, 0.5, 3), (1, 2, "confirm", 4 * day, "b", 46.0, 23.0, None, None), (1, 3, "sighting", 5 * day, "c", 46.0, 23.0, 0.9, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert [r.action for r in lifecycle.life(table, eager=False).orderBy("t").collect()] == ["created", "confirmed", "merged"]
    assert [(r.action, r.t) for r in lifecycle.life(table).orderBy("t").collect()] == [("created", 0.0), ("expired", 3 * day), ("created", 5 * day)]
    assert lifecycle.life(table.limit(0)).count() == 0


# ------------------------------------------------ folds of counters


HITS = "key string, hit_id long, t double, failed boolean"


def hits(seed=3, n=200):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.uniform(0, 6 * 86400, n)).round(2)
    return [(f"k{rng.integers(0, 3)}", i, float(t[i]), bool(rng.random() < 0.6)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("what", ["limit", "budget", "lockout", "lock"])
def test_counters_on_a_stream(spark, tmp_path, parts, what):
    run = {
        "limit": lambda x: live.limited(x, 7200.0, 3), "budget": lambda x: live.limited(x, 86400.0, 5, count_rejected=False),
        "lockout": lambda x: live.limited(x, 7200.0, 2, lockout_s=20_000.0), "lock": lambda x: live.locked_out(x, 20_000.0, 3, 30_000.0),
    }[what]
    rows = hits()
    got = live.run_available(run(stream_of(spark, tmp_path / "in", cut(rows, parts, 2), HITS)), "hits").drop("batch")
    want = rows_of(run(spark.createDataFrame(rows, HITS)))
    assert rows_of(got) == want and len({w[2] for w in want}) == 2


@pytest.mark.parametrize("parts", [1, 5])
def test_sendings_alerts_and_jolts_on_a_stream(spark, tmp_path, parts):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(100, 1000, 240)).round(2)
    schema = "device_id string, damage_type string, report_id long, t double, latitude double, longitude double, jolt double, speed double, event_id long"
    rows = [(f"d{rng.integers(0, 2)}", f"c{rng.integers(0, 2)}", i, float(t[i]), 46 + float(rng.integers(0, 3)) * 1e-4, 23.0, float(rng.uniform(5, 15)), None if i % 5 == 0 else float(rng.uniform(0, 9)), int(rng.integers(0, 30))) for i in range(240)]
    table, parted = spark.createDataFrame(rows, schema), cut(rows, parts, 3)

    def jolts(x):
        m = x.where("report_id % 2 = 0").withColumnRenamed("report_id", "motion_id")
        return live.jolts(m, x.where("report_id % 2 = 1").withColumnRenamed("report_id", "fix_id"))

    runs = {"cooled": lambda x: live.cooled(x, 30.0, 20.0), "alerts": lambda x: live.alerts(x.withColumnRenamed("report_id", "row_id"), 20.0, 60.0), "jolts": jolts}
    for name, run in runs.items():
        got = live.run_available(run(stream_of(spark, tmp_path / name, parted, schema)), name).drop("batch")
        want = rows_of(run(table))
        assert rows_of(got) == want and 5 < len(want) < 200, name


# ------------------------------------------------ late rows


@pytest.mark.parametrize("lateness", [0.0, 3600.0, 40_000.0])
def test_late_rows_go_aside(spark, tmp_path, lateness):
    rng = np.random.default_rng(8)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=float(i * 900 - abs(rng.normal(0, 20_000)))), float(i % 7)) for i in range(300)] + [(300, None, 1.0)]
    schema, parts = "id long, at timestamp, value double", cut(rows, 9, 4)
    w = written.Windows(spark, str(tmp_path / "out"), 7200.0, lateness)
    w.run(stream_of(spark, tmp_path / "in", parts, schema))
    late = {r.id for r in w.late().collect()}
    totals = {r.start: (r.n, r.total) for r in w.totals().collect()}
    # by loops, and by Spark's own windows, which drop what is late, judged by the watermark one batch older
    newest, want, seen = None, defaultdict(lambda: [0, 0.0]), set()
    for part in parts:
        mark = None if newest is None else newest - dt.timedelta(seconds=lateness)
        for i, at, value in part:
            start = None if at is None else at.replace(hour=at.hour // 2 * 2, minute=0, second=0, microsecond=0)
            if at is None or mark is not None and start + dt.timedelta(hours=2) <= mark:
                seen.add(i)
            else:
                want[start][0] += 1
                want[start][1] += value
        newest = max([x[1] for x in part if x[1]] + [newest] * (newest is not None), default=None)
    assert late == seen and totals == {k: tuple(v) for k, v in want.items()} and len(late) + sum(n for n, _ in totals.values()) == len(rows)
    timed = stream_of(spark, tmp_path / "in", parts, schema).withWatermark("at", f"{round(lateness)} seconds")
    own = live.run_available(timed.groupBy(F.window("at", "2 hours").alias("w")).agg(F.count("*").alias("n")), "own", "update")
    own = {r.start: r.n for r in own.groupBy(F.col("w.start").alias("start")).agg(F.max_by("n", "batch").alias("n")).collect()}
    assert all(own[k] >= v[0] for k, v in totals.items()) and sum(own.values()) <= len(rows) and (lateness < 40_000 or own == {k: v[0] for k, v in totals.items()})
    # batches that come again
    for n in (3, 8):
        w.each(spark.createDataFrame(parts[n], schema), n)
    assert {r.start: (r.n, r.total) for r in w.totals().collect()} == totals and {r.id for r in w.late().collect()} == late


# ------------------------------------------------ points, streaks and badges


STANDING = "user_id long, report_at timestamp, reason string, ref_id long"


def deeds(seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(260):
        user = int(rng.integers(0, 4))
        if rng.random() < 0.5:
            rows.append((user, dt.datetime(2024, 3, 20) + dt.timedelta(hours=float(rng.uniform(0, 24 * 25))), None, None))
        else:
            rows.append((user, None, str(rng.choice([*vocab.POINTS, "nothing"])), int(rng.integers(0, 9))))
    return rows


def slow_standing(rows):
    from zoneinfo import ZoneInfo

    zone, out = ZoneInfo("Europe/Bucharest"), {}
    for user in {r[0] for r in rows}:
        local = [r[1].replace(tzinfo=dt.timezone.utc).astimezone(zone) for r in rows if r[0] == user and r[1]]
        days = sorted({x.date() for x in local})
        runs = []
        for d in days:
            runs.append(runs[-1] + 1 if runs and d - dt.timedelta(days=1) in days else 1)
        earned = {(r[2], r[3]) for r in rows if r[0] == user and r[2] in vocab.POINTS}
        count = Counter(x for x, _ in earned)
        figures = {"reports_total": len(local), "confirmed_total": count["event_confirmed"], "verified_total": count["event_verified"], "fixed_total": count["event_fixed"], "current_streak_days": runs[-1] if runs else 0}
        names = [n for n, rule in vocab.BADGES if eval(rule, {}, figures)] + ["night_reporter"] * any(x.hour >= 22 or x.hour < 5 for x in local)  # noqa: S307
        out[user] = (len(local), sum(vocab.POINTS[x] for x, _ in earned), count["event_confirmed"], count["event_verified"], count["event_fixed"], figures["current_streak_days"], max(runs, default=0), tuple(names))
    return out


@pytest.mark.parametrize("parts", [1, 5])
def test_standing_of_users(spark, tmp_path, parts, monkeypatch):
    monkeypatch.setattr(written, "WHOLE_EVERY", 3)
    rows = deeds()
    batches = cut(rows, parts, 9)
    s = written.Standing(spark, str(tmp_path / "out"), vocab.POINTS, vocab.BADGES)
    s.run(stream_of(spark, tmp_path / "in", batches, STANDING))
    view = lambda: {r.user_id: (*tuple(r)[1:-1], tuple(r.badges)) for r in s.view().collect()}
    assert view() == slow_standing(rows)
    last = len(batches) - 1
    s.each(spark.createDataFrame(batches[last], STANDING), last)  # the last batch again, as after a crash
    assert view() == slow_standing(rows)


# ------------------------------------------------ ingestion


def good(**more):
    return {"device_id": "dev-1", "latitude": 46.5, "longitude": 23.5, "damage_type": "pothole"} | more


RECORDS = [
    (good(), []), (good(confidence=None, severity=3, note="x" * 280, other=1), []), (good(latitude="46.5", severity=3.0, confidence=True), []), (good(latitude=-90, longitude=180, confidence=1, severity="5"), []),
    (good(device_id="ab"), ["device_id is too short"]), (good(device_id=12345), ["device_id is no string"]), (good(device_id="x" * 65, note="é" * 281), ["device_id is too long", "note is too long"]),
    ({"latitude": 1}, ["device_id is missing", "longitude is missing", "damage_type is missing"]), (good(latitude=None, longitude=180.5), ["latitude is missing", "longitude is too great"]),
    (good(latitude="north", severity=2.5, confidence=-0.1), ["latitude is no double", "confidence is too small", "severity is no int"]), (good(severity=0, damage_type="p"), ["damage_type is too short", "severity is too small"]),
    (good(latitude=[1], longitude={"a": 1}), ["latitude is no double", "longitude is no double"]), (good(severity=10**30, latitude="NaN"), ["latitude is no double", "severity is no int"]),
    ([1], ["no object"]), ("text", ["no object"]), (None, ["no object"]),
]


def test_records_are_checked(spark, tmp_path):
    lines = [(i, json.dumps(r)) for i, (r, _) in enumerate(RECORDS)] + [(100, "{broken"), (101, ""), (102, None), (103, '{"device_id": "a", "device_id": "b"}')]
    got = {r.i: r for r in ingest.checked(spark.createDataFrame(lines, "i int, value string")).collect()}
    for i, (_, problems) in enumerate(RECORDS):
        assert got[i].problems == problems, (i, got[i])
        assert got[i].raw == lines[i][1]
    assert all(got[i].problems == ["no object"] for i in (100, 101, 102, 103))
    assert (got[2].latitude, got[2].severity, got[2].confidence) == (46.5, 3, 1.0) and got[3].severity == 5 and got[5].device_id is None
    # as a stream, in batches, one of which comes again
    at = dt.datetime(2024, 1, 1)
    rows = [(at, v) for _, v in lines]
    kept = ingest.Ingested(spark, str(tmp_path / "out"))
    kept.run(stream_of(spark, tmp_path / "in", [rows[:7], rows[7:]], "at timestamp, value string"))
    kept.each(spark.createDataFrame(rows[7:], "at timestamp, value string"), 1)
    assert kept.reports.read().count() == 4 and Counter(r.raw for r in kept.quarantine.read().collect()) == Counter(v for (_, v), r in zip(lines, [*(p for _, p in RECORDS), [1], [1], [1], [1]], strict=True) if r)


# ------------------------------------------------ the feed


def applied(messages, seen, ever, new):
    """A client: applies messages in order."""
    hello = False
    for m in messages:
        if m.type == written.HELLO:
            if not hello:
                seen.clear()
                hello = True
            seen[m.event_id] = m.supporters
            ever.add(m.event_id)
        elif m.type == written.UPSERT:
            if m.event_id not in ever:
                new.add(m.event_id)
            ever.add(m.event_id)
            seen[m.event_id] = m.supporters
        else:
            seen.pop(m.event_id, None)
            ever.add(m.event_id)


def test_feed(spark, tmp_path):
    rows = reports(seed=11)
    parts = cut(rows, 6, 1)
    feed = written.Feed(spark, str(tmp_path / "out"))
    feed.run(lifecycle.life_stream(stream_of(spark, tmp_path / "in", parts, SCHEMA)))
    want = {}
    for r in sorted(lifecycle.life(spark.createDataFrame(rows, SCHEMA)).collect(), key=lambda r: (r.t, r.place, r.action in lifecycle.GONE, r.report_id or 1 << 60)):
        want.pop(r.event_id, None) if r.action in lifecycle.GONE else want.update({r.event_id: r.supporters})
    last = feed.last()
    assert {r.event_id: r.supporters for r in feed.connect().collect()} == want and want
    for joined in (None, 0, 2, last):  # clients that connect at the beginning, later, or at the end see the same
        seen, ever, new = {}, set(), set()
        if joined is not None:
            applied(feed.connect(joined).orderBy("seq").collect(), seen, ever, new)
        for _ in range(2):  # what is sent twice changes nothing
            applied(feed.after(joined).orderBy("seq").collect(), seen, ever, new)
        assert seen == want
    every = feed.after(None)
    assert every.count() == lifecycle.life(spark.createDataFrame(rows, SCHEMA)).count() and every.select("seq").distinct().count() == every.count()
    before = rows_of(feed.after(None).drop("batch"))
    feed.each(lifecycle.life(spark.createDataFrame(parts[0], SCHEMA)).limit(0), last + 5)  # an empty batch
    assert rows_of(feed.after(None).drop("batch")) == before and {r.event_id for r in feed.connect().collect()} == set(want)


def test_view_of_messages(spark):
    rows = [(1, "hello", 7), (1, "hello", 8), (2, "event_upsert", 9), (3, "event_removed", 7), (4, "event_upsert", 8), (5, "event_removed", 5)]
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "seq long, type string, event_id long, x double")
    assert {(r.event_id, r.seq, r.is_new) for r in written.viewed(table).collect()} == {(8, 4, False), (9, 2, True)}
    again = table.unionByName(spark.createDataFrame([(6, "hello", 10, 2.0)], table.schema))
    assert {(r.event_id, r.is_new) for r in written.viewed(again).collect()} == {(10, False)}
    assert written.viewed(table.where("type != 'hello' and event_id != 5")).count() == 2 and written.viewed(table.limit(0)).count() == 0
