"""Order-dependent operators against plain loops over all rows, and track formats there and back."""

import datetime as dt
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.operators import experiments, folds, routes, spatial
from kerbline.plans import views as V
from kerbline.plans.registry import queries
from kerbline.sources import tracks
from kerbline.streaming import live

SF = "/root/testdata/sf0.001"


def test_upserts_match_a_plain_loop(spark):
    """All sightings in order against all defects so far, without places or sessions."""
    d = V.detections(spark, SF).where("severity is not null").select("id", "latitude", "longitude", "damage_type", "severity", "confidence", F.col("first_detected").alias("day")).collect()
    held = []
    for r in sorted(d, key=lambda r: (r.day, r.id)):
        near = min(((live.metres(f["lat"], f["lon"], r.latitude, r.longitude), i) for i, f in enumerate(held) if f["kind"] == r.damage_type), default=(math.inf, -1))
        crop = f"crop-{r.id}" if r.id % 3 else None
        if near[0] <= 2:
            f = held[near[1]]
            f["rate"] = round((r.severity / 5.0 - f["severity"] / 5.0) / max((r.day - f["first"]).days, 1), 6)
            f.update(severity=r.severity, confidence=r.confidence, last=r.day, n=f["n"] + 1, crop=crop or f["crop"])
        else:
            held.append({"id": r.id, "kind": r.damage_type, "lat": r.latitude, "lon": r.longitude, "severity": r.severity, "confidence": r.confidence, "first": r.day, "last": r.day, "n": 1, "rate": None, "crop": crop})
    got = {r.id: r for r in queries()["wr_01_upsert"](spark, SF).collect()}
    assert set(got) == {f["id"] for f in held} and any(f["n"] > 2 for f in held)
    for f in held:
        r = got[f["id"]]
        assert (r.damage_type, r.severity, r.confidence, r.crop, r.first_day, r.last_day, r.detection_count, r.rate) == (f["kind"], f["severity"], f["confidence"], f["crop"], f["first"], f["last"], f["n"], f["rate"])
        assert r.priority_score == pytest.approx({1: 0.10, 2: 0.25, 3: 0.50, 4: 0.75, 5: 1.00}.get(f["severity"], 0.25) * math.log(f["n"] + 1), abs=1e-6)


def test_changelog_matches_a_plain_loop(spark):
    """All reports in order against all events of their class."""
    r = V.reports(spark, SF).withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6)
    events, want = {}, {}
    for x in sorted(r.collect(), key=lambda x: (x.t, x.report_id)):
        active = events.setdefault(x.damage_type, [])
        active[:] = [e for e in active if x.t <= e["until"]]
        close = sorted(((live.metres(*e["at"], x.latitude, x.longitude), k) for k, e in enumerate(active)))
        e = active[close[0][1]] if close and close[0][0] <= 25 else None
        if e is None and x.kind != "sighting":
            want[x.report_id] = ("rejected", 0, 0)
            continue
        action = {"sighting": "merged", "confirm": "confirmed", "dispute": "disputed"}[x.kind]
        if e is None:
            action, e = "created", {"at": (x.latitude, x.longitude), "for": set(), "against": set()}
            active.append(e)
        e["against" if x.kind == "dispute" else "for"].add(x.device_id)
        if x.kind != "dispute":
            e["until"] = x.t + 72 * 3600
        elif len(e["against"]) >= 2 and len(e["against"]) >= len(e["for"]):
            active.remove(e)
            action = "removed"
        want[x.report_id] = (action, len(e["for"]), len(e["against"]))
    got = {x.report_id: (x.action, x.supporters, x.disputers) for x in queries()["st_01_changelog"](spark, SF).collect()}
    assert got == want and len({a for a, *_ in want.values()}) >= 4


def slow_tour(points):
    d = [[2 * 6371.0 * math.asin(math.sqrt(min(1, math.sin((math.radians(b[0]) - math.radians(a[0])) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin((math.radians(b[1]) - math.radians(a[1])) / 2) ** 2))) for b in points] for a in points]
    order, left = [0], list(range(1, len(points)))
    while left:
        order.append(min(left, key=lambda i: (d[order[-1]][i], i)))
        left.remove(order[-1])
    better = len(order) >= 4
    while better:
        better = False
        for i in range(len(order) - 2):
            for k in range(i + 2, len(order)):
                a, b, c = order[i], order[i + 1], order[k]
                e = order[k + 1] if k + 1 < len(order) else None
                if d[a][c] + (d[b][e] if e is not None else 0) < d[a][b] + (d[c][e] if e is not None else 0) - 1e-9:
                    order[i + 1 : k + 1] = order[i + 1 : k + 1][::-1]
                    better = True
    return order


def test_tours_match_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    rows = [(o, i, float(46 + rng.random()), float(23 + rng.random())) for o, n in enumerate((1, 2, 3, 4, 9, 30, 60)) for i in range(n)] + [(0, 99, None, 1.0)]
    got = routes.planned(spark.createDataFrame(rows, "order_id long, stop_id long, lat double, lon double"))
    for o, g in got.toPandas().sort_values("stop_seq").groupby("order_id"):
        own = [r for r in rows if r[0] == o and r[2] is not None]
        assert g.stop_id.tolist() == slow_tour([r[2:] for r in own])
    total = {r.order_id: r for r in routes.summaries(got).collect()}
    assert total[6].stops == 60 and total[6].minutes == round(total[6].total_km / 25 * 60 + 60 * 20)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 300])
def test_tours_by_lists(n):
    """With lists of all stops the same tour as by a table; many stops lie on one spot, so that ties decide."""
    rng = np.random.default_rng(n)
    lat, lon = 46 + rng.integers(0, 12, n) / 100, 23 + rng.integers(0, 12, n) / 100
    few = routes._tour_of_few(lat, lon, None)
    assert routes._tour_by_lists(lat, lon, None, 10**6) == few == routes._tour(lat, lon, None)
    assert sorted(routes._tour_by_lists(lat, lon, None, 5)) == list(range(n))


def test_short_tours_compute_each_distance_once(monkeypatch):
    """About half the table, and the same tour as by looking at all pairs, also where few stops are far from all others."""
    rng = np.random.default_rng(5)
    lat, lon = np.append(46 + rng.random(400), [50, 50.1]), np.append(23 + rng.random(400), [23, 29.0])
    want, seen, km = routes._tour_by_lists(lat, lon, None, 10**6), [], routes.Stops.km
    monkeypatch.setattr(routes.Stops, "km", lambda s, i, j: (out := km(s, i, j), seen.append(np.size(out)))[0])
    assert routes._tour_of_few(lat, lon, None) == want and sum(seen) < 0.6 * 402**2


def test_nearest_stops_are_the_nearest(monkeypatch):
    monkeypatch.setattr(routes, "BLOCK", 7)
    rng = np.random.default_rng(1)
    lat, lon = np.append(46 + rng.random(200), [46.5] * 30), np.append(23 + rng.random(200), [23.5] * 30)
    s = routes.Stops(lat, lon, 9)
    for i in range(230):
        d = sorted((float(s.km(i, j)), j) for j in range(230) if j != i)[:9]
        assert s.far[i].tolist() == pytest.approx([x for x, _ in d])
        assert s.near[i].tolist() == [j for _, j in d] or len({round(x, 9) for x, _ in d}) < 9


def test_long_tours(spark):
    """A work order of more stops than a table holds, among small ones: all are visited, and hardly longer than by looking at all pairs."""
    rng = np.random.default_rng(3)
    rows = [(0, i, float(46 + rng.random() / 5), float(23 + rng.random() / 5)) for i in range(5000)] + [(1, 1, 46.0, 23.0), (1, 2, 46.1, 23.0)]
    got = routes.planned(spark.createDataFrame(rows, "order_id long, stop_id long, lat double, lon double")).toPandas()
    own = got[got.order_id == 0].sort_values("stop_seq")
    assert sorted(own.stop_id) == list(range(5000)) and own.stop_seq.tolist() == list(range(5000)) and own.stop_id.iloc[0] == 0
    lat, lon = (np.array([r[k] for r in rows[:1500]]) for k in (2, 3))
    s = routes.Stops(lat, lon, 1)
    long = [float(s.km(np.array(t[:-1]), np.array(t[1:])).sum()) for t in (routes._tour_by_lists(lat, lon, None), routes._tour_of_few(lat, lon, None))]
    assert long[0] < 1.05 * long[1]


def test_alerts_are_said_once(spark):
    rows = [("d", 1, 0.0, 7), ("d", 2, 1.0, 8), ("d", 3, 20.0, 7), ("d", 4, 21.0, 8), ("e", 5, 0.0, 7)]
    got = live.alerts(spark.createDataFrame(rows, "device_id string, row_id long, t double, event_id long"), 10.0)
    assert {r.row_id for r in got.collect()} == {1, 4, 5}


def test_jolts_need_a_fresh_moving_fix(spark):
    fixes = spark.createDataFrame([("a", 1, 0.0, 5.0), ("a", 2, 100.0, 1.0), ("a", 3, 200.0, None)], "device_id string, fix_id long, t double, speed double")
    motions = spark.createDataFrame([("a", i, t, j) for i, (t, j) in enumerate([(1.0, 9.0), (2.0, 20.0), (9.5, 8.9), (9.9, 10.0), (11.0, 10.0), (101.0, 30.0), (201.0, 9.5), (208.9, 9.5), (209.0, 9.5), (300.0, 50.0)])], "device_id string, motion_id long, t double, jolt double")
    assert {(r.motion_id, r.fix_id) for r in live.jolts(motions, fixes).collect()} == {(0, 1), (3, 1), (6, 3), (8, 3)}


def test_sessions_cut_a_key(spark):
    rows = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 5.0, 16.0, 17.0, 40.0])], "k string, i long, t double")
    assert [r.session for r in folds.sessions(rows, ["k"], "t", ["t"], 10.0).orderBy("i").collect()] == [0, 0, 1, 1, 2]


def test_holdout_sizes_are_checked(spark):
    groups = spark.createDataFrame([(1, 1, 4)], "group_id long, stratum long, n_images long")
    with pytest.raises(ValueError, match="held out"):
        experiments.matched_holdout(groups, 4)


def test_nearest_other_on_one_spot(spark):
    step = 10 / 111_195
    p = spark.createDataFrame([(1, 46.0, 23.0, "a"), (2, 46.0, 23.0, "a"), (3, 46.0 + step, 23.0, "a"), (4, 46.0, 23.0, "b")], "id long, lat double, lon double, kind string")
    assert {r.id: (r.target_id, round(r.metres)) for r in spatial.nearest_other(p, 25).collect()} == {1: (2, 0), 2: (1, 0), 3: (1, 10)}


def test_subtitles(spark):
    lines = ["[latitude: 46.77] [longtitude: 23.59]", "GPS(23.5901,46.7701,300)", "GPS (46.7702, 123.59)", "lat 46.12346, lon 23.54321", "no position", "$GPRMC,101010,A,4630.0000,N,02330.0000,E,10.0,0,010124,,", "GPS(0,0)"]
    got = sorted((round(r.lat, 4), round(r.lon, 4)) for r in tracks.parse_subtitles(spark.createDataFrame([(x,) for x in lines], "value string")).collect())
    assert got == sorted([(46.77, 23.59), (46.7701, 23.5901), (46.7702, 123.59), (46.1235, 23.5432), (46.5, 23.5)])


def test_json_is_walked_to_any_depth(spark):
    text = '{"a": [{"lat": 1.5, "lon": 2, "ele": 3, "time": "2024-01-02 03:04:05", "b": {"c": [[{"Latitude": 4.5, "lng": 5.5}]]}}, {"lat": "1.0", "lon": 2.0}], "latitude": 100, "lon": 1}'
    got = tracks.walk_json(spark.createDataFrame([("f", text), ("g", "no json"), ("h", "[]")], "file string, value string"))
    assert {(r.file, r.lat, r.lon, r.elevation, str(r.time)) for r in got.collect()} == {("f", 1.5, 2.0, 3.0, "2024-01-02 03:04:05"), ("f", 4.5, 5.5, None, "None")}


def test_gpx_there_and_back(spark, tmp_path):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [("f", at, 46.1234567, 23.5, 300.25, 1.5), ("f", at + dt.timedelta(seconds=1), 46.2, -23.5, None, None), ("g", at, 1.0, 2.0, 0.0, None)]
    points = spark.createDataFrame(rows, "file string, time timestamp, lat double, lon double, elevation double, speed_mps double")
    for r in tracks.gpx_documents(points).collect():
        (tmp_path / f"{r.file}.gpx").write_text(r.value)
        assert r.value.count("<speed>") == (r.file == "f")
    got = tracks.read_gpx(spark, str(tmp_path))
    assert Counter((r.file[-5:-4], r.time, r.lat, r.lon, r.elevation) for r in got.collect()) == Counter(r[:5] for r in rows)


def test_track_format(spark):
    names = spark.createDataFrame([("a.GPX",), ("x/b.json",)], "name string")
    assert [r.f for r in names.select(tracks.track_format(F.col("name")).alias("f")).collect()] == ["gpx", "json"]
    with pytest.raises(Exception, match="no track format"):
        spark.createDataFrame([("a.fit",)], "name string").select(tracks.track_format(F.col("name"))).collect()


def test_metric_log_keeps_its_columns(spark, tmp_path):
    from kerbline.sources import labels

    at = str(tmp_path / "log")
    labels.append_metrics(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), at)
    labels.append_metrics(spark.createDataFrame([(0.25, 2)], "loss double, epoch int"), at)
    labels.append_metrics(spark.createDataFrame([(3,)], "epoch int"), at)
    assert {(r.epoch, r.loss) for r in spark.read.option("header", True).csv(at).collect()} == {("1", "0.5"), ("2", "0.25"), ("3", None)}
    with pytest.raises(ValueError, match="no columns"):
        labels.append_metrics(spark.createDataFrame([(1,)], "other int"), at)
