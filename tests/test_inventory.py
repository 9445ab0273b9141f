"""Hand-sized cases of the domain's rules, and every query against its SQL."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, scoring
from kerbline.operators import detections as D
from kerbline.operators import retrieval, similarity, spatial, statistics, writes
from kerbline.plans import registry
from kerbline.streaming import live

SF = "/root/testdata/sf0.001"
STEP = 1.5 / 111_195  # degrees of latitude in 1.5 m


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    r = duck.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).limit(1).count() == 1


def points(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, latitude double, longitude double, confidence double")


def test_clusters_chain(spark):
    p = points(spark, (46.0, 23.0, 0.5), (46.0 + STEP, 23.0, 0.9), (46.0 + 2 * STEP, 23.0, 0.9), (47.0, 23.0, 0.1), (None, None, 0.3))
    c = {r.id: r.cluster_id for r in spatial.clusters(p, 2).collect()}
    assert c[0] == c[1] == c[2] != c[3] and c[4] == -1
    kept = {r.id for r in spatial.representatives(spatial.clusters(p, 2), F.col("confidence")).where("not is_duplicate").collect()}
    assert kept == {1, 3, 4}
    noise = {r.id: r.cluster_id for r in spatial.clusters(p, 2, least=2).collect()}
    assert noise[3] == -1 and noise[0] == noise[2] != -1


def test_density_counts_others(spark):
    p = points(spark, (46.0, 23.0, 0.5), (46.0, 23.0, 0.5), (46.0 + STEP, 23.0, 0.9), (None, 1.0, 0.1))
    assert {r.id: r.surrounding_density for r in spatial.density(p, 50).collect()} == {0: 2, 1: 2, 2: 2, 3: None}


def test_interpolation_ends(spark):
    track = spark.createDataFrame([(1, 0.0, 10.0, 20.0), (1, 10.0, 11.0, 22.0)], "track_id long, t double, lat double, lon double")
    frames = spark.createDataFrame([(1, 1, -1.0), (1, 2, 0.0), (1, 3, 5.0), (1, 4, 11.0)], "track_id long, frame_id long, t double")
    got = {r.frame_id: (r.lat, r.lon, r.was_interpolated) for r in spatial.interpolate(frames, track).collect()}
    assert got == {1: (None, None, False), 2: (10.0, 20.0, False), 3: (10.5, 21.0, True), 4: (None, None, False)}
    assert {r.frame_id: r.lat for r in spatial.interpolate(frames, track, clamp=True).collect()} == {1: 10.0, 2: 10.0, 3: 10.5, 4: 11.0}


def test_geofilter(spark):
    near = [(1, i, 46.0, 23.0 + i / 1000) for i in range(4)] + [(1, 9, 10.0, 23.0)]
    few = [(2, i, lat, 23.0) for i, lat in enumerate((46.0, 46.0, 10.0))]
    got = D.median_geofilter(spark.createDataFrame(near + few, "track_id long, fix_id long, lat double, lon double"))
    assert {(r.track_id, r.fix_id) for r in got.collect()} == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2)}


def test_marking_with_all_signals_is_s2(spark):
    d = spark.createDataFrame([("lane_line_blur", 1.0, 9999.0, 9.0, 99.0)], "c string, d double, a double, k double, s double")
    raw = scoring.raw_score(F.col("c"), F.col("d"), F.col("a"), F.col("k"), F.col("s"))
    r = d.select(scoring.severity_score(raw, F.col("c")).alias("x")).select("x", scoring.level(F.col("x")).alias("l")).first()
    assert (r.x, r.l) == (0.2, "S2")


def test_empty_box_is_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        D.in_box(points(spark, (1.0, 1.0, 1.0)), 5, 5, 5, 6)


def test_haversine(spark):
    m = spark.range(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("m")).first().m
    assert abs(m - 111_194.93) < 0.1


def test_hamming_threshold(spark):
    items = spark.createDataFrame([(1, 0), (2, 0b11), (3, 0b11111), (4, 0)], "id long, h long")
    assert {r.id: (r.class_id, r.links, r.copies) for r in similarity.hamming_links(items, 2).collect()} == {1: (1, 2, 1), 2: (2, 2, 0), 3: (3, 0, 0), 4: (1, 2, 1)}
    assert {r.id: r.group_id for r in similarity.duplicate_groups(items, 2).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def reports(*rows):
    import pandas as pd

    return pd.DataFrame([(i, 1, k, float(t), d, 46.0, 23.0, 0.5, 2) for i, (k, t, d) in enumerate(rows)], columns=live._COLUMNS)


def test_devices_validate_an_event():
    out = live.fold([], reports(("sighting", 0, "a"), ("sighting", 1, "a"), ("confirm", 2, "b"), ("sighting", 3, "c")))
    assert out.status.tolist() == ["unverified", "unverified", "confirmed", "verified"] and out.action.tolist() == ["created", "merged", "confirmed", "merged"]


def test_disputes_remove_and_events_expire():
    out = live.fold([], reports(("confirm", 0, "x"), ("sighting", 1, "a"), ("confirm", 2, "b"), ("dispute", 3, "c"), ("dispute", 4, "c"), ("dispute", 5, "d"), ("sighting", 6, "a"), ("confirm", 7 + live.TTL_S, "z")))
    assert out.action.tolist() == ["rejected", "created", "confirmed", "disputed", "disputed", "removed", "created", "rejected"]


def test_changelog_of_events(spark):
    from kerbline.plans.queries_more import st_01, st_02

    sf = "/root/testdata/sf0.01"
    n = {r.action: r["count"] for r in st_01(spark, sf).groupBy("action").count().collect()}
    assert n == {"created": 2852, "merged": 3117, "confirmed": 1089, "disputed": 989, "removed": 107, "rejected": 928 + 918}
    assert {r.action: r["count"] for r in st_02(spark, sf).groupBy("action").count().collect()} == n


def test_rate_limits(spark):
    hits = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate((0, 1, 2, 50, 61, 62))], "key string, hit_id long, t double")
    assert [r.allowed for r in live.limited(hits, 60, 2).orderBy("hit_id").collect()] == [True, True, False, False, True, True]


def test_cooldown(spark):
    rows = [("d", "pothole", i, float(t), 46.0 + far, 23.0) for i, (t, far) in enumerate(((0, 0), (10, 0), (20, 0.01), (31, 0.01), (60, 0.01)))]
    got = live.cooled(spark.createDataFrame(rows, "device_id string, damage_type string, report_id long, t double, latitude double, longitude double"))
    assert sorted(r.report_id for r in got.collect()) == [0, 2, 4]


def test_three_pairs_are_underpowered(spark):
    r = statistics.sign_flips(spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "pair_id long, diff double")).first()
    assert (r.p_value, r.min_achievable_p, r.underpowered) == (0.25, 0.25, True)


def test_fusion_order(spark):
    lists = [spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(s)], "query_id long, id string, rank long") for s in ("abc", "bad")]
    got = {r.id: r.score for r in retrieval.fused(*lists).collect()}
    assert got["a"] == got["b"] > got["c"] >= got["d"]


def test_grounding_drops_unknown_numbers(spark):
    a = spark.createDataFrame([(1, "You get 9999 points. You get 10 points for reports.", "You get 10 points for reports.")], "answer_id long, answer string, context string")
    r = retrieval.grounded(a).first()
    assert (r.kept, r.dropped) == (1, 1)


def test_split_keeps_a_test_group(spark):
    g = spark.createDataFrame([(i, "s") for i in range(3)] + [(9, "t")], "group_id long, stratum string")
    n = statistics.stratified_split(g).where("stratum = 's'").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in n} == {"train": 2, "test": 1}


def test_ledger_is_idempotent(spark):
    new = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "u long, r string")
    once = writes.ledger_append(new.limit(0), new, "u", "r")
    assert once.count() == 2 == writes.ledger_append(once, new, "u", "r").count()


def test_trend_has_no_empty_weeks(spark):
    d = spark.createDataFrame([(dt.date(2001, 6, 5), None), (dt.date(2001, 6, 6), dt.date(2001, 6, 20))], "first_detected date, fixed_on date")
    got = {r.week: (r.new_count, r.fixed_count) for r in D.weekly_trend(d, dt.date(2001, 7, 1)).collect()}
    assert got == {dt.date(2001, 6, 4): (2, 0), dt.date(2001, 6, 18): (0, 1)}
