"""Work orders, clocks and rankings by hand."""

from pyspark.sql import functions as F

from kerbline.operators import orders


def test_edits_of_items(spark):
    items = spark.createDataFrame([(1, 10, 0), (1, 11, 1), (1, 12, 2), (2, 10, 0)], "work_order_id long, detection_id long, sort_order long")
    known = spark.createDataFrame([(i,) for i in (10, 11, 12, 20, 21)], "id long")
    removed = spark.createDataFrame([(1, 11), (1, 11), (2, 10), (9, 1)], "work_order_id long, detection_id long")
    added = spark.createDataFrame([(1, 21, 0), (1, 10, 1), (1, 99, 2), (1, 20, 3), (1, 21, 4), (1, 11, 5), (2, 20, 0), (3, 20, 0)], "work_order_id long, detection_id long, position long")
    got = sorted(map(tuple, orders.edited(items, known, removed, added).collect()))
    assert got == [(1, 10, 0), (1, 11, 5), (1, 12, 2), (1, 20, 4), (1, 21, 3), (2, 20, 0), (3, 20, 0)]


def test_verification_is_refused(spark):
    o = spark.createDataFrame([(1, "repaired"), (2, "repaired"), (3, "open"), (4, "verified")], "work_order_id long, status string")
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, 10), (3, None)], "work_order_id long, detection_id long")
    d = spark.createDataFrame([(10, True), (11, True), (12, False)], "id long, back boolean")
    asked = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "repaired"), (4, "verified"), (7, "open")], "work_order_id long, status string")
    got = {r.work_order_id: tuple(r)[1:] for r in orders.transitions(o, items, d, asked, F.col("back")).collect()}
    assert got == {1: ("repaired", True, [10, 11]), 2: ("verified", False, None), 3: ("repaired", False, None)}


def test_clocks(spark):
    tracks = spark.createDataFrame([(1, "cam7", 10_000.0, 20_000.0)], "track_id long, stem string, begin_s double, end_s double")
    rows = [(1, "x", 1, 15_000.0, 60.0), (2, "cam7", 1, 99_999.0, 60.0), (3, "x", 1, 10_000.0 + 7200 * 3 + 44, 60.0), (4, "x", 1, 10_000.0 - 7200 + 600 + 44.9, 600.0), (5, "x", 1, 3000.0, 60.0), (6, "x", None, 5.0, 1.0), (7, "x", 1, 10_000.0 - 1800 * 3, 0.0)]
    got = {r.video_id: tuple(r)[1:] for r in orders.aligned(spark.createDataFrame(rows, "video_id long, stem string, track_id long, start_s double, duration_s double"), tracks).collect()}
    assert got == {1: (15_000.0, "inside", None), 2: (10_000.0, "embedded", None), 3: (10_044.0, "start stamp", 6), 4: (10_000.0 + 44.9, "end stamp", -2), 5: (3000.0, "unresolved", None), 6: (5.0, "no track", None), 7: (4600.0, "unresolved", None)}


def test_rankings_and_guards(spark):
    runs = spark.createDataFrame([(1, 3, 0.5), (2, 4, 0.1), (3, 4, 0.3), (4, 3, 0.5), (5, 4, 0.3)], "run_id long, classes long, mean double")
    assert sorted((r.position, r.run_id, r.anchor) for r in orders.ranked_runs(runs).collect()) == [(1, 3, 0.3), (2, 5, 0.3), (3, 2, 0.3), (4, 1, 0.5), (5, 4, 0.5)]
    members = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, False), ("b", 4, True)], "g string, m long, admin boolean")
    assert sorted(tuple(r) for r in orders.last_of_kind(members, "g", "m", F.col("admin")).collect()) == [("a", 1, False), ("a", 2, False), ("b", 4, True)]


def test_promotion_of_an_event_without_confidence(spark):
    """A confidence of zero stays; one that no sighting told is a half."""
    from kerbline.streaming import lifecycle

    rows = [(p, 10 * p + i, kind, 5.0 + i, "a", 46.0, 23.0, c, 3) for p, c in ((1, 0.0), (2, None), (3, 0.25)) for i, kind in enumerate(("sighting", "promote"))]
    table = spark.createDataFrame(rows, "place long, report_id long, kind string, t double, device_id string, latitude double, longitude double, confidence double, severity int")
    assert {r.id: r.confidence for r in lifecycle.promotions(lifecycle.life(table)).collect()} == {10: 0.0, 20: 0.5, 30: 0.25}
