"""Spatial joins and clustering on latitude and longitude, by grid cells instead of nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import haversine_m, metres_to_lat, metres_to_lon
from kerbline.session import forget, written


def places(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Distinct coordinates with the number of rows at each: joins run over places, so rows on one spot never make pairs."""
    return points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy(F.col(lat).alias("lat"), F.col(lon).alias("lon")).agg(F.count("*").alias("n"))


def _cells(metres: float, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Cell of a place; a cell is at least `metres` wide up to latitude 84, beyond which nothing is surveyed."""
    return F.floor(lat / metres_to_lat(metres)).cast("long"), F.floor(lon / (metres_to_lat(metres) * 10)).cast("long")


def _around(metres: float, lat: Column, lon: Column) -> Column:
    """All cells that a circle around the place can touch."""
    step = metres_to_lat(metres) * 1.001
    wide = metres_to_lon(metres, lat) * 1.001
    (y0, x0), (y1, x1) = _cells(metres, lat - step, lon - wide), _cells(metres, lat + step, lon + wide)
    return F.flatten(F.transform(F.sequence(y0, y1), lambda y: F.transform(F.sequence(x0, x1), lambda x: F.struct(y.alias("y"), x.alias("x")))))


def within(left: DataFrame, right: DataFrame, metres: float) -> DataFrame:
    """Pairs of rows of left (lat, lon, ...) and right (lat, lon, ...) at most so far apart, as structs l and r with the distance.

    Each left row is sent to the few cells its circle touches and meets the right rows there by an equi-join.
    """
    y, x = _cells(metres, F.col("lat"), F.col("lon"))
    a = left.select(F.struct("*").alias("l"), F.explode(_around(metres, F.col("lat"), F.col("lon"))).alias("c")).select("l", F.col("c.y").alias("y"), F.col("c.x").alias("x"))
    b = right.select(F.struct("*").alias("r"), y.alias("y"), x.alias("x"))
    d = haversine_m(F.col("l.lat"), F.col("l.lon"), F.col("r.lat"), F.col("r.lon"))
    return a.join(b, ["y", "x"]).select("l", "r", d.alias("metres")).where(F.col("metres") <= metres)


def density(points: DataFrame, metres: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Each row with surrounding_density: how many other rows lie within this distance."""
    at = written(places(points, lat, lon), "places")
    near = within(at.select("lat", "lon"), at, metres).groupBy(F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon")).agg((F.sum("r.n") - 1).alias("surrounding_density"))
    return points.join(near, (points[lat] == near.lat) & (points[lon] == near.lon), "left").drop("lat", "lon")


def nearest(points: DataFrame, targets: DataFrame, metres: float) -> DataFrame:
    """Each point (id, lat, lon, kind) with the nearest target (id, lat, lon, kind) of its kind within reach; ties go to the smaller id."""
    got = within(points, targets, metres).where("l.kind = r.kind")
    best = got.groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct("metres", F.col("r.id").alias("target_id"))).alias("best"))
    return best.select("id", "best.target_id", "best.metres")


def nearest_of_all(points: DataFrame, targets: DataFrame, first_m: float = 500.0, decimals: int = 3) -> DataFrame:
    """Each point (id, lat, lon) with the nearest of targets (id, lat, lon), however far: (id, target_id, metres); distances are rounded, ties go to
    the smaller id. Places without a target within reach are sought again with twice the reach, so a round has fewer of them; without
    any target no point has a row. Points without a position have none either.
    """
    at = written(places(points, "lat", "lon").select("lat", "lon"), "places")
    targets = written(targets.where("lat is not null and lon is not null").select("id", "lat", "lon"), "targets")
    found, rest, reach = [], at, first_m
    while targets.limit(1).count() and rest.limit(1).count():
        if reach > 2e6:  # the cells of such a circle would be the whole map: what is left meets all targets
            met = rest.join(targets.select(F.col("id").alias("t"), F.col("lat").alias("y"), F.col("lon").alias("x")))
            met = met.select("lat", "lon", "t", haversine_m(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")).alias("metres"))
        else:
            near = within(rest, targets, reach)
            met = near.select("l.lat", "l.lon", F.col("r.id").alias("t"), "metres")
        best = met.groupBy("lat", "lon").agg(F.min(F.struct(F.round("metres", decimals).alias("m"), "t")).alias("best"))
        best = written(best.select("lat", "lon", F.col("best.t").alias("target_id"), F.col("best.m").alias("metres")), "nearest")
        found.append(best)
        left = written(rest.join(best, ["lat", "lon"], "left_anti"), "rest")
        rest, reach = left, 2 * reach
    if not found:
        return points.select("id", F.lit(None).cast(targets.schema["id"].dataType).alias("target_id"), F.lit(None).cast("double").alias("metres")).limit(0)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    return points.join(every, ["lat", "lon"]).select("id", "target_id", "metres")


def nearest_other(points: DataFrame, metres: float) -> DataFrame:
    """Each point (id, lat, lon, kind) with the nearest other point of its kind within reach: (id, target_id, metres); ties to the smaller id.

    Distances are rounded to a micrometre. Joins run over distinct places of a kind, which carry their two smallest ids.
    """
    spot = ["lat", "lon", "kind"]
    at = points.groupBy(*spot).agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    second = points.join(at.where("n > 1").select(*spot, "low"), spot).where("id != low").groupBy(*spot).agg(F.min("id").alias("second"))
    at = written(at.join(second, spot, "left"), "places")
    got = within(at.select(*spot), at.select(*spot, "low"), metres).where("l.kind = r.kind and (l.lat != r.lat or l.lon != r.lon)")
    away = got.groupBy(*(F.col(f"l.{c}").alias(c) for c in spot)).agg(F.min(F.struct(F.round("metres", 6).alias("m"), F.col("r.low").alias("id"))).alias("away"))
    told = points.join(at.join(away, spot, "left"), spot)
    here = F.when(F.col("n") > 1, F.struct(F.lit(0.0).alias("m"), F.when(F.col("id") == F.col("low"), F.col("second")).otherwise(F.col("low")).alias("id")))
    best = told.withColumn("best", F.least(here, F.col("away"))).where("best is not null")
    return best.select("id", F.col("best.id").alias("target_id"), F.col("best.m").alias("metres"))


def link_counts(points: DataFrame, metres: float, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """One row: how many ordered pairs of rows lie within reach, and how many rows are in one. Pairs are counted over places, never made."""
    at = written(places(points, lat, lon), "places")
    near = within(at, at, metres).groupBy(F.col("l.lat").alias("lat"), F.col("l.lon").alias("lon"), F.col("l.n").alias("n")).agg(F.sum("r.n").alias("there"))
    return near.agg(F.coalesce(F.sum(F.col("n") * (F.col("there") - 1)), F.lit(0)).alias("links"), F.coalesce(F.sum(F.when(F.col("there") > 1, F.col("n"))), F.lit(0)).alias("linked"))


def clusters(points: DataFrame, metres: float, least: int = 1, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """DBSCAN over places: each row with cluster_id (numbered by the first place of the cluster; -1 for noise and for no position).

    A place is a core if at least `least` rows lie within reach, itself included; cores within reach of each other are one
    cluster, found by repeated grouped minima with pointer jumping; a place next to a core joins the one with the smallest number.
    """
    at = places(points, lat, lon).withColumn("p", F.xxhash64("lat", "lon"))
    at = written(at, "places")
    near = within(at.select("lat", "lon", "p"), at, metres).select(F.col("l.p").alias("a"), F.col("r.p").alias("b"), F.col("r.n").alias("n"))
    near = written(near, "near")
    core = near.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a")
    edges = written(near.join(core, "a").join(core.withColumnRenamed("a", "b"), "b").select("a", "b"), "edges")
    label = written(edges.groupBy("a").agg(F.min("b").alias("c")), "labels")
    while True:
        low = edges.join(label.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("c").alias("c"))
        jumped = low.join(label.select(F.col("a").alias("c"), F.col("c").alias("d")), "c").select("a", "d")
        new = written(jumped.withColumnRenamed("d", "c"), "labels")
        changed = new.join(label.withColumnRenamed("c", "old"), "a").where("c != old").limit(1).count()
        forget(label)
        label = new
        if not changed:
            break
    edge_of = near.join(label.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("c").alias("c"))
    of = edge_of.join(label.withColumnRenamed("c", "own"), "a", "left").select(F.col("a").alias("p"), F.coalesce("own", "c").alias("cluster_id"))
    placed = at.join(of, "p", "left").select("lat", "lon", F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    return points.join(placed, (points[lat] == placed.lat) & (points[lon] == placed.lon), "left").drop("lat", "lon").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))


def representatives(clustered: DataFrame, score: Column, key: str = "id") -> DataFrame:
    """Each row with cluster_size and is_duplicate: the best row of a cluster is kept, ties by the smaller key; no position, no duplicate."""
    best = clustered.where("cluster_id != -1").groupBy("cluster_id").agg(F.max(F.struct(score.alias("score"), (-F.col(key)).alias("key"))).alias("best"), F.count("*").alias("cluster_size"))
    out = clustered.join(best, "cluster_id", "left")
    return out.withColumn("is_duplicate", F.coalesce(F.col(key) != -F.col("best.key"), F.lit(False))).withColumn("cluster_size", F.coalesce("cluster_size", F.lit(1))).drop("best")


def interpolate(frames: DataFrame, track: DataFrame, clamp: bool = False) -> DataFrame:
    """As-of join of frames (track_id, frame_id, t) with fixes (track_id, t, lat, lon), positions linear between the fixes around.

    Outside the track: null, or the end fix where clamp is set. One union, no range join. Rows are sorted by ranges of track and time, and a
    window holds a track's part of one range; what lies before and after a range is told by the ends of the others. t is a number of
    seconds.
    """
    fixes = track.select("track_id", "t", "lat", "lon").groupBy("track_id", "t").agg(F.min_by("lat", F.struct("lat", "lon")).alias("lat"), F.min_by("lon", F.struct("lat", "lon")).alias("lon"))
    fix = F.struct("t", "lat", "lon")
    both = fixes.select("track_id", "t", F.lit(None).cast("long").alias("frame_id"), fix.alias("fix")).unionByName(
        frames.select("track_id", "t", F.col("frame_id").cast("long").alias("frame_id"), F.lit(None).cast(fixes.select(fix.alias("f")).schema["f"].dataType).alias("fix"))
    )
    both = written(both.repartitionByRange("track_id", "t").withColumn("part", F.spark_partition_id()), "track")  # rows of one time lie in one range
    ends = both.where("fix is not null").groupBy(F.col("track_id").alias("track"), F.col("part").alias("range")).agg(F.min_by("fix", "t").alias("first"), F.max_by("fix", "t").alias("last"))
    held = both.select(F.col("track_id").alias("track"), F.col("part").alias("range")).distinct()
    parts = held.join(ends.withColumnsRenamed({"track": "t_", "range": "r_"}), F.col("track").eqNullSafe(F.col("t_")) & (F.col("range") == F.col("r_")), "left")
    of = Window.partitionBy("track").orderBy("range")  # at most as many rows as a shuffle has partitions
    parts = parts.select("track", "range", F.last("last", ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.first("first", ignorenulls=True).over(of.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    w = Window.partitionBy("track_id", "part").orderBy("t")
    both = both.withColumn("before", F.last("fix", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    both = both.withColumn("after", F.first("fix", ignorenulls=True).over(w.rangeBetween(0, Window.unboundedFollowing))).where("frame_id is not null")
    both = both.join(parts, F.col("track_id").eqNullSafe(F.col("track")) & (F.col("part") == F.col("range")))
    both = both.withColumn("before", F.coalesce("before", "earlier")).withColumn("after", F.coalesce("after", "later"))
    share = F.when(F.col("after.t") > F.col("before.t"), (F.col("t") - F.col("before.t")) / (F.col("after.t") - F.col("before.t"))).otherwise(0.0)
    inside = F.col("before").isNotNull() & F.col("after").isNotNull()

    def place(c: str) -> Column:
        line = F.col(f"before.{c}") + (F.col(f"after.{c}") - F.col(f"before.{c}")) * share
        ends = F.coalesce(F.col(f"before.{c}"), F.col(f"after.{c}")) if clamp else F.lit(None)
        return F.when(inside, line).otherwise(ends).alias(c)

    return both.select("track_id", "frame_id", "t", place("lat"), place("lon"), (inside & (share > 0)).alias("was_interpolated"))
