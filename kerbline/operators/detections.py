"""Filters, summaries, grids and rankings over the inventory of detections."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import scoring
from kerbline.functions.geo import haversine_m, metres_to_lat, metres_to_lon


def select(d: DataFrame, damage_type=None, min_severity=None, max_severity=None, since=None, until=None) -> DataFrame:
    """Each condition only where given; a null severity fails both bounds."""
    for given, condition in (
        (damage_type, F.col("damage_type") == damage_type), (min_severity, F.col("severity") >= min_severity), (max_severity, F.col("severity") <= max_severity),
        (since, F.col("last_detected") >= F.lit(since)), (until, F.col("last_detected") <= F.lit(until)),
    ):
        if given is not None:
            d = d.where(condition)
    return d


def in_box(d: DataFrame, min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> DataFrame:
    if not (-180 <= min_lon < max_lon <= 180 and -90 <= min_lat < max_lat <= 90):
        raise ValueError("the box is empty or out of range")
    return d.where(F.col("longitude").between(min_lon, max_lon) & F.col("latitude").between(min_lat, max_lat))


def in_radius(d: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows within reach, with the distance; a box that the scan can use goes before."""
    high = metres_to_lat(metres) * 1.001
    from math import cos, radians

    wide = metres / (vocab.METRES_PER_DEGREE * max(cos(radians(lat)), 0.01)) * 1.01
    near = d.where(F.col("latitude").between(lat - high, lat + high) & F.col("longitude").between(lon - wide, lon + wide))
    return near.withColumn("metres", haversine_m(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon))).where(F.col("metres") <= metres)


def reopened() -> Column:
    """Seen again after the repair."""
    return F.coalesce(F.col("is_fixed") & (F.col("last_detected") > F.col("fixed_on")), F.lit(False))


def days_to_today(day: Column, as_of: dt.date) -> Column:
    return F.greatest(F.datediff(F.lit(as_of), day), F.lit(0))


def city_stats(d: DataFrame) -> DataFrame:
    """One pass: what nine scans would tell."""
    latest = d.agg(F.max("survey_date").alias("latest")).scalar()
    return d.agg(
        F.count("*").alias("total"), F.max("survey_date").alias("last_survey"), F.count_if(F.col("survey_date") == latest).alias("today"), F.round(F.avg("severity"), 2).alias("avg_severity"),
        F.round(F.avg(F.col("confidence").cast("decimal(9,6)")), 3).cast("double").alias("avg_confidence"), F.count_if(F.col("severity") >= 4).alias("critical"), F.count_if(F.col("is_fixed")).alias("fixed"),
    )


def weekly_trend(d: DataFrame, as_of: dt.date, weeks: int = 12) -> DataFrame:
    """New and repaired defects by week; weeks with neither have no row."""
    since = F.lit(as_of - dt.timedelta(weeks=weeks))
    sides = F.array(F.struct(F.col("first_detected").alias("day"), F.lit(1).alias("new"), F.lit(0).alias("fixed")), F.struct(F.col("fixed_on").alias("day"), F.lit(0).alias("new"), F.lit(1).alias("fixed")))
    each = d.select(F.explode(sides).alias("x")).select("x.*").where(F.col("day") >= since)
    return each.groupBy(F.trunc("day", "week").alias("week")).agg(F.sum("new").cast("long").alias("new_count"), F.sum("fixed").cast("long").alias("fixed_count"))


def mean_degrees(c: str) -> Column:
    """Mean of coordinates of six decimals, rounded to six; exact, so that it does not hang on the order of summing."""
    return F.round(F.avg(F.col(c).cast("decimal(12,6)")), 6).cast("double")


def quality_grid(d: DataFrame, as_of: dt.date, cell_m: float = 120) -> DataFrame:
    """Road quality by cell: severity, faded with age and cut where repaired, summed to a penalty and turned into a score and a band."""
    ref = d.agg(F.coalesce(F.avg("latitude"), F.lit(45.0))).scalar()
    dlat, dlon = metres_to_lat(cell_m), metres_to_lon(cell_m, ref)
    faded = F.exp(-days_to_today(F.col("last_detected"), as_of) / vocab.FADE_DAYS)
    penalty = scoring.chosen(F.col("severity"), vocab.QUALITY_WEIGHTS, 1.0) * faded * F.when(F.col("is_fixed"), vocab.FIXED_SHARE).otherwise(1.0)
    cells = d.groupBy(F.floor(F.col("latitude") / dlat).alias("y"), F.floor(F.col("longitude") / dlon).alias("x")).agg(
        mean_degrees("latitude").alias("lat"), mean_degrees("longitude").alias("lon"), F.sum(penalty).alias("penalty"), F.count("*").alias("n"), F.max("severity").alias("worst")
    )
    score = F.round(100 * F.exp(-F.col("penalty") / vocab.PENALTY_SCALE)).cast("int")
    out = cells.select("y", "x", "lat", "lon", F.least(F.greatest(score, F.lit(0)), F.lit(100)).alias("score"), "n", "worst")
    return out.withColumn("band", scoring.banded(F.col("score"), vocab.QUALITY_BANDS))


def heat(d: DataFrame, most: int = 20_000) -> DataFrame:
    """Bins of four decimals, heaviest first: severity times the log of sightings; without severity there is no weight."""
    weighed = d.where("severity is not null").withColumn("w", F.col("severity") * F.ln(F.col("detection_count") + 1))
    bins = weighed.groupBy(F.round(F.col("latitude").cast("decimal(12,6)"), 4).alias("lat_bin"), F.round(F.col("longitude").cast("decimal(12,6)"), 4).alias("lon_bin")).agg(
        F.round(F.sum("w"), 6).alias("weight"), mean_degrees("latitude").alias("lat"), mean_degrees("longitude").alias("lon"), F.count("*").alias("n")
    )
    return bins.orderBy(F.desc("weight"), "lat_bin", "lon_bin").limit(most)


def median_geofilter(fixes: DataFrame, km: float = 50.0, group: str = "track_id", order: str = "fix_id") -> DataFrame:
    """Fixes within reach of the track's upper median position; fewer than four fixes, or none within reach: all stay."""
    w = Window.partitionBy(group)
    ranked = fixes.withColumn("n", F.count("*").over(w)).withColumn("i", F.row_number().over(w.orderBy("lat", order))).withColumn("j", F.row_number().over(w.orderBy("lon", order)))
    middle = F.floor(F.col("n") / 2) + 1
    ranked = ranked.withColumn("mid_lat", F.max(F.when(F.col("i") == middle, F.col("lat"))).over(w)).withColumn("mid_lon", F.max(F.when(F.col("j") == middle, F.col("lon"))).over(w))
    near = haversine_m(F.col("lat"), F.col("lon"), F.col("mid_lat"), F.col("mid_lon"), 6371.0088) <= km
    ranked = ranked.withColumn("near", near).withColumn("any_near", F.max("near").over(w))
    return ranked.where("n < 4 or near or not any_near").select(*fixes.columns)


def page(d: DataFrame, sort: str = "priority", size: int = 100, number: int = 1) -> DataFrame:
    """A page in descending order; an unknown column sorts by priority; the key breaks ties."""
    columns = {"priority": F.col("priority_score"), "severity": F.col("severity"), "last_detected": F.col("last_detected"), "confidence": F.col("confidence"), "detection_count": F.col("detection_count")}
    return d.orderBy(columns.get(sort, columns["priority"]).desc_nulls_last(), "id").offset((number - 1) * size).limit(min(size, 10_000))
