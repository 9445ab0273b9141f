"""GPS tracks from GPX, JSON, CSV, NMEA, subtitles and free text, all as (file, time, lat, lon, ...) with bad rows dropped."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.functions.geo import valid
from kerbline.session import written

def number(text: Column) -> Column:
    """A decimal with point or comma; null for anything else."""
    return F.replace(F.trim(text), F.lit(","), F.lit(".")).try_cast("double")


def when(text: Column) -> Column:
    """ISO or one of a few other forms, or epoch seconds."""
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss")
    epoch = text.try_cast("double")
    return F.coalesce(text.try_cast("timestamp"), *(F.try_to_timestamp(text, F.lit(f)) for f in forms), F.when(epoch > 1e8, F.timestamp_millis((epoch * 1000).cast("long"))))


def read_gpx(spark: SparkSession, path: str) -> DataFrame:
    """Track points of GPX files that have a time and a position in range; naive times are UTC."""
    schema = "_lat string, _lon string, ele string, time string"
    raw = spark.read.format("xml").option("rowTag", "trkpt").schema(schema).load(path)
    out = raw.select(F.input_file_name().alias("file"), when(F.col("time")).alias("time"), number(F.col("_lat")).alias("lat"), number(F.col("_lon")).alias("lon"), number(F.col("ele")).alias("elevation"))
    return out.where(F.col("time").isNotNull() & valid(F.col("lat"), F.col("lon")))


#: The namespace that the strict dialect asks for.
GPX_SPACE = "http://www.topografix.com/GPX/1/1"


def read_gpx_strict(spark: SparkSession, path: str) -> DataFrame:
    """Track points of GPX files of version 1.1 by its namespace: files of another one have none. A time is not needed, and one that cannot be
    read is null; a coordinate that is missing counts as 0, one that is no number drops the point."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    root = F.regexp_extract("value", r"(?s)<((?:\w+:)?gpx\b[^>]*)>", 1)
    prefix = F.regexp_extract(root, r"^(\w+:)?gpx", 1)
    declared = F.regexp_extract(root, rf"xmlns(:\w+)?\s*=\s*[\"']{re.escape(GPX_SPACE)}[\"']", 1)
    ours = root.contains(GPX_SPACE) & (F.concat(F.ltrim(declared, F.lit(":")), F.when(declared != "", ":").otherwise("")) == prefix)
    points = text.where(ours).select("file", F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(<(?:\w+:)?trkpt\b(?:[^>]*/>|.*?</(?:\w+:)?trkpt\s*>))"), F.lit(1))).alias("p"))

    def attribute(name: str) -> Column:
        found = F.regexp_extract("p", rf"(?s)^<[^>]*?\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
        there = F.col("p").rlike(rf"(?s)^<[^>]*?\s{name}\s*=")
        return F.when(there, F.trim(found).try_cast("double")).otherwise(0.0)

    def child(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("p", rf"(?s)<(?:\w+:)?{name}\s*>(.*?)</", 1)), F.lit(""))

    out = points.select("file", child("time").try_cast("timestamp").alias("time"), attribute("lat").alias("lat"), attribute("lon").alias("lon"), child("ele").try_cast("double").alias("elevation"))
    return out.where(valid(F.col("lat"), F.col("lon")))


def read_gps_json(spark: SparkSession, path: str) -> DataFrame:
    """Fixes under `locations` or `gps`, or a bare list, with either of the usual names; times in milliseconds; 0.0 counts as missing."""
    fix = "struct<latitude: double, lat: double, longitude: double, lon: double, long: double, timestamp: double, ts: double>"
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    held = F.from_json("value", f"locations array<{fix}>, gps array<{fix}>")
    fixes = F.coalesce(held["locations"], held["gps"], F.from_json("value", f"array<{fix}>"))
    x = text.select("file", F.explode(fixes).alias("x"))

    def first(*names: str) -> Column:
        return F.coalesce(*(F.nullif(F.col(f"x.{n}"), F.lit(0.0)) for n in names))

    out = x.select("file", F.timestamp_millis(first("timestamp", "ts").cast("long")).alias("time"), first("latitude", "lat").alias("lat"), first("longitude", "lon", "long").alias("lon"))
    return out.where(F.col("time").isNotNull() & valid(F.col("lat"), F.col("lon")))


# Names a column of a telemetry table may have, in any case.
SYNONYMS = {
    "lat": ("lat", "latitude", "gpslatitude"), "lon": ("lon", "lng", "long", "longitude", "gpslongitude"),
    "elevation": ("ele", "elevation", "alt", "altitude", "gpsaltitude"), "time": ("time", "timestamp", "datetime", "date", "gpsdatetime"),
}


def read_csv_track(spark: SparkSession, path: str) -> DataFrame:
    """Telemetry tables with a header: columns by any of their names, decimal comma allowed, bad rows dropped."""
    raw = spark.read.option("header", True).csv(path)
    by = {c.strip().lower().replace(" ", ""): c for c in raw.columns}

    def column(name: str) -> Column:
        found = [F.col(f"`{by[s]}`") for s in SYNONYMS[name] if s in by]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = raw.select(F.input_file_name().alias("file"), when(column("time")).alias("time"), *(number(column(c)).alias(c) for c in ("lat", "lon", "elevation")))
    return out.where(valid(F.col("lat"), F.col("lon")))


def nmea_degrees(value: Column, hemisphere: Column) -> Column:
    """ddmm.mmmm with N, S, E or W as signed degrees."""
    x = value.try_cast("double")
    whole = F.floor(x / 100)
    sign = F.when(F.upper(hemisphere).isin("S", "W"), -1.0).otherwise(1.0)
    return sign * (whole + (x - whole * 100) / 60)


def parse_nmea(lines: DataFrame, column: str = "value") -> DataFrame:
    """RMC sentences of status A and GGA sentences: (kind, time, lat, lon, speed_mps); other lines are dropped."""
    p = F.split(F.regexp_replace(F.trim(column), r"\*[0-9A-Fa-f]{2}$", ""), ",")
    kind = F.regexp_extract(p[0], r"^\$..(RMC|GGA)$", 1)
    at = lines.select(p.alias("p"), kind.alias("kind"))
    rmc = at.where("kind = 'RMC' and size(p) > 9 and p[2] = 'A'").select(
        "kind", F.try_to_timestamp(F.concat(F.get("p", F.lit(9)), F.substring(F.get("p", F.lit(1)), 1, 6)), F.lit("ddMMyyHHmmss")).alias("time"),
        nmea_degrees(F.get("p", F.lit(3)), F.get("p", F.lit(4))).alias("lat"), nmea_degrees(F.get("p", F.lit(5)), F.get("p", F.lit(6))).alias("lon"), (F.get("p", F.lit(7)).try_cast("double") * 0.514444).alias("speed_mps"),
    )
    gga = at.where("kind = 'GGA' and size(p) > 6 and p[6] != '0'").select(
        "kind", F.lit(None).cast("timestamp").alias("time"), nmea_degrees(F.get("p", F.lit(2)), F.get("p", F.lit(3))).alias("lat"), nmea_degrees(F.get("p", F.lit(4)), F.get("p", F.lit(5))).alias("lon"), F.lit(None).cast("double").alias("speed_mps"),
    )
    return rmc.unionByName(gga).where(valid(F.col("lat"), F.col("lon")))


def text_position(text: Column) -> Column:
    """Position in free text as struct (lat, lon): labelled, then with hemispheres, then a bare pair; three decimals at least, in range."""
    n = r"([-+]?\d{1,3}[.,]\d{3,})"
    labelled = (rf"(?i)lat(?:itude)?\s*[:=]?\s*{n}", rf"(?i)lon(?:g(?:itude)?)?\s*[:=]?\s*{n}")
    tagged = (rf"{n}\s*°?\s*([NS])", rf"{n}\s*°?\s*([EW])")
    bare = rf"{n}\s*[,; ]\s*{n}"

    def got(pattern: str, i: int = 1) -> Column:
        return number(F.nullif(F.regexp_extract(text, pattern, i), F.lit("")))

    def signed(pattern: str, minus: str) -> Column:
        return got(pattern) * F.when(F.regexp_extract(text, pattern, 2) == minus, -1).otherwise(1)

    pairs = ((got(labelled[0]), got(labelled[1])), (signed(tagged[0], "S"), signed(tagged[1], "W")), (got(bare, 1), got(bare, 2)))
    ok = [F.when(valid(a, b) & (a != b), F.struct(a.alias("lat"), b.alias("lon"))) for a, b in pairs]
    return F.coalesce(*ok)


def first_success(strategies: list[tuple[str, DataFrame]]) -> DataFrame:
    """Of several readings of the same files, each file's rows from the first strategy in order that gave any, with its name."""
    tagged = [df.select("file", "time", "lat", "lon", F.lit(i).alias("priority"), F.lit(name).alias("strategy")) for i, (name, df) in enumerate(strategies)]
    both = reduce(DataFrame.unionByName, tagged)
    return both.withColumn("best", F.min("priority").over(Window.partitionBy("file"))).where("priority = best").drop("best", "priority")


def track_format(name: Column) -> Column:
    """gpx or json, by the suffix of a file's name; any other is an error."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    return F.when(suffix.isin("gpx", "json"), suffix).otherwise(F.raise_error(F.concat(F.lit("no track format of "), name)))


def subtitle_position(line: Column) -> Column:
    """Position in a line of subtitles as struct (lat, lon): labelled numbers, else GPS(longitude, latitude) with the two told apart by their
    range where only one can be a latitude, else any that text_position() finds."""
    n = r"([-+]?\d+(?:\.\d+)?)"

    def got(pattern: str, i: int = 1) -> Column:
        return F.regexp_extract(line, pattern, i).try_cast("double")

    lat, lon = got(rf"(?i)latitude\s*:\s*{n}"), got(rf"(?i)longt?itude\s*:\s*{n}")
    pair = rf"(?i)gps\s*\(\s*{n}\s*,\s*{n}"
    a, b = got(pair, 1), got(pair, 2)
    turned = (F.abs(a) <= 90) & (F.abs(b) > 90)
    gps = F.when(a.isNotNull(), F.struct(F.when(turned, a).otherwise(b).alias("lat"), F.when(turned, b).otherwise(a).alias("lon")))
    found = F.coalesce(F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"))), gps, text_position(line))
    return F.when(valid(found["lat"], found["lon"]), found)


def parse_subtitles(lines: DataFrame, column: str = "value") -> DataFrame:
    """(time, lat, lon) of the lines of a subtitle file: NMEA sentences as such, others by subtitle_position()."""
    trimmed = F.trim(F.col(column))
    nmea = trimmed.rlike(r"^\$.{0,4}(RMC|GGA)")
    others = lines.where(~nmea).select(subtitle_position(trimmed).alias("p")).where("p is not null")
    return parse_nmea(lines.where(nmea), column).select("time", "lat", "lon").unionByName(others.select(F.lit(None).cast("timestamp").alias("time"), "p.lat", "p.lon"))


#: Names of the fields of a point in JSON, the first that is there counts.
_JSON_NAMES = {
    "lat": ("lat", "latitude", "Lat", "Latitude"), "lon": ("lon", "lng", "long", "longitude", "Lon", "Longitude"),
    "elevation": ("ele", "alt", "altitude", "elevation"), "time": ("time", "timestamp", "datetime", "utc", "date"),
}


def walk_json(texts: DataFrame) -> DataFrame:
    """(file, time, lat, lon, elevation) of every object, however deep, of the JSON texts (file, value) that holds a numeric latitude and longitude.

    Level by level: each pass explodes the objects and lists of the one before, all files together. Texts that are no JSON give nothing.
    """
    spark = texts.sparkSession
    level = texts.select("file", F.try_parse_json("value").alias("v")).where("v is not null")
    found = []

    def field(name: str) -> Column:
        return F.coalesce(*(F.try_variant_get("v", f"$.{k}", "variant") for k in _JSON_NAMES[name]))

    def figure(x: Column) -> Column:
        return F.when(F.schema_of_variant(x).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(x, "$", "double"))

    while True:
        level = written(level, "level")
        at = level.select("file", when(F.try_variant_get(field("time"), "$", "string")).alias("time"), figure(field("lat")).alias("lat"), figure(field("lon")).alias("lon"), figure(field("elevation")).alias("elevation"))
        found.append(at.where(valid(F.col("lat"), F.col("lon"))))
        inner = level.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select("file", F.col("value").alias("v"))
        inner = inner.where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, found)
        level = inner


def gpx_documents(points: DataFrame, name: str = "kerbline") -> DataFrame:
    """(file, value): a GPX 1.1 document of each file's points (file, time, lat, lon, elevation, speed_mps), in order of time; height, time
    and speed are left out where they are null. A document holds one file's points."""
    def part(c: Column, text: Column) -> Column:
        return F.when(c.isNotNull(), text).otherwise("")

    head = F.format_string('<trkpt lat="%.7f" lon="%.7f">', "lat", "lon")
    ele = part(F.col("elevation"), F.format_string("<ele>%.2f</ele>", "elevation"))
    at = part(F.col("time"), F.concat(F.lit("<time>"), F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("</time>")))
    speed = part(F.col("speed_mps"), F.format_string("<extensions><speed>%.3f</speed></extensions>", "speed_mps"))
    rows = points.select("file", F.struct("time", "lat", "lon", F.concat(head, ele, at, speed, F.lit("</trkpt>")).alias("x")).alias("p"))
    lines = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["x"]), "\n").alias("points"))
    top = f'<?xml version="1.0" encoding="UTF-8"?>\n<gpx version="1.1" creator="{name}" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>\n'
    return lines.select("file", F.concat(F.lit(top), "points", F.lit("\n</trkseg></trk></gpx>\n")).alias("value"))
