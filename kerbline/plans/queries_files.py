"""Named queries over readers and writers: files are made from the driver's tables, written to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.functions import geo, scoring
from kerbline.operators import routes, spatial, writes
from kerbline.operators import detections as D
from kerbline.plans import views as V
from kerbline.plans.queries_detections import case, det, metres
from kerbline.plans.registry import query
from kerbline.plans.views import duck
from kerbline.session import scratch_dir
from kerbline.sources import labels, tracks


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _put(rows: DataFrame, name: str, separator: str = "\n") -> str:
    """Writes the texts of the only column, each followed by the separator, and tells where."""
    path = _folder(rows.sparkSession, name)
    rows.write.option("lineSep", separator).text(path)
    return path


# ---------------------------------------------------------------- tracks

_FIX = "(46 + event_id % 5000 / 9973) as lat, (23 + event_id % 3000 / 7919) as lon"


def _points(spark, sf) -> DataFrame:
    i = F.col("event_id")
    return V.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("file"), F.col("ts").cast("timestamp").alias("time"), (46 + i % 5000 / 9973).alias("lat"), (23 + i % 3000 / 7919).alias("lon"),
        F.when(i % 3 > 0, (i % 64 / 4)).alias("elevation"), F.when(i % 4 > 0, i % 32 / 8).alias("speed_mps"), i.alias("event_id"),
    )


@query("snk_04_gpx_documents", f"""with p as (select user_id, ts, {_FIX}, printf('<trkpt lat="%.7f" lon="%.7f">', 46 + event_id % 5000 / 9973, 23 + event_id % 3000 / 7919) || case when event_id % 3 > 0 then printf('<ele>%.2f</ele>', event_id % 64 / 4) else '' end
  || '<time>' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z</time>' || case when event_id % 4 > 0 then printf('<extensions><speed>%.3f</speed></extensions>', event_id % 32 / 8) else '' end || '</trkpt>' as x from events)
select user_id::varchar as file, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<gpx version="1.1" creator="kerbline" xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>' || chr(10) || string_agg(x, chr(10) order by ts, lat, lon, x) || chr(10) || '</trkseg></trk></gpx>' || chr(10) as value from p group by user_id""")
def snk_04(spark, sf):
    return tracks.gpx_documents(_points(spark, sf).drop("event_id"))


_READ = "select lat, lon, elevation, ts as time from (select case when event_id % 3 > 0 then event_id % 64 / 4 end as elevation, ts, (46 + event_id % 5000 / 9973) as a, (23 + event_id % 3000 / 7919) as b from events), lateral (select round(a, 7) as lat, round(b, 7) as lon)"


@query("src_03_gpx", _READ)
def src_03(spark, sf):
    """Sixteen documents with the points of all users, written and read again."""
    points = _points(spark, sf).withColumn("file", (F.col("event_id") % 16).cast("string")).drop("event_id")
    path = _folder(spark, "gpx")
    tracks.gpx_documents(points).repartition("file").write.partitionBy("file").text(path)
    return tracks.read_gpx(spark, path).select("lat", "lon", "elevation", F.col("time").cast("timestamp_ntz").alias("time"))


@query("src_04_strict_gpx", _READ)
def src_04(spark, sf):
    """The same by the strict dialect."""
    path = _put(tracks.gpx_documents(_points(spark, sf).drop("event_id")).select("value"), "gpx")
    return tracks.read_gpx_strict(spark, path).select("lat", "lon", "elevation", F.col("time").cast("timestamp_ntz").alias("time"))


@query("src_05_gps_json", f"select lat, lon, date_trunc('millisecond', ts) as time from (select {_FIX}, ts from events where event_id % 50 > 0)")
def src_05(spark, sf):
    """Ten files of fixes under one of two names, with positions of zero among them, which count as missing."""
    p = _points(spark, sf)
    i = F.col("event_id")
    lat, lon = F.when(i % 50 == 0, 0.0).otherwise(F.col("lat")), F.col("lon")
    fix = F.when(i % 2 == 0, F.to_json(F.struct(lat.alias("latitude"), lon.alias("longitude"), F.unix_millis("time").alias("timestamp")))).otherwise(F.to_json(F.struct(lat.alias("lat"), lon.alias("long"), F.unix_millis("time").alias("ts"))))
    by = p.select((i % 10).alias("k"), fix.alias("fix")).groupBy("k").agg(F.array_join(F.collect_list("fix"), ", ").alias("fixes"))
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("["), "fixes", F.lit("]"))).otherwise(F.concat(F.lit('{"'), F.when(F.col("k") % 3 == 1, "gps").otherwise("locations"), F.lit('": ['), "fixes", F.lit("]}")))
    path = _folder(spark, "fixes")
    by.select("k", text.alias("value")).repartition("k").write.partitionBy("k").text(path)
    return tracks.read_gps_json(spark, path).select("lat", "lon", F.col("time").cast("timestamp_ntz").alias("time"))


@query("src_06_formats", "select p_partkey, case when p_partkey % 2 = 0 then 'gpx' else 'json' end as format from part")
def src_06(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.lit("dir.x/"), "p_brand", F.when(k % 4 == 0, ".gpx").when(k % 4 == 1, ".JSON").when(k % 4 == 2, ".a.GPX").otherwise(".json"))
    return V.table(spark, sf, "part").select("p_partkey", tracks.track_format(name).alias("format"))


@query("src_07_csv_track", f"select lat, lon, elevation, date_trunc('second', ts) as time from (select {_FIX}, event_id % 64 / 4 as elevation, ts from events where event_id % 40 > 0)")
def src_07(spark, sf):
    """A telemetry table with decimal commas and names of its own; one row in forty has no number."""
    p = _points(spark, sf)
    i = F.col("event_id")
    comma = lambda x: F.replace(x.cast("string"), F.lit("."), F.lit(","))
    rows = p.select(F.when(i % 40 == 0, "none").otherwise(comma(F.col("lat"))).alias("GPS Latitude"), comma(F.col("lon")).alias("LNG"), comma(i % 64 / 4).alias("Altitude"), F.date_format("time", "yyyy/MM/dd HH:mm:ss").alias("DateTime"))
    path = _folder(spark, "track")
    rows.write.option("header", True).csv(path)
    return tracks.read_csv_track(spark, path).select("lat", "lon", "elevation", F.col("time").cast("timestamp_ntz").alias("time"))


@query("src_08_deep_json", f"select user_id::varchar as file, lat, lon, case when event_id % 3 > 0 then event_id % 64 / 4 end as elevation from (select *, {_FIX} from events) where event_id % 5 < 4")
def src_08(spark, sf):
    """Objects of all depths, under any of their names; a fifth holds its position as text, which is none."""
    p = _points(spark, sf)
    i, x, y, z = F.col("event_id"), F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("elevation").cast("string")
    one = (
        F.when(i % 5 == 0, F.format_string('{"lat": %s, "lng": %s, "alt": %s}', x, y, F.coalesce(z, F.lit("null")))).when(i % 5 == 1, F.format_string('{"a": {"b": [1, {"Latitude": %s, "Longitude": %s, "ele": %s}]}}', x, y, F.coalesce(z, F.lit("null"))))
        .when(i % 5 == 2, F.format_string('[[[{"latitude": %s, "lon": %s, "elevation": %s, "x": "y"}]]]', x, y, F.coalesce(z, F.lit("null")))).when(i % 5 == 3, F.format_string('{"gps": {"lat": %s, "long": %s, "altitude": %s}}', x, y, F.coalesce(z, F.lit("null"))))
        .otherwise(F.format_string('{"lat": "%s", "lon": "%s"}', x, y))
    )
    texts = p.select("file", one.alias("one")).groupBy("file").agg(F.concat(F.lit('{"all": ['), F.array_join(F.collect_list("one"), ", "), F.lit("]}")).alias("value"))
    return tracks.walk_json(texts).select("file", "lat", "lon", "elevation")


_MINUTES = "46 + (event_id % 6000) / 100 / 60"


@query("src_09_nmea", f"""select case when event_id % 3 = 0 then 'GGA' else 'RMC' end as kind, round(case when event_id % 2 = 0 then 1 else -1 end * ({_MINUTES}), 7) as lat, round(-(23 + (event_id % 3000) / 100 / 60), 7) as lon,
  case when event_id % 3 > 0 then date_trunc('second', ts) end as time, case when event_id % 3 > 0 then event_id % 80 / 4 * 0.514444::double end as speed_mps from events where event_id % 7 > 0""")
def src_09(spark, sf):
    """A sentence for each event, with checksums; a seventh is void."""
    lines = _sentences(spark, sf)
    return tracks.parse_nmea(lines).select("kind", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"), F.col("time").cast("timestamp_ntz").alias("time"), "speed_mps")


def _sentences(spark, sf) -> DataFrame:
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    lat = F.concat(F.format_string("46%05.2f", i % 6000 / 100), F.when(i % 2 == 0, ",N").otherwise(",S"))
    lon = F.format_string("023%05.2f,W", i % 3000 / 100)
    rmc = F.concat(F.lit("$GPRMC,"), F.date_format(t, "HHmmss"), F.lit(".00,"), F.when(i % 7 > 0, "A,").otherwise("V,"), lat, F.lit(","), lon, F.lit(","), F.format_string("%.2f", i % 80 / 4), F.lit(",084.4,"), F.date_format(t, "ddMMyy"), F.lit(",,*6A"))
    gga = F.concat(F.lit("$GNGGA,"), F.date_format(t, "HHmmss"), F.lit(","), lat, F.lit(","), lon, F.when(i % 7 > 0, ",1,08").otherwise(",0,00"), F.lit(",0.9,545.4,M,46.9,M,,*47"))
    return V.table(spark, sf, "events").select(F.when(i % 3 == 0, gga).otherwise(rmc).alias("value"), i.alias("event_id"))


@query("src_10_subtitles", "select lat, lon from (select 46 + event_id % 5000 / 8192 as lat, case when event_id % 4 = 1 then 120 else 23 end + event_id % 3000 / 4096 as lon from events where event_id % 4 < 3)")
def src_10(spark, sf):
    """Lines of cameras' subtitles: labelled, as a pair whose order its range tells, or free text; a quarter has no position."""
    i = F.col("event_id")
    lat, lon = F.format_string("%.13f", 46 + i % 5000 / 8192), F.format_string("%.13f", F.when(i % 4 == 1, 120).otherwise(23) + i % 3000 / 4096)
    line = (
        F.when(i % 4 == 0, F.concat(F.lit("[iso: 100] [latitude: "), lat, F.lit("] [longtitude: "), lon, F.lit("]"))).when(i % 4 == 1, F.concat(F.lit("GPS ("), lat, F.lit(", "), lon, F.lit(", 20)")))
        .when(i % 4 == 2, F.concat(F.lit("GPS ("), lon, F.lit(", "), lat, F.lit(", 20)"))).otherwise("00:00:01,000 --> 00:00:02,000")
    )
    return tracks.parse_subtitles(V.table(spark, sf, "events").select(line.alias("value"))).select("lat", "lon")


@query("src_11_text_positions", "select event_id, case when event_id % 4 < 3 then 46 + event_id % 5000 / 8192 end as lat, case event_id % 4 when 1 then -(23 + event_id % 3000 / 4096) when 3 then null else 23 + event_id % 3000 / 4096 end as lon from events")
def src_11(spark, sf):
    i = F.col("event_id")
    lat, lon = F.format_string("%.13f", 46 + i % 5000 / 8192), F.format_string("%.13f", 23 + i % 3000 / 4096)
    text = (
        F.when(i % 4 == 0, F.concat(F.lit("seen at Latitude: "), lat, F.lit("; Longitude = "), lon)).when(i % 4 == 1, F.concat(lat, F.lit("° N "), lon, F.lit("° W near the bridge")))
        .when(i % 4 == 2, F.concat(F.lit("around "), F.replace(lat, F.lit("."), F.lit(",")), F.lit("; "), lon)).otherwise("nowhere 46.1, 23.4")
    )
    e = V.table(spark, sf, "events").select("event_id", tracks.text_position(text).alias("p"))
    return e.select("event_id", "p.lat", "p.lon")


# ---------------------------------------------------------------- labels

_YOLO = "l_orderkey as frame, l_partkey % 10 as class_id, l_quantity / 64 as cx, l_linenumber / 8 as cy, l_discount::double as w, l_tax::double as h"


def _yolo(spark, sf) -> DataFrame:
    """Lines of labels, one in nine broken."""
    i = F.col("l_partkey") + F.col("l_suppkey")
    numbers = F.concat_ws(" ", (F.col("l_partkey") % 10).cast("string"), *(x.cast("double").cast("string") for x in (F.col("l_quantity") / 64, F.col("l_linenumber") / 8, F.col("l_discount"), F.col("l_tax"))))
    return V.table(spark, sf, "lineitem").select(F.when(i % 9 == 0, F.concat(numbers, F.lit(" 7"))).when(i % 9 == 1, F.concat(F.lit("x"), numbers)).otherwise(numbers).alias("value"))


@query("src_17_yolo", f"select class_id, cx, cy, w, h, count(*) as n from (select {_YOLO} from lineitem where (l_partkey + l_suppkey) % 9 > 1) group by all")
def src_17(spark, sf):
    """Boxes of label files; lines with a field too many or no number are broken."""
    boxes = labels.read_yolo(spark, _put(_yolo(spark, sf), "yolo")).where("ok")
    return boxes.groupBy(F.col("class_id").cast("long").alias("class_id"), "cx", "cy", "w", "h").agg(F.count("*").alias("n"))


@query("src_18_coco", f"""with b as (select frame % 50 as stem, class_id, cx, cy, w, h from (select {_YOLO} from lineitem) where class_id % 3 > 0 and frame % 50 < 40)
select stem, class_id + 100 as category_id, greatest(0, cx * (640 + stem) - w * (640 + stem) / 2) as x, greatest(0, cy * 480 - h * 480 / 2) as y, w * (640 + stem) as box_width, h * 480 as box_height, count(*) as n from b group by all""")
def src_18(spark, sf):
    """Boxes in pixels: classes without a number of theirs and images of unknown size are skipped."""
    li = V.table(spark, sf, "lineitem")
    d = [x.cast("double").alias(n) for n, x in (("cx", F.col("l_quantity") / 64), ("cy", F.col("l_linenumber") / 8), ("w", F.col("l_discount")), ("h", F.col("l_tax")))]
    boxes = li.select((F.col("l_orderkey") % 50).cast("string").alias("stem"), (F.col("l_partkey") % 10).cast("int").alias("class_id"), *d, F.lit(True).alias("ok"))
    sizes = boxes.select("stem").distinct().where("cast(stem as int) < 40").select("stem", (640 + F.col("stem").cast("int")).alias("width"), F.lit(480).alias("height"))
    out = labels.yolo_to_coco(boxes, sizes, {c: c + 100 for c in range(10) if c % 3})
    return out.groupBy(F.col("stem").cast("long").alias("stem"), F.col("category_id").cast("long").alias("category_id"), "x", "y", "box_width", "box_height").agg(F.count("*").alias("n"))


@query("snk_09_label_files", f"""select frame as stem, string_agg(x, chr(10) order by x) as label from (select frame, printf('%d %.6f %.6f %.6f %.6f', class_id::integer, least(cx, 1), least(cy, 1), w, h) as x from (select {_YOLO} from lineitem)) group by frame""")
def snk_09(spark, sf):
    """The text of each image's label file."""
    li = V.table(spark, sf, "lineitem")
    d = [x.cast("double").alias(n) for n, x in (("cx", F.col("l_quantity") / 64), ("cy", F.col("l_linenumber") / 8), ("w", F.col("l_discount")), ("h", F.col("l_tax")))]
    return labels.yolo_lines(li.select(F.col("l_orderkey").alias("stem"), (F.col("l_partkey") % 10).alias("class_id"), *d))


def _enclosed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines of a task, which become a file, with the root that they lie in."""
    yield pd.DataFrame({"value": ["<annotations>"]})
    yield from batches
    yield pd.DataFrame({"value": ["</annotations>"]})


@query("src_19_voc", """select filename, category_id, x, y, w, h from (select 'img' || l_orderkey as filename, l_partkey % 4 as category_id, l_linenumber * 10.0::double as x, l_quantity::double as y, (l_partkey % 30)::double as w, (l_suppkey % 40)::double as h from lineitem) where category_id < 3 and w > 0 and h > 0""")
def src_19(spark, sf):
    """A file of annotations for each task, line by line; names that are not known and empty boxes are skipped."""
    c = lambda x: x.cast("double").cast("string")
    x, y, w, h = F.col("l_linenumber") * 10, F.col("l_quantity"), F.col("l_partkey") % 30, F.col("l_suppkey") % 40
    box = F.concat(F.lit("<object><name>k"), (F.col("l_partkey") % 4).cast("string"), F.lit("</name><bndbox><xmin>"), c(x), F.lit("</xmin><ymin>"), c(y), F.lit("</ymin><xmax>"), c(x + w), F.lit("</xmax><ymax>"), c(y + h), F.lit("</ymax></bndbox></object>"))
    each = V.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(box), "").alias("o"))
    text = F.concat(F.lit("<annotation><filename>img"), F.col("l_orderkey").cast("string"), F.lit("</filename>"), "o", F.lit("</annotation>"))
    files = each.select(text.alias("value")).mapInPandas(_enclosed, "value string")
    got = labels.read_voc(spark, _put(files, "voc"), {"k0": 0, "k1": 1, "k2": 2})
    return got.select("filename", F.col("category_id").cast("long").alias("category_id"), "x", "y", "w", "h")


@query("src_20_mask_boxes", """select min(a) as x0, min(r) as y0, max(b) as x1, max(r) as y1, sum(b - a + 1) as pixels from (select l_partkey % 3 as l, l_linenumber as r, l_suppkey % 50 as a, l_suppkey % 50 + l_quantity::integer as b from lineitem) where l > 0""")
def src_20(spark, sf):
    """The box of a mask of runs, of one file with all lines; runs of label 0 are background."""
    li = V.table(spark, sf, "lineitem")
    a = F.col("l_suppkey") % 50
    runs = li.select(F.concat_ws(" ", (F.col("l_partkey") % 3).cast("string"), F.col("l_linenumber").cast("string"), a.cast("string"), (a + F.col("l_quantity").cast("int")).cast("string")).alias("value"))
    boxes = labels.read_seg_boxes(spark, _put(runs, "masks"))
    return boxes.agg(*(f(c).cast("long").alias(c) for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max), ("pixels", F.sum))))


@query("src_21_pairs", "select p_partkey % 7 as root, p_partkey as stem, case when p_partkey % 3 > 0 then 'labels/' || p_partkey || '.txt' end as label_path from part")
def src_21(spark, sf):
    """Images with their label file, by folder and stem; a third has none, and labels of other folders do not count."""
    p = V.table(spark, sf, "part")
    k = F.col("p_partkey")
    images = p.select((k % 7).alias("root"), k.alias("stem"), F.concat(F.lit("images/"), k.cast("string"), F.lit(".jpg")).alias("path"))
    found = p.select(F.when(k % 3 > 0, k % 7).otherwise(k % 7 + 1).alias("root"), k.alias("stem"), F.concat(F.lit("labels/"), k.cast("string"), F.lit(".txt")).alias("label_path"))
    return labels.pairs(images, found).select("root", "stem", "label_path")


@query("src_27_ragged_metrics", "select o_orderkey::integer as epoch, metric, value from (select o_orderkey, 'loss' as metric, case when o_orderkey % 2 = 0 then o_orderkey % 64 / 8 end as value from orders union all select o_orderkey, 'map', case when o_orderkey % 3 = 0 then o_orderkey % 32 / 4 end from orders) where value is not null")
def src_27(spark, sf):
    """A metrics table with blanks, and names with spaces before them."""
    k = F.col("o_orderkey")
    rows = V.table(spark, sf, "orders").select(k.alias("epoch"), F.when(k % 2 == 0, k % 64 / 8).alias(" loss"), F.when(k % 3 == 0, k % 32 / 4).alias("  map"))
    path = _folder(spark, "metrics")
    rows.write.option("header", True).csv(path)
    return labels.read_metrics(spark, path).select("epoch", "metric", "value")


@query("snk_13_metric_log", "select o_orderkey as epoch, case when o_orderstatus <> 'F' then o_totalprice end as loss, case when o_orderstatus = 'F' then o_custkey end as map from orders")
def snk_13(spark, sf):
    """A log of two calls, the second with its columns in another order and one of them missing."""
    o = V.table(spark, sf, "orders").where("o_orderstatus is not null")
    path = _folder(spark, "log")
    labels.append_metrics(o.where("o_orderstatus != 'F'").select(F.col("o_orderkey").alias("epoch"), F.col("o_totalprice").alias("loss"), F.lit(None).cast("string").alias("map")), path)
    labels.append_metrics(o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("map"), F.col("o_orderkey").alias("epoch")), path)
    got = spark.read.option("header", True).csv(path)
    return got.select(F.col("epoch").cast("long").alias("epoch"), F.col("loss").cast("double").alias("loss"), F.col("map").cast("long").alias("map"))


# ---------------------------------------------------------------- single rules over whole tables


@query("sc_geo_01_distances", det(f"select id, round({metres('latitude', 'longitude', '46.77', '23.59')}, 4) as metres, round({metres('latitude', 'longitude', '46.77', '23.59', 6371.0088)}, 7) as km from v_detections"))
def sc_geo_01(spark, sf):
    """From every defect to one place, in metres and, by the mean radius, in kilometres."""
    at = (F.col("latitude"), F.col("longitude"), F.lit(46.77), F.lit(23.59))
    return V.detections(spark, sf).select("id", F.round(geo.haversine_m(*at), 4).alias("metres"), F.round(geo.haversine_m(*at, 6371.0088), 7).alias("km"))


@query("sc_geo_03_valid", "select event_id, lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0) as valid from (select event_id, event_id % 13 * 16 - 96 as lat, event_id % 11 * 40 - 200 as lon from events)")
def sc_geo_03(spark, sf):
    i = F.col("event_id")
    return V.table(spark, sf, "events").select("event_id", geo.valid(i % 13 * 16 - 96, i % 11 * 40 - 200).alias("valid"))


@query("sc_geo_05_nmea_degrees", "select event_id, round(case event_id % 4 when 0 then 1 when 2 then 1 else -1 end * (event_id % 90 + (event_id % 600) / 10 / 60), 9) as degrees from events")
def sc_geo_05(spark, sf):
    i = F.col("event_id")
    value, side = F.format_string("%02d%04.1f", i % 90, i % 600 / 10), F.element_at(F.array(*map(F.lit, ("N", "s", "E", "W"))), (i % 4 + 1).cast("int"))
    return V.table(spark, sf, "events").select("event_id", F.round(tracks.nmea_degrees(value, side), 9).alias("degrees"))


#: Halves are rounded up by the shortest decimal of a number, as Spark does.
_SIGNALS = ", ".join(f"round(cast(cast(least({x}, 1.0::double) as varchar) as decimal(30, 20)), 4)::double as s{i}" for i, x in enumerate(("depth_norm::double", "surface_area_px / 1000.0::double", "interior_contrast / 2.0::double", "edge_sharpness / 60.0::double"), 1))
_RAW = " + ".join(f"{case('class_name', {c: w[i] for c, w in vocab.SIGNAL_WEIGHTS.items()}, 0.25)}::double * s{i + 1}" for i in range(4))


@query("sc_sev_01_signals", duck("v_boxes", body=f"select frame_id, box_id, part, {_SIGNALS} from v_boxes"))
def sc_sev_01(spark, sf):
    b = V.boxes(spark, sf)
    d = vocab.SIGNAL_DENOMS
    return b.select("frame_id", "box_id", "part", scoring.signal(F.col("depth_norm")).alias("s1"), scoring.signal(F.col("surface_area_px"), d["area"]).alias("s2"), scoring.signal(F.col("interior_contrast"), d["contrast"]).alias("s3"), scoring.signal(F.col("edge_sharpness"), d["sharpness"]).alias("s4"))


@query("sc_sev_02_raw_scores", duck("v_boxes", body=f"""s as (select *, {_SIGNALS} from v_boxes), r as (select frame_id, box_id, part, class_name, {_RAW} as raw from s)
select frame_id, box_id, part, round(raw, 3) as raw, case when raw * w * 2 >= 0.75 then 'S5' when raw * w * 2 >= 0.55 then 'S4' when raw * w * 2 >= 0.35 then 'S3' when raw * w * 2 >= 0.15 then 'S2' else 'S1' end as level
from (select *, {case('class_name', vocab.CLASS_WEIGHTS, 0.25)}::double as w from r) where abs(raw * 1000 - floor(raw * 1000) - 0.5) > 0.06 and least(abs(raw * w * 2 - 0.75), abs(raw * w * 2 - 0.55), abs(raw * w * 2 - 0.35), abs(raw * w * 2 - 0.15)) > 0.0002"""))
def sc_sev_02(spark, sf):
    """Scores and levels of all boxes but those that lie on the edge of a rounding or of a level, where engines' last digits decide."""
    b, cls = V.boxes(spark, sf), F.col("class_name")
    exact = scoring.weighted_signals(cls, F.col("depth_norm"), F.col("surface_area_px"), F.col("interior_contrast"), F.col("edge_sharpness"))
    weight = scoring.chosen(cls, vocab.CLASS_WEIGHTS, 0.25)

    def clear(e):
        return (F.abs(e * 1000 - F.floor(e * 1000) - 0.5) > 0.06) & (F.least(*(F.abs(e * weight * 2 - x) for x in (0.75, 0.55, 0.35, 0.15))) > 0.0002)

    raw = F.round("exact", 4)
    kept = b.withColumn("exact", exact).where(scoring.once(F.col("exact"), clear))
    return kept.select("frame_id", "box_id", "part", F.round(raw, 3).alias("raw"), scoring.level(scoring.severity_score(raw, cls)).alias("level"))


@query("prj_02_computed", det("select id, coalesce(is_fixed and last_detected > fixed_on, false) as reopened, id % 4 > 0 as has_evidence from v_detections"))
def prj_02(spark, sf):
    """Columns that a reader adds: whether a defect was seen again after its repair, and whether there is a picture of it."""
    d = V.detections(spark, sf).withColumn("crop", F.when(F.col("id") % 4 > 0, F.concat(F.lit("crop/"), F.col("id").cast("string"))))
    return d.select("id", D.reopened().alias("reopened"), F.col("crop").isNotNull().alias("has_evidence"))


@query("sc_arr_02_arrays", "select c_custkey as id, case when c_custkey % 3 > 0 then [c_nationkey, c_custkey % 5] else [] end || case when c_custkey % 2 = 0 then [c_custkey % 7] else [] end as a from customer where c_custkey % 3 > 0 or c_custkey % 2 = 0")
def sc_arr_02(spark, sf):
    """Arrays of both sides in a row, where either side may be missing."""
    c = V.table(spark, sf, "customer")
    k = F.col("c_custkey")
    left = c.where(k % 3 > 0).select(k.alias("id"), F.array(F.col("c_nationkey").cast("long"), (k % 5).cast("long")).alias("a"))
    return writes.arrays_merged(left, c.where(k % 2 == 0).select(k.alias("id"), F.array((k % 7).cast("long")).alias("a")), "id", "a")


@query("jn_06_nearest_defect", det(f"""q as (select id, latitude as la, longitude as lo, damage_type as k from v_detections where id % 20 = 0),
n as (select q.id, d.id as target_id, round({metres('la', 'lo', 'd.latitude', 'd.longitude')}, 6) as m from q join v_detections d on d.damage_type = k and abs(d.latitude - la) < 0.0001 and abs(d.longitude - lo) < 0.0001)
select id, target_id, m as metres from (select *, row_number() over (partition by id order by m, target_id) as r from n where m <= 2) where r = 1"""))
def jn_06(spark, sf):
    """The nearest defect of the same class within two metres of a sighting: of every twentieth, against all."""
    d = V.detections(spark, sf).select("id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.col("damage_type").alias("kind"))
    near = spatial.within(d.where("id % 20 = 0"), d, 2).where("l.kind = r.kind")
    best = near.groupBy(F.col("l.id").alias("id")).agg(F.min(F.struct(F.round("metres", 6).alias("m"), F.col("r.id").alias("target_id"))).alias("b"))
    return best.select("id", "b.target_id", F.col("b.m").alias("metres"))


@query("opt_03_plans", duck("v_detections", "v_items", body=f"""s as (select work_order_id as order_id, id as stop_id, latitude, longitude, row_number() over (partition by work_order_id order by id) - 1 as stop_seq from v_items join v_detections on id = detection_id),
l as (select order_id, coalesce({metres('lag(latitude) over w', 'lag(longitude) over w', 'latitude', 'longitude')} / 1000, 0) as km from s window w as (partition by order_id order by stop_seq))
select order_id, count(*) as stops, round(sum(km), 6) as total_km, cast(round(sum(km) / 25 * 60 + 20 * count(*)) as bigint) as minutes from l group by order_id having abs((sum(km) / 25 * 60) % 1 - 0.5) > 0.000001"""))
def opt_03(spark, sf):
    """Length and time of visiting the items of an order in the order of their numbers; the few whose minutes are just a half are left out."""
    from pyspark.sql import Window

    items = V.work_order_items(spark, sf).join(V.detections(spark, sf), F.col("detection_id") == F.col("id"))
    w = Window.partitionBy("order_id").orderBy("stop_id")
    stops = items.select(F.col("work_order_id").alias("order_id"), F.col("id").alias("stop_id"), "latitude", "longitude")
    km = F.coalesce(geo.haversine_m(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude")) / 1000, F.lit(0.0))
    legs = stops.withColumn("leg_km", km).withColumn("stop_seq", F.row_number().over(w) - 1)
    legs = legs.withColumn("minutes", F.sum("leg_km").over(w) / 25 * 60 + 20 * (F.col("stop_seq") + 1))
    clear = legs.groupBy("order_id").agg((F.sum("leg_km") / 25 * 60).alias("m")).where(F.abs(F.col("m") % 1 - 0.5) > 0.000001).select("order_id")
    return routes.summaries(legs.join(clear, "order_id", "left_semi")).select("order_id", "stops", F.round("total_km", 6).alias("total_km"), "minutes")
