"""Named queries over rasters, camera files, class lists and a lookup, which are made from the driver's tables."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbline import vocab
from kerbline.operators import pixels
from kerbline.operators.lookup import Lookup
from kerbline.plans import views as V
from kerbline.plans.registry import query
from kerbline.session import scratch_dir
from kerbline.sources import camera, classes

#: A vector of 64 numbers is an image of 8 x 8 spots, each SPOT pixels wide; the mask is that of the numbers from the end.
SPOT, SPOTS = 4, 8
_SIDE = SPOT * SPOTS


def _rasters(spark, sf):
    e = V.table(spark, sf, "embeddings").where(f"size(embedding) = {SPOTS * SPOTS}").select(F.col("vec_id").alias("image_id"), "embedding")
    spot = F.transform(F.sequence(F.lit(0), F.lit(_SIDE * _SIDE - 1)), lambda i: (F.floor(i / (_SIDE * SPOT)) * SPOTS + F.floor((i % _SIDE) / SPOT)).cast("int"))
    grey = F.transform(spot, lambda i: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 400 * F.get("embedding", i).cast("double")))).cast("int")), 2, "0"))
    mask = F.transform(spot, lambda i: F.when(F.get("embedding", SPOTS * SPOTS - 1 - i) > 0.02, "FF").otherwise("00"))
    size = [F.lit(_SIDE).alias("height"), F.lit(_SIDE).alias("width"), F.lit(1).alias("channels")]
    return e.select("image_id", *size, F.unhex(F.array_join(grey, "")).alias("pixels"), F.unhex(F.array_join(mask, "")).alias("mask"))


_PIXELS = f"""v as (select vec_id as image_id, list_transform(embedding, lambda e: greatest(0, least(255, floor(128 + 400 * e::double)))::bigint) as p, list_transform(embedding, lambda e: e > 0.02) as q from embeddings where len(embedding) = {SPOTS * SPOTS}),
t as (select image_id, y, x, p[(y // {SPOT}) * {SPOTS} + x // {SPOT} + 1] as g, q[{SPOTS * SPOTS} - ((y // {SPOT}) * {SPOTS} + x // {SPOT})] as m from v, range({_SIDE}) a(y), range({_SIDE}) b(x))"""

_GRADIENT = """l as (select *, coalesce(lead(g) over r, lag(g) over r) - coalesce(lag(g) over r, lead(g) over r) as dx, coalesce(lag(g) over r, lead(g) over r) + 2 * g + coalesce(lead(g) over r, lag(g) over r) as sm,
  max(m) over (r rows between 2 preceding and 2 following) as m2, min(m) over (r rows between 4 preceding and 4 following) as m4 from {0} window r as (partition by {1}, y order by x)),
e as (select *, coalesce(lag(dx) over c, lead(dx) over c) + 2 * dx + coalesce(lead(dx) over c, lag(dx) over c) as gx, coalesce(lead(sm) over c, lag(sm) over c) - coalesce(lag(sm) over c, lead(sm) over c) as gy,
  max(m2) over (c rows between 2 preceding and 2 following) as grown, min(m4) over (c rows between 4 preceding and 4 following) as shrunk from l window c as (partition by {1}, x order by y))"""


@query("sc_sev_12_mask_geometry", f"""with {_PIXELS}, {_GRADIENT.format('t', 'image_id')}
select image_id, count(*) filter (where m) as surface_area_px, coalesce(avg(sqrt(gx * gx + gy * gy)) filter (where grown and not m), 0) as edge_sharpness,
  coalesce(abs(avg(g) filter (where m) - avg(g) filter (where m and not shrunk)), 0) as interior_contrast from e group by image_id""")
def sc_sev_12_masks(spark, sf):
    """Area, sharpness and contrast of every mask; the outer border is beyond SQL, so compactness has a query of its own."""
    return pixels.mask_geometry(_rasters(spark, sf), digits=None).drop("mask_compactness")


def _sides(i):
    return {"x1": i % 9, "y1": i % 7, "x2": 20 + i % 14, "y2": 18 + i % 11}


_BOXES = """k as (select vec_id, vec_id % 9 as x1, vec_id % 7 as y1, 20 + vec_id % 14 as x2, 18 + vec_id % 11 as y2 from embeddings),
crop as (select image_id, y, x, g from t join k on vec_id = image_id and x >= x1 - 4 and x < x2 + 4 and y >= y1 - 4 and y < y2 + 4),
h as (select image_id, g, sum(count(*)) over (partition by image_id order by g) as n1, sum(sum(g)) over (partition by image_id order by g) as s1, sum(count(*)) over (partition by image_id) as n, sum(sum(g)) over (partition by image_id) as s from crop group by image_id, g),
o as (select image_id, g as cut, n1 / n as share, row_number() over (partition by image_id order by case when n1 < n then ((n * s1 - n1 * s)::double * (n * s1 - n1 * s)::double) / (n1 * (n - n1))::double else -1 end desc, g) as i from h),
d as (select crop.*, share < 0.02 or share > 0.9 or g <= cut as m from crop join o using (image_id) where i = 1)"""


@query("sc_sev_12_box_geometry", f"""with {_PIXELS}, {_BOXES}, {_GRADIENT.format('d', 'image_id')}
select image_id, count(*) filter (where m) as surface_area_px, coalesce(avg(sqrt(gx * gx + gy * gy)) filter (where grown and not m), 0) as edge_sharpness,
  coalesce(abs(avg(g) filter (where shrunk) - avg(g) filter (where grown and not m)), 0) as interior_contrast from e group by image_id""")
def sc_sev_12_boxes(spark, sf):
    """A box in every image, by its dark side."""
    return _boxes_of(spark, sf, None).select("image_id", "surface_area_px", "edge_sharpness", "interior_contrast")


def _boxes_of(spark, sf, digits):
    r = _rasters(spark, sf)
    i = F.col("image_id")
    boxes = r.select("image_id", i.alias("box_id"), V.pick(vocab.CLASSES, i % 10).alias("class_name"), *(c.alias(k) for k, c in _sides(i).items()))
    return pixels.box_geometry(r, boxes, "image_id", digits=digits)


@query("sc_sev_12_severity")
def sc_sev_12_severity(spark, sf):
    """All figures of the boxes with compactness, the depth that stands in, and the severity that follows."""
    return _boxes_of(spark, sf, 4)


# ---------------------------------------------------------------- camera files, written byte by byte


def _number(x: Column, width: int = 4) -> Column:
    """A whole number of so many bytes, in hexadecimal digits."""
    return F.substring(F.lpad(F.hex(x.cast("long")), 16, "0"), 17 - 2 * width, 2 * width)


def _text(x: Column) -> Column:
    return F.hex(F.encode(x, "UTF-8"))


def _record(name: str, kind: str, size: int, repeats: Column, payload: Column) -> Column:
    head = F.concat(F.lit((name.encode() + (kind.encode() or b"\0") + bytes([size])).hex()), _number(repeats, 2))
    return F.concat(head, payload, F.repeat(F.lit("0"), ((8 - F.length(payload) % 8) % 8).cast("int")))


def _nested(name: str, *inner: Column) -> Column:
    body = F.concat(*inner)
    return _record(name, "", 4, F.length(body) / 8, body)


_DAY = "strftime(ts, '%Y-%m-%d')"


@query("src_12_telemetry", f"""select user_id || '/' || {_DAY} as file, row_number() over (partition by user_id, {_DAY} order by event_id) - 1 as seq, (467000000 + (event_id % 1000) * 1234) / 1e7 as lat,
  -(235000000 + (event_id % 777) * 4321) / 1e7 as lon, (event_id % 500) * 10 / 1000 as elevation, date_trunc('second', min(ts) over (partition by user_id, {_DAY})) as time, (event_id % 90) * 100 / 1000 as speed_mps from events""")
def src_12(spark, sf):
    """A recording for each user and day, read back from its nested records."""
    e = V.table(spark, sf, "events")
    i = F.col("event_id")
    sample = F.concat(_number(467_000_000 + i % 1000 * 1234), _number(-(235_000_000 + i % 777 * 4321)), _number(i % 500 * 10), _number(i % 90 * 100), _number(i % 7))
    by = e.groupBy(F.concat("user_id", F.lit("/"), F.date_format("ts", "yyyy-MM-dd")).alias("file")).agg(F.min("ts").alias("began"), F.sort_array(F.collect_list(F.struct(i.alias("i"), sample.alias("s")))).alias("rows"))
    scale = _record("SCAL", "l", 4, F.lit(5), F.concat(*(_number(F.lit(x)) for x in (10**7, 10**7, 1000, 1000, 100))))
    fixes = _record("GPS5", "l", 20, F.size("rows"), F.array_join(F.transform("rows", lambda r: r.s), ""))
    time = _record("GPSU", "U", 16, F.lit(1), _text(F.concat(F.date_format("began", "yyMMddHHmmss"), F.lit(".000"))))
    camera_name = _record("DVNM", "c", 1, F.lit(5), F.lit(b"Hero5".hex()))
    files = by.select("file", F.unhex(_nested("DEVC", camera_name, _nested("STRM", scale, time, fixes))).alias("content"))
    return camera.telemetry_points(files).select("file", "seq", "lat", "lon", "elevation", F.col("time").cast("timestamp_ntz").alias("time"), "speed_mps")


def _blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for r in part.itertuples():
            i = r.event_id
            time = struct.pack("<6I", r.hour, r.minute, r.second, r.year, r.month, r.day)
            fix = b"ANE"[:2] + (b"W" if i % 3 == 0 else b"E") + struct.pack("<3f", 4630 + i % 100 / 4, 2310 + i % 64 / 8, i % 250)
            out.append((b"ANE\0freeGPS"[: i % 12] + bytes([65 + i % 50]) * (i % 400) + camera.MARK + b"\0" * (i % 20) + time + (fix if i % 11 else b"VNE")).ljust(300 + i % 400, b"\1"))
        yield pd.DataFrame({"bytes": out})


def _degrees(x: str) -> str:
    return f"(floor({x} / 100) + ({x} - floor({x} / 100) * 100) / 60)"


@query("src_13_marked_blocks", f"""select {_degrees('(4630 + event_id % 100 / 4)::float::double')} as lat, {_degrees('(2310 + event_id % 64 / 8)::float::double')} * case when event_id % 3 = 0 then -1 else 1 end as lon,
  date_trunc('second', ts) as time, case when event_id % 250 < 200 then event_id % 250 * 0.514444::double end as speed_mps from events where event_id % 11 <> 0""")
def src_13(spark, sf):
    """Recordings with a block for each event, written, and read back by their markers."""
    e = V.table(spark, sf, "events")
    clock = [getattr(F, f)("ts").alias(f) for f in ("hour", "minute", "second", "year", "month")]
    path = f"{scratch_dir(spark)}/recordings-{uuid.uuid4().hex}"
    e.select("event_id", *clock, F.dayofmonth("ts").alias("day")).mapInPandas(_blocks, "bytes binary").select(F.col("bytes").cast("string")).write.option("lineSep", "\0").text(path)
    return camera.read_marked_blocks(spark, path).select("lat", "lon", F.col("time").cast("timestamp_ntz").alias("time"), "speed_mps")


def _box(name: bytes, *inner: Column) -> Column:
    body = F.concat(*inner)
    return F.concat(_number(8 + F.length(body) / 2), F.lit(name.hex()), body)


@query("src_14_location_box", """select c_custkey as file, case when c_custkey % 5 > 0 then 46 + (c_custkey % 100) / 64 end as lat, case when c_custkey % 5 > 0 then -(23 + (c_custkey % 1000) / 128) end as lon,
  case when c_custkey % 5 > 1 then (c_custkey % 50) / 2 end as elevation, case when c_custkey % 5 = 0 then 'no position' end as problem from customer""")
def src_14(spark, sf):
    """A recording for each customer with its place in a box of its own, or loose in the user data, or nowhere."""
    k = F.col("c_custkey")
    lat, lon = 46 + k % 100 / 64, -(23 + k % 1000 / 128)
    place = F.format_string("%+.7f%+.7f", lat, lon)
    text = F.when(k % 5 > 1, F.concat(place, F.format_string("%+.1f/", k % 50 / 2))).otherwise(place)
    own = _box(camera.LOCATION, _number(F.length(text), 2), F.lit("15c7"), _text(text))
    user = F.when(k % 5 == 0, _box(b"meta", _text(F.lit("nothing here")))).when(k % 5 == 1, _box(b"meta", _text(F.concat(F.lit("at "), place)))).otherwise(own)
    media = _box(b"mdat", F.repeat(_text(F.lit("+11.11+22.22 ")), (k % 40).cast("int")))
    movie = _box(b"moov", _box(b"trak", _box(b"mdia", F.lit(""))), _box(b"udta", user))
    files = V.table(spark, sf, "customer").select(k.cast("string").alias("file"), F.unhex(F.concat(_box(b"ftyp", _text(F.lit("isom"))), media, movie)).alias("content"))
    return camera.locations(files).withColumn("file", F.col("file").cast("long"))


# ---------------------------------------------------------------- class lists, and the lookup


@query("src_24_class_lists", """with c as (select c_custkey as k, lower(c_mktsegment) as a, 'n' || c_nationkey as b, 'k' || c_custkey % 7 as c from customer)
select k as dataset, unnest(generate_series(0, case k % 5 when 3 then 0 else 2 end)) as class_id, unnest(case k % 5 when 0 then [a, b, c] when 1 then [c, b, a] when 2 then [b, a, c] when 3 then [a] end) as class_name from c where k % 5 < 4""")
def src_24(spark, sf):
    """A settings file for each customer in one of four forms (map, list, inline list, names file), or without a list; and files that do not count."""
    c = V.table(spark, sf, "customer")
    k, a, b, d = F.col("c_custkey"), F.lower("c_mktsegment"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("k"), (F.col("c_custkey") % 7).cast("string"))
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("path: x\nnames:\n  1: '"), b, F.lit("'\n  0: "), a, F.lit("\n# more\n  2: \""), d, F.lit("\"\nnc: 3\n  0: late\n")))
        .when(k % 5 == 1, F.concat(F.lit("names:\n- "), d, F.lit("\n- '"), b, F.lit("'\n\n  - "), a, F.lit("\nval: x\n- late")))
        .when(k % 5 == 2, F.concat(F.lit("nc: 3\nnames: ['"), b, F.lit("', "), a, F.lit(", \""), d, F.lit("\"]\nval: x"))).otherwise("nc: 0\nval: names of none")
    )
    settings = c.select(k.alias("dataset"), F.concat(F.lit("set/"), k.cast("string"), F.lit("/data.yaml")).alias("file"), text.alias("value"))
    names = c.where("c_custkey % 5 = 3 or c_custkey % 5 = 0").select(k.alias("dataset"), F.concat(F.lit("set/"), k.cast("string"), F.lit("/classes.txt")).alias("file"), F.concat(F.lit("\n "), a, F.lit(" \n\n")).alias("value"))
    return classes.indexed(classes.class_lists(settings.unionByName(names)))


_SPOT = "44 + s_suppkey % 40 / 8 as latitude, 22 + s_suppkey % 24 / 8 as longitude"


@query("src_31_landmarks", f"""with p as (select n_name as city, s_nationkey as n, s_suppkey as rank, s_name as name, 'k' || s_suppkey % 3 as kind, {_SPOT} from supplier join nation on s_nationkey = n_nationkey),
b as (select * from (select *, row_number() over (partition by city, latitude, longitude order by rank) as i from p where n % 3 < 2) where i = 1),
f(prefix, name, latitude, longitude) as (values ('nation_2', 'Station', 45.0, 23.0), ('nation_2', 'Bridge', 45.5, 23.5), ('nation_17', 'Square', 46.0, 24.0))
select city, case when n % 3 = 0 then 'cache' else 'fetched' end as source, name, kind, latitude, longitude from b
union all select n_name, 'fallback', name, case when name is not null then 'x' end, latitude, longitude from nation left join f on starts_with(lower(n_name), prefix) where n_name not in (select city from b)""")
def src_31(spark, sf):
    """Suppliers as the places of their nations: a third is known, a third is fetched, and the rest falls back on a list."""
    nation, supplier = V.table(spark, sf, "nation"), V.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    world = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("city"), F.col("s_nationkey").alias("n"), F.col("s_name").alias("name"), F.concat(F.lit("k"), (k % 3).cast("string")).alias("kind"),
        (44 + k % 40 / 8).alias("latitude"), (22 + k % 24 / 8).alias("longitude"), k.alias("rank"),
    )
    store = Lookup(spark, f"{scratch_dir(spark)}/landmarks-{uuid.uuid4().hex}")
    store.learn(world.where("n % 3 = 0"))
    fallback = spark.createDataFrame([("nation_2", "Station", "x", 45.0, 23.0), ("nation_2", "Bridge", "x", 45.5, 23.5), ("nation_17", "Square", "x", 46.0, 24.0)], "prefix string, name string, kind string, latitude double, longitude double")
    return store.resolve(nation.select(F.col("n_name").alias("city")), lambda cities: world.where("n % 3 = 1").join(cities, "city"), fallback)
