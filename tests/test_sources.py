"""Readers and writers on small files."""

from pyspark.sql import functions as F

from kerbline.sources import labels, tracks


def put(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def test_gpx(spark, tmp_path):
    path = put(tmp_path, "a.gpx", '<gpx><trk><trkseg><trkpt lat="46.5" lon="23.5"><ele>300</ele><time>2024-01-01T00:00:01Z</time></trkpt><trkpt lat="0" lon="0"><time>2024-01-01T00:00:02Z</time></trkpt><trkpt lat="46.6" lon="23.6"></trkpt></trkseg></trk></gpx>')
    assert [(r.lat, r.lon, r.elevation) for r in tracks.read_gpx(spark, path).collect()] == [(46.5, 23.5, 300.0)]


def test_gps_json(spark, tmp_path):
    one = put(tmp_path, "j/a.json", '{"gps": [{"lat": 46.5, "long": 23.5, "ts": 1000}, {"lat": 0.0, "lon": 1.0, "ts": 5}]}')
    put(tmp_path, "j/b.json", '[{"latitude": 46.6, "longitude": 23.6, "timestamp": 2000}]')
    got = sorted((r.lat, r.lon) for r in tracks.read_gps_json(spark, one.rsplit("/", 1)[0]).collect())
    assert got == [(46.5, 23.5), (46.6, 23.6)]


def test_csv_track(spark, tmp_path):
    path = put(tmp_path, "t.csv", 'GPSLatitude,LNG,Time\n"46,5",23.5,2024-01-01 00:00:00\nx,23.5,1\n91,0.5,2\n')
    assert [(r.lat, r.lon) for r in tracks.read_csv_track(spark, path).collect()] == [(46.5, 23.5)]


def test_nmea(spark):
    lines = spark.createDataFrame([("$GPRMC,123519,A,4807.038,N,01131.000,W,022.4,084.4,230394,003.1,W*6A",), ("$GPRMC,1,V,4807.038,N,01131.000,E,0,0,230394",), ("$GPGGA,123519,4807.038,S,01131.000,E,1,08",), ("junk",)], "value string")
    got = {r.kind: (round(r.lat, 4), round(r.lon, 4), r.speed_mps and round(r.speed_mps, 3)) for r in tracks.parse_nmea(lines).collect()}
    assert got == {"RMC": (48.1173, -11.5167, 11.524), "GGA": (-48.1173, 11.5167, None)}


def test_text_position(spark):
    rows = [("Lat: 46.123 Lon: 23.456",), ("46.1234 N 23.4567 W",), ("at 46.123, 23.456",), ("46.1, 23.4",), ("46.123, 46.123",)]
    got = [r.p and (r.p.lat, r.p.lon) for r in spark.createDataFrame(rows, "t string").select(tracks.text_position(F.col("t")).alias("p")).collect()]
    assert got == [(46.123, 23.456), (46.1234, -23.4567), (46.123, 23.456), None, None]


def test_first_success(spark):
    a = spark.createDataFrame([("f1", None, 1.0, 1.0)], "file string, time timestamp, lat double, lon double")
    b = spark.createDataFrame([("f1", None, 2.0, 2.0), ("f2", None, 3.0, 3.0)], a.schema)
    assert sorted((r.file, r.lat, r.strategy) for r in tracks.first_success([("a", a), ("b", b)]).collect()) == [("f1", 1.0, "a"), ("f2", 3.0, "b")]


def test_yolo_round_trip(spark, tmp_path):
    path = put(tmp_path, "l/img1.txt", "4 0.5 0.5 0.2 0.1\nbad line\n0 0.05 0.5 0.2 0.1\n")
    boxes = labels.read_yolo(spark, path)
    assert boxes.where("not ok").count() == 1
    sizes = spark.createDataFrame([("img1", 100, 200)], "stem string, width int, height int")
    got = sorted((r.category_id, round(r.x, 6), round(r.y, 6)) for r in labels.yolo_to_coco(boxes, sizes, {4: 1, 0: 2}).collect())
    assert got == [(1, 40.0, 90.0), (2, 0.0, 90.0)]
    assert labels.yolo_lines(boxes.where("ok")).first().label == "0 0.050000 0.500000 0.200000 0.100000\n4 0.500000 0.500000 0.200000 0.100000"


def test_voc(spark, tmp_path):
    path = put(tmp_path, "a.xml", "<annotation><filename>a.jpg</filename><object><name>hole</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object><object><name>cat</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>9</ymax></bndbox></object></annotation>")
    assert [(r.category_id, r.x, r.w, r.h) for r in labels.read_voc(spark, path, {"hole": 4}).collect()] == [(4, 1.0, 4.0, 7.0)]


def test_seg(spark, tmp_path):
    path = put(tmp_path, "a.seg", "width 9\n0 0 0 8\n1 1 2 4\n1 3 1 2\n")
    r = labels.read_seg_boxes(spark, path).first()
    assert (r.x0, r.y0, r.x1, r.y1, r.pixels) == (1, 1, 4, 3, 5)


def test_runs_and_metrics(spark, tmp_path):
    put(tmp_path, "r/a/run.json", '{"experiment": "e", "seed": 1, "status": "ok", "git_dirty": false}')
    put(tmp_path, "r/a/test_metrics.json", '{"m": 0.5}')
    put(tmp_path, "r/b/run.json", '{"experiment": "f"}')
    got = {r.experiment: r.metrics for r in labels.read_runs(spark, str(tmp_path / "r")).collect()}
    assert got == {"e": {"m": 0.5}, "f": None}
    path = put(tmp_path, "m.csv", "epoch, loss,map\n1,0.5,\n2,,0.3\n")
    assert sorted((r.epoch, r.metric, r.value) for r in labels.read_metrics(spark, path).collect()) == [(1, "loss", 0.5), (2, "map", 0.3)]


def test_run_artefacts(spark, tmp_path):
    put(tmp_path, "r/a/run.json", '{"experiment": "e", "seed": 1, "git_sha": "0123456789ab", "status": "ok", "git_dirty": true, "results": {"val": {"m": 9}}}')
    put(tmp_path, "r/a/test_metrics.json", '{"test": {"m": 0.5}, "other": {"x": 1}}')
    put(tmp_path, "r/a/per_class_ap.json", '{"per_class_AP50": {"pothole": 0.25, "rutting": 1}, "split": "test"}')
    put(tmp_path, "r/x/b/run.json", '{"results": {"val": {"m": 0.1}, "more": {"m": 1}}}')
    put(tmp_path, "r/x/b/test_metrics.json", '{"neither": {"m": 1}}')
    put(tmp_path, "r/c/run.json", '{"experiment": ""}')
    put(tmp_path, "r/c/per_class_ap.json", "{broken")
    got = {r.experiment: r for r in labels.read_run_artefacts(spark, str(tmp_path / "r")).collect()}
    assert set(got) == {"e", "b", "c"}
    assert (got["e"].git_sha, got["e"].git_dirty, got["e"].metrics, got["e"].per_class, got["e"].per_class_split) == ("01234567", True, {"test": {"m": 0.5}}, {"pothole": 0.25, "rutting": 1.0}, "test")
    assert (got["b"].metrics, got["b"].status, got["b"].git_dirty, got["b"].per_class, got["b"].per_class_split) == ({"val": {"m": 0.1}}, "unknown", False, {}, "unknown")
    assert got["c"].metrics is None and got["c"].per_class == {} and got["c"].git_sha is None


def test_strict_gpx(spark, tmp_path):
    space = 'xmlns="http://www.topografix.com/GPX/1/1"'
    body = '<trk><trkseg><trkpt lat="46.5" lon="23.5"><ele>300</ele><time>2024-01-01T00:00:01Z</time></trkpt><trkpt lon="5.5"/><trkpt lat="x" lon="1"/><trkpt lat="91" lon="1"/><trkpt/><trkpt lon=\'7\' lat=\'47\'><time>never</time></trkpt></trkseg></trk>'
    put(tmp_path, "g/a.gpx", f'<?xml version="1.0"?>\n<gpx {space} version="1.1">{body}</gpx>')
    put(tmp_path, "g/b.gpx", f"<gpx>{body}</gpx>")
    prefixed = body.replace("<", "<q:").replace("<q:/", "</q:")
    put(tmp_path, "g/c.gpx", f"<q:gpx {space.replace('xmlns', 'xmlns:q')}>{prefixed}</q:gpx>")
    put(tmp_path, "g/d.gpx", f'<gpx xmlns="http://www.topografix.com/GPX/1/0">{body}</gpx>')
    got = sorted((r.file[-5:], r.lat, r.lon, r.elevation, r.time is not None) for r in tracks.read_gpx_strict(spark, str(tmp_path / "g")).collect())
    own = [(0.0, 5.5, None, False), (46.5, 23.5, 300.0, True), (47.0, 7.0, None, False)]
    assert got == [(f, *x) for f in ("a.gpx", "c.gpx") for x in own]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, 46.12345678, 23.5, None)], "id long, lat double, lon double, s int")
    labels.write_csv(df, str(tmp_path / "out"), {"lat": 4})
    assert spark.read.text(str(tmp_path / "out")).collect()[1][0] == "1,46.1235,23.5,"
    assert labels.geojson(df).first().feature == '{"type":"Feature","geometry":{"type":"Point","coordinates":[23.5,46.12345678]},"properties":{"id":1}}'
    assert sorted(r.name for r in labels.materialised(spark.createDataFrame([("train", "a")] * 3, "split string, image string")).collect()) == ["a", "a__dup1", "a__dup2"]
