"""Camera files against encoders: nested records, marked blocks across every cut, location boxes."""

import datetime as dt
import struct

import pyarrow as pa
import pytest

from kerbline.sources import camera

WHEN = dt.datetime(2024, 5, 6, 7, 8, 9, tzinfo=dt.timezone.utc)


def record(name, kind, size, repeats, payload):
    return name + (kind.encode() if kind else b"\0") + bytes([size]) + repeats.to_bytes(2) + payload + bytes(-len(payload) % 4)


def box_of(name, *inner):
    body = b"".join(inner)
    body += bytes(-len(body) % 4)
    return record(name, "", 4, len(body) // 4, body)


def scale(*by):
    return record(b"SCAL", "l", 4, len(by), struct.pack(f">{len(by)}i", *by))


def fixes(name, *rows):
    return record(name, "l", 4 * len(rows[0]), len(rows), b"".join(struct.pack(f">{len(r)}i", *r) for r in rows))


TIME = record(b"GPSU", "U", 16, 1, b"240506070809.000")
ROW = (465_000_000, 235_000_000, 300_000, 1500, 1400)


def test_records_round_trip():
    data = box_of(b"DEVC", record(b"DVNM", "c", 1, 3, b"cam"), box_of(b"STRM", scale(10**7, 10**7, 1000, 1000, 100), TIME, fixes(b"GPS5", ROW, (0, 0, 0, 0, 0), (910_000_000, 1, 1, 1, 1), ROW)))
    got, wrong = camera.telemetry(data)
    assert got == [(46.5, 23.5, 300.0, WHEN, 1.5)] * 2 and not wrong


def test_divisors_hold_in_their_stream():
    inner = box_of(b"DEVC", fixes(b"GPS5", ROW))  # no stream of its own: inherits
    data = box_of(b"DEVC", box_of(b"STRM", scale(10**8), inner), box_of(b"STRM", fixes(b"GPS9", ROW)), scale(10**9), fixes(b"GPS5", ROW[:2]))
    got, _ = camera.telemetry(data)
    assert [g[:3] for g in got] == [(4.65, 2.35, 0.003), (46.5, 23.5, 300.0), (0.465, 0.235, None)] and got[1][4] is None
    assert camera.telemetry(box_of(b"STRM", scale(0, 10**7), fixes(b"GPS5", (5, 10**7, 7))))[0][0][:2] == (5.0, 1.0)  # a divisor of 0 divides nothing


@pytest.mark.parametrize("cut", range(0, 130, 3))
def test_cut_records_are_told(cut):
    data = box_of(b"DEVC", box_of(b"STRM", scale(10**7, 10**7, 1000, 1000, 100), TIME, fixes(b"GPS5", *[ROW] * 3)))
    got, wrong = camera.telemetry(data[: len(data) - cut])
    assert bool(wrong) == (0 < cut <= len(data) - 8)  # less than a head is nothing
    left = min(3, max(0, 3 - -(-cut // 20)))
    assert got == [(46.5, 23.5, 300.0, WHEN, 1.5)] * (left if cut <= 60 else 0)


def test_nesting_is_bounded():
    data = fixes(b"GPS5", ROW)
    for _ in range(40):
        data = box_of(b"DEVC", data)
    assert camera.telemetry(data) == ([], ["DEVC is nested too deep"])
    assert camera.telemetry(b"\0" * 64) == ([], []) and camera.telemetry(b"") == ([], [])


def test_telemetry_table(spark, tmp_path):
    rows = [("a", box_of(b"DEVC", box_of(b"STRM", fixes(b"GPS5", ROW, ROW)))), ("b", fixes(b"GPS5", ROW)[:20]), ("c", None), ("d", b"junk")]
    got = sorted((r.file, r.seq, r.problem) for r in camera.telemetry_points(spark.createDataFrame([(*r, 1) for r in rows], "file string, content binary, seq int")).collect() if r.seq is None or r.lat == 46.5)
    assert [g for g in got if g[0] == "a"] == [("a", 0, None), ("a", 1, None)] and ("b", None, "GPS5 ends early") in got and {g[0] for g in got} == {"a", "b"}
    (tmp_path / "x.bin").write_bytes(rows[0][1])
    assert camera.read_telemetry(spark, str(tmp_path)).count() == 2


def block(lat=4630.0, lon=2330.0, speed=10.0, hemispheres=b"NE", lead=b"", time=(7, 8, 9, 2024, 5, 6)):
    body = camera.MARK + lead + (struct.pack("<6I", *time) if time else b"") + b"A" + hemispheres + struct.pack("<3f", lat, lon, speed)
    return body.ljust(camera.BLOCK, b"\0")


def test_one_block():
    assert camera.block_fix(block()) == (46.5, 23.5, None, WHEN, pytest.approx(5.14444))
    assert camera.block_fix(block(hemispheres=b"SW"))[:2] == (-46.5, -23.5)
    assert camera.block_fix(block(speed=500.0))[4] is None and camera.block_fix(block(time=(25, 0, 0, 0, 1, 1)))[3] is None and camera.block_fix(block(time=None))[3] is None
    assert camera.block_fix(block(lat=float("nan"))) is None and camera.block_fix(block(lat=9930.0)) is None and camera.block_fix(block(hemispheres=b"XE")) is None
    assert camera.block_fix(block(lead=b"ANE" + b"\xff" * 13)) == (46.5, 23.5, None, WHEN, pytest.approx(5.14444))  # a false one comes first
    assert camera.block_fix(b"ANE") is None and camera.block_fix(b"") is None


def test_markers_across_every_cut(spark, tmp_path):
    """A file of 3 KB in splits of 97 bytes: markers lie at every offset within a split; half markers and repeated ones lie about."""
    data, want = block(1.0, 1.0), []
    for i in range(60):
        data += b"freeGPS"[: i % 8] + b"x" * (i % 5)
        data += block(4600.0 + i, 2300.0 + i) if i % 4 else camera.MARK
        want += [4600.0 + i] if i % 4 else []
    (tmp_path / "a.mp4").write_bytes(b"ANE" + struct.pack("<3f", 1234.0, 1234.0, 1.0) + data)
    (tmp_path / "b.mp4").write_bytes(block(4500.0, 2200.0))
    (tmp_path / "c.mp4").write_bytes(b"nothing at all")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = camera.read_marked_blocks(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 50
        rows = sorted((r.file.rsplit("/", 1)[1], r.split, r.line, round((r.lat - int(r.lat)) * 60 + int(r.lat) * 100, 2)) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r[3] for r in rows if r[0] == "a.mp4"] == [1.0, *want]
    assert [r[3] for r in rows if r[0] != "a.mp4"] == [4500.0]


def atom(name, *inner, wide=False, size=None):
    body = b"".join(inner)
    if wide:
        return (1).to_bytes(4) + name + (16 + len(body)).to_bytes(8) + body
    return (8 + len(body) if size is None else size).to_bytes(4) + name + body


def place(text):
    return atom(camera.LOCATION, len(text).to_bytes(2), b"\x15\xc7", text)


MEDIA = atom(b"mdat", b"+11.111+22.222" * 9 + camera.LOCATION + b"\0\x05\0\0+1+1/")

CASES = {
    "plain": (atom(b"ftyp", b"isom") + MEDIA + atom(b"moov", atom(b"trak", b""), atom(b"udta", place(b"+46.5000+023.5000+300.1/"))), (46.5, 23.5, 300.1)),
    "wide": (atom(b"mdat", MEDIA, wide=True) + atom(b"moov", atom(b"udta", place(b"-46.5+23.5/"), wide=True)), (-46.5, 23.5, None)),
    "deep": (atom(b"moov", atom(b"trak", atom(b"udta", place(b"+1.5-2.5/")))), (1.5, -2.5, None)),
    "loose": (MEDIA + atom(b"moov", atom(b"udta", atom(b"meta", b"where +46.25+023.25 it was"))), (46.25, 23.25, None)),
    "last to the end": (atom(b"moov", atom(b"udta", place(b"+5.5+6.5/")), size=0), (5.5, 6.5, None)),
    "none": (MEDIA + atom(b"moov", atom(b"udta", b"")), None),
    "range": (atom(b"moov", atom(b"udta", place(b"+99.5+23.5/"))), None),
    "short": (atom(b"moov", atom(b"udta", place(b"+46.5+23.5/")))[:-3], None),
    "broken": (atom(b"ftyp", b"isom") + (3).to_bytes(4) + b"moov" + place(b"+46.5+23.5/"), None),
    "empty": (b"", None), "junk": (b"\x00\x00", None),
}


def read_of(data, seen=None):
    def read(at, n):
        if seen is not None:
            seen.append((at, n))
        return data[at : at + n]

    return read


@pytest.mark.parametrize("name", CASES)
def test_location_boxes(name):
    data, want = CASES[name]
    got, problems = camera.location(read_of(data), len(data))
    assert got == want or name == "short" and got[:1] == (46.5,)
    assert bool(problems) == (name in ("range", "short", "broken"))


def test_media_is_not_read():
    data = atom(b"mdat", b"z" * 100_000) + CASES["plain"][0]
    seen = []
    assert camera.location(read_of(data, seen), len(data))[0] == (46.5, 23.5, 300.1)
    assert sum(n for _, n in seen) < 500


def test_small_files_leave_a_task_together():
    """A batch for each of many recordings costs more than they do."""
    parts = [pa.record_batch({"a": [i] * (i % 3)}, pa.schema([("a", pa.int64())])) for i in range(25_000)]
    got = list(camera.gathered(iter(parts)))
    assert len(got) == 3 and [x for b in got for x in b.column(0).to_pylist()] == [x for p in parts for x in p.column(0).to_pylist()]
    rows = [(str(i), float(i), 0.0, None, None) for i in range(25_000)]
    got = list(camera._together(iter(rows)))
    assert len(got) == 3 and [tuple(r.values()) for b in got for r in b.to_pylist()] == rows and not list(camera._together(iter(())))


def test_location_files(spark, tmp_path):
    for k, (data, _) in CASES.items():
        (tmp_path / f"{k}.mp4").write_bytes(data or b"\0")
    by = {r.file.rsplit("/", 1)[1][:-4].replace("%20", " "): r for r in camera.read_locations(spark, str(tmp_path)).collect()}
    assert set(by) == set(CASES)
    for k, (_, want) in CASES.items():
        if k != "short":
            assert ((by[k].lat, by[k].lon, by[k].elevation) if by[k].lat is not None else None) == want and (want is not None or by[k].problem)
    table = spark.createDataFrame([(k, d) for k, (d, _) in CASES.items()] + [("null", None)], "file string, content binary")
    rows = {r.file: r for r in camera.locations(table).collect()}
    assert rows["null"].problem == "no position" and all(tuple(rows[k])[1:] == tuple(by[k])[1:] for k in CASES if k != "empty")
