"""Positions that cameras write into their recordings: telemetry of nested records, marked blocks, and location boxes."""

from __future__ import annotations

import datetime as dt
import math
import re
import struct
from collections.abc import Callable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Containers within containers that are followed.
MOST_DEEP = 16
_UTC = dt.timezone.utc


def in_range(lat: float, lon: float) -> bool:
    return -90 <= lat <= 90 and -180 <= lon <= 180 and not lat == lon == 0


# ---------------------------------------------------------------- nested records: name (4), type (1), size (1), repeats (2), payload in fours

# Number types by the letter of a record, big-endian; divisors where a stream names none; the letters of times.
NUMBERS = {"b": "i1", "B": "u1", "s": ">i2", "S": ">u2", "l": ">i4", "L": ">u4", "f": ">f4", "d": ">f8", "j": ">i8", "J": ">u8"}
DIVISORS = (1e7, 1e7, 1000.0)
TIME_FORMS = (("%y%m%d%H%M%S.%f", 16), ("%y%m%d%H%M%S", 12))
STREAM, SCALE, TIME, FIXES = b"STRM", b"SCAL", b"GPSU", (b"GPS5", b"GPS9")


class Record(NamedTuple):
    name: bytes
    kind: int
    size: int
    repeats: int
    payload: memoryview
    short: bool


def records(data: memoryview) -> Iterator[Record]:
    """The records side by side in data; one whose payload ends early is marked, and fewer than 8 bytes at the end are none."""
    at = 0
    while at + 8 <= len(data):
        size, repeats = data[at + 5], int.from_bytes(data[at + 6 : at + 8])
        long = size * repeats
        yield Record(bytes(data[at : at + 4]), data[at + 4], size, repeats, data[at + 8 : at + 8 + long], at + 8 + long > len(data))
        at += 8 + -(-long // 4) * 4


def _numbers(r: Record) -> list[float] | None:
    kind = NUMBERS.get(chr(r.kind))
    if not kind:
        return None
    width = np.dtype(kind).itemsize
    return np.frombuffer(r.payload[: len(r.payload) // width * width], kind).astype(np.float64).tolist()


def _time(r: Record) -> dt.datetime | None:
    text = bytes(r.payload).decode("ascii", "ignore").strip("\0")
    for form, size in TIME_FORMS:
        try:
            return dt.datetime.strptime(text[:size], form).replace(tzinfo=_UTC)
        except ValueError:
            continue
    return None


def telemetry(data: bytes) -> tuple[list[tuple], list[str]]:
    """Fixes (lat, lon, elevation, time, speed) of nested records in order, and what was wrong with them.

    A stream's divisors hold within it and what it contains, and are forgotten after it; a time holds until the next one. Fixes out of range
    or at 0, 0 are dropped. Of a record that ends early its whole samples are read.
    """
    out: list[tuple] = []
    wrong: list[str] = []
    # containers being read, with the state each of them writes its divisors to; the time is one for all
    todo: list[tuple[Iterator[Record], dict]] = [(records(memoryview(data)), {"scale": None})]
    time = None
    while todo:
        walk, state = todo[-1]
        r = next(walk, None)
        if r is None:
            todo.pop()
            continue
        name = r.name.decode("latin-1")
        if r.short:
            wrong.append(f"{name} ends early")
        if r.kind == 0:
            if len(todo) > MOST_DEEP:
                wrong.append(f"{name} is nested too deep")
            else:
                todo.append((records(r.payload), {"scale": None} if r.name == STREAM else state))
        elif r.name == SCALE:
            state["scale"] = _numbers(r)
        elif r.name == TIME:
            time = _time(r) or time
        elif r.name in FIXES and r.size >= 8:
            n, width = min(r.repeats, len(r.payload) // r.size), r.size // 4
            raw = np.frombuffer(r.payload[: n * r.size], np.uint8).reshape(n, r.size)[:, : width * 4].copy().view(">i4").astype(np.float64)
            for i in range(min(width, 4)):
                own = state["scale"]
                by = (own[i] if i < len(own) else own[0]) if own else DIVISORS[min(i, 2)]
                raw[:, i] /= by or 1.0
            for v in raw.tolist():
                if in_range(v[0], v[1]):
                    out.append((v[0], v[1], v[2] if width > 2 else None, time, v[3] if r.name == FIXES[0] and width > 3 else None))
    return out, wrong


_TRACK = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("elevation", pa.float64()), ("time", pa.timestamp("us", "UTC")), ("speed_mps", pa.float64()), ("problem", pa.string())])
TRACK = "file string, seq long, lat double, lon double, elevation double, time timestamp, speed_mps double, problem string"


def _track(file: str, fixes: list[tuple], problems: list[str]) -> pa.RecordBatch:
    rows = [(file, i, *f, None) for i, f in enumerate(fixes)] + [(file, None, None, None, None, None, None, p) for p in problems]
    return pa.RecordBatch.from_pylist([dict(zip(_TRACK.names, r, strict=True)) for r in rows], _TRACK)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


#: Rows that leave a task together, about: a batch for each small file costs more than the file.
TOGETHER = 10_000


def gathered(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with small batches joined."""
    held, rows = [], 0
    for part in parts:
        held.append(part)
        rows += part.num_rows
        if rows >= TOGETHER or len(held) >= TOGETHER:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def telemetry_points(files: DataFrame) -> DataFrame:
    """(file, seq, lat, lon, elevation, time, speed_mps, problem) of telemetry (file, content): a row for each fix in order, and a row with
    nothing but the problem for each record that ends early or lies too deep. Null and empty contents give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered(_track(file, *telemetry(content or b"")) for file, content in _contents(batches))

    return files.select(F.col("file").cast("string"), F.col("content").cast("binary")).mapInArrow(run, TRACK)


def read_telemetry(spark: SparkSession, path: str) -> DataFrame:
    """telemetry_points() of files that hold a telemetry track."""
    return telemetry_points(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


# ---------------------------------------------------------------- marked blocks anywhere in a recording

# What a block begins with, its length, metres a second of a knot, greatest degrees and minutes, and most knots.
MARK, BLOCK, KNOT, MOST_DEGREES, MOST_KNOTS = b"freeGPS ", 256, 0.514444, 18_000.0, 200.0
_ACTIVE = re.compile(rb"A[NS][EW]")


def _degrees(x: float, hemisphere: int) -> float | None:
    """ddmm.mmmm as signed degrees."""
    if math.isnan(x) or abs(x) > MOST_DEGREES:
        return None
    whole = abs(x) // 100
    return (whole + (abs(x) - whole * 100) / 60) * (-1 if hemisphere in b"SW" else 1)


def block_fix(block: bytes) -> tuple | None:
    """The first fix (lat, lon, elevation, time, speed) in a block: an A with the hemispheres, then three little-endian floats; six whole
    numbers before it are the time, if they can be one. The order in which cameras write the rest is left open."""
    for m in _ACTIVE.finditer(block, 0, len(block) - 14):
        at = m.start()
        lat, lon, speed = struct.unpack_from("<3f", block, at + 3)
        lat, lon = _degrees(lat, block[at + 1]), _degrees(lon, block[at + 2])
        if lat is None or lon is None or not in_range(lat, lon):
            continue
        time = None
        if at >= 24:
            hour, minute, second, year, month, day = struct.unpack_from("<6I", block, at - 24)
            try:
                time = dt.datetime(2000 + year % 100, month, day, hour, minute, second, tzinfo=_UTC)
            except (ValueError, OverflowError):
                time = None
        return lat, lon, None, time, speed * KNOT if 0 <= speed < MOST_KNOTS else None
    return None


def read_marked_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, line, lat, lon, elevation, time, speed_mps) of the marked blocks of recordings of any size; split and line are their order.

    The marker is taken as the end of a line: Spark cuts a file into splits, and its line reader finds a marker that lies across a cut in one
    of them only. So no file is held at once, but what lies between two markers; a recording without any is one line, which a task
    must hold. Blocks without a fix give no rows, nor does what stands before the first marker.
    """
    lines = spark.read.option("lineSep", MARK.decode()).text(path)
    block = F.concat(F.lit(MARK), F.substring(F.col("value").cast("binary"), 1, BLOCK - len(MARK)))
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), block.alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = []
            for i, (file, split, b) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True)):
                head = split == 0 and (file, split) != last
                last = file, split
                if not head and (f := block_fix(b)):
                    found.append((i, f))
            at = pa.array([i for i, _ in found], pa.int64())
            columns = list(zip(*(f for _, f in found), strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(c, k.type) for c, k in zip(columns, list(_TRACK)[2:7], strict=True))], ["file", "split", "line", *_TRACK.names[2:7]])

    return rows.mapInArrow(run, "file string, split long, line long, lat double, lon double, elevation double, time timestamp, speed_mps double")


# ---------------------------------------------------------------- a location box in a recording

# Boxes that hold boxes, the box of a location, and the forms of a location.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta")
LOCATION = b"\xa9xyz"
POSITION = re.compile(rb"([+-]\d{1,3}(?:\.\d+)?)([+-]\d{1,3}(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?")
LOOSE = re.compile(rb"[+-]\d{1,2}\.\d+[+-]\d{1,3}\.\d+")
#: Bytes of a box that are searched for a loose position; longer boxes are read in pieces that overlap.
PIECE = 1 << 20
MOST_BOXES = 6


class Box(NamedTuple):
    name: bytes
    start: int
    size: int


def boxes(read: Callable[[int, int], bytes], start: int, end: int, problems: list[str]) -> Iterator[Box]:
    """The boxes between two places of a file, payloads only; reads 16 bytes of each and goes on behind it."""
    at = start
    while at + 8 <= end:
        head = read(at, 16)
        size, name, skip = int.from_bytes(head[:4]), head[4:8], 8
        if size == 1:
            if len(head) < 16:
                problems.append("a box ends early")
                return
            size, skip = int.from_bytes(head[8:16]), 16
        elif size == 0:
            size = end - at
        if size < skip:
            problems.append(f"a box {name.decode('latin-1')} of {size} bytes")
            return
        if at + size > end:
            problems.append(f"box {name.decode('latin-1')} ends early")
            size = end - at
        yield Box(name, at + skip, size - skip)
        at += size


def location(read: Callable[[int, int], bytes], size: int) -> tuple[tuple | None, list[str]]:
    """(lat, lon, elevation) of a recording by its location box, else by a loose position in its user data; and what was wrong with its boxes.

    read(at, n) gives n bytes from there. Of media only the headers of their boxes are read.
    """
    problems: list[str] = []
    todo, users, text = [(0, size, 0)], [], None
    while todo and text is None:
        start, end, deep = todo.pop()
        for b in boxes(read, start, end, problems):
            if b.name == LOCATION:
                head = read(b.start, 4)
                text = read(b.start + 4, min(int.from_bytes(head[:2]), max(b.size - 4, 0)))
                break
            if b.name == b"udta":
                users.append(b)
            if b.name in CONTAINERS:
                if deep + 1 < MOST_BOXES:
                    todo.append((b.start, b.start + b.size, deep + 1))
                else:
                    problems.append(f"box {b.name.decode('latin-1')} is nested too deep")
    for b in users if not text else ():
        for at in range(b.start, b.start + b.size, PIECE):
            if m := LOOSE.search(read(at, min(PIECE + 64, b.start + b.size - at))):
                text = m[0]
                break
    m = POSITION.search(text) if text else None
    if not m:
        return None, problems
    lat, lon, high = float(m[1]), float(m[2]), float(m[3]) if m[3] else None
    return ((lat, lon, high), problems) if in_range(lat, lon) else (None, [*problems, "position out of range"])


_PLACE = pa.schema([("file", pa.string()), ("lat", pa.float64()), ("lon", pa.float64()), ("elevation", pa.float64()), ("problem", pa.string())])
PLACE = "file string, lat double, lon double, elevation double, problem string"


def _place(file: str, read: Callable[[int, int], bytes], size: int) -> tuple:
    found, problems = location(read, size)
    return (file, *(found or (None,) * 3), "; ".join(problems) or (None if found else "no position"))


def _together(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, TOGETHER)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some, strict=True), _PLACE, strict=True)], schema=_PLACE)


def locations(files: DataFrame) -> DataFrame:
    """(file, lat, lon, elevation, problem) of recordings (file, content): a row each; nulls with a problem where there is no position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for file, content in _contents(batches):
                content = content or b""
                yield _place(file, lambda at, n, held=content: held[at : at + n], len(content))

        return _together(rows())

    return files.select(F.col("file").cast("string"), F.col("content").cast("binary")).mapInArrow(run, PLACE)


#: Stores in which a task can read a part of a file by itself.
SEEKABLE = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """locations() of files. Where the store is one of SEEKABLE, only the headers of boxes and the user data are read; else whole files are, by
    Spark's reader."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.regexp_extract("path", r"^(\w+):", 1).alias("scheme"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    store, name = (pafs.LocalFileSystem(), re.sub(r"^file:/+", "/", file)) if file.startswith("file:") else pafs.FileSystem.from_uri(file)
                    with store.open_input_file(name) as held:
                        yield _place(file, lambda at, n, held=held: held.read_at(n, at), size)

        return _together(rows())

    sought = files.where(F.col("scheme").isin(*SEEKABLE)).select("path", "length").mapInArrow(run, PLACE)
    whole = spark.read.format("binaryFile").load(path).where(~F.regexp_extract("path", r"^(\w+):", 1).isin(*SEEKABLE))
    return sought.unionByName(locations(whole.select(F.col("path").alias("file"), "content")))
