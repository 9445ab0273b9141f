"""Geometry of damage masks from pixels: area, sharpness of the edge, contrast and compactness, of given masks or of boxes in frames.

A raster is one row (height, width, channels, pixels): row by row, one byte a pixel or three in the order blue, green, red. Rasters are
handled in Arrow batches, an image at a time, by array operations; what depends on the whole image (the outer border) is followed once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import scoring

#: Bytes of a batch of rasters sent to a worker, about.
BATCH_BYTES = "16m"
#: Most pixels of an image that is decoded; a larger one is a problem of its file.
MOST_PIXELS = 1 << 28

# Side of the square that a mask is grown and shrunk by, times it is shrunk, margin around a box, least side of a crop,
# and the shares of dark pixels between which a threshold is believed.
SIDE, SHRINKS, MARGIN, LEAST_SIDE, DARK_SHARES = 5, 2, 4, 6, (0.02, 0.90)

FIGURES = "surface_area_px long, edge_sharpness double, interior_contrast double, mask_compactness double"


# ---------------------------------------------------------------- kernels


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of blue, green and red by rounded whole numbers; a single channel as it is."""
    if image.ndim == 2:
        return image.astype(np.int64)
    b, g, r = (image[..., i].astype(np.int64) for i in range(3))
    return (1868 * b + 9617 * g + 4899 * r + (1 << 13)) >> 14


def sobel(g: np.ndarray) -> np.ndarray:
    """Magnitude of the gradient by 3 x 3 Sobel kernels, the image mirrored at its border without repeating it."""
    p = np.pad(g, [(1, 1) if n > 1 else (0, 0) for n in g.shape], "reflect")
    p = np.pad(p, [(0, 0) if n > 1 else (1, 1) for n in g.shape], "edge")  # an image one pixel wide has nothing to mirror
    smooth_down, smooth_right = p[:-2] + 2 * p[1:-1] + p[2:], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    x, y = smooth_down[:, 2:] - smooth_down[:, :-2], smooth_right[2:] - smooth_right[:-2]
    return np.sqrt((x * x + y * y).astype(np.float64))


def _spread(mask: np.ndarray, reach: int) -> np.ndarray:
    """True where a true pixel lies in the square of this reach; nothing lies beyond the border."""
    for axis in (0, 1):
        total = np.cumsum(np.pad(mask.astype(np.int64), [(reach + 1, reach) if a == axis else (0, 0) for a in (0, 1)]), axis=axis)
        n = mask.shape[axis]
        mask = np.take(total, np.arange(n) + 2 * reach + 1, axis) > np.take(total, np.arange(n), axis)
    return mask


def grown(mask: np.ndarray) -> np.ndarray:
    return _spread(mask, SIDE // 2)


def shrunk(mask: np.ndarray) -> np.ndarray:
    """Shrunk by the square SHRINKS times; what lies beyond the border takes nothing away."""
    return ~_spread(~mask, SIDE // 2 * SHRINKS)


def threshold(g: np.ndarray) -> int:
    """Otsu's threshold: of the values t that part the pixels into those up to t and those above, the first with the greatest variance between."""
    counts = np.bincount(g.ravel(), minlength=256)
    n1, s1 = np.cumsum(counts)[:-1], np.cumsum(counts * np.arange(256))[:-1]
    n, s = int(counts.sum()), int((counts * np.arange(256)).sum())
    apart = (n * s1 - n1 * s).astype(np.float64)
    both = (n1 * (n - n1)).astype(np.float64)
    return int(np.argmax(np.where(both > 0, apart * apart / np.maximum(both, 1), -1.0))) if both.any() else 0


def dark(g: np.ndarray) -> np.ndarray:
    """The darker side of the threshold, as damage reads darker than intact road; all of it if that is next to nothing or nearly all."""
    mask = g <= threshold(g)
    return mask if DARK_SHARES[0] <= mask.mean() <= DARK_SHARES[1] else np.ones_like(mask)


def _outside(mask: np.ndarray) -> np.ndarray:
    """Background that reaches the frame by steps along rows and columns, with a border of one around the image: lines are swept until none changes."""
    free = np.pad(~mask, 1, constant_values=True)
    out = np.zeros_like(free)
    out[0] = out[-1] = True
    out[:, 0] = out[:, -1] = True
    while True:
        before = int(out.sum())
        for axis in (1, 0):
            a, f = (out, free) if axis else (out.T, free.T)
            run = np.cumsum(np.pad(~f, ((0, 0), (1, 0)))[:, :-1] | ~f, axis=1) + np.arange(len(f))[:, None] * (f.shape[1] + 1)  # a number for each run of free pixels
            hit = np.unique(run[a & f])
            a |= f & np.isin(run, hit)
        if int(out.sum()) == before:
            return out


#: The eight neighbours in the order of the clock, from the left.
_ROUND = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def perimeter(mask: np.ndarray) -> float:
    """Length of the outer borders of the mask's outermost parts (joined over corners too), from pixel centre to pixel centre."""
    if not mask.any():
        return 0.0
    outside = _outside(mask)
    wide = mask.shape[1] + 2
    held = np.pad(mask, 1).ravel().tolist()
    offsets = [dy * wide + dx for dy, dx in _ROUND]
    begins = np.nonzero(np.pad(mask, 1).ravel()[1:] & outside.ravel()[:-1])[0] + 1
    seen: set[int] = set()
    straight = slanted = 0
    for start in begins.tolist():
        if start in seen:
            continue
        first = next((d for d in range(8) if held[start + offsets[d]]), None)
        seen.add(start)
        if first is None:
            continue
        # round the border against the clock, each time from the neighbour that the last step came from
        end, at, back = start + offsets[first], start, first
        while True:
            step = next(d for d in ((back - k) % 8 for k in range(1, 9)) if held[at + offsets[d]])
            straight, slanted = straight + (step % 2 == 0), slanted + step % 2
            to = at + offsets[step]
            if to == start and at == end:
                break
            at, back = to, (step + 4) % 8
            seen.add(at)
    return straight + slanted * math.sqrt(2)


def compactness(mask: np.ndarray) -> float:
    """4 pi area over the square of the perimeter; 0 without one."""
    p = perimeter(mask)
    return 4 * math.pi * int(mask.sum()) / (p * p) if p else 0.0


def _mean(values: np.ndarray, where: np.ndarray) -> float:
    return float(values[where].sum() / where.sum())


def _rounded(digits: int | None, *values: float) -> tuple[float, ...]:
    return values if digits is None else tuple(round(x, digits) for x in values)


def of_mask(image: np.ndarray, mask: np.ndarray, digits: int | None = 4) -> tuple[int, float, float, float]:
    """Figures of a given mask: sharpness over the ring just outside, contrast between all of the mask and the ring just inside its edge."""
    g = grey(image)
    ring, rim = grown(mask) & ~mask, mask & ~shrunk(mask)
    sharp = _mean(sobel(g), ring) if ring.any() else 0.0
    contrast = abs(_mean(g, mask) - _mean(g, rim)) if rim.any() else 0.0
    return int(mask.sum()), *_rounded(digits, sharp, contrast, compactness(mask))


def of_box(image: np.ndarray, x1: float, y1: float, x2: float, y2: float, digits: int | None = 4) -> tuple[int, float, float, float, float]:
    """Figures of a box by the dark side of a threshold: contrast between the shrunk mask and the ring outside, compactness of at most 1, and
    the depth that stands in for a measured one. A crop too small to tell gives zeros."""
    height, width = image.shape[:2]
    left, top, right, bottom = max(0, int(x1) - MARGIN), max(0, int(y1) - MARGIN), min(width, int(x2) + MARGIN), min(height, int(y2) + MARGIN)
    if right - left < LEAST_SIDE or bottom - top < LEAST_SIDE:
        return 0, 0.0, 0.0, 0.0, 0.0
    g = grey(image[top:bottom, left:right])
    mask = dark(g)
    ring, core = grown(mask) & ~mask, shrunk(mask)
    sharp = _mean(sobel(g), ring) if ring.any() else 0.0
    contrast = abs(_mean(g, core) - _mean(g, ring)) if core.any() and ring.any() else 0.0
    compact, area = min(compactness(mask), 1.0), int(mask.sum())
    depth = min(area / max(height * width, 1), 1.0) * (0.5 + 0.5 * compact)
    return area, *_rounded(digits, sharp, contrast, compact, min(max(depth, 0.0), 1.0))


# ---------------------------------------------------------------- files


def _netpbm(data: bytes) -> np.ndarray:
    m = re.match(rb"P([56])((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)((?:\s+|#[^\n]*\n)+)(\d+)\s", data)
    if not m or int(m[7]) != 255:
        raise ValueError("not an 8-bit P5 or P6 image")
    width, height, n = int(m[3]), int(m[5]), 3 if m[1] == b"6" else 1
    _fits(width, height)
    x = np.frombuffer(data, np.uint8, width * height * n, m.end()).reshape(height, width, n)
    return x[..., ::-1] if n == 3 else x[..., 0]


def _fits(width: int, height: int) -> None:
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError("image size out of range")


def _png(data: bytes) -> np.ndarray:
    """PNG of 8 bits, grey or colour, with or without alpha (left out), not interlaced."""
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + size
    if head is None or len(head) < 13 or head[8] != 8 or head[9] not in (0, 2, 4, 6) or head[12]:
        raise ValueError("this kind of PNG is not read")
    width, height, n = int.from_bytes(head[:4]), int.from_bytes(head[4:8]), {0: 1, 2: 3, 4: 2, 6: 4}[head[9]]
    _fits(width, height)
    most = height * (width * n + 1)
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), most), np.uint8)
    if len(raw) < most:
        raise ValueError("image data ends early")
    raw, out = raw.reshape(height, width * n + 1), np.zeros((height, width, n), np.int64)
    above = np.zeros((width, n), np.int64)
    for y in range(height):
        line = raw[y, 1:].reshape(width, n).astype(np.int64)
        kind = raw[y, 0]
        if kind == 1:
            line = np.cumsum(line, axis=0) & 255
        elif kind == 2:
            line = (line + above) & 255
        elif kind in (3, 4):
            left = corner = np.zeros(n, np.int64)
            for x in range(width):
                if kind == 3:
                    guess = (left + above[x]) // 2
                else:
                    p = left + above[x] - corner
                    a, b, c = abs(p - left), abs(p - above[x]), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, above[x], corner))
                line[x] = left = (line[x] + guess) & 255
                corner = above[x]
        elif kind:
            raise ValueError("unknown line filter")
        out[y] = above = line
    x = out.astype(np.uint8)
    return x[..., 0] if n < 3 else x[..., 2::-1]


def decoded(data: bytes) -> np.ndarray:
    """(height, width) grey or (height, width, 3) blue, green, red of a PNG or a binary PGM or PPM; ValueError for anything else."""
    try:
        return _png(data) if data[:8] == b"\x89PNG\r\n\x1a\n" else _netpbm(data)
    except (zlib.error, IndexError) as e:
        raise ValueError(str(e)) from e


RASTER = "height int, width int, channels int, pixels binary"


def _mapped(df: DataFrame, run, schema: str) -> DataFrame:
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(file, height, width, channels, pixels, problem) of image files; what cannot be read has its problem and nulls. Spark
    leaves out empty files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {"file": batch.column(0)[i].as_py(), "height": None, "width": None, "channels": None, "pixels": None, "problem": None}
                try:
                    image = decoded(batch.column(1)[i].as_py() or b"")
                    row |= {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2] if image.ndim == 3 else 1, "pixels": image.tobytes()}
                except ValueError as e:
                    row["problem"] = str(e)[:200]
                yield pa.RecordBatch.from_pylist([row], pa.schema([("file", pa.string()), *((c, pa.int32()) for c in ("height", "width", "channels")), ("pixels", pa.binary()), ("problem", pa.string())]))

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return _mapped(files, run, f"file string, {RASTER}, problem string")


def _image(height: int, width: int, channels: int, pixels: bytes) -> np.ndarray | None:
    if not (height and width and pixels is not None and len(pixels) == height * width * channels and channels in (1, 3)):
        return None
    x = np.frombuffer(pixels, np.uint8).reshape(height, width, channels)
    return x[..., 0] if channels == 1 else x


# ---------------------------------------------------------------- tables


def mask_geometry(rasters: DataFrame, key: str = "image_id", digits: int | None = 4) -> DataFrame:
    """(key, surface_area_px, edge_sharpness, interior_contrast, mask_compactness) of rasters (key, height, width, channels, pixels, mask), mask a
    byte a pixel, set if over 127. An empty mask gives zeros; a raster whose sizes do not agree, or without mask, nulls."""
    kind = rasters.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for height, width, channels, pixels, mask in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
                image = _image(height, width, channels, pixels)
                ok = image is not None and mask is not None and len(mask) == height * width
                rows.append(of_mask(image, np.frombuffer(mask, np.uint8).reshape(height, width) > 127, digits) if ok else (None,) * 4)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], [key, *(c.split()[0] for c in FIGURES.split(", "))])

    return _mapped(rasters.select(key, "height", "width", "channels", "pixels", "mask"), run, f"{key} {kind}, {FIGURES}")


def box_geometry(frames: DataFrame, boxes: DataFrame, frame: str = "frame_id", key: str = "box_id", digits: int | None = 4) -> DataFrame:
    """The figures, depth_proxy, severity_score and severity_level of boxes (frame, key, class_name, x1, y1, x2, y2) in frames (frame, height,
    width, channels, pixels): a row for each box whose frame is there, with nulls where the raster cannot be used.

    A frame is sent once with all its boxes, so its pixels are not repeated for each of them.
    """
    by = boxes.groupBy(frame).agg(F.sort_array(F.collect_list(F.struct(key, "class_name", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2"))))).alias("boxes"))
    both = frames.select(frame, "height", "width", "channels", "pixels").join(by, frame)
    kinds = {c: t.schema[c].dataType.simpleString() for c, t in ((frame, frames), (key, boxes))}
    names = [frame, key, "class_name", *(c.split()[0] for c in FIGURES.split(", ")), "depth_proxy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, classes, rows = [], [], [], []
            for i, (height, width, channels, pixels, own) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True)):
                image = _image(height, width, channels, pixels)
                for b in own:
                    sides = [b[c] for c in ("x1", "y1", "x2", "y2")]
                    ok = image is not None and all(s is not None and math.isfinite(s) for s in sides)
                    at.append(i)
                    keys.append(b[key])
                    classes.append(b["class_name"])
                    rows.append(of_box(image, *sides, digits) if ok else (None,) * 5)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            ids = pa.array(keys, batch.schema.field("boxes").type.value_type.field(key).type)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), ids, pa.array(classes, pa.string()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.float64()) for c in columns[1:])], names)

    out = _mapped(both, run, f"{frame} {kinds[frame]}, {key} {kinds[key]}, class_name string, {FIGURES}, depth_proxy double")
    raw = scoring.raw_score(F.col("class_name"), F.col("depth_proxy"), F.col("surface_area_px"), F.col("interior_contrast"), F.col("edge_sharpness"))
    score = F.when(F.col("surface_area_px").isNotNull(), scoring.severity_score(raw, F.col("class_name")))
    return out.withColumn("severity_score", score).withColumn("severity_level", F.when(F.col("severity_score").isNotNull(), scoring.level(F.col("severity_score"))))
