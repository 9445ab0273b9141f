"""Pixel kernels against loops over single pixels, image files against an encoder, and the tables."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerbline.operators import pixels


def mirrored(i, n):
    return i if n == 1 and i == 0 else (0 if n == 1 else -i if i < 0 else 2 * (n - 1) - i if i >= n else i)


def slow_sobel(g):
    h, w = g.shape
    out = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            at = lambda dy, dx: int(g[mirrored(y + dy, h), mirrored(x + dx, w)])  # noqa: E731, B023
            gx = sum(k * (at(dy, 1) - at(dy, -1)) for dy, k in ((-1, 1), (0, 2), (1, 1)))
            gy = sum(k * (at(1, dx) - at(-1, dx)) for dx, k in ((-1, 1), (0, 2), (1, 1)))
            out[y, x] = math.hypot(gx, gy)
    return out


def near(mask, y, x, reach):
    h, w = mask.shape
    return [mask[j, i] for j in range(max(0, y - reach), min(h, y + reach + 1)) for i in range(max(0, x - reach), min(w, x + reach + 1))]


def slow_grown(mask):
    return np.array([[any(near(mask, y, x, 2)) for x in range(mask.shape[1])] for y in range(mask.shape[0])])


def slow_shrunk(mask, times=2):
    for _ in range(times):
        mask = np.array([[all(near(mask, y, x, 2)) for x in range(mask.shape[1])] for y in range(mask.shape[0])])
    return mask


def slow_threshold(g):
    best, at, v = -1.0, 0, [int(x) for x in g.ravel()]
    for t in range(255):
        low, high = [x for x in v if x <= t], [x for x in v if x > t]
        if low and high:
            apart = float(len(v) * sum(low) - len(low) * sum(v))
            x = apart * apart / float(len(low) * len(high))
            if x > best:
                best, at = x, t
    return at


def slow_perimeter(mask):
    """Each outermost part by flood fill; its border by a walker that keeps the background on its right hand and counts its steps, told apart
    by pixel and heading."""
    h, w = mask.shape
    on = lambda y, x: 0 <= y < h and 0 <= x < w and bool(mask[y, x])
    outside, todo = set(), [(-1, -1)]
    while todo:
        p = todo.pop()
        if p in outside or not (-1 <= p[0] <= h and -1 <= p[1] <= w) or on(*p):
            continue
        outside.add(p)
        todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    done, total = set(), 0.0
    heads = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]  # by the clock, from the right
    for y in range(h):
        for x in range(w):
            if not on(y, x) or (y, x) in done:
                continue
            part, todo = set(), [(y, x)]
            while todo:
                p = todo.pop()
                if p not in part and on(*p):
                    part.add(p)
                    todo += [(p[0] + a, p[1] + b) for a, b in heads]
            done |= part
            if (y, x - 1) not in outside or len(part) == 1:
                continue
            # states (pixel, heading); the walk turns as far to one side as it can and ends when a state comes again
            at, head, length, seen = (y, x), 0, 0.0, {}
            while (at, head) not in seen:
                seen[at, head] = length
                for k in range(8):
                    d = (head + 5 + k) % 8  # from behind to the left, on by the clock
                    if on(at[0] + heads[d][0], at[1] + heads[d][1]):
                        break
                at, head, length = (at[0] + heads[d][0], at[1] + heads[d][1]), d, length + (math.sqrt(2) if d % 2 else 1.0)
            total += length - seen[at, head]
    return total


images = st.integers(0, 1 << 30).map(lambda s: np.random.default_rng(s)).map(lambda r: (r.integers(0, 256, (int(r.integers(1, 14)), int(r.integers(1, 14)))), r))


@settings(max_examples=60, deadline=None)
@given(images)
def test_kernels_follow_loops(made):
    g, rng = made
    mask = rng.random(g.shape) < rng.choice([0.1, 0.4, 0.7, 0.95])
    assert np.allclose(pixels.sobel(g), slow_sobel(g))
    assert (pixels.grown(mask) == slow_grown(mask)).all() and (pixels.shrunk(mask) == slow_shrunk(mask)).all()
    assert pixels.threshold(g) == slow_threshold(g)
    assert pixels.perimeter(mask) == pytest.approx(slow_perimeter(mask))


def test_perimeters_of_known_shapes():
    def of(*lines):
        return pixels.perimeter(np.array([[c == "#" for c in x] for x in lines]))

    assert of("....", ".##.", ".##.") == 4 and of("#") == 0 and of("####") == 6 and of("..", "..") == 0
    assert of("#..", ".#.", "..#") == pytest.approx(4 * math.sqrt(2))
    assert of("#####", "#...#", "#.#.#", "#...#", "#####") == 16  # neither hole nor island
    assert of("##.##", "##.##") == 8


def test_figures_by_hand():
    image = np.full((20, 20), 200, np.uint8)
    image[6:14, 6:14] = 40
    mask = image < 100
    area, sharp, contrast, compact = pixels.of_mask(image, mask)
    assert area == 64 and contrast == 0 and compact == round(4 * math.pi * 64 / 28**2, 4) and sharp > 100
    got = pixels.of_box(image, 6, 6, 14, 14)
    assert got[0] == 64 and got[2] == 0.0 and got[3] == 1.0 and got[4] == round(64 / 400 * 1.0, 4)  # nothing is left of 8 x 8 after two shrinks
    image[4:18, 4:18] = 40
    assert pixels.of_box(image, 4, 4, 18, 18)[2] == 160
    assert pixels.of_box(image, 3, 3, 3, 3)[0] > 0 and pixels.of_box(image, -9, 0, -8, 1) == (0, 0.0, 0.0, 0.0, 0.0)


def png(x, filters):
    """An encoder with the line filter of choice."""
    h, w = x.shape[:2]
    n = 1 if x.ndim == 2 else x.shape[2]
    rows = x.reshape(h, w * n).astype(int)
    body = b""
    for y in range(h):
        f, up = filters[y % len(filters)], rows[y - 1] if y else np.zeros(w * n, int)
        left, corner = np.append(np.zeros(n, int), rows[y])[: w * n], np.append(np.zeros(n, int), up)[: w * n]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        guess = [0 * up, left, up, (left + up) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))][f]
        body += bytes([f]) + ((rows[y] - guess) % 256).astype(np.uint8).tobytes()
    chunk = lambda k, d: len(d).to_bytes(4) + k + d + zlib.crc32(k + d).to_bytes(4)
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    packed = zlib.compress(body)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4) + h.to_bytes(4) + bytes([8, kind, 0, 0, 0])) + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_round_trip(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 256, (11, 7, n) if n > 1 else (11, 7)).astype(np.uint8)
    got = pixels.decoded(png(x, [0, 1, 2, 3, 4]))
    assert (got == (x if n == 1 else x[..., 0] if n == 2 else x[..., 2::-1])).all()


def test_files_and_tables(spark, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (9, 8, 3)).astype(np.uint8)
    whole = png(x, [4])
    files = {"a.png": whole, "b.ppm": b"P6 # it\n8 9\n255\n" + x.tobytes(), "c.pgm": b"P5\n8 9 255\n" + x[..., 0].tobytes(), "d.png": whole[:60], "e.jpg": b"\xff\xd8", "f.ppm": b"P6 8 9 255\n", "g.ppm": b"x", "empty.ppm": b""}
    for k, v in files.items():
        (tmp_path / k).write_bytes(v)
    got = {r.file.rsplit("/", 1)[1]: r for r in pixels.read_rasters(spark, str(tmp_path)).collect()}
    assert bytes(got["a.png"].pixels) == bytes(got["b.ppm"].pixels) == x[..., ::-1].tobytes() and got["c.pgm"].channels == 1
    assert all(got[k].problem and got[k].pixels is None for k in ("d.png", "e.jpg", "f.ppm", "g.ppm"))
    mask = (x[..., 0] > 90).astype(np.uint8) * 255
    image = x[..., ::-1].copy()
    rows = [(1, 9, 8, 3, image.tobytes(), mask.tobytes()), (2, 9, 8, 3, image.tobytes(), bytes(72)), (3, 9, 8, 3, image.tobytes()[:-1], mask.tobytes()), (4, None, None, None, None, None), (None, 9, 8, 3, image.tobytes(), None)]
    table = spark.createDataFrame(rows, "image_id long, height int, width int, channels int, pixels binary, mask binary")
    by = {r.image_id: tuple(r)[1:] for r in pixels.mask_geometry(table).collect()}
    assert by[1] == pixels.of_mask(image, mask > 127) and by[2] == (0, 0.0, 0.0, 0.0) and by[3] == by[4] == by[None] == (None,) * 4
    boxes = spark.createDataFrame([(1, 1, "pothole", 0.0, 0.0, 8.0, 9.0), (1, 2, "rutting", None, 0.0, 8.0, 9.0), (3, 3, "pothole", 0.0, 0.0, 8.0, 9.0), (9, 4, "pothole", 0.0, 0.0, 8.0, 9.0)], "image_id long, box_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    got = {r.box_id: r for r in pixels.box_geometry(table, boxes, "image_id").collect()}
    assert set(got) == {1, 2, 3} and tuple(got[1])[3:8] == pixels.of_box(image, 0, 0, 8, 9) and got[1].severity_level[0] == "S" and got[2].severity_level is None and got[3].surface_area_px is None
    assert pixels.box_geometry(table, boxes.limit(0), "image_id").count() == 0 and pixels.mask_geometry(table.limit(0)).count() == 0
