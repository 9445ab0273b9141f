"""Tours over the stops of a work order: nearest neighbour, then 2-opt; and the ordered spatial upsert."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions import scoring
from kerbline.operators import folds
from kerbline.streaming.live import metres

#: Stops of a tour whose reversals look at all others, by a table of all distances (8 MB at most).
FEW = 1000
#: Nearest stops of each stop that a reversal looks at in longer tours. Memory is so many numbers a stop.
NEIGHBOURS = 24
#: Stops whose distances are computed at a time.
BLOCK = 256
#: Rows of a table of all distances that are computed at a time: some hundred kilobytes.
TABLE_ROWS = 32


class Stops:
    """Positions, and for each its nearest others with their distances in km."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, k: int = NEIGHBOURS):
        self.y, self.x, self.cos = np.radians(lat), np.radians(lon), np.cos(np.radians(lat))
        self.n = len(lat)
        self.k = min(k, self.n - 1)
        self.near, self.far = np.empty((self.n, self.k), np.int64), np.empty((self.n, self.k))
        if self.k > 0:
            self._find()

    def km(self, i, j) -> np.ndarray:
        a = np.sin((self.y[i] - self.y[j]) / 2) ** 2 + self.cos[i] * self.cos[j] * np.sin((self.x[i] - self.x[j]) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, a)))

    def table(self) -> np.ndarray:
        """All distances; each pair is computed once, as both ways give the same number."""
        d = np.empty((self.n, self.n))
        for at in range(0, self.n, TABLE_ROWS):
            own = np.arange(at, min(at + TABLE_ROWS, self.n))
            d[at : at + TABLE_ROWS, at:] = self.km(own[:, None], slice(at, None))
            d[at:, at : at + TABLE_ROWS] = d[at : at + TABLE_ROWS, at:].T
        return d

    def _find(self) -> None:
        """Block by block of stops in the order of latitude: others are sought in a band that is widened until all that lie outside are farther."""
        by = np.argsort(self.y, kind="stable")
        y = self.y[by]
        band = max((y[-1] - y[0]) * self.k / self.n, 1e-9)
        for at in range(0, self.n, BLOCK):
            own = by[at : at + BLOCK]
            low, high = y[at], y[min(at + BLOCK, self.n) - 1]
            while True:
                i, j = np.searchsorted(y, low - band), np.searchsorted(y, high + band, "right")
                others = np.sort(by[i:j])  # so that a stable sort puts the first stop first among equally far ones
                d = self.km(own[:, None], others)
                d[own[:, None] == others] = np.inf
                if j - i > self.k:
                    order = np.argsort(d, axis=1, kind="stable")[:, : self.k] if j - i <= 4 * self.k else self._least(d)
                    far = np.take_along_axis(d, order, 1)
                    if j - i == self.n or far[:, -1].max() <= 6371.0 * band:
                        break
                band *= 2
            self.near[own], self.far[own] = others[order], far
            band /= 2

    def _least(self, d: np.ndarray) -> np.ndarray:
        """The columns of the k least of each row, in order, equal ones by column."""
        some = np.sort(np.argpartition(d, self.k - 1, axis=1)[:, : self.k], axis=1)
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def _nearest_first(s: Stops) -> np.ndarray:
    """Open tour from the first stop: the nearest unvisited each time, the first on ties."""
    order, left = np.zeros(s.n, np.int64), np.ones(s.n, bool)
    left[0] = False
    rest, gone = np.arange(1, s.n), 0
    for i in range(1, s.n):
        at = order[i - 1]
        free = left[s.near[at]]
        k = int(free.argmax()) if s.k else 0
        # a list holds all that is nearer than its last; of those as far as it, some may be missing
        if s.k and free[k] and (s.k == s.n - 1 or s.far[at, k] < s.far[at, -1]):
            to = s.near[at, k]
        else:
            if gone > len(rest) // 2:
                rest, gone = rest[left[rest]], 0
            d = s.km(at, rest)
            d[~left[rest]] = np.inf
            to = rest[int(np.argmin(d))]
        order[i] = to
        left[to] = False
        gone += 1
    return order


def _tour(lat: np.ndarray, lon: np.ndarray, passes: int | None) -> list[int]:
    """Open tour from the first stop: nearest unvisited each time (the first on ties), then reversals that shorten it, pass after pass."""
    return _tour_of_few(lat, lon, passes) if len(lat) <= FEW else _tour_by_lists(lat, lon, passes)


def _tour_of_few(lat: np.ndarray, lon: np.ndarray, passes: int | None) -> list[int]:
    """A reversal of the stops from b, which follows a, to c, which is followed by e, shortens the tour only if c is nearer to a than b is, or b
    nearer to e than c is. So each stop has a list of those nearer than the longer of its two legs, and only these are looked at."""
    n, s = len(lat), Stops(lat, lon, 0)
    d = s.table()
    order, gone, better = [0], np.zeros(n), n >= 4
    for _ in range(1, n):
        gone[order[-1]] = np.inf
        order.append(int(np.argmin(d[order[-1]] + gone)))
    place = np.argsort(order).tolist()
    km, leg = memoryview(d.ravel()), [0.0, *d[order[:-1], order[1:]].tolist(), 0.0]  # km: a table by rows; leg: from the stop before, by place
    longest = np.maximum(leg[:-1], leg[1:])
    nearer: list[list[int]] = [[] for _ in range(n)]
    nearer_to: list[list[int]] = [[] for _ in range(n)]  # the stops whose lists hold a stop
    for v, w in zip(*(x.tolist() for x in (d < longest[place][:, None]).nonzero()), strict=True):
        nearer[v].append(w)
        nearer_to[w].append(v)

    def enlist(at: int) -> None:
        v = order[at]
        now = (d[v] < max(leg[at], leg[at + 1])).nonzero()[0].tolist()
        before, nearer[v] = set(nearer[v]), now
        for w in before.difference(now):
            nearer_to[w].remove(v)
        for w in now:
            if w not in before:
                nearer_to[w].append(v)

    while better and passes != 0:
        better, passes = False, None if passes is None else passes - 1
        for i in range(1, n - 1):
            j = i + 1
            while j < n:  # the first end of a segment from i whose reversal shortens the tour, then on from there
                a, b, x, end = order[i - 1], order[i], leg[i], n
                from_a, from_b = a * n, b * n
                for c in nearer[a]:
                    if j <= (at := place[c]) < end and (k := km[from_a + c]) < x and x - k + (leg[at + 1] - km[from_b + order[at + 1]] if at < n - 1 else 0.0) > 1e-9:
                        end = at
                for e in nearer_to[b]:
                    if j < (at := place[e]) <= end and (k := km[from_b + e]) < leg[at] and x - km[from_a + order[at - 1]] + (leg[at] - k) > 1e-9:
                        end = at - 1
                if end == n:
                    break
                j = end
                order[i : j + 1] = order[i : j + 1][::-1]
                leg[i + 1 : j + 1] = leg[i + 1 : j + 1][::-1]
                for at in range(i, j + 1):
                    place[order[at]] = at
                leg[i] = km[order[i - 1] * n + order[i]]
                if j < n - 1:
                    leg[j + 1] = km[order[j] * n + order[j + 1]]
                for at in (i - 1, i, j, min(j + 1, n - 1)):
                    enlist(at)
                better, j = True, j + 1
    return order


def _tour_by_lists(lat: np.ndarray, lon: np.ndarray, passes: int | None, k: int = NEIGHBOURS) -> list[int]:
    """The same, but for what a reversal looks at; the same in all if lists hold all other stops.

    A segment that follows stop a and begins with b may be reversed if it ends with one of the nearest of a, or before one of the nearest
    of b. From the second pass on, only stops near an end of a segment reversed in the pass before are looked at, unless lists hold all stops.
    """
    n, s = len(lat), Stops(lat, lon, k)
    order = _nearest_first(s)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    look, better = np.ones(n, bool), n >= 4
    while better and passes != 0:
        better, passes = False, None if passes is None else passes - 1
        touched = np.zeros(n, bool)
        for i in range(1, n - 1):
            if not (look[order[i - 1]] or look[order[i]]):
                continue
            j = i + 1
            while j < n:  # the first end of a segment from i whose reversal shortens the tour, then on from there
                a, b = order[i - 1], order[i]
                ends = np.concatenate([place[s.near[a]], place[s.near[b]] - 1])
                ends = np.unique(ends[ends >= j])
                if not len(ends):
                    break
                last, after = order[ends], order[np.minimum(ends + 1, n - 1)]
                gain = s.km(a, b) - s.km(a, last) + np.where(ends < n - 1, s.km(last, after) - s.km(b, after), 0.0)
                at = int(np.argmax(gain > 1e-9))
                if gain[at] <= 1e-9:
                    break
                j = int(ends[at])
                touched[[a, b, order[j], order[min(j + 1, n - 1)]]] = True
                order[i : j + 1] = order[i : j + 1][::-1].copy()
                place[order[i : j + 1]] = np.arange(i, j + 1)
                better, j = True, j + 1
        if s.k < n - 1:
            look = touched.copy()
            look[s.near[touched]] = True
    return order.tolist()


def planned(stops: DataFrame, passes: int | None = None, speed_kmh: float = 25.0, stop_minutes: float = 20.0) -> DataFrame:
    """(order_id, stop_id, lat, lon) with stop_seq, leg_km and minutes so far: a tour of each work order's stops that have a position.

    Reversals go on until none of those looked at shortens the tour, or for so many passes. A work order is one task, and may have any number
    of stops: memory grows with them, not with their pairs.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("stop_id").reset_index(drop=True)
        out = pdf.iloc[_tour(pdf.lat.to_numpy(), pdf.lon.to_numpy(), passes)].reset_index(drop=True)
        y, x = out.lat.tolist(), out.lon.tolist()
        leg = [0.0] + [metres(*ends) / 1000 for ends in zip(y[:-1], x[:-1], y[1:], x[1:], strict=True)]
        out["stop_seq"], out["leg_km"] = np.arange(len(out)), leg
        out["minutes"] = np.cumsum(leg) / speed_kmh * 60 + stop_minutes * (np.arange(len(out)) + 1)
        return out[["order_id", "stop_id", "stop_seq", "leg_km", "minutes"]]

    # the rows are few bytes but much work: a fixed number of partitions, which adaptive execution does not merge
    parts = int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stops.where("lat is not null and lon is not null").select("order_id", "stop_id", "lat", "lon").repartition(parts, "order_id")
    return dealt.groupBy("order_id").applyInPandas(run, "order_id long, stop_id long, stop_seq long, leg_km double, minutes double")


def summaries(tours: DataFrame) -> DataFrame:
    """(order_id, stops, total_km, minutes) of planned(): minutes are whole."""
    return tours.groupBy("order_id").agg(F.count("*").alias("stops"), F.sum("leg_km").alias("total_km"), F.round(F.max("minutes")).cast("long").alias("minutes"))


CHANGES = "seq long, action string, id long, damage_type string, lat double, lon double, severity int, confidence double, crop string, first_day date, last_day date, detection_count int, rate double"


def upserts(sightings: DataFrame, reach: float = 2.0) -> DataFrame:
    """What each of (place, damage_type, seq, id, lat, lon, severity, confidence, crop, day), in the order of seq, did, and its defect then.

    A sighting meets the nearest defect of its class within reach, or makes one. place is a connected cluster of positions, so that
    each fold is exact; a task holds the defects of one place. A defect keeps its place and first day; the rest follows the sighting,
    the crop where it has one; the rate is the change of severity, in fifths a day since the first.
    """

    def step(held: list[dict], r) -> list[tuple]:
        at = min(((metres(f["lat"], f["lon"], r.lat, r.lon), i) for i, f in enumerate(held)), default=(np.inf, -1))
        if at[0] <= reach:
            action, f = "update", held[at[1]]
            days = max((r.day - f["first_day"]).days, 1)
            f["rate"] = round((r.severity / 5.0 - f["severity"] / 5.0) / days, 6)
            f["detection_count"] += 1
        else:
            action, f = "insert", {"id": r.id, "lat": r.lat, "lon": r.lon, "first_day": r.day, "detection_count": 1, "rate": None, "crop": None}
            held.append(f)
        f.update(severity=r.severity, confidence=r.confidence, last_day=r.day, crop=r.crop if r.crop is not None else f["crop"])
        return [(r.seq, action, f["id"], r.damage_type, f["lat"], f["lon"], f["severity"], f["confidence"], f["crop"], f["first_day"], f["last_day"], f["detection_count"], f["rate"])]

    rows = sightings.select("place", "damage_type", "seq", "id", "lat", "lon", "severity", "confidence", "crop", "day")
    return folds.folded(rows, ["damage_type", "place"], ["seq"], list, step, CHANGES)


def upserted(sightings: DataFrame, reach: float = 2.0) -> DataFrame:
    """The defects that upserts() leaves, with their priority."""
    names = [c.split()[0] for c in CHANGES.split(", ")[3:]]
    last = upserts(sightings, reach).groupBy("id").agg(F.max_by(F.struct(*names), "seq").alias("x")).select("id", "x.*")
    return last.withColumn("priority_score", scoring.priority_v1(F.col("severity"), F.col("detection_count")))
