"""Live reports: stateful clustering and validation of sightings and votes, rate limits, and windowed counts.

The state machine of one place is a small fold over its reports in order; batch and stream share it. Reports at most REACH apart
can meet in one event, so a place is a connected cluster of positions of one class (operators.spatial.clusters finds them in
batch): folding each place by itself is exact, and a busy class is split over its places. In batch a place is cut further where
nothing came for so long that all its events have expired.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kerbline.operators import folds, spatial
from kerbline.session import scratch_dir
from kerbline.vocab import EARTH_M

REACH = 25.0
TTL_S = 72 * 3600
CONFIRMED, VERIFIED, LEAST_DISPUTES = 2, 3, 2

CHANGES = "report_id long, place long, action string, supporters int, disputers int, status string"


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * math.asin(math.sqrt(min(1.0, a)))


def step(events: list[dict], kind: str, t: float, device: str, lat: float, lon: float, confidence: float, severity: int) -> tuple[str, dict | None]:
    """One report against the active events of its place; changes them and tells what it did."""
    events[:] = [e for e in events if e["expires"] >= t]
    near = min(((metres(e["lat"], e["lon"], lat, lon), i) for i, e in enumerate(events)), default=(math.inf, -1))
    event = events[near[1]] if near[0] <= REACH else None
    if kind == "sighting":
        action = "merged"
        if event is None:
            action, event = "created", {"lat": lat, "lon": lon, "yes": [], "no": [], "confidence": 0.0, "severity": 0}
            events.append(event)
        event["confidence"], event["severity"] = max(event["confidence"], confidence), max(event["severity"], severity)
        event["expires"] = t + TTL_S
        voters = event["yes"]
    elif event is None:
        return "rejected", None
    else:
        action, voters = ("confirmed", event["yes"]) if kind == "confirm" else ("disputed", event["no"])
        if kind == "confirm":
            event["expires"] = t + TTL_S
    if device not in voters:
        voters.append(device)
    if kind == "dispute" and len(event["no"]) >= max(LEAST_DISPUTES, len(event["yes"])):
        events.remove(event)
        action = "removed"
    return action, event


def status(supporters: int) -> str:
    return "verified" if supporters >= VERIFIED else "confirmed" if supporters >= CONFIRMED else "unverified"


def told(events: list[dict], r) -> tuple:
    action, e = step(events, r.kind, r.t, r.device_id, r.latitude, r.longitude, r.confidence, r.severity)
    yes, no = (len(e["yes"]), len(e["no"])) if e else (0, 0)
    return r.report_id, r.place, action, yes, no, status(yes)


def fold(events: list[dict], reports: pd.DataFrame) -> pd.DataFrame:
    rows = [told(events, r) for r in reports.sort_values(["t", "report_id"]).itertuples()]
    return pd.DataFrame(rows, columns=["report_id", "place", "action", "supporters", "disputers", "status"])


_COLUMNS = ["report_id", "place", "kind", "t", "device_id", "latitude", "longitude", "confidence", "severity"]


def placed(reports: DataFrame) -> DataFrame:
    """reports with `place`: the connected cluster of positions at most REACH apart, of one class (batch)."""
    at = spatial.clusters(reports.select("report_id", "latitude", "longitude"), REACH).select("report_id", "cluster_id")
    return reports.drop("place").join(at, "report_id").withColumn("place", F.xxhash64("cluster_id", "damage_type"))


def changelog(reports: DataFrame) -> DataFrame:
    """What each report did: created, merged, confirmed, disputed, removed, or rejected for want of an event."""
    cut = folds.sessions(reports.select(*_COLUMNS), ["place"], "t", ["t", "report_id"], TTL_S)
    return folds.folded(cut, ["place", "session"], ["t", "report_id"], list, lambda events, r: [told(events, r)], CHANGES)


def changelog_stream(reports: DataFrame) -> DataFrame:
    """The same on a stream: the active events of each place are kept as state, which a place gives up when its last event has expired by
    the watermark. Arrival order is the order within a batch; reports more than TTL_S late are dropped."""

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        events = json.loads(state.get[0]) if state.exists else []
        for part in parts:
            yield fold(events, part)
        if events:
            state.update((json.dumps(events),))
            state.setTimeoutTimestamp(max(int(max(e["expires"] for e in events) * 1000), state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()

    timed = reports.select(*_COLUMNS, F.timestamp_micros((F.col("t") * 1_000_000).cast("long")).alias("at")).withWatermark("at", f"{TTL_S} seconds")
    return timed.groupBy("place").applyInPandasWithState(run, CHANGES, "events string", "append", GroupStateTimeout.EventTimeTimeout)


def sweep(reports: DataFrame, changes: DataFrame, now: float) -> DataFrame:
    """(place, report_id, expired): the last report that each place's events were kept alive by, and whether that was too long ago at `now`."""
    alive = changes.where("action in ('created', 'merged', 'confirmed')").select("report_id", "place").join(reports.select("report_id", "t"), "report_id")
    last = alive.groupBy("place").agg(F.max(F.struct("t", "report_id")).alias("last"))
    return last.select("place", "last.report_id", (F.lit(now) - F.col("last.t") > TTL_S).alias("expired"))


def limited(hits: DataFrame, window_s: float, most: int, count_rejected: bool = True, lockout_s: float = 0.0) -> DataFrame:
    """Fixed-window rate limit by key over (key, hit_id, t): the first hit opens a window, and more than `most` in it are rejected.

    count_rejected: rejected hits count as well. With a lockout, the first rejection locks the key for that long.
    """

    def step(state: dict, r) -> list[tuple]:
        if r.t < state["locked"]:
            return [(r.key, r.hit_id, False)]
        if state["start"] is None or r.t - state["start"] > window_s:
            state.update(start=r.t, count=0)
        ok = state["count"] + 1 <= most
        state["count"] += ok or count_rejected
        if not ok and lockout_s:
            state.update(locked=r.t + lockout_s, start=None)
        return [(r.key, r.hit_id, ok)]

    return _by_key(hits.select("key", "hit_id", "t"), step, "key string, hit_id long, allowed boolean", window_s, lockout_s)


def locked_out(attempts: DataFrame, window_s: float, most: int, lockout_s: float) -> DataFrame:
    """Failed sign-ins by key over (key, hit_id, t, failed): (key, hit_id, refused, locks).

    The `most`-th failure within a window that the first one opened locks the key; while it is locked every attempt is refused and
    counts for nothing; a success clears the count.
    """

    def step(state: dict, r) -> list[tuple]:
        if r.t < state["locked"]:
            return [(r.key, r.hit_id, True, False)]
        if not r.failed:
            state.update(start=None, count=0)
            return [(r.key, r.hit_id, False, False)]
        if state["start"] is None or r.t - state["start"] > window_s:
            state.update(start=r.t, count=0)
        state["count"] += 1
        locks = state["count"] >= most
        if locks:
            state.update(locked=r.t + lockout_s, start=None, count=0)
        return [(r.key, r.hit_id, False, locks)]

    return _by_key(attempts.select("key", "hit_id", "t", "failed"), step, "key string, hit_id long, refused boolean, locks boolean", window_s, lockout_s)


def _by_key(rows: DataFrame, step, schema: str, window_s: float, lockout_s: float) -> DataFrame:
    """A fold of counters by key, over a table or a stream: no state matters once its window and its lock are over."""

    def start() -> dict:
        return {"start": None, "count": 0, "locked": -math.inf}

    def deadline(state: dict) -> float | None:
        ends = [state["locked"], *([] if state["start"] is None else [state["start"] + window_s])]
        return max(ends) if max(ends) > -math.inf else None

    if rows.isStreaming:
        return folds.streamed(rows, ["key"], "t", ["t", "hit_id"], start, step, schema, deadline)
    cut = folds.sessions(rows, ["key"], "t", ["t", "hit_id"], max(window_s, lockout_s))
    return folds.folded(cut, ["key", "session"], ["t", "hit_id"], start, step, schema)


def cooled(detections: DataFrame, seconds: float = 30.0, reach: float = 20.0) -> DataFrame:
    """Sendings by (device, class): one less than `seconds` and `reach` after the last one sent is suppressed."""

    def step(last: list, r) -> list[tuple]:
        if last and r.t - last[0] < seconds and metres(last[1], last[2], r.latitude, r.longitude) < reach:
            return []
        last[:] = [r.t, r.latitude, r.longitude]
        return [(r.report_id,)]

    by = ["device_id", "damage_type"]
    rows = detections.select(*by, "report_id", "t", "latitude", "longitude")
    if rows.isStreaming:
        return folds.streamed(rows, by, "t", ["t", "report_id"], list, step, "report_id long", lambda last: last[0] + seconds if last else None)
    cut = folds.sessions(rows, by, "t", ["t", "report_id"], seconds)
    return folds.folded(cut, [*by, "session"], ["t", "report_id"], list, step, "report_id long")


#: A jolt in m/s2, the least speed in m/s, the greatest age of a fix and the pause between two hits in seconds.
JOLT, LEAST_SPEED, FIX_AGE_S, JOLT_PAUSE_S = 9.0, 2.5, 10.0, 8.0


def jolts(motions: DataFrame, fixes: DataFrame) -> DataFrame:
    """Hits (device_id, motion_id, fix_id) of motions (device_id, motion_id, t, jolt) that are hard enough, with the last fix
    (device_id, fix_id, t, speed) before them: not too old, and moving where it tells the speed; none soon after another."""
    if motions.isStreaming:
        return _jolts_of(motions, fixes)
    fix = F.struct("t", "fix_id", "speed")
    kind = fixes.select(fix.alias("f")).schema["f"].dataType
    both = fixes.select("device_id", "t", F.lit(0).alias("is_motion"), F.col("fix_id").alias("id"), fix.alias("fix"), F.lit(None).cast("double").alias("jolt")).unionByName(
        motions.select("device_id", "t", F.lit(1).alias("is_motion"), F.col("motion_id").alias("id"), F.lit(None).cast(kind).alias("fix"), F.col("jolt").cast("double").alias("jolt"))
    )
    w = Window.partitionBy("device_id").orderBy("t", "is_motion", "id").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("fix", F.last("fix", ignorenulls=True).over(w)).where((F.col("is_motion") == 1) & (F.col("jolt") >= JOLT))
    fit = (F.col("t") - F.col("fix.t") <= FIX_AGE_S) & (F.col("fix.speed").isNull() | (F.col("fix.speed") >= LEAST_SPEED))
    met = met.where(fit).select("device_id", F.col("id").alias("motion_id"), "t", F.col("fix.fix_id").alias("fix_id"))
    return spaced(met, "device_id", "motion_id", JOLT_PAUSE_S).select("device_id", "motion_id", "fix_id")


def _jolts_of(motions: DataFrame, fixes: DataFrame) -> DataFrame:
    """jolts() on a stream: a device's state is its last fix and its last hit."""
    none = F.lit(None).cast("double")
    both = fixes.select("device_id", "t", F.lit(0).alias("is_motion"), F.col("fix_id").alias("id"), none.alias("jolt"), F.col("speed").cast("double").alias("speed")).unionByName(
        motions.select("device_id", "t", F.lit(1).alias("is_motion"), F.col("motion_id").alias("id"), F.col("jolt").cast("double").alias("jolt"), none.alias("speed"))
    )

    def step(state: dict, r) -> list[tuple]:
        if not r.is_motion:
            state["fix"] = [r.t, int(r.id), None if r.speed != r.speed or r.speed is None else r.speed]
            return []
        fix = state["fix"]
        fit = fix and r.jolt >= JOLT and r.t - fix[0] <= FIX_AGE_S and (fix[2] is None or fix[2] >= LEAST_SPEED)
        if not fit or state["hit"] is not None and r.t - state["hit"] < JOLT_PAUSE_S:
            return []
        state["hit"] = r.t
        return [(r.device_id, int(r.id), fix[1])]

    def deadline(state: dict) -> float | None:
        ends = [state["fix"][0] + FIX_AGE_S] * bool(state["fix"]) + [state["hit"] + JOLT_PAUSE_S] * (state["hit"] is not None)
        return max(ends, default=None)

    return folds.streamed(both, ["device_id"], "t", ["t", "is_motion", "id"], lambda: {"fix": None, "hit": None}, step, "device_id string, motion_id long, fix_id long", deadline)


def spaced(rows: DataFrame, key: str, row_id: str, pause_s: float) -> DataFrame:
    """Of rows with a time t, by key in order, those that come pause_s or more after the last one kept."""

    def step(last: list, r) -> list[tuple]:
        if last and r.t - last[0] < pause_s:
            return []
        last[:] = [r.t]
        return [(getattr(r, row_id),)]

    cut = folds.sessions(rows.select(key, row_id, "t"), [key], "t", ["t", row_id], pause_s)
    kept = folds.folded(cut, [key, "session"], ["t", row_id], list, step, f"{row_id} {rows.schema[row_id].dataType.simpleString()}")
    return rows.join(kept, row_id, "left_semi")


def alerts(near: DataFrame, gap_s: float, session_s: float = 6 * 3600.0) -> DataFrame:
    """Spoken alerts (device_id, row_id) of sightings (device_id, row_id, t, event_id) in order: each event once in a session, none within gap_s
    of the last. A device's session ends when nothing came for session_s, so what it has said is bounded by a session."""

    def step(state: dict, r) -> list[tuple]:
        if state["seen"] is not None and r.t - state["seen"] > session_s:
            state.update(said={}, last=-math.inf)
        state["seen"] = r.t
        if str(r.event_id) in state["said"] or r.t - state["last"] < gap_s:
            return []
        state["said"][str(r.event_id)] = 1
        state["last"] = r.t
        return [(r.device_id, int(r.row_id))]

    def start() -> dict:
        return {"said": {}, "last": -math.inf, "seen": None}

    rows, schema = near.select("device_id", "row_id", "t", "event_id"), "device_id string, row_id long"
    if rows.isStreaming:
        return folds.streamed(rows, ["device_id"], "t", ["t", "row_id"], start, step, schema, lambda state: None if state["seen"] is None else state["seen"] + session_s)
    cut = folds.sessions(rows, ["device_id"], "t", ["t", "row_id"], session_s)
    return folds.folded(cut, ["device_id", "session"], ["t", "row_id"], start, step, schema)


def touched(signals: DataFrame, registry: DataFrame) -> DataFrame:
    """Signals (device_id, t, counted) against paired devices (device_id, is_active): (device_id, verdict, last_seen, reports), a row for each
    device: those whose owner revoked them are rejected, others allowed, and only paired ones are written to."""
    by = signals.groupBy("device_id").agg(F.max("t").alias("last_seen"), F.count_if("counted").alias("reports"))
    verdict = F.when(F.col("is_active"), "touched").when(~F.col("is_active"), "rejected").otherwise("allowed")
    seen = F.coalesce("is_active", F.lit(False))
    return by.join(registry.select("device_id", "is_active"), "device_id", "left").select("device_id", verdict.alias("verdict"), F.when(seen, F.col("last_seen")).alias("last_seen"), F.when(seen, F.col("reports")).alias("reports"))


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns what it wrote, with the number of its batch; files are in the shared folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/batch_id={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    kept = spark.read.parquet(f"{base}/out")
    return kept.drop("batch_id")
