"""The life of live events: created, merged, confirmed, disputed and removed by reports, resolved, dismissed or promoted by operators, and
expired by time, as a fold that runs over a table or a stream.

Rows of the result tell what happened to which event (named by the report that created it) and what it was then. An event that nothing
extended for TTL_S expires. Eagerly (the default), it is gone from that moment, and a row at that time says so. Lazily, it is swept when
the next sighting comes to its place, or GRACE_S after it has expired: a confirmation that comes before still finds and revives it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators import folds
from kerbline.streaming.live import LEAST_DISPUTES, REACH, TTL_S, metres, status

#: For how long an expired event can be revived, if events are swept lazily.
GRACE_S = TTL_S

#: What operators do, and what it is called when done.
CLOSINGS = {"resolve": "resolved", "dismiss": "dismissed", "promote": "promoted"}
#: Actions after which an event is gone.
GONE = ("removed", "expired", *CLOSINGS.values())

LIFE = (
    "place long, event_id long, report_id long, t double, action string, supporters int, disputers int, status string, latitude double, longitude double, confidence double, severity int, "
    "sightings int, expires double"
)
_COLUMNS = ["place", "report_id", "kind", "t", "device_id", "latitude", "longitude", "confidence", "severity"]


def _row(e: dict, place: int, report: int | None, t: float, action: str) -> tuple:
    yes = len(e["yes"])
    return place, e["id"], report, t, action, yes, len(e["no"]), status(yes), e["lat"], e["lon"], e["confidence"], e["severity"], e["sightings"], e["expires"]


def _told(state: dict, over: list[dict]) -> Iterator[tuple]:
    """Drops these events, the earliest first, and tells."""
    state["events"] = [e for e in state["events"] if e not in over]
    for e in sorted(over, key=lambda e: (e["expires"], e["id"])):
        yield _row(e, state["place"], None, e["expires"], "expired")


def _over_by_ms(state: dict, now_ms: int, grace_s: float) -> list[dict]:
    """A stream's clock counts milliseconds: an event is over if its last millisecond is before the clock's."""
    return [e for e in state["events"] if math.floor((e["expires"] + grace_s) * 1000) < now_ms]


def stepped(eager: bool):
    """step(state, report) of the fold."""

    def step(state: dict, r) -> Iterable[tuple]:
        state["place"] = int(r.place)
        grace = 0.0 if eager or r.kind == "sighting" else GRACE_S
        out = list(_told(state, [e for e in state["events"] if e["expires"] + grace < r.t]))
        near = min(((metres(e["lat"], e["lon"], r.latitude, r.longitude), i) for i, e in enumerate(state["events"])), default=(math.inf, -1))
        e = state["events"][near[1]] if near[0] <= REACH else None
        if r.kind in CLOSINGS:
            if e:
                state["events"].remove(e)
                out.append(_row(e, state["place"], int(r.report_id), r.t, CLOSINGS[r.kind]))
        elif r.kind == "sighting":
            action = "merged"
            if e is None:
                action = "created"
                e = {"id": int(r.report_id), "lat": r.latitude, "lon": r.longitude, "yes": [], "no": [], "confidence": None, "severity": 0, "sightings": 0}
                state["events"].append(e)
            severity = r.severity if r.severity is not None and r.severity == r.severity else 0
            if r.confidence is not None and r.confidence == r.confidence:  # zero is a confidence
                e["confidence"] = float(r.confidence if e["confidence"] is None else max(e["confidence"], r.confidence))
            e.update(severity=int(max(e["severity"], severity)), sightings=e["sightings"] + 1, expires=r.t + TTL_S)
            if r.device_id not in e["yes"]:
                e["yes"].append(r.device_id)
            out.append(_row(e, state["place"], int(r.report_id), r.t, action))
        elif e is not None:
            votes = e["yes"] if r.kind == "confirm" else e["no"]
            if r.device_id not in votes:
                votes.append(r.device_id)
            action = "confirmed" if r.kind == "confirm" else "disputed"
            if r.kind == "confirm":
                e["expires"] = r.t + TTL_S
            elif len(e["no"]) >= max(LEAST_DISPUTES, len(e["yes"])):
                state["events"].remove(e)
                action = "removed"
            out.append(_row(e, state["place"], int(r.report_id), r.t, action))
        return out

    return step


def _start() -> dict:
    return {"place": 0, "events": []}


def _now_ms(reports: DataFrame, lateness_s: float) -> int | None:
    last = reports.agg(F.max(F.floor(F.col("t") * 1000))).first()[0]
    return None if last is None else last - round(lateness_s * 1000)


def life(reports: DataFrame, eager: bool = True, lateness_s: float = folds.LATENESS_S) -> DataFrame:
    """LIFE rows of all reports (place, report_id, kind, t, device_id, latitude, longitude, confidence, severity), with what has expired by
    the newest report's time less lateness_s. Votes and closings that find no event give no row. A place is a group of positions that
    can meet in one event (live.placed); one report lies in one place.
    """
    now, grace = _now_ms(reports, lateness_s), 0.0 if eager else GRACE_S
    cut = folds.sessions(reports.select(*_COLUMNS), ["place"], "t", ["t", "report_id"], TTL_S + grace)
    return folds.folded(cut, ["place", "session"], ["t", "report_id"], _start, stepped(eager), LIFE, lambda state: _told(state, _over_by_ms(state, now, grace)))


def life_stream(reports: DataFrame, eager: bool = True, lateness_s: float = folds.LATENESS_S) -> DataFrame:
    """life() on a stream: the same rows for any cut of the reports, in order of time, into batches. A place's timer stands at its first expiry."""
    grace = 0.0 if eager else GRACE_S

    def deadline(state: dict) -> float | None:
        return min(e["expires"] for e in state["events"]) + grace if state["events"] else None

    def due(state: dict, now: float) -> Iterator[tuple]:
        return _told(state, _over_by_ms(state, round(now * 1000), grace))

    return folds.streamed(reports.select(*_COLUMNS), ["place"], "t", ["t", "report_id"], _start, stepped(eager), LIFE, deadline, due, lateness_s)


def promotions(changes: DataFrame) -> DataFrame:
    """The defects that promoted events become: (id, confidence, detection_count, first_detected, last_detected) from life() rows, one for each. An event without a confidence
    has 0.5; it was seen at least once."""
    by = changes.groupBy("event_id").agg(
        F.max_by(F.struct("action", "latitude", "longitude", "confidence", "severity", "sightings", "t"), F.struct("t", F.col("action").isin(*GONE).cast("int"))).alias("e"), F.min("t").alias("first")
    )
    done = by.where("e.action = 'promoted'")
    confidence = F.coalesce("e.confidence", F.lit(0.5))
    return done.select(
        F.col("event_id").alias("id"), confidence.alias("confidence"), F.greatest("e.sightings", F.lit(1)).cast("long").alias("detection_count"),
        F.timestamp_seconds(F.floor("first")).cast("date").alias("first_detected"), F.timestamp_seconds(F.floor("e.t")).cast("date").alias("last_detected"),
    )
