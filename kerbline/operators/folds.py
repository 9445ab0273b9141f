"""Ordered folds: what depends on the rows before, run over rows in order with a small state, never over a whole group at once.

A fold is written once, as step(state, row), and runs over a table (folded) or a stream (streamed).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(rows: DataFrame, by: list[str], t: str, order: list[str], gap_s: float) -> DataFrame:
    """rows with `session`: a new one of its key begins after a gap of more than gap_s. State that a gap ends makes sessions independent,
    so that a key with a large share of all rows is dealt over many tasks."""
    w = Window.partitionBy(*by).orderBy(*order)
    fresh = F.coalesce((F.col(t) - F.lag(t).over(w) > gap_s).cast("long"), F.lit(0))
    return rows.withColumn("fresh_", fresh).withColumn("session", F.sum("fresh_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh_")


def folded(
    rows: DataFrame, by: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], schema: str, end: Callable[[Any], Iterable[tuple]] | None = None
) -> DataFrame:
    """step(state, row) for each row of a key in order, from start(); what it returns are the rows of the result, and after a key's last row
    what end(state) returns.

    Rows are sorted by Spark within partitions by key and stream through a task in batches; the state of one key is all that is held.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.itertuples(index=False):
                own = tuple(getattr(r, c) for c in by)
                if own != key:
                    out.extend(end(state) if end and key is not None else ())
                    key, state = own, start()
                out.extend(step(state, r))
            if out:
                yield pd.DataFrame(out, columns=names)
        if end and key is not None and (out := list(end(state))):
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


#: How far behind the newest row the time of a stream stands, in seconds; rows behind that are late.
LATENESS_S = 1.0
#: Groups that the keys of a stream are kept in: a call of a task for each key would cost more than its rows.
BUCKETS = 1024


def streamed(
    rows: DataFrame, by: list[str], t: str, order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], Iterable[tuple]], schema: str, deadline: Callable[[Any], float | None],
    due: Callable[[Any, float], Iterable[tuple]] | None = None, lateness_s: float = LATENESS_S,
) -> DataFrame:
    """folded() on a stream: the same rows whatever batches the stream is cut into, as long as none is late.

    The state of a key (it must be JSON) outlives the batch; BUCKETS groups keep the states of their keys together. deadline(state) is the time, in seconds like the column t, after which it must
    be looked at: then due(state, now) may change it and returns rows of its own, such as those of what has expired. A state without
    a deadline, or with nothing due at it, is given up. Rows of a key are taken in order within a batch. Rows more than lateness_s behind
    the newest of the batches before are dropped by Spark (streaming.written.Windows keeps such rows aside); so is a row at the epoch itself.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def tell(held: dict, now_ms: int, busy: set) -> list[tuple]:
        """What is due of keys that had no row in this batch; states that are no more looked at go."""
        out = []
        for k in [k for k in held if k not in busy]:
            until = deadline(held[k])
            if until is not None and math.floor(until * 1000) < now_ms:
                out.extend(due(held[k], now_ms / 1000) if due else ())
                if not due or deadline(held[k]) is None:
                    del held[k]
        return out

    def run(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, now_ms = json.loads(state.get[0]) if state.exists else {}, state.getCurrentWatermarkMs()
        out: list[tuple] = []
        busy = set()
        if not state.hasTimedOut:
            every = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
            own = zip(*(every[c] for c in by), strict=True)
            for own_key, r in zip(own, every.itertuples(index=False), strict=True):
                k = json.dumps(own_key)
                if k not in held:
                    held[k] = start()
                busy.add(k)
                out.extend(step(held[k], r))
            for k in busy:
                if deadline(held[k]) is None:
                    del held[k]
        out.extend(tell(held, now_ms, busy))
        if held:
            state.update((json.dumps(held),))
            first = min(math.floor(deadline(x) * 1000) for x in held.values())
            state.setTimeoutTimestamp(max(first, now_ms + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    at = F.timestamp_micros((F.col(t) * 1_000_000).cast("long"))
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    timed = rows.withColumns({"at_": at, "bucket_": bucket}).withWatermark("at_", f"{round(lateness_s * 1000)} milliseconds")
    return timed.groupBy("bucket_").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
