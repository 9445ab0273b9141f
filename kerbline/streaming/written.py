"""Tables that a stream keeps, written batch by batch so that a batch that comes again changes nothing.

Each batch writes under its own number and replaces what an earlier, broken or repeated run of the same batch left there; it reads only
what batches before it wrote. So a restart after any crash gives what an undisturbed run gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Every so many batches all rows are written anew, so that a reader needs the batches since then only.
WHOLE_EVERY = 64


def _there(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of the store, by Spark's own file system."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []


class Batches:
    """Rows by the number of the batch that wrote them; a batch counts when its write has ended."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def numbers(self) -> list[int]:
        found = (int(x.removeprefix("batch=")) for x in _there(self.spark, self.path) if x.startswith("batch="))
        return sorted(n for n in found if "_SUCCESS" in _there(self.spark, f"{self.path}/batch={n}"))

    def put(self, n: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={n}")

    def read(self, first: int = 0, before: int | None = None) -> DataFrame:
        """The rows of batches from `first`, and before another, with their number."""
        numbers = [n for n in self.numbers() if n >= first and (before is None or n < before)]
        paths = [f"{self.path}/batch={n}" for n in numbers]
        if not paths:
            return self.spark.createDataFrame([], f"{self.schema}, batch long")
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/[^/]*$", 1).cast("long")
        return rows.select("*", number.alias("batch"))


class Latest(Batches):
    """One row for each key: the one of the last batch that wrote it. put() takes the rows that a batch changed, whole."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str):
        super().__init__(spark, path, schema)
        self.keys = keys

    def state(self, before: int | None = None) -> DataFrame:
        numbers = [n for n in self.numbers() if before is None or n < before]
        whole = max((n for n in numbers if n % WHOLE_EVERY == WHOLE_EVERY - 1), default=0)
        rows = self.read(whole, before)
        columns = [c for c in rows.columns if c not in (*self.keys, "batch")]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "batch").alias("row_"))
        return last.select(*self.keys, *(F.col(f"row_.{c}").alias(c) for c in columns))

    def put(self, n: int, rows: DataFrame) -> None:
        if n % WHOLE_EVERY == WHOLE_EVERY - 1:
            rows = rows.unionByName(self.state(n).join(rows.select(*self.keys), self.keys, "left_anti"))
        super().put(n, rows)


def kept(stream: DataFrame, path: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Runs a stream over what is there, handing each batch with its number to `each`; progress is kept beside the tables."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


# ---------------------------------------------------------------- late rows


class Windows:
    """Counts and sums of fixed windows of a stream, and a side table of the rows that came too late for theirs.

    The watermark of a batch is the newest time of all batches before it less the lateness allowed. A row is late if its window had
    ended by then. Spark's own windows drop such rows (a batch later, as they judge by the watermark one batch older); here they
    are kept, with the watermark that they missed. On-time rows of all batches and late rows together are all rows.
    """

    def __init__(self, spark: SparkSession, path: str, window_s: float, lateness_s: float, at: str = "at", value: str = "value"):
        self.spark, self.path, self.at, self.value = spark, path, at, value
        self.window, self.lateness = round(window_s * 1e6), round(lateness_s * 1e6)
        self.parts = Batches(spark, f"{path}/parts", "start long, n long, total double, greatest double")
        self.clock = Batches(spark, f"{path}/clock", "newest long")

    def watermark(self, before: int | None = None) -> int | None:
        """In microseconds; None before the first row."""
        newest = self.clock.read(before=before).agg(F.max("newest")).first()[0]
        return None if newest is None else newest - self.lateness

    def _micros(self) -> Column:
        return F.unix_micros(F.col(self.at).cast("timestamp"))

    def each(self, batch: DataFrame, n: int) -> None:
        mark = self.watermark(n)
        start = (F.floor(self._micros() / self.window) * self.window).cast("long")
        rows = batch.withColumn("start_", start)
        late = F.lit(False) if mark is None else F.coalesce(F.col("start_") + self.window <= mark, F.lit(False))
        late = late | F.col("start_").isNull()  # a row without a time has no window
        side = rows.where(late).drop("start_").withColumn("missed", F.lit(mark).cast("long"))
        side.write.mode("overwrite").parquet(f"{self.path}/late/batch={n}")
        counted = rows.where(~late).groupBy(F.col("start_").alias("start")).agg(F.count("*").alias("n"), F.sum(F.col(self.value).cast("double")).alias("total"), F.max(F.col(self.value).cast("double")).alias("greatest"))
        self.parts.put(n, counted)
        self.clock.put(n, batch.agg(F.max(self._micros()).alias("newest")))  # last: a batch without it does not count for the next

    def run(self, stream: DataFrame) -> None:
        kept(stream, self.path, self.each)

    def totals(self) -> DataFrame:
        """(start, n, total, greatest, closed), one row for each window."""
        mark = self.watermark()
        by = self.parts.read().groupBy("start").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("greatest").alias("greatest"))
        closed = F.lit(False) if mark is None else F.col("start") + self.window <= mark
        return by.select(F.timestamp_micros("start").alias("start"), "n", "total", "greatest", closed.alias("closed"))

    def late(self) -> DataFrame:
        """Rows of the stream with `missed`, the watermark in microseconds."""
        return self.spark.read.parquet(f"{self.path}/late/*")


# ---------------------------------------------------------------- points, streaks and badges


STATS = "user_id long, reports_total long, points_total long, confirmed_total long, verified_total long, fixed_total long, at_night boolean, days array<struct<first: date, last: date>>"


class Standing:
    """Reports, points, day streaks and badges of users, kept from a stream of what they did.

    Rows: (user_id, report_at) for a report, or (user_id, reason, ref_id) for points, which count once for each reason and ref_id. Days
    are those of the zone. A user's days are kept as runs of days, so reports in any order and in any batch give the same streaks.
    """

    def __init__(self, spark: SparkSession, path: str, points: dict[str, int], badges: tuple[tuple[str, str], ...], zone: str = "Europe/Bucharest"):
        self.spark, self.path, self.points, self.badges_, self.zone = spark, path, points, badges, zone
        self.stats = Latest(spark, f"{path}/stats", ["user_id"], STATS)
        self.ledger = Batches(spark, f"{path}/ledger", "user_id long, reason string, ref_id long")

    def each(self, batch: DataFrame, n: int) -> None:
        earned = batch.where(F.col("reason").isin(*self.points)).select("user_id", "reason", "ref_id").distinct()
        fresh = earned.join(self.ledger.read(before=n), ["user_id", "reason", "ref_id"], "left_anti")
        self.ledger.put(n, fresh)
        fresh = self.ledger.read(n, n + 1)
        local = F.from_utc_timestamp(F.col("report_at").cast("timestamp"), self.zone)
        night = (F.hour(local) >= 22) | (F.hour(local) < 5)
        reports = batch.where("report_at is not null").select("user_id", local.cast("date").alias("day"), night.alias("night"))
        price = F.element_at(F.create_map(*(F.lit(x) for kv in self.points.items() for x in kv)), F.col("reason"))

        def count(reason: str) -> Column:
            return F.count_if(F.col("reason") == reason)

        got = fresh.groupBy("user_id").agg(F.sum(price).alias("points"), count("event_confirmed").alias("confirmed"), count("event_verified").alias("verified"), count("event_fixed").alias("fixed"))
        said = reports.groupBy("user_id").agg(F.count("*").alias("reports"), F.max("night").alias("night"))
        before = self.stats.state(n)
        changed = said.select("user_id").union(got.select("user_id")).distinct()
        old = changed.join(before, "user_id", "left")
        runs = old.select("user_id", F.explode("days").alias("d")).select("user_id", "d.first", "d.last")
        days = _runs(runs.unionByName(reports.select("user_id", F.col("day").alias("first"), F.col("day").alias("last")).distinct()))

        def more(c: str, x: str) -> Column:
            return (F.coalesce(c, F.lit(0)) + F.coalesce(x, F.lit(0))).cast("long").alias(c)

        rows = old.drop("days").join(said, "user_id", "left").join(got, "user_id", "left").join(days, "user_id", "left")
        self.stats.put(n, rows.select(
            "user_id", more("reports_total", "reports"), more("points_total", "points"), more("confirmed_total", "confirmed"), more("verified_total", "verified"), more("fixed_total", "fixed"),
            (F.coalesce("at_night", F.lit(False)) | F.coalesce("night", F.lit(False))).alias("at_night"), F.coalesce("days", F.array().cast("array<struct<first: date, last: date>>")).alias("days"),
        ))

    def run(self, stream: DataFrame) -> None:
        kept(stream, self.path, self.each)

    def view(self) -> DataFrame:
        """A row for each user: counters, the last and the best streak of days, and badges."""
        long = F.transform("days", lambda d: F.datediff(d.last, d.first) + 1)
        s = self.stats.state().withColumn("long", long)
        s = s.withColumn("current_streak_days", F.coalesce(F.element_at(F.when(F.size("long") > 0, F.col("long")), -1), F.lit(0))).withColumn("best_streak_days", F.coalesce(F.array_max("long"), F.lit(0)))
        names = [F.when(F.expr(rule), name) for name, rule in self.badges_] + [F.when(F.col("at_night"), "night_reporter")]
        return s.withColumn("badges", F.array_compact(F.array(*names))).drop("long", "days", "at_night")


def _runs(days: DataFrame) -> DataFrame:
    """(user_id, days) of runs (user_id, first, last) that may overlap or touch: joined ones, in order."""
    w = Window.partitionBy("user_id").orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = days.withColumn("fresh", F.coalesce((F.col("first") > F.date_add(reach, 1)).cast("int"), F.lit(1)))
    run = fresh.withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = run.groupBy("user_id", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return joined.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("days"))


# ---------------------------------------------------------------- a feed of changes

MESSAGES = "seq long, type string, event_id long, latitude double, longitude double, confidence double, severity int, status string, supporters int, disputers int, expires double"
#: What a client is sent when it connects, when an event is there or has changed, and when it is gone.
HELLO, UPSERT, REMOVED = "hello", "event_upsert", "event_removed"


class Feed:
    """Changes of events (lifecycle rows) as messages for clients: all that is there when they connect, then what changes.

    A client says up to which batch it has read (None: it knows nothing) and gets messages in order of seq. A batch that comes again
    replaces its own messages by the same ones; applying a message twice changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.changes = Batches(spark, f"{path}/changes", MESSAGES)
        self.events = Latest(spark, f"{path}/events", ["event_id"], MESSAGES)

    def each(self, batch: DataFrame, n: int) -> None:
        from kerbline.streaming.lifecycle import GONE

        gone = F.col("action").isin(*GONE)
        # within a batch by time; an event's own rows of one time in the order of its reports, its end last
        key = F.struct("t", "place", gone.alias("gone"), F.coalesce("report_id", F.lit((1 << 63) - 1)).alias("report"))
        figures = [F.when(~gone, F.col(c)).alias(c) for c in ("latitude", "longitude", "confidence", "severity", "status", "supporters", "disputers", "expires")]
        rows = batch.select(key.alias("key"), F.when(gone, REMOVED).otherwise(UPSERT).alias("type"), "event_id", *figures)
        messages = _in_order(rows, n)
        self.changes.put(n, messages)
        mine = self.changes.read(n, n + 1).drop("batch")
        columns = [c for c in mine.columns if c != "event_id"]
        last = mine.groupBy("event_id").agg(F.max_by(F.struct(*columns), "seq").alias("m"))
        self.events.put(n, last.select("m.seq", "m.type", "event_id", *(F.col(f"m.{c}") for c in columns[2:])))

    def run(self, stream: DataFrame) -> None:
        kept(stream, self.path, self.each)

    def last(self) -> int | None:
        """The newest batch that is there for clients."""
        return max(self.events.numbers(), default=None)

    def connect(self, upto: int | None = None) -> DataFrame:
        """The snapshot for a new client: a hello for each event that is there after batch `upto` (the newest, if not given)."""
        state = self.events.state(None if upto is None else upto + 1)
        return state.where(F.col("type") == UPSERT).withColumn("type", F.lit(HELLO)).select(*(c.split()[0] for c in MESSAGES.split(", ")))

    def after(self, batch: int | None) -> DataFrame:
        """What changed after a batch."""
        done = self.last()
        return self.changes.read(0 if batch is None else batch + 1, None if done is None else done + 1)


def _in_order(rows: DataFrame, n: int) -> DataFrame:
    """rows with seq by their key, above all of earlier batches: sorted by ranges, each range's places in the lower 33 bits."""
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")
    # numbers that the batch, the range and the place in it make up, so that no task sorts a batch
    seq = F.lit(n << 44) + F.shiftleft(F.shiftright(F.monotonically_increasing_id(), 33), 30) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return ordered.select(seq.alias("seq"), *[c for c in rows.columns if c != "key"])


def viewed(messages: DataFrame) -> DataFrame:
    """What a client sees after messages (seq, type, event_id, ...): a hello at a seq replaces all that was there by its own rows, an upsert
    sets an event, a removal takes it away. (event_id, ..., is_new): new is an event whose id came first in an upsert."""
    hello = messages.where(F.col("type") == HELLO).agg(F.coalesce(F.max("seq"), F.lit(-(1 << 62))).alias("from_"))
    rest = [c for c in messages.columns if c not in ("event_id", "seq", "type")]
    by = messages.join(F.broadcast(hello)).groupBy("event_id").agg(  # one row
        F.max_by(F.struct("seq", "type", *rest), F.struct("seq", (F.col("type") == REMOVED).alias("gone"))).alias("m"), F.min_by("type", "seq").alias("first_"), F.first("from_").alias("from_")
    )
    there = (F.col("m.seq") >= F.col("from_")) & (F.col("m.type") != REMOVED)
    return by.where(there).select("event_id", F.col("m.seq").alias("seq"), *(F.col(f"m.{c}").alias(c) for c in rest), (F.col("first_") == UPSERT).alias("is_new"))
