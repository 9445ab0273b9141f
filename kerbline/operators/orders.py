"""Work orders: what a change of status does, edits of items, guards; the clock of a recording against its track; ranked runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.operators import statistics

# ---------------------------------------------------------------- status and items


def transitions(orders: DataFrame, items: DataFrame, detections: DataFrame, changes: DataFrame, reopened: Column) -> DataFrame:
    """(work_order_id, status, refused, reopened_ids) for each change (work_order_id, status) of an order (work_order_id, status).

    An order is not verified if a defect among its items (work_order_id, detection_id) was seen again after its repair (reopened, a
    condition on detections): it keeps its status, and the defects are named in order. All other changes are made, in whatever order.
    A change to the same status, and one of an order that is not there, is none.
    """
    asked = changes.select("work_order_id", F.col("status").alias("to")).join(orders.select("work_order_id", "status"), "work_order_id").where("to != status")
    back = detections.where(reopened).select(F.col("id").alias("detection_id"))
    wanted = asked.where("to = 'verified'").select("work_order_id").distinct()
    found = items.select("work_order_id", "detection_id").distinct().join(wanted, "work_order_id").join(back, "detection_id")
    found = found.groupBy("work_order_id").agg(F.sort_array(F.collect_list("detection_id")).alias("reopened_ids"))  # items of one order
    out = asked.join(found, "work_order_id", "left").withColumn("refused", F.col("reopened_ids").isNotNull())
    return out.select("work_order_id", F.when(F.col("refused"), F.col("status")).otherwise(F.col("to")).alias("status"), "refused", "reopened_ids")


def repaired(detections: DataFrame, items: DataFrame, made: DataFrame, on: Column) -> DataFrame:
    """detections with is_fixed and fixed_on after transitions: the items of orders that became repaired are fixed on that day."""
    done = made.where("status = 'repaired' and not refused").select("work_order_id").join(items, "work_order_id").select(F.col("detection_id").alias("id")).distinct().withColumn("done_", F.lit(True))
    out = detections.join(done, "id", "left")
    return out.withColumn("is_fixed", F.coalesce("done_", "is_fixed")).withColumn("fixed_on", F.when(F.col("done_"), on).otherwise(F.col("fixed_on"))).drop("done_")


def edited(items: DataFrame, detections: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """items (work_order_id, detection_id, sort_order) after edits: removed (work_order_id, detection_id) go; added (work_order_id, detection_id,
    position) are appended, in the order of position, after the greatest sort_order that is left, if the defect exists and is no item
    yet. One that is added twice is appended once, at its first position. Gaps that removals leave stay.
    """
    pair = ["work_order_id", "detection_id"]
    left = items.select(*pair, "sort_order").join(removed.select(*pair).distinct(), pair, "left_anti")
    last = left.groupBy("work_order_id").agg(F.max("sort_order").alias("last"))
    fresh = added.groupBy(*pair).agg(F.min("position").alias("position")).join(detections.select(F.col("id").alias("detection_id")).distinct(), "detection_id", "left_semi").join(left, pair, "left_anti")
    nth = F.row_number().over(Window.partitionBy("work_order_id").orderBy("position", "detection_id"))
    fresh = fresh.withColumn("nth", nth).join(last, "work_order_id", "left")
    return left.unionByName(fresh.select(*pair, (F.coalesce("last", F.lit(-1)) + F.col("nth")).cast(items.schema["sort_order"].dataType).alias("sort_order")))


def last_of_kind(members: DataFrame, group: str, member: str, holds: Column) -> DataFrame:
    """(group, member, refused) of members for whom the condition holds: taking it from one is refused if no other of the group has it."""
    own = members.where(holds).select(group, member)
    n = own.groupBy(group).agg(F.count("*").alias("n"))
    return own.join(n, group).select(group, member, (F.col("n") < 2).alias("refused"))


# ---------------------------------------------------------------- clocks

#: Seconds that whole hours may leave between two clocks.
RESIDUAL_S = 45.0


def aligned(videos: DataFrame, tracks: DataFrame) -> DataFrame:
    """(video_id, start_s, rule, hours) of videos (video_id, stem, track_id, start_s, duration_s) against their track (track_id, stem, begin_s, end_s).

    A start within the track stands (inside). Else, if video and track have the same stem, the track was taken from the video: it starts
    with it (embedded). Else the start may be off by whole hours from the track's (start stamp), or the stamp is that of the end (end
    stamp), with at most RESIDUAL_S left over; hours are rounded half to even. What fits nothing stands (unresolved), as does a
    video without a track (no track).
    """
    t = tracks.select("track_id", F.col("stem").alias("of"), "begin_s", "end_s")
    v = videos.join(t, "track_id", "left")

    def shift(start: Column) -> tuple[Column, Column]:
        apart = start - F.col("begin_s")
        hours = F.bround(apart / 3600)
        return hours, F.abs(apart - hours * 3600) < RESIDUAL_S

    start, end = F.col("start_s"), F.col("start_s") - F.col("duration_s")
    (h1, ok1), (h2, ok2) = shift(start), shift(end)
    rule = F.when(F.col("begin_s").isNull(), "no track").when(start.between(F.col("begin_s"), F.col("end_s")), "inside").when(F.col("stem") == F.col("of"), "embedded").when(ok1, "start stamp").when(ok2, "end stamp").otherwise("unresolved")
    v = v.withColumn("rule", rule)
    hours = F.when(F.col("rule") == "start stamp", h1).when(F.col("rule") == "end stamp", h2)
    at = F.when(F.col("rule") == "embedded", F.col("begin_s")).when(F.col("rule") == "start stamp", start - h1 * 3600).when(F.col("rule") == "end stamp", end - h2 * 3600).otherwise(start)
    return v.select("video_id", at.alias("start_s"), "rule", hours.cast("long").alias("hours"))


# ---------------------------------------------------------------- ranked runs


def ranked_runs(runs: DataFrame) -> DataFrame:
    """runs (run_id, classes, mean) with position (more classes first, then the greater mean, then the smaller id) and anchor, the best mean
    among runs of as many classes. Ranked over ranges, so any number of runs will do."""
    place = F.struct(-F.col("classes"), -F.col("mean"), "run_id")
    at = statistics.running(runs.select("run_id", "classes", "mean").withColumn("n", F.lit(1)), [], place).withColumn("position", F.col("before") + 1).drop("n", "before")
    return at.join(runs.groupBy("classes").agg(F.max("mean").alias("anchor")), "classes")
