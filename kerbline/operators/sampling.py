"""Moments of recordings: an even grid of frames, and the middles of equal parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid(videos: DataFrame, least_s: float = 0.0) -> DataFrame:
    """(video_id, i, t) of videos (video_id, duration_s, fps): t = 0 and then every 1 / fps seconds, or least_s if that is more, while before the
    end. A recording without a length or a positive rate has no frames. The frames of one recording come from one row."""
    step = F.greatest(1 / F.col("fps"), F.lit(least_s))
    good = videos.where("duration_s > 0 and fps > 0").withColumn("step", step)
    each = good.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration_s") / F.col("step")))))
    return each.withColumn("t", F.col("i") * F.col("step")).where("t < duration_s").select("video_id", "i", "t")


def middles(videos: DataFrame) -> DataFrame:
    """(video_id, i, t): the middle of each of n equal parts of videos (video_id, duration_s, n)."""
    each = videos.where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)))
    return each.select("video_id", "i", ((F.col("i") + 0.5) / F.col("n") * F.col("duration_s")).alias("t"))
