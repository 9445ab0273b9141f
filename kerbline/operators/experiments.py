"""Datasets and experiments: oversampling, splits by country, schedules, comparisons, jobs, gates and class checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import folds, statistics
from kerbline.session import written


def oversampled(images: DataFrame, ratio: float = 0.30) -> DataFrame:
    """(class_id, copy, image_id): repeats of training images (image_id, class_id), drawn with replacement, that bring each class to
    `ratio` of the images of the commonest one. The n-th image of a class is found by its number, so no class is gathered."""
    held = written(images.select("image_id", "class_id").distinct(), "images")
    have = written(held.groupBy("class_id").agg(F.count("*").alias("have")), "have")
    most = have.agg(F.max("have")).first()[0] or 0
    needed = have.where(F.col("have") < int(most * ratio)).select("class_id", "have", F.explode(F.sequence(F.lit(1), F.lit(int(most * ratio)) - F.col("have"))).alias("copy"))
    numbered = statistics.running(held.withColumn("n", F.lit(1)), ["class_id"], F.col("image_id").cast("double")).select("class_id", "image_id", F.col("before").alias("nth"))
    return needed.withColumn("nth", statistics.draw("class_id", "copy", size=F.col("have"))).join(numbered, ["class_id", "nth"]).select("class_id", "copy", "image_id")


def country_split(groups: DataFrame, holdout: str, val: float = 0.15) -> DataFrame:
    """(group_id, split): groups (group_id, stratum, country) of the country held out are the test; of the others the first `val` in hash
    order of each stratum is for validation, one at least and less than all where there are two."""
    i, n = F.col("i"), F.col("n")
    k = F.greatest(F.lit(1), F.least(F.round(n * val), n - 1))
    pool = statistics.placed(groups.where(F.col("country") != holdout)).select("group_id", F.when((n >= 2) & (i < k), "val").otherwise("train").alias("split"))
    return pool.unionByName(groups.where(F.col("country") == holdout).select("group_id", F.lit("test").alias("split")))


def matched_holdout(groups: DataFrame, size: int) -> DataFrame:
    """(group_id, held): of groups (group_id, stratum, n_images) so many of each stratum, in hash order, that about `size` images are held out
    in all; where a stratum has three or more, one at least and all but two at most."""
    total = groups.agg(F.sum("n_images")).first()[0]
    if not 0 < size < (total or 0):
        raise ValueError(f"{size} of {total} images cannot be held out")
    i, n = F.col("i"), F.col("n")
    k = F.round(n * (size / total))
    k = F.when(n >= 3, F.greatest(F.lit(1), F.least(k, n - 2))).otherwise(k)
    return statistics.placed(groups).select("group_id", (i < k).alias("held"))


def scheduled(jobs: DataFrame, hours_left: float) -> DataFrame:
    """(queue, job_id, starts, finishes, fits) of jobs (queue, job_id, position, hours), walked in order: one that would end too late is
    skipped and takes no time."""

    def step(clock: list, r) -> list[tuple]:
        end = clock[0] + r.hours
        start, fits = clock[0], end <= hours_left + 1e-9
        if fits:
            clock[0] = end
        return [(r.queue, r.job_id, start, end, fits)]

    return folds.folded(jobs.select("queue", "job_id", "position", "hours"), ["queue"], ["position"], lambda: [0.0], step, "queue long, job_id long, starts double, finishes double, fits boolean")


def moved(frames: DataFrame, least: float) -> DataFrame:
    """(stream_id, frame_id) of the frames (stream_id, frame_id, pixels) whose mean difference from the last one passed reaches `least`; the first passes."""

    def step(last: list, r) -> list[tuple]:
        if last and sum(abs(a - b) for a, b in zip(r.pixels, last[0], strict=True)) / len(r.pixels) < least:
            return []
        last[:] = [list(r.pixels)]
        return [(r.stream_id, r.frame_id)]

    return folds.folded(frames.select("stream_id", "frame_id", "pixels"), ["stream_id"], ["frame_id"], list, step, "stream_id long, frame_id long")


def compared(per_class: DataFrame, baseline: str, challenger: str, noise: float) -> DataFrame:
    """One row on two experiments of (experiment, class_name, ap): a verdict on their mean over shared classes.

    Where the sets of classes differ, no aggregate is given, and the shared classes are judged. A change below the noise is none.
    """
    a, b = (per_class.where(F.col("experiment") == e).groupBy("class_name").agg(F.avg("ap").alias(x)) for e, x in ((baseline, "a"), (challenger, "b")))
    both = a.join(b, "class_name", "full").withColumn("delta", F.col("b") - F.col("a"))
    order = F.when(F.col("delta").isNotNull(), F.struct("delta", "class_name"))
    out = both.agg(
        F.count("a").alias("n_baseline"), F.count("b").alias("n_challenger"), F.count("delta").alias("n_shared"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("delta").alias("mean_delta"),
        F.count_if(F.col("delta") > 0).alias("n_better"), F.max_by("class_name", order).alias("best_class"), F.min_by("class_name", order).alias("worst_class"),
    )
    same = F.col("n_baseline") == F.col("n_challenger")
    change = F.when(same, F.col("mean_b") - F.col("mean_a")).otherwise(F.col("mean_delta"))
    verdict = F.when(F.col("n_shared") == 0, "nothing shared").when(F.abs(change) < noise, "below noise").when(change > 0, "better").otherwise("not better")
    return out.select("n_baseline", "n_challenger", "n_shared", "n_better", F.when(same, F.round(change, 6)).alias("aggregate_delta"), F.round("mean_delta", 6).alias("shared_delta"), "best_class", "worst_class", (~same).alias("suppressed"), verdict.alias("verdict"))


#: Seconds without a sign of life after which a job counts as dead.
STALE_S = 2 * 3600.0


def active_jobs(jobs: DataFrame, signs: DataFrame, now: float) -> DataFrame:
    """(job_id, state) of jobs (job_id, status, t) with the last of their own time and their sessions' (job_id, t): open ones that were
    silent too long are stale, and others as they say."""
    last = signs.groupBy("job_id").agg(F.max("t").alias("sign"))
    silent = F.lit(now) - F.greatest("t", F.coalesce("sign", F.lit(0.0))) > STALE_S
    return jobs.join(last, "job_id", "left").select("job_id", F.when(F.col("status").isin("pending", "running") & silent, "stale").otherwise(F.col("status")).alias("state"))


def next_job(jobs: DataFrame) -> DataFrame:
    """The oldest pending job (job_id, status, t); none while another runs."""
    busy = jobs.where("status = 'running'").limit(1)
    return jobs.where("status = 'pending'").join(busy.select(F.lit(1).alias("b")), F.lit(True), "left_anti").orderBy("t", "job_id").limit(1)


def class_check(declared: Column, wanted: list[str]) -> Column:
    """match, reordered, subset or foreign: what a declared list of classes is to the wanted one."""
    own = F.transform(declared, F.lower)
    want = F.array(*(F.lit(x.lower()) for x in wanted))
    return F.when(own == want, "match").when(F.array_sort(own) == F.array_sort(want), "reordered").when(F.size(F.array_except(own, want)) == 0, "subset").otherwise("foreign")


def best_folders(images: DataFrame, labels: DataFrame, most: int = 40) -> DataFrame:
    """(folder, matches, images): folders whose images (folder, stem) meet labels of the sibling folder (folder, stem), best first, `most` of them."""
    met = images.join(labels.distinct(), ["folder", "stem"], "left_semi").groupBy("folder").agg(F.countDistinct("stem").alias("matches"))
    every = images.groupBy("folder").agg(F.count("*").alias("images"))
    return met.join(every, "folder").orderBy(F.desc("matches"), "folder").limit(most)


def merged_view(images: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, folder, stem): the labelled images of all folders in one, with the folder's name before theirs."""
    tag = F.regexp_replace(F.regexp_replace("folder", r"^/+|/+$", ""), "[/ ]", "_")
    return images.join(labels.distinct(), ["folder", "stem"], "left_semi").select(F.concat(tag, F.lit("__"), "stem").alias("name"), "folder", "stem")


def flattened(rows: DataFrame, key: str, most: int = 480) -> DataFrame:
    """(key, name, value): the leaves of all other columns as text of at most `most` characters, named by their path with dots."""
    leaves: list[tuple[str, Column]] = []

    def walk(kind, at: Column, name: str) -> None:
        if hasattr(kind, "fields"):
            for f in kind.fields:
                walk(f.dataType, at[f.name], f"{name}.{f.name}")
        else:
            leaves.append((name, (F.to_json(at) if kind.simpleString().startswith(("array", "map")) else at.cast("string"))))

    for f in rows.schema.fields:
        if f.name != key:
            walk(f.dataType, F.col(f.name), f.name)
    pairs = F.array(*(F.struct(F.lit(n).alias("name"), F.left(c, F.lit(most)).alias("value")) for n, c in leaves))
    return rows.select(key, F.explode(pairs).alias("p")).select(key, "p.name", "p.value")
