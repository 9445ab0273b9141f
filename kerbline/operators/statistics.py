"""Rank correlation, permutation tests, bootstrap, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import written


def running(counts: DataFrame, by: list[str], order: Column, n: str = "n") -> DataFrame:
    """counts with `before`: the sum of n over the rows of its group that come earlier; order has no ties within a group.

    No task holds a group: rows are sorted by ranges of group and order, as many as there are partitions of a shuffle; a group's ranges are
    added up, which are at most so many numbers, and each range is summed by itself.
    """
    ordered = counts.withColumn("o_", order).repartitionByRange(*by, "o_").withColumn("part_", F.spark_partition_id())
    counts = written(ordered, "counts")
    totals = counts.groupBy(*by, "part_").agg(F.sum(n).alias("t_"))
    head = F.coalesce(F.sum("t_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "part_").orderBy("o_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = totals.select(*(F.col(c).alias(f"{c}_h") for c in by), F.col("part_").alias("part_h"), head.alias("head_"))
    same = F.col("part_") == F.col("part_h")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_h"))
    out = counts.withColumn("own_", own).join(heads, same)
    return out.withColumn("before", F.col("head_") + F.col("own_")).drop("o_", "part_", "own_", "head_", "part_h", *(f"{c}_h" for c in by))


def ranks(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, x, average-tie rank) of each distinct value of x, a number, in its group."""
    counts = running(rows.where(F.col(x).isNotNull()).groupBy(group, x).agg(F.count("*").alias("n")), [group], F.col(x).cast("double"))
    return counts.select(group, x, (F.col("before") + (F.col("n") + 1) / 2).alias("r"))


def medians(rows: DataFrame, group: str, x: str) -> DataFrame:
    """(group, median) of x, a number: the mean of the one or two middle values, found by their places among counts of values."""
    counts = running(rows.where(F.col(x).isNotNull()).groupBy(group, F.col(x).cast("double").alias("x_")).agg(F.count("*").alias("n")), [group], F.col("x_"))
    counts = written(counts, "places")
    total = counts.groupBy(F.col(group).alias("g_")).agg(F.sum("n").alias("all_"))
    low, high = F.floor((F.col("all_") - 1) / 2), F.floor(F.col("all_") / 2)
    after = F.col("before") + F.col("n")
    middle = counts.join(total, F.col(group).eqNullSafe(F.col("g_"))).where((F.col("before") <= high) & (low < after))
    return middle.groupBy(group).agg(((F.min("x_") + F.max("x_")) / 2).alias("median"))


def spearman(rows: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Pearson correlation of average-tie ranks by group; null where a side does not vary. Ranks come from counts of values."""
    pairs = written(rows.groupBy(group, x, y).agg(F.count("*").alias("n")), "pairs")
    of_x, of_y = ranks(rows, group, x).withColumnRenamed("r", "rx"), ranks(rows, group, y).withColumnRenamed("r", "ry")
    both = pairs.join(of_x, [group, x]).join(of_y, [group, y])
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    mean = both.groupBy(group).agg((F.sum(n * a) / F.sum(n)).alias("ma"), (F.sum(n * b) / F.sum(n)).alias("mb"))
    a, b = a - F.col("ma"), b - F.col("mb")
    sums = both.join(mean, group).groupBy(group).agg(F.sum(n).alias("n"), F.sum(n * a * b).alias("ab"), F.sum(n * a * a).alias("aa"), F.sum(n * b * b).alias("bb"))
    return sums.select(group, "n", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("rho"))


def sign_flips(pairs: DataFrame, exact_pairs: int = 20, draws: int = 10_000) -> DataFrame:
    """Paired sign-flip test over (pair_id, diff): up to exact_pairs pairs all 2^n sign assignments, so there is no seed; above, so many random
    ones, by hashes of draw and pair, with one added to hits and draws.

    Columns: n_pairs, mean_difference, p_value, min_achievable_p, underpowered. Fewer than three pairs: no row.
    """
    n = pairs.count()
    if n > exact_pairs:
        return _drawn_flips(pairs, n, draws)
    if n < 3:
        return pairs.sparkSession.createDataFrame([], "n_pairs long, mean_difference double, p_value double, min_achievable_p double, underpowered boolean")
    diffs = pairs.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair_id", "diff"))), lambda p: p["diff"]).alias("d"))  # at most `exact_pairs` numbers
    signs = pairs.sparkSession.range(1 << n).join(F.broadcast(diffs))
    flipped = F.aggregate(F.zip_with("d", F.sequence(F.lit(0), F.lit(n - 1)), lambda d, i: F.when(F.getbit("id", i) == 1, -d).otherwise(d)), F.lit(0.0), lambda a, b: a + b)
    seen = F.aggregate("d", F.lit(0.0), lambda a, b: a + b)
    out = signs.select((F.abs(flipped) >= F.abs(seen) - 1e-12).alias("hit"), (seen / n).alias("mean")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("all"), F.max("mean").alias("mean_difference"))
    least = 2.0 ** (1 - n)
    return out.select(F.lit(n).cast("long").alias("n_pairs"), "mean_difference", (F.col("hits") / F.col("all")).alias("p_value"), F.lit(least).alias("min_achievable_p"), F.lit(least > 0.05).alias("underpowered"))


def _drawn_flips(pairs: DataFrame, n: int, draws: int) -> DataFrame:
    """Each pair takes part in every draw by a row of its own; sums of draws are combined before they are shuffled."""
    each = pairs.select("pair_id", "diff", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    sign = F.when(draw("draw", "pair_id", size=F.lit(2)) == 1, -1.0).otherwise(1.0)
    sums = each.groupBy("draw").agg(F.abs(F.sum(sign * F.col("diff"))).alias("s"))
    seen = pairs.agg(F.sum("diff").alias("seen"))
    out = sums.join(F.broadcast(seen)).agg(F.count_if(F.col("s") >= F.abs("seen") - 1e-12).alias("hits"), F.max("seen").alias("seen"))  # one row
    least = max(2.0 ** (1 - n) if n < 1000 else 0.0, 1 / (draws + 1))
    return out.select(F.lit(n).cast("long").alias("n_pairs"), (F.col("seen") / n).alias("mean_difference"), ((F.col("hits") + 1) / (draws + 1)).alias("p_value"), F.lit(least).alias("min_achievable_p"), F.lit(least > 0.05).alias("underpowered"))


def draw(*columns: Column | str, size: Column) -> Column:
    """A number from 0 to size - 1 by the MD5 of these columns, so that any engine draws the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *columns)), 1, 8), 16, 10).cast("long") % size


def placed_by(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, their place from 0 in the order of the key, for a sample that is small enough to be resampled: means of groups, seeds, classes."""
    return rows.withColumn("i", (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def bootstrap_mean(values: DataFrame, resamples: int = 1000) -> DataFrame:
    """Percentile interval of the mean over (i, v), i from 0 to n - 1; draws are hashes of resample and position, so runs agree."""
    n = values.count()
    draws = values.sparkSession.range(resamples).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j")).select("b", draw("b", "j", size=F.lit(n)).alias("i"))
    means = draws.join(values, "i").groupBy("b").agg(F.avg("v").alias("m"))
    return means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))


def permutation_p(rows: DataFrame, permutations: int = 1000) -> DataFrame:
    """Add-one p value of the absolute rank correlation over (i, rx, ry), i from 0: ry is dealt anew in the order of a hash."""
    perms = rows.sparkSession.range(permutations).withColumnRenamed("id", "perm")
    dealt = perms.join(F.broadcast(rows.select("i", "ry"))).withColumn("to", F.row_number().over(Window.partitionBy("perm").orderBy(F.md5(F.concat_ws(":", "perm", "i")), "i")) - 1)
    rho = dealt.join(rows.select(F.col("i").alias("to"), "rx"), "to").groupBy("perm").agg(F.abs(F.corr("rx", "ry")).alias("rho"))
    seen = rows.agg(F.abs(F.corr("rx", "ry")).alias("seen"))
    return rho.join(F.broadcast(seen)).agg(((F.count_if(F.col("rho") >= F.col("seen") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"), F.max("seen").alias("rho"))


def placed(groups: DataFrame) -> DataFrame:
    """groups (group_id, stratum, ...) with i, the place from 0 in hash order within the stratum, and n, the stratum's size.

    Places come from running(), by the first 52 bits of the MD5 of the id; rows that share these are ordered in one small window.
    """
    digest = F.md5(F.col("group_id").cast("string"))
    rows = groups.withColumn("d_", digest).withColumn("h_", F.conv(F.substring(digest, 1, 13), 16, 10).cast("long"))
    counts = running(rows.groupBy("stratum", "h_").agg(F.count("*").alias("n")), ["stratum"], F.col("h_").cast("double")).drop("n")
    total = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    tie = F.row_number().over(Window.partitionBy("stratum", "h_").orderBy("d_", "group_id")) - 1
    out = rows.withColumn("tie_", tie).join(counts, ["stratum", "h_"]).join(total, "stratum")
    return out.withColumn("i", F.col("before") + F.col("tie_")).drop("d_", "h_", "tie_", "before")


def stratified_split(groups: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """(group_id, stratum) to a split, by position in hash order within the stratum; three groups or more keep one for test."""
    at = placed(groups)
    n_train = F.round(F.col("n") * train)
    n_val = F.round(F.col("n") * val)
    n_val = F.when((F.col("n") >= 3) & (n_train + n_val >= F.col("n")), F.greatest(F.lit(0), F.col("n") - n_train - 1)).otherwise(n_val)
    return at.select("group_id", "stratum", F.when(F.col("i") < n_train, "train").when(F.col("i") < n_train + n_val, "val").otherwise("test").alias("split"))
