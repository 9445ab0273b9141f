"""Similarity joins on bit hashes, and duplicate groups."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import forget, written


def packed(bits: Column) -> Column:
    """A string of 64 zeros and ones as a long, the first one the highest."""
    high, low = F.conv(F.substring(bits, 1, 32), 2, 10).cast("long"), F.conv(F.substring(bits, 33, 32), 2, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def _slices(limit: int) -> list[tuple[int, int]]:
    """Where each of limit + 4 slices of a hash begins and ends."""
    n = limit + 4
    return list(itertools.pairwise([64 * i // n for i in range(n + 1)]))


def keys(h: Column, limit: int) -> Column:
    """Keys of a hash: four of limit + 4 slices, in every choice, with the number of the choice above. Two hashes at most `limit` bits apart
    differ in at most so many slices, so four others agree; a key has some 40 bits, so that unlike hashes seldom meet however many there are."""
    out, cuts = [], _slices(limit)
    for i, some in enumerate(itertools.combinations(range(limit + 4), 4)):
        key = F.lit(i).cast("long")
        for j in some:
            a, b = cuts[j]
            key = F.shiftleft(key, b - a).bitwiseOR(F.shiftrightunsigned(h, a).bitwiseAND((1 << (b - a)) - 1))
        out.append(key)
    return F.array(*out)


def _links(hashes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b), a < b, of different hashes at most `limit` bits apart, each from the first key that both share: no other makes it again."""
    cuts, choices = _slices(limit), list(itertools.combinations(range(limit + 4), 4))
    # slices that must differ if a choice is to be the first that agrees
    before = F.array(*(F.lit(sum(1 << j for j in range(max(c)) if j not in c)) for c in choices))
    each = hashes.select("h", F.posexplode(keys(F.col("h"), limit)).alias("choice", "key"))
    l, r = each.select(F.col("h").alias("a"), "choice", "key"), each.select(F.col("h").alias("b"), "key")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    agree = sum((F.when(F.shiftrightunsigned(apart, x).bitwiseAND((1 << (y - x)) - 1) == 0, 1 << j).otherwise(0) for j, (x, y) in enumerate(cuts)), F.lit(0))
    near = (F.col("a") < F.col("b")) & (F.bit_count(apart) <= limit) & (agree.bitwiseAND(F.get(before, F.col("choice"))) == 0)
    # both sides are many times what Spark takes them for, which knows no number of keys: neither may be broadcast
    return l.join(r.hint("merge"), "key").where(near).select("a", "b")


def hamming_links(items: DataFrame, limit: int) -> DataFrame:
    """Each id with its class, the smallest id of equal hash, how many others are at most `limit` bits away, and how many of those are equal.

    Links are found and counted among distinct hashes; items of equal hash are never paired.
    """
    classes = written(items.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "hashes")
    links = class_links(classes, limit).select("a", "b")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    there = both.join(classes.select(F.col("class_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("more"))
    of = classes.join(there, "class_id", "left").select("h", "class_id", (F.col("n") - 1).alias("copies"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return items.join(of, "h").select("id", "class_id", "links", "copies")


def class_links(classes: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, distance) of representatives of classes (h, class_id), a < b, with hashes at most `limit` bits apart."""
    found = _links(classes.select("h"), limit)
    x, y = classes.select(F.col("h").alias("a"), F.col("class_id").alias("p")), classes.select(F.col("h").alias("b"), F.col("class_id").alias("q"))
    made = found.join(x, "a").join(y, "b")
    return made.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))


def split_leaks(items: DataFrame, limit: int) -> DataFrame:
    """From (id, h, split): pairs of splits with the pairs of different hashes and the equal hashes that cross them, and an example of each side.

    Counted over distinct hashes of a split; a check that is independent of how the splits were made.
    """
    held = written(items.groupBy("h", "split").agg(F.min("id").alias("id")), "hashes")
    links = _links(held.select("h").distinct(), limit)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(held.select(F.col("h").alias("a"), F.col("h").alias("b")).distinct())
    x, y = held.select(F.col("h").alias("a"), F.col("split").alias("split_a"), F.col("id").alias("id_a")), held.select(F.col("h").alias("b"), F.col("split").alias("split_b"), F.col("id").alias("id_b"))
    met = both.join(x, "a").join(y, "b").where("split_a < split_b")
    return met.groupBy("split_a", "split_b").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("equal"), F.min("id_a").alias("first_a"), F.min("id_b").alias("first_b"))


def duplicate_groups(items: DataFrame, limit: int) -> DataFrame:
    """Each id with the smallest id reachable over links of at most `limit` bits, and the group's size."""
    hashes = written(items.groupBy("h").agg(F.min("id").alias("class_id")), "hashes")
    links = written(class_links(hashes, limit).select("a", "b"), "links")
    label = grouped_minima(hashes.select("class_id"), links)
    of = items.join(hashes, "h").join(label, "class_id").select("id", "group_id")
    size = of.groupBy("group_id").agg(F.count("*").alias("group_size"))
    return of.join(size, "group_id").select("id", "group_id", "group_size")


def grouped_minima(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(class_id, group_id): the smallest node reachable from each over links (a, b). Each round hears of the least label around and then
    jumps to the label of that label, so that the number of rounds grows with the logarithm of the longest path."""
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    label = written(nodes.select(F.col("class_id").alias("a"), F.col("class_id").alias("c")), "labels")
    while True:
        heard = both.join(label.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("c").alias("m"))
        low = label.join(heard, "a", "left").select("a", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jumped = low.join(label.select(F.col("a").alias("c"), F.col("c").alias("d")), "c").select("a", F.least("c", "d").alias("c"), (F.least("c", "d") < F.col("old")).alias("changed"))
        new = written(jumped, "labels")
        changed = new.where("changed").limit(1).count()
        forget(label)
        label = new
        if not changed:
            return label.select(F.col("a").alias("class_id"), F.col("c").alias("group_id"))
