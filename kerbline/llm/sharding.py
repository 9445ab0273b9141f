"""Shards as contiguous cuts of an ordered row of atomic groups, with the least possible capacity.

Groups (documents of equal text) are ordered by the 64-bit hash of the text, so the order needs no sort and a cut is a hash
value. The capacity is found by binary search: a greedy walk from the left, each shard as full as the capacity allows, tells
whether so many shards do.

The walk needs running totals. Groups that hold more than a 2 ** -FINE_BITS part of all, of which there are at most so many, stand by
themselves; Spark sums the others into 2 ** FINE_BITS ranges of the hash, cut where one of these stands between. Within a range the
group ends are unknown, so a walk knows each cut only between two bounds, and bisection ends with an interval of capacities; only the
ranges that a cut can fall into for these (a few for each cut, as ranges are of like size) are summed again, by further bits of the
hash, until each holds one group and the bisection ends exactly. A step brings the driver MOST_ROWS sums or two for each of these
ranges, whatever the input. All else is a projection of each row: no group is ever gathered.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import written

FINE_BITS = 16
#: Sums that one step brings to the driver at most.
MOST_ROWS = 1 << 18
#: Rows, about, that are numbered together; there are as many such parts of a shard as that takes.
PART_ROWS = 1 << 16
LAWS = ("bytes", "rows")


def _key(text: Column) -> Column:
    return F.xxhash64(text)


def _range(key: Column, bits: int) -> Column:
    return F.shiftright(key, 64 - bits)


def walk(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy: positions in `ends` (running totals after each group) where each shard ends; None if groups are left over."""
    cuts, at = [], 0
    for _ in range(shards):
        done = ends[at - 1] if at else 0
        at = bisect_right(ends, done + capacity)
        cuts.append(at)
        if at == len(ends):
            return cuts + [at] * (shards - len(cuts))
    return None


def least_capacity(ends: list[int], low: int, high: int, shards: int) -> int:
    """Smallest capacity in low..high for which walk() succeeds; it must for high."""
    while low < high:
        middle = (low + high) // 2
        if walk(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


class Part(NamedTuple):
    """Groups that follow each other: least and greatest key, total, largest group, how many, and the bits of the hash they share."""

    first: int
    last: int
    size: int
    largest: int
    n: int
    bits: int


def furthest(parts: list[Part], ends: list[int], capacity: int, shards: int) -> list[int]:
    """The furthest that each shard can end, if a part may be cut anywhere but in its largest group, where that must lie."""
    out, at = [], 0
    for _ in range(shards):
        at = min(ends[-1], at + capacity)
        i = bisect_right(ends, at)
        if i < len(parts):
            start, p = (ends[i - 1] if i else 0), parts[i]
            if start + p.size - p.largest < at < start + p.largest:
                at = start + p.size - p.largest
        out.append(at)
    return out


def _parts(groups: DataFrame, bits: int, *by: str) -> list[Part]:
    """The parts that groups make which agree on so many bits of the key, and on the columns `by`."""
    made = groups.groupBy(_range(F.col("key"), bits).alias("at"), *by).agg(F.min("key"), F.max("key"), F.sum("size"), F.max("size"), F.count("*")).collect()
    return [Part(*r[1 + len(by) :], bits) for r in made]


def first_parts(groups: DataFrame, bits: int) -> list[Part]:
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") * F.lit(1 << bits) > F.lit(total)
    alone = [Part(k, k, s, s, 1, 64) for k, s in groups.where(large).select("key", "size").collect()]  # fewer than 2 ** bits
    rest = groups.where(~large).withColumn("at", _range(F.col("key"), bits))
    if not alone:
        return sorted(_parts(rest, bits))
    walls = groups.sparkSession.createDataFrame([(p.first, p.first >> (64 - bits)) for p in alone], "wall long, at long")
    beside = rest.join(walls, "at").groupBy("key", "size").agg(F.max(F.when(F.col("wall") < F.col("key"), F.col("wall"))).alias("wall"))
    return sorted([*alone, *_parts(beside, bits, "wall"), *_parts(rest.join(walls, "at", "left_anti"), bits)])


def cuts(groups: DataFrame, shards: int, bits: int = FINE_BITS, most_rows: int = MOST_ROWS) -> tuple[list[int], int]:
    """From groups (key, size): keys at which shards 1, 2, ... begin, and the capacity."""
    parts = first_parts(groups, bits)
    if not parts:
        return [], 0
    low = max(max(p.largest for p in parts), -(-sum(p.size for p in parts) // shards))
    while True:
        ends = list(accumulate(p.size for p in parts))
        # a walk that never cuts a part needs this capacity; the least one lies between
        high = least_capacity(ends, max(low, max(p.size for p in parts)), ends[-1], shards)
        # which parts can the j-th cut fall into, for any capacity from low to high?
        wanted, behind = set(), 0
        for far in furthest(parts, ends, high, shards):
            behind = bisect_right(ends, (ends[behind - 1] if behind else 0) + low)
            wanted.update(i for i in range(behind, min(bisect_right(ends, far), len(parts) - 1) + 1) if parts[i].n > 1)
        if not wanted:
            break
        more = max(1, (most_rows // len(wanted)).bit_length() - 1)
        parts = sorted([*(p for i, p in enumerate(parts) if i not in wanted), *_split(groups, [parts[i] for i in sorted(wanted)], more)])
    capacity = least_capacity(ends, low, high, shards)
    return [parts[c].first for c in walk(ends, capacity, shards)[:-1] if c < len(parts)], capacity


def _split(groups: DataFrame, parts: list[Part], more: int) -> list[Part]:
    """These parts by further bits of the key."""
    out = []
    for bits in {p.bits for p in parts}:
        own = [p for p in parts if p.bits == bits]
        bounds = groups.sparkSession.createDataFrame([(p.first >> (64 - bits), p.first, p.last) for p in own], "at long, first long, last long")
        inside = groups.withColumn("at", _range(F.col("key"), bits)).join(bounds, "at").where(F.col("key").between(F.col("first"), F.col("last"))).drop("at")
        out += _parts(inside, min(64, bits + more), "first")
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, law: str = "bytes", bits: int = FINE_BITS, most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard), one for each row of docs.

    size is the UTF-8 bytes of the text (null: none) plus 1. Law `bytes` bounds the bytes of a shard, `rows` its rows, each by the
    smallest capacity that keeps equal texts together in hash order. A group larger than the rest fills a shard alone or with
    neighbours. slot numbers the rows of a shard from 0 without gaps, ordered within a part of the shard by id, then checksum.
    Null texts are one group, apart from empty ones; null ids are rows like others. Empty in, empty out.
    """
    if law not in LAWS:
        raise ValueError(f"law is one of {LAWS}")
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"), _key(F.col(text_col)).alias("key"), F.monotonically_increasing_id().alias("row")
    )
    rows = written(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size" if law == "bytes" else F.lit(1)).cast("long").alias("size"), F.count("*").alias("n"))
    groups = written(groups, "groups")
    begins, _ = cuts(groups, shards, bits, most_rows)
    place = F.lit(0)
    for k in begins:
        place = place + (F.col("key") >= F.lit(k)).cast("int")
    many = groups.agg(F.sum("n")).first()[0] or 0
    parts = max(-(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards), -(-many // (shards * PART_ROWS)))
    rows = rows.select("doc_id", "size", "text_crc32", place.alias("shard"), F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("part"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))  # shards * parts rows
    offsets = written(counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "offsets")
    own = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("own") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
