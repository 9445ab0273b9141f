"""Target-distribution importance resampling: documents are drawn in proportion to how much more likely their words are in a target.

1. Words and runs of words are hashed into BUCKETS; tasks count theirs as arrays, and the sums (BUCKETS numbers) give each bucket's
   gain, the log ratio of its share in the target to that in the corpus.
2. A document's weight is the sum of the gains of its features, looked up in that array. A Gumbel number from a hash of its id is added:
   the highest scores are then a draw without replacement in proportion to exp(weight).
3. The k-th highest key (score, then smaller id, then place in the written table) is found by radix selection: digits of DIGIT bits from the top,
   each a grouped count of the rows that agree with the digits before, so at most 2^DIGIT numbers reach the driver for each digit.
4. Only rows up to that key are sorted, by ranges, and numbered by adding up the sizes of the ranges.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import REMEMBERED, in_parts, mapped, texts
from kerbline.session import written

BUCKETS, ORDER, SEED = 10_000, 1, 2024
#: Words that a document needs to be drawn, and documents drawn of a hundred.
LEAST_WORDS, PERCENT = 20, 10
#: Bits of a digit of the selection.
DIGIT = 12
_TOP = -(1 << 63)
#: A-Z to a-z; 0-9, a-z and all bytes of other characters as they are; the rest to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Buckets(dict):
    """word or run of words -> its bucket, remembered."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[feature] = zlib.crc32(feature) % self.size
        return value

    def of(self, text: bytes, order: int) -> tuple[int, np.ndarray]:
        """How many words the text has, and the bucket of each run of 1 to `order` words."""
        words = text.translate(_FOLD).split()
        runs = [words, *([b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] for k in range(2, order + 1))]
        return len(words), np.fromiter(map(self.__getitem__, itertools.chain(*runs)), np.int64, sum(map(len, runs)))


def _counts(size: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, total = Buckets(size), np.zeros(size, np.int64)
        for part in in_parts(batches):
            for text in texts(part.column(0)):
                total += np.bincount(buckets.of(text, order)[1], minlength=size)
        held = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", size: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    out = np.zeros(size, np.int64)
    rows = mapped(docs.select(text_col), _counts(size, order), "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    for bucket, n in rows.collect():  # at most `size` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's share, one added to each count."""
    size, all_s, all_t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + size) / (float(s + 1) * float(all_t + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighted(gain: np.ndarray, order: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, row = Buckets(len(gain)), TaskContext.get().partitionId() << 33
        for part in in_parts(batches):
            found = [buckets.of(text, order) for text in texts(part.column(1))]
            n_words, n, weight = [f[0] for f in found], [len(f[1]) for f in found], [int(gain[f[1]].sum()) for f in found]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (range(row, row + part.num_rows), n_words, n, weight))], names)
            row += part.num_rows

    return run


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number from the first 32 bits of a hash of seed and id; a null id counts as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BUCKETS, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """Rows (id, row, n_words, n_features, weight, score), written: one for each row of docs, row a number of its own."""
    gain = gains(bucket_counts(docs, text_col, size, order), bucket_counts(target, "text", size, order))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "row", "n_words", "n_features", "weight"]
    rows = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), _weighted(gain, order, names), f"id {kind}, row long, n_words long, n_features long, weight long")
    return written(rows.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scores")


def upto(rows: DataFrame, keys: list[str], k: int, digit: int = DIGIT) -> Column:
    """The condition that holds for the k first rows in the order of these long columns, which together tell rows apart.

    A column's values are read as unsigned numbers (the sign bit turned), digit by digit below what all share. As soon as all rows that
    agree with the digits so far are wanted, the rest need not be told.
    """
    if k <= 0:
        return F.lit(False)
    bounds: list[tuple[str, int, int]] = []
    for key in keys:
        low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
        if n <= k:
            bounds.append((key, low, high)) if n else None
            break
        low, high = low - _TOP, high - _TOP
        width = (low ^ high).bit_length()
        prefix = low >> width
        while width and n > k:
            step = min(digit, width)
            width -= step
            own = F.shiftrightunsigned(F.col(key).bitwiseXOR(F.lit(_TOP)), width).bitwiseAND(F.lit((1 << step) - 1))
            for value, n in sorted(rows.groupBy(own.alias("digit")).count().collect()):  # at most 2^step rows
                if n >= k:
                    break
                k -= n
            prefix = prefix << step | value
            rows = rows.where(F.col(key).between((prefix << width) + _TOP, (prefix + 1 << width) - 1 + _TOP))
        bounds.append((key, (prefix << width) + _TOP, (prefix + 1 << width) - 1 + _TOP))
        if n <= k:
            break
    out = F.lit(True)
    for key, low, high in reversed(bounds):
        out = (F.col(key) < low) | (F.col(key).between(low, high) & out)
    return out


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with rank, 1, 2, 3 and so on in the order of the keys: sorted by ranges, each range's ranks begin where the one before ends."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "ranks")  # its range in the upper bits, its place in the lower 33
    sizes = sorted(ordered.groupBy(F.shiftright("at", 33).alias("range")).count().collect())  # a row for each range
    before, starts = 0, []
    for part, n in sizes:
        starts.append((part, before))
        before += n
    starts = spark.createDataFrame(pa.table({"range": pa.array([x for x, _ in starts], pa.int64()), "before": pa.array([x for _, x in starts], pa.int64())}))
    return ordered.join(starts, F.shiftright("at", 33) == starts.range).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "range", "before")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, size: int = BUCKETS, order: int = ORDER, seed: int = SEED
) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of docs; rank is null for those not drawn.

    Of the N rows with least_words words or more, floor(percent * N / 100) are drawn: highest scores first, ties to smaller ids, null
    ids last, then in the order in which they were written (rows of one id and score differ in nothing else that counts). The id is a
    whole number. Null and empty texts have no features and weight 0. An empty target or corpus counts zero; empty in, empty out.
    """
    every = scored(docs, target, id_col, text_col, size, order, seed)
    first, second = F.negate("score").alias("down"), F.col("id").isNull().cast("long").alias("none")
    keyed = every.select("*", first, second, F.coalesce(F.col("id").cast("long"), F.lit(0)).alias("least"))
    keys, may = ["down", "none", "least", "row"], F.col("n_words") >= least_words
    chosen = may & upto(keyed.where(may).select(*keys), keys, every.where(may).count() * percent // 100)
    drawn = numbered(keyed.where(chosen), keys).select("id", "n_features", "weight", "score", "rank")
    rest = keyed.where(~chosen).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest).withColumnRenamed("id", "doc_id")
