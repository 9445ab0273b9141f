"""Vector code compression: product quantisation whose nearest entries are found by a float32 matrix product and proven in int64.

Components become the integers floor(SCALE * x); a vector is cut into PARTS equal parts, each with a codebook of at most ENTRIES
entries. The nearest entry of all parts of a batch is screened by one matrix product in float32, t = |c|^2 - 2 x.c, with an interval
around each value that holds the true one whatever the order of summation:

    |fl(t) - t| <= gamma(d + 4) * (|c|^2 + 2 |x| |c|),   gamma(n) = n u / (1 - n u),   u = 2^-24

(2 roundings for the factors' conversion, d for the product in any order, 2 for |c|^2 and the difference). Every entry whose interval
overlaps the best one's is evaluated again in int64, and the least distance, then the least index, wins. So the result is that of
whole numbers, on any machine and BLAS.

A round sends each task's sums and counts of each entry, at most PARTS * ENTRIES rows, so codebooks (a fixed size) are all that the
driver sees and tasks are sent.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import in_parts, mapped
from kerbline.session import written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Unit roundoff of float32.
UNIT = 2.0**-24


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry to each row of x, both int64 matrices; ties go to the lower index."""
    dim = x.shape[1]
    gamma = (dim + 4) * UNIT / (1 - (dim + 4) * UNIT)
    square = (entries * entries).sum(axis=1)
    t = square.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ entries.T.astype(np.float32))
    far, long = math.sqrt(int(square.max())), np.sqrt((x * x).sum(axis=1).astype(np.float64))
    bound = gamma * far * (far + 2 * long) * (1 + 2.0**-40)  # of float64's own roundings here
    most = np.nextafter((t.min(axis=1) + 2 * bound).astype(np.float32), np.float32(np.inf))
    row, col = np.nonzero(t <= most[:, None])
    apart = x[row] - entries[col]
    d = (apart * apart).sum(axis=1)
    starts = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(d, starts) if len(x) else d
    hit = np.nonzero(d == least[row])[0]
    first = hit[np.append(True, row[hit][1:] != row[hit][:-1])] if len(hit) else hit
    return col[first], least


def largest(dim: int) -> int:
    """Components are held to this size, so that int64 holds the squared distance of any two vectors."""
    return math.isqrt((1 << 62) // dim) // 2


def whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Vectors as rows of integers."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, dim)
    return np.clip(x, -largest(dim), largest(dim)).astype(np.int64)


@dataclass
class Codebooks:
    """Entries of all parts: an array (parts, entries, components)."""

    entries: np.ndarray

    def cut(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), len(self.entries), -1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector the index of each part, and the squared distances summed."""
        parts = self.cut(x)
        found = [screened(np.ascontiguousarray(parts[:, i]), own) for i, own in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), sum(f[1] for f in found)


def usable(vector: Column) -> Column:
    """The vector is there, and so are all its components, as finite numbers."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _sums(books: Codebooks, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, each = books.entries.shape
        total, count = np.zeros((parts, size, each), np.int64), np.zeros((parts, size), np.int64)
        for batch in in_parts(batches, 8192):
            x = whole(batch.column(0), dim, scale)
            codes, _ = books.codes(x)
            cut = books.cut(x)
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                own = codes[order, p]
                at = np.nonzero(np.append(True, own[1:] != own[:-1]))[0]
                total[p, own[at]] += np.add.reduceat(cut[order, p], at, axis=0)
                count[p] += np.bincount(own, minlength=size)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def _coded(books: Codebooks, dim: int, scale: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_parts(batches, 8192):
            codes, error = books.codes(whole(batch.column(batch.num_columns - 1), dim, scale))
            text = [bytes(c).hex() for c in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(text, pa.string()), pa.array(error)], names)

    return run


def trained(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of vectors (id, vector) of one length, begun with the parts of those with the smallest ids (ties by the vector, null ids
    last): each round replaces every entry by the floor of the mean of its parts, and leaves unused ones."""
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector")
    start = whole(first.toArrow().column(0).combine_chunks(), dim, scale)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        sums = mapped(vectors.select("vector"), _sums(books, dim, scale), "part int, entry int, n long, total array<long>")
        exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(dim // parts)]
        new = books.entries.copy()
        for part, entry, n, *total in sums.groupBy("part", "entry").agg(F.sum("n"), *exact).collect():  # at most parts * entries rows
            new[part, entry] = [int(t) // n for t in total]
        books = Codebooks(new)
    return books


def compress(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256), one for each vector kept.

    Dropped: null vectors, those with a null or non-finite component, and those of another length than the first usable vector (by id,
    null ids last) whose length is a positive multiple of `parts`. Repeated ids are vectors of their own. Components beyond largest()
    are held to it. Fewer vectors than entries make smaller codebooks. label_error adds error over equal labels, null labels together;
    it is null if it is beyond a long. Empty in, empty out. At most 256 entries, as a code is two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook holds 1 to 256 entries")
    kept = table.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    kept = kept.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    kind, label = kept.schema["id"].dataType.simpleString(), kept.schema["label"].dataType.simpleString()
    head = kept.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    if head is None:
        return table.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    dim = head[0]
    kept = kept.where(F.size("vector") == dim)
    books = trained(kept.select("id", "vector"), dim, parts, entries, rounds, scale)
    coded = written(mapped(kept, _coded(books, dim, scale, ["id", "label", "code", "error"]), f"id {kind}, label {label}, code string, error long"), "codes")
    by = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint").alias("label_error"))
    out = coded.join(by, coded.label.eqNullSafe(by.of))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
