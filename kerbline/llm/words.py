"""Words as the operators see them: maximal runs of bytes outside space, \\t, \\n, \\v, \\f, \\r, kept as UTF-8 bytes.

bytes.split() and bytes.lower() follow ASCII only, so both agree with [^\\x20\\x09-\\x0D]+ and A-Z.
"""

from __future__ import annotations

import ctypes
import inspect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Words remembered by a worker; past it the memory is emptied, so it stays bounded.
REMEMBERED = 150_000
#: Bytes of a batch sent to a worker, about; a longer text goes alone.
BATCH_BYTES = "8m"


class WordHashes(dict):
    """word -> 64-bit hash, remembered."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class TextHashes:
    """64-bit hashes of all words of texts, by array operations on their bytes: a word's is the sum over its bytes of a random number for the
    byte times a power of an odd number for its place, mixed; sums over a whole buffer give each word's as a difference."""

    #: Bytes handled at a time, about; a longer text is cut between words.
    PIECE = 1 << 18

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * self.PIECE:  # one very long word: not kept
            return tuple(self._run(b, n) for b in (self.base, pow(self.base, -1, 1 << 64)))
        if n > len(self.up):
            self.up, self.down = (self._run(b, 2 * self.PIECE) for b in (self.base, pow(self.base, -1, 1 << 64)))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x, out=x)

    def __call__(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hashes of the words of all texts in a row; of each text how many words it has, and how many code points these have."""
        words, chars = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        out, held, of, size = [np.zeros(0, np.uint64)], [], [], 0
        for i, text in enumerate(docs):
            for piece in _between_words(text, self.PIECE):
                held.append(piece)
                of.append(i)
                size += len(piece) + 1
                if size >= self.PIECE:
                    self._add(held, of, out, words, chars)
                    held, of, size = [], [], 0
        if held:
            self._add(held, of, out, words, chars)
        return np.concatenate(out), words, chars

    def _add(self, pieces: list[bytes], of: list[int], out: list[np.ndarray], words: np.ndarray, chars: np.ndarray) -> None:
        a = np.frombuffer(b"\n".join([b"", *pieces, b""]), np.uint8)
        blank = (a == 32) | ((a >= 9) & (a <= 13))
        turn = np.nonzero(blank[1:] != blank[:-1])[0] + 1  # it begins and ends with a blank
        start, stop = turn[::2], turn[1::2]
        up, down = self._powers(len(a))
        total = np.cumsum(np.where(blank, np.uint64(0), self.table[a]) * up)  # wraps, as meant
        out.append(mix((total[stop - 1] - total[start - 1]) * down[start]))
        ends = np.cumsum([len(p) + 1 for p in pieces])
        np.add.at(words, of, np.diff(np.searchsorted(start, ends), prepend=0))
        seen = np.cumsum(~blank & ((a & 0xC0) != 0x80))
        np.add.at(chars, of, np.diff(seen[ends], prepend=0))


_blank = re.compile(rb"[ \t-\r]")


def _between_words(text: bytes, size: int) -> Iterator[bytes]:
    """The text in pieces of about this size that end between words."""
    at = 0
    while len(text) - at > 2 * size and (m := _blank.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The texts of an Arrow column as bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64, a bijection of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes; as many as fit."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    b, out = np.uint64(base), h[:n].copy()
    for j in range(1, k):
        out *= b
        out += h[j : j + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def in_parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in record batches of at most `rows`, so that the working memory does not follow the batch size."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same, giving memory back when its partition ends: the worker waits beside the JVM for the next task."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidied_groups(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of one group, or of two that belong together."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            give_back()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            give_back()

    return two if len(inspect.signature(run).parameters) == 2 else one


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run) in batches of BATCH_BYTES unless the session sets a size: rows are no bound, as texts are of any length."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(tidied(run), schema)
