"""Probabilistic suffix tree: a language model whose contexts are as long as the corpus supports.

A state is a context, the last 1 to DEPTH words before a place; the root is the empty context. The next-word distribution of a state s
is smoothed by that of its longest retained proper suffix: P(x|s) = (c(s,x) + ALPHA P(x|suffix)) / (n(s) + ALPHA); the root has one added
to the count of each word and of one unknown word. A context is retained by a divergence test: the cross-validated estimate of
n(s) KL(next words of s || distribution of its suffix),

    sum over x of c(s,x) (log P'(x|s) - log P(x|suffix)),   P'(x|s) = (c(s,x) - 1 + ALPHA P(x|suffix)) / (n(s) - 1 + ALPHA),

where each occurrence is left out of its own prediction, must reach LEAST_GAIN nats. A context seen once has a divergence of 0, so only
contexts seen twice or more need a test. A place is scored by the state of its longest retained suffix.

The tree lies nowhere as a whole. Texts are held as chunks of word numbers, written; what grows with the corpus is dealt by hash:

1. Words: each chunk sends its words with their counts to buckets, which add them up and send the sums back to each chunk.
2. Level 1, 2, ... DEPTH: each chunk sends its distinct (context, next word) whose context was seen twice or more (it knows that from the
   level before), sorted and packed, to the bucket of the context's hash. A bucket merges what all chunks sent, tests its contexts and
   sends back the sums and the verdicts, which the chunk adds to what it holds.
   A context seen over HOT times would make its bucket large: its rows are dealt over all buckets by the next word too. Its count is
   known to the senders, so only the test needs a sum over buckets; there are at most MOST_HOT such contexts, by the threshold.
3. Each chunk, holding the counts of all its places at all levels, has their probabilities and adds them up by text.

All counts are whole numbers and each probability is made from them in the same order everywhere, so a run gives the same doubles
however tasks are dealt.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.words import TextHashes, in_parts, mapped, mix, texts, tidied_groups
from kerbline.session import forget, written

DEPTH, ALPHA, LEAST_GAIN = 2, 4.0, 3.0
#: Bytes of text that a chunk holds, and that a bucket stands for; least number of buckets.
CHUNK_BYTES, BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 8 << 20, 16
#: A context is hot if it was seen so often and has this share of all places or more, so there are at most MOST_HOT at a level.
HOT, MOST_HOT = 1 << 16, 1 << 20
_START, _END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC2B2AE3D27D4EB4F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Of a next word's hash so many bits are sent; two words would have to share them after the same context to be mistaken.
NEXT_BITS = 48

_hashes = TextHashes(17)


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, not negative, as planes of bytes, compressed: as many planes as the largest needs, which the first byte tells."""
    x = np.ascontiguousarray(x, np.uint64)
    width = max(1, int(x.max()).bit_length() + 7 >> 3) if len(x) else 1
    return bytes([width]) + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, size: int) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(pa.decompress(memoryview(data)[1:], size * width, "zstd", asbytes=True), np.uint8).reshape(width, size)
    out = planes[0].astype(np.uint64)
    for i in range(1, width):
        out |= planes[i].astype(np.uint64) << np.uint64(8 * i)
    return out.view(np.int64)


def widths(x: np.ndarray) -> bytes:
    """Sorted hashes as packed differences."""
    return pack(np.diff(x, prepend=np.uint64(0)))


def hashes(data: bytes, size: int) -> np.ndarray:
    return np.cumsum(unpack(data, size).view(np.uint64))


def in_order(a: np.ndarray, b: np.ndarray, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of numbers, b below n_b: an order by a, then b, and where in it a new pair begins. One sort of one number."""
    key = a * n_b + b
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return order, fresh


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """By ranges of the hash, so that sorted hashes have sorted buckets."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def chain(root: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], n_all: int, n_words: int, alpha: float) -> np.ndarray:
    """Probabilities from the counts of the word, and for each level the occurrences of the context (0: not retained) and of the word after it."""
    p = (root + 1) / (n_all + n_words + 1)
    for seen, count in levels:
        p = np.where(seen > 0, (count + alpha * p) / (seen + alpha), p)
    return p


# ---------------------------------------------------------------- chunks


class Chunk:
    """Texts as numbers of sorted words, with all that is known of each place so far."""

    def __init__(self, words: np.ndarray, ranks: np.ndarray, sizes: np.ndarray, held: np.ndarray, totals: np.ndarray | None = None, kept: list | None = None, counts: list | None = None):
        self.words, self.ranks, self.sizes, self.held, self.totals = words, ranks, sizes, held, totals
        #: For each level and place: whether its context is retained, and how often it was seen with this word (0 if not asked).
        self.kept, self.counts = kept or [], counts or []

    @classmethod
    def of(cls, docs: list[bytes], held: list[bool]) -> Chunk:
        h, size, _ = _hashes([t.lower() for t in docs])
        ends = np.cumsum(size) + np.arange(len(docs))
        tokens = np.empty(len(h) + len(docs), np.uint64)
        inner = np.ones(len(tokens), bool)
        inner[ends] = False
        tokens[inner], tokens[ends] = h, _END
        words, ranks = np.unique(tokens, return_inverse=True)
        return cls(words, ranks.astype(np.int32), size + 1, np.array(held, bool))

    @classmethod
    def from_row(cls, r: dict) -> Chunk:
        n = r["n_places"]
        totals = unpack(r["totals"], r["n_words"]) if r["totals"] is not None else None
        kept, counts = [unpack(x, n) > 0 for x in r["kept"]], [unpack(x, n) for x in r["counts"]]
        return cls(hashes(r["words"], r["n_words"]), unpack(r["ranks"], n).astype(np.int32), np.array(r["sizes"], np.int64), np.array(r["held"], bool), totals, kept, counts)

    def row(self, chunk: int, ids: list) -> dict:
        out = {"chunk": chunk, "ids": ids, "held": self.held.tolist(), "sizes": self.sizes.tolist(), "n_words": len(self.words), "n_places": len(self.ranks), "words": widths(self.words)}
        out |= {"ranks": pack(self.ranks), "totals": None if self.totals is None else pack(self.totals)}
        return out | {"kept": [pack(x) for x in self.kept], "counts": [pack(x) for x in self.counts]}

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.ranks[self.trained()], minlength=len(self.words))

    def occurrences(self, level: int) -> np.ndarray:
        """How often the context of each place was seen: as often as what it ends with came after the rest of it. 0 where a text begins too late."""
        before = self.totals[self.ranks] if level == 1 else self.counts[level - 2]
        out = np.append(0, before[:-1])[: len(before)]
        out[self.starts()] = self.totals[np.searchsorted(self.words, _END)] if level == 1 else 0  # as many starts as ends
        return out

    def retained(self, level: int) -> np.ndarray:
        """How often the context of each place was seen, 0 if it is not retained."""
        return np.where(self.kept[level - 1], self.occurrences(level), 0)

    def contexts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the level after those known: the places whose context was seen twice or more, the context's hash of 56 bits, and how often it was seen."""
        level = len(self.kept) + 1
        seen = self.occurrences(level)
        at = np.nonzero(seen > 1)[0]
        into = at - np.repeat(self.starts(), self.sizes)[at]
        h = np.zeros(len(at), np.uint64)
        for back in range(1, level + 1):
            h = mix(h * _ODD + np.where(into >= back, self.words[self.ranks[at - back]], _START))
        return at, h & ~np.uint64(0xFF), seen[at]

    def probabilities(self, n_all: int, n_words: int, alpha: float) -> np.ndarray:
        return chain(self.totals[self.ranks], [(self.retained(i + 1), x) for i, x in enumerate(self.counts)], n_all, n_words, alpha)


def chunk_schema(kind: str) -> str:
    return f"chunk long, ids array<{kind}>, held array<boolean>, sizes array<int>, n_words int, n_places int, words binary, ranks binary, totals binary, kept array<binary>, counts array<binary>"


def _arrow(id_type: pa.DataType) -> pa.Schema:
    of = {"ids": pa.list_(id_type), "held": pa.list_(pa.bool_()), "sizes": pa.list_(pa.int32()), "n_words": pa.int32(), "n_places": pa.int32(), "kept": pa.list_(pa.binary()), "counts": pa.list_(pa.binary())}
    return pa.schema([(c, of.get(c, pa.int64() if c == "chunk" else pa.binary())) for c in ("chunk", "ids", "held", "sizes", "n_words", "n_places", "words", "ranks", "totals", "kept", "counts")])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, held, text) to chunks of CHUNK_BYTES, or of one longer text."""
    chunk, ids, held, docs, size, schema = TaskContext.get().partitionId() << 33, [], [], [], 0, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([Chunk.of(docs, held).row(chunk, ids)], schema)

    for part in in_parts(batches):
        schema = _arrow(part.column(0).type)
        for i, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
            ids.append(i)
            held.append(h)
            docs.append(text)
            size += len(text)
            if size >= CHUNK_BYTES:
                yield out()
                chunk, ids, held, docs, size = chunk + 1, [], [], [], 0
    if docs:
        yield out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _cuts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.append(np.nonzero(np.append(True, x[1:] != x[:-1]))[0], len(x)) if len(x) else np.zeros(1, np.int64)


# ---------------------------------------------------------------- words

WORDS = "bucket int, chunk long, size int, words binary, n binary"
SUMS = "bucket int, chunk long, size int, n binary, total long, distinct long"


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            chunk = Chunk.from_row(r)
            n, bucket = chunk.word_counts(), bucket_of(chunk.words, buckets)
            cuts = _cuts(bucket)
            rows = [{"bucket": int(bucket[i]), "chunk": r["chunk"], "size": int(j - i), "words": widths(chunk.words[i:j]), "n": pack(n[i:j])} for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("n", pa.binary())]))

    return run


def _word_sums(table: pa.Table) -> pa.Table:
    """WORDS of a bucket to SUMS: for each chunk the counts of its words over all chunks; on the first row, how many there are."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    words, at = np.unique(np.concatenate([hashes(r["words"], r["size"]) for r in rows]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unpack(r["n"], r["size"]) for r in rows]), minlength=len(words)).astype(np.int64)
    out, done = [], 0
    for i, r in enumerate(rows):
        own = n[at[done : done + r["size"]]]
        done += r["size"]
        out.append({"bucket": r["bucket"], "chunk": r["chunk"], "size": r["size"], "n": pack(own), "total": 0 if i else int(n.sum()), "distinct": 0 if i else int((n > 0).sum())})
    return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("size", pa.int32()), ("n", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())]))


def _told(chunk: pa.Table, sums: pa.Table) -> pa.Table:
    """A chunk, with the counts of its words."""
    rows = []
    for r in chunk.to_pylist():
        own = Chunk.from_row(r)
        own.totals = np.concatenate([unpack(s["n"], s["size"]) for s in sorted(sums.to_pylist(), key=lambda s: s["bucket"])])
        rows.append(own.row(r["chunk"], r["ids"]))
    return pa.Table.from_pylist(rows, _arrow(chunk.schema.field("ids").type.value_type))


# ---------------------------------------------------------------- contexts

#: seen: of each context, at each level up to its own, how often that suffix of it was seen (0: not retained). counts: of each next word,
#: at each level before, how often it came after that suffix; the first is how often it came at all.
GRAMS = "bucket int, chunk long, n_contexts int, n_grams int, contexts binary, runs binary, seen array<binary>, next binary, n binary, counts array<binary>"
VERDICTS = "bucket int, chunk long, n_contexts int, n_grams int, n binary, kept binary, hot array<struct<context:long,seen:long,gain:double>>"
_VERDICTS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n_contexts", pa.int32()), ("n_grams", pa.int32()), ("n", pa.binary()), ("kept", pa.binary()), ("hot", pa.list_(pa.struct([("context", pa.int64()), ("seen", pa.int64()), ("gain", pa.float64())])))])
_GRAMS = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("n_contexts", pa.int32()), ("n_grams", pa.int32()), ("contexts", pa.binary()), ("runs", pa.binary()), ("seen", pa.list_(pa.binary())), ("next", pa.binary()), ("n", pa.binary()), ("counts", pa.list_(pa.binary()))])


class Filed:
    """A chunk's distinct (context, next word) of the next level, in the order in which buckets get them."""

    def __init__(self, chunk: Chunk, buckets: int, hot: int):
        self.at, context, seen = chunk.contexts()
        rank = chunk.ranks[self.at]
        x = chunk.words[rank] & np.uint64((1 << NEXT_BITS) - 1)
        order, fresh = in_order(np.unique(context, return_inverse=True)[1], rank, len(chunk.words))
        bucket = bucket_of(context, buckets)
        often = seen >= hot
        if often.any():
            bucket[often] = (mix(context[often] + x[often] * _ODD) % np.uint64(buckets)).astype(np.int64)
            moved = np.argsort(bucket[order].astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
            order, fresh = order[moved], fresh[moved]  # equal ones lie in one bucket, and stay together
        context, x, bucket = context[order], x[order], bucket[order]
        self.begin = np.nonzero(fresh)[0]
        #: Of each place, which of the distinct ones it is.
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(fresh) - 1
        self.context, self.next, self.bucket = context[self.begin], x[self.begin], bucket[self.begin]
        self.place, self.seen = self.at[order[self.begin]], seen[order[self.begin]]

    def rows(self, chunk: Chunk, number: int) -> Iterator[dict]:
        n = np.bincount(self.which[chunk.trained()[self.at]], minlength=len(self.begin))
        seen, counts = [chunk.retained(i + 1)[self.place] for i in range(len(chunk.kept))] + [self.seen], [chunk.totals[chunk.ranks[self.place]]] + [x[self.place] for x in chunk.counts]
        cuts = _cuts(self.bucket)
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            runs = _cuts(self.context[i:j])
            first = i + runs[:-1]
            yield {
                "bucket": int(self.bucket[i]), "chunk": number, "n_contexts": len(first), "n_grams": int(j - i), "contexts": widths(self.context[first]), "runs": pack(np.diff(runs)),
                "seen": [pack(x[first]) for x in seen], "next": pack(self.next[i:j].view(np.int64)), "n": pack(n[i:j]), "counts": [pack(x[i:j]) for x in counts],
            }


def _grams(buckets: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            chunk = Chunk.from_row(r)
            held: list[dict] = []
            for row in Filed(chunk, buckets, hot).rows(chunk, r["chunk"]):
                held.append(row)
                if len(held) == 64:
                    yield pa.RecordBatch.from_pylist(held, _GRAMS)
                    held = []
            if held:
                yield pa.RecordBatch.from_pylist(held, _GRAMS)

    return run


def _tested(n_all: int, n_words: int, alpha: float, least_gain: float, hot: int):
    """GRAMS of a bucket to VERDICTS: for each chunk the counts of its rows over all chunks, and which contexts are retained (2: hot, told by
    the sum of the gains that the first row lists)."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        table = None
        runs = [unpack(r["runs"], r["n_contexts"]) for r in rows]
        contexts = np.concatenate([hashes(r["contexts"], r["n_contexts"]) for r in rows])
        heads, told = np.unique(contexts, return_inverse=True)
        nexts, x = np.unique(np.concatenate([unpack(r["next"], r["n_grams"]) for r in rows]), return_inverse=True)
        order, fresh = in_order(np.repeat(told, np.concatenate(runs)), x, len(nexts))
        begin = np.nonzero(fresh)[0]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        one = order[begin]  # of each distinct row, where it stands first
        context = np.repeat(told, np.concatenate(runs))[one]
        del x, nexts, order, fresh
        n = np.bincount(which, weights=np.concatenate([unpack(r["n"], r["n_grams"]) for r in rows]), minlength=len(begin)).astype(np.int64)
        root, *counts = (np.concatenate([unpack(r["counts"][k], r["n_grams"]) for r in rows])[one] for k in range(len(rows[0]["counts"])))
        *lower, own = (np.concatenate([np.repeat(unpack(r["seen"][k], r["n_contexts"]), run) for r, run in zip(rows, runs, strict=True)])[one] for k in range(len(rows[0]["seen"])))
        p = chain(root, list(zip(lower, counts, strict=True)), n_all, n_words, alpha)
        part = np.where(n > 0, n * (np.log(np.maximum(n - 1, 0) + alpha * p) - np.log(p)), 0.0)
        at = _cuts(context)
        seen = own[at[:-1]]
        gain = np.add.reduceat(part, at[:-1]) if len(part) else part
        often = seen >= hot
        kept = np.where(often, 2, gain - seen * np.log(seen - 1 + alpha) >= least_gain).astype(np.int64)
        asked = [{"context": c, "seen": s, "gain": g} for c, s, g in zip(heads[often].view(np.int64).tolist(), seen[often].tolist(), gain[often].tolist(), strict=True)]
        out, done, head = [], 0, 0
        for i, r in enumerate(rows):
            out.append({k: r[k] for k in ("bucket", "chunk", "n_contexts", "n_grams")} | {"n": pack(n[which[done : done + r["n_grams"]]]), "kept": pack(kept[told[head : head + r["n_contexts"]]]), "hot": None if i else asked})
            done, head = done + r["n_grams"], head + r["n_contexts"]
        return pa.Table.from_pylist(out, _VERDICTS)

    return run


def _learned(chunk: Chunk, verdicts: list[dict], buckets: int, hot: int, retained: np.ndarray) -> None:
    """Adds a level's counts to a chunk, from what the buckets sent back."""
    filed = Filed(chunk, buckets, hot)
    kept, count = np.zeros(len(chunk.ranks), bool), np.zeros(len(chunk.ranks), np.int64)
    if verdicts:
        rows = sorted(verdicts, key=lambda r: r["bucket"])
        n = np.concatenate([unpack(r["n"], r["n_grams"]) for r in rows])
        cuts = _cuts(filed.bucket)
        heads = np.concatenate([np.add(i, _cuts(filed.context[i:j])[:-1]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)])
        told = np.concatenate([unpack(r["kept"], r["n_contexts"]) for r in rows])
        told = np.where(told == 2, np.isin(filed.context[heads], retained), told == 1)
        kept[filed.at] = np.repeat(told, np.diff(np.append(heads, len(filed.begin))))[filed.which]
        count[filed.at] = n[filed.which]
    chunk.kept.append(kept)
    chunk.counts.append(count)


def _grown(buckets: int, hot: int, retained):
    def run(chunk: pa.Table, verdicts: pa.Table) -> pa.Table:
        rows = []
        for r in chunk.to_pylist():
            own = Chunk.from_row(r)
            _learned(own, verdicts.to_pylist(), buckets, hot, retained.value)
            rows.append(own.row(r["chunk"], r["ids"]))
        return pa.Table.from_pylist(rows, _arrow(chunk.schema.field("ids").type.value_type))

    return run


def _scored(buckets: int, hot: int, retained, n_all: int, n_words: int, alpha: float):
    """The last level: chunks to a row for each text."""

    def run(chunk: pa.Table, verdicts: pa.Table) -> pa.Table:
        out = []
        for r in chunk.to_pylist():
            own = Chunk.from_row(r)
            if retained is not None:
                _learned(own, verdicts.to_pylist(), buckets, hot, retained.value)
            root = own.totals[own.ranks]
            first = own.starts()
            of = lambda x: np.add.reduceat(x, first)  # noqa: E731, B023  every text has its end
            base, score = of(np.log10(chain(root, [], n_all, n_words, alpha))), of(np.log10(own.probabilities(n_all, n_words, alpha)))
            columns = [pa.array(r["ids"], chunk.schema.field("ids").type.value_type), pa.array(own.held), pa.array(own.sizes), pa.array(of((root > 0).astype(np.int64))), pa.array(base), pa.array(score)]
            out.append(pa.Table.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, depth: int = DEPTH, alpha: float = ALPHA, least_gain: float = LEAST_GAIN, hot: int = HOT,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of docs.

    The model is learned from the rows where held_out is not true (null counts as not held out). A token is a word or the end of a text.
    A null text is empty: one token, its end. Repeated rows count and are scored each, null ids like others. Without any row to learn
    from every token has probability 1 under the base. Empty in, empty out. depth 0 scores by the root alone.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    slim = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    buckets = max(LEAST_BUCKETS, math.ceil((slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / bucket_bytes))
    schema = chunk_schema(kind)
    chunks = written(mapped(slim, _chunked, schema), "chunks")
    sums = written(mapped(chunks, _words(buckets), WORDS).groupBy("bucket").applyInArrow(tidied_groups(_word_sums), SUMS), "sums")
    n_all, n_words = (x or 0 for x in sums.agg(F.sum("total"), F.sum("distinct")).first())
    now = written(chunks.groupBy("chunk").cogroup(sums.groupBy("chunk")).applyInArrow(tidied_groups(_told), schema), "chunks")
    forget(chunks)
    forget(sums)
    hot = max(hot, n_all // MOST_HOT)
    result = f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    retained = None
    for level in range(1, depth + 1):
        verdicts = written(mapped(now, _grams(buckets, hot), GRAMS).groupBy("bucket").applyInArrow(tidied_groups(_tested(n_all, n_words, alpha, least_gain, hot)), VERDICTS), "verdicts")
        asked = verdicts.select(F.explode("hot").alias("h")).groupBy(F.col("h.context").alias("context")).agg(F.sum("h.gain").alias("gain"), F.first("h.seen").alias("seen"))
        asked = asked.where(F.col("gain") - F.col("seen") * F.log(F.col("seen") - 1 + alpha) >= least_gain)
        retained = spark.sparkContext.broadcast(np.array([r.context for r in asked.select("context").collect()], np.int64).view(np.uint64))  # at most MOST_HOT
        pairs = now.groupBy("chunk").cogroup(verdicts.drop("hot").groupBy("chunk"))
        if level < depth:
            after = written(pairs.applyInArrow(tidied_groups(_grown(buckets, hot, retained)), schema), "chunks")
            forget(now)
            forget(verdicts)
            now = after
    if depth == 0:
        pairs = now.groupBy("chunk").cogroup(now.limit(0).groupBy("chunk"))
    out = written(pairs.applyInArrow(tidied_groups(_scored(buckets, hot, retained, n_all, n_words, alpha)), result), "scored")
    forget(now)
    if depth:
        forget(verdicts)
    return out.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
