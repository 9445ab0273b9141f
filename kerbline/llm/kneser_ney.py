"""Quality rules: counts that any text has, and the perplexity of its words under a modified Kneser-Ney model of its language.

The model is over words of order two: the probability of a word after the one before it (or after the start of the text), with the
modified discounts, interpolated with how many different words it follows, and that with the uniform distribution. There is one
model for each value of the language column, over all words of all documents but those that noise makes no example of the language (see
is_noisy), and what is gathered grows with them. Texts are dealt into two folds by their hash, and each is scored by what the other
fold holds, so that neither its own words nor its exact copies make it look probable: a text of words that nobody else uses, or of
noise, has a high perplexity, and one that dozens of others hold nearly word by word a very low one.

No task holds a model. Words are hashes of 40 bits; the pairs of a language are filed under buckets by the hash of the first word,
as many as the corpus needs, and a bucket is a set of sorted hash arrays:

1. A pass over the texts gives the counts of each, and finds frequent first words: those with a bucket's share of all pairs or
   more, at most some four in three buckets and never over MOST_HOT, by one text in SAMPLED (what is found decides where pairs go,
   and nothing else). Their pairs are dealt over all buckets by both words, so no word makes a bucket large.
2. Each chunk of texts sends a bucket its distinct pairs as sorted arrays; a bucket merges them, which gives counts of counts and
   how many pairs each second word ends. These numbers are added up by second word and sent back.
3. Each chunk sends its pairs again, now with the documents that hold them. A bucket merges the arrays, has the probability of each
   pair by bisection and sends each document's sum back. This runs in ROUNDS parts of the buckets, to keep the disk small.

A text's figure is the mean log perplexity of its words. A language's bounds come from an exact histogram over the documents that
pass the base rules: HIGH quartile distances above the median, LOW below it, the latter never above LEAST_SHARE of the median, as
near copies in the other fold make a text probable, and copies are not bad texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.words import TextHashes, in_parts, mapped, mix, texts, tidied_groups
from kerbline.session import forget, written

SMALLEST = 50
MOST_REPEATED = 50
LOW, HIGH, LEAST_SHARE = 3.0, 7.0, 0.2
#: Steps of a histogram, a unit of log perplexity.
STEPS = 1000
MARKS = b"#*$%&|<>"
#: A text is noisy if more than these shares of its bytes are marks (or !), or capital letters.
NOISE, MOST_NOISE, MOST_CAPITALS = MARKS + b"!", 0.03, 0.4
_CAPITALS = bytes(range(65, 91))
#: Bytes of text that a chunk holds, and that a bucket stands for; parts in which documents are scored.
CHUNK_BYTES, BUCKET_BYTES, ROUNDS = 16 << 20, 16 << 20, 2
BITS = 40
#: Of so many texts one, chosen by its hash, is asked for frequent words.
SAMPLED = 16
#: However large the corpus, a frequent word begins at least one of so many pairs, so that there are not more of them.
MOST_HOT = 1 << 20
_START, _PAIR = np.uint64(0x9AE16A3B2F90404F), np.uint64(0x9E3779B97F4A7C15)

_hashes = TextHashes(11)


# ---------------------------------------------------------------- arrays as bytes


def pack(x: np.ndarray, width: int) -> bytes:
    """Whole numbers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, size: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, size * width, "zstd", asbytes=True), np.uint8).reshape(width, size)
    out = np.zeros((size, 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8")[:, 0].astype(np.int64)


def word_ids(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """By ranges of the hash, so that sorted ids have sorted buckets."""
    return (ids >> 8) * buckets >> BITS - 8


# ---------------------------------------------------------------- counts of one text


def repeated_words(h: np.ndarray, k: int = 3) -> int:
    """Words, given as hashes, that lie in a window of k words found twice or more in the text."""
    n = len(h) - k + 1
    if n < 2:
        return 0
    key = h[:n].copy()
    for j in range(1, k):
        key = key * _PAIR + h[j : j + n]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    at = np.concatenate([order[1:][same], order[:-1][same]])
    cover = np.zeros(len(h), bool)
    for j in range(k):
        cover[at + j] = True
    return int(cover.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def is_noisy(text: bytes) -> bool:
    """Whether a text is no example of a language: the model is not learned from it."""
    n = len(text)
    return n - len(text.translate(None, NOISE)) > MOST_NOISE * n or n - len(text.translate(None, _CAPITALS)) > MOST_CAPITALS * n


_marks = [bytes([x]) for x in MARKS]
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(buckets: int):
    """(doc_id, lang, key, text) to a row of figures for each text, and rows (lang, first, n) of first words that may be frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type, seen = None, {}
        for part in in_parts(batches):
            id_type, langs, rows, firsts = part.column(0).type, part.column(1).to_pylist(), [], {}
            docs = texts(part.column(3))
            words, n_words, n_chars = _hashes(docs)
            ends = np.cumsum(n_words).tolist()
            for lang, key, text, n, chars, end in zip(langs, part.column(2).to_pylist(), docs, n_words.tolist(), n_chars.tolist(), ends, strict=True):
                h = words[end - n : end]
                rows.append((n, chars, sum(map(text.count, _marks)), repeated_lines(text), repeated_words(h)))
                if len(h) and key % SAMPLED == 0:
                    firsts.setdefault(lang, []).append(np.append(_START, h[:-1]))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array(c, pa.int64()) for c in cols), none, none], ["doc_id", "lang", "key", *FIGURES, "first", "n"])
            for lang, found in firsts.items():
                ids, n = np.unique(word_ids(np.concatenate(found)), return_counts=True)
                often = n * 4 * buckets >= n.sum()
                held = seen.setdefault(lang, {})
                for i, x in zip(ids[often].tolist(), n[often].tolist(), strict=True):
                    held[i] = held.get(i, 0) + x
        for lang, held in seen.items():
            size = len(held)
            blank = [pa.nulls(size, pa.int64())] * (1 + len(FIGURES))
            arrays = [pa.nulls(size, id_type), pa.array([lang] * size, pa.string()), *blank, pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "key", *FIGURES, "first", "n"])

    return run


# ---------------------------------------------------------------- pairs of words, from chunks to buckets

#: n0, n1: how often the pair occurs in texts of either fold that are learned from. held: how often at all; at: the texts that hold it, of
#: which the first n_zero are of fold 0.
PAIRS = "bucket int, chunk long, lang string, n_first int, n_pairs int, n_at int, n_zero int, n_keys int, first binary, runs binary, second binary, n0 binary, n1 binary, held binary, at binary, keys binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str | None, int, bytes]]]:
    held, size = [], 0
    for part in in_parts(batches):
        for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), strict=True):
            held.append(row)
            size += len(row[2])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def pairs_of(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word ids in order, and of each word of these texts the rank of the one before it, its own rank, and its text."""
    h, size, _ = _hashes(docs)
    words = word_ids(np.append(_START, h))
    ids, rank = np.unique(words, return_inverse=True)
    rank = rank.astype(np.int32)
    start, cur = rank[0], rank[1:]
    before = np.append(start, cur[:-1])[: len(cur)]
    ends = np.cumsum(size)
    before[(ends - size)[size > 0]] = start
    return ids, before, cur, np.repeat(np.arange(len(docs), dtype=np.int32), size)


def _pairs(buckets: int, often, rounds: int, mine: int, scored: bool):
    """(lang, key, text) to PAIRS: the distinct pairs of each chunk and language, for each bucket of this round; with their texts if scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, chunk = often.value, TaskContext.get().partitionId() << 33
        for held in _chunks(batches):
            for lang in sorted({r[0] for r in held}, key=lambda x: (x is not None, x)):
                own = sorted((r for r in held if r[0] == lang), key=lambda r: r[1] & 1)  # fold 0 first
                chunk += 1
                if rows := list(_filed(own, lang, hot.get(lang, (np.zeros(0, np.int64),))[0], chunk)):
                    yield pa.RecordBatch.from_pylist(rows, schema)

    def _filed(own, lang, hot, chunk):
        ids, before, cur, at = pairs_of([r[2] for r in own])
        keys = np.array([r[1] for r in own], np.int64)
        zeros = int((keys & 1 == 0).sum())
        learned = ~np.array([is_noisy(r[2]) for r in own], bool)
        bucket = bucket_of(ids, buckets)[before]
        dealt = np.isin(ids, hot)[before]
        bucket[dealt] = (mix(ids[before[dealt]].astype(np.uint64) * _PAIR + ids[cur[dealt]].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        here = bucket % rounds == mine
        before, cur, at, bucket = before[here], cur[here], at[here], bucket[here]
        pair = before.astype(np.int64) * len(ids) + cur
        del before, cur, here, dealt
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(bucket[order].astype(np.uint16 if buckets < 1 << 16 else np.int32), kind="stable")]
        pair, bucket, at = pair[order], bucket[order], at[order]
        fresh = np.ones(len(pair), bool)
        fresh[1:] = (pair[1:] != pair[:-1]) | (bucket[1:] != bucket[:-1])
        begin = np.nonzero(fresh)[0]
        one = at >= zeros
        n1 = np.add.reduceat(one & learned[at], begin, dtype=np.int64) if len(begin) else begin
        n0 = np.add.reduceat(~one & learned[at], begin, dtype=np.int64) if len(begin) else begin
        held = np.diff(np.append(begin, len(pair)))
        pair, bucket = pair[begin], bucket[begin]
        first, second = ids[pair // len(ids)], ids[pair % len(ids)]
        cuts = np.append(np.nonzero(np.append(True, bucket[1:] != bucket[:-1]))[0], len(bucket)) if len(bucket) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            run = np.append(np.nonzero(np.append(True, first[i + 1 : j] != first[i : j - 1]))[0], j - i)
            row = {"bucket": int(bucket[i]), "chunk": chunk, "lang": lang, "n_first": len(run) - 1, "n_pairs": int(j - i), "n_at": 0, "n_zero": zeros, "n_keys": 0}
            row |= {"first": pack(np.diff(first[i:j][run[:-1]], prepend=0), 5), "runs": pack(np.diff(run), 4), "second": pack(second[i:j], 5), "n0": pack(n0[i:j], 4), "n1": pack(n1[i:j], 4)}
            if scored:
                told = at[begin[i] : begin[j] if j < len(begin) else len(at)]
                row |= {"n_at": len(told), "at": pack(told, 4), "held": pack(held[i:j], 4)}
                if i == 0:
                    row |= {"n_keys": len(keys), "keys": keys.tobytes()}
            yield row

    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("lang", pa.string()), *((c, pa.int32()) for c in ("n_first", "n_pairs", "n_at", "n_zero", "n_keys")), *((c, pa.binary()) for c in ("first", "runs", "second", "n0", "n1", "held", "at", "keys"))])
    return run


def _rows_by_lang(table: pa.Table) -> dict[str | None, list[dict]]:
    out: dict[str | None, list[dict]] = {}
    for r in table.to_pylist():
        out.setdefault(r["lang"], []).append(r)
    return out


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted arrays of a bucket: first words, for each pair which of them and the second word, its counts in both folds; and where each sent pair went."""
    first = np.concatenate([np.repeat(np.cumsum(unpack(r["first"], r["n_first"], 5)), unpack(r["runs"], r["n_first"], 4)) for r in rows])
    second, n0, n1 = (np.concatenate([unpack(r[c], r["n_pairs"], width) for r in rows]) for c, width in (("second", 5), ("n0", 4), ("n1", 4)))
    firsts, of = np.unique(first, return_inverse=True)
    pairs, went = np.unique(of << BITS | second, return_inverse=True)
    n = np.stack([np.bincount(went, weights=x, minlength=len(pairs)).astype(np.int64) for x in (n0, n1)])
    return firsts, pairs >> BITS, pairs & (1 << BITS) - 1, n, went


def contexts(of: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """Of each first word the total of its pairs, and how many have the counts one, two, three and more."""
    return np.stack([np.bincount(of, weights=n, minlength=size), *(np.bincount(of[n == i], minlength=size) for i in (1, 2)), np.bincount(of[n > 2], minlength=size)], axis=1).astype(np.int64)


def of_counts(n: np.ndarray) -> list[int]:
    return [int((n == c).sum()) for c in (1, 2, 3, 4)]


ENDS = "bucket int, lang string, dest int, size int, second binary, n0 binary, n1 binary, counts array<long>, hot array<array<long>>"


def _counted(buckets: int, often):
    """The pairs of a bucket to ENDS: how many pairs end in each second word, by the bucket of that; on the first row of a language,
    counts of counts and the totals of frequent first words."""

    def run(table: pa.Table) -> pa.Table:
        out, bucket = [], table.column("bucket")[0].as_py()
        for lang, rows in _rows_by_lang(table).items():
            firsts, of, second, n, _ = merged(rows)
            ends, which = np.unique(second, return_inverse=True)
            ways = [np.bincount(which[x > 0], minlength=len(ends)) for x in n]
            dest = bucket_of(ends, buckets)
            cuts = np.append(np.nonzero(np.append(True, dest[1:] != dest[:-1]))[0], len(dest))
            hot = np.nonzero(np.isin(firsts, often.value.get(lang, (np.zeros(0, np.int64),))[0]))[0]
            totals = np.column_stack([firsts[hot], *(contexts(of, x, len(firsts))[hot] for x in n)]).tolist()
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                row = {"bucket": bucket, "lang": lang, "dest": int(dest[i]), "size": int(j - i), "second": pack(np.diff(ends[i:j], prepend=0), 5)} | {f"n{f}": pack(x[i:j], 4) for f, x in enumerate(ways)}
                out.append(row | {"counts": of_counts(n[0]) + of_counts(n[1]) if i == 0 else None, "hot": totals if i == 0 else None})
        return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("dest", pa.int32()), ("size", pa.int32()), ("second", pa.binary()), ("n0", pa.binary()), ("n1", pa.binary()), ("counts", pa.list_(pa.int64())), ("hot", pa.list_(pa.list_(pa.int64())))]))

    return run


WAYS = "bucket int, lang string, dest int, size int, ways0 binary, ways1 binary, counts array<long>, hot array<array<long>>, types array<long>"


def _added(table: pa.Table) -> pa.Table:
    """ENDS of one destination to WAYS: the sums over all buckets, each sent back in its sender's order; on the first row of a language,
    for either fold how many words follow one, two, three, four words, how many there are, and how many pairs."""
    out = []
    for lang, rows in _rows_by_lang(table).items():
        _, of = np.unique(np.concatenate([np.cumsum(unpack(r["second"], r["size"], 5)) for r in rows]), return_inverse=True)
        ways = [np.bincount(of, weights=np.concatenate([unpack(r[c], r["size"], 4) for r in rows])).astype(np.int64) for c in ("n0", "n1")]
        types = [t for x in ways for t in (*of_counts(x), int((x > 0).sum()), int(x.sum()))]
        at = np.append(0, np.cumsum([r["size"] for r in rows]))
        for i, r in enumerate(rows):
            row = {k: r[k] for k in ("bucket", "lang", "dest", "size", "counts", "hot")}
            out.append(row | {f"ways{f}": pack(x[of[at[i] : at[i + 1]]], 5) for f, x in enumerate(ways)} | {"types": types if i == 0 else None})
    return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("dest", pa.int32()), ("size", pa.int32()), ("ways0", pa.binary()), ("ways1", pa.binary()), ("counts", pa.list_(pa.int64())), ("hot", pa.list_(pa.list_(pa.int64()))), ("types", pa.list_(pa.int64()))]))


# ---------------------------------------------------------------- the model


def discounts(c: list[int]) -> np.ndarray:
    """What to take from counts 0, 1, 2, 3 and more, by counts of counts; where these are missing, an absolute discount or a half."""
    n1, n2, n3, n4 = map(float, c)
    if not (n1 and n2):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else y]
    return np.array([0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def log_probabilities(of: np.ndarray, n: np.ndarray, totals: np.ndarray, ways: np.ndarray, counts: list[int], types: list[int]) -> np.ndarray:
    """Of pairs with the first word `of`, the count n and a second word that follows so many words: modified Kneser-Ney, interpolated,
    where any of these may be 0. All words that were never counted share the probability of one."""
    d, e = discounts(counts), discounts(types[:4])
    t1, t2, _, _, many, pairs = types
    rest = (e[1] * t1 + e[2] * t2 + e[3] * (many - t1 - t2)) / pairs if pairs else 1.0
    lower = (ways - e[np.minimum(ways, 3)]) / max(pairs, 1) + rest / (many + 1)
    total = np.maximum(totals[:, 0], 1)
    weight = np.where(totals[:, 0] > 0, (totals[:, 1] * d[1] + totals[:, 2] * d[2] + totals[:, 3] * d[3]) / total, 1.0)
    return np.log((n - d[np.minimum(n, 3)]) / total[of] + weight[of] * lower)


SUMS = "chunk long, size int, at binary, loss binary, n_keys int, keys binary"


def _scored(often):
    """The pairs of a bucket with their texts, and its WAYS with the counts of the language, to SUMS: the losses of each text of a chunk."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        out, by = [], _rows_by_lang(known)
        for lang, rows in _rows_by_lang(table).items():
            firsts, of, second, n, went = merged(rows)
            told = sorted(by[lang], key=lambda r: r["dest"])
            which = np.unique(second, return_inverse=True)[1]
            hot, whole = often.value.get(lang, (np.zeros(0, np.int64), np.zeros((0, 8), np.int64)))
            loss = []
            for f in (1, 0):  # texts of fold 0 are scored by fold 1
                ways = np.concatenate([unpack(r[f"ways{f}"], r["size"], 5) for r in told])[which]
                totals = contexts(of, n[f], len(firsts))
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, firsts), len(hot) - 1)
                    totals = np.where((hot[at] == firsts)[:, None], whole[at][:, 4 * f : 4 * f + 4], totals)
                loss.append(-log_probabilities(of, n[f], totals, ways, told[0]["all_counts"][4 * f :][:4], told[0]["all_types"][6 * f :][:6]))
            done = 0
            for r in rows:
                pair = np.repeat(went[done : done + r["n_pairs"]], unpack(r["held"], r["n_pairs"], 4))
                done += r["n_pairs"]
                at = unpack(r["at"], r["n_at"], 4)
                own = np.where(at < r["n_zero"], loss[0][pair], loss[1][pair])
                docs = np.unique(at)
                sums = np.bincount(at, weights=own)[docs].astype("<f4").tobytes()
                out.append({"chunk": r["chunk"], "size": len(docs), "at": pack(np.diff(docs, prepend=0), 4), "loss": sums, "n_keys": r["n_keys"], "keys": r["keys"]})
        return pa.Table.from_pylist(out, pa.schema([("chunk", pa.int64()), ("size", pa.int32()), ("at", pa.binary()), ("loss", pa.binary()), ("n_keys", pa.int32()), ("keys", pa.binary())]))

    return run


def _summed(table: pa.Table) -> pa.Table:
    """SUMS of one chunk to (key, loss)."""
    rows = table.to_pylist()
    keys = np.frombuffer(next(r["keys"] for r in rows if r["n_keys"]), np.int64)
    loss = np.zeros(len(keys))
    for r in rows:
        loss[np.cumsum(unpack(r["at"], r["size"], 4))] += np.frombuffer(r["loss"], "<f4")
    return pa.table({"key": keys, "loss": loss})


def losses(docs: DataFrame, measured: DataFrame, buckets: int, rounds: int = ROUNDS) -> DataFrame:
    """(key, loss) for each key of docs (lang, key, text) with words: the sum of the negative log probabilities of its words."""
    spark = docs.sparkSession
    sampled = measured.where(F.col("key") % SAMPLED == 0).agg(F.sum("n_words")).first()[0] or 0
    often = measured.where("first is not null").groupBy("lang", "first").agg(F.sum("n").alias("n")).where(F.col("n") >= max(0.75 * sampled / buckets, sampled / MOST_HOT))
    hot: dict[str | None, list[int]] = {}
    for lang, first, _ in often.collect():  # at most MOST_HOT, and at most 4/3 a bucket
        hot.setdefault(lang, []).append(first)
    seen = spark.sparkContext.broadcast({k: (np.sort(np.array(v, np.int64)),) for k, v in hot.items()})
    pairs = mapped(docs, _pairs(buckets, seen, 1, 0, False), PAIRS)
    ends = pairs.groupBy("bucket").applyInArrow(tidied_groups(_counted(buckets, seen)), ENDS)
    ways = written(ends.groupBy("dest").applyInArrow(tidied_groups(_added), WAYS), "ways")
    of = ways.groupBy("lang").agg(*(F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k))).alias(f"all_{c}") for c, k in (("counts", 8), ("types", 12))))
    of = written(of.withColumnRenamed("lang", "of_lang"), "counts")
    known = ways.join(of, ways.lang.eqNullSafe(of.of_lang)).drop("of_lang", "counts", "hot", "types")
    totals: dict[str | None, list[list[int]]] = {}
    for lang, first, *t in ways.select("lang", F.explode("hot").alias("t")).groupBy("lang", F.col("t")[0].alias("first")).agg(*(F.sum(F.col("t")[i]) for i in range(1, 9))).collect():
        totals.setdefault(lang, []).append([first, *t])
    arrays = {k: np.array(sorted(v), np.int64) for k, v in totals.items()}
    whole = spark.sparkContext.broadcast({k: (np.ascontiguousarray(v[:, 0]), v[:, 1:]) for k, v in arrays.items()})
    out = []
    for mine in range(rounds):
        pairs = mapped(docs, _pairs(buckets, whole, rounds, mine, True), PAIRS)
        sums = pairs.groupBy("bucket").cogroup(known.where(F.col("bucket") % rounds == mine).groupBy("bucket")).applyInArrow(tidied_groups(_scored(whole)), SUMS)
        out.append(written(sums.groupBy("chunk").applyInArrow(_summed, "key long, loss double"), "losses"))
    every = out[0].withColumn("round", F.lit(0))
    for i, x in enumerate(out[1:], 1):
        every = every.unionByName(x.withColumn("round", F.lit(i)))
    done = written(every.groupBy("key", "round").agg(F.max("loss").alias("loss")).groupBy("key").agg(F.sum("loss").alias("loss")), "losses")  # equal texts have equal losses
    for x in (ways, of, *out):
        forget(x)
    return done


def bands(measured: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(of_lang, least, most): a language's bounds, from histograms of at most some thousand bins."""
    good = measured.where("not base_failed and log_perplexity is not null").select(F.col("lang").alias("of_lang"), F.floor(F.col("log_perplexity") * STEPS).alias("bin"))
    w = Window.partitionBy("of_lang")
    run = good.groupBy("of_lang", "bin").agg(F.count("*").alias("n")).select("of_lang", "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))

    def at(p: float):
        return F.min(F.when(F.col("upto") >= F.col("total") * p, (F.col("bin") + 0.5) / STEPS))

    step = F.lit(2.0 / STEPS)
    least = F.least(at(0.5) - low * F.greatest(at(0.5) - at(0.25), step), LEAST_SHARE * at(0.5))
    most = at(0.5) + high * F.greatest(at(0.75) - at(0.5), step)
    return run.groupBy("of_lang").agg(least.alias("least"), most.alias("most"))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", low: float = LOW, high: float = HIGH, bucket_bytes: int = BUCKET_BYTES, keys: bool = False
) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, kept), one for each
    row; with keys also `key`, a hash of language and text, which is what the verdict rests on.

    A null text is empty: no words, no perplexity, base_failed. A null language is a language of its own. Repeated rows are judged
    (and counted for the model) each, null ids like others. A language none of whose documents passes the base rules keeps nothing
    anyway. Bounds of a band belong to it. Empty in, empty out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_key(F.col(lang_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    buckets = max(2, math.ceil((slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / bucket_bytes))
    schema = f"doc_id {kind}, lang string, key long, {', '.join(f'{c} long' for c in FIGURES)}, first long, n long"
    measured = written(mapped(slim, _measure(buckets), schema), "measured")
    loss = losses(slim.select("lang", "key", "text"), measured, buckets)
    each = measured.where("key is not null").drop("first", "n").join(loss, "key", "left")
    each = each.withColumn("base_failed", F.expr(f"n_words < {SMALLEST} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))
    each = written(each.withColumn("log_perplexity", F.when(F.col("n_words") > 0, F.col("loss") / F.col("n_words"))), "perplexities")
    bounds = written(bands(each, low, high), "bands")
    inside = F.coalesce((F.col("log_perplexity") >= F.col("least")) & (F.col("log_perplexity") <= F.col("most")), F.lit(False))
    out = each.join(bounds, each.lang.eqNullSafe(bounds.of_lang), "left").withColumn("kept", ~F.col("base_failed") & inside)
    return out.select("doc_id", *FIGURES, "base_failed", "log_perplexity", "kept", *(["key"] if keys else []))


def text_key(lang, text):
    """A hash of language and text, nulls apart from empty strings."""
    return F.xxhash64(lang.cast("string"), lang.isNull(), text, text.isNull())
