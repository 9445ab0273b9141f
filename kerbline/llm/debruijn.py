"""Substring de-duplication over a compacted, sparse De Bruijn graph of word windows.

Every window of K consecutive words is an edge from its first K-1 words to its last K-1. Each window is filed under its
minimizer, the M-word run in it with the least hash (leftmost on ties): equal windows have equal minimizers wherever they stand,
and consecutive windows mostly share one, so a document becomes a short path of minimizers, each with the stretch of windows
(its region) filed under it.

1. Regions meet by a shuffle on their minimizer. A minimizer seen in one document only is dropped with all its windows.
2. Where everybody who holds a minimizer holds the same region, the path does not branch there: the whole region is settled
   at once by the smallest document id. This is the compaction; it leaves one row for a stretch of windows.
3. Where regions differ (ends of shared passages, edits), the path branches: only these windows are expanded to single edges,
   which meet by a second shuffle on the window itself.
4. Back at the texts, settled regions and edges are laid over the coordinates of each document; runs of removed windows with one
   source join to long spans, and the words they cover go.
5. Each different span is sent to its source document, where its words are looked for, literally. Should any not be there, two
   unlike windows had equal hashes, and all is done again with other ones.

Documents are dealt into chunks of a few megabytes by a hash of the row. A chunk sends each minimizer or window once, with its
smallest and largest document id, so a passage in every document costs one row a chunk and no key gets an unbounded group.
A row of a minimizer or window is some 40 bytes, and a key has one for each chunk that holds it. A step's shuffles go when it is
written, so the disk holds one step at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.llm.words import TextHashes, mix, rolling, signed, texts
from kerbline.session import forget, written

#: Words of a minimizer.
M = 5
#: Bytes of text in a chunk, about; and chunks a partition at least, so that partitions come out even.
CHUNK_BYTES = 8 << 20
CHUNKS_A_PARTITION = 4
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

#: Bits of a window's second hash that come back to its chunk, where it is told from the chunk's own windows only.
TWO_KEPT = 0xFFFF

#: Seeds of the hashes that are tried in turn.
SEEDS = (7, 107, 207, 307)


@dataclass
class Paths:
    """All documents of a chunk, laid end to end."""

    words: list[list[bytes]]
    first: np.ndarray  # where each document's words begin; one more at the end
    window: np.ndarray  # starts of the windows that lie in one document
    run: np.ndarray  # where in `window` each region begins; one more at the end
    doc: np.ndarray  # of each region, the position of its document
    minimizer: np.ndarray
    region: np.ndarray
    one: np.ndarray  # two hashes of each window
    two: np.ndarray


_known: dict[int, TextHashes] = {}


def paths(column: pa.ChunkedArray, k: int, seed: int) -> Paths:
    if seed not in _known:
        _known.clear()
        _known[seed] = TextHashes(seed)
    docs = texts(column)
    words = [t.split() for t in docs]
    h, size, _ = _known[seed](docs)
    first = np.append(0, np.cumsum(size))
    m, n = min(M, k), len(h) - k + 1
    empty = np.zeros(0, np.uint64)
    doc_of = np.repeat(np.arange(len(words)), np.diff(first))
    window = np.nonzero(np.arange(max(n, 0)) + k <= first[doc_of[: max(n, 0)] + 1])[0]
    if not len(window):
        return Paths(words, first, window, np.zeros(1, np.int64), np.zeros(0, np.int64), empty, empty, empty, empty)
    small = rolling(h, m, BASES[0])
    best, at = small[:n].copy(), np.arange(n)
    for j in range(1, k - m + 1):
        less = small[j : j + n] < best
        best[less] = small[j : j + n][less]
        at[less] = np.nonzero(less)[0] + j
    at, one = at[window], rolling(h, k, BASES[1])[window]
    two = rolling(mix(h ^ np.uint64(BASES[2])), k, BASES[2])[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (at[1:] != at[:-1]) | (doc_of[window[1:]] != doc_of[window[:-1]])
    run = np.nonzero(fresh)[0]
    part = mix(one + (at - window).astype(np.uint64) * np.uint64(BASES[2]))
    region = np.add.reduceat(part, run)
    return Paths(words, first, window, np.append(run, len(window)), doc_of[window[run]], small[at[run]], region, one, two)


def lowest_by(order: np.ndarray, fresh: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.nonzero(fresh)[0]
    v = values[order]
    return np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)


def _ids(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Document ids, and which are not null."""
    column = table.column("doc_id").combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


#: several: more than one document of the chunk holds it. forked: the chunk holds it with more than one region.
REGIONS = "chunk int, minimizer long, lo long, region long, several boolean, forked boolean"
WINDOWS = "chunk int, one long, two long, lo long, several boolean"


def _regions(k: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        p, (ids, real) = paths(table.column("text"), k, seed), _ids(table)
        use = real[p.doc]
        key, region, doc = p.minimizer[use], p.region[use], ids[p.doc[use]]
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = sorted_key[1:] != sorted_key[:-1]
        if len(key):
            lo, hi = lowest_by(order, fresh, doc)
            r_lo, r_hi = lowest_by(order, fresh, region)
        else:
            lo = hi = doc
            r_lo = r_hi = region
        chunk = table.column("chunk")[0].as_py()
        return pa.table({"chunk": pa.array(np.full(len(lo), chunk, np.int32)), "minimizer": signed(sorted_key[fresh]), "lo": lo, "region": signed(r_lo), "several": lo < hi, "forked": r_lo != r_hi})

    return run


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, whether it is in the sorted array `wanted`, and where."""
    if not len(wanted):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return wanted[at] == keys, at


def _column(table: pa.Table, name: str, kind=None) -> np.ndarray:
    out = table.column(name).to_numpy()
    return out.view(kind) if kind else out


def _expand(k: int, seed: int):
    def run(docs: pa.Table, forked: pa.Table) -> pa.Table:
        """The windows of forked regions, each once."""
        keys = np.sort(_column(forked, "minimizer", np.uint64))
        chunk, a, b = 0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        lo = hi = np.zeros(0, np.int64)
        if len(keys) and len(docs):
            chunk = forked.column("chunk")[0].as_py()
            p, (ids, real) = paths(docs.column("text"), k, seed), _ids(docs)
            hit, _ = _found(p.minimizer, keys)
            size = np.diff(p.run)
            each = np.repeat(hit & real[p.doc], size)
            a, b, doc = p.one[each], p.two[each], ids[np.repeat(p.doc, size)[each]]
            order = np.lexsort((b, a))
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            if len(a):
                lo, hi = lowest_by(order, fresh, doc)
                a, b = a[order][fresh], b[order][fresh]
        return pa.table({"chunk": pa.array(np.full(len(a), chunk, np.int32)), "one": signed(a), "two": signed(b), "lo": lo, "several": lo < hi})

    return run


def _cut(k: int, seed: int):
    def run(docs: pa.Table, settled: pa.Table) -> pa.Table:
        p, (ids, real) = paths(docs.column("text"), k, seed), _ids(docs)
        source = np.full(len(p.window), np.iinfo(np.int64).max)
        for kind in (0, 1):
            mine = _column(settled, "kind") == kind
            one, two, lo = _column(settled, "one", np.uint64)[mine], _column(settled, "two", np.uint64)[mine], _column(settled, "lo")[mine]
            order = np.argsort(one, kind="stable")
            one, two, lo = one[order], two[order], lo[order]
            if not len(one):
                continue
            if kind == 0:
                hit, at = _found(p.minimizer, one)
                size = np.diff(p.run)
                hit, at = np.repeat(hit, size), np.repeat(at, size)
            else:
                hit, at = _found(p.one, one)
                hit &= two[at] == p.two & np.uint64(TWO_KEPT)
            source[hit] = lo[at[hit]]
        of = np.repeat(p.doc, np.diff(p.run))
        gone = (source < ids[of]) & real[of]
        start, source, of = p.window[gone], source[gone], of[gone]
        cover = np.zeros(p.first[-1] + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + k, -1)
        cover = np.cumsum(cover)[:-1] > 0
        fresh = np.ones(len(start), bool)
        fresh[1:] = (start[1:] != start[:-1] + 1) | (source[1:] != source[:-1]) | (of[1:] != of[:-1])
        at = np.nonzero(fresh)[0]
        length = np.diff(np.append(at, len(start))) + k - 1
        begin = start[at] - p.first[of[at]]
        said = [b" ".join(p.words[d][i : i + n]) for d, i, n in zip(of[at].tolist(), begin.tolist(), length.tolist(), strict=True)]
        spans = pa.StructArray.from_arrays([pa.array(begin), pa.array(length), pa.array(source[at]), pa.array(said, pa.binary()).cast(pa.string())], ["start", "length", "source", "words"])
        bounds = np.searchsorted(of[at], np.arange(len(p.words) + 1))
        removed = np.add.reduceat(np.append(cover, False), p.first[:-1], dtype=np.int64) if len(p.words) else np.zeros(0, np.int64)
        removed[np.diff(p.first) == 0] = 0
        kept = []
        for i, words in enumerate(p.words):
            if removed[i]:
                keep = ~cover[p.first[i] : p.first[i + 1]]
                words = [w for w, x in zip(words, keep, strict=True) if x]
            kept.append(b" ".join(words))
        return pa.table(
            {
                "doc_id": docs.column("doc_id"),
                "n_words": np.diff(p.first),
                "n_removed": removed,
                "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                "spans": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans),
            }
        )

    return run


def _absent(k: int):
    def run(docs: pa.Table, claims: pa.Table) -> pa.Table:
        """The claims (source, words) whose words, window by window, stand in no text of the source."""
        asked: dict[int, list[bytes]] = {}
        for source, words in zip(claims.column("source").to_pylist(), texts(claims.column("words")), strict=True):
            asked.setdefault(source, []).append(words)
        there: dict[int, list[bytes]] = {}
        for i, source in enumerate(docs.column("doc_id").to_pylist() if asked else []):
            if source in asked:
                there.setdefault(source, []).append(b" " + b" ".join(texts(docs.column("text").slice(i, 1))[0].split()) + b" ")
        out = []
        for source, spans in asked.items():
            own = there.get(source, [])
            for span in spans:
                if any(b" " + span + b" " in t for t in own):
                    continue
                w = span.split()  # a span may follow several passages of its source
                if len(w) < k or not all(any(b" " + b" ".join(w[i : i + k]) + b" " in t for t in own) for i in range(len(w) - k + 1)):
                    out.append((source, span.decode()))
        return pa.table({"source": pa.array([x for x, _ in out], pa.int64()), "words": pa.array([x for _, x in out], pa.string())})

    return run


def absent(cut: DataFrame, docs: DataFrame, chunks: int, k: int) -> DataFrame:
    """Spans of cut (spans) that are not in their source among docs (doc_id, text): (source, words). Each different span is sent once, and
    of the texts those that are a source."""
    claims = written(cut.select(F.explode("spans").alias("s")).select("s.source", "s.words").distinct(), "claims")
    sources = claims.select("source").distinct()
    held = docs.join(sources, docs.doc_id == sources.source, "left_semi")
    by = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(chunks)).cast("int").alias("chunk")
    sent = claims.withColumn("chunk", F.pmod(F.xxhash64("source"), F.lit(chunks)).cast("int"))
    return held.select("doc_id", "text", by).groupBy("chunk").cogroup(sent.groupBy("chunk")).applyInArrow(_absent(k), "source long, words string")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept, spans): kept is the text without the words covered by a window of k words that
    also starts in a document with a smaller id; spans are (start, length, source id, words), in words of the document.

    One row for each row of docs, repeated rows included. A null text has no words. A null id is neither smaller nor larger than
    any other, so such a row keeps all its words and takes none from others. Rows of one id never shorten each other. Windows
    are judged on the input. Ids are whole numbers; others are refused. Empty in, empty out.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} holds no whole numbers, which documents are ordered by")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    chunks = max(CHUNKS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // CHUNK_BYTES))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = slim.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    for seed in SEEDS:
        cut = written(_repeats_cut(dealt, k, seed), "cut")
        if not absent(cut, slim, chunks, k).limit(1).count():
            return cut
        forget(cut)
    raise RuntimeError("equal hashes of unlike windows under every seed")


def _repeats_cut(dealt: DataFrame, k: int, seed: int) -> DataFrame:
    regions = dealt.groupBy("chunk").applyInArrow(_regions(k, seed), REGIONS)
    held = Window.partitionBy("minimizer")
    shared = regions.select(
        "chunk", "minimizer", F.min("lo").over(held).alias("lo"), F.max("lo").over(held).alias("last"), F.max("several").over(held).alias("several"),
        (F.max("forked").over(held) | (F.min("region").over(held) != F.max("region").over(held))).alias("forked"),
    ).where("lo < last or several")
    shared = written(shared.select("chunk", "minimizer", "lo", "forked"), "shared")
    forked = shared.where("forked").select("chunk", "minimizer")
    windows = dealt.groupBy("chunk").cogroup(forked.groupBy("chunk")).applyInArrow(_expand(k, seed), WINDOWS)
    held = Window.partitionBy("one", "two")
    repeated = windows.select("chunk", "one", "two", F.min("lo").over(held).alias("lo"), F.max("lo").over(held).alias("last"), F.max("several").over(held).alias("several")).where("lo < last or several")
    repeated = written(repeated.select("chunk", F.lit(1).alias("kind"), "one", F.col("two").bitwiseAND(TWO_KEPT).alias("two"), "lo"), "repeated")
    whole = shared.where("not forked").select("chunk", F.lit(0).alias("kind"), F.col("minimizer").alias("one"), F.lit(0).cast("long").alias("two"), "lo")
    settled = whole.unionByName(repeated)
    spans = "spans array<struct<start: long, length: long, source: long, words: string>>"
    return dealt.groupBy("chunk").cogroup(settled.groupBy("chunk")).applyInArrow(_cut(k, seed), f"doc_id long, n_words long, n_removed long, kept string, {spans}")
