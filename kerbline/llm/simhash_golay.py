"""SimHash near-duplicates linked by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect (23,12) Golay code.
Let c(w) be the codeword nearest to w (at most 3 bits away) and K(w) all codewords within 4 bits (1 or 6 of them).

* If two words differ in at most 1 bit, c of either lies in K of the other.
* If they differ in at most 2 bits, their K sets meet: the word half-way is at most 3 bits from its codeword, so both are within 4.

Two fingerprints at distance 4 or less put at most 2 errors into their two best segments together (pigeonhole: the third takes
the most). So for each pair of segments (a, b) a fingerprint gets the keys {c(a)} x K(b) and K(a) x {c(b)}: errors split 1+1 meet
across the two sets, 0+2 and 2+0 within one. No link is lost; each meeting is verified by the exact distance.

Equal fingerprints are collapsed first. A key's rows are compared in one pass that yields the links of a spanning forest, not
all pairs; a key with more than BLOCK rows is dealt out by pairs of blocks, so no task gets an unbounded group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.words import TextHashes, in_parts, mapped, mix, rolling, signed, texts
from kerbline.session import forget, written

MAX_DISTANCE = 4
SEED = 42
#: Rows of one key compared with each other in one place.
BLOCK = 2048
#: Shingles whose bits are counted at a time.
AT_ONCE = 1 << 16
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23,12) Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    """Bits set in over half of the XXH64 of all word shingles, repeats included; no words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined, k = b" ".join(words), min(shingle, n)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts, stops = [0, *ends[: n - k]], ends[k - 1 :]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, n - k + 1, AT_ONCE):
        h = np.array([digest(joined[s : e - 1], seed) for s, e in zip(starts[i : i + AT_ONCE], stops[i : i + AT_ONCE], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n - k + 1, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """Rows (id, fp): one for each row of docs; a null text counts as empty (fp 0)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            fps = np.fromiter((fingerprint(t, shingle) for t in texts(part.column(1))), np.uint64, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(signed(fps))], ["id", "fp"])

    return mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, fp long")


# ---------------------------------------------------------------- Golay keys


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


class Golay:
    """Tables: for each of the 2048 syndromes the error pattern of weight 3 or less, and those of weight 4."""

    def __init__(self) -> None:
        unit = [_remainder(1 << i) for i in range(23)]
        self.low = np.array([_remainder(i) for i in range(1 << 12)], np.uint32)
        self.high = np.array([_remainder(i << 12) for i in range(1 << 11)], np.uint32)
        self.near = np.zeros((2048, 6), np.uint32)
        found = np.zeros(2048, np.int64)
        for weight in range(5):
            for bits in itertools.combinations(range(23), weight):
                s = 0
                for i in bits:
                    s ^= unit[i]
                error = sum(1 << i for i in bits)
                if weight <= 3:
                    self.near[s, :] = error
                    found[s] = 1
                else:
                    self.near[s, found[s]] = error
                    found[s] += 1

    def keys(self, words: np.ndarray) -> np.ndarray:
        """For each word six 12-bit codeword indices within 4 bits; the nearest comes first and fills up missing ones."""
        syndrome = self.low[words & 0xFFF] ^ self.high[words >> 12]
        return (words[:, None] ^ self.near[syndrome]) >> 11


_golay: Golay | None = None


def bucket_keys(fps: np.ndarray) -> np.ndarray:
    """An array of (n, 33) keys of each fingerprint, with repeats."""
    global _golay
    _golay = _golay or Golay()
    k = [_golay.keys((fps >> np.uint64(at) & np.uint64((1 << size) - 1)).astype(np.uint32)).astype(np.int64) for at, size in SEGMENTS]
    out = []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        top = pair << 24
        out += [top | k[a][:, :1] << 12 | k[b], top | k[a][:, 1:] << 12 | k[b][:, :1]]
    return np.concatenate(out, axis=1)


def _fresh(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct keys in a line, and the row of each."""
    keys = np.sort(keys, axis=1)
    fresh = np.concatenate([np.ones((len(keys), 1), bool), keys[:, 1:] != keys[:, :-1]], axis=1)
    return keys[fresh], np.nonzero(fresh)[0]


def _column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, check, sketches ...) to (key, node, check, sketch), a row for each key of each sketch."""
    for part in in_parts(batches, 5000):
        node, check = _column(part, 0), _column(part, 1)
        for j in range(2, part.num_columns):
            sketch = _column(part, j)
            keys, of = _fresh(bucket_keys(sketch) | (j - 2) << 26)
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(signed(x[of])) for x in (node, check, sketch))], ["key", "node", "check", "sketch"])


# ---------------------------------------------------------------- comparing a key's rows


@dataclass
class Held:
    """Rows to compare: two are linked if their sketches and their checks are near enough."""

    node: np.ndarray
    check: np.ndarray
    sketch: np.ndarray

    def __getitem__(self, at) -> Held:
        return Held(self.node[at], self.check[at], self.sketch[at])

    def near(self, other: Held, limit: int, far: int) -> np.ndarray:
        hit = np.bitwise_count(self.sketch ^ other.sketch) <= limit
        return hit & (np.bitwise_count(self.check ^ other.check) <= far) if far < 64 else hit


def forest(held: Held, limit: int, far: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links (from, to) that join what is connected at this distance: each node is met once by the one that reached it."""
    rest, links = held[np.unique(held.node, return_index=True)[1]], []
    queue: list[tuple[Held, int]] = []
    while len(rest.node):
        if not queue:
            queue, rest = [(rest, 0)], rest
            rest = rest[1:]
            continue
        of, i = queue.pop()
        x = of[i : i + 1]
        hit = rest.near(x, limit, far)
        if hit.any():
            got = rest[hit]
            links.append((np.full(len(got.node), x.node[0]), got.node))
            queue.extend((got, i) for i in range(len(got.node)))
            rest = rest[~hit]
    return links


def runs_of(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.nonzero(key[1:] != key[:-1])[0] + 1, [len(key)]])


def links_in_order(key: np.ndarray, held: Held, limit: int, far: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys: short runs by shifted comparison, long ones by forest()."""
    edges = runs_of(key)
    size = np.diff(edges)
    short = np.repeat(size <= 8, size)
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for shift in range(1, 8):
        hit = short[:-shift] & (key[:-shift] == key[shift:])
        at = np.nonzero(hit)[0]
        at = at[held[at].near(held[at + shift], limit, far)]
        a.append(held.node[at])
        b.append(held.node[at + shift])
    for i in np.nonzero(size > 8)[0]:
        for x, y in forest(held[edges[i] : edges[i + 1]], limit, far):
            a.append(x)
            b.append(y)
    return np.concatenate(a), np.concatenate(b)


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by fewer links: (node, smallest node) of each component of these links."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[keep], nodes[label[keep]]


def _compare(limit: int, far: int):
    """(key, node, check, sketch) in the order of key, or (key, sketch) where a sketch is its own node, to links within equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        us, vs, many = [], [], 0

        def flush():
            u, v = spanning(np.concatenate(us), np.concatenate(vs))
            us.clear()
            vs.clear()
            return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(signed(v))], ["u", "v"])

        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                own = [_column(batch, i) for i in range(batch.num_columns)]
                now = [np.concatenate(x) for x in zip(kept, own, strict=True)] if kept else own
            elif kept:
                now = kept
            else:
                break
            cut = len(now[0]) if batch is None or not len(now[0]) else int(runs_of(now[0])[-2])
            kept = [x[cut:] for x in now]
            if cut:
                rows = [x[:cut] for x in now[1:]]
                u, v = links_in_order(now[0][:cut], Held(*(rows if len(rows) == 3 else rows * 3)), limit, far)
                if len(u):
                    us.append(u)
                    vs.append(v)
                    many += len(u)
            if us and (batch is None or many > 500_000):
                yield flush()
                many = 0

    return run


def _dealt(keys: DataFrame, node: str, block: int) -> DataFrame:
    """The same rows, but those of a key with more than `block` rows dealt out by pairs of blocks, each pair under a key of its own."""
    hot = keys.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    return _by_blocks(keys.join(hot, "key", "left"), node)


def _by_blocks(keys: DataFrame, node: str) -> DataFrame:
    """Rows with the number of blocks of their key (null: one) to the same under a key for each pair of blocks."""
    rest = [c for c in keys.columns if c not in ("key", "blocks")]
    mine = F.pmod(F.xxhash64(node), F.col("blocks").cast("long")).cast("int")
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = keys.select("key", *rest, F.coalesce(mine, F.lit(0)).alias("mine"), other.alias("other"))
    pair = F.shiftleft(F.least("mine", "other").cast("long"), 28) + F.shiftleft(F.greatest("mine", "other").cast("long"), 46)
    return dealt.select((F.col("key") + pair).alias("key"), *rest)


def links(distinct: DataFrame, limit: int = MAX_DISTANCE, block: int = BLOCK, far: int = 64) -> DataFrame:
    """Links (u, v) of nodes that join all that are connected: some sketch at most `limit` bits apart and the checks at most `far`.

    distinct has the columns node, check and one or more sketches, a node in one row.
    """
    if limit > MAX_DISTANCE:
        raise ValueError("these keys are proven for distances of at most 4")
    keys = mapped(distinct, _key_rows, "key long, node long, check long, sketch long")
    return mapped(_dealt(keys, "node", block).repartition("key").sortWithinPartitions("key"), _compare(limit, far), "u long, v long")


#: Components with this share of all classes or more, of which there are at most as many, are named by a broadcast.
LARGE = 1 / 256


def _rooted(classes: DataFrame, linked: DataFrame, *columns: str) -> DataFrame:
    """classes (node, ...) with the root of each node's component, written."""
    root = components(linked)
    return written(classes.join(root, "node", "left").select("node", *columns, F.coalesce("root", "node").alias("root")), "rooted")


def _named(each: DataFrame, classes: DataFrame, linked: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each with component_id: the smallest id of its class's component."""
    rooted = _rooted(classes, linked, *[c for c in by if c != "node"], "low")
    named = written(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n")), "named")
    total = named.agg(F.sum("n")).first()[0] or 0
    large = F.broadcast(named.where(F.col("n") >= LARGE * total).select("root", "component_id"))  # at most 1 / LARGE rows
    hot = rooted.join(large, "root")
    rest = rooted.join(large, "root", "left_anti").join(named.where(F.col("n") < LARGE * total), "root")
    of = written(hot.select(*by, "component_id").unionByName(rest.select(*by, "component_id")), "components")
    return each.join(of, by)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, limit: int = MAX_DISTANCE) -> DataFrame:
    """Rows (id, fp, component_id) for each row of docs: component_id is the smallest id reachable over links of at most `limit` bits.

    Null texts count as empty. Texts without words share fingerprint 0 and link like others. Repeated rows come back repeated.
    A null id is kept as a row but never names a component; a component with no other id gets null. Empty in, empty out.
    """
    each = written(fingerprints(docs, id_col, text_col, shingle), "fps")
    lowest = written(each.groupBy("fp").agg(F.min("id").alias("low")), "lowest")
    fp = F.col("fp")
    linked = links(lowest.select(fp.alias("node"), fp.alias("check"), fp.alias("sketch")), limit)
    return _named(each, lowest.withColumn("node", fp), linked, ["fp"]).select("id", "fp", "component_id")


# ---------------------------------------------------------------- near copies of a given similarity

#: Jaccard similarity of the sets of five-word shingles from which texts are linked.
ALIKE = 0.8
#: Sketches of a text, and shingles that each is made of: those that come first in a hash order of its own. Texts of similarity s have the
#: same shingles in none of them with probability (1 - s**SAMPLE)**SKETCHES: 0.9 % at 0.8, 0.1 % at 0.85, 4e-5 at 0.9.
SKETCHES, SAMPLE = 12, 5
#: A sketch is a SimHash of two words of the Golay code; it meets sketches at most so many bits away.
SKETCH_BITS, SKETCH_DISTANCE = 46, 2
#: Sketches compared first; of the others only buckets are compared that these have not linked throughout.
FIRST = 2
#: Bytes of a shingle's hash where sets are compared, and bytes of the sets of one block.
HASH_BYTES, BLOCK_BYTES = 5, 1 << 22
_random = np.random.default_rng(SEED)
_FLIP = _random.integers(0, 1 << 32, SKETCHES, np.uint32)
_TIMES = _random.integers(0, 1 << 32, SKETCHES, np.uint32) | np.uint32(1)
_hashes = TextHashes(13)


def shingle_sets(docs: list[bytes], shingle: int = 5) -> list[np.ndarray]:
    """Of each text the distinct hashes of its word shingles, in order; a shorter text is one shingle, and one without words none."""
    h, size, _ = _hashes([t.lower() for t in docs])
    ends = np.cumsum(size).tolist()
    return [np.unique(rolling(h[end - n : end], min(shingle, n), 0x9E3779B97F4A7C15)) if n else np.zeros(0, np.uint64) for n, end in zip(size.tolist(), ends, strict=True)]


def sketches(held: np.ndarray) -> np.ndarray:
    """SKETCHES fingerprints of a set of shingles, each the SimHash of the SAMPLE shingles that come first in its order (or of all, if fewer),
    with the number of the order above its bits. No shingles: zeros."""
    band = np.arange(SKETCHES, dtype=np.uint64) << np.uint64(SKETCH_BITS)
    if not len(held):
        return band
    low = held.astype(np.uint32)
    if len(held) > SAMPLE:
        first = np.stack([held[np.argpartition((low ^ flip) * times, SAMPLE - 1)[:SAMPLE]] for flip, times in zip(_FLIP, _TIMES, strict=True)])
    else:
        first = np.broadcast_to(held, (SKETCHES, len(held)))
    # another seed in each order, so that texts of few shingles have sketches of their own in each
    votes = np.unpackbits(mix(first ^ (band << np.uint64(10))[:, None])[..., None].view(np.uint8), axis=-1, bitorder="little").sum(axis=1, dtype=np.int64)
    bits = np.packbits(2 * votes > first.shape[1], axis=-1, bitorder="little").reshape(-1).view(np.uint64)
    return band | bits & np.uint64((1 << SKETCH_BITS) - 1)


def sketch_keys(held: np.ndarray) -> np.ndarray:
    """An array of (n, 12) keys of each sketch, with repeats: two of one order that differ in at most 2 bits share a key.

    Of 2 errors in two words, one each: c of either lies in K of the other; both in one: that word's K sets meet, the other's c is equal.
    """
    global _golay
    _golay = _golay or Golay()
    a, b = (_golay.keys((held >> np.uint64(at) & np.uint64((1 << 23) - 1)).astype(np.uint32)).astype(np.int64) for at in (0, 23))
    band = (held >> np.uint64(SKETCH_BITS)).astype(np.int64)[:, None] << 24
    return np.concatenate([band | a[:, :1] << 12 | b, band | a << 12 | b[:, :1]], axis=1)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sketch) to (key, sketch), a row for each key."""
    for part in in_parts(batches, 20_000):
        sketch = _column(part, 0)
        keys, of = _fresh(sketch_keys(sketch))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(signed(sketch[of]))], ["key", "sketch"])


def _few(batches: Iterator[pa.RecordBatch], most: int, crowded: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """(key, sketch) in the order of key: the rows of keys with at most `most` rows; each other key goes to crowded, with the number of its rows.

    Of a key that goes on in the next batch no more than `most` rows are held.
    """
    key, sketch, passed = np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            key, sketch = np.concatenate([key, _column(batch, 0)]), np.concatenate([sketch, _column(batch, 1)])
        if not len(key):
            continue
        edges = runs_of(key)
        size = np.diff(edges)
        n = size.copy()
        n[0] += passed
        done = len(n) - (batch is not None)
        over = n[:done] > most
        crowded += [(int(key[edges[i]]), int(n[i])) for i in np.nonzero(over)[0]]
        fine = np.repeat(~over, size[:done])
        if fine.any():
            yield pa.RecordBatch.from_arrays([pa.array(signed(x[: edges[done]][fine])) for x in (key, sketch)], ["key", "sketch"])
        passed = 0 if done else passed
        key, sketch = key[edges[done] :], sketch[edges[done] :]
        if len(key) > most:
            passed += len(key) - 1
            key, sketch = key[:1], sketch[:1]


def _compare_few(limit: int, most: int):
    """(key, sketch) in the order of key to links (u, v, 0) within keys of at most `most` rows, and (key, key, rows) of each other key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded: list[tuple[int, int]] = []
        for found in _compare(limit, 64)(_few(batches, most, crowded)):
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(np.zeros(found.num_rows, np.int64))], ["u", "v", "n"])
        if crowded:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in crowded], pa.int64()) for i in (0, 0, 1)], ["u", "v", "n"])

    return run


def _sketch_links(held: DataFrame, block: int) -> DataFrame:
    """Links (u, v) that join all sketches (sketch) which are connected over SKETCH_DISTANCE bits or fewer.

    Keys are not counted beforehand, as almost all are short: those found to have more than `block` rows are dealt out and compared after the
    others. A key has at most 2 x 2^11 x 10,903 sketches, so many words being near its two codewords.
    """
    keys = mapped(held, _sketch_rows, "key long, sketch long")
    near = written(mapped(keys.repartition("key").sortWithinPartitions("key"), _compare_few(SKETCH_DISTANCE, block), "u long, v long, n long"), "near")
    linked = near.where("n = 0").select("u", "v")
    hot = written(near.where("n > 0").select(F.col("u").alias("key"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "crowded")
    if hot.first() is None:
        return linked
    dealt = _by_blocks(keys.join(hot, "key"), "sketch")
    return linked.unionByName(mapped(dealt.repartition("key").sortWithinPartitions("key"), _compare(SKETCH_DISTANCE, 64), "u long, v long"))


def _near_sketches(rows: DataFrame) -> DataFrame:
    """Rows (node, key) of sketches to the same with each sketch named by the least one that it reaches over SKETCH_DISTANCE bits or fewer."""
    root = components(_sketch_links(rows.select(F.col("key").alias("sketch")).distinct(), BLOCK))
    return rows.join(root, rows.key == root.node, "left").select(rows.node, "size", "band", F.coalesce("root", "key").alias("key"))


def _packed(held: np.ndarray) -> bytes:
    return np.unique(held & np.uint64((1 << 8 * HASH_BYTES) - 1)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    out = np.zeros((sum(map(len, packed)) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, HASH_BYTES)
    return out.view(np.uint64)[:, 0]


def alike(nodes: list[int], packed: list[bytes], least: float, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join what is connected by sets of this Jaccard similarity: each node is met once by the one that reached it. Nodes of one
    root are connected already, so the first that is reached brings the others."""
    size = np.array([len(x) // HASH_BYTES for x in packed])
    shared = _shared(packed, size)
    root = np.arange(len(nodes)) if roots is None else np.unique(roots, return_inverse=True)[1]
    rest, queue, links = np.arange(len(nodes)), [], []
    while len(rest):
        if not queue:
            own = root[rest] == root[rest[0]]
            queue, rest = rest[own].tolist(), rest[~own]
            continue
        x = queue.pop()
        may = rest[np.minimum(size[rest], size[x]) >= least * np.maximum(size[rest], size[x])]
        if not len(may):
            continue
        both = shared(x, may)
        got = may[both >= least * (size[may] + size[x] - both)]
        if len(got):
            links += [(nodes[x], nodes[i]) for i in got]
            met = np.isin(root[rest], root[got])
            queue.extend(rest[met].tolist())
            rest = rest[~met]
    return links


#: Bytes of the table of which set holds which of the shingles that two or more hold.
TABLE_BYTES = 1 << 23


def _shared(packed: list[bytes], size: np.ndarray):
    """shared(x, others): how many shingles set x has in common with each of others. By bits of the shingles that two sets or more hold; if
    there are too many of these for a table, by marking those of x."""
    number = np.unique(_unpacked(packed), return_inverse=True)[1]
    often = np.bincount(number) > 1
    column = np.cumsum(often) - 1
    start = np.concatenate([[0], np.cumsum(size)])
    words = -(-int(often.sum()) // 64)
    if len(size) * words * 8 <= TABLE_BYTES:
        table = np.zeros((len(size), words * 8), np.uint8)
        for i in range(len(size)):
            own = number[start[i] : start[i + 1]]
            held = np.zeros(words * 64, bool)
            held[column[own[often[own]]]] = True
            table[i] = np.packbits(held)
        table = table.view(np.uint64)
        return lambda x, others: np.bitwise_count(table[others] & table[x]).sum(axis=1, dtype=np.int64)
    mark = np.zeros(len(often), bool)

    def by_marks(x: int, others: np.ndarray) -> np.ndarray:
        own = number[start[x] : start[x + 1]]
        mark[own] = True
        out = np.array([np.count_nonzero(mark[number[start[i] : start[i + 1]]]) for i in others])
        mark[own] = False
        return out

    return by_marks


def _alike_in_order(least: float):
    """(key, node, root, shingles) in the order of key to links within equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, {}, []
        for batch in itertools.chain(batches, [None]):
            rows = [(None, 0, 0, b"")] if batch is None else zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for k, node, root, shingles in rows:
                if k != key:
                    if len(held) > 1:
                        out += alike(list(held), [x for _, x in held.values()], least, [r for r, _ in held.values()])
                    key, held = k, {}
                held[node] = (root, shingles)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["u", "v"])
                out = []

    return run


def _blocks(n: Column, size: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, size * HASH_BYTES / BLOCK_BYTES)).cast("int")


def _buckets(rows: DataFrame) -> DataFrame:
    """(key, main, mains, others) of the keys to compare, of rows (node, size, root, key): not those within one root, and of keys with the
    same nodes one. main is the root with most nodes, mains and others are the blocks that its nodes and the others make."""
    each = rows.groupBy("key", "root").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("nodes"), F.min("node").alias("least"), F.sum("size").alias("size"))
    each = each.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.bit_xor("nodes").alias("nodes"), F.min("least").alias("least"), F.sum("size").alias("size"), F.count("*").alias("roots"))
    each = each.where("roots > 1").groupBy("n", "nodes", "least", "size").agg(F.min(F.struct("key", "main")).alias("one"))
    main = F.col("one.main")
    mains, others = _blocks(main.n, main["size"]), _blocks(F.col("n") - main.n, F.col("size") - main["size"])
    return each.select(F.col("one.key").alias("key"), main.root.alias("main"), _blocks(F.col("n"), F.col("size")).alias("blocks"), mains.alias("mains"), others.alias("others"))


def _verified(rows: DataFrame, sets: DataFrame, least: float, whole: bool) -> DataFrame:
    """Links (u, v) that join what is connected at this similarity within a key. Keys of more than a block are dealt out: at first by blocks
    alone; then (whole) by pairs of blocks, but for pairs within the main root, which is connected already."""
    met = rows.join(_buckets(rows), "key")

    def one_of(n: Column) -> Column:
        return F.pmod(F.xxhash64("node", "key"), n.cast("long")).cast("int")

    if whole:
        is_main = F.col("root") == F.col("main")
        met = met.select("node", "root", "key", "mains", F.when(is_main, one_of(F.col("mains"))).otherwise(F.col("mains") + one_of(F.col("others"))).alias("mine"), is_main.alias("is_main"), "others")
        other = F.explode(F.sequence(F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1))
        met = met.select("node", "root", "key", "mine", other.alias("other")).select("node", "root", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))
    else:
        met = met.select("node", "root", F.xxhash64("key", one_of(F.col("blocks"))).alias("key"))
    met = met.join(sets, "node").select("key", "node", "root", "shingles")
    return written(mapped(met.repartition("key").sortWithinPartitions("key"), _alike_in_order(least), "u long, v long"), "alike")


def _alike(docs: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, key, node) for each row of docs, key a hash of the text and node that of its set of shingles; classes (node, low); links."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def named(held: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(held.tobytes(), SEED) - (1 << 63)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            sets = shingle_sets(texts(part.column(1)), shingle)
            keys = np.concatenate([sketches(x) for x in sets]) if sets else np.zeros(0, np.uint64)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SKETCHES), pa.array(signed(keys)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([named(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), keys], ["id", "key", "node", "size", "keys"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_parts(batches):
            sets = shingle_sets(texts(part.column(1)), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([named(x) for x in sets], pa.int64()), pa.array([_packed(x) for x in sets], pa.binary())], ["node", "shingles"])

    each = written(mapped(docs.withColumn("key", text_key(F.col("text"))), keyed, f"id {kind}, key long, node long, size long, keys array<long>"), "sketches")
    classes = written(each.groupBy("node").agg(F.min("id").alias("low"), F.min("size").alias("size"), F.first("keys").alias("keys")), "classes")
    rows = written(_near_sketches(classes.where("size > 0").select("node", "size", F.posexplode("keys").alias("band", "key"))), "rows")
    meeting = rows.join(_buckets(rows.withColumn("root", F.col("node"))), "key", "left_semi").select("node").distinct()
    meeting = written(classes.join(meeting, "node", "left_semi").select("node", "low"), "meeting")
    lows = meeting.select("low").distinct()
    sets = mapped(docs.join(lows, docs.id.eqNullSafe(lows.low), "left_semi"), packed, "node long, shingles binary")
    sets = written(sets.join(meeting, "node", "left_semi").dropDuplicates(["node"]), "shingles")
    linked = _verified(rows.where(F.col("band") < FIRST).withColumn("root", F.col("node")), sets, least, False)
    root = components(linked)
    more = written(rows.join(root, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), "key"), "rooted")
    linked = linked.unionByName(_verified(more, sets, least, True))
    for x in (rows, meeting, sets, more):
        forget(x)
    return each.select("id", "key", "node"), classes.select("node", "low"), linked


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = ALIKE) -> DataFrame:
    """Rows (id, component_id) for each row of docs, linked where the Jaccard similarity of the sets of word shingles is `least` or more.

    Texts with equal sets are one class. Classes whose SimHash sketches meet by a Golay key, at most SKETCH_DISTANCE bits apart, are candidates
    (see SKETCHES for the recall), and each is verified by the similarity itself, of hashes of HASH_BYTES bytes. Candidates of the first
    sketches are compared and joined; of all sketches, then, buckets that hold more than one component, where nodes of unlike components
    are compared with each other. Nulls, ties and empty texts are as in near_duplicates().
    """
    each, classes, linked = _alike(docs, id_col, text_col, shingle, least)
    return _named(each, classes, linked, ["node"]).select("id", "component_id")


def text_key(text: Column) -> Column:
    return F.xxhash64(text, text.isNull())


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = ALIKE) -> DataFrame:
    """docs with one row of each group of similar(): that with the smallest id, null ids after all others, then the least hash of the
    text; of rows equal in both, any one. Texts without words are a group like others. Columns of docs may have any names."""
    each, classes, linked = _alike(docs, id_col, text_col, shingle, least)
    rows = each.join(_rooted(classes, linked).withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"))
    held = rows.groupBy("root", "id", "key").agg(F.count("*").alias("n")).groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "n")).alias("best"))
    best = written(held.select(F.col("best.id").alias("best_id"), F.col("best.key").alias("best_key"), F.col("best.n").alias("best_n")), "survivors")
    wanted = docs[id_col].eqNullSafe(best.best_id) & (text_key(docs[text_col]) == best.best_key)
    once = docs.join(best.where("best_n = 1"), wanted, "left_semi")
    again = docs.join(best.where("best_n > 1"), wanted, "left_semi").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
