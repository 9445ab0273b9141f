"""Product codes, importance resampling and the suffix tree against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kerbline.llm import importance_sampling, product_quantizer, suffix_tree

from .test_operators import LONG, TEXTS, docs, empty

SF = "/root/testdata/sf0.01"


# ------------------------------------------------ 11


def nearest(x, entries):
    """Index and distance by whole numbers of any size."""
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
    return d.index(min(d)), min(d)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 8), st.integers(0, 27), st.integers(1, 70), st.integers(0, 1 << 30), st.integers(0, 3))
def test_screening_is_exact(dim, bits, size, seed, near):
    """Values of all sizes; entries that differ by a unit far from zero, where float32 cannot tell them apart."""
    rng = np.random.default_rng(seed)
    top = min(1 << bits, product_quantizer.largest(dim))
    entries = rng.integers(-top, top + 1, (size, dim))
    if near:
        entries = np.clip(entries[:1] + rng.integers(-near, near + 1, (size, dim)), -top, top)
    x = np.concatenate([rng.integers(-top, top + 1, (20, dim)), entries[rng.integers(0, size, 20)]])
    code, d = product_quantizer.screened(x, entries)
    assert list(zip(code.tolist(), d.tolist(), strict=True)) == [nearest(v, entries) for v in x]


def test_screening_of_nothing():
    code, d = product_quantizer.screened(np.zeros((0, 4), np.int64), np.ones((3, 4), np.int64))
    assert len(code) == len(d) == 0


def codes_of(rows, parts, size, rounds, scale=256):
    """(id, vector, label) to (id, code, error, label_error, digest) by loops."""
    ok = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and r[1] and len(r[1]) % parts == 0]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ok = [r for r in ok if len(r[1]) == len(ok[0][1])]
    each = len(ok[0][1]) // parts
    most = product_quantizer.largest(each * parts)
    x = [[max(-most, min(most, math.floor(scale * v))) for v in r[1]] for r in ok]
    cut = [[v[p * each : p * each + each] for p in range(parts)] for v in x]
    books = [[v[p] for v in cut[:size]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            found = defaultdict(list)
            for v in cut:
                found[nearest(v[p], books[p])[0]].append(v[p])
            books[p] = [[sum(c) // len(found[e]) for c in zip(*found[e], strict=True)] if e in found else old for e, old in enumerate(books[p])]
    got = [[nearest(v[p], books[p]) for p in range(parts)] for v in cut]
    by = Counter()
    for r, g in zip(ok, got, strict=True):
        by[r[2]] += sum(d for _, d in g)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((r[0], bytes(e for e, _ in g).hex(), sum(d for _, d in g), by[r[2]], digest) for r, g in zip(ok, got, strict=True))


def test_codes_follow_loops(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], int(i % 3) if i % 4 else None) for i in range(150)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1), (3, [float("nan")] * 8, 1), (4, [1.0, None] * 4, 1), (5, None, 1), (6, [math.inf] * 8, 1), (-1, [], 1), (-2, [1.0] * 7, 1), (200, [1.0] * 12, 1), (201, [1e30] * 8, 2)]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, id int")
    got = product_quantizer.compress(table, parts=4, entries=16)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    assert Counter(map(tuple, got.collect())) == codes_of(rows, 4, 16, 2)


def test_codes_of_few_and_of_none(spark):
    table = spark.createDataFrame([(2, [1.0, 2.0], None), (1, [1.0, 2.0], None)], "vec_id long, embedding array<double>, label string")
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in product_quantizer.compress(table, parts=2, entries=4).orderBy("vec_id").collect()] == [(1, "0000", 0, 0), (2, "0000", 0, 0)]
    assert product_quantizer.compress(table.limit(0), parts=2).count() == 0 and product_quantizer.compress(table.where("vec_id > 5"), parts=3).count() == 0
    with pytest.raises(ValueError):
        product_quantizer.compress(table, entries=257)


# ------------------------------------------------ 12


@settings(max_examples=15, deadline=None, suppress_health_check=list(__import__("hypothesis").HealthCheck))
@given(st.integers(0, 1 << 30), st.integers(0, 45), st.sampled_from([3, 5, 12]), st.sampled_from([3, 1000, (1 << 63) - 1]))
def test_radix_selection(spark, seed, k, digit, span):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(-span - 1, span, endpoint=True)), int(rng.integers(0, 3)), i) for i in range(40)]
    table = spark.createDataFrame(rows, "a long, b long, c long")
    assert sorted(map(tuple, table.where(importance_sampling.upto(table, ["a", "b", "c"], k, digit)).collect())) == sorted(rows)[:k]


def words(text):
    return (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else 32 for c in range(256))).split()


def drawn(rows, target, order, percent=10, least=20, size=10_000):
    runs = lambda w: [b" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    found = [[zlib.crc32(f) % size for f in runs(words(t))] for _, t in rows]
    s, t = Counter(b for f in found for b in f), Counter(zlib.crc32(f) % size for x in target for f in runs(words(x)))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + size) / ((s[b] + 1) * (t.total() + size)))) for b in s}
    out = []
    for (i, text), f in zip(rows, found, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(words(text)) >= least))
    order_ = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    k = len(order_) * percent // 100
    return Counter([(*x[:4], r + 1) for r, x in enumerate(order_[:k])] + [(*x[:4], None) for x in order_[k:]] + [(*x[:4], None) for x in out if not x[4]])


@pytest.mark.parametrize(("order", "percent"), [(1, 10), (2, 50), (3, 100)])
def test_resampling_follows_loops(spark, order, percent):
    rng = np.random.default_rng(9)
    vocabulary = ["Road", "crack-line", "pothole", "é1", "x{y", "the", "of", "and", "42", "sea"]
    rows = list(zip([*range(len(TEXTS) - 1), None], TEXTS, strict=True)) + [(100 + i, " ".join(rng.choice(vocabulary, 15 + i % 30))) for i in range(80)]
    rows += [(50, rows[20][1])] * 30  # repeated rows, which the cut may run through
    target = ["road crack line", None, "", "pothole pothole the road"]
    table = docs(spark, [t for _, t in rows], [i for i, _ in rows])
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance_sampling.resample(table, items, order=order, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == drawn(rows, target, order, percent)


def test_resampling_of_nothing(spark):
    items = spark.createDataFrame([("a b",)], "text string")
    assert importance_sampling.resample(empty(spark), items).count() == 0
    got = importance_sampling.resample(docs(spark), items.limit(0)).collect()
    assert len(got) == len(TEXTS) and all(r.weight == 0 for r in got if not r.n_features)


def test_drawn_documents_are_nearer_the_target(spark):
    table, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance_sampling.resample(table, items).where("n_features > 0").select(F.col("rank").isNotNull().alias("drawn"), (F.col("weight") / F.col("n_features")).alias("each"))
    mean = {r.drawn: r.each for r in got.groupBy("drawn").agg(F.avg("each").alias("each")).collect()}
    assert mean[True] > mean[False]


# ------------------------------------------------ 13


class Tree:
    """The model by dictionaries of tuples."""

    def __init__(self, texts, depth, alpha, least):
        self.alpha, self.depth = alpha, depth
        self.counts = [defaultdict(Counter) for _ in range(depth + 1)]
        for w in texts:
            for level, context, x in self.places(w):
                self.counts[level][context][x] += 1
        self.n, self.v = self.counts[0][()].total(), len(self.counts[0][()])
        self.kept = {()}
        for level in range(1, depth + 1):
            for context, after in self.counts[level].items():
                n = after.total()
                p = {x: self.p(context[1:], x) for x in after}
                gain = sum(c * (math.log(c - 1 + alpha * p[x]) - math.log(p[x])) for x, c in after.items()) - n * math.log(n - 1 + alpha) if n > 1 else 0
                if n > 1 and gain >= least:
                    self.kept.add(context)

    def places(self, w):
        held = (None, *w)
        for i in range(1, len(held)):
            for level in range(min(i, self.depth) + 1):
                yield level, held[i - level : i], held[i]

    def p(self, context, x):
        """By the longest retained suffix."""
        if not context:
            return (self.counts[0][()][x] + 1) / (self.n + self.v + 1)
        lower = self.p(context[1:], x)
        after = self.counts[len(context)].get(context)
        return (after[x] + self.alpha * lower) / (after.total() + self.alpha) if context in self.kept else lower

    def score(self, w):
        held = (None, *w)
        return sum(math.log10(self.p(held[max(0, i - self.depth) : i], held[i])) for i in range(1, len(held)))


def tokens(text):
    return [*(text or "").encode().lower().split(), b""]


def corpus():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(12)]
    said = ["the cat sat on the mat", "the dog sat on the mat too", "a cat ran", LONG[:800]]
    return TEXTS + said * 4 + [" ".join(rng.choice(vocabulary, int(rng.integers(1, 60)), p=np.arange(12, 0, -1) / 78)) for _ in range(60)]


@pytest.mark.parametrize(("depth", "hot", "least"), [(0, 9, 3.0), (1, 1 << 16, 3.0), (2, 1 << 16, 3.0), (2, 4, 3.0), (3, 10, 0.5), (3, 1 << 16, 0.5)])
def test_tree_follows_loops(spark, depth, hot, least, monkeypatch):
    monkeypatch.setattr(suffix_tree, "MOST_HOT", 1 << 40)
    texts = corpus()
    ids = [None if i == 3 else i % 90 for i in range(len(texts))]
    table = docs(spark, texts, ids).repartition(5)
    got = suffix_tree.score(table, held_out=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, depth=depth, hot=hot, least_gain=least)
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in ids]
    tree = Tree([tokens(t) for t, h in zip(texts, held, strict=True) if not h], depth, suffix_tree.ALPHA, least)
    root = Tree([tokens(t) for t, h in zip(texts, held, strict=True) if not h], 0, suffix_tree.ALPHA, least)
    nice = lambda x: float(f"{x:.9g}")
    want = Counter((i, h, len(tokens(t)), sum(x in root.counts[0][()] for x in tokens(t)), root.n, nice(root.score(tokens(t))), nice(tree.score(tokens(t)))) for i, t, h in zip(ids, texts, held, strict=True))
    assert Counter((*r[:5], nice(r[5]), nice(r[6])) for r in got.collect()) == want
    if depth:
        assert any(len(c) == depth for c in tree.kept) and len(tree.kept) < sum(len(c) for c in tree.counts)


def test_states_are_distributions():
    tree = Tree([tokens(t) for t in corpus()], 2, suffix_tree.ALPHA, 3.0)
    every = [*tree.counts[0][()], b"unknown"]
    assert len(tree.kept) > 5
    for context in tree.kept:
        assert sum(tree.p(context, x) for x in every) == pytest.approx(1)


def test_tree_of_nothing(spark):
    assert suffix_tree.score(empty(spark)).count() == 0
    got = suffix_tree.score(docs(spark), held_out=F.lit(True)).collect()  # nothing to learn from
    assert len(got) == len(TEXTS) and all(r.score == r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in got)


def test_tree_predicts_texts_it_has_not_seen(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    base, score = suffix_tree.score(table, held_out=held).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.97 * base
