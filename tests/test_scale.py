"""Operators that must hold for any size, with groups dealt over many partitions."""

import itertools
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbline.operators import retrieval, similarity, spatial, statistics
from kerbline.plans import queries_more
from kerbline.streaming.live import metres


def test_running_over_ranges(spark):
    """A group far larger than a range, small ones, and a null one; 4 ranges of a shuffle hold parts of each."""
    rng = random.Random(1)
    rows = [("big", i, rng.randint(1, 5)) for i in range(5000)] + [("small", 3, 2), ("small", 1, 7), (None, 9, 1), (None, 8, 4)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, x long, n long").repartition(7)
    got = {(r.g, r.x): r.before for r in statistics.running(table, ["g"], -F.col("x")).collect()}
    want = {}
    for g, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] or "", -r[1])), key=lambda r: r[0]):
        total = 0
        for _, x, n in own:
            want[g, x] = total
            total += n
    assert got == want
    every = statistics.running(table.groupBy("x").agg(F.sum("n").alias("n")), [], F.col("x"))
    assert every.agg(F.max(F.col("before") + F.col("n"))).first()[0] == sum(r[2] for r in rows)
    assert statistics.running(table.limit(0), ["g"], F.col("x")).count() == 0


def test_many_sign_flips_are_drawn(spark):
    rng = random.Random(2)
    even = spark.createDataFrame([(i, rng.gauss(0, 1)) for i in range(30)], "pair_id long, diff double")
    far = even.withColumn("diff", F.col("diff") + 3)
    a, b = statistics.sign_flips(even).first(), statistics.sign_flips(far).first()
    assert a.n_pairs == 30 and a.p_value > 0.05 and b.p_value == pytest.approx(1 / 10_001) and not b.underpowered
    assert statistics.sign_flips(even).first() == a
    few = even.where("pair_id < 12")
    assert statistics.sign_flips(few).first().p_value == pytest.approx(statistics.sign_flips(few, exact_pairs=5, draws=4000).first().p_value, abs=0.03)


def test_nearest_target_at_any_distance(spark):
    rng = random.Random(3)
    points = [(i, 40 + rng.random() * 12, 15 + rng.random() * 12) for i in range(60)] + [(100, 40.0, 15.0), (101, 40.0, 15.0), (102, None, 1.0), (103, -60.0, -100.0)]
    targets = [(i, 46 + rng.random() / 10, 23 + rng.random() / 10) for i in range(9)] + [(20, 46.05, 23.05), (21, 46.05, 23.05), (22, None, None), (23, 40.0, 15.0)]
    schema = "id long, lat double, lon double"
    p, t = spark.createDataFrame(points, schema), spark.createDataFrame(targets, schema)
    got = {r.id: (r.target_id, r.metres) for r in spatial.nearest_of_all(p, t).collect()}
    want = {i: min((round(metres(y, x, b, a), 3), k) for k, b, a in targets if b is not None) for i, y, x in points if y is not None}
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (_, k) in want.items()}
    assert spatial.nearest_of_all(p, t.limit(0)).count() == 0 and spatial.nearest_of_all(p.limit(0), t).count() == 0


@pytest.mark.parametrize("limit", [0, 1, 2, 3])
def test_hash_links_come_once(spark, limit):
    rng = random.Random(limit)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {0, 1, 3, (1 << 64) - 1}
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    table = spark.createDataFrame([(h,) for h in signed], "h long")
    got = [tuple(r) for r in similarity._links(table, limit).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= limit}
    assert len(got) == len(set(got)) and set(got) == want


def test_hash_keys_are_not_broadcast(spark):
    """Seventy keys a hash are taken for one small table, which a driver of little memory can't collect."""
    links = similarity._links(spark.range(1000).withColumnRenamed("id", "h"), 4)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_interpolation_over_ranges(spark):
    """A track that lies in all ranges, with frames between and outside its fixes, one in gaps of many ranges, and one without a name."""
    import numpy as np

    rng = random.Random(5)
    fixes = [(1, float(t), 46 + t / 1e4, 23 - t / 2e4) for t in rng.sample(range(100, 9000), 700)] + [(2, 0.0, 1.0, 1.0), (2, 9000.0, 2.0, 3.0), (None, 5.0, 7.0, 7.0)]
    frames = [(1, i, float(i * 7)) for i in range(1400)] + [(2, 10_000 + i, i * 100.0 + 1) for i in range(80)] + [(3, 20_000, 5.0), (None, 30_000, 5.0)]
    track = spark.createDataFrame(fixes, "track_id long, t double, lat double, lon double").repartition(5)
    table = spark.createDataFrame(frames, "track_id long, frame_id long, t double").repartition(5)
    got = {r.frame_id: (r.lat, r.lon) for r in spatial.interpolate(table, track).collect()}
    assert len(got) == len(frames) and got[20_000] == (None, None) and got[30_000] == (7.0, 7.0)
    for k in (1, 2):
        own = sorted(f for f in fixes if f[0] == k)
        for _, i, t in (f for f in frames if f[0] == k):
            inside = own[0][1] <= t <= own[-1][1]
            want = [float(np.interp(t, [f[1] for f in own], [f[c] for f in own])) for c in (2, 3)]
            assert got[i] == (pytest.approx(tuple(want)) if inside else (None, None))


def test_annotations_are_written_one_a_row(spark, monkeypatch):
    """No row holds the text of a file, which grows with the table."""
    from kerbline.plans import queries_files

    put, rows = queries_files._put, []
    monkeypatch.setattr(queries_files, "_put", lambda table, name: rows.append(table) or put(table, name))
    got = queries_files.src_19(spark, "/root/testdata/sf0.001")
    assert got.count() > 1000 and rows[0].agg(F.max(F.length("value"))).first()[0] < 2000


def test_keys_of_a_stream_share_a_group(spark, monkeypatch, tmp_path):
    """All keys in one group, over three batches: each keeps a state of its own, and the rows are those of the table."""
    from kerbline.operators import folds
    from kerbline.streaming import live

    monkeypatch.setattr(folds, "BUCKETS", 1)
    rng = random.Random(7)
    rows = [(f"d{rng.randint(0, 20)}" if i % 9 else None, "a" if i % 3 else "b", i, 1000.0 + i * 3, 46.0, 23.0 + rng.randint(0, 1) / 100) for i in range(900)]
    for n in range(3):
        spark.createDataFrame(rows[n * 300 : n * 300 + 300], "device_id string, damage_type string, report_id long, t double, latitude double, longitude double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(r.report_id for r in live.run_available(live.cooled(stream, 200.0, 20.0), "shared").collect())
    assert got == sorted(r.report_id for r in live.cooled(table, 200.0, 20.0).collect()) and len(got) > 100


def test_feed_folds_once(spark, monkeypatch):
    """The life of events is a table by the time its batches are cut."""
    from kerbline.plans import queries_streams

    seen, each = [], queries_streams.written.Feed.each
    monkeypatch.setattr(queries_streams.written.Feed, "each", lambda self, batch, n: seen.append(batch) or each(self, batch, n))
    assert queries_streams.snk_08(spark, "/root/testdata/sf0.001").count() >= 0
    assert len(seen) == 3 and all("MapInPandas" not in b._jdf.queryExecution().optimizedPlan().toString() for b in seen)


def test_dense_keeps_a_few_rows_a_task(spark):
    """Three batches of one task and several slabs: what leaves the task is the best k of each query, not of each batch."""
    import numpy as np

    from kerbline.operators import retrieval

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(25_000, 4)), 3)
    x = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").coalesce(1)
    q = x.where("id % 5000 < 70").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    got, ends = retrieval.dense(x, q), {r.query_id: (r.best, r.worst) for r in retrieval.extremes(x, q).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.id, r.score))
    assert len(rows) == 350
    for k in (0, 69, 5000, 20_069):
        score = np.round(unit @ unit[k], 6)
        order = np.lexsort((np.arange(len(v)), -score))[:6]
        assert [s for _, s in rows[k]] == pytest.approx([score[i] for i in order], abs=2e-6)
        rest = np.delete(score, k)
        assert ends[k] == pytest.approx((rest.max(), rest.min()), abs=2e-6)
    left = []

    def seen(scored, k):
        left.append(scored.count())
        return scored

    best, retrieval._best = retrieval._best, seen
    try:
        retrieval.dense(x, q)
    finally:
        retrieval._best = best
    assert left == [350 * 6]


def test_medians_by_places(spark):
    rows = [("a", x) for x in (3.0, 1.0, 2.0, 2.0)] + [("b", 5.0), ("b", 7.0), ("b", None), (None, 4.0)] + [("c", float(i)) for i in range(1001)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    assert {r.g: r.median for r in statistics.medians(table, "g", "x").collect()} == {"a": 2.0, "b": 6.0, None: 4.0, "c": 500.0}


def test_scores_are_computed_once(spark):
    """The filter and the levels name a score many times; the plan rounds each signal once for the filter and once for the result."""
    from kerbline.plans import queries_files

    plan = queries_files.sc_sev_02(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") <= 20


def test_hash_words_of_odd_letters(spark, tmp_path):
    """A vertical tab parts no words, a final sigma and a dotted capital I are lowered like others: as in the SQL."""
    import duckdb

    from kerbline.plans import queries_joins

    texts = ["a\x0bb c", "ΟΔΟΣ x", "İstanbul y", "plain Ä words\twith\nbreaks", "", None]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.bits for r in queries_joins.phashes(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == dict(con.execute("with " + queries_joins._PHASH + "select doc_id, h from h where doc_id in (select doc_id from w)").fetchall())


def test_fields_are_read_once(spark):
    from kerbline.streaming import ingest

    plan = ingest.checked(spark.createDataFrame([("{}",)], "value string"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("try_variant_get") <= 6 * len(ingest.REPORT)


@pytest.mark.parametrize("fuzzy", [False, True])
@pytest.mark.parametrize("often", [1, 40, 1 << 17])
def test_bm25_in_bounded_tasks(spark, fuzzy, often):
    """Terms sent to all tasks or to none give the scores of the SQL, also for texts that are null, empty or share an id; no task sums more than a_task rows or so."""
    rng = random.Random(4)
    stems = ["a", "road", "roads", "roadside", "crack", "cracks", "patch", "patches", "potholes", "pothole", "gut\u00e9x", "Gutter"]
    texts = [" ".join(rng.choice(stems) + rng.choice(["", "", "s", "er", "x1"]) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "road road"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, "road " + texts[3]), (5, None), (5, "crack")]
    asked = [(0, "Road cracks a pothole"), (20, "patched patch gutter"), (40, "nothing"), (60, None)]
    d, q = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    found = retrieval.bm25(d, q, fuzzy=fuzzy, often=often, a_task=20)
    got = sorted(tuple(r) for r in found.select("query_id", "id", "score", "rank").collect())
    db = duckdb.connect()
    db.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    db.register("benchmark", pd.DataFrame(asked, columns=["item_id", "text"]))
    sql = queries_more._FUZZY if fuzzy else queries_more._BM25
    want = sorted(db.execute(sql + "select query_id, id, score, rank from r where rank <= 6").fetchall())
    assert len(want) > 6 and [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1.5e-6)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(int(n) for n in re.findall(r"RepartitionByExpression \[query_id\S+ id\S+\], (\d+)", plan)) >= 120 * 2 // 20 - (often == 1)
