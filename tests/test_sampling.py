"""Moments of recordings by hand."""

from kerbline.operators import sampling


def test_grid_and_middles(spark):
    v = spark.createDataFrame([(1, 1.0, 4.0, 2), (2, 1.01, 4.0, 1), (3, 0.0, 4.0, 0), (4, 5.0, 0.0, None), (5, 0.7, 100.0, -1)], "video_id long, duration_s double, fps double, n long")
    got = sorted((r.video_id, r.i, round(r.t, 9)) for r in sampling.grid(v, 0.2).collect())
    assert got == [(1, i, i / 4) for i in range(4)] + [(2, i, i / 4) for i in range(5)] + [(5, i, round(i * 0.2, 9)) for i in range(4)]
    assert sorted((r.video_id, r.t) for r in sampling.middles(v).collect()) == [(1, 0.25), (1, 0.75), (2, 0.505)]
    assert sampling.grid(v.limit(0)).count() == 0
