"""What the fourth review found: inputs on which a query failed or differed before."""

import datetime as dt

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect
from tests.test_findings_r03 import brute_clusters, grid_of
from tidegrid.operators import components, density
from tidegrid.plans.registry import ORACLE, QUERIES
from tidegrid.streaming import jobs


@pytest.mark.parametrize("bounds", [{}, {"most": 7, "most_pairs": 100_000}])
def test_f1_pairs_in_time_take_no_disk(spark, tmp_path, bounds):
    n, rng = 800, np.random.default_rng(1)
    (tmp_path / "events").mkdir()
    # half of them at one time, the others over nine hours
    at = [dt.datetime(2024, 1, 1, 5)] * (n // 2) + [dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(s)) for s in rng.integers(0, 32400, n - n // 2)]
    for k in range(2):
        pq.write_table(pa.table({"image_id": np.arange(k, n, 2), "ts": pa.array(at[k::2], pa.timestamp("us"))}), tmp_path / f"events/part-{k}.parquet")
    images = jobs.file_stream(spark, str(tmp_path / "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    got = jobs.neighbours_by_batch(images, 2, str(tmp_path / "held"), **bounds)
    t = np.array(at, dtype="datetime64[us]").astype("int64")
    want = {(a, b) for a, b in zip(*np.nonzero(np.abs(t[:, None] - t[None, :]) <= 7_200_000_000)) if a != b}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) > 200_000 and set(rows) == want
    # a few bytes an image, whatever its pairs
    assert sum(p.stat().st_size for p in (tmp_path / "held").rglob("*.parquet")) < 40 * n


@pytest.mark.parametrize("most", [200_000, 0])
def test_f7_copies_of_a_place_count_once_in_a_scan(spark, monkeypatch, most):
    rows, write = [], components.checkpointed

    def noted(df):
        got = write(df)
        rows.append(got.count())
        return got

    monkeypatch.setattr(density, "checkpointed", noted)
    monkeypatch.setattr(density, "BROADCAST_PLACES", most, raising=False)
    rng = np.random.default_rng(4)
    some = rng.uniform(0, 6, (40, 2)).round(1)
    # 400 points at one place, one to nine at others, those of zero with either sign; keys in no order
    at = [(0.0, 0.0)] * 200 + [(-0.0, 0.0)] * 200 + [tuple(map(float, p)) for i, p in enumerate(some) for _ in range(i % 9 + 1)]
    points = {int(k): p for k, p in zip(rng.permutation(len(at)) + 7, at)}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()] + [(1, None, 1.0), (2, float("nan"), 1.0)], "uid long, a double, b double")
    params = [(0.3, 2), (0.3, 7), (0.9, 4), (0.9, 12)]
    got = {(r.eps, r.min_points, r.uid): r.cluster for r in density.clusters(df, "uid", ["a", "b"], params).collect()}
    assert len(got) == len(params) * (len(points) + 2)
    for eps, m in params:
        assert {k: got[eps, m, k] for k in points} == brute_clusters(points, eps, m)
        assert got[eps, m, 1] == got[eps, m, 2] == -1
    # pairs of places, not of points
    assert max(rows) < 41 * 41


def test_f6_balanced_flow_beside_the_equator_has_all_digits(spark, tmp_path):
    # the equator and the rows where a latitude that goes on comes back to it
    ids = [k for y in (400, 2200, 4000, 5800) for k in range(100 * (y - 5), 100 * (y + 6))]
    grid_of("orders", tmp_path, ids, o_totalprice=lambda k: (k * 7919 % 50021) * 1.25, o_custkey=lambda k: k * 31 % 997)
    got = {(r.y, r.x): (r.whole, r.geo, r.ageo) for r in QUERIES["n20_frontogenesis_parts"](spark, str(tmp_path)).collect()}
    want = {r[:2]: r[2:] for r in connect(str(tmp_path)).sql(ORACLE["n20_frontogenesis_parts"]).fetchall()}
    assert set(got) == set(want) and len(want) > 2000
    assert max(abs(v[1]) for v in want.values() if np.isfinite(v[1])) > 1e12
    # to the last digits, where the two were off by some thousand of them
    for k, w in want.items():
        np.testing.assert_allclose(got[k], w, rtol=4e-15, atol=0)
