"""Writers, re-runs, splits and blocks, streams and component kernels against what they must leave behind."""

import heapq
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.test_brute import flood
from tests.test_lines_and_spheres import RING, blobs, cells, places, thin_loop
from tidegrid.functions import ocean
from tidegrid.operators import archive, catalog, colocate, components, geometry, morphology, ranking
from tidegrid.plans import fixtures as fx
from tidegrid.plans.registry import QUERIES
from tidegrid.sources import tables
from tidegrid.sources.npy import NpyDataSource
from tidegrid.streaming import jobs


def writer(df, path, mode="error", **options):
    w = df.write.format("npy").mode(mode).option("path", str(path))
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


def test_npy_maps_are_written_by_several_tasks(spark, tmp_path):
    spark.dataSource.register(NpyDataSource)
    rng = np.random.default_rng(1)
    a = rng.normal(size=(37, 23))
    a[3, 4] = np.nan
    df = spark.createDataFrame([(y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)], "y int, x int, value double").repartition(7)
    writer(df, tmp_path / "a.npy", "append", height=37, width=23)
    np.testing.assert_array_equal(np.load(tmp_path / "a.npy"), a)
    mask = df.filter("value > 0.5").withColumn("value", F.lit(1.0))
    writer(mask, tmp_path / "m.npy", "append", height=37, width=23, dtype="u1")
    got = np.load(tmp_path / "m.npy")
    assert got.dtype == np.uint8 and (got == (a > 0.5)).all()
    back = spark.read.format("npy").option("path", str(tmp_path / "m.npy")).option("nonzero", "true").load()
    assert places(back) == set(map(tuple, np.argwhere(a > 0.5).tolist()))
    writer(df.limit(0), tmp_path / "none.npy", "append", height=3, width=2)
    assert (np.load(tmp_path / "none.npy") == np.zeros((3, 2))).all()
    assert sorted(os.listdir(tmp_path)) == ["a.npy", "m.npy", "none.npy"]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    spark.dataSource.register(NpyDataSource)
    df = spark.range(20).selectExpr("cast(id div 5 as int) as y", "cast(id % 5 as int) as x", "cast(id as double) as value").repartition(4)
    writer(df, tmp_path / "a.npy", "append", height=4, width=5, dtype="i4")
    for wrong in (df.withColumn("y", F.col("y") + 1), df.withColumn("value", F.when(F.col("x") > 0, F.col("value")))):
        with pytest.raises(Exception, match="outside the array|no place for nulls"):
            writer(wrong, tmp_path / "a.npy", "overwrite", height=4, width=5, dtype="i4")
    with pytest.raises(Exception, match="a.npy"):
        writer(df, tmp_path / "a.npy", "append", height=4, width=5)
    assert os.listdir(tmp_path) == ["a.npy"] and (np.load(tmp_path / "a.npy").ravel() == np.arange(20)).all()
    writer(df.withColumn("value", -F.col("value")), tmp_path / "a.npy", "overwrite", height=4, width=5, dtype="i4")
    assert (np.load(tmp_path / "a.npy").ravel() == -np.arange(20)).all()


def test_runs_replace_only_their_partitions(spark, tmp_path):
    path, keys = f"{tmp_path}/runs", ("version", "snapshot")
    req = spark.createDataFrame([(1, s) for s in range(5)], "version int, snapshot int")
    made = []
    make = lambda tag: lambda todo: (made.append(sorted(r.snapshot for r in todo.collect())), todo.withColumn("tag", F.lit(tag)))[1]
    rows = lambda: {r.snapshot: r.tag for r in spark.read.parquet(path).collect()}
    assert tables.done_runs(spark, path, keys) is None
    tables.process_runs(req.filter("snapshot < 3"), path, make("a"), keys)
    tables.process_runs(req, path, make("b"), keys)
    assert tables.process_runs(req, path, make("c"), keys).count() == 0
    assert made == [[0, 1, 2], [3, 4]] and rows() == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b"}
    tables.process_runs(req.filter("snapshot in (1, 4)"), path, make("d"), keys, clobber=True)
    assert rows() == {0: "a", 1: "d", 2: "a", 3: "b", 4: "d"}
    with pytest.raises(Exception, match="broken"):
        tables.process_runs(req, path, lambda todo: todo.withColumn("tag", F.when(F.col("snapshot") == 3, F.raise_error(F.lit("broken"))).otherwise("e")), keys, clobber=True)
    assert rows() == {0: "a", 1: "d", 2: "a", 3: "b", 4: "d"}


def test_missing_inputs(spark):
    have = spark.createDataFrame([(1, "b"), (1, "b"), (2, "s")], "snapshot int, field string")
    want = spark.createDataFrame([(1, "b"), (2, "b"), (2, "b"), (2, "s"), (None, "s")], "snapshot int, field string")
    assert sorted(map(tuple, tables.missing_inputs(want, have).collect()), key=str) == [(2, "b"), (None, "s")]


def test_split_takes_the_first_in_hash_order(spark):
    t = spark.range(5000).selectExpr("id as uid", "id * 2 as v").repartition(5)
    order = sorted(range(5000), key=lambda u: ((u + 3) * 48271 % 2147483647, u))
    got = catalog.random_split(t, {"train": 100, "valid": 20, "test": 30}, seed=3).collect()
    assert {r.uid: r.split for r in got} == {u: "train" if k < 100 else "valid" if k < 120 else "test" for k, u in enumerate(order[:150])}
    assert {r.split for r in catalog.random_split(t, {"all": 9000}).collect()} == {"all"} and catalog.random_split(t.limit(0), {"a": 3}).count() == 0


def test_catalogue_by_blocks_of_days(spark):
    points = spark.createDataFrame([(float(k), float(-k)) for k in range(7)], "lat double, lon double")
    days = spark.range(11).selectExpr("date_add(date'2012-01-01', cast(id as int)) as day")
    rows = lambda df: sorted(map(tuple, df.select("lat", "lon", "datetime", "uid").collect()))
    got = catalog.generate(points, days, most=4)
    assert rows(got) == rows(catalog.generate(points, days)) and got.count() == 77 and got.select("uid").distinct().count() == 77
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_running_sums_by_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), None if v == 0 else float(v), int(c)) for k, v, c in zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300), rng.integers(1, 9, 300), strict=True)]
    df = components.checkpointed(spark.createDataFrame(rows, "k int, v double, c int"))
    key = lambda v: (v is not None, v or 0)
    for most in (10, 10**6):
        for r in ranking.running_sum(df, ("k",), "v", "c", "upto", most).collect():
            assert r.upto == sum(c for k, v, c in rows if k == r.k and key(v) <= key(r.v))


def test_percentiles_with_ranges_of_few_rows(spark, monkeypatch):
    monkeypatch.setattr(ranking.running_sum, "__defaults__", (5,))
    v = np.random.default_rng(5).normal(size=3000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    got = ranking.percentiles(df, "v", [0, 1, 33.3, 50, 99, 100], direct=10, accuracy=100).first()
    np.testing.assert_allclose(list(got), np.percentile(v, [0, 1, 33.3, 50, 99, 100]))


def test_merged_streams_let_state_go_and_drop_late_images(spark, tmp_path):
    start, folder = 1_600_000_000, f"{tmp_path}/in"
    for hour in range(13):
        rows = [(hour * 4 + k, start + hour * 3600 + k * 900) for k in range(4)] + ([(900, start)] if hour == 9 else [])
        spark.createDataFrame(rows, "image_id long, s long").selectExpr("image_id", "timestamp_seconds(s) as ts").coalesce(1).write.mode("append").parquet(folder)
    left = jobs.file_stream(spark, folder)
    right = left.withColumnsRenamed({"image_id": "other_id", "ts": "other_ts"})
    seen = jobs.merged_neighbours(left, right, 2, "1 hour")
    q = seen.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    got = {(r.image_id, r.other_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(a, b) for a in range(52) for b in range(52) if a != b and abs(a - b) * 900 <= 7200}
    # an image that comes nine hours late meets nothing; what is held does not grow with what has been
    assert got == want and held[-1] <= max(held[:8])


def test_measures_of_the_flow(spark):
    rng = np.random.default_rng(6)
    rows = [(*map(float, rng.normal(size=6)), float(x)) for x in np.linspace(-20, 20, 41)] + [(0.0,) * 6 + (40.0,)]
    names = ("u", "v", "ux", "uy", "vx", "vy", "lat")
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))
    for r in df.select("*", *[c.alias(n) for n, c in ocean.flow_measures(*[F.col(c) for c in names]).items()]).collect():
        bend = r.u**2 * r.vx - r.v**2 * r.uy + r.u * r.v * (r.vy - r.ux)
        f, speed = 2 * 7.2921e-5 * math.sin(math.radians(r.lat)), math.hypot(r.u, r.v)
        assert r.kinetic_energy == pytest.approx(speed**2 / 2)
        near = abs(r.lat) <= 6
        assert (r.vorticity is None) == (r.rossby is None) == near
        if bend:
            radius = speed**3 / bend
            assert r.radius == pytest.approx(radius) and r.beta_c == pytest.approx(speed / radius**2) and r.kappa == pytest.approx(1000 / radius)
            assert r.curvature_number is None if near else r.curvature_number == pytest.approx(2 * speed / f / (radius + 1))
        else:
            assert r.radius is r.beta_c is r.curvature_number is None


def test_counts_back_to_temperature(spark):
    k = [273.15, 290.004, 268.16, 300.0]
    df = spark.createDataFrame([(x,) for x in k], "k double").select("k", ocean.to_counts(F.col("k")).alias("n"))
    for r in df.select("k", ocean.from_counts(F.col("n"), celsius=False).alias("back"), ocean.from_counts(F.col("n")).alias("c")).collect():
        assert abs(r.back - r.k) <= 0.005 + 1e-9 and r.c == pytest.approx(r.back - 273.15)
    assert spark.range(1).select(ocean.from_counts(F.lit(-32768)).alias("c")).first().c is None


def test_front_pca_equals_numpy(spark):
    from tidegrid.plans.tables import FRONT_COLS

    t = colocate.label_statistics(fx.label_cells(spark, SF_SMALL), ["p1", "p2", "p3"], ("mean", "std"), min_size=2).select(*FRONT_COLS).toPandas().dropna().to_numpy(dtype=float)
    z = (t - t.mean(0)) / t.std(0)
    values = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    got = {r.pc: r.variance_ratio for r in QUERIES["a23_front_pca"](spark, SF_SMALL).collect()}
    np.testing.assert_allclose([got[k] for k in (1, 2, 3)], (values / values.sum())[:3], atol=1e-5)


def test_custom_statistic_as_grouped_pandas_udf(spark):
    colocate.register_stat("spread", _spread, pandas=True)
    df = spark.createDataFrame([(k % 5, float(k * k % 17)) for k in range(100)], "label int, p double")
    got = {r.label: r.p_spread for r in colocate.label_statistics(df, ["p"], ("spread", "mean")).collect()}
    assert got == {g: float(max(k * k % 17 for k in range(g, 100, 5)) - min(k * k % 17 for k in range(g, 100, 5))) for g in range(5)}


def _spread(column):
    import pandas as pd

    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return spread(column)


def test_one_dimensional_axes_make_a_grid(spark):
    lats = spark.createDataFrame([(0, 10.0), (1, 10.5)], "y int, lat double")
    lons = spark.createDataFrame([(0, -3.0), (1, -2.0), (2, -1.0)], "x int, lon double")
    grid = geometry.meshed(lats, lons)
    assert sorted(map(tuple, grid.collect())) == [(y, x, 10.0 + 0.5 * y, -3.0 + x) for y in (0, 1) for x in (0, 1, 2)]
    e = geometry.extent(grid.withColumns({"grid_id": F.lit(0), "label": F.when(F.col("x") < 2, 1).otherwise(2)})).orderBy("label").collect()
    assert [(r.npix, r.centroid_lat, r.centroid_lon, r.lon_range) for r in e] == [(4, 10.25, -2.5, 1.0), (2, 10.25, -1.0, 0.0)]


def is_simple(around):
    """Whether taking the middle of a 3 x 3 away keeps its surroundings in one piece, and the background too."""
    on = around.copy()
    on[1, 1] = False
    pieces = flood(on, True).max()
    off = ~on
    off[1, 1] = False
    lab = flood(off, False)
    return pieces == 1 and len({lab[p] for p in ((0, 1), (1, 0), (1, 2), (2, 1)) if lab[p]}) == 1


def sharpen_loop(a, v):
    on = np.pad(a, 1)
    heap = [(v[y, x], y, x) for y, x in np.argwhere(a).tolist()]
    heapq.heapify(heap)
    waiting = {(y, x) for _, y, x in heap}
    while heap:
        _, y, x = heapq.heappop(heap)
        waiting.discard((y, x))
        w = on[y : y + 3, x : x + 3]
        if not w[1, 1] or w.sum() < 3 or not is_simple(w):
            continue
        on[y + 1, x + 1] = False
        for dy, dx in RING:
            q = (y + dy, x + dx)
            if on[q[0] + 1, q[1] + 1] and q not in waiting:
                waiting.add(q)
                heapq.heappush(heap, (v[q], *q))
    return on[1:-1, 1:-1]


@pytest.mark.parametrize("pack", [10**6, 40])
def test_sharpening_is_the_loop(spark, monkeypatch, pack):
    monkeypatch.setattr(morphology._by_component, "__defaults__", ("label", pack))
    a = blobs(11, (26, 28), 0.55)
    v = np.random.default_rng(1).integers(0, 40, a.shape).astype(float)
    field = spark.createDataFrame([(0, y, x, float(z)) for (y, x), z in np.ndenumerate(v)], "grid_id int, y int, x int, f double")
    lab = components.checkpointed(components.label(cells(spark, a)))
    want = sharpen_loop(a, v)
    got = morphology.sharpened(lab, field, "f")
    assert places(got) == set(map(tuple, np.argwhere(want).tolist())) and want.sum() < a.sum()
    of = flood(want, True)
    big = want & (np.bincount(of.ravel())[of] >= 6)
    assert places(morphology.sharpened(lab, field, "f", 6)) == set(map(tuple, np.argwhere(big).tolist()))


def prune_loop(a, longest):
    on = {tuple(p) for p in np.argwhere(a).tolist()}
    near = lambda p: [(p[0] + dy, p[1] + dx) for dy, dx in RING if (p[0] + dy, p[1] + dx) in on]
    while True:
        count, gone = {p: len(near(p)) for p in on}, set()
        for end in (p for p in on if count[p] == 1):
            path, length = [end], 0.0
            while True:
                ahead = [q for q in near(path[-1]) if q not in path]
                if len(ahead) != 1:
                    break
                length += math.dist(path[-1], ahead[0])
                if length > longest:
                    break
                if count[ahead[0]] >= 3:
                    gone |= set(path)
                    break
                path.append(ahead[0])
        if not gone:
            return on
        on -= gone


def test_pruning_is_the_loop(spark):
    a = blobs(12, (40, 40), 0.45)
    for longest in (2, 5):
        want = prune_loop(thin_loop(a), longest)
        assert places(morphology.despurred(cells(spark, a), longest)) == want


def test_cosine_transforms_are_their_matrices():
    for n in (1, 2, 5, 8, 37):
        a = np.random.default_rng(n).normal(size=(3, n))
        np.testing.assert_allclose(archive._cosines(a), a @ archive._dct(n).T, atol=1e-12)
        np.testing.assert_allclose(archive._cosines(archive._cosines(a), back=True), a, atol=1e-12)


@pytest.mark.parametrize("lines", [64, 3])
def test_images_destriped_by_lines_equal_those_of_one_task(spark, lines):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3):
        a = np.cumsum(rng.normal(size=(13, 18)), axis=1) + np.where(np.arange(13) % 4 == k, 2.0, 0.0)[:, None]
        a[2, 5] = np.nan
        rows += [(k, y, x, None if k == 2 else float(v)) for (y, x), v in np.ndenumerate(a) if (k, y, x) != (1, 3, 3)]
    df = spark.createDataFrame(rows, "image_id int, y int, x int, f double").repartition(3)
    read = lambda t: {(r.image_id, r.y, r.x): (r.clean, r.stripes) for r in t.collect()}
    got, want = read(archive.destriped_by_lines(df, "f", 13, 18, 0.8, lines=lines)), read(archive.destriped(df, "f", 13, 18, 0.8))
    assert got.keys() == want.keys() and len(got) == len(rows)
    np.testing.assert_allclose([got[k] for k in got], [want[k] for k in got], atol=1e-9)
