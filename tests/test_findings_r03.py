"""What the third review found: inputs on which a query failed or differed before."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows
from tidegrid.operators import archive, components, density, features, geometry, morphology, stencil
from tidegrid.plans.registry import ORACLE, QUERIES
from tidegrid.streaming import jobs


def equal_to_sql(spark, folder, name: str) -> int:
    got, want = QUERIES[name](spark, str(folder)), connect(str(folder)).sql(ORACLE[name])
    mine = rows(got.columns, got.collect())
    assert mine == rows(want.columns, want.fetchall())
    return len(mine)


def grid_of(table: str, folder, ids, **columns) -> None:
    key = {"events": "event_id", "orders": "o_orderkey"}[table]
    ids = np.asarray(ids, dtype=np.int64)
    pq.write_table(pa.table({key: ids} | {c: f(ids) for c, f in columns.items()}), f"{folder}/{table}.parquet")


def test_f1_long_chains_in_the_order_of_their_ids_become_one_component(spark):
    n = 3000
    edges = spark.range(n - 1).selectExpr("id as a", "id + 1 as b").union(spark.range(n, 2 * n - 1).selectExpr("id as a", "id + 1 as b"))
    got = components.min_label_components(edges, small=20, rounds=12)
    assert got.count() == 2 * n
    assert {(r[0], r[1]) for r in got.groupBy("label").count().collect()} == {(0, n), (n, n)}


@pytest.mark.parametrize("width", [9, 70])
def test_f12_f21_holes_need_only_rows_about_the_mask(spark, width):
    height, most, rng = 60, 8, np.random.default_rng(3)
    on = {(0, y, x) for y in (0, 1, 2, 5, 6, 57) for x in range(width) if rng.random() < 0.75} | {(1, 30, x) for x in range(width)} | {(1, 31, 0)}
    mask = spark.createDataFrame(sorted(on), "grid_id int, y int, x int")
    want = set(on)
    for g in (0, 1):
        left = {(y, x) for y in range(height) for x in range(width)} - {(y, x) for k, y, x in on if k == g}
        while left:
            todo = [left.pop()]
            group = set(todo)
            while todo:
                y, x = todo.pop()
                for c in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if c in left:
                        left.remove(c)
                        group.add(c)
                        todo.append(c)
            if len(group) < most:
                want |= {(g, y, x) for y, x in group}
    got = components.holes_filled(mask, height, width, most)
    assert {tuple(r) for r in got.collect()} == want and want > on


def test_f12_f21_a_tall_grid_costs_rows_about_the_mask(spark):
    # all rows of each grid would be a thousand million
    mask = spark.range(1000).selectExpr("cast(id as int) as grid_id", "cast(id * 40 as int) as y", "5 as x")
    assert components.holes_filled(mask, 1_000_000, 100).count() == 1000


def test_f7_differences_equal_but_for_rounding_are_ties(spark):
    f = [50.12, 0.0, 20.11, 0.0, 70.13, 0.0, 40.12, 0.0, 10.11]
    assert abs(f[4] - f[2]) != abs(f[4] - f[6]) or abs(f[0] - f[2]) != abs(f[6] - f[8])
    best = max(range(1, 8), key=lambda x: (round(abs(f[x + 1] - f[x - 1]), 6), -x))
    field = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate(f)], "grid_id int, y int, x int, f double")
    mask = spark.createDataFrame([(0, 0, x) for x in range(1, 8)], "grid_id int, y int, x int")
    assert [r["x"] for r in morphology.gradient_thinned(mask, field, "f").collect()] == [best]
    # the later of two, larger by rounding alone, loses
    near = spark.createDataFrame([(0, 0, x, v) for x, v in enumerate([0.0, 5.0, 0.1 + 0.2, 5.0, 0.0, 5.0, 0.30000000000000010])], "grid_id int, y int, x int, f double")
    two = spark.createDataFrame([(0, 0, 1), (0, 0, 3), (0, 0, 5)], "grid_id int, y int, x int")
    assert [r["x"] for r in morphology.gradient_thinned(two, near, "f").collect()] == [1]


def test_f8_files_in_any_order_of_time(spark, tmp_path):
    path = tmp_path / "events.parquet"
    os.makedirs(path)
    began = dt.datetime(2024, 1, 1)
    for k in range(3):
        at = [began + dt.timedelta(days=25 - 12 * k, seconds=21600 * i + (21599.7 if i == 3 else 5.2)) for i in range(40)]
        pq.write_table(pa.table({"event_id": np.arange(40) + 40 * k, "ts": pa.array(at, pa.timestamp("us")), "value": np.linspace(1, 99, 40)}), path / f"part-{k}.parquet")
        os.utime(path / f"part-{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    assert equal_to_sql(spark, tmp_path, "st1_snapshot_counts") > 100
    assert equal_to_sql(spark, tmp_path, "st3_merged_neighbours") >= 0


def test_f9_rows_beside_the_equator_stay(spark, tmp_path):
    grid_of("orders", tmp_path, range(39500, 40500), o_totalprice=lambda k: (k * 7919 % 50021) * 1.25, o_custkey=lambda k: k * 31 % 997)
    assert equal_to_sql(spark, tmp_path, "n20_frontogenesis_parts") == 6 * 96


@pytest.mark.parametrize("name, first", [("n19_geographic_gradient", 1500), ("n19_skewed_gradient", 4880)])
def test_f10_f11_gradients_towards_a_pole(spark, tmp_path, name, first):
    grid_of("events", tmp_path, range(100 * (first - 5), 100 * (first + 10)), value=lambda k: (k * 7919 % 10007) / 100)
    assert equal_to_sql(spark, tmp_path, name) > 500


def test_f22_means_need_no_window_over_a_grid(spark):
    cells = spark.range(100).selectExpr("case when id < 50 then 1 end as grid_id", "cast(id as int) as y", "0 as x", "cast(id as double) as f")
    got = stencil.demeaned(cells, "f")
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r["grid_id"], r["s"]) for r in got.groupBy("grid_id").agg(F.sum("f").alias("s")).collect()} == {(1, 0.0), (None, 0.0)}
    assert got.count() == 100


def test_f14_f16_samples_move_with_their_tile(spark):
    rng = np.random.default_rng(5)
    cells = [(y, x, None if rng.random() < 0.2 else float(rng.integers(0, 40))) for y in range(40) for x in range(30) if rng.random() < 0.9]
    field = spark.createDataFrame(cells, "y int, x int, v double")
    lines = spark.createDataFrame([(s, m, 2 * s + m, (m * (s + 1)) % 30) for s in range(6) for m in range(1, 26)], "seg int, m int, y int, x int")
    arrays = archive.profile_arrays(lines, field, "v", 40, 30, 5, tile=8)
    long = archive.profiles(lines, field, "v", 40, 30, 5)
    assert sorted((r.seg, r.m, r.s.offset, r.s.v is None, r.s.v or 0) for r in arrays.select("seg", "m", F.explode("s").alias("s")).collect()) == sorted((r.seg, r.m, r.offset, r.v is None, r.v or 0) for r in long.collect())
    for f in (archive.across, archive.steepest_offset):
        assert sorted(map(str, f(arrays).collect())) == sorted(map(str, f(long).collect())) and f(long).count() > 100
    plan = archive.across(arrays)._jdf.queryExecution().executedPlan().toString()
    # no shuffle of samples after the tiles have met
    assert "Exchange" not in plan[: plan.index("FlatMapCoGroupsInArrow")]


def test_f2_neighbours_in_time_are_held_in_tables(spark, tmp_path):
    path, n = tmp_path / "events.parquet", 240
    os.makedirs(path)
    began, rng = dt.datetime(1969, 12, 31, 12), np.random.default_rng(2)
    # days about 1970, gaps of exactly two hours and copies of a time, in three files
    seconds = [int(k) for k in rng.integers(0, 86400, n - 40)] + [7200 * k for k in range(10)] + [7200 * k for k in range(30)]
    at = [began + dt.timedelta(seconds=k, microseconds=k % 2) for k in seconds]
    for k in range(3):
        pq.write_table(pa.table({"event_id": np.arange(k, n, 3), "ts": pa.array([*at[k::3][:-1], None], pa.timestamp("us")), "value": np.ones(n // 3)}), path / f"part-{k}.parquet")
    assert equal_to_sql(spark, tmp_path, "st3_merged_neighbours") > 5000
    images = jobs.file_stream(spark, str(path)).select(F.col("event_id").alias("image_id"), F.col("ts").cast("timestamp").alias("ts"))
    assert jobs.neighbours_by_batch(images, 2, str(tmp_path / "held")).count() > 5000
    # no state in the executors; a table of what was seen, one part a batch
    assert len([p for p in (tmp_path / "held").glob("stream-*-seen/batch=*")]) == 3
    assert not [p for p in (tmp_path / "held").glob("stream-*-state/state")]


@pytest.fixture
def plans(monkeypatch):
    """Plans of all tables that are written on the way."""
    seen, write = [], components.checkpointed

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    for module in (components, density, geometry):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


def test_f17_f18_f20_f25_no_join_of_a_round_goes_through_the_driver(spark, plans):
    cells = spark.range(400).selectExpr("cast(id % 2 as int) as grid_id", "cast(id div 2 as int) as y", "5 as x")
    lines = archive.line_order(cells, small=10)
    plans.append(lines._jdf.queryExecution().executedPlan().toString())
    assert [(r.grid_id, r.seg, r.m) for r in lines.orderBy("grid_id", "seg", "m").collect()] == [(g, 1, m) for g in (0, 1) for m in range(1, 201)]
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("at_once, target", [(1, 0.01), (3, 0.01), (8, 30.0)])
def test_f15_f19_medians_by_tiles_are_the_rounds(spark, plans, at_once, target):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 60, (37, 29)).astype(float)
    cells = [(g, y - 3, x, None if rng.random() < 0.02 else float(a[y, x]) + g) for g in (0, 1) for y in range(37) for x in range(29) if rng.random() < 0.99]
    df = spark.createDataFrame(cells, "grid_id int, y int, x int, f double")
    want, old = df.toPandas().set_index(["grid_id", "y", "x"]).sort_index(), None
    while old is None or ((d := (want - old)["f"].dropna())[d != 0] ** 2).mean() ** 0.5 > target:
        old = want
        want = stencil.contextual_median(spark.createDataFrame(old.astype(object).where(old.notna(), None).reset_index(), df.schema)).toPandas().set_index(["grid_id", "y", "x"]).sort_index()
    plans.clear()
    got = stencil.iterated_median(df, target=target, tile=16, at_once=at_once).toPandas().set_index(["grid_id", "y", "x"]).sort_index()
    assert len(got) == len(cells) and got["f"].equals(want["f"])
    # one shuffle for some rounds, none for each
    assert len(plans) > 1 and all(p.count("Exchange") <= 1 and "Window" not in p for p in plans)


def brute_clusters(points: dict, eps: float, least: int) -> dict:
    keys = sorted(points)
    at = np.array([points[k] for k in keys])
    near = ((at[:, None] - at[None]) ** 2).sum(axis=2) <= eps * eps
    core, label = near.sum(axis=1) >= least, np.full(len(keys), -1)
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = i
                todo += list(np.flatnonzero(near[j] & core))
    return {k: keys[label[i]] if core[i] else keys[min(label[near[i] & core])] if (near[i] & core).any() else -1 for i, k in enumerate(keys)}


@pytest.fixture
def written(monkeypatch):
    """Numbers of rows of all tables that are written on the way."""
    seen, write = [], components.checkpointed

    def noted(df):
        got = write(df)
        seen.append(got.count())
        return got

    for module in (components, density, features):
        monkeypatch.setattr(module, "checkpointed", noted)
    return seen


@pytest.mark.parametrize("least, most_pairs", [(2, 0), (4, 300), (9, 5_000_000)])
def test_f23_clusters_of_copies_dense_and_sparse_places(spark, least, most_pairs):
    rng = np.random.default_rng(least)
    parts = [rng.normal(0, 0.6, (120, 2)), rng.uniform(-9, 9, (120, 2)), rng.integers(-6, 6, (60, 2)) * 0.5, np.repeat(rng.uniform(-9, 9, (6, 2)), 5, axis=0), np.array([[1e9, 0.0], [1e9 + 1, 0.0], [1e9 + 2, 0.0], [-0.0, 20.0], [0.0, 21.0]])]
    points = {k * 7 + 3: tuple(p) for k, p in enumerate(rng.permutation(np.concatenate(parts)).tolist())}
    df = spark.createDataFrame([(k, *p) for k, p in points.items()] + [(1, None, 0.0), (2, 0.0, float("nan"))], "id long, a double, b double")
    got = {r[0]: r[1] for r in features.density_clusters(df, "id", ["a", "b"], 1.0, least, most_pairs=most_pairs).collect()}
    assert got == brute_clusters(points, 1.0, least) | {1: -1, 2: -1}


def test_f23_pairs_grow_with_the_places(spark, written):
    # two blobs that all of 2,000 distinct points lie in, and 20,000 copies of a point: 400 million pairs within the radius
    n, rng = 2000, np.random.default_rng(4)
    blobs = [(k, *p) for k, p in enumerate((rng.uniform(0, 0.5, (n, 2)) + np.where(np.arange(n) % 2, 1.3, 0.0)[:, None]).tolist())]
    copies = spark.range(n, n + 20000).selectExpr("id", "30.0d as a", "cast(30 as double) as b")
    got = features.density_clusters(spark.createDataFrame(blobs, "id long, a double, b double").union(copies), "id", ["a", "b"], 1.0, 4, most_pairs=1000)
    assert sorted(r[:] for r in got.groupBy("cluster").count().collect()) == sorted([(n, 20000), *[(min(g), len(g)) for g in _groups(brute_clusters({k: (a, b) for k, a, b in blobs}, 1.0, 4))]])
    assert max(written) <= 4 * n


def _groups(labels: dict) -> list[list]:
    out: dict = {}
    for k, c in labels.items():
        out.setdefault(c, []).append(k)
    return list(out.values())


def test_f24_f26_geometry_is_two_aggregations_and_one_join_with_the_grid(spark, plans):
    rng = np.random.default_rng(6)
    cells = [(g, lab, y, 7 * lab + x, -10 + 0.1 * y, 0.1 * (7 * lab + x)) for g in (0, 1) for lab in range(1, 6) for y in range(12) for x in range(6) if rng.random() < 0.15 * lab]
    df = spark.createDataFrame(cells, "grid_id int, label long, y int, x int, lat double, lon double")
    grid = spark.createDataFrame([(g, y, x, -10 + 0.1 * y, 0.1 * x) for g in (0, 1) for y in range(12) for x in range(40)], "grid_id int, y int, x int, lat double, lon double")
    thin = df.filter("(y + x) % 4 <> 1")
    got = geometry.geometry(df, thin.select("grid_id", "label", "y", "x"), "2012-11-09", grid=grid)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sum(p.count("Exchange hashpartitioning") for p in plans) <= 12
    for part in (geometry.front_ids(df, "2012-11-09", grid=grid), geometry.extent(df), geometry.length_km(thin, grid=grid), geometry.orientation(df), geometry.branches(thin), geometry.curvature(thin)):
        fields = lambda t: sorted(str([f"{v:.9g}" if isinstance(v, float) else v for v in r]) for r in t.select(part.columns).collect())  # noqa: B023, E731
        assert fields(got) == fields(part) and part.count() == 10
    on = {(r.grid_id, r.label, r.y, r.x) for r in thin.collect()}
    branches = {}
    for g, lab, y, x in on:
        n = sum((g, lab, y + dy, x + dx) in on for dy in (-1, 0, 1) for dx in (-1, 0, 1)) - 1
        branches[g, lab] = branches.get((g, lab), 0) + (n >= 3)
    assert {(r.grid_id, r.label): r.num_branches for r in got.collect()} == branches


@pytest.mark.parametrize("batch", [1, 7, 10000])
def test_f24_small_groups_share_a_call_and_stay_whole(spark, batch):
    # groups of 1 to 9 rows of two keys, then one that is larger than a batch
    rows_ = [(k, k % 3, j) for k in range(40) for j in range(k % 9 + 1)] + [(99, 0, j) for j in range(60)]
    df = spark.createDataFrame(rows_, "a int, b int, j int").repartition(5)

    def run(pdf):
        of = components.group_numbers(pdf, ["a", "_b"])
        return pdf[["a"]].assign(n=pd.Series(of).map(pd.Series(of).value_counts()), groups=of[-1] + 1)

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = components.by_group(df, {"a": F.col("a"), "_b": F.col("b")}, run, "a int, n long, groups long").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(r[:2] for r in got) == sorted((a, 60 if a == 99 else a % 9 + 1) for a, _, _ in rows_)
    assert batch < 10000 or max(r.groups for r in got) > 1


def test_f24_many_small_grids_thin_and_label_as_each_alone(spark):
    rng = np.random.default_rng(3)
    # copies of one shape in many grids, across edges of blocks and tiles
    shape = [(y, x) for y in range(250, 262) for x in range(440, 452) if rng.random() < 0.7]
    grids = [(g, y, x) for g in range(30) for y, x in shape]
    lab = components.checkpointed(components.label(spark.createDataFrame(grids, "grid_id int, y int, x int")))
    thin = morphology.skeletons(lab)
    for got in (lab, thin):
        by_grid = {}
        for r in got.collect():
            by_grid.setdefault(r.grid_id, set()).add((r.y, r.x, r.label))
        assert len(by_grid) == 30 and len({frozenset(v) for v in by_grid.values()}) == 1
    one = [r[:] for r in lab.filter("grid_id = 7").select("y", "x", "label").collect()]
    y, x, name = (np.array(c) for c in zip(*one, strict=True))
    want = {c for c, on in zip(one, morphology.thin_kernel(morphology.Cells(y, x, name)), strict=True) if on}
    assert {r[:] for r in thin.filter("grid_id = 7").select("y", "x", "label").collect()} == want


def test_f24_tiles_before_the_origin_are_not_made(spark, monkeypatch):
    asked, grouped = [], components.by_group
    monkeypatch.setattr(components, "by_group", lambda df, *a: asked.append(df.count()) or grouped(df, *a))
    df = spark.range(2000).selectExpr("cast(id % 2 as int) as grid_id", "1L as label", "cast(id div 100 as int) as y", "cast(id div 2 % 50 as int) as x")
    assert morphology.skeletons(df).count() > 0 and asked[0] == 2000


def test_f24_a_loaded_run_takes_the_positions_of_its_run(spark):
    plan = QUERIES["s08_loaded_run"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "struct<o_orderkey" in plan and "struct<event_id" not in plan


@pytest.mark.parametrize("small, block", [(0, (2, 3)), (200_000, (2, 3)), (0, (64, 4096))])
def test_f24_f26_runs_are_joined_within_blocks_first(spark, monkeypatch, small, block):
    rng, asked, rounds = np.random.default_rng(8), [], components.min_label_components
    monkeypatch.setattr(components, "min_label_components", lambda edges, *a, **k: asked.append(edges.count()) or rounds(edges, *a, **k))
    on = {(g, y, x) for g in (0, 1) for y in range(30) for x in range(25) if rng.random() < 0.4}
    got = {(r.grid_id, r.y, r.x): r.label for r in components.label(spark.createDataFrame(sorted(on), "grid_id int, y int, x int"), small=small, block=block).collect()}
    want, n = {}, {0: 0, 1: 0}
    for c in sorted(on):
        if c not in want:
            n[c[0]] += 1
            todo = [c]
            while todo:
                g, y, x = todo.pop()
                if (g, y, x) in on and (g, y, x) not in want:
                    want[g, y, x] = n[g]
                    todo += [(g, y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    assert got == want
    assert asked[0] > 0 if block[0] == 2 else asked == [0]
