"""Matching on the sphere, density clusters, lines in order, tiles and detection steps against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_brute import flood, haversine
from tidegrid.operators import archive, components, density, detect, histograms, match, morphology, stencil

# what stands around a cell that goes as a spur, up to quarter turns
SPURS = ["...\n.#.\n...", ".#.\n.#.\n...", "#..\n.#.\n...", "##.\n.#.\n...", ".#.\n.##\n...", "###\n.#.\n..."]
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


def spur_grids():
    out = set()
    for text in SPURS:
        a = np.array([[c == "#" for c in line] for line in text.split("\n")])
        for turn in range(4):
            out.add(tuple(np.rot90(a, turn).ravel().tolist()))
    return out


def without_spurs(a):
    wide, grids, out = np.pad(a, 1, constant_values=True), spur_grids(), a.copy()
    for y, x in np.argwhere(a):
        out[y, x] = tuple(wide[y : y + 3, x : x + 3].ravel().tolist()) not in grids
    return out


def cells(spark, a):
    return spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(a)], "grid_id int, y int, x int")


def places(df):
    return {(r.y, r.x) for r in df.collect()}


def test_all_256_neighbourhoods(spark):
    grids = spur_grids()
    assert len(grids) == 21
    a = np.zeros((5, 4 * 256 + 1), dtype=bool)
    for code in range(256):
        a[2, 4 * code + 2] = True
        for k, (dy, dx) in enumerate(RING):
            a[2 + dy, 4 * code + 2 + dx] = code >> k & 1
    got = places(morphology.without_spurs(cells(spark, a), *a.shape))
    assert got == set(map(tuple, np.argwhere(without_spurs(a)).tolist()))
    gone = [c for c in range(256) if (2, 4 * c + 2) not in got]
    assert len(gone) == 21


def test_spurs_of_a_small_picture(spark):
    a = np.array([[0, 0, 0, 0], [0, 0, 1, 0], [0, 1, 0, 0], [1, 1, 0, 0]], dtype=bool)
    assert places(morphology.without_spurs(cells(spark, a), 4, 4)) == {(2, 1), (3, 0), (3, 1)}


def thin_loop(a):
    """Two half-steps over and over, cell by cell, by the rules of Guo and Hall."""
    a = np.pad(a, 1)
    while True:
        before = a.sum()
        for half in (0, 1):
            gone = []
            for y, x in np.argwhere(a):
                p2, p3, p4, p5, p6, p7, p8, p9 = (bool(a[y + dy, x + dx]) for dy, dx in RING)
                c = (not p2 and (p3 or p4)) + (not p4 and (p5 or p6)) + (not p6 and (p7 or p8)) + (not p8 and (p9 or p2))
                n = min((p9 or p2) + (p3 or p4) + (p5 or p6) + (p7 or p8), (p2 or p3) + (p4 or p5) + (p6 or p7) + (p8 or p9))
                m = ((p2 or p3 or not p5) and p4) if half == 0 else ((p6 or p7 or not p9) and p8)
                if c == 1 and 2 <= n <= 3 and not m:
                    gone.append((y, x))
            for p in gone:
                a[p] = False
        if a.sum() == before:
            return a[1:-1, 1:-1]


def without_small(a, least=7):
    lab = flood(a, True)
    return a & (np.bincount(lab.ravel())[lab] >= least)


def holes_filled(a, most=64):
    lab = flood(~a, False)
    return a | (~a & (np.bincount(lab.ravel())[lab] < most))


def dilated(a):
    wide = np.pad(a, 1)
    return wide[1:-1, 1:-1] | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]


def chain(a, rounds=2):
    a = dilated(a)
    for k in range(rounds):
        a = holes_filled(without_small(without_spurs(thin_loop(a))))
        a = dilated(a) if k < rounds - 1 else a
    return thin_loop(a)


def blobs(seed, shape=(40, 44), share=0.5):
    rng = np.random.default_rng(seed)
    v = rng.random(shape)
    for _ in range(2):
        w = np.pad(v, 1, mode="edge")
        v = sum(w[1 + dy : 1 + dy + shape[0], 1 + dx : 1 + dx + shape[1]] for dy, dx in [*RING, (0, 0)]) / 9
    return v > np.quantile(v, share)


@pytest.mark.parametrize(("tile", "halo"), [(512, 64), (16, 2), (7, 4)])
def test_thinning_is_the_loop_whatever_the_tiles(spark, tile, halo):
    a = blobs(1)
    lab = cells(spark, a).withColumn("label", F.lit(1))
    got = places(morphology.thinned_in_tiles(lab, tile, halo))
    assert got == set(map(tuple, np.argwhere(thin_loop(a)).tolist())) and len(got) < a.sum() / 2


def test_thinning_takes_labels_apart_and_counts_rounds(spark):
    a = np.ones((6, 20), dtype=bool)
    lab = cells(spark, a).withColumn("label", F.when(F.col("y") < 3, 5).otherwise(2))
    got = morphology.skeletons(lab).collect()
    for label, rows in ((5, slice(0, 3)), (2, slice(3, 6))):
        want = np.zeros_like(a)
        want[rows] = thin_loop(a[rows])
        assert {(r.y, r.x) for r in got if r.label == label} == set(map(tuple, np.argwhere(want).tolist()))
    one = morphology.thinned(cells(spark, a), rounds=1)
    assert len(places(morphology.thinned(cells(spark, a)))) < one.count() < a.sum()
    assert morphology.thinned(cells(spark, a[:0])).count() == 0


def test_thinning_chain_is_the_loop(spark):
    a = blobs(4, share=0.6)
    assert places(morphology.thinning_chain(cells(spark, a), *a.shape)) == set(map(tuple, np.argwhere(chain(a)).tolist()))


def field_of(spark, v):
    rows = [(0, int(y), int(x), None if np.isnan(z) else float(z), float(y)) for (y, x), z in np.ndenumerate(v)]
    return spark.createDataFrame(rows, "grid_id int, y int, x int, f double, lat double")


def above_local(v, window, pct):
    h = window // 2
    out = np.zeros(v.shape, dtype=bool)
    for (y, x), z in np.ndenumerate(v):
        w = v[max(0, y - h) : y + h, max(0, x - h) : x + h]
        out[y, x] = not np.isnan(z) and z > np.nanpercentile(w, pct)
    return out


def sobel_loop(v):
    wide = np.pad(v, 1, mode="edge")
    out = np.full(v.shape, np.nan)
    for y, x in np.ndindex(v.shape):
        w = wide[y : y + 3, x : x + 3]
        gx = (w[:, 2] - w[:, 0]) @ [1, 2, 1] + 0 * w[:, 1].sum()
        gy = (w[2] - w[0]) @ [1, 2, 1] + 0 * w[1].sum()
        out[y, x] = math.hypot(gx, gy) * math.cos(math.radians(y))
    return out


def test_sobel_has_no_value_beside_a_gap(spark):
    v = np.random.default_rng(3).random((7, 9))
    v[2, 3], v[6, 8] = np.nan, np.nan
    df = field_of(spark, v).filter("not (y = 4 and x = 6)")
    v[4, 6] = np.nan
    got = {(r.y, r.x): r.sobel for r in stencil.sobel(df, "f").collect()}
    want = sobel_loop(v)
    assert all((got[p] is None) == bool(np.isnan(want[p])) and (got[p] is None or math.isclose(got[p], want[p], abs_tol=1e-12)) for p in got)
    assert len(got) == v.size - 1 and sum(x is None for x in got.values()) > 15


def test_automatic_detection_is_the_loop(spark):
    rng = np.random.default_rng(6)
    y, x = np.mgrid[:34, :36]
    v = np.round(np.where(x + 3 * np.sin(y / 5) > 17, 20.0, 10.0) + rng.random((34, 36)), 3)
    v[3, 30] = np.nan
    got = detect.automatic(field_of(spark, v), "f", 34, 36, window=16, threshold=85)
    smooth = np.full(v.shape, np.nan)
    for r in got["filtered"].collect():
        smooth[r.y, r.x] = np.nan if r.f is None else r.f
    near = np.zeros(v.shape, dtype=bool)
    for p in np.argwhere(np.isnan(v)):
        near |= (y - p[0]) ** 2 + (x - p[1]) ** 2 <= 16
    edge = sobel_loop(np.where(near, np.nan, smooth))
    want = chain(above_local(edge, 16, 85))
    assert places(got["features"]) == set(map(tuple, np.argwhere(want).tolist())) and want.sum() > 20


def test_nearest_on_the_sphere(spark):
    rng = np.random.default_rng(8)
    lat = np.concatenate([rng.uniform(-90, 90, 60), rng.uniform(84, 90, 60), rng.uniform(-2, 2, 60), [90, -90, 0, 0, 80]])
    lon = np.concatenate([rng.uniform(-180, 180, 120), rng.choice([-1, 1], 60) * rng.uniform(178.5, 180, 60), [17, 5, 180, -180, 179]])
    t = rng.integers(0, 20, len(lat)).astype(float)
    left = [(k, float(a), float(b), float(c)) for k, (a, b, c) in enumerate(zip(lat, lon, t, strict=True))]
    right = [(1000 + k, float(np.clip(a + rng.normal(0, 0.4), -90, 90)), float((b + rng.normal(0, 2) + 540) % 360 - 180), c + float(rng.integers(-7, 8))) for k, a, b, c in left]
    right += [(5000 + k, *r[1:]) for k, r in enumerate(right[:20])] + [(7000, 0.0, -179.9, 3.0), (7001, 80.0, -179.0, 3.0), (9000, None, 3.0, 3.0), (9001, 1.0, 1.0, None)]
    schema = "uid long, lat double, lon double, t double"
    for degrees, days in ((0.5, 6), (3.0, 6), (170.0, 2)):
        want = {}
        for k, a, b, c in left:
            near = [(haversine(a, b, q, r) / 6371 * 180 / math.pi, j) for j, q, r, s in right if q is not None and s is not None and abs(s - c) < days]
            best = min(near, default=None)
            if best and best[0] <= degrees:
                want[k] = best
        got = match.nearest_in_space_time(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), days, degrees).collect()
        assert {r.uid: r.uid_o for r in got} == {k: j for k, (_, j) in want.items()} and len(want) > 20
        assert all(math.isclose(r.degrees, want[r.uid][0], abs_tol=1e-9) for r in got)
    none = match.nearest_in_space_time(spark.createDataFrame([], schema), spark.createDataFrame(right, schema), 6, 1.0)
    assert none.count() == 0


def test_matched_histogram(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(0, 1, 500), rng.normal(0.5, 2, 300)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "v double")
    got = histograms.matched_histogram(frame(a), frame(b), "v").orderBy("bin").collect()
    edges = np.linspace(*np.percentile(np.concatenate([a, b]), [1, 99]), 80)
    assert [r.n_left for r in got] == np.histogram(a, edges)[0].tolist() and [r.n_right for r in got] == np.histogram(b, edges)[0].tolist()
    assert np.allclose([r.lo for r in got] + [got[-1].hi], edges)
    empty = spark.createDataFrame([], "v double")
    assert histograms.matched_histogram(empty, empty, "v").count() == 0


@pytest.mark.parametrize("boxes", [100_000, 0])
def test_far_cells_go_down_the_pyramid(spark, monkeypatch, boxes):
    monkeypatch.setattr(match, "BOXES", boxes)
    rng = np.random.default_rng(4)
    at = [(0, int(y), int(x), -70 + 0.5 * int(y), -170 + 0.5 * int(x)) for y, x in {tuple(p) for p in rng.integers(0, 30, (150, 2)).tolist()}] + [(0, 500, 500, 30.0, 100.0)]
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40), strict=True))]
    cells_, pts = spark.createDataFrame(at, "grid_id int, y int, x int, lat double, lon double"), spark.createDataFrame(points, "id int, lat double, lon double")
    got = {r.id: (r.y, r.x) for r in match._far_cell(pts, cells_, "id").collect()}
    assert got == {k: min(((a - c[3]) ** 2 + (b - c[4]) ** 2, c[1], c[2]) for c in at)[1:] for k, a, b in points}
    plan = match._far_cell(pts, cells_, "id")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def dbscan(pts, eps, m):
    near = [[j for j in range(len(pts)) if math.dist(pts[i], pts[j]) <= eps] for i in range(len(pts))]
    core = [len(n) >= m for n in near]
    label = [-1] * len(pts)
    for i in range(len(pts)):
        if core[i] and label[i] < 0:
            label[i], todo = i, [i]
            while todo:
                for j in near[todo.pop()]:
                    if core[j] and label[j] < 0:
                        label[j] = i
                        todo.append(j)
    edge = lambda i: min((label[j] for j in near[i] if core[j]), default=-1)
    return [label[i] if core[i] else edge(i) for i in range(len(pts))]


@pytest.mark.parametrize("small", [200_000, 0])
def test_clusters_of_all_parameters_from_one_graph(spark, small):
    rng = np.random.default_rng(7)
    pts = np.concatenate([rng.normal(c, s, (25, 4)) for c, s in ((0, 0.3), (3, 0.5), (6, 0.2))] + [rng.uniform(-3, 9, (15, 4))]).round(2)
    pts = np.concatenate([pts, pts[:6], pts[:6]])  # copies
    rows = [(k, *map(float, p)) for k, p in enumerate(pts)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0, 1.0), (901, float("nan"), 1.0, 1.0, 1.0)], "id long, a double, b double, c double, d double")
    params = [(0.4, 3), (0.7, 3), (0.7, 6), (1.3, 10)]
    found = components.checkpointed(density.clusters(df, "id", ["a", "b", "c", "d"], params, small=small))
    got = {(r.eps, r.min_points, r.id): r.cluster for r in found.collect()}
    assert len(got) == len(params) * (len(rows) + 2)
    for eps, m in params:
        assert [got[eps, m, k] for k in range(len(rows))] == dbscan(pts.tolist(), eps, m)
        assert got[eps, m, 900] == got[eps, m, 901] == -1
    table = {(r.eps, r.min_points): r for r in density.scan(found, params, 0.5).collect()}
    for p, r in table.items():
        own = [c for (e, m, _), c in got.items() if (e, m) == p]
        assert r.n_clusters == len(set(own) - {-1}) and math.isclose(r.noise_share, own.count(-1) / len(own))
    good = [p for p in params if table[p].noise_share < 0.5 and table[p].n_clusters]
    assert [p for p in params if table[p].chosen] == [max(good, key=lambda p: table[p].n_clusters)]
    assert not density.scan(found, params, 0.0).filter("chosen").count()


@pytest.mark.parametrize("small", [200_000, 0])
def test_spanning_forest_is_kruskal(spark, small):
    rng = np.random.default_rng(9)
    rows = [(g, int(a), int(b), float(w)) for g in (1, 2) for a, b, w in zip(rng.integers(0, 30, 80), rng.integers(0, 30, 80), rng.integers(0, 9, 80), strict=True)]
    got = sorted(map(tuple, density.spanning_forest(spark.createDataFrame(rows, "m int, a long, b long, w double"), ("m",), small).select("m", "a", "b", "w").collect()))
    want, root = [], {(g, k): k for g in (1, 2) for k in range(30)}
    for g, w, a, b in sorted({(g, w, min(a, b), max(a, b)) for g, a, b, w in rows}):
        p, q = root[g, a], root[g, b]
        if p != q:
            want.append((g, a, b, w))
            root = {k: q if k[0] == g and v == p else v for k, v in root.items()}
    assert got == sorted(want)


def ordered_lines(on):
    """Lines walked cell by cell."""
    def near(p):
        out = []
        for dy, dx in RING:
            q = (p[0] + dy, p[1] + dx)
            if q in on and (dy == 0 or dx == 0 or ((p[0] + dy, p[1]) not in on and (p[0], p[1] + dx) not in on)):
                out.append(q)
        return out

    plain = {p for p in on if len(near(p)) <= 2}
    link = {p: sorted(set(near(p)) & plain) for p in plain}
    left, lines = set(plain), []
    for p in sorted(plain):
        if p not in left:
            continue
        whole, todo = {p}, [p]
        while todo:
            for q in link[todo.pop()]:
                if q not in whole:
                    whole.add(q)
                    todo.append(q)
        ends = [q for q in whole if len(link[q]) < 2]
        line = [min(ends) if ends else p]
        while True:
            ahead = [q for q in link[line[-1]] if q not in line]
            if not ahead:
                break
            line.append(ahead[0])
        assert set(line) == whole
        left -= whole
        lines.append(line)
    return lines


@pytest.mark.parametrize("small", [200_000, 0])
def test_lines_in_order(spark, small):
    ring = {(int(round(20 + 8 * math.sin(k / 40))), int(round(20 + 8 * math.cos(k / 40)))) for k in range(252)}
    wave = {(40 + round(3 * math.sin(x / 4)), x) for x in range(60)}
    diagonal = {(60 + k, 5 + k) for k in range(30)}
    stairs = {(70 + k // 2, 50 + (k + 1) // 2) for k in range(31)}
    fork = {(100, x) for x in range(20)} | {(100 + k, 10) for k in range(9)} | {(100 - k, 10 + k) for k in range(5)}
    on = ring | wave | diagonal | stairs | fork | {(120, 3)} | {(125, 1), (125, 2)} | {(130 + a, 4 + b) for a in (0, 1) for b in (0, 1)}
    df = spark.createDataFrame([(0, *p) for p in on] + [(3, 5, x) for x in range(40)], "grid_id int, y int, x int").repartition(3)
    got = components.checkpointed(archive.line_order(df, small)).orderBy("grid_id", "seg", "m").collect()
    lines = {}
    for r in got:
        lines.setdefault((r.grid_id, r.seg), []).append((r.y, r.x))
    want = ordered_lines(on)
    assert [lines[0, k + 1] for k in range(len(want))] == want and lines[3, 1] == [(5, x) for x in range(40)] and len(lines) == len(want) + 1


def test_profiles_across_curved_and_closed_lines(spark):
    on = {(int(round(20 + 8 * math.sin(k / 40))), int(round(20 + 8 * math.cos(k / 40)))) for k in range(252)} | {(45 + k, 5 + k) for k in range(12)} | {(50, 40), (51, 41), (51, 42)}
    df = spark.createDataFrame([(0, *p) for p in on], "grid_id int, y int, x int")
    field = spark.createDataFrame([(y, x, float(y * 100 + x)) for y in range(64) for x in range(64)], "y int, x int, v double")
    lines = archive.line_order(df).select(F.col("seg"), "m", "y", "x")
    got = {(r.seg, r.m, r.offset): r.v for r in archive.profiles(lines, field, "v", 64, 64, 3).collect()}
    want = {}
    for s, line in enumerate(ordered_lines(on), 1):
        n = len(line)
        for i in range(n):
            a, b = (0, n - 1) if n < 5 else (0, 4) if i < 2 else (n - 5, n - 1) if i >= n - 2 else (i - 2, i + 2)
            dy, dx = line[b][0] - line[a][0], line[b][1] - line[a][1]
            size = math.hypot(dy, dx)
            for k in range(-3, 4):
                y, x = (min(63, max(0, round(v))) for v in (line[i][0] + k * dx / size, line[i][1] - k * dy / size))
                want[s, i + 1, k] = float(y * 100 + x)
    assert got == want
