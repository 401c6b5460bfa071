import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.operators import colocate, components, detect, features, geometry, morphology, stencil
from tidegrid.operators.maps import ring_pixel


def mask(spark, text):
    rows = [(0, y, x) for y, line in enumerate(text.strip("\n").split("\n")) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "grid_id int, y int, x int")


SPIRAL = """
########
.......#
######.#
#....#.#
#.##.#.#
#.#..#.#
#.####.#
########
"""
COMB = "\n".join(["#.#.#.#"] * 5 + ["#######"])
CHAIN = "\n".join("." * k + "#" for k in range(12))


@pytest.mark.parametrize(("text", "eight", "four"), [(SPIRAL, 1, 1), (COMB, 1, 1), (CHAIN, 1, 12), ("#", 1, 1), ("#.#\n.#.\n#.#", 1, 5), ("####\n####", 1, 1)])
@pytest.mark.parametrize("small", [200_000, 0])
def test_component_counts(spark, text, eight, four, small):
    m = mask(spark, text)
    for conn, want in ((2, eight), (1, four)):
        got = components.label(m, conn, small).collect()
        assert len(got) == text.count("#") and {r.label for r in got} == set(range(1, want + 1))
        first = {}
        for r in sorted(got, key=lambda r: (r.y, r.x)):
            first.setdefault(r.label, (r.y, r.x))
        assert [first[k] for k in sorted(first)] == sorted(first.values())


def test_components_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(0, int(y), int(x)) for y, x in np.argwhere(rng.random((30, 30)) < 0.45)]
    want = None
    for n in (1, 7):
        df = spark.createDataFrame(rows, "grid_id int, y int, x int").repartition(n)
        for small in (200_000, 0):
            got = sorted(map(tuple, components.label(df, 2, small).collect()))
            assert want is None or got == want
            want = got
    assert components.label(spark.createDataFrame([], "grid_id int, y int, x int")).count() == 0


def grid_of(df, h, w):
    a = np.zeros((h, w), dtype=bool)
    for r in df.collect():
        a[r.y, r.x] = True
    return a


def count(a):
    """8-connected components by flood fill."""
    left, n = {tuple(p) for p in np.argwhere(a)}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            y, x = todo.pop()
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
    return n


def test_thinning_and_sharpening_keep_components_and_are_subsets(spark):
    rng = np.random.default_rng(2)
    a = rng.random((24, 24)) < 0.55
    m = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(a)], "grid_id int, y int, x int")
    field = spark.createDataFrame([(0, y, x, float(v)) for (y, x), v in np.ndenumerate(rng.random((24, 24)))], "grid_id int, y int, x int, f double")
    lab = components.checkpointed(components.label(m))
    thin = morphology.thinned(m, lab)
    t = grid_of(thin, 24, 24)
    assert not (t & ~a).any() and count(t) == count(a) and t.sum() < a.sum()
    assert (grid_of(morphology.thinned(components.checkpointed(thin)), 24, 24) == t).all()
    s = grid_of(morphology.sharpened(lab, field, "f"), 24, 24)
    assert not (s & ~a).any() and count(s) == count(a) and s.sum() < a.sum()


def test_bands_thin_to_their_steepest_line(spark):
    field = spark.createDataFrame([(0, y, x, 285.0 if x < 25 else 290.0) for y in range(50) for x in range(50)], "grid_id int, y int, x int, sst double")
    band = spark.createDataFrame([(0, y, x) for y in range(50) for x in (24, 25, 26)], "grid_id int, y int, x int")
    got = morphology.gradient_thinned(band, field, "sst").collect()
    assert {r.x for r in got} == {24} and len(got) == 50
    cold = field.withColumn("sst", F.when(F.col("y").between(20, 29), 265.0).otherwise(F.col("sst")))
    assert not [r for r in morphology.gradient_thinned(band, cold, "sst", valid_from=271.35).collect() if 20 <= r.y < 30]
    assert morphology.gradient_thinned(band.limit(0), field, "sst").count() == 0


def test_side_branch_goes_and_line_stays(spark):
    line = mask(spark, "\n".join(["." * 6 + "#" + "." * 5] * 2 + ["############"]))
    got = morphology.despurred(line, 3)
    assert grid_of(got, 3, 12)[2].sum() >= 10 and not grid_of(got, 3, 12)[0].any()


def test_local_threshold_does_not_depend_on_tiles(spark):
    rng = np.random.default_rng(3)
    v = rng.random((40, 40))
    v[5:8, 5:8] = np.nan
    df = spark.createDataFrame([(0, y, x, None if np.isnan(z) else float(z)) for (y, x), z in np.ndenumerate(v)], "grid_id int, y int, x int, f double")
    want = {(y, x) for y in range(40) for x in range(40) if v[y, x] > np.nanpercentile(v[max(0, y - 4) : y + 4, max(0, x - 4) : x + 4], 90)}
    for tile in (16, 64):
        assert {(r.y, r.x) for r in stencil.local_threshold(df, "f", 8, 90, tile).collect()} == want


def test_detection_pipeline_and_empty_grid(spark):
    df = spark.createDataFrame([(0, y, x, 100.0 - abs(x - 15) if abs(x - 15) < 2 else float((y * 7 + x) % 5), 0.0, 0.0) for y in range(30) for x in range(30)], "grid_id int, y int, x int, f double, lat double, lon double")
    got = detect.features(df, "f", 30, 30, window=16, threshold=80, sharpen=True, dilate=True, min_size=5)
    assert {r.x for r in got.collect()} <= {13, 14, 15, 16, 17} and got.count() >= 25
    assert detect.features(df.withColumn("f", F.lit(None).cast("double")), "f", 30, 30, mode="global").count() == 0


def test_dilation_ties_and_own_cells(spark):
    lab = spark.createDataFrame([(0, 1, 0, 0), (0, 2, 0, 3)], "grid_id int, label int, y int, x int")
    near = {(r.y, r.x): r.label for r in colocate.dilate_nearest(lab, 2, 1, 5).collect()}
    assert near == {(0, 0): 1, (0, 1): 1, (0, 2): 2, (0, 3): 2, (0, 4): 2}
    first = {(r.y, r.x): r.label for r in colocate.dilate_first(lab, 3, 1, 5).collect()}
    assert first == {(0, 0): 1, (0, 1): 1, (0, 2): 1, (0, 3): 1, (0, 4): 2}


def test_front_ids(spark):
    cells = spark.createDataFrame([(0, 1, 5, 5, 0.35, -60.25)], "grid_id int, label int, y int, x int, lat double, lon double")
    assert geometry.front_ids(cells, "2012-11-09T12:00:00").first().name == "20121109T120000_0.3N_60.2W"
    assert geometry.front_ids(cells, "2012-11-09T12:00:00", legacy_id=True).first().name.startswith("20121109TT120000")


def test_pca_reconstructs_and_density_clusters_find_blobs(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 0.2, (40, 2)), rng.normal(5, 0.2, (40, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(pts)], "id long, a double, b double")
    labels = {r.id: r.cluster for r in features.density_clusters(df, "id", ["a", "b"], 1.0, 4).collect()}
    assert {labels[k] for k in range(40)} == {0} and {labels[k] for k in range(40, 80)} == {40} and labels[80] == -1
    pca = features.PCA(df, ["a", "b"], 2)
    back = pca.reconstruct(pca.project(df), [1, 2]).collect()
    assert max(abs(r.a - r.a_back) + abs(r.b - r.b_back) for r in back) < 1e-9 and abs(pca.ratio.sum() - 1) < 1e-12


def test_ring_pixels_have_equal_areas(spark):
    n = 4
    rng = np.random.default_rng(5)
    z, phi = rng.uniform(-1, 1, 60000), rng.uniform(-180, 180, 60000)
    df = spark.createDataFrame([(float(np.degrees(np.arcsin(a))), float(b)) for a, b in zip(z, phi)], "lat double, lon double")
    got = df.groupBy(ring_pixel(F.col("lat"), F.col("lon"), n).alias("p")).count().collect()
    assert sorted(r.p for r in got) == list(range(12 * n * n))
    c = np.array([r["count"] for r in got])
    assert abs(c - 60000 / len(c)).max() < 6 * np.sqrt(60000 / len(c))


def test_filled_reaches_across_gaps_of_any_width(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    # a strip wider than 200 cells, a square with few cells, and a grid without any
    for g, h, w, at in ((0, 3, 460, {(1, 0), (2, 459)}), (1, 60, 60, {(0, 0), (59, 59), (20, 41), (41, 20), (30, 59)}), (2, 4, 4, set())):
        value = {p: float(v) for p, v in zip(sorted(at), rng.permutation(len(at)), strict=True)}
        for y in range(h):
            for x in range(w):
                rows.append((g, y, x, value.get((y, x))))
                want[g, y, x] = value[min(at, key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p))] if at else None
    df = spark.createDataFrame(rows, "grid_id int, y int, x int, f double").repartition(3)
    got = stencil.filled(df, "f").collect()
    assert len(got) == len(rows) and {(r.grid_id, r.y, r.x): r.f for r in got} == want
