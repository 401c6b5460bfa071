"""Operators without SQL against plain loops over small grids, and queries without SQL against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidegrid.operators import archive, catalog, colocate, components, features, geometry, morphology, stencil
from tidegrid.plans import fixtures as fx
from tidegrid.plans.registry import QUERIES
from tidegrid.sources import tables


def cells_of(spark, a, key="grid_id", name="f"):
    rows = [(0, int(y), int(x), None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, f"{key} int, y int, x int, {name} double")


def array_of(df, shape, value):
    out = np.full(shape, np.nan)
    for r in df.select("y", "x", value).collect():
        out[r.y, r.x] = np.nan if r[value] is None else r[value]
    return out


def contextual(a):
    """Medians of 3 x 3 where a value is extreme in its 3 x 3 and not in its 5 x 5 window; windows must lie inside and be present."""
    out = a.copy()
    for (y, x), v in np.ndenumerate(a):
        def extreme(h, y=y, x=x, v=v):
            if y < h or x < h or y + h >= a.shape[0] or x + h >= a.shape[1]:
                return False
            w = a[y - h : y + h + 1, x - h : x + h + 1]
            return bool(np.isfinite(w).all()) and (v == w.min() or v == w.max())

        if extreme(1) and not extreme(2):
            w = a[max(0, y - 1) : y + 2, max(0, x - 1) : x + 2]
            out[y, x] = np.nanmedian(w)
    return out


def test_iterated_median_is_the_loop(spark):
    a = np.random.default_rng(3).normal(size=(14, 15)).round(3) * 10
    a[4, 5] = np.nan
    got = array_of(stencil.iterated_median(cells_of(spark, a)), a.shape, "f")
    now = a
    while True:
        new = contextual(now)
        d = new - now
        d = d[np.isfinite(d) & (d != 0)]
        now = new
        if not len(d) or np.sqrt((d * d).mean()) <= 0.01:
            break
    np.testing.assert_allclose(got, now, equal_nan=True)


def flood(on, eight):
    """Labels of the cells that are on, by flood fill."""
    lab, n = np.zeros(on.shape, int), 0
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for start in zip(*np.nonzero(on), strict=True):
        if lab[start]:
            continue
        n += 1
        todo = [start]
        lab[start] = n
        while todo:
            y, x = todo.pop()
            for dy, dx in steps:
                p = (y + dy, x + dx)
                if 0 <= p[0] < on.shape[0] and 0 <= p[1] < on.shape[1] and on[p] and not lab[p]:
                    lab[p] = n
                    todo.append(p)
    return lab


@pytest.mark.parametrize("seed", [0, 1])
def test_cropped_is_the_loop(spark, seed):
    a = np.random.default_rng(seed).random((24, 26)) < 0.62
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    wide = np.pad(a, 1, constant_values=True)
    code = sum(wide[1 + dy : 25 + dy, 1 + dx : 27 + dx].astype(int) << k for k, (dy, dx) in enumerate(ring))
    kept = a & ~np.array(morphology.SPUR)[code]
    lab = flood(kept, True)
    kept &= np.bincount(lab.ravel())[lab] >= 7
    holes = flood(~kept, False)
    kept |= ~kept & (np.bincount(holes.ravel())[holes] < 20)
    m = spark.createDataFrame([(0, int(y), int(x)) for y, x in np.argwhere(a)], "grid_id int, y int, x int")
    now = components.holes_filled(components.without_small(morphology.without_spurs(m, 24, 26), 7), 24, 26, 20)
    assert {(r.y, r.x) for r in now.collect()} == set(map(tuple, np.argwhere(kept).tolist()))
    small = morphology.cropped(m, 24, 26)
    assert small.count() >= now.count()


def haversine(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(min(1.0, h)))


def test_length_is_the_loop(spark):
    rng = np.random.default_rng(5)
    rows = sorted({(int(k), int(y), int(x)) for k in range(1, 5) for y, x in rng.integers(0, 9, (6 * k, 2))}) + [(9, 40, 40)]
    pos = lambda y, x: (10 + 0.1 * y + 0.01 * x, -20 + 0.2 * x)
    df = spark.createDataFrame([(0, k, y, x, *pos(y, x)) for k, y, x in rows], "grid_id int, label int, y int, x int, lat double, lon double")
    got = {r.label: r.length_km for r in geometry.length_km(df).collect()}
    for label in {k for k, _, _ in rows}:
        own = sorted((y, x) for k, y, x in rows if k == label)
        step = max(1, len(own) // min(20, len(own)))
        dist = []
        for y, x in own[::step][:20]:
            near = [(y + dy, x + dx) for dy, dx in geometry.FIRST if (y + dy, x + dx) in own]
            dist += [haversine(*pos(y, x), *pos(*near[0]))] if near else []
        want = 0.0 if len(own) < 2 else len(own) * (np.mean(dist) if dist else 1.0)
        assert got[label] == pytest.approx(want)


def destriped(a, threshold):
    """Least squares in place of cosine transforms: the field whose forward differences are the kept ones."""
    h, w = a.shape
    rows, rhs = [], []
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0)):
                if y + dy < h and x + dx < w:
                    row = np.zeros(h * w)
                    row[(y + dy) * w + x + dx], row[y * w + x] = 1, -1
                    d = a[y + dy, x + dx] - a[y, x]
                    rows.append(row)
                    rhs.append(d if dx or abs(d) >= threshold else 0.0)
    smooth = np.linalg.lstsq(np.array(rows), np.array(rhs), rcond=None)[0].reshape(h, w)
    rest = a - smooth - (a - smooth).mean()
    wide = np.pad(rest, ((0, 0), (1, 1)), mode="edge")
    return a - np.median(np.stack([wide[:, :-2], wide[:, 1:-1], wide[:, 2:]]), axis=0)


def test_destriped_is_the_least_squares_field(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(7, 9)) + 5 + np.where(np.arange(7)[:, None] % 3 == 0, 0.4, 0)
    df = cells_of(spark, a, "image_id")
    np.testing.assert_allclose(array_of(archive.destriped_as(df, "f", 7, 9), a.shape, "clean"), destriped(a, 0.8), atol=1e-8)
    np.testing.assert_allclose(array_of(archive.destriped_as(df, "f", 7, 9, "chlorophyll"), a.shape, "clean"), destriped(np.log10(a + 1e-6), 0.1), atol=1e-8)
    np.testing.assert_allclose(array_of(archive.destriped_as(df, "f", 7, 9, "chlorophyll", 0.3), a.shape, "clean"), destriped(a, 0.3), atol=1e-8)
    below = a - 6
    np.testing.assert_allclose(array_of(archive.destriped_as(cells_of(spark, below, "image_id"), "f", 7, 9, "chlorophyll"), a.shape, "clean"), destriped(below, 0.1), atol=1e-8)
    with pytest.raises(ValueError, match="unknown type"):
        archive.destriped_as(df, "f", 7, 9, "wind")


def test_destriped_query_and_its_gradients(spark):
    got = QUERIES["n24_destriped"](spark, SF_SMALL).toPandas()
    im = fx.images(spark, SF_SMALL).toPandas()
    clean = {}
    for key, part in list(im.groupby("image_id"))[:2]:
        a = np.full((20, 20), np.nan)
        a[part.y, part.x] = part.f
        a = np.where(np.isnan(a), np.nanmean(a), a)
        clean[key] = destriped(a, 50.0)
        mine = got[got.image_id == key]
        np.testing.assert_allclose(mine.clean, clean[key][mine.y, mine.x], atol=1e-3)
    slope = QUERIES["n25_corrected_gradients"](spark, SF_SMALL).toPandas()
    assert len(slope) == len(got)
    key = min(clean)
    mid = slope[(slope.grid_id == key) & slope.x.between(1, 18) & slope.y.between(1, 18)].dropna()
    c = clean[key]
    np.testing.assert_allclose(mid.gx, (c[mid.y, mid.x + 1] - c[mid.y, mid.x - 1]) / 2, atol=1e-3)
    np.testing.assert_allclose(mid.gy, (c[mid.y + 1, mid.x] - c[mid.y - 1, mid.x]) / 2, atol=1e-3)


def test_components_of_variance_equal_numpys(spark):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    a = fx.read(spark, SF_SMALL, "lineitem").select(*[F.col(c).cast("double") for c in cols]).toPandas().to_numpy()
    z = (a - a.mean(axis=0)) / a.std(axis=0)
    share = np.sort(np.linalg.svd(z - z.mean(axis=0), compute_uv=False) ** 2)[::-1]
    share /= share.sum()
    got = QUERIES["a22_pca_variance"](spark, SF_SMALL).select("pc", "variance_ratio").distinct().toPandas().set_index("pc").variance_ratio
    np.testing.assert_allclose([got[k] for k in (1, 2, 3)], share[:3], atol=1e-5)
    back = QUERIES["a24_pca_reconstructed"](spark, SF_SMALL).first()
    assert all(back[c] == 0 for c in cols)


def test_geometry_holds_its_parts(spark):
    got = QUERIES["g06_geometry"](spark, SF_SMALL).toPandas().set_index(["grid_id", "label"])
    names = QUERIES["p24_front_ids"](spark, SF_SMALL).toPandas().set_index(["grid_id", "label"]).name
    sizes = QUERIES["g01_extent"](spark, SF_SMALL).toPandas().set_index(["grid_id", "label"]).npix
    assert len(got) == len(sizes) and (got.npix == sizes.reindex(got.index)).all()
    own = got.name.dropna()
    assert (own == names.reindex(own.index)).all() and set(names.dropna().index) == set(own.index)
    skeleton = QUERIES["m08_skeletons"](spark, SF_SMALL).groupBy("grid_id", "label").count().toPandas().set_index(["grid_id", "label"])["count"]
    assert ((got.length_km == 0) == (skeleton.reindex(got.index) == 1)).all()


def test_fields_by_f_and_columns_to_choose(spark):
    t = spark.createDataFrame([(1, 2.0, 3.0, -0.5, 1.0), (2, 2.0, None, 0.0, 1.0)], "flabel int, strain_n_mean double, divergence_p90 double, coriolis_f_median double, Theta double")
    got = features.over_f(t)
    assert tables.selectable(got) == ["coriolis_f_median", "Theta", "divergence_p90_over_f"]
    assert [(r.strain_n_mean_over_f, r.divergence_p90_over_f) for r in got.orderBy("flabel").collect()] == [(4.0, 6.0), (None, None)]
    assert features.over_f(t.drop("coriolis_f_median")).columns == [c for c in t.columns if c != "coriolis_f_median"]
    e = features.engineered(spark.createDataFrame([(None, 1.0, 0)], "lat double, v double, n int"), "lat", ["v"], logs=["v"], npix="n").first()
    assert (e.v_over_f, e.log_v, e.log_npix) == (None, 0.0, 0.0)


def test_fields_divided_by_f(spark):
    long = spark.createDataFrame([(1, "b", 0, 0, 2.0), (2, "b", 0, 0, 2.0), (3, "b", 0, 0, 2.0)], "uid int, field string, y int, x int, value double")
    where = spark.createDataFrame([(1, -30.0), (2, 0.0)], "uid int, lat double")
    got = {r.uid: (r.fnorm_b, r.afnorm_b) for r in catalog.gathered(long, ["fnorm_b", "afnorm_b"], catalog=where).collect()}
    assert got[1] == (pytest.approx(-2 / 7.2921e-5), pytest.approx(2 / 7.2921e-5)) and got[2] == got[3] == (2.0, 2.0)
    with pytest.raises(ValueError, match="catalogue"):
        catalog.gathered(long, ["fnorm_b"])
    with pytest.raises(ValueError, match="only averages"):
        colocate.label_averages(long, {"median_b": "value"})


def test_short_texts_are_pythons(spark):
    values = [0.0, 1.0, 12345.0, 12355.0, 0.00012345, 1e-5, -2.5, 123456.789, float("nan"), None, 1e22, float("inf")]
    t = spark.createDataFrame(list(enumerate(values, 1)), "label int, v double")
    got = tables.hover(t, t.unionByName(t.withColumn("label", F.lit(0))), ["v", "absent"]).orderBy("label").collect()
    assert [r.hover for r in got] == [f'{{"label":{k},"v":"{"NaN" if v is None or v != v else f"{v:.4g}"}"}}' for k, v in enumerate(values, 1)]


def test_shares_of_a_heavy_tail_and_clusters_in_many_columns(spark):
    v = np.exp(np.random.default_rng(4).normal(size=400) * 6).round(6)
    t = spark.createDataFrame([(float(a), k % 5) for k, a in enumerate(v)] + [(None, 1), (3.0, None)], "v double, w int")
    got = {r.v: r.share for parts in (None, 13) for r in features.cumulative_share(t, "w", "v", parts).collect()}
    w = np.arange(400) % 5
    assert set(got) == set(v) and all(got[a] == pytest.approx(w[v <= a].sum() / w.sum()) for a in v)
    p = np.random.default_rng(6).integers(0, 4, (60, 5)) * 1.0
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(p)], "id int, a double, b double, c double, d double, e double")
    near = ((p[:, None] - p[None]) ** 2).sum(axis=2) <= 2.0
    core = near.sum(axis=1) >= 3
    want = np.where(core, np.arange(60), -1)
    for _ in range(60):
        want = np.array([min(want[j] for j in range(60) if core[j] and near[k, j]) if core[k] else -1 for k in range(60)])
    want = [min((want[j] for j in range(60) if core[j] and near[k, j]), default=-1) for k in range(60)]
    for axes in (1, 3):
        rows = features.density_clusters(df, "id", list("abcde"), math.sqrt(2.0) + 1e-9, 3, axes).collect()
        assert [r.cluster for r in sorted(rows)] == want


def test_kinds_of_temperature(spark):
    for values, kind, first in (([280.0, 290.0, None], "kelvin", 280.0 - 273.15), ([-1.0, 2.0], "anomaly", -1.0), ([12.0, 18.0], "celsius", 12.0)):
        got = features.aligned_temperature(spark.createDataFrame([(v,) for v in values], "t double"), "t").collect()
        assert {r.kind for r in got} == {kind} and got[0].t == pytest.approx(first) and pd.isna([r.t for r in got]).sum() == pd.isna(values).sum()
