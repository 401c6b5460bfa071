import numpy as np

from tidegrid.operators import match, ranking


def test_bracketed_percentiles_equal_direct_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(g, float(v)) for g, n in ((0, 3000), (1, 700), (2, 1)) for v in np.round(rng.normal(size=n) ** 3, 2)] + [(3, None), (0, None), (1, 1e300)]
    df = spark.createDataFrame(rows, "g int, v double").repartition(3)
    pcts = [0, 1, 12.5, 50, 90, 100]
    for direct in (10**6, 1000, 500):
        got = {r.g: list(r)[1:] for r in ranking.percentiles(df, "v", pcts, "g", direct=direct).collect()}
        assert got.keys() == {0, 1, 2}
        for g, x in got.items():
            assert np.allclose(x, np.percentile([v for k, v in rows if k == g and v is not None], pcts), rtol=1e-9)
    whole = ranking.percentiles(df, "v", [50.0], direct=100).first().p0
    assert abs(whole - np.median([v for _, v in rows if v is not None])) < 1e-9


def test_cells_are_found_at_any_distance(spark):
    cells = spark.createDataFrame([(0, y, x, 50.0 + y, 100.0 + x) for y in range(3) for x in range(3)], "grid_id int, y int, x int, lat double, lon double")
    points = spark.createDataFrame([(1, -80.0, -170.0), (2, 51.2, 101.1), (3, 89.0, 179.0)], "uid long, lat double, lon double")
    got = {r.uid: (r.y, r.x) for r in match.nearest_cell(points, cells, "uid", 0.5).collect()}
    assert got == {1: (0, 0), 2: (1, 1), 3: (2, 2)}
