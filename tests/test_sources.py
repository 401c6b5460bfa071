import numpy as np
import pytest

from tidegrid.operators import catalog, match
from tidegrid.sources import tables
from tidegrid.sources.npy import NpyDataSource


def test_npy_blocks_and_crop(spark, tmp_path):
    a = np.arange(600, dtype=float).reshape(20, 30)
    a[3, 4] = np.nan
    np.save(tmp_path / "a.npy", a)
    spark.dataSource.register(NpyDataSource)
    df = spark.read.format("npy").option("path", str(tmp_path / "a.npy")).option("rows", 7).load()
    assert df.count() == 600 and df.filter("value is null").collect()[0][:2] == (3, 4)
    crop = spark.read.format("npy").option("path", str(tmp_path / "a.npy")).option("y0", 5).option("y1", 9).option("x0", 2).option("x1", 4).load()
    assert sorted((r.y, r.x, r.value) for r in crop.collect()) == [(y, x, a[y, x]) for y in range(5, 9) for x in range(2, 4)]
    assert spark.read.format("npy").option("path", str(tmp_path / "a.npy")).option("nonzero", "true").load().count() == 599


def test_formats(spark, tmp_path):
    df = spark.range(3)
    for ext in ("csv", "parquet"):
        tables.write_table(df, f"{tmp_path}/t.{ext}")
        assert tables.read_table(spark, f"{tmp_path}/t.{ext}").count() == 3
    with pytest.raises(ValueError, match="unknown format"):
        tables.write_table(df, f"{tmp_path}/t.xyz")
    with pytest.raises(ValueError, match="unknown format"):
        tables.read_table(spark, f"{tmp_path}/t.xyz")


def test_lookups(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "uid long, k string")
    assert catalog.find_one(t, k="a") == 1 and catalog.find_one(t, k="z") == -1
    with pytest.raises(ValueError, match="several"):
        catalog.find_one(t, k="b")
    with pytest.raises(KeyError):
        catalog.find_one(t, nope=1)
    with pytest.raises(ValueError, match="no match"):
        catalog.matched(t, t.filter("uid < 3"))
    with pytest.raises(ValueError, match="unknown"):
        catalog.vet(t, {"uid": "bigint"})


def test_balanced_sample_is_even_and_keeps_the_maximum_reachable(spark):
    t = spark.range(1000).selectExpr("id as uid", "case when id < 900 then id / 900.0 else 9.0 + id / 1000.0 end as m")
    got = catalog.balanced_sample(t, "m", 5, 200).groupBy("bin").count().collect()
    assert sum(r["count"] for r in got) == 200 and {r["bin"]: r["count"] for r in got} == {0: 100, 4: 100}
    assert catalog.balanced_sample(t, "m", 5, 2000).count() == 1000


def test_nearest_time_takes_the_earlier_at_ties(spark):
    src = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (30.0,)], "t double")
    tgt = spark.createDataFrame([(5.0,), (-3.0,), (10.0,), (21.0,), (99.0,)], "t double")
    got = {r.t: (r.source_t, r.gap) for r in match.nearest_time(tgt, src).collect()}
    assert got == {5.0: (0.0, 5.0), -3.0: (0.0, 3.0), 10.0: (10.0, 0.0), 21.0: (30.0, 9.0), 99.0: (30.0, 69.0)}
    assert match.nearest_time(tgt, src, most=4).count() == 2
