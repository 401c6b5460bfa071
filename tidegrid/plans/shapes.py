"""Queries of components, morphology, detection, geometry and co-location, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators import archive, colocate, components, detect, geometry, morphology, stencil
from tidegrid.plans import fixtures as fx
from tidegrid.plans.stencils import r, size
from tidegrid.sources import tables

QUERIES, ORACLE = {}, {}
E, M, O = fx.GRID_EVENTS, fx.MASK_INT, fx.GRID_ORDERS


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def labelled(view: str = "mask_int", name: str = "labels", touch: str = "abs(m.y - r.y) <= 1 and abs(m.x - r.x) <= 1") -> str:
    """Components of a small mask by reachability: label is the rank of the first cell in raster order."""
    return f"""{name}_r(grid_id, y, x, v, u) as (select grid_id, y, x, y, x from {view} union
  select r.grid_id, m.y, m.x, r.v, r.u from {name}_r r join {view} m on m.grid_id = r.grid_id and {touch}),
{name}_m as (select grid_id, y, x, min(v * 100000 + u) as root from {name}_r group by grid_id, y, x),
{name} as (select grid_id, y, x, dense_rank() over (partition by grid_id order by root) as label from {name}_m)"""


def rec(*views: str, then: str) -> str:
    return "with recursive " + ",\n".join(views) + "\n" + then


SIDES = "abs(m.y - r.y) + abs(m.x - r.x) = 1"


@query("m01_components", rec(E, M, labelled(), then="select grid_id, y, x, label from labels"))
def m01(spark: SparkSession, d: str) -> DataFrame:
    return components.label(fx.mask_int(spark, d))


@query("m01_components_by_sides", rec(E, M, labelled(touch=SIDES), then="select grid_id, y, x, label from labels"))
def m01b(spark: SparkSession, d: str) -> DataFrame:
    return components.label(fx.mask_int(spark, d), 1)


@query("m02_labels_present", rec(E, M, labelled(), then="select distinct grid_id, label from labels"))
def m02(spark: SparkSession, d: str) -> DataFrame:
    return components.label(fx.mask_int(spark, d)).select("grid_id", "label").distinct()


@query("m03_component_table", rec(E, M, labelled(), then="""
select grid_id, label, count(*) as npix, min(y) as y0, max(y) + 1 as y1, min(x) as x0, max(x) + 1 as x1, round(avg(y), 6) as cy, round(avg(x), 6) as cx from labels group by grid_id, label"""))
def m03(spark: SparkSession, d: str) -> DataFrame:
    return components.table(components.label(fx.mask_int(spark, d))).withColumns({"cy": F.round("cy", 6), "cx": F.round("cx", 6)})


@query("m04_without_small", rec(E, M, labelled(), then="""
select grid_id, y, x from labels where (grid_id, label) in (select (grid_id, label) from labels group by grid_id, label having count(*) >= 7)"""))
def m04(spark: SparkSession, d: str) -> DataFrame:
    return components.without_small(fx.mask_int(spark, d), 7)


DENSE = "dense_mask as (select 0 as grid_id, y, x from grid_events where (event_id * 7919) % 100 < 75)"


def dense_mask(spark: SparkSession, d: str) -> DataFrame:
    return fx.grid_events(spark, d).filter("(event_id * 7919) % 100 < 75").select("grid_id", "y", "x")


@query("m05_holes_filled", rec(E, DENSE, """free as (select 0 as grid_id, y, x from grid_events where not (event_id * 7919) % 100 < 75)""", labelled("free", "bg", SIDES), then="""
select 0::int as grid_id, y, x from dense_mask union all select 0::int, y, x from bg where label in (select label from bg group by label having count(*) < 8)"""))
def m05(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return components.holes_filled(dense_mask(spark, d), size(g), 100, 8)


CODES = """codes as (select a.grid_id, a.y, a.x, coalesce(sum(case when b.y = a.y - 1 and b.x = a.x then 1 when b.y = a.y - 1 and b.x = a.x + 1 then 2 when b.y = a.y and b.x = a.x + 1 then 4
    when b.y = a.y + 1 and b.x = a.x + 1 then 8 when b.y = a.y + 1 and b.x = a.x then 16 when b.y = a.y + 1 and b.x = a.x - 1 then 32 when b.y = a.y and b.x = a.x - 1 then 64
    when b.y = a.y - 1 and b.x = a.x - 1 then 128 end), 0)::int as code
  from mask_int a left join mask_int b on a.grid_id = b.grid_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by a.grid_id, a.y, a.x)"""


#: Neighbour codes (bit 0 above, then clockwise) of cells that go as spurs.
SPUR_CODES = "0, 1, 2, 4, 5, 6, 8, 14, 16, 20, 24, 32, 56, 64, 65, 80, 96, 128, 129, 131, 224"


@query("m06_spurs_removed", fx.with_sql(E, M, CODES, """edged as (select grid_id, y, x, code | (case when y = 0 then 1 + 2 + 128 else 0 end) | (case when x = 0 then 32 + 64 + 128 else 0 end)
    | (case when x = 99 then 2 + 4 + 8 else 0 end) | (case when y = (select max(y) from grid_events) then 8 + 16 + 32 else 0 end) as code from codes)""",
    then="select grid_id, y, x from edged where code not in (" + SPUR_CODES + ")"))
def m06(spark: SparkSession, d: str) -> DataFrame:
    return morphology.without_spurs(fx.mask_int(spark, d), size(fx.grid_events(spark, d)), 100)


@query("m07_thinned")
def m07(spark: SparkSession, d: str) -> DataFrame:
    return morphology.thinned(fx.mask_int(spark, d))


@query("m08_skeletons")
def m08(spark: SparkSession, d: str) -> DataFrame:
    return morphology.skeletons(components.label(fx.mask_int(spark, d)))


@query("m09_dilated", fx.with_sql(E, M, then="""
select distinct grid_id, y + dy as y, x + dx as x from mask_int, (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) as o(dy, dx) where y + dy >= 0 and x + dx >= 0 and x + dx < 100"""))
def m09(spark: SparkSession, d: str) -> DataFrame:
    return morphology.dilated(fx.mask_int(spark, d), height=1 << 30, width=100)


@query("m10_cropped")
def m10(spark: SparkSession, d: str) -> DataFrame:
    return morphology.cropped(fx.mask_int(spark, d), size(fx.grid_events(spark, d)), 100)


@query("m11_thinning_chain")
def m11(spark: SparkSession, d: str) -> DataFrame:
    return morphology.thinning_chain(fx.mask_int(spark, d), size(fx.grid_events(spark, d)), 100)


@query("m12_sharpened")
def m12(spark: SparkSession, d: str) -> DataFrame:
    field = fx.grid_events(spark, d).select(F.expr("cast(y div 40 as int)").alias("grid_id"), "y", "x", "f")
    return morphology.sharpened(components.label(fx.mask_int(spark, d)), field, "f", 3)


@query("m13_sharpened_after_dilation")
def m13(spark: SparkSession, d: str) -> DataFrame:
    field = fx.grid_events(spark, d).select(F.expr("cast(y div 40 as int)").alias("grid_id"), "y", "x", "f")
    return morphology.sharpened(colocate.dilate_first(components.label(fx.mask_int(spark, d)), 1), field, "f", 3)


DISK = "o as (select a.k as dy, b.k as dx, a.k * a.k + b.k * b.k as d2 from range(-2, 3) as a(k), range(-2, 3) as b(k) where a.k * a.k + b.k * b.k <= 4)"


@query("m14_dilated_first", rec(E, M, labelled(), DISK, then="""
select grid_id, (y + dy)::int as y, (x + dx)::int as x, min(label) as label from labels, o where y + dy >= 0 and x + dx >= 0 group by 1, 2, 3"""))
def m14(spark: SparkSession, d: str) -> DataFrame:
    return colocate.dilate_first(components.label(fx.mask_int(spark, d)), 2)


@query("m15_dilated_nearest", rec(E, M, labelled(), DISK, then="""
select grid_id, (y + dy)::int as y, (x + dx)::int as x, arg_min(label, d2 * 100000 + label) as label from labels, o where y + dy >= 0 and x + dx >= 0 group by 1, 2, 3"""))
def m15(spark: SparkSession, d: str) -> DataFrame:
    return colocate.dilate_nearest(components.label(fx.mask_int(spark, d)), 2)


@query("m16_despurred")
def m16(spark: SparkSession, d: str) -> DataFrame:
    return morphology.despurred(fx.mask_int(spark, d), 3)


def _pass(line: str, along: str) -> str:
    n = f"p_{line}"
    return f"""{n}a as (select m.grid_id, m.y, m.x, case when m.{along} - lag(m.{along}) over w > 3 then 1 else 0 end as nw from mask_int m window w as (partition by m.grid_id, m.{line} order by m.{along})),
{n}b as (select *, sum(nw) over (partition by grid_id, {line} order by {along}) as s from {n}a),
{n}g as (select a.y, a.x, abs(b.f - c.f) as g from grid_events a join grid_events b on b.{line} = a.{line} and b.{along} = a.{along} + 1 join grid_events c on c.{line} = a.{line} and c.{along} = a.{along} - 1
  where abs(b.f - c.f) > 0 and (a.y // 40 = b.y // 40) and (a.y // 40 = c.y // 40)),
{n} as (select b.grid_id, b.{line}, arg_max(b.{along}, g * 1000000 - b.{along} * 0.000001) as {along} from {n}b b join {n}g g using (y, x) group by b.grid_id, b.{line}, b.s)"""


@query("m17_gradient_thinned", fx.with_sql(E, M, _pass("y", "x"), _pass("x", "y"), then="select grid_id, y, x from p_y union select grid_id, y, x from p_x"))
def m17(spark: SparkSession, d: str) -> DataFrame:
    field = fx.grid_events(spark, d).select(F.expr("cast(y div 40 as int)").alias("grid_id"), "y", "x", "f")
    return morphology.gradient_thinned(fx.mask_int(spark, d), field, "f")


@query("m18_neighbour_counts", fx.with_sql(E, M, CODES, then="select grid_id, y, x, bit_count(code)::int as n, bit_count(code) = 1 as is_end, bit_count(code) >= 3 as is_branch from codes"))
def m18(spark: SparkSession, d: str) -> DataFrame:
    return morphology.neighbour_counts(fx.mask_int(spark, d))


@query("m19_features")
def m19(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return detect.features(g, "f", size(g), 100, window=8, threshold=75, min_size=3, despur=True, longest_spur=2)


@query("m20_automatic")
def m20(spark: SparkSession, d: str) -> DataFrame:
    # gaps far enough apart that buffers around them leave something
    g = fx.grid_events(spark, d).drop("f").join(fx.read(spark, d, "events").selectExpr("event_id", "case when event_id % 997 = 0 then null else value end as f"), "event_id")
    return detect.automatic(g, "f", size(g), 100, window=8, threshold=75)["features"]


@query("m21_features_of_many_cutouts", rec(fx.CUTOUTS, "hot as (select uid as grid_id, y, x from cutouts join (select uid, quantile_cont(f, 0.8) as q from cutouts group by uid) using (uid) where f > q)", labelled("hot"), then="select grid_id, y, x, label from labels"))
def m21(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cutouts(spark, d).withColumnRenamed("uid", "grid_id")
    return components.label(stencil.global_threshold(c, "f", 80).select("grid_id", "y", "x"))


@query("m22_sweep", fx.with_sql(E, then="""
select c.config, grid_id, y, x from grid_events, (select 'A' as config, quantile_cont(f, 0.8) as q from grid_events union all select 'B', quantile_cont(f, 0.9) from grid_events
  union all select 'C', quantile_cont(f, 0.95) from grid_events) c where f > q"""))
def m22(spark: SparkSession, d: str) -> DataFrame:
    return detect.sweep(fx.grid_events(spark, d), "f", {"A": 80.0, "B": 90.0, "C": 95.0})


@query("m23_compared", fx.with_sql(E, "a as (select y, x from grid_events where f > 60), b as (select y, x from grid_events where f > 70 or x = 0)", then="""
select count(a.y) as n_a, count(b.y) as n_b, count(*) filter (a.y is null or b.y is null) as n_differ, count(*) filter (a.y is null or b.y is null) = 0 as equal,
  round(100.0 * count(*) filter (a.y is null or b.y is null) / count(a.y), 6) as percent from a full join b on a.y = b.y and a.x = b.x"""))
def m23(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return morphology.compared(g.filter("f > 60"), g.filter("f > 70 or x = 0")).withColumn("percent", F.round("percent", 6))


@query("m24_some_labels", rec(E, M, labelled(), then="select grid_id, y, x, label from labels where label in (2, 3, 5, 8)"))
def m24(spark: SparkSession, d: str) -> DataFrame:
    return components.label(fx.mask_int(spark, d)).filter(F.col("label").isin(2, 3, 5, 8))


def placed_labels(spark: SparkSession, d: str) -> DataFrame:
    pos = fx.grid_events(spark, d).select(F.expr("cast(y div 40 as int)").alias("grid_id"), "y", "x", "lat", "lon", "f")
    return components.label(fx.mask_int(spark, d)).join(pos, ["grid_id", "y", "x"])


PLACED = "placed as (select l.*, e.lat, e.lon, e.f from labels l join grid_events e on e.y = l.y and e.x = l.x)"


@query("g01_extent", rec(E, M, labelled(), PLACED, then="""
select grid_id, label, count(*) as npix, round(avg(lat), 6) as centroid_lat, round(avg(lon), 6) as centroid_lon, round(min(lat), 6) as lat_min, round(max(lat), 6) as lat_max,
  round(min(lon), 6) as lon_min, round(max(lon), 6) as lon_max, round(max(lat) - min(lat), 6) as lat_range, round(max(lon) - min(lon), 6) as lon_range from placed group by grid_id, label"""))
def g01(spark: SparkSession, d: str) -> DataFrame:
    e = geometry.extent(placed_labels(spark, d))
    return e.select("grid_id", "label", "npix", *[r(c, 6) for c in e.columns[3:]])


@query("j10_painted", rec(E, M, labelled(), "n as (select grid_id, label, count(*) as npix from labels group by grid_id, label)", then="""
select grid_id, y, x, label, case when npix >= 3 then npix end as npix from labels join n using (grid_id, label)"""))
def j10(spark: SparkSession, d: str) -> DataFrame:
    cells = components.checkpointed(components.label(fx.mask_int(spark, d)))
    return colocate.painted(cells, components.table(cells).filter("npix >= 3"), "npix")


@query("g02_length")
def g02(spark: SparkSession, d: str) -> DataFrame:
    cells = placed_labels(spark, d)
    skel = morphology.skeletons(cells.select("grid_id", "label", "y", "x")).join(cells.select("grid_id", "y", "x", "lat", "lon"), ["grid_id", "y", "x"])
    return geometry.length_km(skel).select("grid_id", "label", r("length_km", 4))


@query("g03_orientation", rec(E, M, labelled(), then="""
select grid_id, label, round(case when count(*) * sum(y * x) = sum(y) * sum(x) and count(*) * sum(y * y) - sum(y) * sum(y) = count(*) * sum(x * x) - sum(x) * sum(x) then 45.0
  else abs(degrees(0.5 * atan2(2 * (count(*) * sum(y * x) - sum(y) * sum(x))::double, (count(*) * sum(y * y) - sum(y) * sum(y) - count(*) * sum(x * x) + sum(x) * sum(x))::double))) end, 4) as orientation
from labels group by grid_id, label"""))
def g03(spark: SparkSession, d: str) -> DataFrame:
    return geometry.orientation(components.label(fx.mask_int(spark, d))).select("grid_id", "label", r("orientation", 4))


HAV = "2 * 6371 * asin(sqrt(least(1, pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


@query("g04_curvature", rec(E, M, labelled(), PLACED, """t as (select grid_id, label, lat, lon, lag(lat, 5) over w as ta, lag(lon, 5) over w as na, lead(lat, 5) over w as tb, lead(lon, 5) over w as nb from placed
  window w as (partition by grid_id, label order by y, x))""", f"""k as (select grid_id, label,
  atan2({HAV.format('lat', 'ta', 'lon', 'lon')} * case when ta > lat then -1 else 1 end, {HAV.format('lat', 'lat', 'lon', 'na')} * case when na > lon then -1 else 1 end) as a,
  atan2({HAV.format('lat', 'tb', 'lon', 'lon')} * case when tb < lat then -1 else 1 end, {HAV.format('lat', 'lat', 'lon', 'nb')} * case when nb < lon then -1 else 1 end) as b,
  case when ta is not null and tb is not null then nullif({HAV.format('ta', 'tb', 'na', 'nb')}, 0) end as arc from t)""", "j as (select *, case when b - a > pi() then b - a - 2 * pi() when b - a < -pi() then b - a + 2 * pi() else b - a end / arc as k from k)",
    then="""select grid_id, label, round(avg(abs(k)), 5) as mean_curvature, round(avg(k), 5) + 0.0 as curvature_direction from j group by grid_id, label"""))
def g04(spark: SparkSession, d: str) -> DataFrame:
    got = geometry.curvature(components.checkpointed(placed_labels(spark, d)))
    return got.select("grid_id", "label", r("mean_curvature"), (F.round("curvature_direction", 5) + 0.0).alias("curvature_direction"))


@query("g05_branches", rec(E, M, labelled(), CODES, then="""
select l.grid_id, label, sum(case when bit_count(code) >= 3 then 1 else 0 end)::bigint as num_branches from labels l join codes c on c.grid_id = l.grid_id and c.y = l.y and c.x = l.x group by l.grid_id, label"""))
def g05(spark: SparkSession, d: str) -> DataFrame:
    return geometry.branches(components.label(fx.mask_int(spark, d)))


@query("g06_geometry")
def g06(spark: SparkSession, d: str) -> DataFrame:
    cells = components.checkpointed(placed_labels(spark, d))
    return geometry.geometry(cells, morphology.skeletons(cells.select("grid_id", "label", "y", "x")), "2012-11-09T12:00:00", grid=grid_40(spark, d)).select(
        "grid_id", "label", "name", "npix", "num_branches", r("length_km", 4), r("mean_curvature", 5)
    )


@query("g11_means_by_cutout_label", fx.with_sql(fx.CUTOUTS, then="select uid, y // 2 as label, count(*) as npix, case when count(f) = 16 then round(avg(f), 6) end as avg_f from cutouts where y >= 2 group by 1, 2"))
def g11(spark: SparkSession, d: str) -> DataFrame:
    return colocate.label_averages(fx.cutouts(spark, d).withColumn("label", F.expr("y div 2")), {"avg_f": "f"}).withColumn("avg_f", F.round("avg_f", 6))


@query("g12_longitude_shift", fx.with_sql(E, "s as (select y, x, ((lon + 1.7 * y + 400) % 9) as lon from grid_events)", then="""
select 0::int as grid_id, -arg_min(x, lon * 1000 + x * 0.0001)::int as shift from s where y = (select (max(y) + 1) // 2 from grid_events)"""))
def g12(spark: SparkSession, d: str) -> DataFrame:
    return geometry.longitude_shift(fx.grid_events(spark, d).withColumn("lon", (F.col("lon") + 1.7 * F.col("y") + 400) % 9))


@query("g13_rolled", fx.with_sql(E, then="select y, (x + 37) % 100 as x, event_id from grid_events"))
def g13(spark: SparkSession, d: str) -> DataFrame:
    return stencil.rolled(fx.grid_events(spark, d), 37, 100).select("y", "x", "event_id")


GRID_40 = "cells40 as (select (y // 40)::int as grid_id, y, x, lat, lon, f from grid_events)"


def grid_40(spark: SparkSession, d: str) -> DataFrame:
    """The event grid cut as the mask is."""
    return fx.grid_events(spark, d).select(F.expr("cast(y div 40 as int)").alias("grid_id"), "y", "x", "lat", "lon", "f")


@query("p24_front_ids", rec(E, M, labelled(), GRID_40, "mid as (select grid_id, label, round_even(avg(y), 0)::int as y, round_even(avg(x), 0)::int as x from labels group by grid_id, label)", then="""
select grid_id, label, '20121109T120000_' || format('{:.1f}', abs(lat)) || case when lat >= 0 then 'N' else 'S' end || '_' || format('{:.1f}', abs(lon)) || case when lon >= 0 then 'E' else 'W' end as name
from mid join cells40 using (grid_id, y, x)"""))
def p24(spark: SparkSession, d: str) -> DataFrame:
    return geometry.front_ids(placed_labels(spark, d), "2012-11-09T12:00:00", grid=grid_40(spark, d))


@query("g07_grouped", rec(E, M, labelled(), GRID_40, then="select grid_id, label, count(*) as npix, min(y) as y0, max(x) + 1 as x1, (select count(*) from labels) as n_label_cells from labels group by grid_id, label"))
def g07(spark: SparkSession, d: str) -> DataFrame:
    """All of a run's tables, the index checked against the labels."""
    got = geometry.grouped(fx.mask_int(spark, d), grid_40(spark, d), "2012-11-09T12:00:00", ["f"], config="A")
    both = got["index"].select("grid_id", "label", "npix").join(got["geometry"].select("grid_id", "label", "y0", "x1"), ["grid_id", "label"])
    return both.crossJoin(F.broadcast(got["metadata"].select("n_label_cells")))


@query("s08_loaded_run", rec(E, M, O, labelled(), GRID_40, "st as (select l.grid_id, label, avg(g) as m from labels l join grid_orders o on o.y = l.y and o.x = l.x and l.y // 40 = l.grid_id group by 1, 2), n as (select grid_id, label, count(*) as npix from labels group by 1, 2)", then="""
select l.grid_id, l.label, l.y, (l.x + 37) % 100 as x, round(c.lat, 6) as lat, n.npix, round(st.m, 4) as g_mean from labels l join cells40 c using (grid_id, y, x) join n using (grid_id, label) left join st using (grid_id, label)"""))
def s08(spark: SparkSession, d: str) -> DataFrame:
    grid = grid_40(spark, d)
    run = geometry.grouped(fx.mask_int(spark, d), grid, "2012-11-09T12:00:00", ["f"], skip_curvature=True)
    field = fx.grid_orders(spark, d).withColumn("grid_id", F.expr("cast(y div 40 as int)")).select("grid_id", "y", "x", "g")
    stats = colocate.colocate(run["labels"], field, ["g"], stats=("mean",))
    meta = run["metadata"].withColumn("width", F.lit(100))
    return tables.loaded_run(meta, run["placed"], run["geometry"].select("grid_id", "label", "npix"), stats, roll=37).select("grid_id", "label", "y", "x", r("lat", 6), "npix", r("g_mean", 4))


@query("g08_meshed_extent", rec(E, M, labelled(), then="""
select label, grid_id, count(*) as npix, round(avg(-20 + 0.25 * y::double), 6) as centroid_lat, round(avg(30 + 0.5 * x::double), 6) as centroid_lon, round(max(30 + 0.5 * x::double) - min(30 + 0.5 * x::double), 6) as lon_range
from labels group by 1, 2"""))
def g08(spark: SparkSession, d: str) -> DataFrame:
    m = fx.mask_int(spark, d)
    axis = lambda c, lo, step, name: m.select(c).distinct().withColumn(name, lo + step * F.col(c))
    grid = geometry.meshed(axis("y", -20, 0.25, "lat"), axis("x", 30, 0.5, "lon"))
    e = geometry.extent(components.label(m).join(grid, ["y", "x"]))
    return e.select("label", "grid_id", "npix", r("centroid_lat", 6), r("centroid_lon", 6), F.round(F.col("lon_max") - F.col("lon_min"), 6).alias("lon_range"))


@query("g09_approximate_positions", fx.with_sql(E, then="select y, x, round(-60 + y * 2.25 / (2 * pi() * 6371 / 360), 6) as lat, round(-170 + x * 2.25 / (2 * pi() * 6371 / 360 * cos(radians(-60))), 6) as lon from grid_events"))
def g09(spark: SparkSession, d: str) -> DataFrame:
    return geometry.approximate_positions(fx.grid_events(spark, d).drop("lat", "lon"), -60.0, -170.0).select("y", "x", r("lat", 6), r("lon", 6))


LC = fx.LABEL_CELLS
_ST = ", ".join(f"round(avg({p}), 5) as {p}_mean, round(stddev_pop({p}), 4) as {p}_std, round(median({p}), 5) as {p}_median, min({p}) as {p}_min, max({p}) as {p}_max" for p in ("p1", "p2"))


@query("a01_label_statistics", fx.with_sql(LC, then=f"select label, count(*) as npix, {_ST} from label_cells group by label having count(*) >= 2"))
def a01(spark: SparkSession, d: str) -> DataFrame:
    got = colocate.label_statistics(fx.label_cells(spark, d), ["p1", "p2"], ("mean", "std", "median", "min", "max"), min_size=2)
    return got.withColumns({c: F.round(c, 4 if c.endswith("std") else 5) for c in got.columns if c.endswith(("mean", "std", "median"))})


@query("a03_label_percentiles", fx.with_sql(LC, then="""
select label, count(*) as npix, round(quantile_cont(p2, 0.1), 7) as p2_p10, round(quantile_cont(p2, 0.025), 7) as "p2_p2.5", round(quantile_cont(p2, 0.9), 7) as p2_p90 from label_cells group by label"""))
def a03(spark: SparkSession, d: str) -> DataFrame:
    got = colocate.label_statistics(fx.label_cells(spark, d), ["p2"], (), (10, 2.5, 90))
    return got.select("label", "npix", *[F.round(F.col(f"`{c}`"), 7).alias(c) for c in got.columns[2:]])


@query("a02_nan_policy", fx.with_sql(LC, then="""
select label, count(*) as npix, round(avg(case when l_nan then null else p1 end), 5) as q_mean, max(case when l_nan then null else p1 end) as q_max
from (select label, p1, p1 is null as l_nan from label_cells) group by label"""))
def a02(spark: SparkSession, d: str) -> DataFrame:
    c = fx.label_cells(spark, d).withColumn("q", F.coalesce("p1", F.lit(float("nan"))))
    return colocate.label_statistics(c, ["q"], ("mean", "max")).withColumn("q_mean", F.round("q_mean", 5))


@query("a05_colocated", rec(E, M, O, labelled(), DISK, """sized as (select grid_id, label, count(*) as npix from labels group by 1, 2 having count(*) >= 3)""", """grown as (select grid_id, (y + dy)::int as y, (x + dx)::int as x,
  arg_min(label, d2 * 100000 + label) as label from labels join sized using (grid_id, label) cross join o where y + dy >= 0 and x + dx >= 0 group by 1, 2, 3)""", """st as (
  select g.grid_id, g.label, round(avg(g), 6) as g_mean, round(median(g), 6) as g_median, round(quantile_cont(g, 0.9), 6) as g_p90
  from grown g join grid_orders o on o.y = g.y and o.x = g.x and o.y // 40 = g.grid_id and o.x % 3 <> 0 group by 1, 2)""", then="select grid_id, label, npix, npix as g_count, g_mean, g_median, g_p90 from sized left join st using (grid_id, label)"))
def a05(spark: SparkSession, d: str) -> DataFrame:
    field = fx.grid_orders(spark, d).filter("x % 3 <> 0").withColumn("grid_id", F.expr("cast(y div 40 as int)")).select("grid_id", "y", "x", "g")
    got = colocate.colocate(components.label(fx.mask_int(spark, d)), field, ["g"], 2, min_size=3, stats=("mean", "median", "count"), percentiles=(90,))
    return got.select("grid_id", "label", "npix", "g_count", *[r(c, 6) for c in ("g_mean", "g_median", "g_p90")])


@query("flagship_front_statistics", rec(E, O, "hot as (select 0 as grid_id, y, x, lat, lon from grid_events where f > (select quantile_cont(f, 0.9) from grid_events))", labelled("hot", "labels"), then="""
select l.label, count(*) as npix, min(l.y) as y0, max(l.y) + 1 as y1, min(l.x) as x0, max(l.x) + 1 as x1, round(avg(h.lat), 6) as centroid_lat, round(avg(h.lon), 6) as centroid_lon,
  round(avg(g), 3) as g_mean, round(median(g), 3) as g_median, round(quantile_cont(g, 0.9), 3) as g_p90
from labels l join hot h on h.y = l.y and h.x = l.x left join grid_orders o on o.y = l.y and o.x = l.x group by l.label"""))
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Global threshold, components, geometry and the statistics of a second field by component."""
    grid = fx.grid_events(spark, d)
    mask = stencil.global_threshold(grid, "f", 90)
    both = components.label(mask.select("grid_id", "y", "x")).join(mask.select("grid_id", "y", "x", "lat", "lon"), ["grid_id", "y", "x"]).join(
        fx.grid_orders(spark, d).select("grid_id", "y", "x", "g"), ["grid_id", "y", "x"], "left"
    )
    got = both.groupBy("label").agg(
        F.count(F.lit(1)).alias("npix"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"), F.avg("g").alias("g_mean"), F.median("g").alias("g_median"), F.percentile("g", F.lit(0.9)).alias("g_p90"),
    )
    return got.select("label", "npix", "y0", "y1", "x0", "x1", r("centroid_lat", 6), r("centroid_lon", 6), r("g_mean", 3), r("g_median", 3), r("g_p90", 3))


STEP = fx.STEP_COUNTS
WIN = """w as (select grid_id, y, x, n, wy, wx from step_counts, range(0, 1000) as a(wy), range(0, 12) as b(wx)
  where (wy = y // 8 or wy = y // 8 - 1) and (wx = x // 8 or wx = x // 8 - 1)),
h as (select wy, wx, n as v, count(*) as c from w group by 1, 2, 3),
k as (select wy, wx, v, sum(c) over o as na, sum(c * v) over o as sa, sum(c) over p as n, sum(c * v) over p as st, sum(c * v * v) over p as qt from h
  window o as (partition by wy, wx order by v), p as (partition by wy, wx)),
j as (select *, na * (n - na) * pow(sa / na - (st - sa) / (n - na), 2) as j from k where n > 100 and na < n),
splits as (select wy, wx, arg_max(v, j - v * 1e-9) as tau, max(n) as n, arg_max(na, j - v * 1e-9) as na, max(j) / max(n) / nullif(max(qt - st * st / n), 0) as theta,
  arg_max((st - sa) / (n - na) - sa / na, j - v * 1e-9) as step from j group by 1, 2)"""


@query("a29_window_bimodality", fx.with_sql(E, STEP, WIN, then="select wy::int as wy, wx::int as wx, n::bigint as n, tau::int as tau, na::bigint as na, round(theta, 6) as theta from splits where least(na, n - na) > 0.25 * n"))
def a29(spark: SparkSession, d: str) -> DataFrame:
    return archive.bimodality(fx.step_counts(spark, d), "n", 16).select("wy", "wx", "n", "tau", "na", r("theta", 6))


PAIRS = """good as (select * from splits where least(na, n - na) > 0.25 * n and theta > 0.6 and step >= 2),
m as (select w.wy, w.wx, y, x, w.n > tau as hot from w join good g on g.wy = w.wy and g.wx = w.wx),
pairs as (select a.wy, a.wx, a.y, a.x, a.hot as a, b.hot as b from m a join m b on a.wy = b.wy and a.wx = b.wx and ((b.y = a.y and b.x = a.x + 1) or (b.y = a.y + 1 and b.x = a.x))),
coh as (select wy, wx, count(*) filter (not a and not b) * 1.0 / nullif(count(*) filter (not a), 0) as cold, count(*) filter (a and b) * 1.0 / nullif(count(*) filter (a), 0) as warm,
  count(*) filter (a = b) * 1.0 / count(*) as al from pairs group by 1, 2)"""


@query("a30_cohesion", fx.with_sql(E, STEP, WIN, PAIRS, then="select wy::int as wy, wx::int as wx, round(cold, 6) as cold, round(warm, 6) as warm, round(al, 6) as whole from coh"))
def a30(spark: SparkSession, d: str) -> DataFrame:
    c = fx.step_counts(spark, d)
    good = archive.bimodality(c, "n", 16).filter("theta > 0.6 and mean_b - mean_a >= 2")
    return archive.cohesion(archive.pairs_in_windows(c, "n", good, 16)).select("wy", "wx", r("cold", 6), r("warm", 6), F.round("all", 6).alias("whole"))


HITS = "hits as (select 0 as grid_id, y, x, count(distinct (wy, wx)) as hits from pairs p join coh using (wy, wx) where a <> b and cold >= 0.8 and warm >= 0.8 and al >= 0.8 group by 1, 2, 3)"


@query("a31_edges", fx.with_sql(E, STEP, WIN, PAIRS, HITS, then="select y, x, hits from hits"))
def a31(spark: SparkSession, d: str) -> DataFrame:
    return archive.edges(fx.step_counts(spark, d), "n", 16, cold=0.8, warm=0.8, whole=0.8).select("y", "x", "hits")


@query("a32_edge_segments", rec(E, STEP, WIN, PAIRS, HITS, labelled("hits", "seg"), then="select y, x, label from seg where label in (select label from seg group by label having count(*) >= 10)"))
def a32(spark: SparkSession, d: str) -> DataFrame:
    return archive.segments(archive.edges(fx.step_counts(spark, d), "n", 16, cold=0.8, warm=0.8, whole=0.8).select("grid_id", "y", "x"), 10).select("y", "x", "label")


@query("a33_direction_coherence", fx.with_sql(O, then="""
select a.y, a.x, round(sqrt(pow(sum(b.u), 2) + pow(sum(b.v), 2)) / nullif(sum(sqrt(b.u * b.u + b.v * b.v)), 0), 5) as coherence
from grid_orders a join grid_orders b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by a.y, a.x"""))
def a33(spark: SparkSession, d: str) -> DataFrame:
    return archive.direction_coherence(fx.grid_orders(spark, d), "u", "v").select("y", "x", r("coherence"))
