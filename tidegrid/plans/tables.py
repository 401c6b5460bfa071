"""Queries of catalogues, joins, expressions, histograms, features, archives and sets, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import ocean
from tidegrid.operators import archive, catalog, density, features, histograms, match
from tidegrid.operators.components import checkpointed, shared_folder
from tidegrid.operators.ranking import numbered_rows
from tidegrid.plans import fixtures as fx
from tidegrid.plans.stencils import UV, r, size
from tidegrid.sources import tables
from tidegrid.sources.npy import NpyDataSource

QUERIES, ORACLE = {}, {}
C, E, O, LC, IM = fx.CATALOG, fx.GRID_EVENTS, fx.GRID_ORDERS, fx.LABEL_CELLS, fx.IMAGES


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


# --- expressions ---------------------------------------------------------------------------------------------------------

@query("p12_p15_coriolis", fx.with_sql(C, then="""
select uid, round(2 * 7.2921e-5 * sin(radians(lat)) * 1e6, 6) as f_e6, case when lat <> 0 then round((label + 1) / (2 * 7.2921e-5 * sin(radians(lat))) / 1e4, 4) end as by_f,
  case when abs(lat) >= 5 and abs(2 * 7.2921e-5 * sin(radians(lat))) >= 1e-5 then round((label + 1) / abs(2 * 7.2921e-5 * sin(radians(lat))) / 1e4, 4) end as rossby from catalog"""))
def p12(spark: SparkSession, d: str) -> DataFrame:
    lat = F.col("lat")
    return fx.catalog(spark, d).select(
        "uid", F.round(ocean.coriolis(lat) * 1e6, 6).alias("f_e6"), F.round(ocean.by_coriolis(F.col("label") + 1, lat) / 1e4, 4).alias("by_f"),
        F.round(ocean.rossby(F.col("label") + 1, lat, absolute=True) / 1e4, 4).alias("rossby"),
    )


@query("p16_turner_angle", fx.with_sql(O, then="""
select y, x, round(case when u > 0 then degrees(atan(1025.0 * (7.4e-4 * 7.4e-4 * (g / 1000) - 2e-4 * 2e-4 * (v * v)) / (-u / 1025.0))) end, 5) as turner from grid_orders"""))
def p16(spark: SparkSession, d: str) -> DataFrame:
    t = ocean.turner_angle(F.lit(1.0), F.col("g") / 1000, F.col("v") * F.col("v"), F.col("u"))
    return fx.grid_orders(spark, d).select("y", "x", F.round(t, 5).alias("turner"))


@query("p17_engineered", fx.with_sql(C, then="""
select uid, round(label / greatest(abs(2 * 7.2921e-5 * sin(radians(lat))), 1e-7) / 1e4, 4) as label_over_f, round(log10(greatest(label, 1e-30)), 6) as log_label from catalog"""))
def p17(spark: SparkSession, d: str) -> DataFrame:
    e = features.engineered(fx.catalog(spark, d), "lat", ["label"], logs=["label"])
    return e.select("uid", F.round(F.col("label_over_f") / 1e4, 4).alias("label_over_f"), r("log_label", 6))


@query("p17_feature_families", fx.with_sql(O, then="""
select y, x, round(sqrt(u * u + v * v), 6) as speed, round(log10(greatest(g / greatest(v, 1e-30), 1e-30)), 6) as log_grad_ratio, round(log10(greatest(v, 1)), 6) as log_npix,
  round(u / pow(greatest(abs(2 * 7.2921e-5 * sin(radians(y * 0.01))), 1e-7), 2) / 1e9, 3) as u_over_f2 from grid_orders"""))
def p17b(spark: SparkSession, d: str) -> DataFrame:
    e = features.engineered(fx.grid_orders(spark, d).withColumn("lat", F.col("y") * 0.01), "lat", by_f2=["u"], speed=("u", "v"), grad_ratio=("g", "v"), npix="v")
    return e.select("y", "x", r("speed", 6), r("log_grad_ratio", 6), r("log_npix", 6), F.round(F.col("u_over_f2") / 1e9, 3).alias("u_over_f2"))


@query("p08_p15_over_f", fx.with_sql(LC, then="""
select label, p3 as coriolis_f_median, round(p1 / nullif(abs(p3), 0), 6) as strain_mag_median_over_f, round(p2 / nullif(abs(p3), 0), 4) as divergence_p10_over_f from label_cells"""))
def p15(spark: SparkSession, d: str) -> DataFrame:
    """Of the properties and those by f, the ones to choose from."""
    c = fx.label_cells(spark, d).selectExpr("label as flabel", "p1 as strain_mag_median", "p2 as divergence_p10", "p2 as gradeta2_mean", "p3 as coriolis_f_median")
    all_ = features.over_f(c)
    some = all_.select("flabel", *tables.selectable(all_))
    return some.withColumns({"strain_mag_median_over_f": F.round("strain_mag_median_over_f", 6), "divergence_p10_over_f": F.round("divergence_p10_over_f", 4)}).withColumnRenamed("flabel", "label")


@query("p13_normalised", fx.with_sql(fx.CUTOUTS, "c as (select vec_id as uid, vec_id % 5 - 2.0 as lat, 2 * 7.2921e-5 * sin(radians(vec_id % 5 - 2.0)) as f0 from embeddings)", then="""
select uid, y, x, round(f, 6) as f, round(case when lat <> 0 then f / f0 else f end, 2) as fnorm_f, round(case when lat <> 0 then f / abs(f0) else f end, 2) as afnorm_f from cutouts join c using (uid)"""))
def p13(spark: SparkSession, d: str) -> DataFrame:
    long = fx.cutouts(spark, d).select("uid", "y", "x", F.lit("f").alias("field"), F.col("f").alias("value"))
    where = fx.catalog(spark, d).select("uid", (F.col("uid") % 5 - 2.0).alias("lat"))
    got = catalog.gathered(long, ["f", "fnorm_f", "afnorm_f"], catalog=where)
    return got.select("uid", "y", "x", r("f", 6), r("fnorm_f", 2), r("afnorm_f", 2))


@query("p18_a12_conversion", fx.with_sql(E, "n as (select f, round_even((270 + f / 10 - 268.15) / 0.01, 0) as r from grid_events)", then="""
select min(r) filter (r > 0 and r <= 600)::int as min, max(r) filter (r > 0 and r <= 600)::int as max, count(*) filter (r <= 0) as n_too_small, count(*) filter (r > 600) as n_too_large,
  count(*) filter (f is null) as n_fill, count(*) filter (r > 0 and r <= 600) as n_valid from n"""))
def p18(spark: SparkSession, d: str) -> DataFrame:
    return archive.conversion_stats(fx.grid_events(spark, d).withColumn("k", 270 + F.col("f") / 10), "k", most=600)


@query("p20_p23_haversine", fx.with_sql(C, then="""
select a.uid, round(2 * 6371 * asin(sqrt(least(1, pow(sin(radians(10 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(20 - lon) / 2), 2)))), 4) as km,
  round(((lon + 250 + 180) % 360) - 180, 6) as lon from catalog a"""))
def p20(spark: SparkSession, d: str) -> DataFrame:
    return fx.catalog(spark, d).select("uid", F.round(ocean.haversine_km(F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0)), 4).alias("km"), F.round(ocean.wrap_longitude(F.col("lon") + 250), 6).alias("lon"))


@query("p21_solar_zenith", """with e as (select event_id, event_id % 180 - 90.0::double as lat, event_id % 360 - 180.0::double as lon, hour(ts) * 60 + minute(ts) as m, 2 * pi() * (dayofyear(ts) - 1 + (hour(ts) - 12) / 24) / 365 as t from events),
s as (select *, 229.18 * (0.000075 + 0.001868 * cos(t) - 0.032077 * sin(t) - 0.014615 * cos(2 * t) - 0.040849 * sin(2 * t)) as eq,
  0.006918 - 0.399912 * cos(t) + 0.070257 * sin(t) - 0.006758 * cos(2 * t) + 0.000907 * sin(2 * t) as decl from e)
select event_id, floor(degrees(acos(least(1, greatest(-1, sin(radians(lat)) * sin(decl) + cos(radians(lat)) * cos(decl) * cos(radians((m + eq + 4 * lon) / 4 - 180)))))))::int as zenith from s""")
def p21(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("ts")
    both = fx.read(spark, d, "events").withColumns({"lat": F.col("event_id") % 180 - 90.0, "lon": F.col("event_id") % 360 - 180.0})
    return both.select("event_id", ocean.solar_zenith(F.dayofyear(t), F.hour(t), F.minute(t), F.col("lat"), F.col("lon")).alias("zenith"))


@query("p22_aligned_units", fx.with_sql(O, "m as (select median(g) as m from grid_orders)", then="select y, x, round(case when m > 200 then g - 273.15 else g end, 6) as g from grid_orders, m"))
def p22(spark: SparkSession, d: str) -> DataFrame:
    return features.aligned_temperature(fx.grid_orders(spark, d), "g").select("y", "x", r("g", 6))


@query("p22_aligned_gradients", fx.with_sql(E, then="select 'raw' as kind, y, x, round(case when f > 0 then log10(f) - 6 end, 6) as f from grid_events union all select 'anomaly', y, x, round(f - 50, 6) from grid_events"))
def p22b(spark: SparkSession, d: str) -> DataFrame:
    """Values of which none is negative, and the same as anomalies, which stay."""
    g = fx.grid_events(spark, d).select("y", "x", "f")
    both = [features.aligned_gradient(t, "f").select(F.lit(k).alias("kind"), "y", "x", r("f", 6)) for k, t in (("raw", g), ("anomaly", g.withColumn("f", F.col("f") - 50)))]
    return both[0].unionByName(both[1])


@query("p06_index_box", fx.with_sql(E, "t as (select y, x, lat + 0.03 * x as lat, lon + 0.02 * y as lon from grid_events)", "b as (select min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1 from t where lat between -58.5 and -56.2 and lon between -168 and -164.4)", then="""
select y, x, round(lat, 6) as lat from t, b where y between y0 and y1 and x between x0 and x1"""))
def p06(spark: SparkSession, d: str) -> DataFrame:
    """A grid at an angle to the axes: its index box holds cells off the box of positions."""
    t = fx.grid_events(spark, d).withColumns({"lat": F.col("lat") + F.col("x") * 0.03, "lon": F.col("lon") + F.col("y") * 0.02})
    return catalog.cropped_to(t, (-58.5, -56.2), (-168.0, -164.4)).select("y", "x", r("lat", 6))


@query("p10_land_and_ocean", fx.with_sql(LC, then="select label, p1 is null and p2 is null as land, coalesce(p1 > 20 and p3 > 0, false) as ocean from (select label, p1, p2, p3 from label_cells)"))
def p10(spark: SparkSession, d: str) -> DataFrame:
    c = fx.label_cells(spark, d).withColumn("q", F.col("p1") - 20)
    return c.select("label", ocean.is_land("p1", "p2").alias("land"), ocean.is_ocean("q", "p3").alias("ocean"))


@query("p05_p06_p10_regions", fx.with_sql(E, then="select y, x from grid_events where lat between -59.51 and -55.01 and lon between -169 and -165.05 and f is not null and f > 0"))
def p05(spark: SparkSession, d: str) -> DataFrame:
    return fx.grid_events(spark, d).filter(F.col("lat").between(-59.51, -55.01) & F.col("lon").between(-169, -165.05) & F.col("f").isNotNull() & (F.col("f") > 0)).select("y", "x")


@query("p25_hover_json", fx.with_sql(LC, then="""
select label, '{"label":' || label || ',"npix":"' || count(*) || '","p2":"' || coalesce(format('{:.4g}', max(p2)), 'NaN') || '","p3":"' || coalesce(format('{:.4g}', min(p3)), 'NaN') || '"}' as hover
from label_cells where label % 3 > 0 group by label"""))
def p25(spark: SparkSession, d: str) -> DataFrame:
    c = fx.label_cells(spark, d)
    one = c.groupBy("label").agg(F.count(F.lit(1)).alias("npix"), F.max("p2").alias("p2"), F.min("p3").alias("p3"))
    return tables.hover(one, c.filter("label % 3 > 0"), ["npix", "p2", "p3"])


@query("p26_s09_names", "select event_id, strftime(ts, '%Y%m%d_%H%M%S') as stamp, strftime(ts, '%Y%m%dT%H_%M_%S') as time, 'v2' as tag from events")
def p26(spark: SparkSession, d: str) -> DataFrame:
    e = fx.read(spark, d, "events").withColumn("name", F.concat(F.lit("labels_"), F.date_format("ts", "yyyyMMdd'T'HH_mm_ss"), F.lit("_v2.parquet")))
    return e.withColumn("p", tables.parsed_name(F.col("name"))).select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), "p.time", "p.tag")


@query("p27_flow_curvature", fx.with_sql(O, UV, "k as (select y, x, u, v, (ur - ul) / 2 as ux, (ud - uu) / 2 as uy, (vr - vl) / 2 as vx, (vd - vu) / 2 as vy from su)", then="""
select y, x, round(case when u * u * vx - v * v * uy + u * v * (vy - ux) <> 0 then pow(u * u + v * v, 1.5) / (u * u * vx - v * v * uy + u * v * (vy - ux)) end, 3) as radius from k where ux + uy + vx + vy is not null"""))
def p27(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.stencil import kinematics

    k = kinematics(fx.grid_orders(spark, d)).filter("ux + uy + vx + vy is not null")
    radius = ocean.flow_curvature(*[F.col(c) for c in ("u", "v", "ux", "uy", "vx", "vy")])
    return k.select("y", "x", F.round(radius, 3).alias("radius"))


@query("p27_curvature_number", fx.with_sql(O, UV, """k as (
  select y, x, u, v, (ur - ul) / 2 as ux, (ud - uu) / 2 as uy, (vr - vl) / 2 as vx, (vd - vu) / 2 as vy, (y % 80) * 0.2 - 7.9 as lat from su)""", """m as (
  select *, 2 * 7.2921e-5 * sin(radians(lat)) as fc, u * u * vx - v * v * uy + u * v * (vy - ux) as bend, abs(lat) <= 6 as near from k where ux + uy + vx + vy is not null)""", """q as (
  select *, case when bend <> 0 then pow(u * u + v * v, 1.5) / bend end as r from m)""", then="""
select y, x, round(case when not near and r <> -1 then 2 * sqrt(u * u + v * v) / fc / (r + 1) end, 2) as curvature_number, round((u * u + v * v) / 2, 4) as kinetic_energy,
  round(sqrt(u * u + v * v) / nullif(r * r, 0), 4) as beta_c, round(case when not near then vx - uy end, 6) as vorticity, round(case when not near then (vx - uy) / fc end, 0) as rossby, round(1000 / nullif(r, 0), 4) as kappa from q"""))
def p27_number(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.stencil import kinematics

    k = kinematics(fx.grid_orders(spark, d)).filter("ux + uy + vx + vy is not null")
    got = ocean.flow_measures(*[F.col(c) for c in ("u", "v", "ux", "uy", "vx", "vy")], (F.col("y") % 80) * 0.2 - 7.9)
    digits = {"curvature_number": 2, "kinetic_energy": 4, "beta_c": 4, "vorticity": 6, "rossby": 0, "kappa": 4}
    return k.select("y", "x", *[F.round(got[c], n).alias(c) for c, n in digits.items()])


@query("p19_from_counts", fx.with_sql("n as (select event_id, case when event_id % 11 = 0 then -32768 else (event_id * 37) % 4000 end as n from events)", then="""
select event_id, round(case when n <> -32768 then n::double * 0.01 + 268.15 end, 6) as kelvin, round(case when n <> -32768 then n::double * 0.01 - 5 end, 6) as celsius from n"""))
def p19(spark: SparkSession, d: str) -> DataFrame:
    n = fx.read(spark, d, "events").selectExpr("event_id", "case when event_id % 11 = 0 then -32768 else (event_id * 37) % 4000 end as n")
    return n.select("event_id", F.round(ocean.from_counts(F.col("n"), celsius=False), 6).alias("kelvin"), F.round(ocean.from_counts(F.col("n")), 6).alias("celsius"))


# --- catalogue -----------------------------------------------------------------------------------------------------------

@query("p01_p02_lookup", fx.with_sql(C, then="select uid, lat, lon from catalog where month = 3 and label = 4"))
def p01(spark: SparkSession, d: str) -> DataFrame:
    return catalog.find_entries(fx.catalog(spark, d), month=3, label=4).select("uid", "lat", "lon")


@query("p03_vetted", fx.with_sql(C, then="select 'month' as field, count(*) filter (month not in (0, 1, 2, 3)) as n_bad from catalog"))
def p03(spark: SparkSession, d: str) -> DataFrame:
    return catalog.vet(fx.catalog(spark, d).select("uid", "lat", "month"), {"uid": "bigint", "lat": "double", "month": "int"}, {"month": [0, 1, 2, 3]})


@query("j04_t06_flags", fx.with_sql(C, "m as (select uid from catalog where uid % 3 = 0)", then="select uid, uid in (select uid from m) as present from catalog where flag_a and flag_b"))
def j04(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d)
    return catalog.flag_present(c.filter("flag_a and flag_b"), c.filter("uid % 3 = 0"), "present").select("uid", "present")


@query("j05_array_index", fx.with_sql(C, then="select a.uid, coalesce(b.uid * 2, -1)::bigint as gidx from catalog a left join (select uid from catalog where uid % 4 <> 1) b using (uid)"))
def j05(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d)
    return catalog.index_of(c.select("uid"), c.filter("uid % 4 <> 1").select("uid", (F.col("uid") * 2).alias("gidx"))).select("uid", F.col("gidx").cast("long").alias("gidx"))


@query("j01_j10_joined_statistics", fx.with_sql(LC, "s as (select label, avg(p1) as m from label_cells group by label), t as (select label, count(*) as npix from label_cells group by label)", then="""
select label, npix, round(m, 5) as m from t join s using (label)"""))
def j01(spark: SparkSession, d: str) -> DataFrame:
    c = fx.label_cells(spark, d)
    return c.groupBy("label").agg(F.count(F.lit(1)).alias("npix")).join(c.groupBy("label").agg(F.round(F.avg("p1"), 5).alias("m")), "label")


@query("j03_matched", fx.with_sql(C, then="select uid, a.lat, b.label from catalog a join (select uid, label from catalog where uid % 2 = 0) b using (uid)"))
def j03(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d)
    return catalog.matched(c.select("uid", "lat"), c.filter("uid % 2 = 0").select("uid", "label"), required=False)


@query("j06_p07_nearest_cell", fx.with_sql(C, E, "p as (select uid, -60 + (uid * 37 % 1000) / 100.1 as lat, -170 + (uid * 91 % 1000) / 100.1 as lon from catalog)", """k as (
  select uid, y, x, row_number() over (partition by uid order by pow(p.lat - e.lat, 2) + pow(p.lon - e.lon, 2), y, x) as k from p, grid_events e)""", then="select uid, y, x from k where k = 1"))
def j06(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog(spark, d).select("uid", (-60 + (F.col("uid") * 37 % 1000) / 100.1).alias("lat"), (-170 + (F.col("uid") * 91 % 1000) / 100.1).alias("lon"))
    return match.nearest_cell(p, fx.grid_events(spark, d), "uid", 0.2).select("uid", "y", "x")


@query("p07_cropped_around", fx.with_sql(C, E, "p as (select uid, -60 + (uid * 37 % 1000) / 100.1 as lat, -170 + (uid * 91 % 1000) / 100.1 as lon from catalog)", """k as (
  select uid, y, x, row_number() over (partition by uid order by pow(p.lat - e.lat, 2) + pow(p.lon - e.lon, 2), y, x) as k from p, grid_events e)""", then="""
select k.uid, e.y, e.x, (e.y - k.y + 2)::int as "row", (e.x - k.x + 3)::int as col from k join grid_events e on e.y between k.y - 2 and k.y + 2 and e.x between k.x - 3 and k.x + 2 where k.k = 1"""))
def p07(spark: SparkSession, d: str) -> DataFrame:
    p = fx.catalog(spark, d).select("uid", (-60 + (F.col("uid") * 37 % 1000) / 100.1).alias("lat"), (-170 + (F.col("uid") * 91 % 1000) / 100.1).alias("lon"))
    return match.cropped_around(p, fx.grid_events(spark, d), "uid", 5, 6, start_degrees=0.2).select("uid", "y", "x", "row", "col")


ARC = "degrees(2 * asin(sqrt(least(1, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))))"
#: A catalogue and another one moved across the date line and the poles: every pair within six days, by the haversine alone.
MATCHED = (
    "s as (select uid, lat, lon, month * 30.0 as t from catalog)",
    "o as (select uid + 1000000 as uid, greatest(-90, least(90, lat + 0.2)) as lat, (lon + 0.1 + 540) % 360 - 180 as lon, month * 30.0 + 3 as t from catalog)",
    f"k as (select a.uid, b.uid as uid_o, {ARC} as arc from s a join o b on abs(a.t - b.t) < 6)",
    "j as (select uid, uid_o, arc from (select *, row_number() over (partition by uid order by arc, uid_o) as n from k) where n = 1 and arc <= 3)",
)


def matched_cutouts(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d).select("uid", "lat", "lon", (F.col("month") * 30.0).alias("t"))
    moved = {"lat": F.greatest(F.lit(-90.0), F.least(F.lit(90.0), F.col("lat") + 0.2)), "lon": (F.col("lon") + 0.1 + 540) % 360 - 180}
    o = c.withColumns({"uid": F.col("uid") + 1000000, "t": F.col("t") + 3} | moved)
    return match.nearest_in_space_time(c, o, 6, 3)


@query("j07_nearest_in_space_time", fx.with_sql(C, *MATCHED, then="select uid, uid_o, round(arc, 6) as degrees from j"))
def j07(spark: SparkSession, d: str) -> DataFrame:
    return matched_cutouts(spark, d).withColumn("degrees", F.round("degrees", 6))


@query("t14_matched_histogram", fx.with_sql(C, fx.CUTOUTS, *MATCHED, "v as (select c.f, 0 as side from cutouts c join j using (uid) union all select c.f + 0.25, 1 from cutouts c join j on c.uid = j.uid_o - 1000000)",
    "q as (select quantile_cont(f, 0.01) as lo, quantile_cont(f, 0.99) as hi from v)", """n as (
  select least(floor((f - lo) / ((hi - lo) / 79))::int, 78) as bin, count(*) filter (where side = 0) as n_left, count(*) filter (where side = 1) as n_right
  from v, q where f between lo and hi group by 1)""", then="""
select k::int as bin, round(lo + (hi - lo) * k / 79, 6) as lo, round(lo + (hi - lo) * (k + 1) / 79, 6) as hi, coalesce(n_left, 0)::bigint as n_left, coalesce(n_right, 0)::bigint as n_right
from q, range(0, 79) r(k) left join n on n.bin = k""").replace("from q, range(0, 79) r(k) left join", "from q cross join range(0, 79) r(k) left join"))
def t14(spark: SparkSession, d: str) -> DataFrame:
    pairs, cells = checkpointed(matched_cutouts(spark, d)), fx.cutouts(spark, d).select("uid", "f")
    left = cells.join(pairs.select("uid"), "uid")
    right = cells.withColumns({"uid": F.col("uid") + 1000000, "f": F.col("f") + 0.25}).join(pairs.select(F.col("uid_o").alias("uid")), "uid")
    return histograms.matched_histogram(left, right, "f").withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


IMT = "t as (select image_id, min(epoch(ts)) as t from images group by 1)"


def image_times(spark: SparkSession, d: str) -> DataFrame:
    return fx.images(spark, d).groupBy("image_id").agg(F.min(F.col("ts").cast("timestamp").cast("double")).alias("t"))


@query("j08_temporal_neighbours", fx.with_sql(IM, IMT, "k as (select *, row_number() over (order by t, image_id) as k from t)", then="""
select a.image_id, b.image_id as other_id, round(b.t - a.t, 3) as gap_s from k a join k b on abs(a.k - b.k) <= 3 and a.k <> b.k and abs(a.t - b.t) <= 60 * 3600"""))
def j08(spark: SparkSession, d: str) -> DataFrame:
    return match.temporal_neighbours(image_times(spark, d), 3, 60).withColumn("gap_s", F.round("gap_s", 3))


def _contour(spark: SparkSession, d: str) -> DataFrame:
    o = fx.grid_orders(spark, d)
    return o.select(F.lit(0).alias("image_id"), F.col("y").alias("contour_id"), F.col("x").alias("m"), "y", "x", F.col("v").alias("gi"), F.col("u").alias("gj"))


@query("j09_contour_merge", fx.with_sql(O, "p as (select y as contour_id, x as m, y, x, v as gi, u as gj from grid_orders)", """s as (
  select contour_id, m, a.k as sy, b.k as sx, case when gi * o.u + gj * o.v > 0 then (gi * o.u + gj * o.v) / greatest(sqrt(gi * gi + gj * gj), greatest(sqrt(o.u * o.u + o.v * o.v), 2.0)) else 0 end as score
  from p, range(-1, 2) a(k), range(-1, 2) b(k) left join grid_orders o on o.y = p.y + a.k and o.x = p.x + b.k)""", """w as (
  select *, sum(score) over (partition by contour_id, sy, sx order by m rows between current row and 20 following) as total from s)""", """b as (
  select contour_id, m, row_number() over (partition by contour_id, m order by total desc, sy, sx) as k, sy, sx, total from w)""", then="""
select distinct p.y + b.sy as y, p.x + b.sx as x from b, range(0, 21) r(k2) join p on p.contour_id = b.contour_id and p.m = b.m + r.k2 where b.k = 1 and b.total > 10""").replace(
    "select distinct p.y + b.sy", "select distinct p.y + b.sy").replace("from b, range(0, 21) r(k2) join p on p.contour_id = b.contour_id and p.m = b.m + r.k2 where", "from b cross join range(0, 21) r(k2) join p on p.contour_id = b.contour_id and p.m = b.m + r.k2 where").replace(
    "from p, range(-1, 2) a(k), range(-1, 2) b(k) left join", "from p cross join range(-1, 2) a(k) cross join range(-1, 2) b(k) left join"))
def j09(spark: SparkSession, d: str) -> DataFrame:
    field = fx.grid_orders(spark, d).select("y", "x", F.col("u").alias("hi"), F.col("v").alias("hj"))
    return archive.contour_scores(_contour(spark, d), field, 1).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))


@query("j13_nearest_time", fx.with_sql(IM, IMT, "o as (select distinct epoch(o_orderdate) as s from orders)", """k as (select distinct t, s, row_number() over (partition by t order by abs(t - s), s) as k from t, o)""", then="""
select round(t, 3) as t, round(s, 3) as source_t, round(abs(t - s), 3) as gap from k where k = 1"""))
def j13(spark: SparkSession, d: str) -> DataFrame:
    src = fx.read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").cast("double").alias("t"))
    got = match.nearest_time(image_times(spark, d), src)
    return got.select(r("t", 3), r("source_t", 3), r("gap", 3))


@query("j14_nearest_value", fx.with_sql("p as (select p_partkey as draw_id, (p_partkey * 7919 % 1000) * 550.0 as v from part)", """k as (
  select draw_id, o_orderkey as uid, abs(v - o_totalprice) as gap, row_number() over (partition by draw_id order by abs(v - o_totalprice), o_orderkey) as k from p, orders)""",
    then="select draw_id, uid, round(gap, 4) as gap from k where k = 1"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    draws = fx.read(spark, d, "part").select(F.col("p_partkey").alias("draw_id"), ((F.col("p_partkey") * 7919 % 1000) * 550.0).alias("v"))
    got = match.nearest_value(draws, fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), "o_totalprice"), "o_totalprice", "uid")
    return got.withColumn("gap", F.round("gap", 4))


# --- splits and training sets --------------------------------------------------------------------------------------------

H = "((uid + 1) * 48271) % 2147483647"


@query("t04_random_split", fx.with_sql(C, f"k as (select uid, row_number() over (order by {H}, uid) as k from catalog)", then="select uid, case when k <= 200 then 'train' when k <= 250 then 'valid' else 'test' end as split from k where k <= 300"))
def t04(spark: SparkSession, d: str) -> DataFrame:
    return catalog.random_split(fx.catalog(spark, d), {"train": 200, "valid": 50, "test": 50}, seed=1).select("uid", "split")


@query("t05_balanced_sample", f"""with recursive o as (select o_orderkey as uid, log10(o_totalprice) as m from orders), lim as (select min(m) as lo, max(m) as hi from o),
b as (select uid, least(floor((m - lo) / ((hi - lo) / 10))::int, 9) as bin from o, lim), c as (select bin, count(*) as n, row_number() over (order by count(*), bin) as k, count(*) over () as bins from b group by bin),
q(k, bin, quota, rem) as (select 0::bigint, -1, 0::bigint, 1000::bigint union all select c.k, c.bin, least(c.n, rem // (bins - c.k + 1)), rem - least(c.n, rem // (bins - c.k + 1)) from q join c on c.k = q.k + 1),
h as (select uid, bin, row_number() over (partition by bin order by {H}, uid) as r from b)
select uid, h.bin from h join q on q.bin = h.bin where r <= quota""")
def t05(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("uid"), F.log10("o_totalprice").alias("m"))
    return catalog.balanced_sample(o, "m", 10, 1000, seed=1).select("uid", "bin")


@query("t07_catalogue", fx.with_sql(E, "t as (select distinct last_day(o_orderdate)::date as day from orders)", then="""
select y, x, strftime(day, '%Y-%m-%d') as datetime from grid_events, t"""))
def t07(spark: SparkSession, d: str) -> DataFrame:
    """Month ends of the orders times every point of the event grid."""
    times = fx.read(spark, d, "orders").select(F.last_day("o_orderdate").alias("day")).distinct()
    points = fx.grid_events(spark, d).select("y", "x", "lat", "lon")
    return catalog.generate(points, times).select("y", "x", F.col("datetime").cast("string").alias("datetime"))


@query("t08_g10_cutout_fields", fx.with_sql(C, O, "k as (select uid, (uid * 13 % 90)::int as row, (uid * 29 % 90)::int as col from catalog)", then="""
select uid, count(*) as n, round(sum(g), 2) as g, count(*) = 64 as complete from k join grid_orders o on o.y between row and row + 7 and o.x between col and col + 7 group by uid"""))
def t08(spark: SparkSession, d: str) -> DataFrame:
    k = fx.catalog(spark, d).select("uid", (F.col("uid") * 13 % 90).cast("int").alias("row"), (F.col("uid") * 29 % 90).cast("int").alias("col"))
    got = catalog.covered_fields(k, fx.grid_orders(spark, d), 8)
    return got.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("g"), 2).alias("g"), (F.count(F.lit(1)) == 64).alias("complete"))


@query("t10_stacks", "select vec_id as uid, 64 as n, round(cast(embedding[1] as double), 6) as first, round(2 * cast(embedding[64] as double), 6) as last from embeddings")
def t10(spark: SparkSession, d: str) -> DataFrame:
    st = catalog.stack(fx.cutouts(spark, d).withColumn("g", F.col("f") * 2), ["f", "g"])
    return st.select("uid", F.size(st.channels[0]).alias("n"), F.round(st.channels[0][0], 6).alias("first"), F.round(st.channels[1][63], 6).alias("last"))


@query("t11_binary_target", fx.with_sql(fx.CUTOUTS, "q as (select uid, quantile_cont(f, 0.8) as q from cutouts group by uid)", then="select uid, y, x, (f > 0.05 and f > q)::int as target from cutouts join q using (uid)"))
def t11(spark: SparkSession, d: str) -> DataFrame:
    return catalog.binary_target(fx.cutouts(spark, d), "f", 0.05, 80).select("uid", "y", "x", "target")


@query("t01_t03_sets", fx.with_sql(C, then="(select uid from catalog where flag_a union all select uid from catalog where flag_b) except all select uid from catalog where month = 2"))
def t01(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d)
    return c.filter("flag_a").select("uid").unionByName(c.filter("flag_b").select("uid")).exceptAll(c.filter("month = 2").select("uid"))


@query("s10_s11_not_done", fx.with_sql(C, then="select distinct 2 as version, month as snapshot, label as config from catalog where not (month % 2 = 0 and label < 5)"))
def s10(spark: SparkSession, d: str) -> DataFrame:
    req = fx.catalog(spark, d).select(F.lit(2).alias("version"), F.col("month").alias("snapshot"), F.col("label").alias("config")).distinct()
    return tables.not_done(req, req.filter("snapshot % 2 = 0 and config < 5"))


@query("s10_clobbered", fx.with_sql(C, "k as (select distinct month as snapshot, label as config from catalog)", then="""
select 2 as version, snapshot, config, case when snapshot % 2 = 0 then 'second' else 'first' end as run from k"""))
def s10_clobbered(spark: SparkSession, d: str) -> DataFrame:
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    req = checkpointed(fx.catalog(spark, d).select(F.lit(2).alias("version"), F.col("month").alias("snapshot"), F.col("label").alias("config")).distinct())
    run = lambda name: lambda todo: todo.withColumn("run", F.lit(name))
    tables.process_runs(req.filter("snapshot < 4"), path, run("first"))
    tables.process_runs(req, path, run("first"))  # what is there already is left alone
    tables.process_runs(req.filter("snapshot % 2 = 0"), path, run("second"), clobber=True)
    return spark.read.parquet(path).select("version", "snapshot", "config", "run")


@query("s11_missing_inputs", fx.with_sql(C, then="select distinct month as snapshot, 'F' || label as field from catalog where not (month < 3 or label in (1, 4))"))
def s11(spark: SparkSession, d: str) -> DataFrame:
    req = fx.catalog(spark, d).select(F.col("month").alias("snapshot"), F.concat(F.lit("F"), F.col("label")).alias("field"))
    return tables.missing_inputs(req, req.filter("snapshot < 3 or field in ('F1', 'F4')"))


@query("s04_npy_round_trip", fx.with_sql(E, then="select y, x, f as value from grid_events"))
def s04(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(NpyDataSource)
    g = fx.grid_events(spark, d).select("y", "x", F.col("f").alias("value"))
    at = f"{shared_folder(spark).removeprefix('file://')}/map-{uuid.uuid4().hex}.npy"
    g.repartition(8).write.format("npy").option("path", at).option("height", size(g)).option("width", 100).mode("append").save()
    return spark.read.format("npy").option("path", at).option("rows", 64).load()


@query("s12_by_subset", "select case when p_size < 20 then 'small' when p_size < 40 then 'large' end as subset, array_to_string(list_sort(list(distinct p_brand)), ',') as properties from part where p_brand <> 'Brand#11' group by 1")
def s12(spark: SparkSession, d: str) -> DataFrame:
    p = fx.read(spark, d, "part").select(F.col("p_brand").alias("property"), F.expr("case when p_size < 20 then 'small' when p_size < 40 then 'large' end").alias("subset"))
    got = tables.by_subset(p.select("property"), p.distinct(), p.filter("property = 'Brand#11'").select("property").distinct())
    return got.select("subset", F.array_join("properties", ",").alias("properties"))


@query("s14_merged_inventories", fx.with_sql("a as (select epoch(o_orderdate)::bigint as s, o_orderkey as k, 0 as q from orders where o_orderkey % 2 = 0 union all select epoch(o_orderdate)::bigint, o_orderkey, 1 from orders where o_orderkey % 3 = 0)", then="""
select s as seconds_since_1970, k as num_clear from (select *, row_number() over (partition by s order by q, k) as n from a) where n = 1"""))
def s14(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").cast("long").alias("seconds_since_1970"), F.col("o_orderkey").alias("num_clear"))
    return archive.merged_inventories([o.filter("num_clear % 2 = 0"), o.filter("num_clear % 3 = 0")])


@query("s07_wide_fields", fx.with_sql(O, then="select y, (x + 7) % 100 as x, g, u from grid_orders where y % 2 = 0 and x % 2 = 0"))
def s07(spark: SparkSession, d: str) -> DataFrame:
    o = fx.grid_orders(spark, d)
    long = o.select("grid_id", "y", "x", F.explode(F.create_map(F.lit("g"), "g", F.lit("u"), "u", F.lit("v"), "v")).alias("field", "value"))
    return tables.wide_fields(long, ["g", "u"], 2, 7, 100).select("y", "x", "g", "u")


@query("s05_run_metadata", fx.with_sql(E, then="""
select max(y) + 1 as height, 100 as width, count(*) as n_cells, round(min(lat), 6) as lat_min, round(max(lat), 6) as lat_max,
  count(*) as n_label_cells, count(distinct y) as n_labels, 'f,u' as fields, 'A' as config, '0.5' as threshold from grid_events"""))
def s05(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return tables.run_metadata(g, g.select("grid_id", F.col("y").alias("label")), ["f", "u"], config="A", threshold="0.5").select(
        "height", "width", "n_cells", r("lat_min", 6), r("lat_max", 6), "n_label_cells", "n_labels", F.array_join("fields", ",").alias("fields"), "config", "threshold"
    )


@query("p08_p09_columns", fx.with_sql(LC, then="select label, count(*) as npix, round(median(p1), 5) as p1, round(avg(p2), 5) as p2, round(median(p1), 5) as p1_median from label_cells group by label"))
def p08(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.colocate import label_statistics

    c = fx.label_cells(spark, d)
    both = label_statistics(c, ["p1"], ("median", "mean")).join(label_statistics(c, ["p2"], ("mean",)).drop("npix"), "label")
    some = tables.columns_like(both, ("p1",), ("_median",), ("label", "npix", "p2_mean"))
    assert some.columns == ["label", "npix", "p1_median", "p2_mean"]
    one, two = tables.first_available(some, "p1"), tables.first_available(some, "p2")
    return some.select("label", "npix", one, two, "p1_median").select("label", "npix", r("p1"), r("p2"), r("p1_median"))


@query("j15_split_rows", fx.with_sql(C, then="select uid from catalog where uid % 3 = 1 and month in (1, 4)"))
def j15(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d).withColumns({"split": (F.col("uid") % 3).cast("int"), "t": F.col("month")})
    return catalog.split_rows(c, "train", c.filter("uid % 3 = 1").select("uid"), c.filter("month in (1, 4)")).select("uid")


@query("t09_gathered", fx.with_sql(fx.CUTOUTS, then="select uid, y, x, round(f, 6) as f, case when uid % 5 <> 0 then round(f * 2, 6) end as g from cutouts"))
def t09(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cutouts(spark, d)
    long = c.select("uid", "y", "x", F.explode(F.create_map(F.lit("f"), F.col("f"), F.lit("g"), F.col("f") * 2, F.lit("h"), F.col("f") * 3)).alias("field", "value"))
    got = catalog.gathered(long.filter("field <> 'g' or uid % 5 <> 0"), ["f", "g"])
    return got.select("uid", "y", "x", r("f", 6), r("g", 6))


@query("t12_training_set", fx.with_sql(C, f"k as (select uid, row_number() over (order by {H}, uid) as k from catalog)", then="""
select uid, case when k <= 200 then 'train' when k <= 250 then 'valid' else 'test' end as split, case when k <= 200 then 1 when k <= 250 then 0 else 2 end as pp_type,
  64 as n, round(2 * cast(embedding[64] as double), 6) as last from k join embeddings on vec_id = uid where k <= 300"""))
def t12(spark: SparkSession, d: str) -> DataFrame:
    got = catalog.training_set(fx.catalog(spark, d), fx.cutouts(spark, d).withColumn("g", F.col("f") * 2), ["f", "g"], {"train": 200, "valid": 50, "test": 50}, seed=1)
    return got.select("uid", "split", "pp_type", F.size(got.channels[0]).alias("n"), F.round(got.channels[1][63], 6).alias("last"))


# --- histograms ----------------------------------------------------------------------------------------------------------

BIN = "case when {v} >= {lo} and {v} <= {hi} then least(floor(({v} - ({lo})) / ({w}))::int, {n} - 1) end"
BU, BV = BIN.format(v="u", lo=-50, hi=450, w=25, n=20), BIN.format(v="v", lo=-50, hi=50, w=10, n=10)
UVB = f"b as (select *, {BU} as bx, {BV} as \"by\" from grid_orders), c as (select * from b where bx is not null and \"by\" is not null)"
JP = ("u", "v", 20, 10, (-50, 450), (-50, 50))


@query("a09_joint_histogram", fx.with_sql(O, UVB, then="select bx, \"by\", count(*) as n, round(count(*) / ((select count(*) from c) * 250.0), 9) as pdf from c group by bx, \"by\""))
def a09(spark: SparkSession, d: str) -> DataFrame:
    return histograms.joint(fx.grid_orders(spark, d), *JP).withColumn("pdf", F.round("pdf", 9))


@query("a10_auto_range", fx.with_sql(O, "q as (select quantile_cont(u, 0.01) as lo, quantile_cont(u, 0.99) as hi from grid_orders)", then="""
select round(greatest(0, lo), 5) as lo, round(hi, 5) as hi, round(-greatest(abs(lo), abs(hi)), 5) as sym_lo from q"""))
def a10(spark: SparkSession, d: str) -> DataFrame:
    u = fx.grid_orders(spark, d)
    (lo, hi), (sym, _) = histograms.percentile_range(u, "u"), histograms.percentile_range(u, "u", symmetric=True)
    return spark.createDataFrame([(lo, hi, sym)], "lo double, hi double, sym_lo double").select(r("lo"), r("hi"), r("sym_lo"))


@query("a11_conditional_mean", fx.with_sql(O, UVB, then="select bx, \"by\", count(g) as n, case when count(g) >= 60 then round(sum(g) / count(g), 3) end as mean from c group by bx, \"by\""))
def a11(spark: SparkSession, d: str) -> DataFrame:
    u, v, nx, ny, xr, yr = JP
    return histograms.conditional_mean(fx.grid_orders(spark, d), u, v, "g", nx, ny, xr, yr, 60).withColumn("mean", F.round("mean", 3))


@query("a13_accumulated", fx.with_sql(O, UVB, "s as (select y // 40 as snapshot, bx, \"by\", count(*) as n from c group by 1, 2, 3)", "p as (select *, n / (sum(n) over (partition by snapshot) * 250.0) as pdf from s)", then="""
select bx, "by", sum(n)::bigint as n, round(sum(pdf) / (select count(distinct snapshot) from s), 9) as pdf from p group by bx, \"by\""""))
def a13(spark: SparkSession, d: str) -> DataFrame:
    o = fx.grid_orders(spark, d).withColumn("snapshot", F.expr("y div 40"))
    return histograms.accumulate(histograms.joint(o, *JP, by=("snapshot",))).withColumn("pdf", F.round("pdf", 9))


@query("a14_flow_regions", fx.with_sql(O, UVB, "h as (select bx, \"by\", count(*) as n from c group by 1, 2)", then="""
select case when bx - 10 < -("by" + 0.5) then 'AVD' when bx - 10 > "by" + 0.5 then 'CVD' else 'SD' end as region, round(sum(n) / (select sum(n) from h), 6) as share from h group by 1"""))
def a14(spark: SparkSession, d: str) -> DataFrame:
    h = histograms.joint(fx.grid_orders(spark, d), *JP)
    return histograms.flow_regions(h, F.col("bx") - 10, F.col("by") + 0.5).withColumn("share", F.round("share", 6))


@query("a15_binned_map", fx.with_sql(C, then="""
select least(floor((lat + 90) / 15)::int, 11) as by, least(floor((lon + 180) / 20)::int, 17) as bx, count(label) as n, round(avg(label), 6) as mean from catalog group by 1, 2 having count(label) >= 2"""))
def a15(spark: SparkSession, d: str) -> DataFrame:
    return histograms.binned_map(fx.catalog(spark, d), "label", 12, 18, 2).withColumn("mean", F.round("mean", 6))


@query("a16_log_joint", fx.with_sql(O, """b as (select case when v between -50 and 50 then least(floor((v + 50) / 10)::int, 9) end as bx,
  case when g between 1000 and 600000 then least(floor((log10(g) - 3) / ((log10(600000) - 3) / 12))::int, 11) end as "by" from grid_orders)""", then="select bx, \"by\", count(*) as n from b where bx is not null and \"by\" is not null group by bx, \"by\""))
def a16(spark: SparkSession, d: str) -> DataFrame:
    return histograms.log_joint(fx.grid_orders(spark, d), "v", "g", 10, 12, (-50, 50), (1000, 600000)).select("bx", "by", "n")


@query("a17_histogram", fx.with_sql("q as (select quantile_cont(o_totalprice, 0.01) as lo, quantile_cont(o_totalprice, 0.99) as hi from orders)", "b as (select least(floor((o_totalprice - lo) / ((hi - lo) / 40))::int, 39) as bin from orders, q where o_totalprice between lo and hi)", then="select bin, count(*) as n from b group by bin"))
def a17(spark: SparkSession, d: str) -> DataFrame:
    return histograms.histogram(fx.read(spark, d, "orders"), "o_totalprice", 40).select("bin", "n")


@query("a18_kernel_density", fx.with_sql("s as (select count(*) as n, stddev_samp(p_retailprice) as s, min(p_retailprice) as lo, max(p_retailprice) as hi from part)", then="""
select k::int as k, round(1e6 * sum(exp(-pow((lo + (hi - lo) * k / 59 - p_retailprice) / (s * pow(n, -0.2)), 2) / 2)) / max(n * s * pow(n, -0.2) * sqrt(2 * pi())), 5) as density from part, s, range(0, 60) t(k) group by k"""))
def a18(spark: SparkSession, d: str) -> DataFrame:
    return histograms.kernel_density(fx.read(spark, d, "part"), "p_retailprice", 60).select("k", F.round(F.col("density") * 1e6, 5).alias("density"))


@query("a19_weak_and_strong", fx.with_sql(O, "q as (select quantile_cont(g, 0.8) as q from grid_orders)", then="select case when g >= q then 'strong' else 'weak' end as part, count(*) as n, round(avg(u), 6) as u from grid_orders, q group by 1"))
def a19(spark: SparkSession, d: str) -> DataFrame:
    return histograms.split_by_percentile(fx.grid_orders(spark, d), "g", 80).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("u"), 6).alias("u"))


@query("a06_a07_cutout_summary", fx.with_sql(fx.CUTOUTS, then="""
select uid, round(avg(f), 6) as mu, round(min(f), 6) as min, round(max(f), 6) as max, round(quantile_cont(f, 0.1), 6) as p10, round(quantile_cont(f, 0.9), 6) as p90,
  round(quantile_cont(f, 0.9) - quantile_cont(f, 0.1), 6) as dt, count(*) filter (f > 0.1) as n_pos, count(*) filter (f < -0.1) as n_neg,
  round(coalesce(sum(f) filter (f > 0), 0), 6) as pos_sum, round(coalesce(sum(f) filter (f < 0), 0), 6) as neg_sum from cutouts group by uid"""))
def a06(spark: SparkSession, d: str) -> DataFrame:
    c = fx.cutouts(spark, d)
    both = features.cutout_summary(c, "f").join(features.counters(c, "f", 0.1), "uid")
    return both.select("uid", "n_pos", "n_neg", *[r(k, 6) for k in ("mu", "min", "max", "p10", "p90", "dt", "pos_sum", "neg_sum")])


# --- features ------------------------------------------------------------------------------------------------------------

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("a20_correlations", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(COLS) for b in COLS[i:]))
def a20(spark: SparkSession, d: str) -> DataFrame:
    return features.correlations(fx.read(spark, d, "lineitem"), COLS).withColumn("r", F.round("r", 6))


@query("a21_p11_scaled", "select vec_id, round((label - (select avg(label) from embeddings)) / (select stddev_pop(label) from embeddings), 6) as label from embeddings")
def a21(spark: SparkSession, d: str) -> DataFrame:
    return features.scaled(features.finite(fx.read(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label")), ["label"]), ["label"]).select("vec_id", r("label", 6))


FRONT_COLS = [f"{p}_{s}" for p in ("p1", "p2", "p3") for s in ("mean", "std")]


@query("a22_pca_variance")
def a22(spark: SparkSession, d: str) -> DataFrame:
    return features.PCA(fx.read(spark, d, "lineitem"), COLS, 3).summary(spark, 2).select("pc", r("variance_ratio", 5), r("cumulative", 5), "rank", "column", r("loading", 4))


@query("a23_front_pca")
def a23(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.colocate import label_statistics

    fronts = label_statistics(fx.label_cells(spark, d), ["p1", "p2", "p3"], ("mean", "std"), min_size=2)
    return features.PCA(fronts, FRONT_COLS, 3).summary(spark, 3).select("pc", r("variance_ratio", 5), r("cumulative", 5), "rank", "column", r("loading", 4))


@query("u01_custom_statistics", fx.with_sql(LC, then="select label, count(*) as npix, round(max(p2) - min(p2), 4) as p2_range, round(sqrt(avg(p2 * p2)), 4) as p2_rms from label_cells group by label"))
def u01(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.colocate import label_statistics, register_stat

    register_stat("range", lambda c: F.max(c) - F.min(c))
    register_stat("rms", lambda c: F.sqrt(F.avg(c * c)))
    return label_statistics(fx.label_cells(spark, d), ["p2"], ("range", "rms")).select("label", "npix", r("p2_range", 4), r("p2_rms", 4))


@query("a24_pca_reconstructed")
def a24(spark: SparkSession, d: str) -> DataFrame:
    df = fx.read(spark, d, "lineitem")
    pca = features.PCA(df, COLS, 4)
    back = pca.reconstruct(pca.project(df), [1, 2, 3, 4])
    return back.agg(*[F.round(F.max(F.abs(F.col(c) - F.col(f"{c}_back"))), 4).alias(c) for c in COLS])


@query("a26_healpix_like_map", fx.with_sql(C, """t as (select label, sin(radians(lat)) as z, ((radians(lon) % (2 * pi()) + 2 * pi()) % (2 * pi())) / (pi() / 2) as t from catalog)""",
    """p as (select label, z, floor(4 * (0.5 + t) - 4 * z * 0.75)::int as jp, floor(4 * (0.5 + t) + 4 * z * 0.75)::int as jm, t, t - floor(t) as tp, 4 * sqrt(3 * (1 - abs(z))) as w from t)""",
    """q as (select *, 5 + jp - jm as ir, 1 - (5 + jp - jm) % 2 as kshift, floor(tp * w)::int + floor((1 - tp) * w)::int + 1 as ic from p)""",
    """n as (select label, case when abs(z) <= 2 / 3 then 2 * 4 * 3 + (ir - 1) * 16 + (((jp + jm - 4 + kshift + 1) // 2) % 16 + 16) % 16
  when z > 0 then 2 * ic * (ic - 1) + least(floor(t * ic)::int, 4 * ic - 1) else 192 - 2 * ic * (ic + 1) + least(floor(t * ic)::int, 4 * ic - 1) end::bigint as pixel from q)""",
    then="select pixel, count(*) as n, round(avg(label), 6) as mean from n group by pixel"))
def a26(spark: SparkSession, d: str) -> DataFrame:
    from tidegrid.operators.maps import ring_pixel

    return fx.catalog(spark, d).groupBy(ring_pixel(F.col("lat"), F.col("lon"), 4).alias("pixel")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("mean"))


@query("a27_w08_cluster_profile", fx.with_sql("p as (select l_returnflag, count(*) as n, median(l_quantity) as q, median(l_extendedprice) as e from lineitem group by 1)", then="""
select l_returnflag, n, q as l_quantity, e as l_extendedprice, round(n / (select sum(n) from p), 6) as share from p"""))
def a27(spark: SparkSession, d: str) -> DataFrame:
    return features.cluster_profile(fx.read(spark, d, "lineitem"), "l_returnflag", ["l_quantity", "l_extendedprice"]).select("l_returnflag", "n", "l_quantity", "l_extendedprice", r("share", 6))


@query("a28_density_clusters", fx.with_sql(C, "p as (select uid, lat / 10 as a, lon / 10 as b from catalog)", "near as (select x.uid as u, y.uid as v from p x, p y where pow(x.a - y.a, 2) + pow(x.b - y.b, 2) <= 1.0)", """core as (
  select u from near group by u having count(*) >= 4)""", "r(u, v) as (select u, u from core union select r.u, near.v from r join near on near.u = r.v join core c on c.u = near.v)", "lab as (select u, min(v) as l from r group by u)", """e as (
  select near.v as uid, min(l) as l from near join lab on lab.u = near.u group by 1)""", then="select uid, coalesce(l, -1)::bigint as cluster from p left join e using (uid)").replace("with ", "with recursive ", 1))
def a28(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d).select("uid", (F.col("lat") / 10).alias("a"), (F.col("lon") / 10).alias("b"))
    return features.density_clusters(c, "uid", ["a", "b"], 1.0, 4)


SCANNED = [(0.6, 2), (0.6, 4), (0.8, 2), (0.8, 4), (1.0, 4), (1.0, 6)]


@query("a28_parameter_scan", fx.with_sql(C, "p as (select uid, lat / 10 as a, lon / 10 as b from catalog)", "q(eps, m, place) as (values " + ", ".join(f"({e}, {m}, {k})" for k, (e, m) in enumerate(SCANNED)) + ")", """near as (
  select eps, m, x.uid as u, y.uid as v from p x, p y, q where pow(x.a - y.a, 2) + pow(x.b - y.b, 2) <= eps * eps)""", "core as (select eps, m, u from near group by 1, 2, 3 having count(*) >= m)",
    "r(eps, m, u, v) as (select eps, m, u, u from core union select r.eps, r.m, r.u, n.v from r join near n on n.u = r.v and n.eps = r.eps and n.m = r.m join core c on c.u = n.v and c.eps = r.eps and c.m = r.m)",
    "lab as (select eps, m, u, min(v) as l from r group by 1, 2, 3)", "e as (select n.eps, n.m, n.v as uid, min(l) as l from near n join lab using (eps, m, u) group by 1, 2, 3)", """s as (
  select q.eps, q.m, place, count(distinct l) as n_clusters, avg((l is null)::int) as noise_share from q cross join p left join e on e.uid = p.uid and e.eps = q.eps and e.m = q.m group by 1, 2, 3)""",
    then="""select eps::double as eps, m::int as min_points, n_clusters, round(noise_share, 9) as noise_share,
  coalesce(noise_share < 0.7 and n_clusters > 0 and row_number() over (order by noise_share < 0.7 and n_clusters > 0 desc, n_clusters desc, place) = 1, false) as chosen from s""").replace("with ", "with recursive ", 1))
def a28_scan(spark: SparkSession, d: str) -> DataFrame:
    c = fx.catalog(spark, d).select("uid", (F.col("lat") / 10).alias("a"), (F.col("lon") / 10).alias("b"))
    found = density.clusters(c, "uid", ["a", "b"], SCANNED)
    return density.scan(found, SCANNED, 0.7).withColumn("noise_share", F.round("noise_share", 9))


@query("w01_cumulative_share", "select v as o_totalprice, round(sum(w) over (order by v) / sum(w) over (), 6) as share from (select o_totalprice as v, count(*) as w from orders group by 1)")
def w01(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders").withColumn("w", F.lit(1))
    return features.cumulative_share(o, "w", "o_totalprice").withColumn("share", F.round("share", 6))


@query("w02_running_mean", fx.with_sql(IM, "c as (select y, x, image_id as t, case when event_id % 5 = 0 then null else f end as f from images)", then="""
select y, x, t, count(f) over w as n, round(avg(f) over w, 8) as mean from c window w as (partition by y, x order by t rows between unbounded preceding and current row) qualify count(f) over w >= 1"""))
def w02(spark: SparkSession, d: str) -> DataFrame:
    c = fx.images(spark, d).select("y", "x", F.col("image_id").alias("t"), F.expr("case when event_id % 5 = 0 then null else f end").alias("f"))
    return archive.running_mean(c, "f").select("y", "x", "t", "n", r("mean", 8))


@query("w04_w05_strided_first", "select o_orderkey from (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as k from orders) where k % 7 = 0")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return numbered_rows(fx.read(spark, d, "orders").select("o_totalprice", "o_orderkey"), "o_totalprice", "o_orderkey").filter("k % 7 = 0").select("o_orderkey")


@query("a34_clear_images", fx.with_sql(IM, then="select image_id, count(f) filter (f > 20) as num_clear from images group by 1 having count(f) filter (f > 20) >= 200"))
def a34(spark: SparkSession, d: str) -> DataFrame:
    return archive.clear_images(fx.images(spark, d).withColumn("f", F.expr("case when f > 20 then f end")), "f", 200)


def _samples(spark: SparkSession, d: str) -> DataFrame:
    o = fx.grid_orders(spark, d)
    seg = o.select(F.col("y").alias("seg"), F.col("x").alias("m"), "y", "x")
    return archive.profile_arrays(seg, o, "g", size(o), 100, 8)


SAMPLES = """p as (select y as seg, x as m, y, x from grid_orders),
s as (select p.seg, p.m, k as "offset", g as v from p cross join range(-8, 9) r(k) join grid_orders o on o.x = p.x and o.y = greatest(0, least((select max(y) from grid_orders), p.y + k)))"""


@query("a35_profiles", fx.with_sql(O, SAMPLES, then='select seg, m, "offset"::int as "offset", v from s'))
def a35(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("seg", "m", F.explode("s").alias("s")).select("seg", "m", "s.offset", "s.v")


#: A closed line, a wave and a zigzag with side branches on the cells of the event grid.
CURVES = """(y % 34 < 23 and floor(sqrt(pow(y % 34 - 11, 2) + pow(x - 20, 2)))::int = 9) or x = 60 + round(8 * sin(y / 8.0))::int or (x = 80 + abs(y % 12 - 6)) or (y % 12 = 3 and x between 84 and 97)"""


LINES = (
    f"on_ as (select y, x, y * 1000 + x as id from grid_events where {CURVES})", """near as (
  select a.id as u, b.id as v from on_ a join on_ b on abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and a.id <> b.id
  where a.y = b.y or a.x = b.x or not exists (select 1 from on_ c where (c.y = a.y and c.x = b.x) or (c.y = b.y and c.x = a.x)))""",
    "plain as (select id from on_ where (select count(*) from near where u = id) <= 2)", "lk as (select u, v from near where u in (select id from plain) and v in (select id from plain))",
    "r(u, v) as (select id, id from plain union select r.u, lk.v from r join lk on lk.u = r.v)", "root as (select u as id, min(v) as root from r group by u)", """deg as (
  select id, root, (select count(*) from lk where u = id) as k from root)""", """start as (
  select root, coalesce(min(id) filter (k < 2), root) as id, coalesce(min(id) filter (k < 2), -1) < 0 as closed from deg group by root)""", """walk(root, m, id, prev) as (
  select root, 1, id, case when closed then (select max(v) from lk where u = start.id) else -1 end from start
  union all select w.root, w.m + 1, lk.v, w.id from walk w join lk on lk.u = w.id and lk.v <> w.prev join start s on s.root = w.root and lk.v <> s.id)""", "line as (select dense_rank() over (order by root) as seg, m::bigint as m, (id // 1000)::int as y, (id % 1000)::int as x from walk)",
)


@query("a35_line_order", fx.with_sql(E, *LINES, then="select seg, m, y, x from line").replace("with ", "with recursive ", 1))
def a35_order(spark: SparkSession, d: str) -> DataFrame:
    return curved_lines(spark, d)


def curved_lines(spark: SparkSession, d: str) -> DataFrame:
    y, x = F.col("y"), F.col("x")
    ring = (y % 34 < 23) & (F.floor(F.sqrt(F.pow(y % 34 - 11, 2) + F.pow(x - 20, 2))) == 9)
    wave = x == 60 + F.round(8 * F.sin(y / 8.0)).cast("int")
    zigzag = (x == 80 + F.abs(y % 12 - 6)) | ((y % 12 == 3) & x.between(84, 97))
    lines = archive.line_order(fx.grid_events(spark, d).filter(ring | wave | zigzag))
    return lines.select("seg", "m", "y", "x")


#: Directions by two points on both sides, at the ends by the first or last five points, of short lines by the whole; samples along the normal.
ACROSS = (
    "n as (select *, count(*) over (partition by seg) as n from line)",
    """e as (select *, case when n < 5 or m <= 2 then 1 when m > n - 2 then n - 4 else m - 2 end as lo, case when n < 5 then n when m <= 2 then 5 when m > n - 2 then n else m + 2 end as hi from n)""",
    """v as (select e.seg, e.m, e.y, e.x, (q.y - p.y)::double as dy, (q.x - p.x)::double as dx, sqrt(pow(q.y - p.y, 2) + pow(q.x - p.x, 2)) as len
  from e join line p on p.seg = e.seg and p.m = e.lo join line q on q.seg = e.seg and q.m = e.hi)""",
    """o as (select seg, m, k as "offset", greatest(0, least((select max(y) from grid_events), round_even(y + k * dx / len, 0)::int)) as y, greatest(0, least(99, round_even(x + k * -dy / len, 0)::int)) as x
  from v cross join range(-6, 7) r(k) where len > 0)""",
    """s as (select seg, m, "offset", g.f as v from o join grid_events g using (y, x))""",
)


def curved_samples(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return archive.profile_arrays(checkpointed(curved_lines(spark, d)), g, "f", size(g), 100, 6)


@query("a35_curved_profiles", fx.with_sql(E, *LINES, *ACROSS, then='select seg, m, "offset"::int as "offset", v from s').replace("with ", "with recursive ", 1))
def a35_curved(spark: SparkSession, d: str) -> DataFrame:
    return curved_samples(spark, d).select("seg", "m", F.explode("s").alias("s")).select("seg", "m", "s.offset", "s.v")


@query("a36_a38_curved_across", fx.with_sql(E, *LINES, *ACROSS, """g as (select seg, m, avg(v) filter ("offset" < 0) as before, avg(v) filter ("offset" > 0) as after, avg(v) filter (abs("offset") >= 5) as background,
  arg_max(v, abs(v) * 1000 - "offset" * 1e-6) filter (abs("offset") <= 3) as feature from s group by seg, m)""", """t as (
  select seg, m, "offset" as o, avg(v) over w as a, count(v) over w as c from s window w as (partition by seg, m order by "offset" rows between 1 preceding and 1 following))""", """b as (
  select seg, m, o from t where c = 3 qualify row_number() over (partition by seg, m order by a desc, case when o < 0 then o + 1000 else -o end desc) = 1)""", then="""
select seg, m, round(before, 6) as before, round(after, 6) as after, round((after - before) * 10, 5) as contrast, round(background, 6) as background, feature, o::int as steepest
from g left join b using (seg, m)""").replace("with ", "with recursive ", 1))
def a36_curved(spark: SparkSession, d: str) -> DataFrame:
    s = checkpointed(curved_samples(spark, d))
    both = archive.across(s).join(archive.steepest_offset(s).withColumnRenamed("offset", "steepest"), ["seg", "m"], "left")
    return both.select("seg", "m", r("before", 6), r("after", 6), r("contrast", 5), r("background", 6), "feature", "steepest")


@query("a36_a37_across", fx.with_sql(O, SAMPLES, then="""
select seg, m, round(avg(v) filter ("offset" < 0), 7) as before, round(avg(v) filter ("offset" > 0), 7) as after, round(avg(v) filter (abs("offset") >= 5), 7) as background,
  max(v) filter (abs("offset") <= 3) as feature from s group by seg, m"""))
def a36(spark: SparkSession, d: str) -> DataFrame:
    return archive.across(_samples(spark, d)).select("seg", "m", r("before", 7), r("after", 7), r("background", 7), "feature")


@query("a38_steepest_offset", fx.with_sql(O, SAMPLES, """t as (select seg, m, "offset" as o, avg(v) over w as a, count(v) over w as c from s window w as (partition by seg, m order by "offset" rows between 1 preceding and 1 following))""", then="""
select seg, m, o::int as "offset" from t where c = 3 qualify row_number() over (partition by seg, m order by a desc, case when o < 0 then o + 1000 else -o end desc) = 1"""))
def a38(spark: SparkSession, d: str) -> DataFrame:
    return archive.steepest_offset(_samples(spark, d))


@query("a08_j11_finite_semi", fx.with_sql(LC, then="select count(*) as n, round(avg(p2), 4) as mean, min(p2) as lo, max(p2) as hi from label_cells where label in (select o_orderkey from orders where o_orderstatus = 'F') and p2 is not null"))
def a08(spark: SparkSession, d: str) -> DataFrame:
    f = fx.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("label"))
    return features.finite(fx.label_cells(spark, d).join(f, "label", "left_semi"), ["p2"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p2"), 4).alias("mean"), F.min("p2").alias("lo"), F.max("p2").alias("hi"))


@query("t13_seeded_subsample", fx.with_sql("k as (select o_orderkey as uid from orders)", then=f"select uid from k order by {H}, uid limit 500"))
def t13(spark: SparkSession, d: str) -> DataFrame:
    o = fx.read(spark, d, "orders").select(F.col("o_orderkey").alias("uid"))
    return o.orderBy(catalog.hash_order("uid", 1), "uid").limit(500)
