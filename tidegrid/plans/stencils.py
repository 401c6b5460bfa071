"""Queries of the neighbourhood operators over the event and order grids, and their SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.ocean import buoyancy, density
from tidegrid.operators import archive, stencil
from tidegrid.plans import fixtures as fx

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


def r(c: str, k: int = 5):
    return F.round(c, k).alias(c)


def size(grid: DataFrame) -> int:
    """Rows of a grid."""
    return grid.agg(F.max("y")).first()[0] + 1


E, O = fx.GRID_EVENTS, fx.GRID_ORDERS


def shifted(view: str, value: str, name: str = "s", offsets=((0, -1), (0, 1), (-1, 0), (1, 0))) -> str:
    """A view with a column a neighbour: l, r, u, d for the four sides, or v_dy_dx."""
    names = {(0, -1): "l", (0, 1): "r", (-1, 0): "u", (1, 0): "d"}
    cols = ", ".join(f"n{i}.{value} as {names.get(o, f'v{i}')}" for i, o in enumerate(offsets))
    joins = " ".join(f"left join {view} n{i} on n{i}.grid_id = a.grid_id and n{i}.y = a.y + ({dy}) and n{i}.x = a.x + ({dx})" for i, (dy, dx) in enumerate(offsets))
    return f"{name} as (select a.*, {cols} from {view} a {joins})"


@query("n02_global_threshold", fx.with_sql(E, then="""
select grid_id, y, x from grid_events where f > (select quantile_cont(f, 0.9) from grid_events)"""))
def n02(spark: SparkSession, d: str) -> DataFrame:
    return stencil.global_threshold(fx.grid_events(spark, d), "f", 90).select("grid_id", "y", "x")


@query("n01_window_64", fx.with_sql(E, """w as (
  select a.y, a.x, a.f, quantile_cont(b.f, 0.9) as p from grid_events a join grid_events b on b.y between a.y - 32 and a.y + 31 and b.x between a.x - 32 and a.x + 31
  group by a.y, a.x, a.f)""", then="select 0::int as grid_id, y, x from w where f > p"))
def n01_64(spark: SparkSession, d: str) -> DataFrame:
    return stencil.local_threshold(fx.grid_events(spark, d), "f", 64, 90).select("grid_id", "y", "x")


@query("n24_destriped_by_lines")
def n24_lines(spark: SparkSession, d: str) -> DataFrame:
    return archive.destriped_by_lines(fx.images(spark, d), "f", 20, 20, 3.0)


@query("n01_local_threshold", fx.with_sql(E, """w as (
  select a.y, a.x, a.f, quantile_cont(b.f, 0.9) as p from grid_events a join grid_events b on b.y between a.y - 4 and a.y + 3 and b.x between a.x - 4 and a.x + 3
  group by a.y, a.x, a.f)""", then="select 0::int as grid_id, y, x from w where f > p"))
def n01(spark: SparkSession, d: str) -> DataFrame:
    return stencil.local_threshold(fx.grid_events(spark, d), "f", 8, 90, tile=50).select("grid_id", "y", "x")


@query("n03_weak_removed", fx.with_sql(E, then="""
select y, x from grid_events where f > (select quantile_cont(f, 0.8) from grid_events) and f > 20"""))
def n03(spark: SparkSession, d: str) -> DataFrame:
    return stencil.global_threshold(fx.grid_events(spark, d), "f", 80).filter("f > 20").select("y", "x")


PEAK = """{n} as (select a.y, a.x, max(a.f) as f, count(b.f) = {k} * {k} and (max(a.f) = min(b.f) or max(a.f) = max(b.f)) as p
  from grid_events a join grid_events b on b.y between a.y - {h} and a.y + {h} and b.x between a.x - {h} and a.x + {h} group by a.y, a.x)"""


@query("n04_peaks", fx.with_sql(E, PEAK.format(n="p3", k=3, h=1), then="select y, x, coalesce(p, false) as peak from p3"))
def n04(spark: SparkSession, d: str) -> DataFrame:
    return stencil.peaks(fx.grid_events(spark, d), "f", 3, "peak").select("y", "x", "peak")


@query("n05_contextual_median", fx.with_sql(E, PEAK.format(n="p3", k=3, h=1), PEAK.format(n="p5", k=5, h=2), """m as (
  select a.y, a.x, median(b.f) as m from grid_events a join grid_events b on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by a.y, a.x)""",
    then="""select y, x, round(case when p3.p and not coalesce(p5.p, false) then m else p3.f end, 5) as f from p3 join p5 using (y, x) join m using (y, x)"""))
def n05(spark: SparkSession, d: str) -> DataFrame:
    return stencil.contextual_median(fx.grid_events(spark, d), "f").select("y", "x", r("f"))


@query("n06_iterated_median")
def n06(spark: SparkSession, d: str) -> DataFrame:
    return stencil.iterated_median(fx.grid_events(spark, d), "f", target=0.01).select("y", "x", r("f"))


@query("n07_sobel", fx.with_sql(E, """t as (
  select a.y, a.x, a.lat, i.k as dy, j.k as dx, b.f from grid_events a cross join (values (-1), (0), (1)) as i(k) cross join (values (-1), (0), (1)) as j(k)
  left join grid_events b on b.y = least(greatest(a.y + i.k, 0), (select max(y) from grid_events)) and b.x = least(greatest(a.x + j.k, 0), 99))""",
    then="""select y, x, case when count(f) = 9 then round(sqrt(pow(sum(f * dx * (2 - abs(dy))), 2) + pow(sum(f * dy * (2 - abs(dx))), 2)) * cos(radians(max(lat))), 4) end as sobel
from t group by y, x"""))
def n07(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sobel(fx.grid_events(spark, d), "f").select("y", "x", r("sobel", 4))


@query("n08_buffered", fx.with_sql(E, then="""
select y, x from grid_events a where f is not null and not exists (
  select 1 from grid_events b where b.f is null and (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 4)"""))
def n08(spark: SparkSession, d: str) -> DataFrame:
    return stencil.buffered(fx.grid_events(spark, d), "f", 2).select("y", "x")


_Z = NormalDist().inv_cdf(0.875)


@query("n09_confidence_band", fx.with_sql(E, """w as (
  select a.y, a.x, max(a.f) as f, avg(b.f) as m, stddev_pop(b.f) as s from grid_events a join grid_events b
  on b.y between a.y - 3 and a.y + 2 and b.x between a.x - 3 and a.x + 2 group by a.y, a.x)""", then=f"select y, x, f from w where f < m - {_Z!r} * s or f > m + {_Z!r} * s"))
def n09(spark: SparkSession, d: str) -> DataFrame:
    return stencil.outside_band(fx.grid_events(spark, d), "f", 6, 0.75).filter("f is not null").select("y", "x", "f")


@query("n10_percentile_band", fx.with_sql(E, """w as (
  select a.y, a.x, max(a.f) as f, quantile_cont(b.f, 0.125) as lo, quantile_cont(b.f, 0.875) as hi from grid_events a join grid_events b
  on b.y between a.y - 3 and a.y + 2 and b.x between a.x - 3 and a.x + 2 group by a.y, a.x)""", then="select y, x, f from w where f < lo or f > hi"))
def n10(spark: SparkSession, d: str) -> DataFrame:
    return stencil.outside_percentiles(fx.grid_events(spark, d), "f", 6, 75, tile=50).filter("f is not null").select("y", "x", "f")


MIRROR = "case when {c} < 0 then -1 - ({c}) when {c} >= {n} then 2 * {n} - 1 - ({c}) else {c} end"


@query("n11_median_filter", fx.with_sql(E, fx.STEP_COUNTS, """c as (select y, x, case when (y * 7 + x) % 5 = 0 then null else n end as n from step_counts)""", f"""t as (
  select a.y, a.x, coalesce(c.n, 0) as v, c.n from c a, (values (-1), (0), (1)) as i(k), (values (-1), (0), (1)) as j(k), c
  where c.y = {MIRROR.format(c='a.y + i.k', n='(select max(y) + 1 from c)')} and c.x = {MIRROR.format(c='a.x + j.k', n=100)})""",
    then="select y, x, case when 2 * count(n) >= 9 then median(v)::double end as n from t group by y, x"))
def n11(spark: SparkSession, d: str) -> DataFrame:
    c = fx.step_counts(spark, d).withColumn("n", F.expr("case when (y * 7 + x) % 5 = 0 then null else n end"))
    return stencil.median_filter(c, "n", 3, size(c), 100).select("y", "x", F.col("n").cast("double").alias("n"))


@query("n13_central_gradient", fx.with_sql(E, shifted("grid_events", "f"), then="select y, x, round(sqrt(pow((r - l) / 2, 2) + pow((d - u) / 2, 2)), 5) as grad from s where f is not null and l + r + u + d is not null"))
def n13(spark: SparkSession, d: str) -> DataFrame:
    return stencil.central_gradient(fx.grid_events(spark, d), "f").filter("grad is not null").select("y", "x", r("grad"))


GRAD = """g as (select y, x, case when x = 0 then r - f when x = 99 then f - l else (r - l) / 2 end as gx,
  case when y = 0 then d - f when y = (select max(y) from s) then f - u else (d - u) / 2 end as gy from s)"""


@query("n14_gradient", fx.with_sql(O, shifted("grid_orders", "u", offsets=((0, -1), (0, 1), (-1, 0), (1, 0))).replace("n2.u as u", "n2.u as up").replace("n0.u as l", "n0.u as l"), GRAD.replace("r - f", "r - u").replace("f - l", "u - l").replace("d - f", "d - u").replace("f - u", "u - up").replace("(d - u) / 2", "(d - up) / 2"),
    then="select y, x, round(gx, 7) as gx, round(gy, 7) as gy, round(sqrt(gx * gx + gy * gy), 5) as magnitude from g"))
def n14(spark: SparkSession, d: str) -> DataFrame:
    return stencil.gradient(fx.grid_orders(spark, d), "u").select("y", "x", r("gx", 7), r("gy", 7), r("magnitude"))


@query("n15_edge_mask", fx.with_sql(O, shifted("grid_orders", "g").replace("n2.g as u", "n2.g as up"), then="""
select y, x from s where case when x = 0 then r - g when x = 99 then g - l else (r - l) / 2 end >= 200000"""))
def n15(spark: SparkSession, d: str) -> DataFrame:
    return stencil.gradient(fx.grid_orders(spark, d), "g").filter("gx >= 200000").select("y", "x")


@query("n16_masked_laplacian", fx.with_sql(O, shifted("grid_orders", "g").replace("n2.g as u", "n2.g as up"), then="""
select y, x, round(case when x = 0 then r - g when x = 99 then l - g when y = 0 then d - g when y = (select max(y) from s) then up - g
  else l + r - 2 * g + (x % 2) * (up + d - 2 * g) end, 4) as rhs from s"""))
def n16(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_orders(spark, d).withColumn("mask", (F.col("x") % 2).cast("double"))
    return stencil.masked_laplacian(g, "g", "mask").select("y", "x", r("rhs", 4))


@query("n18_pixel_geometry", fx.with_sql(E, """c as (select grid_id, y, x, lat + 0.01 * x as lat, lon - 0.02 * y as lon from grid_events)""",
    shifted("c", "lat").replace("n0.lat as l", "n0.lat as l, n0.lon as ll").replace("n1.lat as r", "n1.lat as r, n1.lon as lr").replace("n2.lat as u", "n2.lat as u, n2.lon as lu").replace("n3.lat as d", "n3.lat as d, n3.lon as ld"),
    then="""select y, x, round(sqrt(pow((lr - ll) / 2 * cos(radians(lat)) * 111, 2) + pow((r - l) / 2 * 111, 2)), 4) as dist_x,
  round(sqrt(pow((ld - lu) / 2 * cos(radians(lat)) * 111, 2) + pow((d - u) / 2 * 111, 2)), 4) as dist_y from s where l + r + u + d is not null"""))
def n18(spark: SparkSession, d: str) -> DataFrame:
    c = fx.grid_events(spark, d).withColumns({"lat": F.col("lat") + 0.01 * F.col("x"), "lon": F.col("lon") - 0.02 * F.col("y")})
    return stencil.pixel_geometry(c).filter("dist_x is not null and dist_y is not null").select("y", "x", r("dist_x", 4), r("dist_y", 4))


@query("n19_geographic_gradient", fx.with_sql(E, shifted("grid_events", "f").replace("n0.f as l", "n0.f as l, n0.lon as ll").replace("n1.f as r", "n1.f as r, n1.lon as lr").replace("n2.f as u", "n2.f as u, n2.lat as lu").replace("n3.f as d", "n3.f as d, n3.lat as ld"),
    then="""select y, x, round((r - l) / ((lr - ll) * cos(radians(lat)) * 111), 5) as g_east, round((d - u) / ((ld - lu) * 111), 5) as g_north from s where l + r + u + d is not null"""))
def n19(spark: SparkSession, d: str) -> DataFrame:
    return stencil.geographic_gradient(fx.grid_events(spark, d), "f").filter("g_east is not null").select("y", "x", r("g_east"), r("g_north"))


#: Bands of 40 rows whose axes are skewed each in its way: both, the second from north, the first from east.
SKEW = {0: (0.04, -0.03), 1: (0.0, 0.05), 2: (0.05, 0.0)}
SKEWED = "skewed as (select cast(y // 40 as int) as grid_id, y, x, f, " + ", ".join(
    f"{a}::double + 0.1::double * {b} + case (y // 40) % 3 " + " ".join(f"when {k} then {s[j]}::double" for k, s in SKEW.items()) + f" end * {c} as {n}" for a, b, c, j, n in ((-40, "y", "x", 0, "lat"), (-170, "x", "y", 1, "lon"))
) + " from grid_events)"


@query("n19_skewed_gradient", fx.with_sql(E, SKEWED, """t as (
  select grid_id, y, x, (lead(f) over h - lag(f) over h) / 2 as ga, (lead(f) over v - lag(f) over v) / 2 as gb, (lead(lon) over h - lag(lon) over h) / 2 * 111 * cos(radians(lat)) as ae,
    (lead(lat) over h - lag(lat) over h) / 2 * 111 as an, (lead(lon) over v - lag(lon) over v) / 2 * 111 * cos(radians(lat)) as be, (lead(lat) over v - lag(lat) over v) / 2 * 111 as bn
  from skewed window h as (partition by grid_id, y order by x), v as (partition by grid_id, x order by y))""", then="""
select grid_id, y, x, round((ga * bn - gb * an) / (ae * bn - an * be), 5) as g_east, round((ae * gb - be * ga) / (ae * bn - an * be), 5) as g_north from t where ga + gb is not null"""))
def n19_skewed(spark: SparkSession, d: str) -> DataFrame:
    band = F.expr("cast(y div 40 as int)")
    skew = lambda j: F.element_at(F.array(*[F.lit(SKEW[k][j]) for k in SKEW]), band % 3 + 1)
    g = fx.grid_events(spark, d).withColumns({"grid_id": band, "lat": F.lit(-40.0) + 0.1 * F.col("y") + skew(0) * F.col("x"), "lon": F.lit(-170.0) + 0.1 * F.col("x") + skew(1) * F.col("y")})
    return stencil.geographic_gradient(g, "f").filter("g_east is not null").select("grid_id", "y", "x", r("g_east"), r("g_north"))


UV = shifted("grid_orders", "u", "su").replace("n0.u as l", "n0.u as ul, n0.v as vl").replace("n1.u as r", "n1.u as ur, n1.v as vr").replace("n2.u as u", "n2.u as uu, n2.v as vu").replace("n3.u as d", "n3.u as ud, n3.v as vd")


@query("n20_kinematics", fx.with_sql(O, UV, "k as (select y, x, (ur - ul) / 2 as ux, (ud - uu) / 2 as uy, (vr - vl) / 2 as vx, (vd - vu) / 2 as vy from su)", then="""
select y, x, round(vx - uy, 7) as vorticity, round(ux + vy, 7) as divergence, round(sqrt(pow(ux - vy, 2) + pow(vx + uy, 2)), 4) as strain,
  round(pow(ux - vy, 2) + pow(vx + uy, 2) - pow(vx - uy, 2), 3) as okubo_weiss from k where ux + uy + vx + vy is not null"""))
def n20(spark: SparkSession, d: str) -> DataFrame:
    k = stencil.kinematics(fx.grid_orders(spark, d)).filter("ux + uy + vx + vy is not null")
    return k.select("y", "x", r("vorticity", 7), r("divergence", 7), r("strain", 4), r("okubo_weiss", 3))


@query("n20_frontogenesis", fx.with_sql(O, UV.replace("ul, n0.v as vl", "ul, n0.v as vl, n0.g as gl").replace("ur, n1.v as vr", "ur, n1.v as vr, n1.g as gr").replace("uu, n2.v as vu", "uu, n2.v as vu, n2.g as gu").replace("ud, n3.v as vd", "ud, n3.v as vd, n3.g as gd"),
    "k as (select y, x, (ur - ul) / 2 as ux, (ud - uu) / 2 as uy, (vr - vl) / 2 as vx, (vd - vu) / 2 as vy, (gr - gl) / 2 as bx, (gd - gu) / 2 as b_y from su)", then="""
select y, x, round((bx * bx + b_y * b_y) / 1e6, 3) as grad2, round(-(bx * bx * ux + b_y * b_y * vy + bx * b_y * (vx + uy)) / 1e9, 3) as frontogenesis from k where ux + uy + vx + vy + bx + b_y is not null"""))
def n20b(spark: SparkSession, d: str) -> DataFrame:
    return stencil.frontogenesis(stencil.kinematics(fx.grid_orders(spark, d)), "g").filter("frontogenesis is not null").select("y", "x", F.round(F.col("grad2") / 1e6, 3).alias("grad2"), F.round(F.col("frontogenesis") / 1e9, 3).alias("frontogenesis"))


_AT = "left join {v} n{i} on n{i}.y = a.y + ({dy}) and n{i}.x = a.x + ({dx})"
_SIDES = lambda v: " ".join(_AT.format(v=v, i=i, dy=dy, dx=dx) for i, (dy, dx) in enumerate(((0, -1), (0, 1), (-1, 0), (1, 0))))
_F = "(2 * 7.2921e-5 * sin(radians(-40 + 0.1 * a.y)))"
_TENDENCY = "-(bx * bx * {u}x + b_y * b_y * {v}y + bx * b_y * ({v}x + {u}y)) / 1e9"


@query("n20_frontogenesis_parts", fx.with_sql(O, f"""flow as (select a.y, a.x, a.g, a.u, a.v, -9.81 * (n3.v - n2.v) / 2 * 1e-6 / {_F} as p, 9.81 * (n1.v - n0.v) / 2 * 1e-6 / {_F} as q from grid_orders a {_SIDES('grid_orders')})""",
    "d as (select a.y, a.x, " + ", ".join(f"(n1.{c} - n0.{c}) / 2 as {c}x, (n3.{c} - n2.{c}) / 2 as {c}y" for c in "uvpq") + f", (n1.g - n0.g) / 2 as bx, (n3.g - n2.g) / 2 as b_y from flow a {_SIDES('flow')})", then=f"""
select y, x, round({_TENDENCY.format(u='u', v='v')}, 3) as whole, round({_TENDENCY.format(u='p', v='q')}, 3) as geo, round({_TENDENCY.format(u='u', v='v')} - {_TENDENCY.format(u='p', v='q')}, 3) as ageo
from d where ux + uy + vx + vy + px + py + qx + qy + bx + b_y is not null"""))
def n20c(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_orders(spark, d).withColumns({"lat": F.expr("cast(-40 + 0.1 * y as double)"), "eta": F.col("v")})
    # beside the equator the balanced part is infinite or none; the whole is there all the same
    got = stencil.frontogenesis_parts(g, "g", "eta", null_on_equator=False, metres=1e-6, per=1e9).filter("frontogenesis is not null and frontogenesis_geo is not null")
    # rounded as a whole number of thousandths, as in SQL: beyond 1e12 the two ways differ by a last bit
    part = lambda c: F.round(F.col(c) * 1000) / 1000
    return got.select("y", "x", part("frontogenesis").alias("whole"), part("frontogenesis_geo").alias("geo"), part("frontogenesis_ageo").alias("ageo"))


@query("n21_seam", fx.with_sql(E, "c as (select grid_id, y, x, lat + case when y >= 50 then 20 else 0 end as lat, lon from grid_events)", then="""
select y, x from c a where not exists (select 1 from c b where b.x = a.x and abs(b.y - a.y) = 1 and (abs(a.lat - b.lat) > 5 or abs(a.lon - b.lon) > 90))"""))
def n21(spark: SparkSession, d: str) -> DataFrame:
    return stencil.seam(fx.grid_events(spark, d).withColumn("lat", F.col("lat") + F.when(F.col("y") >= 50, 20).otherwise(0))).select("y", "x")


@query("n22_detrended", fx.with_sql(E, """s as (select y // 20 as ty, x // 20 as tx, avg(x) as mx, avg(y) as my, avg(f) as mv, var_pop(x) as xx, var_pop(y) as yy, covar_pop(x, y) as xy,
  covar_pop(x, f) as xv, covar_pop(y, f) as yv from grid_events where f is not null group by 1, 2)""", then="""
select e.y, e.x, round(f - case when xx * yy - xy * xy > 0 then mv + (xv * yy - yv * xy) / (xx * yy - xy * xy) * (e.x - mx) + (yv * xx - xv * xy) / (xx * yy - xy * xy) * (e.y - my) else mv end, 4) as f
from grid_events e join s on e.y // 20 = ty and e.x // 20 = tx"""))
def n22(spark: SparkSession, d: str) -> DataFrame:
    return stencil.detrended(fx.grid_events(spark, d), "f", 20).select("y", "x", r("f", 4))


@query("n23_filled", fx.with_sql(E, """n as (select a.y, a.x, b.f, row_number() over (partition by a.y, a.x order by (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x), b.y, b.x) as k
  from grid_events a join grid_events b on b.y between a.y - 3 and a.y + 3 and b.x between a.x - 3 and a.x + 3 where a.f is null and b.f is not null)""",
    then="select e.y, e.x, coalesce(e.f, n.f) as f from grid_events e left join n on n.y = e.y and n.x = e.x and k = 1"))
def n23(spark: SparkSession, d: str) -> DataFrame:
    return stencil.filled(fx.grid_events(spark, d), "f").select("y", "x", "f")


@query("n24_destriped")
def n24(spark: SparkSession, d: str) -> DataFrame:
    return archive.destriped(fx.images(spark, d), "f", 20, 20, 50.0).select("image_id", "y", "x", r("clean", 4))


@query("n26_noise_index", fx.with_sql(E, "c as (select y, x, f as a, f * 0.5 + x % 3 as b from grid_events)", """t as (select a - lag(a) over w as da, b - lag(b) over w as db from c window w as (partition by y order by x))""",
    then="select round(100 * (1 - var_pop(db) / var_pop(da)), 4) as nif from t"))
def n26(spark: SparkSession, d: str) -> DataFrame:
    c = fx.grid_events(spark, d).withColumn("b", F.col("f") * 0.5 + F.col("x") % 3)
    return stencil.noise_index(c, "f", "b").select(r("nif", 4))


@query("n27_distortion_index", fx.with_sql(E, then="select round(sum(pow(f * 0.5 + x % 3, 2)) / sum(f * f), 6) as ndf from grid_events"))
def n27(spark: SparkSession, d: str) -> DataFrame:
    return stencil.distortion_index(fx.grid_events(spark, d).withColumn("b", F.col("f") * 0.5 + F.col("x") % 3), "f", "b").select(r("ndf", 6))


@query("n28_strided", fx.with_sql(E, then="select y, x, f from grid_events where y % 3 = 0 and x % 3 = 0"))
def n28(spark: SparkSession, d: str) -> DataFrame:
    return stencil.strided(fx.grid_events(spark, d), 3).select("y", "x", "f")


@query("n29_block_mean", fx.with_sql(E, then="select (y // 8)::int as y, (x // 8)::int as x, round(avg(f), 5) as f from grid_events where y < (select (max(y) + 1) // 8 * 8 from grid_events) and x < 96 group by 1, 2"))
def n29(spark: SparkSession, d: str) -> DataFrame:
    g = fx.grid_events(spark, d)
    return stencil.block_mean(g, "f", 8, size(g), 100).select("y", "x", r("f"))


@query("n30_block_max", fx.with_sql(E, then="select distinct (y // 4)::int as y, (x // 4)::int as x from grid_events where f > 60"))
def n30(spark: SparkSession, d: str) -> DataFrame:
    return stencil.block_max(fx.grid_events(spark, d).filter("f > 60"), 4).select("y", "x")


@query("n31_resized", fx.with_sql(fx.CUTOUTS, """w as (select uid, ty, tx, f, (least(y + 1, (ty + 1) * 1.6) - greatest(y, ty * 1.6)) * (least(x + 1, (tx + 1) * 1.6) - greatest(x, tx * 1.6)) as w
  from cutouts, range(0, 5) as a(ty), range(0, 5) as b(tx) where ty * 1.6 < y + 1 and (ty + 1) * 1.6 > y and tx * 1.6 < x + 1 and (tx + 1) * 1.6 > x)""",
    then="select uid, ty::int as y, tx::int as x, round(sum(w * f) / sum(w), 5) + 0.0 as f from w group by uid, ty, tx"))
def n31(spark: SparkSession, d: str) -> DataFrame:
    return stencil.resized(fx.cutouts(spark, d), "f", 8, 5).select("uid", "y", "x", (F.round("f", 5) + 0.0).alias("f"))


_G = [math.exp(-k * k / 2) for k in range(-3, 4)]


@query("n32_preprocessed", fx.with_sql(E, "g(k, w) as (values " + ", ".join(f"({k - 3}, {w!r})" for k, w in enumerate(_G)) + ")", """m as (select y, x, f - (select avg(f) from grid_events) as f from grid_events)""", """s as (
  select a.y, a.x, sum(b.f * i.w * j.w) / sum(i.w * j.w) as f from m a, g i, g j, m b where b.y = a.y + i.k and b.x = a.x + j.k and b.f is not null group by a.y, a.x)""",
    then="select y, x, round(f, 5) as f from s"))
def n32(spark: SparkSession, d: str) -> DataFrame:
    return stencil.smoothed(stencil.demeaned(fx.grid_events(spark, d), "f"), "f", 1.0).filter("f is not null").select("y", "x", r("f"))


@query("n33_buoyancy_gradient", fx.with_sql(O, """b as (select y, x, grid_id, 0.0098 * (1025.0 * (1 - 2e-4 * (u / 10 - 10) + 7.4e-4 * (v / 10 - 35))) / 1025.0 as b from grid_orders)""",
    shifted("b", "b"), then="select y, x, round(1e9 * (pow((r - l) / 2, 2) + pow((d - u) / 2, 2)), 4) as b2 from s where l + r + u + d is not null"))
def n33(spark: SparkSession, d: str) -> DataFrame:
    b = fx.grid_orders(spark, d).withColumn("b", buoyancy(density(F.col("u") / 10, F.col("v") / 10)))
    g = stencil.central_gradient(b, "b").filter("grad is not null")
    return g.select("y", "x", F.round(F.col("grad") * F.col("grad") * 1e9, 4).alias("b2"))


@query("n12_median_keeps_missing", fx.with_sql(E, """m as (select a.y, a.x, case when max(a.f) is not null then median(b.f) end as f from grid_events a join grid_events b
  on b.y between a.y - 1 and a.y + 1 and b.x between a.x - 1 and a.x + 1 group by a.y, a.x)""", then="select y, x, round(f, 6) as f from m"))
def n12(spark: SparkSession, d: str) -> DataFrame:
    return stencil.median_of_present(fx.grid_events(spark, d), "f", 3).select("y", "x", r("f", 6))


@query("n17_counts_sobel", fx.with_sql(E, fx.STEP_COUNTS, """t as (select a.y, a.x, j.k as dx, i.k as dy, b.n from step_counts a, (values (-1), (0), (1)) as i(k), (values (-1), (0), (1)) as j(k), step_counts b
  where b.y = a.y + i.k and b.x = a.x + j.k)""", then="""select y, x, sum(n * dx * (2 - abs(dy))) / 8 as gx, sum(n * dy * (2 - abs(dx))) / 8 as gy from t group by y, x having count(n) = 9"""))
def n17(spark: SparkSession, d: str) -> DataFrame:
    return stencil.sobel_of_present(fx.step_counts(spark, d), "n").filter("gx is not null and gy is not null").select("y", "x", "gx", "gy")


@query("n25_corrected_gradients")
def n25(spark: SparkSession, d: str) -> DataFrame:
    clean = archive.destriped(fx.images(spark, d), "f", 20, 20, 50.0).withColumnRenamed("image_id", "grid_id")
    return stencil.gradient(clean, "clean").select("grid_id", "y", "x", r("gx", 4), r("gy", 4))
