"""Grids, masks and catalogues laid out of the given tables: the same views as DataFrames and, for the oracle, as SQL text.

Cells are (grid_id, y, x, fields); a missing value is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def grid_events(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").selectExpr(
        "cast(0 as int) as grid_id", "cast(event_id div 100 as int) as y", "cast(event_id % 100 as int) as x",
        "case when event_id % 37 = 0 then null else value end as f",
        "cast(-60 + 0.1 * (event_id div 100) as double) as lat", "cast(-170 + 0.1 * (event_id % 100) as double) as lon", "event_id",
    )


GRID_EVENTS = """grid_events as (
  select cast(0 as int) as grid_id, cast(event_id // 100 as int) as y, cast(event_id % 100 as int) as x,
    case when event_id % 37 = 0 then null else value end as f,
    cast(-60 + 0.1 * (event_id // 100) as double) as lat, cast(-170 + 0.1 * (event_id % 100) as double) as lon, event_id
  from events)"""


def grid_orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").selectExpr(
        "cast(0 as int) as grid_id", "cast(o_orderkey div 100 as int) as y", "cast(o_orderkey % 100 as int) as x",
        "o_totalprice as g", "o_totalprice / 1000 - 50 as u", "cast(o_custkey % 100 - 50 as double) as v",
    )


GRID_ORDERS = """grid_orders as (
  select cast(0 as int) as grid_id, cast(o_orderkey // 100 as int) as y, cast(o_orderkey % 100 as int) as x,
    o_totalprice as g, o_totalprice / 1000 - 50 as u, cast(o_custkey % 100 - 50 as double) as v
  from orders)"""

_MASK = "((event_id * event_id) % 1009 * (event_id % 613 + 7)) % 97 < 38"


def mask_int(spark: SparkSession, d: str) -> DataFrame:
    """A mask over all of the event grid, cut into grids of 40 rows."""
    return grid_events(spark, d).filter(_MASK).selectExpr("cast(y div 40 as int) as grid_id", "y", "x", "event_id")


MASK_INT = f"mask_int as (select cast(y // 40 as int) as grid_id, y, x, event_id from grid_events where {_MASK})"


def label_cells(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").selectExpr(
        "l_orderkey as label", *[f"case when l_partkey % 11 = 0 then null else {c} end as {n}" for n, c in (("p1", "l_quantity"), ("p2", "l_extendedprice"), ("p3", "l_discount"))]
    )


LABEL_CELLS = "label_cells as (select l_orderkey as label, " + ", ".join(
    f"case when l_partkey % 11 = 0 then null else {c} end as {n}" for n, c in (("p1", "l_quantity"), ("p2", "l_extendedprice"), ("p3", "l_discount"))
) + " from lineitem)"


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").selectExpr(
        "vec_id as uid", "cast(((vec_id * 37) % 18000) / 100.0 - 90 as double) as lat", "cast(((vec_id * 91) % 36000) / 100.0 - 180 as double) as lon",
        "cast(vec_id % 6 as int) as month", "vec_id % 7 <> 0 as flag_a", "vec_id % 5 <> 0 as flag_b", "label",
    )


CATALOG = """catalog as (
  select vec_id as uid, cast(((vec_id * 37) % 18000) / 100.0 - 90 as double) as lat, cast(((vec_id * 91) % 36000) / 100.0 - 180 as double) as lon,
    cast(vec_id % 6 as int) as month, vec_id % 7 <> 0 as flag_a, vec_id % 5 <> 0 as flag_b, label
  from embeddings)"""


def cutouts(spark: SparkSession, d: str) -> DataFrame:
    """Cells of 8 x 8 cut-outs."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("uid"), F.posexplode("embedding").alias("pos", "e")).selectExpr(
        "uid", "cast(pos div 8 as int) as y", "cast(pos % 8 as int) as x", "cast(e as double) as f"
    )


CUTOUTS = """cutouts as (
  select vec_id as uid, cast(i // 8 as int) as y, cast(i % 8 as int) as x, cast(embedding[i + 1] as double) as f
  from embeddings, range(0, 64) as t(i))"""


def images(spark: SparkSession, d: str) -> DataFrame:
    """20 x 20 images of an archive."""
    return read(spark, d, "events").selectExpr(
        "event_id div 400 as image_id", "cast((event_id % 400) div 20 as int) as y", "cast(event_id % 20 as int) as x", "value as f", "ts", "event_id"
    )


IMAGES = """images as (
  select event_id // 400 as image_id, cast((event_id % 400) // 20 as int) as y, cast(event_id % 20 as int) as x, value as f, ts, event_id from events)"""


def step_counts(spark: SparkSession, d: str) -> DataFrame:
    return grid_events(spark, d).selectExpr("grid_id", "y", "x", "cast(100 + case when x > 45 + y % 7 then 40 else 0 end + (event_id * 7919) % 5 as int) as n")


STEP_COUNTS = """step_counts as (
  select grid_id, y, x, cast(100 + case when x > 45 + y % 7 then 40 else 0 end + (event_id * 7919) % 5 as int) as n from grid_events)"""


def with_sql(*views: str, then: str) -> str:
    return "with " + ",\n".join(views) + "\n" + then
