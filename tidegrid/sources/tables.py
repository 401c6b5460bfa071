"""Tables of runs: formats, paths, what is done already, and what has to be there first."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidegrid.operators.components import checkpointed


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """By extension, parquet or csv; other formats raise. The path may be a pattern."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    if path.rstrip("/").endswith((".parquet", ".parquet/*", "*")) or "." not in path.rpartition("/")[2]:
        return spark.read.parquet(path)
    raise ValueError(f"unknown format: {path}")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "error") -> None:
    w = df.write.mode(mode).partitionBy(*partition_by)
    if path.endswith(".csv"):
        w.option("header", True).csv(path)
    elif path.endswith(".parquet"):
        w.parquet(path)
    else:
        raise ValueError(f"unknown format: {path}")


def parsed_name(name: Column) -> Column:
    """(time, tag) of names like prefix_20121109T12_00_00_tag.parquet; nulls where they don't look so."""
    pattern = "_(\\d{8}T\\d{2}_\\d{2}_\\d{2})_([A-Za-z0-9.-]+?)(?:\\.[a-z0-9]+)?$"
    got = lambda k: F.nullif(F.regexp_extract(name, pattern, k), F.lit(""))
    return F.struct(got(1).alias("time"), got(2).alias("tag"))


def snapshot_path(root: str, version: str, time: Column) -> Column:
    return F.concat_ws("/", F.lit(root), F.concat(F.lit("V"), F.lit(version)), F.date_format(time, "yyyyMMdd_HHmmss"))


def not_done(requested: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("version", "snapshot", "config"), clobber: bool = False) -> DataFrame:
    """Requested runs without an output; all of them with clobber."""
    return requested if clobber else requested.join(done.select(*keys).distinct(), list(keys), "left_anti")


def done_runs(spark: SparkSession, path: str, keys: tuple[str, ...] = ("version", "snapshot", "config")) -> DataFrame | None:
    """The runs that have an output under path, a table partitioned by the keys; None if there is no such table yet."""
    try:
        return spark.read.parquet(path).select(*keys).distinct()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def process_runs(requested: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], keys: tuple[str, ...] = ("version", "snapshot", "config"), clobber: bool = False) -> DataFrame:
    """Makes what is requested and has no output yet, all of it with clobber, and returns what was asked of make. Only the partitions that make
    gives rows for are replaced, all at once when the job ends: others stay, and so does everything if it fails."""
    done = None if clobber else done_runs(requested.sparkSession, path, keys)
    todo = requested if done is None else not_done(requested, done, keys)
    todo = checkpointed(todo)
    if not todo.isEmpty():
        make(todo).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    return todo


def missing_inputs(requested: DataFrame, available: DataFrame, keys: tuple[str, ...] = ("snapshot", "field")) -> DataFrame:
    """What is requested and not there. Callers raise if it has rows."""
    return requested.select(*keys).distinct().join(available.select(*keys).distinct(), list(keys), "left_anti")


def by_subset(requested: DataFrame, config: DataFrame, present: DataFrame) -> DataFrame:
    """Requested properties that are not there yet, grouped by the subset that makes them; unknown ones under a null subset."""
    todo = requested.join(present, "property", "left_anti")
    return todo.join(config, "property", "left").groupBy("subset").agg(F.sort_array(F.collect_set("property")).alias("properties"))


def wide_fields(long: DataFrame, names: list[str], stride: int = 1, roll: int = 0, width: int | None = None) -> DataFrame:
    """(grid_id, y, x, field, value) to one column a field, only the named ones read; every stride-th cell, rolled along x."""
    some = long.filter(F.col("field").isin(names))
    if stride > 1:
        some = some.filter((F.col("y") % stride == 0) & (F.col("x") % stride == 0))
    got = some.groupBy("grid_id", "y", "x").pivot("field", names).agg(F.first("value"))
    return got.withColumn("x", F.pmod(F.col("x") + roll, F.lit(width))) if roll and width else got


def run_metadata(cells: DataFrame, labels: DataFrame, fields: list[str], **params: str) -> DataFrame:
    """One row a run: parameters, shape, counts, coordinate ranges, fields; written as JSON beside its data."""
    a = cells.agg(
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count(F.lit(1)).alias("n_cells"),
        F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"), F.min("lon").alias("lon_min"), F.max("lon").alias("lon_max"),
    )
    b = labels.agg(F.count(F.lit(1)).alias("n_label_cells"), F.count_distinct("grid_id", "label").alias("n_labels"))
    return a.crossJoin(F.broadcast(b)).withColumn("fields", F.array(*[F.lit(f) for f in fields])).withColumns({k: F.lit(v) for k, v in params.items()})


def columns_like(df: DataFrame, prefixes: tuple[str, ...] = ("",), suffixes: tuple[str, ...] = ("",), always: tuple[str, ...] = ()) -> DataFrame:
    """The columns that are always kept and those with one of the prefixes and one of the suffixes, in the table's order."""
    return df.select([F.col(f"`{c}`") for c in df.columns if c in always or (c.startswith(prefixes) and c.endswith(suffixes))])


#: Prefixes of columns left out of a choice of properties, and of those kept only when divided by f.
LEFT_OUT = ("gradeta2", "gradrho2", "gradsalt2", "gradtheta2", "rossby_number", "strain_n", "strain_s")
ONLY_OVER_F = ("strain_mag", "relative_vorticity", "divergence")


def selectable(df: DataFrame, key: str = "flabel", left_out: tuple[str, ...] = LEFT_OUT, only_over_f: tuple[str, ...] = ONLY_OVER_F) -> list[str]:
    """Names of the properties to choose from: not the key, none with a prefix left out, and some only as *_over_f."""
    return [c for c in df.columns if c != key and not c.startswith(left_out) and (c.endswith("_over_f") or not c.startswith(only_over_f))]


def short_text(value: Column, kind: str) -> Column:
    """A value as text: doubles with four significant digits, NaN where there is none."""
    text = _four_digits(value) if kind in ("double", "float") else value.cast("string")
    return F.coalesce(text, F.lit("NaN"))


@F.pandas_udf(StringType())
def _four_digits(value: pd.Series) -> pd.Series:
    return value.map(lambda v: "NaN" if v != v else f"{v:.4g}")


def hover(properties: DataFrame, in_view: DataFrame, columns: list[str], label: str = "label") -> DataFrame:
    """(label, hover): a JSON object of the properties of each label in view, numbers as short texts. The label 0 is background."""
    kinds = dict(properties.dtypes)
    seen = in_view.filter(F.col(label) > 0).select(label).distinct()
    some = properties.join(seen, label, "left_semi")
    return some.select(label, F.to_json(F.struct(label, *[short_text(F.col(c), kinds[c]).alias(c) for c in columns if c in kinds])).alias("hover"))


def first_available(df: DataFrame, name: str, suffixes: tuple[str, ...] = ("_median", "_mean", "")) -> Column:
    """The first column of the name with one of the suffixes that the table has, under the bare name."""
    for s in suffixes:
        if name + s in df.columns:
            return F.col(f"`{name + s}`").alias(name)
    raise KeyError(f"no column of {name}")


def write_metadata(metadata: DataFrame, path: str) -> None:
    """The row of a run beside its data, as JSON."""
    metadata.coalesce(1).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def loaded_run(metadata: DataFrame, labels: DataFrame, geometry: DataFrame, colocation: DataFrame, coords: DataFrame | None = None, roll: int = 0) -> DataFrame:
    """A run's results as one table of its labelled cells: label, position, the label's geometry and co-located statistics, rolled
    along x by `roll` columns of the width that the metadata gives. A label without statistics keeps its cells. Positions are those of
    coords; without it the labels have lat and lon themselves, and no grid is joined."""
    per_label = geometry.join(colocation.drop("npix"), ["grid_id", "label"], "left")
    placed = labels if coords is None else labels.join(coords.select("grid_id", "y", "x", "lat", "lon"), ["grid_id", "y", "x"], "left")
    cells = placed.join(per_label, ["grid_id", "label"], "left")
    if not roll:
        return cells
    return cells.crossJoin(F.broadcast(metadata.select("width").limit(1))).withColumn("x", F.pmod(F.col("x") + roll, F.col("width"))).drop("width")
