"""Statistics of fields by label, and the dilation of labels before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statistics by name; register_stat adds to them.
STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_pop, "median": F.median, "min": F.min, "max": F.max, "count": lambda c: F.count(F.lit(1)),
}


#: Names of statistics that are pandas UDFs, which Spark aggregates apart from built-in ones.
APART: set[str] = set()


def register_stat(name: str, column_of: Callable[[Column], Column], pandas: bool = False) -> None:
    """A statistic of one's own: an aggregate of a column, built in or, with pandas, a grouped-aggregate pandas UDF, which gets all values
    of a label at once."""
    STATS[name] = column_of
    (APART.add if pandas else APART.discard)(name)


def label_statistics(
    cells: DataFrame, fields: list[str], stats: tuple[str, ...] = ("mean", "std", "median"), percentiles: tuple[float, ...] = (), min_size: int = 1,
    keys: tuple[str, ...] = ("label",), nan_policy: str = "omit",
) -> DataFrame:
    """Per label npix and {field}_{stat}, {field}_p{pct}, in one shuffle, and a second one if there are pandas statistics. omit: NaN counts as
    missing; propagate: NaN sorts last."""
    clean = cells if nan_policy == "propagate" else cells.withColumns({f: F.when(~F.isnan(f), F.col(f)) for f in fields})
    out = [F.count(F.lit(1)).alias("npix")]
    for f in fields:
        out += [STATS[s](F.col(f)).alias(f"{f}_{s}") for s in stats if s not in APART]
        if percentiles:
            out.append(F.percentile(f, F.array(*[F.lit(p / 100) for p in percentiles])).alias(f"_{f}"))
    got = clean.groupBy(*keys).agg(*out).filter(F.col("npix") >= min_size)
    if apart := [STATS[s](F.col(f)).alias(f"{f}_{s}") for f in fields for s in stats if s in APART]:
        got = got.join(clean.groupBy(*keys).agg(*apart), list(keys))
    named = {f"{f}_p{p:g}": F.get(f"_{f}", F.lit(k)) for f in fields for k, p in enumerate(percentiles)}
    return got.withColumns(named).drop(*[f"_{f}" for f in fields])


def label_averages(cells: DataFrame, properties: dict[str, str], keys: tuple[str, ...] = ("uid", "label")) -> DataFrame:
    """Per label of a cut-out npix and averages, {name: field}; a name that does not begin with avg raises. A label with a missing
    value has no average of that field; cells of label 0 are background."""
    if wrong := [p for p in properties if not p.startswith("avg")]:
        raise ValueError(f"only averages are known, not {wrong}")
    whole = lambda f: F.when(F.count(f) == F.count(F.lit(1)), F.avg(f))
    return cells.filter(F.col(keys[-1]) > 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("npix"), *[whole(f).alias(p) for p, f in properties.items()])


def painted(labels: DataFrame, per_label: DataFrame, value: str) -> DataFrame:
    """A label's value at each of its cells; null for labels that the table lacks."""
    return labels.select("grid_id", "y", "x", "label").join(per_label.select("grid_id", "label", value), ["grid_id", "label"], "left")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def spread(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each cell at all offsets: (…, y, x) moved, d2 the squared distance."""
    off = F.explode(F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(a * a + b * b).alias("d2")) for a, b in offsets])).alias("_o")
    rest = [c for c in cells.columns if c not in ("y", "x")]
    return cells.select(*rest, "y", "x", off).select(*rest, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x"), F.col("_o.d2").alias("d2"))


def inside(cells: DataFrame, height: int | None, width: int | None) -> DataFrame:
    out = cells.filter("y >= 0 and x >= 0")
    if height is not None:
        out = out.filter((F.col("y") < height) & (F.col("x") < width))
    return out


def dilate_first(labels: DataFrame, radius: int, height: int | None = None, width: int | None = None) -> DataFrame:
    """Every cell within the radius of a label gets the least such label, even over another label's own cells."""
    return inside(spread(labels.select("grid_id", "label", "y", "x"), disk(radius)), height, width).groupBy("grid_id", "y", "x").agg(F.min("label").alias("label"))


def dilate_nearest(labels: DataFrame, radius: int, height: int | None = None, width: int | None = None, min_size: int = 1) -> DataFrame:
    """Cells within the radius get the nearest label (the least at ties); a label's own cells stay, small labels go first."""
    sized = labels.select("grid_id", "label", "y", "x")
    if min_size > 1:
        big = sized.groupBy("grid_id", "label").count().filter(F.col("count") >= min_size).select("grid_id", "label")
        sized = sized.join(big, ["grid_id", "label"], "left_semi")
    return inside(spread(sized, disk(radius)), height, width).groupBy("grid_id", "y", "x").agg(F.min_by("label", F.struct("d2", "label")).alias("label"))


def colocate(
    labels: DataFrame, fields_grid: DataFrame, fields: list[str], radius: int = 0, height: int | None = None, width: int | None = None, min_size: int = 1,
    stats: tuple[str, ...] = ("mean", "std", "median"), **kw,
) -> DataFrame:
    """Fields of a grid by label: dilation, one equi-join on the cell, one aggregation.

    npix, the least size and the statistic "count" are those of the labels as given, before any dilation; only labels of that size
    spread. A label without cells of the grid stays, with null statistics."""
    sized = labels.groupBy("grid_id", "label").agg(F.count(F.lit(1)).alias("npix")).filter(F.col("npix") >= min_size)
    kept = labels.select("grid_id", "label", "y", "x")
    if min_size > 1:
        kept = kept.join(sized.select("grid_id", "label"), ["grid_id", "label"], "left_semi")
    grown = dilate_nearest(kept, radius, height, width) if radius else kept
    found = label_statistics(grown.join(fields_grid, ["grid_id", "y", "x"]), fields, tuple(x for x in stats if x != "count"), keys=("grid_id", "label"), **kw).drop("npix")
    out = sized.join(found, ["grid_id", "label"], "left")
    return out.withColumns({f"{f}_count": F.col("npix") for f in fields}) if "count" in stats else out
