"""Nearest-neighbour joins: in space, in space and time, in time, and by value. All go by buckets, none by a cross join of tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.ocean import EARTH_KM, haversine_km
from tidegrid.operators.components import checkpointed
from tidegrid.operators.ranking import numbered_rows


def _around(*cols: str) -> list[Column]:
    """Bucket columns shifted by -1, 0 and 1 each: one struct a neighbour bucket."""
    out = [[]]
    for c in cols:
        out = [[*row, (F.col(c) + k).alias(c)] for row in out for k in (-1, 0, 1)]
    return [F.struct(*row) for row in out]


def within_degrees(points: DataFrame, others: DataFrame, degrees: float, suffix: str = "_o") -> DataFrame:
    """Pairs of points whose lat and lon both differ by at most `degrees`, in the plane of degrees: an equi-join on square buckets and
    their neighbours. Longitudes are not wrapped; on the sphere see within_arc."""
    names = {c: c + suffix for c in others.columns}
    cut = {"_by": F.floor(F.col("lat") / degrees).cast("long"), "_bx": F.floor(F.col("lon") / degrees).cast("long")}
    mine = points.withColumns(cut)
    near = mine.select(*points.columns, F.explode(F.array(*_around("_by", "_bx"))).alias("_b")).select(*points.columns, "_b.*")
    far = others.withColumns(cut).withColumnsRenamed(names)
    ok = (F.abs(F.col("lat") - F.col("lat" + suffix)) <= degrees) & (F.abs(F.col("lon") - F.col("lon" + suffix)) <= degrees)
    return near.join(far, ["_by", "_bx"]).filter(ok).drop("_by", "_bx")


def _best_cell(pairs: DataFrame, key: str) -> DataFrame:
    best = pairs.groupBy(key).agg(F.min_by(F.struct("grid_id_o", "y_o", "x_o", "d2"), F.struct("d2", "grid_id_o", "y_o", "x_o")).alias("b"))
    return best.select(key, F.col("b.grid_id_o").alias("grid_id"), F.col("b.y_o").alias("y"), F.col("b.x_o").alias("x"), F.col("b.d2").alias("d2"))


def _pyramid(cells: DataFrame, degrees: float, levels: int) -> list[DataFrame]:
    """Boxes around the cells of squares of `degrees`, and of twice that, and so on: (up, by, bx, s, n, w, e), up the square above."""
    size, out = degrees, []
    squares = cells.groupBy(F.floor(F.col("lat") / size).cast("long").alias("by"), F.floor(F.col("lon") / size).cast("long").alias("bx")).agg(
        F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e")
    )
    for k in range(levels):
        above = F.struct(F.floor(F.col("by") / 2).cast("long").alias("by"), F.floor(F.col("bx") / 2).cast("long").alias("bx"))
        # all squares of the last level stand below one place
        out.append(checkpointed(squares.withColumn("up", above if k < levels - 1 else F.struct(F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("bx")))))
        squares = out[-1].groupBy(F.col("up.by").alias("by"), F.col("up.bx").alias("bx")).agg(F.min("s").alias("s"), F.max("n").alias("n"), F.min("w").alias("w"), F.max("e").alias("e"))
    return out


#: Boxes of one level that may be broadcast: some 50 bytes each.
BOXES = 100_000


def _far_cell(points: DataFrame, cells: DataFrame, key: str, degrees: float = 2.0, levels: int = 8) -> DataFrame:
    """The nearest cell at any distance, from the top of a pyramid of boxes down: each level is an equi-join of what a point still
    asks for with the boxes below it, and only those stay that may hold a nearer cell than the farthest corner of the box where that
    is nearest. The last level's boxes are joined with their cells."""
    cut = {"_by": F.floor(F.col("lat") / degrees).cast("long"), "_bx": F.floor(F.col("lon") / degrees).cast("long")}
    lat, lon = F.col("lat"), F.col("lon")
    least = F.pow(F.greatest(F.col("s") - lat, lat - F.col("n"), F.lit(0.0)), 2) + F.pow(F.greatest(F.col("w") - lon, lon - F.col("e"), F.lit(0.0)), 2)
    most = F.pow(F.greatest(F.abs(lat - F.col("s")), F.abs(lat - F.col("n"))), 2) + F.pow(F.greatest(F.abs(lon - F.col("w")), F.abs(lon - F.col("e"))), 2)
    asked = points.select(key, "lat", "lon", F.struct(F.lit(0).cast("long").alias("by"), F.lit(0).cast("long").alias("bx")).alias("up"))
    for boxes in reversed(_pyramid(cells, degrees, levels)):
        small = boxes.limit(BOXES + 1).count() <= BOXES
        both = asked.join(F.broadcast(boxes) if small else boxes, "up").select(key, "lat", "lon", F.struct("by", "bx").alias("up"), least.alias("_least"), most.alias("_most"))
        both = checkpointed(both)
        bound = both.groupBy(key).agg(F.min("_most").alias("_bound"))
        asked = checkpointed(both.join(bound, key).filter(F.col("_least") <= F.col("_bound")).select(key, "lat", "lon", "up"))
    names = {c: c + "_o" for c in ("grid_id", "y", "x", "lat", "lon")}
    pairs = asked.select(key, "lat", "lon", F.col("up.by").alias("_by"), F.col("up.bx").alias("_bx")).join(cells.withColumns(cut).withColumnsRenamed(names), ["_by", "_bx"])
    return _best_cell(pairs.withColumn("d2", F.pow(lat - F.col("lat_o"), 2) + F.pow(lon - F.col("lon_o"), 2)), key)


def nearest_cell(points: DataFrame, cells: DataFrame, key: str, start_degrees: float = 1.0, rounds: int = 3) -> DataFrame:
    """Per point the cell of least squared distance in degrees, the first in raster order at ties, however far it is.

    A cell found within r degrees is the nearest if it is within r; points without one go on with twice the radius, and those left
    after `rounds` of that look for it down a pyramid of boxes."""
    cells = cells.select("grid_id", "y", "x", "lat", "lon")
    todo, out = points, None
    r = start_degrees
    for _ in range(rounds):
        pairs = within_degrees(todo, cells, r)
        d2 = F.pow(F.col("lat") - F.col("lat_o"), 2) + F.pow(F.col("lon") - F.col("lon_o"), 2)
        got = checkpointed(_best_cell(pairs.withColumn("d2", d2).filter(F.col("d2") <= r * r), key))
        out = got if out is None else out.unionByName(got)
        todo = checkpointed(todo.join(got.select(key), key, "left_anti"))
        if todo.isEmpty():
            return out
        r *= 2
    return out.unionByName(_far_cell(todo, cells, key))


def cropped_around(points: DataFrame, cells: DataFrame, key: str, height: int, width: int, **kw) -> DataFrame:
    """The height x width cells around each point's nearest cell, which stands at (height // 2, width // 2) of them: (key, grid_id, y,
    x, row, col), less what lies outside the grid."""
    at = nearest_cell(points, cells, key, **kw)
    rows, cols = (F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c) for n, c in ((height, "row"), (width, "col")))
    want = at.select(key, "grid_id", F.col("y").alias("cy"), F.col("x").alias("cx"), rows).select("*", cols)
    placed = want.select(key, "grid_id", (F.col("cy") + F.col("row") - height // 2).alias("y"), (F.col("cx") + F.col("col") - width // 2).alias("x"), "row", "col")
    return placed.join(cells, ["grid_id", "y", "x"])


def _reach(c: Column, by: float) -> Column:
    """The slots of twice the width `by` that a value meets with everything within `by` of it: one or two."""
    slack = by * 1e-6
    return F.sequence(F.floor((c - by - slack) / (2 * by)), F.floor((c + by + slack) / (2 * by)))


def within_arc(points: DataFrame, others: DataFrame, degrees: float, within: float, time: str = "t", suffix: str = "_o") -> DataFrame:
    """Pairs of points less than `within` apart in time and at most `degrees` of a great circle apart, with arc, the degrees between them.

    Points are unit vectors in cubes of twice the chord of that arc, and in slots of twice the time: one meets at most two cubes an axis
    and two slots, an equi-join that knows no edge at the date line and no narrowing towards the poles. Cubes and slots only
    propose; the haversine decides. Rows without a place or a time meet nothing."""
    chord = 2 * math.sin(math.radians(min(degrees, 180.0)) / 2) or 1e-12
    phi, lam = F.radians("lat"), F.radians("lon")
    vector = {"_x": F.cos(phi) * F.cos(lam), "_y": F.cos(phi) * F.sin(lam), "_z": F.sin(phi), "_t": F.col(time).cast("double")}
    sizes = {"_x": chord, "_y": chord, "_z": chord, "_t": within}
    near = points.withColumns(vector)
    for c, by in sizes.items():
        near = near.withColumn(c, F.explode(_reach(F.col(c), by)))
    far = others.withColumns(vector).withColumns({c: F.floor(F.col(c) / (2 * by)) for c, by in sizes.items()}).withColumnsRenamed({c: c + suffix for c in others.columns})
    pairs = near.join(far, list(sizes)).drop(*sizes).filter(F.abs(F.col(time) - F.col(time + suffix)) < within)
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat" + suffix), F.col("lon" + suffix))
    return pairs.withColumn("arc", F.degrees(km / EARTH_KM)).filter(F.col("arc") <= degrees)


def nearest_in_space_time(left: DataFrame, right: DataFrame, days: float, degrees: float, time: str = "t", key: str = "uid") -> DataFrame:
    """Per row of left the nearest row of right (on the sphere, the least key at ties) less than `days` away in time and within
    `degrees`: (key, key_o, degrees). Rows of right at one place and time are one candidate, the one of least key."""
    one = right.groupBy("lat", "lon", time).agg(F.min(key).alias(key))
    near = within_arc(left.select(key, "lat", "lon", time), one, degrees, days, time)
    best = near.groupBy(key).agg(F.min_by(F.struct(f"{key}_o", "arc"), F.struct("arc", f"{key}_o")).alias("b"))
    return best.select(key, F.col(f"b.{key}_o").alias(f"{key}_o"), F.col("b.arc").alias("degrees"))


def _beside(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(t, s): each distinct target value with the source values next below (or equal) and next above it.

    Distinct source values are numbered; a target's place among them comes from the union of both in order, and its two neighbours
    from equi-joins on the number."""
    src = checkpointed(numbered_rows(sources.select(F.col("s").cast("double").alias("s")).filter("s is not null").distinct(), "s"))
    both = targets.select(F.col("t").cast("double").alias("s"), F.lit(1).alias("o")).filter("s is not null").distinct().unionByName(src.select("s", F.lit(0).alias("o")))
    # sources sort before targets of the same value, so a target's number less the targets up to it counts sources not after it
    placed = numbered_rows(both, "s", "o", name="n")
    t = numbered_rows(placed.filter("o = 1").select("s", "n"), "s", name="m").select(F.col("s").alias("t"), (F.col("n") - F.col("m")).alias("k"))
    return t.select("t", F.explode(F.array(F.col("k"), F.col("k") + 1)).alias("k")).join(src, "k").select("t", "s")


def nearest_time(targets: DataFrame, sources: DataFrame, time: str = "t", most: float | None = None, best: int | None = None) -> DataFrame:
    """Per distinct target time the source time with the smallest gap, the earlier at ties; with `most`, only gaps up to that, or all
    if there is none; with `best`, only so many of the smallest gaps."""
    near = _beside(targets.select(F.col(time).alias("t")), sources.select(F.col(time).alias("s")))
    gap = F.abs(F.col("t") - F.col("s"))
    out = near.groupBy("t").agg(F.min_by("s", F.struct(gap.alias("g"), "s")).alias("source_t"), F.min(gap).alias("gap"))
    if most is not None:
        out = checkpointed(out)
        close = out.filter(F.col("gap") <= most)
        out = out if close.isEmpty() else close
    return out if best is None else out.orderBy("gap", "t").limit(best)


def nearest_value(draws: DataFrame, table: DataFrame, value: str, key: str) -> DataFrame:
    """Per draw (draw_id, v) the row whose value is closest, however far, the smaller key at ties."""
    near = _beside(draws.select(F.col("v").alias("t")), table.select(F.col(value).alias("s")))
    named = near.join(table.groupBy(F.col(value).cast("double").alias("s")).agg(F.min(key).alias(key)), "s")
    gap = F.abs(F.col("t") - F.col("s"))
    best = named.groupBy("t").agg(F.min_by(key, F.struct(gap.alias("g"), key)).alias(key), F.min(gap).alias("gap"))
    return draws.withColumn("t", F.col("v").cast("double")).join(best, "t").select("draw_id", key, "gap")


def temporal_neighbours(images: DataFrame, window: int, hours: float, key: str = "image_id", time: str = "t") -> DataFrame:
    """Pairs of images at most `window` places apart in time order and at most so many hours: an equi-join on shifted places."""
    placed = numbered_rows(images.select(key, F.col(time).alias("t")), "t", key)
    shift = F.explode(F.array(*[F.lit(s) for s in range(-window, window + 1) if s]))
    mine = placed.select(key, "t", "k", shift.alias("s")).withColumn("k", F.col("k") + F.col("s"))
    other = placed.select(F.col(key).alias("other_id"), F.col("t").alias("other_t"), "k")
    return mine.join(other, "k").filter(F.abs(F.col("t") - F.col("other_t")) <= hours * 3600).select(key, "other_id", (F.col("other_t") - F.col("t")).alias("gap_s"))
