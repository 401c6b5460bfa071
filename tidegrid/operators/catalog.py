"""Catalogues of cut-outs: lookups, checks, flags, splits and training stacks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ocean import normalised
from tidegrid.operators.components import checkpointed
from tidegrid.operators.ranking import numbered_rows


#: Values that hash_order takes.
HASHES = 2147483647


def hash_order(uid: str = "uid", seed: int = 0) -> Column:
    """An order by an arithmetic hash that any engine can compute."""
    return ((F.col(uid) + seed) * 48271) % HASHES


def find_entries(table: DataFrame, **equal) -> DataFrame:
    """Rows that equal all given values; a name that is no column raises."""
    if missing := [k for k in equal if k not in table.columns]:
        raise KeyError(f"no such columns: {missing}")
    out = table
    for k, v in equal.items():
        out = out.filter(F.col(k) == F.lit(v))
    return out


def find_one(table: DataFrame, key: str = "uid", **equal) -> int:
    """The key of the only match, -1 if there is none; several raise."""
    rows = find_entries(table, **equal).select(key).take(2)
    if len(rows) > 1:
        raise ValueError("several rows match")
    return rows[0][0] if rows else -1


def vet(table: DataFrame, required: dict[str, str], allowed: dict[str, list] | None = None, optional: tuple[str, ...] = ()) -> DataFrame:
    """Raises on absent, unknown or wrongly typed columns; returns (field, n_bad): values outside the allowed ones."""
    types = dict(table.dtypes)
    wrong = {k: types.get(k) for k, t in required.items() if types.get(k) != t}
    unknown = set(types) - set(required) - set(optional)
    if wrong or unknown:
        raise ValueError(f"wrong or absent: {wrong}; unknown: {sorted(unknown)}")
    counts = [F.count_if(~F.col(k).isin(v)).alias(k) for k, v in (allowed or {}).items()]
    one = table.agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("n_bad")) for k in (allowed or {})])).alias("r")).select("r.*")


def flag_present(catalog: DataFrame, meta: DataFrame, flag: str, key: str = "uid") -> DataFrame:
    """catalog with a flag: whether meta has the key."""
    return catalog.join(meta.select(key).distinct().withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def matched(left: DataFrame, right: DataFrame, key: str = "uid", required: bool = True) -> DataFrame:
    """Inner join by key; with required, a key of left without a match raises."""
    if required and (n := left.join(right.select(key), key, "left_anti").count()):
        raise ValueError(f"{n} keys have no match")
    return left.join(right, key)


def index_of(meta: DataFrame, arrays: DataFrame, key: str = "uid") -> DataFrame:
    """Array index of each row of meta, -1 where there is none."""
    return meta.join(arrays.select(key, "gidx"), key, "left").withColumn("gidx", F.coalesce("gidx", F.lit(-1)))


def random_split(table: DataFrame, sizes: dict[str, int], key: str = "uid", seed: int = 0) -> DataFrame:
    """Adds split: the first sizes in hash order, the rest is left out. Rows beyond a hash that leaves enough are dropped before any are
    numbered, and numbers come range by range."""
    total, rows = sum(sizes.values()), table.count()
    hashed = table.withColumn("_h", hash_order(key, seed))
    cut = HASHES if total >= rows else math.ceil(HASHES * min(1.0, (total + 6 * math.sqrt(total) + 20) / rows))
    some = hashed.filter(F.col("_h") < cut)
    some = some if cut == HASHES or some.count() >= total else hashed
    out, upto = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        out = F.when((F.col("_n") > upto) & (F.col("_n") <= upto + size), name).otherwise(out)
        upto += size
    return numbered_rows(some, "_h", key, name="_n").filter(F.col("_n") <= total).withColumn("split", out).drop("_h", "_n")


def balanced_sample(table: DataFrame, metric: str, nbins: int, total: int, key: str = "uid", seed: int = 0) -> DataFrame:
    """A draw that is even over bins of a metric: bins with no more rows than an even share give all of theirs, the others
    share what is left evenly, in hash order. The largest value belongs to the last bin."""
    lim = table.agg(F.min(metric).alias("lo"), F.max(metric).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / nbins
    binned = table.crossJoin(F.broadcast(lim)).withColumn(
        "bin", F.when(width > 0, F.least(F.floor((F.col(metric) - F.col("lo")) / width), F.lit(nbins - 1))).otherwise(0).cast("int")
    ).drop("lo", "hi")
    counts = sorted((r.n, r.bin) for r in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect())
    quota, left = {}, total
    for k, (n, b) in enumerate(counts):
        quota[b] = min(n, left // (len(counts) - k))
        left -= quota[b]
    # rows beyond a hash that leaves a bin enough are dropped before any are ranked
    size = dict((b, n) for n, b in counts)
    cut = {b: HASHES if q == size[b] else math.ceil(HASHES * min(1.0, (q + 6 * math.sqrt(q) + 20) / size[b])) for b, q in quota.items()}
    of = lambda m: F.create_map(*[F.lit(v) for kv in m.items() for v in kv])[F.col("bin")]
    if not quota:
        return binned
    got = {r.bin: r.n for r in binned.filter(hash_order(key, seed) < of(cut)).groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = {b: c if got.get(b, 0) >= quota[b] else HASHES for b, c in cut.items()}
    some = binned.filter(hash_order(key, seed) < of(cut))
    rank = F.row_number().over(Window.partitionBy("bin").orderBy(hash_order(key, seed), key))
    return some.withColumn("_r", rank).filter(F.col("_r") <= of(quota)).drop("_r")


#: Days of a catalogue that are broadcast together.
DAYS = 100_000


def generate(points: DataFrame, times: DataFrame, most: int = DAYS) -> DataFrame:
    """Catalogue of every point (lat, lon, ...) at every time (day): uid is a hash of all of these. Up to `most` times, counted, are
    broadcast and points stay where they are; more are numbered and cut into blocks, and points meet them block by block."""
    days = times.withColumnRenamed("day", "datetime")
    if days.limit(most + 1).count() <= most:
        both = points.crossJoin(F.broadcast(days))
    else:
        cut = checkpointed(numbered_rows(days, "datetime").withColumn("_b", F.floor((F.col("k") - 1) / most)).drop("k"))
        blocks = cut.agg(F.max("_b")).first()[0]
        both = points.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks)))).join(cut, "_b").drop("_b")
    return both.withColumn("uid", F.xxhash64("lat", "lon", "datetime"))


def stack(cells: DataFrame, channels: list[str], key: str = "uid") -> DataFrame:
    """Per key an array of channels, each the array of its values in raster order."""
    each = cells.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("y", "x", *channels))).alias("p"))
    return each.select(key, F.array(*[F.col(f"p.{c}") for c in channels]).alias("channels"))


def binary_target(cells: DataFrame, value: str, threshold: float, pct: float, key: str = "uid") -> DataFrame:
    """Adds target: 1 where a value is above the threshold and above its cut-out's percentile."""
    own = F.percentile(value, F.lit(pct / 100)).over(Window.partitionBy(key))
    return cells.withColumn("target", ((F.col(value) > threshold) & (F.col(value) > own)).cast("int"))


def covered_fields(catalog: DataFrame, cells: DataFrame, size: int) -> DataFrame:
    """Cells of the square cut-outs of a catalogue with (row, col) corners: an equi-join on blocks of the cut-out's size, then the
    range; each cut-out meets at most four blocks."""
    step = F.array(F.lit(0), F.lit(1))
    blocks = catalog.select("*", F.explode(step).alias("_dy")).select("*", F.explode(step).alias("_dx")).withColumns(
        {"_by": F.floor(F.col("row") / size) + F.col("_dy"), "_bx": F.floor(F.col("col") / size) + F.col("_dx")}
    )
    of = cells.withColumns({"_by": F.floor(F.col("y") / size), "_bx": F.floor(F.col("x") / size)})
    inside = (F.col("y") >= F.col("row")) & (F.col("y") < F.col("row") + size) & (F.col("x") >= F.col("col")) & (F.col("x") < F.col("col") + size)
    return blocks.join(of, ["_by", "_bx"]).filter(inside).drop("_by", "_bx", "_dy", "_dx")


def index_box(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """(grid_id, y0, y1, x0, x1): rows and columns that enclose all cells of a box of positions, ends exclusive."""
    inside = cells.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))
    return inside.groupBy("grid_id").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def cropped_to(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Cells in the index box of a box of positions, also those whose own position lies off it."""
    box = index_box(cells, lat, lon)
    within = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return cells.join(box, "grid_id").filter(within).select(*cells.columns)


def gathered(cutouts: DataFrame, fields: list[str], uid: int | None = None, missing: str = "skip", key: str = "uid", catalog: DataFrame | None = None) -> DataFrame:
    """(uid, field, y, x, value) to one column a field, of one cut-out or of all. A cut-out without a field has nulls there; with
    missing="raise" that is an error. fnorm_ and afnorm_ before a name divide it by f or |f| at the catalogue's (uid, lat); on the
    equator the value stays."""
    bare = {f: f.removeprefix("a").removeprefix("fnorm_") if f.startswith(("fnorm_", "afnorm_")) else f for f in fields}
    if any(k != v for k, v in bare.items()):
        if catalog is None:
            raise ValueError("fields divided by f need the catalogue")
        wide = gathered(cutouts, sorted(set(bare.values())), uid, missing, key).join(catalog.select(key, F.col("lat").alias("_lat")), key, "left")
        value = lambda f: F.col(bare[f]) if f == bare[f] else normalised(F.col(bare[f]), F.col("_lat"), f.startswith("a"))
        return wide.select(key, "y", "x", *[value(f).alias(f) for f in fields])
    some = cutouts.filter(F.col("field").isin(fields))
    if uid is not None:
        some = some.filter(F.col(key) == uid)
    if missing == "raise":
        lacking = some.groupBy(key).agg(F.count_distinct("field").alias("n")).filter(F.col("n") < len(fields)).select(key).take(5)
        if lacking or (uid is not None and some.isEmpty()):
            raise KeyError(f"fields are missing of cut-outs {[r[0] for r in lacking] or uid}")
    return some.groupBy(key, "y", "x").pivot("field", fields).agg(F.first("value"))


#: Codes of the parts of a split.
SPLITS = {"valid": 0, "train": 1, "test": 2}


def split_rows(meta: DataFrame, part: str, arrays: DataFrame, times: DataFrame, code: str = "split", time: str = "t") -> DataFrame:
    """Rows of a part of the split, as many as its stacked array has (else an error), at the given times."""
    rows = meta.filter(F.col(code) == SPLITS[part])
    if (n := rows.count()) != (m := arrays.count()):
        raise ValueError(f"{n} rows of {part}, but {m} in its array")
    return rows.join(times.select(time).distinct(), time, "left_semi")


def training_set(table: DataFrame, cells: DataFrame, channels: list[str], sizes: dict[str, int], allowed: dict[str, list] | None = None, path: str | None = None, seed: int = 0, key: str = "uid") -> DataFrame:
    """(uid, split, pp_type, channels): the parts of a split with their stacked fields, checked, and written by part if a path is
    given. pp_type is 0 for validation, 1 for training, 2 for tests. A row without cells is an error."""
    parts = random_split(table, sizes, key, seed).select(key, "split")
    code = F.create_map(*[F.lit(x) for kv in SPLITS.items() for x in kv])[F.col("split")]
    both = parts.join(stack(cells, channels, key), key, "left").withColumn("pp_type", code).select(key, "split", "pp_type", "channels")
    bad = both.agg(F.count_if(F.col("channels").isNull()).alias("n"), F.count_if(F.col("pp_type").isNull()).alias("m")).first()
    if bad.n or bad.m:
        raise ValueError(f"{bad.n} rows have no cells, {bad.m} no known part")
    wrong = vet(both.select("split"), {"split": "string"}, allowed or {"split": list(SPLITS)}).filter("n_bad > 0")
    if not wrong.isEmpty():
        raise ValueError("a part has a name that is not allowed")
    if path is None:
        return both
    both.write.partitionBy("split").parquet(path)
    return table.sparkSession.read.parquet(path)
