"""Connected components of masks, on runs of cells instead of cells, and what follows from them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master, as in tests,
    and an error on a cluster, whose machines do not share such folders."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidegrid-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut: written to the shared folder and read from there. Unlike checkpoint(), the table keeps no
    constraints of its plan, which double with each round of a loop."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df as one side of a join of tables that both grow with the input: it is shuffled, not sent whole through the driver, however small the
    file that it is read from (ids compress well, and a loop joins many times)."""
    return df.hint("merge")


def _joined_up(pdf: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Each end of the edges with the least id of its component, by union-find."""
    root: dict = {}

    def top(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    groups = list(zip(*[pdf[c] for c in key], strict=True)) if key else [()] * len(pdf)
    for g, a, b in zip(groups, pdf["a"], pdf["b"], strict=True):
        p, q = top((g, a)), top((g, b))
        if p != q:
            root[max(p, q, key=lambda k: k[1])] = min(p, q, key=lambda k: k[1])
    rows = [(*k[0], k[1], top(k)[1]) for k in list(root)]
    return pd.DataFrame(rows, columns=[*key, "a", "p"])


def min_label_components(edges: DataFrame, by: tuple[str, ...] = (), rounds: int = 60, small: int = 200_000) -> DataFrame:
    """(by, id, label) of every id in edges (by, a, b), each component named by its least id; ids of different `by` are apart.

    A round hooks every node onto the neighbour that comes first in an order drawn by a hash of the ids, anew each round, if that comes before
    the node itself; it shortens the chains of hooks by leaping, and contracts the graph to what is left: edges between different
    labels. Chains along a drawn order are short whatever the ids, so the graph shrinks geometrically and neither a component's diameter nor
    the order of its ids matters. What has shrunk to at most `small` edges, counted, is finished in one task. The rounds' hooks are
    followed from the last round back, so that each id is moved once."""
    key = list(by)
    types = dict(edges.dtypes)
    ends = edges.select(*key, F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in (("a", "b"), ("b", "a"))])).alias("e"))
    ends = checkpointed(ends.select(*key, F.col("e.a").alias("a"), F.col("e.b").alias("b")).distinct())
    graph, hooked = ends.filter("a <> b"), []
    for k in range(rounds):
        # counted from the footers of a table that was written
        if graph.count() <= small:
            fields = ", ".join(f"`{c}` {types[c]}" for c in [*key, "a"]) + f", p {types['a']}"
            found = graph.filter("a < b").withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(lambda pdf: _joined_up(pdf, key), fields)
            break
        drawn = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("p"))  # noqa: B023, E731
        first = graph.groupBy(*key, "a").agg(F.min(drawn("b")).alias("_m")).withColumn("_m", F.least("_m", drawn("a")))
        hooks = checkpointed(first.select(*key, "a", F.col("_m.p").alias("p")))
        far = hooks
        for _ in range(2):
            step = far.select(*key, F.col("a").alias("p"), F.col("p").alias("q"))
            far = far.join(by_shuffle(step), [*key, "p"]).select(*key, "a", F.col("q").alias("p"))
        far = checkpointed(far)
        hooked.append(far)
        to = lambda c: far.select(*key, F.col("a").alias(c), F.col("p").alias("to"))  # noqa: B023, E731
        one = graph.join(by_shuffle(to("a")), [*key, "a"]).select(*key, F.col("to").alias("a"), "b")
        two = one.join(by_shuffle(to("b")), [*key, "b"]).select(*key, "a", F.col("to").alias("b"))
        # chains longer than the leaps stay linked by the hooks of where they stopped
        stopped = far.select(*key, F.col("p").alias("a")).distinct().join(by_shuffle(hooks.filter("a <> p")), [*key, "a"]).select(*key, "a", F.col("p").alias("b"))
        rest = stopped.unionByName(stopped.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        graph = checkpointed(two.filter("a <> b").unionByName(rest).distinct())
    else:
        raise RuntimeError(f"components were not done after {rounds} rounds")
    for far in reversed(hooked):
        onward = found.select(*key, F.col("a").alias("p"), F.col("p").alias("to"))
        found = checkpointed(far.join(by_shuffle(onward), [*key, "p"], "left").select(*key, "a", F.coalesce("to", "p").alias("p")))
    ids = ends.select(*key, F.col("a").alias("id")).distinct()
    named = ids.join(by_shuffle(found.withColumnRenamed("a", "id")), [*key, "id"], "left").select(*key, "id", F.coalesce("p", "id").alias("p"))
    if not hooked:
        return checkpointed(named.withColumnRenamed("p", "label"))
    named = checkpointed(named)
    least = named.groupBy(*key, "p").agg(F.min("id").alias("label"))
    return checkpointed(named.join(by_shuffle(least), [*key, "p"]).select(*key, "id", "label"))


def _least_of_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number of its component for each of 0 to n - 1, joined by pairs a, b: larger roots hook onto smaller ones until no
    pair lies apart; what is left halves in two rounds."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def by_group(df: DataFrame, keys: dict[str, Column], run: Callable[[pd.DataFrame], pd.DataFrame], fields: str) -> DataFrame:
    """What run gives for the rows of df, some whole groups of equal keys a call: such groups are small and many, and a call for each would cost
    more than its work. A call has the groups that end in a batch, or one group that is larger. run gets the keys as columns, too."""
    names = list(keys)

    def calls(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, last = [], None
        for pdf in batches:
            key = pdf[names].to_numpy()
            if len(key) == 0:
                continue
            begin = len(key) - int((key == key[-1]).all(axis=1).sum())
            if held and (begin or (key[-1] != last).any()):
                yield run(pd.concat([*held, pdf[:begin]], ignore_index=True))
                held = []
            elif begin:
                yield run(pdf[:begin])
            held, last = [*held, pdf[begin:]], key[-1]
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return df.withColumns(keys).repartition(*names).sortWithinPartitions(*names).mapInPandas(calls, fields)


def group_numbers(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    """0, 1, ... by group of rows that are sorted by the named columns."""
    new = np.zeros(len(pdf), dtype=np.int64)
    for c in names:
        v = pdf[c].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.cumsum(new)


def _runs_of_blocks(pdf: pd.DataFrame, reach: int, block: tuple[int, int]) -> pd.DataFrame:
    """Runs of side by side cells (grid_id, y, x0, x1, both ends in the run) of some blocks, with p, the id of the first run of their
    component in the block, and whether they are that run."""
    of, y, x = group_numbers(pdf, ["grid_id", "_y", "_x"]), pdf["y"].to_numpy().astype(np.int64), pdf["x"].to_numpy().astype(np.int64)
    order = np.lexsort((x, y, of))
    of, y, x = of[order], y[order], x[order]
    start = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(y) != 0) | (np.diff(x) != 1)))
    of, y, x0, x1 = of[start], y[start], x[start], x[np.append(start[1:], len(x)) - 1]
    # rows of all blocks laid end to end, with room between them and an empty row after a block
    row, left = of * (block[0] + 1) + y % block[0], x0 // block[1] * block[1] - 2
    at = lambda row_, x_: row_ * (block[1] + 4) + x_ - left
    lo = np.searchsorted(at(row, x1), at(row + 1, x0 - reach))
    met = np.searchsorted(at(row, x0), at(row + 1, x1 + reach), "right") - lo
    a = np.repeat(np.arange(len(y)), met)
    b = np.arange(len(a)) + np.repeat(lo - np.cumsum(met) + met, met)
    # cells that the mask has twice begin runs over others of their row
    twice = np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] <= x1[:-1]))
    root = _least_of_joined(len(y), np.append(a, twice), np.append(b, twice + 1))
    return pd.DataFrame({"grid_id": pdf["grid_id"].to_numpy()[order[start]], "y": y, "x0": x0, "x1": x1, "p": ((y << 32) + x0)[root], "top": root == np.arange(len(y))})


def _across_blocks(local: DataFrame, reach: int, block: tuple[int, int]) -> DataFrame:
    """Edges (grid_id, a, b) of what the blocks have joined, where runs of two blocks touch: the first row of a block and the row above it,
    the first column and the one before it."""
    on = lambda c, n: F.pmod(c, F.lit(n)) == 0
    above = local.filter(on(F.col("y") + 1, block[0])).select("grid_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("p").alias("b"))
    touch = (F.col("x0") <= F.col("u1") + reach) & (F.col("u0") <= F.col("x1") + reach)
    down = local.filter(on(F.col("y"), block[0])).join(by_shuffle(above), ["grid_id", "y"]).filter(touch).select("grid_id", F.col("p").alias("a"), "b")
    rows = F.explode(F.sequence(F.col("y") - reach, F.col("y") + reach))
    before = local.filter(on(F.col("x1") + 1, block[1])).select("grid_id", rows.alias("y"), (F.col("x1") + 1).alias("x0"), F.col("p").alias("b"))
    side = local.filter(on(F.col("x0"), block[1])).join(by_shuffle(before), ["grid_id", "y", "x0"])
    return down.union(side.select("grid_id", F.col("p").alias("a"), "b"))


def label(mask: DataFrame, connectivity: int = 2, small: int = 200_000, block: tuple[int, int] = (256, 4096)) -> DataFrame:
    """Adds label to mask (grid_id, y, x): components numbered from 1 in the raster order of their first cells.

    connectivity 2 joins cells that touch at corners, 1 only those that share a side. Cells become runs of adjacent cells and runs are joined
    within blocks of rows and columns, a block a task; only where blocks meet do edges go through rounds. A run is named by the raster
    order of its first cell."""
    reach, types = 1 if connectivity == 2 else 0, dict(mask.dtypes)
    fields = f"grid_id {types['grid_id']}, y {types['y']}, x0 {types['x']}, x1 {types['x']}, p bigint, top boolean"
    blocks = {f"_{c}": F.floor(F.col(c) / n) for c, n in zip("yx", block, strict=True)}
    cells = mask.select("grid_id", "y", "x").dropna()
    local = checkpointed(by_group(cells, {"grid_id": F.col("grid_id"), **blocks}, lambda pdf: _runs_of_blocks(pdf, reach, block), fields))
    roots = min_label_components(_across_blocks(local, reach, block), ("grid_id",), small=small).withColumnsRenamed({"id": "p", "label": "root"})
    tops = local.filter("top").select("grid_id", "p").join(by_shuffle(roots), ["grid_id", "p"], "left")
    named = numbered(checkpointed(tops.select("grid_id", "p", F.coalesce("root", "p").alias("root"))))
    return local.join(by_shuffle(named), ["grid_id", "p"]).select("grid_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def numbered(tops: DataFrame) -> DataFrame:
    """(grid_id, p, label) of what blocks have joined (grid_id, p, root): roots to labels 1, 2, ... per grid. Ranks come from two steps:
    components are counted by row, then the rows' counts are summed up, so that no window holds all components of a grid."""
    first = tops.filter("root = p").select("grid_id", "root", F.shiftright("root", 32).alias("ry"))
    in_row = F.row_number().over(Window.partitionBy("grid_id", "ry").orderBy("root"))
    per_row = first.groupBy("grid_id", "ry").agg(F.count(F.lit(1)).alias("n"))
    before = per_row.select("grid_id", "ry", (F.sum("n").over(Window.partitionBy("grid_id").orderBy("ry")) - F.col("n")).alias("before"))
    ranks = first.withColumn("k", in_row).join(by_shuffle(before), ["grid_id", "ry"]).select("grid_id", "root", (F.col("k") + F.col("before")).cast("long").alias("label"))
    return tops.join(by_shuffle(ranks), ["grid_id", "root"]).select("grid_id", "p", "label")


def table(labels: DataFrame) -> DataFrame:
    """Per label npix, half-open bounding box and centroid."""
    return labels.groupBy("grid_id", "label").agg(
        F.count(F.lit(1)).alias("npix"), F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
        F.avg("y").alias("cy"), F.avg("x").alias("cx"),
    )


def without_small(mask: DataFrame, min_size: int, connectivity: int = 2, labels: DataFrame | None = None) -> DataFrame:
    """The mask without components of fewer than min_size cells."""
    lab = label(mask, connectivity) if labels is None else labels
    big = lab.groupBy("grid_id", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
    return lab.join(by_shuffle(big.select("grid_id", "label")), ["grid_id", "label"], "left_semi").select("grid_id", "y", "x")


def holes_filled(mask: DataFrame, height: int, width: int, most: int = 64) -> DataFrame:
    """The mask with background components of fewer than `most` cells filled (cells joined by sides).

    A background run of `most` cells or more is in no such hole; those go before labelling, and what touches one of them is no
    hole either: the giant background is never labelled."""
    busy = mask.select("grid_id", "y", "x")
    # rows about the mask's own: as many empty rows as hold `most` cells decide as all of a grid's do
    about = -(-most // width)
    near = F.sequence(F.greatest(F.col("y") - about, F.lit(0)), F.least(F.col("y") + about, F.lit(height - 1)))
    rows = busy.select("grid_id", "y").distinct().select("grid_id", F.explode(near).alias("y")).distinct().filter((F.col("y") >= 0) & (F.col("y") < height))
    # gaps between the cells of each row, with the edges of the grid as cells outside it
    ends = rows.select("grid_id", "y", F.explode(F.array(F.lit(-1), F.lit(width))).alias("x"))
    w = Window.partitionBy("grid_id", "y").orderBy("x")
    gaps = busy.union(ends).withColumn("next", F.lead("x").over(w)).filter(F.col("next") - F.col("x") > 1)
    free = checkpointed(gaps.select("grid_id", "y", (F.col("x") + 1).alias("x0"), (F.col("next") - 1).alias("x1")))
    long = free.filter(F.col("x1") - F.col("x0") + 1 >= most)
    small = free.filter(F.col("x1") - F.col("x0") + 1 < most)
    cells = small.select("grid_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    lab = checkpointed(label(cells, 1))
    beside = long.select("grid_id", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), F.col("x0").alias("l0"), F.col("x1").alias("l1"))
    open_ = lab.join(by_shuffle(beside), ["grid_id", "y"]).filter((F.col("x") >= F.col("l0")) & (F.col("x") <= F.col("l1"))).select("grid_id", "label").distinct()
    few = lab.groupBy("grid_id", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < most).select("grid_id", "label")
    holes = lab.join(by_shuffle(few), ["grid_id", "label"], "left_semi").join(by_shuffle(open_), ["grid_id", "label"], "left_anti")
    return busy.unionByName(holes.select("grid_id", "y", "x"))
