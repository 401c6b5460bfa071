"""Shapes of masks: thinning, spurs, dilation, ridge sharpening.

Whole-mask steps (neighbour counts, spur removal, dilation, gradient thinning) are joins and windows. Thinning runs on tiles that
exchange their edges. Steps that look at a cell's 3 x 3 in an order of their own (sharpening, pruning) run on packs of whole
components as grouped maps: no decision reaches past a component, so the result is that of the whole grid. Packs are of bounded size,
but for a component beyond that; kernels work on sorted cell lists.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators import components
from tidegrid.operators.colocate import inside, spread
from tidegrid.operators.components import checkpointed

#: Neighbours clockwise from above: bit k of a neighbour code is the k-th of these.
RING = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
#: Cells of whole components that a task works on together.
PACK_CELLS = 400_000
#: Cells of the arrays in which small tiles are thinned together.
STACK_CELLS = 4_000_000
#: Fixed value: rounding of a difference, as a share of the values that it is taken of.
ROUNDING = 2.0**-50
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _spurs() -> list[bool]:
    """By neighbour code whether a cell goes as a spur: it stands alone, has one neighbour, two sides at a right angle, a side and the
    corner before it (clockwise), or the three of one side; each at any quarter turn."""
    quarter = [(), (0,), (1,), (7, 0), (0, 2), (7, 0, 1)]
    codes = {sum(1 << (k + turn) % 8 for k in some) for some in quarter for turn in (0, 2, 4, 6)}
    return [c in codes for c in range(256)]


SPUR = _spurs()


def _simple(code: int) -> bool:
    """Whether a set cell's removal changes no topology: one 8-component of set neighbours, one 4-component of unset side neighbours."""
    on = [k for k in range(8) if code >> k & 1]
    off = [k for k in range(8) if not code >> k & 1]

    def pieces(cells: list[int], near: Callable[[int, int], bool], count: Callable[[list[int]], bool]) -> int:
        left, n = set(cells), 0
        while left:
            group, todo = [], [left.pop()]
            while todo:
                a = todo.pop()
                group.append(a)
                more = [b for b in left if near(a, b)]
                left.difference_update(more)
                todo += more
            n += count(group)
        return n

    dist = lambda a, b: max(abs(RING[a][0] - RING[b][0]), abs(RING[a][1] - RING[b][1]))
    side = lambda a, b: abs(RING[a][0] - RING[b][0]) + abs(RING[a][1] - RING[b][1]) == 1
    return pieces(on, lambda a, b: dist(a, b) == 1, lambda g: True) == 1 and pieces(off, side, lambda g: any(k % 2 == 0 for k in g)) == 1


SIMPLE = [_simple(c) for c in range(256)]


def neighbour_codes(mask: DataFrame, height: int | None = None, width: int | None = None) -> DataFrame:
    """mask with code: bit k set if its k-th neighbour is. With a grid's size, places outside it count as set."""
    off = F.explode(F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit")) for k, (dy, dx) in enumerate(RING)])).alias("o")
    sent = mask.select("grid_id", "y", "x", off).select("grid_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.bit").alias("bit"))
    own = mask.select("grid_id", "y", "x", F.lit(0).alias("bit"), F.lit(1).alias("own"))
    got = sent.withColumn("own", F.lit(0)).unionByName(own).groupBy("grid_id", "y", "x").agg(F.sum("bit").cast("int").alias("code"), F.max("own").alias("own")).filter("own = 1").drop("own")
    if height is None:
        return got
    edge = F.lit(0)
    for k, (dy, dx) in enumerate(RING):
        out = (F.col("y") + dy < 0) | (F.col("y") + dy >= height) | (F.col("x") + dx < 0) | (F.col("x") + dx >= width)
        edge = edge + F.when(out, 1 << k).otherwise(0)
    return got.withColumn("code", F.col("code").bitwiseOR(edge))


def neighbour_counts(mask: DataFrame) -> DataFrame:
    """mask with n, is_end (one neighbour) and is_branch (three or more)."""
    n = F.bit_count("code").cast("int")
    return neighbour_codes(mask).select("grid_id", "y", "x", n.alias("n"), (n == 1).alias("is_end"), (n >= 3).alias("is_branch"))


def without_spurs(mask: DataFrame, height: int, width: int, rounds: int | None = 1) -> DataFrame:
    """Spurs removed, all of a round at once; places outside the grid count as set. None: until nothing changes."""
    lut = F.array(*[F.lit(x) for x in SPUR])
    now, k = mask.select("grid_id", "y", "x"), 0
    while rounds is None or k < rounds:
        coded = neighbour_codes(now, height, width)
        if rounds is None:
            coded = checkpointed(coded)
            if coded.filter(F.get(lut, F.col("code"))).isEmpty():
                break
        now = coded.filter(~F.get(lut, F.col("code"))).select("grid_id", "y", "x")
        k += 1
    return now


def dilated(mask: DataFrame, offsets: list[tuple[int, int]] = CROSS, height: int | None = None, width: int | None = None) -> DataFrame:
    return inside(spread(mask.select("grid_id", "y", "x"), offsets).drop("d2").distinct(), height, width)


def cropped(mask: DataFrame, height: int, width: int, min_size: int = 7, connectivity: int = 2) -> DataFrame:
    """One round of spur removal, then small objects go and small holes are filled."""
    return components.holes_filled(components.without_small(without_spurs(mask, height, width), min_size, connectivity), height, width)


class Cells:
    """The cells of some components, with their neighbours of the same one as indices; the last index stands for none."""

    def __init__(self, y: np.ndarray, x: np.ndarray, component: np.ndarray | int = 0):
        # room around each component, so that no step leads into the next row or component
        y, x = y.astype(np.int64) - y.min() + 1, x.astype(np.int64) - x.min() + 1
        width, height = x.max() + 2, y.max() + 2
        self.key = (component * height + y) * width + x
        self.order = np.argsort(self.key)
        ranked = self.key[self.order]
        self.near = np.full((len(y), 8), len(y))
        for k, (dy, dx) in enumerate(RING):
            want = self.key + dy * width + dx
            at = np.searchsorted(ranked, want).clip(max=len(y) - 1)
            hit = ranked[at] == want
            self.near[hit, k] = self.order[at[hit]]

    def codes(self, on: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        return (np.append(on, False)[self.near[rows]] << np.arange(8)).sum(axis=1)


def _thinnable() -> list[np.ndarray]:
    """Two tables by code, for the two half-steps of the two-subiteration thinning of Guo and Hall (1989)."""
    out = [np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)]
    for c in range(256):
        n, ne, e, se, s, sw, w, nw = (bool(c >> k & 1) for k in range(8))
        crossing = (not n and (ne or e)) + (not e and (se or s)) + (not s and (sw or w)) + (not w and (nw or n))
        a = (nw or n) + (ne or e) + (se or s) + (sw or w)
        b = (n or ne) + (e or se) + (s or sw) + (w or nw)
        if crossing == 1 and 2 <= min(a, b) <= 3:
            out[0][c] = not ((n or ne or not se) and e)
            out[1][c] = not ((s or sw or not nw) and w)
    return out


THIN = _thinnable()


def thin_kernel(cells: Cells, rounds: int | None = None) -> np.ndarray:
    on, k = np.ones(len(cells.key), dtype=bool), 0
    while rounds is None or k < rounds:
        before = int(on.sum())
        for table in THIN:
            on &= ~table[cells.codes(on)]
        k += 1
        if int(on.sum()) == before:
            break
    return on


def _thin_tiles(names: np.ndarray, rounds: int, own: np.ndarray) -> bool:
    """Thins tiles in place, at most so many rounds; names has a label a cell, 0 for none. Whether the last round still changed the tiles'
    own cells, those not within a halo."""
    for _ in range(rounds):
        before, all_before = np.count_nonzero(names[own]), np.count_nonzero(names)
        for table in THIN:
            y, x = np.nonzero(names)
            wide = np.pad(names, 1)
            code = np.zeros(len(y), dtype=np.int64)
            for k, (dy, dx) in enumerate(RING):
                code |= (wide[y + 1 + dy, x + 1 + dx] == names[y, x]).astype(np.int64) << k
            off = table[code]
            names[y[off], x[off]] = 0
        if np.count_nonzero(names) == all_before:
            return False
    return np.count_nonzero(names[own]) != before


def _of_steps(run: Callable, steps: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: run(steps, pdf)


def thinned_in_tiles(labels: DataFrame, tile: int = 512, halo: int = 64, rounds: int | None = None) -> DataFrame:
    """labels (grid_id, label, y, x) thinned, each label apart, however large it is: the whole grid's thinning tile by tile.

    A half-step looks at a cell's 3 x 3, so what a tile knows beyond its edge goes stale by one cell a half-step: with a halo of 64
    cells it thins 32 rounds by itself, then tiles exchange their edges. That is repeated until no tile's own cells change in a
    last round. A task holds some tiles and their halos at a time, whatever the component. Tiles name themselves busy in a row without a
    place. They are laid out from a halo before the origin: a grid that begins there needs no tiles before it."""
    types = dict(labels.dtypes)
    fields = f"grid_id {types['grid_id']}, label {types['label']}, y {types['y']}, x {types['x']}"
    each, keys = halo // 2, ["grid_id", "_ty", "_tx"]

    def run(steps: int, pdf: pd.DataFrame) -> pd.DataFrame:
        place = lambda c: pdf[c].to_numpy() + halo - pdf[f"_t{c}"].to_numpy() * tile
        y, x = place("y"), place("x")
        inner = (y >= 0) & (y < tile) & (x >= 0) & (x < tile)
        of = components.group_numbers(pdf, keys)
        owning = (np.bincount(of, inner) > 0)[of]
        pdf, y, x, inner = pdf[owning], y[owning], x[owning], inner[owning]
        if pdf.empty:
            return pdf[["grid_id", "label", "y", "x"]]
        of = components.group_numbers(pdf, keys)
        # tiles as far as they have cells, below one another with an empty row between them, up to a size at a time
        first = np.flatnonzero(np.diff(of, prepend=-1))
        low = np.minimum.reduceat(y, first)
        high = np.maximum.reduceat(y, first) - low + 2
        row, stack = y + (np.cumsum(high) - high - low)[of], (np.cumsum(high) * (tile + 2 * halo) // STACK_CELLS)[of]
        left, busy = np.zeros(len(pdf), dtype=bool), False
        for k in np.unique(stack):
            part = stack == k
            at = row[part] - row[part].min(), x[part] - x[part].min()
            names = np.zeros((at[0].max() + 1, at[1].max() + 1), dtype=np.int64)
            own = np.zeros(names.shape, dtype=bool)
            names[at] = np.unique(pdf["label"].to_numpy()[part], return_inverse=True)[1] + 1
            own[at] = inner[part]
            busy |= _thin_tiles(names, steps, own)
            left[part] = names[at] > 0
        out = pdf.loc[left & inner, ["grid_id", "label", "y", "x"]]
        return pd.concat([out, pdf[["grid_id", "label"]].head(1).assign(y=None, x=None)]).astype({"y": "Int64", "x": "Int64"}) if busy else out

    def spread_out(now: DataFrame) -> DataFrame:
        for c in "yx":
            tiles = F.sequence(F.floor(F.col(c) / tile), F.floor((F.col(c) + 2 * halo) / tile))
            now = now.withColumn(f"_t{c}", F.explode(tiles))
        return now

    now, done = labels.select("grid_id", "label", "y", "x"), 0
    while rounds is None or done < rounds:
        steps = each if rounds is None else min(each, rounds - done)
        got = checkpointed(components.by_group(spread_out(now), {k: F.col(k) for k in keys}, _of_steps(run, steps), fields))
        now, done = got.filter("y is not null"), done + steps
        if got.filter("y is null").isEmpty():
            break
    return now


def sharpen_kernel(cells: Cells, value: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cells are taken off from the lowest value up, if that leaves topology and ends alone; a cell whose neighbour went is asked again."""
    on = np.ones(len(value), dtype=bool)
    heap = [(v, int(a), int(b), k) for k, (v, a, b) in enumerate(zip(value.tolist(), y.tolist(), x.tolist(), strict=True))]
    heapq.heapify(heap)
    waiting = np.ones(len(value), dtype=bool)
    flags = np.append(on, False)
    while heap:
        _, _, _, k = heapq.heappop(heap)
        waiting[k] = False
        if not flags[k]:
            continue
        code = int((flags[cells.near[k]] << np.arange(8)).sum())
        if SIMPLE[code] and code.bit_count() > 1:
            flags[k] = False
            for j in cells.near[k]:
                if flags[j] and not waiting[j]:
                    waiting[j] = True
                    heapq.heappush(heap, (value[j], int(y[j]), int(x[j]), int(j)))
    return flags[:-1]


def _by_component(cells: DataFrame, kernel: Callable[[pd.DataFrame, Cells], np.ndarray], key: str = "label", pack: int = PACK_CELLS) -> DataFrame:
    """What the kernel keeps of the cells, many components at a time."""
    types = dict(cells.dtypes)
    cells = checkpointed(cells)
    packs = max(1, -(-cells.count() // pack))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["grid_id", key, "y", "x"], ignore_index=True)
        keep = kernel(pdf, Cells(pdf["y"].to_numpy(), pdf["x"].to_numpy(), pdf.groupby(["grid_id", key], sort=False).ngroup().to_numpy()))
        return pdf.loc[keep, ["grid_id", key, "y", "x"]]

    packed = cells.withColumn("_pack", F.pmod(F.xxhash64("grid_id", key), F.lit(packs)))
    return packed.groupBy("_pack").applyInPandas(run, f"grid_id {types['grid_id']}, {key} {types[key]}, y {types['y']}, x {types['x']}")


def thinned(mask: DataFrame, labels: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """Lines one cell wide; with labels, each label by itself. A cell that touches another is thinned together with it, so the mask needs no
    components."""
    lab = mask.select("grid_id", F.lit(1).alias("label"), "y", "x") if labels is None else labels
    return thinned_in_tiles(lab, rounds=rounds).select("grid_id", "y", "x")


def skeletons(labels: DataFrame) -> DataFrame:
    """Thinned cells of each label, with the label."""
    return thinned_in_tiles(labels)


def sharpened(labels: DataFrame, field: DataFrame, value: str, min_size: int = 1) -> DataFrame:
    """Ridges of a field within each label; labels left with fewer than min_size cells go."""
    both = labels.join(field.select("grid_id", "y", "x", value), ["grid_id", "y", "x"]).filter(F.col(value).isNotNull()).select("grid_id", "label", "y", "x", value)
    got = _by_component(both, lambda p, c: sharpen_kernel(c, p[value].to_numpy(), p["y"].to_numpy(), p["x"].to_numpy()))
    if min_size > 1:
        got = checkpointed(got)
        big = got.groupBy("grid_id", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size)
        got = got.join(big.select("grid_id", "label"), ["grid_id", "label"], "left_semi")
    return got


def _prune(cells: Cells, longest: float) -> np.ndarray:
    """Branches from an end to a junction of a length up to `longest` taken off, junctions left; a path without a junction stays.
    A step to a side is one long, a diagonal one the root of two."""
    on = np.ones(len(cells.key), dtype=bool)
    while True:
        flags = np.append(on, False)
        count = flags[cells.near].sum(axis=1) * on
        gone = []
        for end in np.flatnonzero(count == 1):
            path, length = [end], 0.0
            while True:
                ahead = [(j, k) for k, j in enumerate(cells.near[path[-1]]) if flags[j] and j not in path]
                if len(ahead) != 1:
                    break
                j, k = ahead[0]
                length += math.sqrt(2) if k % 2 else 1.0
                if length > longest:
                    break
                if count[j] >= 3:
                    gone += path
                    break
                path.append(j)
        if not gone:
            return on
        on[gone] = False


def despurred(mask: DataFrame, longest: float) -> DataFrame:
    """Skeletons without side branches of a length up to `longest`."""
    return _by_component(skeletons(components.label(mask)), lambda _, c: _prune(c, longest)).select("grid_id", "y", "x")


def gradient_thinned(mask: DataFrame, field: DataFrame, value: str, min_gap: int = 2, valid_from: float | None = None, min_gradient: float = 0.0) -> DataFrame:
    """Of each stretch of mask cells along a row, and along a column, the cell with the steepest central difference across it, the
    first at ties; both passes together. Differences are equal where they agree to the rounding of the values that
    they are taken of. Cells at most min_gap + 1 apart are one stretch. The two cells across must be valid, above
    valid_from if that is given; the cell itself need not be."""
    v = F.when(~F.isnan(value) if valid_from is None else (F.col(value) > valid_from) & ~F.isnan(value), F.col(value))
    clean = field.select("grid_id", "y", "x", v.alias("v"))

    def one(line: str, along: str) -> DataFrame:
        w = Window.partitionBy("grid_id", line).orderBy(along)
        ahead, back = F.max("v").over(w.rangeBetween(1, 1)), F.max("v").over(w.rangeBetween(-1, -1))
        g = clean.withColumns({"g": F.abs(ahead - back), "size": F.abs(ahead) + F.abs(back)})
        ok = mask.select("grid_id", "y", "x").join(g.filter(F.col("g") > min_gradient), ["grid_id", "y", "x"])
        all_ = mask.select("grid_id", "y", "x").withColumn("new", F.coalesce(F.col(along) - F.lag(along).over(w) > min_gap + 1, F.lit(True)).cast("int"))
        stretch = all_.withColumn("s", F.sum("new").over(w)).drop("new")
        whole = Window.partitionBy("grid_id", line, "s")
        steep = stretch.join(ok, ["grid_id", "y", "x"]).withColumns({"top": F.max("g").over(whole), "most": F.max("size").over(whole)})
        best = steep.filter(F.col("g") >= F.col("top") - F.col("most") * ROUNDING).groupBy("grid_id", line, "s").agg(F.min(along).alias(along))
        return best.select("grid_id", "y", "x")

    return one("y", "x").union(one("x", "y")).distinct()


def thinning_chain(mask: DataFrame, height: int, width: int, rounds: int = 2, min_size: int = 7, dilate: bool = True) -> DataFrame:
    """Dilation, then rounds of thinning, spur removal, small objects out and holes filled, with a dilation between rounds (none after
    the last one); a last thinning."""
    now = dilated(mask, height=height, width=width) if dilate else mask
    for k in range(rounds):
        now = cropped(checkpointed(thinned(now)), height, width, min_size)
        now = checkpointed(dilated(now, height=height, width=width) if k < rounds - 1 else now)
    return thinned(now)


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: cells of both masks, whether they are equal, and the share that differs."""
    both = a.select("grid_id", "y", "x", F.lit(1).alias("a")).join(b.select("grid_id", "y", "x", F.lit(1).alias("b")), ["grid_id", "y", "x"], "full")
    one = both.agg(F.count("a").alias("n_a"), F.count("b").alias("n_b"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_differ"))
    return one.select("n_a", "n_b", "n_differ", (F.col("n_differ") == 0).alias("equal"), (100.0 * F.col("n_differ") / F.greatest("n_a", F.lit(1))).alias("percent"))
