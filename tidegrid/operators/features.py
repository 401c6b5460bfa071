"""Feature tables: engineering, scaling, correlations, principal components, cluster profiles, density clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.ocean import coriolis
from tidegrid.operators.components import by_shuffle, checkpointed, min_label_components
from tidegrid.operators.ranking import RANGE_ROWS, percentiles


#: The properties divided by |f| at the median, and the statistics of them that are.
BY_F = ("strain_mag", "strain_n", "strain_s", "relative_vorticity", "divergence")
BY_F_STATS = ("_mean", "_median", "_p10", "_p25", "_p75", "_p90")


def at_least(value: Column, least: float) -> Column:
    """The value or the bound below it; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(least)))


def engineered(
    df: DataFrame, lat: str, by_f: list[str] = (), by_f2: list[str] = (), logs: list[str] = (), speed: tuple[str, str] | None = None,
    grad_ratio: tuple[str, str] | None = None, npix: str | None = None,
) -> DataFrame:
    """x / |f| with |f| at least 1e-7, x / f^2, log10 with values at least 1e-30; speed from two components, log_grad_ratio of two
    squared gradients, log_npix of a count. What is missing stays missing."""
    f = at_least(F.abs(coriolis(F.col(lat))), 1e-7)
    log = lambda v, least=1e-30: F.log10(at_least(v, least))
    new = {f"{c}_over_f": F.col(c) / f for c in by_f} | {f"{c}_over_f2": F.col(c) / (f * f) for c in by_f2} | {f"log_{c}": log(F.col(c)) for c in logs}
    if speed:
        new["speed"] = F.hypot(*speed)
    if grad_ratio:
        new["log_grad_ratio"] = log(F.col(grad_ratio[0]) / at_least(F.col(grad_ratio[1]), 1e-30))
    if npix:
        new["log_npix"] = log(F.col(npix), 1.0)
    return df.withColumns(new)


def over_f(df: DataFrame, f: str = "coriolis_f_median", names: tuple[str, ...] = BY_F, stats: tuple[str, ...] = BY_F_STATS) -> DataFrame:
    """Adds {name}{stat}_over_f, divided by |f|, for every such column that the table has; null where f is 0. Without f, nothing."""
    if f not in df.columns:
        return df
    size = F.nullif(F.abs(F.col(f)), F.lit(0.0))
    return df.withColumns({f"{n}{s}_over_f": F.col(n + s) / size for n in names for s in stats if n + s in df.columns})


def aligned_temperature(df: DataFrame, value: str) -> DataFrame:
    """Values in Celsius and kind: kelvin (a median above 200, converted), anomaly (a median within 5 of 0) or celsius, as they are."""
    both = df.crossJoin(F.broadcast(percentiles(df, value, [50]).select(F.col("p0").alias("_m"))))
    m = F.col("_m")
    kind = F.when(m > 200, "kelvin").when(F.abs(m) < 5, "anomaly").otherwise("celsius")
    return both.withColumns({value: F.when(m > 200, F.col(value) - 273.15).otherwise(F.col(value)), "kind": kind}).drop("_m")


def aligned_gradient(df: DataFrame, value: str) -> DataFrame:
    """Squared gradients per km as log10 per m: log10 - 6, null at 0. If any value is negative, all are anomalies and stay."""
    both = df.crossJoin(F.broadcast(df.agg(F.min(value).alias("_m"))))
    return both.withColumn(value, F.when(F.col("_m") < 0, F.col(value)).otherwise(F.when(F.col(value) > 0, F.log10(value) - 6))).drop("_m")


def cutout_summary(cells: DataFrame, value: str, key: str = "uid") -> DataFrame:
    """Per cut-out mu, min, max, p10, p90 and dt, the difference of the last two."""
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    got = cells.groupBy(key).agg(F.avg(value).alias("mu"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("_q"))
    return got.withColumns({"p10": F.get("_q", F.lit(0)), "p90": F.get("_q", F.lit(1))}).withColumn("dt", F.col("p90") - F.col("p10")).drop("_q")


def counters(cells: DataFrame, value: str, threshold: float, key: str = "uid") -> DataFrame:
    """Per cut-out the cells above the threshold and below its negative, and the sums of positive and of negative values."""
    v = F.col(value)
    total = lambda where: F.coalesce(F.sum(F.when(where, v)), F.lit(0.0))
    return cells.groupBy(key).agg(
        F.count_if(v > threshold).alias("n_pos"), F.count_if(v < -threshold).alias("n_neg"), total(v > 0).alias("pos_sum"), total(v < 0).alias("neg_sum"),
    )


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose values are all present and finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.filter(ok)


def scaled(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, by their population standard deviation."""
    one = df.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"_s{k}") for k, c in enumerate(cols)])
    both = df.crossJoin(F.broadcast(one))
    return both.withColumns({c: (F.col(c) - F.col(f"_m{k}")) / F.when(F.col(f"_s{k}") == 0, 1.0).otherwise(F.col(f"_s{k}")) for k, c in enumerate(cols)}).drop(*one.columns)


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, r) for all pairs of columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


class PCA:
    """Principal components of scaled columns. The p x p covariance is one aggregate over all rows; its eigenvectors are found on
    the driver, and projections are column expressions. A component's largest weight is positive."""

    def __init__(self, df: DataFrame, cols: list[str], k: int):
        self.cols, p = cols, len(cols)
        good = finite(df, cols)
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        one = good.agg(
            *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
            *[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs], F.count(F.lit(1)).alias("n"),
        ).first()
        self.n = one["n"]
        self.mean = np.array([one[f"m{i}"] for i in range(p)])
        self.std = np.array([one[f"s{i}"] or 1.0 for i in range(p)])
        cov = np.zeros((p, p))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = one[f"c{i}_{j}"] / (self.std[i] * self.std[j])
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)
        self.variance, self.ratio = values[order][:k], (values[order] / values.sum())[:k]
        parts = vectors[:, order[:k]].T
        self.loadings = parts * np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(axis=1)])[:, None]

    def project(self, df: DataFrame) -> DataFrame:
        z = [(F.col(c) - float(self.mean[i])) / float(self.std[i]) for i, c in enumerate(self.cols)]
        return finite(df, self.cols).withColumns({f"pc{k + 1}": sum((z[i] * float(w) for i, w in enumerate(row)), F.lit(0.0)) for k, row in enumerate(self.loadings)})

    def reconstruct(self, projected: DataFrame, use: list[int]) -> DataFrame:
        return projected.withColumns({
            f"{c}_back": sum((F.col(f"pc{k}") * float(self.loadings[k - 1, i]) for k in use), F.lit(0.0)) * float(self.std[i]) + float(self.mean[i]) for i, c in enumerate(self.cols)
        })

    def summary(self, spark, top: int = 3) -> DataFrame:
        """(pc, variance_ratio, cumulative, rank, column, loading): the top columns of each component."""
        rows, total = [], 0.0
        for k, row in enumerate(self.loadings):
            total += float(self.ratio[k])
            for rank, i in enumerate(np.argsort(-np.abs(row))[:top]):
                rows.append((k + 1, float(self.ratio[k]), total, rank + 1, self.cols[i], float(row[i])))
        return spark.createDataFrame(rows, "pc int, variance_ratio double, cumulative double, rank int, column string, loading double")


def cluster_profile(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """Per cluster its size, share and median features, and these scaled over the clusters."""
    mid = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), *[F.median(c).alias(c) for c in cols])
    total = mid.agg(F.sum("n").alias("_all"), *[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    z = {f"{c}_z": F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")) for c in cols}
    return mid.crossJoin(F.broadcast(total)).withColumns(z | {"share": F.col("n") / F.col("_all")}).drop(*total.columns)


def _box(names: list[str]) -> list:
    return [f(v).alias(v + s) for v in names for f, s in ((F.min, "lo"), (F.max, "hi"))]


def _least_d2(names: list[str], a: str, b: str) -> Column:
    """Squared distance that no pair of points of two boxes falls below, in floating point too: differences, squares and sums grow with what they
    are taken of."""
    gap = lambda v: F.greatest(F.lit(0.0), F.col(f"{b}.{v}lo") - F.col(f"{a}.{v}hi"), F.col(f"{a}.{v}lo") - F.col(f"{b}.{v}hi"))
    return sum((gap(v) ** 2 for v in names), F.lit(0.0))


def _most_d2(names: list[str], a: str, b: str) -> Column:
    """Squared distance that no pair of points of two boxes exceeds."""
    far = lambda v: F.greatest(F.col(f"{b}.{v}hi") - F.col(f"{a}.{v}lo"), F.col(f"{a}.{v}hi") - F.col(f"{b}.{v}lo"))
    return sum((far(v) ** 2 for v in names), F.lit(0.0))


def _met(left: DataFrame, right: DataFrame, at: list[str], side: float) -> DataFrame:
    """(l, r): rows of two tables as structs, those in one cube of the side along the columns `at` or in cubes beside each other."""
    # a little wider, so that rounding moves nothing past the next cube
    cube = lambda v: F.floor(F.col(v) / (side * (1 + 1e-6))).cast("long")
    names = [f"_c{i}" for i in range(len(at))]
    mine = left.select(F.struct(*left.columns).alias("l"), *[cube(v).alias(n) for n, v in zip(names, at, strict=True)])
    for n in names:
        mine = mine.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
    other = right.select(F.struct(*right.columns).alias("r"), *[cube(v).alias(n) for n, v in zip(names, at, strict=True)])
    return mine.join(by_shuffle(other), names).select("l", "r")


def places(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(k, v0, v1, ..., n): the places of the points that have all columns; k is the least key of the n points of a place."""
    return finite(df, cols).groupBy(*[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)]).agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n"))


def _linked_cells(core: DataFrame, vs: list[str], eps: float, side: float, most_axes: int, most_pairs: int) -> DataFrame:
    """(a, b): pairs of cells a < b that have points within eps of each other; core has (k, v0, ..., cell).

    Boxes about the cells' points decide first: far apart, or all of one within eps of all of the other. What they leave open is asked again
    of the halves of cells along each column, and so on, until few pairs of points are left to be looked at one by one. Of boxes
    that hold a point each, one or the other is true."""
    path = lambda k: F.array(*[F.floor(F.col(v) / side * float(1 << k)).cast("long") for v in vs])
    nodes = lambda k: core.withColumn("path", path(k)).groupBy("cell", "path").agg(*_box(vs), F.count(F.lit(1)).alias("n"))

    def judged(met: DataFrame) -> DataFrame:
        one = met.filter(_least_d2(vs, "l", "r") <= eps * eps).withColumn("sure", _most_d2(vs, "l", "r") <= eps * eps)
        return checkpointed(one.select(F.col("l.cell").alias("a"), F.col("r.cell").alias("b"), F.col("l.path").alias("pa"), F.col("r.path").alias("pb"), (F.col("l.n") * F.col("r.n")).alias("pairs"), "sure"))

    first = checkpointed(nodes(0))
    # two cells with points within eps begin less than two eps apart
    got, out, k = judged(_met(first, first, [f"{v}lo" for v in vs[:most_axes]], 2 * eps).filter("l.cell < r.cell")), [], 0
    while True:
        sure = checkpointed(got.filter("sure").select("a", "b").distinct())
        out.append(sure)
        left = checkpointed(got.filter("not sure").join(by_shuffle(sure), ["a", "b"], "left_anti").select("a", "b", "pa", "pb", "pairs"))
        todo = left.agg(F.sum("pairs")).first()[0]
        if todo is None:
            break
        mine = lambda t, k, c, p, s: t.select(F.col("cell").alias(c), (F.col("path") if k is None else F.transform("path", lambda i: F.shiftright(i, 1))).alias(p), F.struct(*t.columns).alias(s))
        if todo <= most_pairs or k == 20:
            each = core.withColumn("path", path(k))
            both = left.join(by_shuffle(mine(each, None, "a", "pa", "l")), ["a", "pa"]).join(by_shuffle(mine(each, None, "b", "pb", "r")), ["b", "pb"])
            d2 = sum(((F.col(f"l.{v}") - F.col(f"r.{v}")) ** 2 for v in vs), F.lit(0.0))
            out.append(both.filter(d2 <= eps * eps).select("a", "b").distinct())
            break
        k += 1
        half = checkpointed(nodes(k))
        got = judged(left.join(by_shuffle(mine(half, k, "a", "pa", "l")), ["a", "pa"]).join(by_shuffle(mine(half, k, "b", "pb", "r")), ["b", "pb"]).select("l", "r"))
    links = out[0]
    for more in out[1:]:
        links = links.unionByName(more)
    return links


def density_clusters(df: DataFrame, key: str, cols: list[str], eps: float, min_points: int, most_axes: int = 3, most_pairs: int = 5_000_000) -> DataFrame:
    """Clusters of points that have at least min_points within eps, themselves included; -1 for noise; the least key names a cluster.

    Points of one place count as one with their number. Places are put in cells so small that all of a cell are within eps of each other (cells
    whose box rounding makes larger are taken apart): a cell of min_points or more is dense without a pair looked at. Only the few
    places of other cells are held against their surroundings, and cells are linked by their boxes, so that pairs grow with the
    places. Places meet in cubes along the first `most_axes` columns; beyond these, pairs of sparse cells may be more."""
    vs, side = [f"v{i}" for i in range(len(cols))], 0.999 * eps / math.sqrt(len(cols))
    near = sum(((F.col(f"l.{v}") - F.col(f"r.{v}")) ** 2 for v in vs), F.lit(0.0)) <= eps * eps
    # lists are equal where all of their numbers are
    placed = checkpointed(places(df, key, cols).withColumn("at", F.array(*[F.floor(F.col(v) / side).cast("long") for v in vs])))
    whole = placed.groupBy("at").agg(F.min("k").alias("cell"), F.sum("n").alias("all"), *_box(vs))
    tight = sum(((F.col(f"{v}hi") - F.col(f"{v}lo")) ** 2 for v in vs), F.lit(0.0)) <= eps * eps
    dense = F.when(tight, F.col("all")).otherwise(F.col("n")) >= min_points
    one = checkpointed(placed.join(by_shuffle(whole), "at").select("k", *vs, "n", F.when(tight, F.col("cell")).otherwise(F.col("k")).alias("cell"), dense.alias("dense")))
    axes = vs[:most_axes]
    counted = _met(one.filter("not dense").select("k", *vs), one.select("n", *vs), axes, eps).filter(near).groupBy(F.col("l.k").alias("k")).agg(F.sum("r.n").alias("about"))
    state = checkpointed(one.join(by_shuffle(counted), "k", "left").select("k", *vs, "cell", (F.col("dense") | (F.col("about") >= min_points)).alias("core")))
    core = state.filter("core").select("k", *vs, "cell")
    links = _linked_cells(core, vs, eps, side, most_axes, most_pairs)
    cells = core.groupBy("cell").agg(F.min("k").alias("k"))
    roots = min_label_components(links.unionByName(cells.select(F.col("cell").alias("a"), F.col("cell").alias("b"))))
    rooted = cells.join(by_shuffle(roots.withColumnsRenamed({"id": "cell", "label": "root"})), "cell")
    named = rooted.join(by_shuffle(rooted.groupBy("root").agg(F.min("k").alias("label"))), "root").select("cell", "label")
    inner = checkpointed(core.join(by_shuffle(named), "cell").select(*vs, "label"))
    edge = _met(state.filter("not core").select(*vs), inner, axes, eps).filter(near).groupBy(*[F.col(f"l.{v}").alias(v) for v in vs]).agg(F.min("r.label").alias("label"))
    found = inner.unionByName(edge).withColumnsRenamed({v: f"_{v}" for v in vs} | {"label": "_label"})
    at = [F.col(c) == F.col(f"_{v}") for c, v in zip(cols, vs, strict=True)]
    return df.select(key, *cols).join(by_shuffle(found), at, "left").select(key, F.coalesce("_label", F.lit(-1)).alias("cluster"))


def cumulative_share(df: DataFrame, weight: str, by: str, parts: int | None = None) -> DataFrame:
    """Cumulative share of a weight in the order of another column, without a window over all rows: distinct values are cut into
    ranges of even size, in number with them, ranges are summed, and each one's running sum begins at the sum of those before it."""
    kept = df.select(F.col(by).alias("v"), F.col(weight).alias("w")).filter("v is not null and w is not null").groupBy("v").agg(F.sum("w").alias("w"))
    if parts is None:
        kept = checkpointed(kept)
        parts = max(8, kept.count() // RANGE_ROWS)
    cut = checkpointed(kept.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    sums = cut.groupBy("part").agg(F.sum("w").alias("s"))
    before = sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("all"))
    run = F.sum("w").over(Window.partitionBy("part").orderBy("v"))
    return cut.join(F.broadcast(before), "part").select(F.col("v").alias(by), ((run + F.col("before")) / F.col("all")).alias("share"))
