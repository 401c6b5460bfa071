"""Density clusters of feature vectors for many parameters from one graph of neighbours.

Points of one place count as one with their number, and pairs of places within the largest radius are found once. For each number of points m, a point's core distance is that to its m-th nearest
point, itself included, and a pair's reach is the largest of its distance and both core distances. The points that a radius connects are those
that the minimum spanning forest of the reaches connects once it is cut there, so each m needs one forest, whatever the radii.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.components import by_shuffle, checkpointed, min_label_components
from tidegrid.operators.features import finite, places

#: Places whose names are sent to all tasks at most.
BROADCAST_PLACES = 200_000


def neighbours(df: DataFrame, key: str, cols: list[str], radius: float, most_axes: int = 3, number: str | None = None) -> DataFrame:
    """(a, b, d, n): all ordered pairs of points within the radius, each point with itself too; b stands for n points, its `number`. Points meet in cubes of side `radius` along the
    first `most_axes` columns and in the cubes beside them; a cube that holds many points is split by the join's skew handling."""
    names = [f"_c{i}" for i in range(min(most_axes, len(cols)))]
    at = [F.floor(F.col(f"_v{i}") / radius).cast("long") for i in range(len(names))]
    points = finite(df, cols).select(F.col(key).alias("a"), (F.col(number) if number else F.lit(1)).cast("long").alias("n"), *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    mine = points
    for n, c in zip(names, at, strict=True):
        mine = mine.withColumn(n, F.explode(F.sequence(c - 1, c + 1)))
    mine = mine.drop("n")
    other = points.withColumns(dict(zip(names, at, strict=True))).withColumnsRenamed({"a": "b"} | {f"_v{i}": f"_w{i}" for i in range(len(cols))})
    d2 = sum(((F.col(f"_v{i}") - F.col(f"_w{i}")) ** 2 for i in range(len(cols))), F.lit(0.0))
    return mine.join(by_shuffle(other), names).select("a", "b", "n", d2.alias("d2")).filter(F.col("d2") <= radius * radius).select("a", "b", F.sqrt("d2").alias("d"), "n")


def core_distances(near: DataFrame, counts: list[int]) -> DataFrame:
    """(id, m, c) for each point and each m of counts; null where fewer points than m are near."""
    order = Window.partitionBy("a").orderBy("d", "b")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = near.withColumns({"k": F.row_number().over(order), "upto": upto}).filter(F.col("k") <= max(counts))
    found = ranked.groupBy(F.col("a").alias("id")).agg(*[F.min(F.when(F.col("upto") >= m, F.col("d"))).alias(f"c{m}") for m in counts])
    return found.select("id", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(f"c{m}").alias("c")) for m in counts])).alias("x")).select("id", "x.*")


def reaches(near: DataFrame, cores: DataFrame) -> DataFrame:
    """(m, a, b, w) of the pairs a < b whose points both have a core distance."""
    known = cores.filter("c is not null")
    one = near.filter("a < b").join(by_shuffle(known.select(F.col("id").alias("a"), "m", F.col("c").alias("ca"))), "a")
    two = one.join(by_shuffle(known.select(F.col("id").alias("b"), "m", F.col("c").alias("cb"))), ["b", "m"])
    return two.select("m", "a", "b", F.greatest("d", "ca", "cb").alias("w"))


def _finished(pdf: pd.DataFrame, key: list[str]) -> pd.DataFrame:
    """Edges of a small graph that connect, from the lightest up."""
    root: dict = {}

    def top(k):
        while root.setdefault(k, k) != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    pdf = pdf.sort_values([*key, "w", "a", "b"], ignore_index=True)
    groups = list(zip(*[pdf[c] for c in key], strict=True)) if key else [()] * len(pdf)
    kept = []
    for k, (g, a, b) in enumerate(zip(groups, pdf["ca"], pdf["cb"], strict=True)):
        p, q = top((g, a)), top((g, b))
        if p != q:
            root[p] = q
            kept.append(k)
    return pdf.loc[kept, [*key, "a", "b", "w"]]


def spanning_forest(edges: DataFrame, by: tuple[str, ...] = (), small: int = 200_000, rounds: int = 60) -> DataFrame:
    """(by, a, b, w): the minimum spanning forest of edges (by, a, b, w), graphs of different `by` apart; of equal weights the pair (a, b) of
    lesser ids comes first, which makes it unique.

    In a round each component takes its lightest edge, what is so joined becomes one component, and of the edges between two
    components the lightest stays: at most half of the components are left, whatever their shape. A graph of at most `small`
    edges, counted, is finished in one task."""
    key, types = list(by), dict(edges.dtypes)
    out, graph = [], checkpointed(edges.filter("a <> b").select(*key, F.least("a", "b").alias("ca"), F.greatest("a", "b").alias("cb"), F.struct("w", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("e")).groupBy(*key, "ca", "cb").agg(F.min("e").alias("e")))
    for _ in range(rounds):
        if graph.limit(small + 1).count() <= small:
            fields = ", ".join(f"`{c}` {types[c]}" for c in [*key, "a", "b", "w"])
            rest = graph.select(*key, "ca", "cb", "e.*", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(lambda pdf: _finished(pdf, key), fields)
            for part in out:
                rest = rest.unionByName(part)
            return checkpointed(rest)
        ends = graph.select(*key, F.explode(F.array("ca", "cb")).alias("c"), F.struct("e", "ca", "cb").alias("s"))
        chosen = checkpointed(ends.groupBy(*key, "c").agg(F.min("s").alias("s")).select(*key, "s.*").distinct())
        out.append(chosen.select(*key, "e.a", "e.b", "e.w"))
        labels = min_label_components(chosen.select(*key, F.col("ca").alias("a"), F.col("cb").alias("b")), by, small=small)
        for c in ("ca", "cb"):
            graph = graph.join(by_shuffle(labels.select(*key, F.col("id").alias(c), F.col("label").alias(f"_{c}"))), [*key, c])
        left = graph.filter("_ca <> _cb").select(*key, F.least("_ca", "_cb").alias("ca"), F.greatest("_ca", "_cb").alias("cb"), "e")
        graph = checkpointed(left.groupBy(*key, "ca", "cb").agg(F.min("e").alias("e")))
    raise RuntimeError(f"the forest was not done after {rounds} rounds")


def clusters(df: DataFrame, key: str, cols: list[str], params: list[tuple[float, int]], most_axes: int = 3, small: int = 200_000) -> DataFrame:
    """(eps, min_points, key, cluster) for every row of df and each pair of parameters. A point with at least min_points within eps, itself
    included, is in a cluster with all such points within eps; another point within eps of one joins its cluster, that of the
    least name if there are several; the rest are noise, -1. The least key of its core points names a cluster."""
    counts, vs = sorted({m for _, m in params}), [f"v{i}" for i in range(len(cols))]
    placed = checkpointed(places(df, key, cols))
    near = checkpointed(neighbours(placed, "k", vs, max(eps for eps, _ in params), most_axes, "n"))
    cores = checkpointed(core_distances(near, counts))
    forest = spanning_forest(reaches(near, cores), ("m",), small=small)
    each = F.explode(F.array(*[F.struct(F.lit(float(eps)).alias("eps"), F.lit(m).alias("min_points")) for eps, m in params])).alias("p")
    asked = lambda t, *c: t.select(*c, "m", each).filter("m = p.min_points").select(*c, "p.*")
    by = ("eps", "min_points")
    dense = F.coalesce(F.col("c") <= F.col("eps"), F.lit(False))
    state = asked(cores, "id", "c").withColumn("dense", dense)
    alone = state.filter("dense").select(*by, F.col("id").alias("a"), F.col("id").alias("b"))
    inner = asked(forest, "a", "b", "w").filter("w <= eps").select(*by, "a", "b")
    labels = min_label_components(inner.unionByName(alone), by, small=small)
    # what is not dense itself looks for the dense places about it
    edge = state.filter("not dense").select(*by, F.col("id").alias("a")).join(by_shuffle(near), "a").filter("d <= eps").join(by_shuffle(labels.withColumnRenamed("id", "b")), [*by, "b"])
    named = labels.select(*by, F.col("id").alias("k"), "label").unionByName(edge.groupBy(*by, F.col("a").alias("k")).agg(F.min("label").alias("label")))
    # a place's names under all parameters are one row, so that a row of df moves once, or not at all
    own = lambda eps, m: F.max(F.when((F.col("eps") == float(eps)) & (F.col("min_points") == m), F.col("label")))
    wide = named.groupBy("k").agg(*[own(eps, m).alias(f"_l{i}") for i, (eps, m) in enumerate(params)])
    found = checkpointed(placed.join(by_shuffle(wide), "k").select(*[F.col(v).alias(f"_{v}") for v in vs], *[f"_l{i}" for i in range(len(params))]))
    found = F.broadcast(found) if found.limit(BROADCAST_PLACES + 1).count() <= BROADCAST_PLACES else by_shuffle(found)
    at = [F.col(c) == F.col(f"_{v}") for c, v in zip(cols, vs, strict=True)]
    name = lambda i, eps, m: F.struct(F.lit(float(eps)).alias("eps"), F.lit(m).alias("min_points"), F.coalesce(F.col(f"_l{i}"), F.lit(-1)).alias("cluster"))
    rows = df.select(key, *cols).join(found, at, "left").select(key, F.explode(F.array(*[name(i, *p) for i, p in enumerate(params)])).alias("p"))
    return rows.select("p.eps", "p.min_points", key, "p.cluster")


def scan(found: DataFrame, params: list[tuple[float, int]], most_noise: float = 0.2) -> DataFrame:
    """(eps, min_points, n_clusters, noise_share, chosen): one row a pair of parameters of clusters(); chosen is the one of most clusters whose
    share of noise is below most_noise, the first in the given order at ties; none if all are above it or find no cluster."""
    one = found.groupBy("eps", "min_points").agg(
        F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("n_clusters"), F.avg((F.col("cluster") < 0).cast("double")).alias("noise_share"),
    )
    place = F.array_position(F.array(*[F.struct(F.lit(float(e)).alias("eps"), F.lit(m).alias("min_points")) for e, m in params]), F.struct("eps", "min_points"))
    good = (F.col("noise_share") < most_noise) & (F.col("n_clusters") > 0)
    # a row a pair of parameters: small whatever the table
    best = one.filter(good).agg(F.max_by(F.struct("eps", "min_points"), F.struct("n_clusters", -place)).alias("best"))
    return one.crossJoin(F.broadcast(best)).withColumn("chosen", F.coalesce(F.struct("eps", "min_points") == F.col("best"), F.lit(False))).drop("best")
