"""Joint and one-dimensional histograms, conditional means, binned maps, densities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import ranking


def bin_of(value: Column, lo: float | Column, hi: float | Column, n: int) -> Column:
    """Bin 0 to n - 1, the last one closed; null outside."""
    lo, hi = (v if isinstance(v, Column) else F.lit(float(v)) for v in (lo, hi))
    k = F.floor((value - lo) / ((hi - lo) / n)).cast("int")
    return F.when((value >= lo) & (value <= hi), F.least(k, F.lit(n - 1)))


def percentile_range(df: DataFrame, value: str, clip: float = 1.0, symmetric: bool = False, floor: bool = True) -> tuple[float, float]:
    """Edges from the clip and 100 - clip percentiles; symmetric: around zero, else with floor from zero at the least."""
    lo, hi = ranking.percentiles(df, value, [clip, 100 - clip]).first()
    if symmetric:
        return -max(abs(lo), abs(hi)), max(abs(lo), abs(hi))
    return (max(0.0, lo) if floor else lo), hi


def joint(df: DataFrame, x: str, y: str, nx: int, ny: int, xr: tuple[float, float], yr: tuple[float, float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, bx, by_, n, pdf): counts and density of the pairs of finite values in range; the density sums to one over the area."""
    dx, dy = (xr[1] - xr[0]) / nx, (yr[1] - yr[0]) / ny
    cut = df.select(*by, bin_of(F.col(x), *xr, nx).alias("bx"), bin_of(F.col(y), *yr, ny).alias("by")).filter("bx is not null and by is not null")
    n = cut.groupBy(*by, "bx", "by").agg(F.count(F.lit(1)).alias("n"))
    # bins are few: their sum is joined back, as a window over all of them would be one task
    total = n.groupBy(*by).agg(F.sum("n").alias("all"))
    both = n.join(total, list(by)) if by else n.crossJoin(F.broadcast(total))
    return both.withColumn("pdf", F.col("n") / (F.col("all") * dx * dy)).drop("all")


def conditional_mean(df: DataFrame, x: str, y: str, value: str, nx: int, ny: int, xr: tuple[float, float], yr: tuple[float, float], min_count: int = 1, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean of a value by joint bin; null where fewer than min_count values are."""
    cut = df.select(*by, bin_of(F.col(x), *xr, nx).alias("bx"), bin_of(F.col(y), *yr, ny).alias("by"), F.col(value).alias("v")).filter("bx is not null and by is not null")
    return cut.groupBy(*by, "bx", "by").agg(F.count("v").alias("n"), F.sum("v").alias("s")).select(*by, "bx", "by", "n", F.when(F.col("n") >= min_count, F.col("s") / F.col("n")).alias("mean"))


def accumulate(per_snapshot: DataFrame) -> DataFrame:
    """Mean over snapshots of their densities, with pooled counts: (snapshot, bx, by, n, pdf) to (bx, by, n, pdf)."""
    k = per_snapshot.select("snapshot").distinct().agg(F.count(F.lit(1)).alias("k"))
    summed = per_snapshot.groupBy("bx", "by").agg(F.sum("n").alias("n"), F.sum("pdf").alias("p"))
    return summed.crossJoin(F.broadcast(k)).select("bx", "by", "n", (F.col("p") / F.col("k")).alias("pdf"))


def flow_regions(jpdf: DataFrame, vorticity: Column, strain: Column) -> DataFrame:
    """Shares of mass where vorticity beats strain (anticyclonic, cyclonic) or strain dominates."""
    region = F.when(vorticity < -strain, "AVD").when(vorticity > strain, "CVD").otherwise("SD")
    n = jpdf.groupBy(region.alias("region")).agg(F.sum("n").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("region", (F.col("n") / F.col("all")).alias("share"))


def binned_map(df: DataFrame, value: str, ny: int, nx: int, min_count: int = 1) -> DataFrame:
    """Mean and count by latitude and longitude bins of the globe."""
    cut = df.select(bin_of(F.col("lat"), -90, 90, ny).alias("by"), bin_of(F.col("lon"), -180, 180, nx).alias("bx"), F.col(value).alias("v"))
    got = cut.filter("by is not null and bx is not null").groupBy("by", "bx").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    return got.filter(F.col("n") >= min_count)


def log_joint(df: DataFrame, x: str, y: str, nx: int, ny: int, xr: tuple[float, float], yr: tuple[float, float]) -> DataFrame:
    """Joint histogram with bins of y even in its logarithm; density by the bins' real widths."""
    lo, hi = math.log10(yr[0]), math.log10(yr[1])
    cut = df.filter(F.col(y) > 0).select(bin_of(F.col(x), *xr, nx).alias("bx"), bin_of(F.log10(y), lo, hi, ny).alias("by")).filter("bx is not null and by is not null")
    n = cut.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    step = (hi - lo) / ny
    width = F.pow(F.lit(10.0), lo + (F.col("by") + 1) * step) - F.pow(F.lit(10.0), lo + F.col("by") * step)
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("all")))).select("bx", "by", "n", (F.col("n") / (F.col("all") * ((xr[1] - xr[0]) / nx) * width)).alias("pdf"))


def histogram(df: DataFrame, value: str, n: int, clip: float = 1.0) -> DataFrame:
    """(bin, lo, n, density) between the clip percentiles."""
    lo, hi = percentile_range(df, value, clip, floor=False)
    got = df.select(bin_of(F.col(value), lo, hi, n).alias("bin")).filter("bin is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    step = (hi - lo) / n
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("all")))).select("bin", (F.lit(lo) + F.col("bin") * step).alias("lo"), "n", (F.col("n") / (F.col("all") * step)).alias("density"))


def kernel_density(df: DataFrame, value: str, points: int, by: str | None = None) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at evenly spaced points: each row meets a fixed number of points, and the
    sums are partial aggregates."""
    one = df.agg(F.count(value).alias("n"), F.stddev_samp(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k")
    near = df.select(F.col(value).alias("v")).filter("v is not null").crossJoin(F.broadcast(one)).select("*", at)
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)
    h = F.col("s") * F.pow(F.col("n"), F.lit(-0.2))
    kernel = F.exp(-F.pow((x - F.col("v")) / h, 2) / 2) / (F.col("n") * h * math.sqrt(2 * math.pi))
    return near.groupBy("k").agg(F.first(x).alias("x"), F.sum(kernel).alias("density"))


def split_by_percentile(df: DataFrame, value: str, pct: float) -> DataFrame:
    """Adds part: weak or strong, by a percentile of another column over all rows."""
    cut = ranking.percentiles(df, value, [pct]).withColumnRenamed("p0", "_c")
    return df.crossJoin(F.broadcast(cut)).withColumn("part", F.when(F.col(value) >= F.col("_c"), "strong").when(F.col(value).isNotNull(), "weak")).drop("_c")


def matched_histogram(left: DataFrame, right: DataFrame, value: str, edges: int = 80, clip: float = 1.0) -> DataFrame:
    """(bin, lo, hi, n_left, n_right): the finite values of both sides over shared bins between `edges` even edges, from the clip
    percentile to the 100 - clip one of all of them; values outside are not counted, empty bins are."""
    each = [df.select(F.col(value).cast("double").alias("v"), F.lit(k).alias("side")) for k, df in enumerate((left, right))]
    both = each[0].unionByName(each[1]).filter("v is not null and not isnan(v) and abs(v) <> double('infinity')")
    cut = ranking.percentiles(both, "v", [clip, 100 - clip])
    n = edges - 1
    placed = both.crossJoin(F.broadcast(cut)).select("side", bin_of(F.col("v"), F.col("p0"), F.col("p1"), n).alias("bin")).filter("bin is not null")
    counts = placed.groupBy("bin").agg(F.count_if(F.col("side") == 0).alias("n_left"), F.count_if(F.col("side") == 1).alias("n_right"))
    bins = cut.filter("p0 is not null").select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    edge = lambda k: F.col("p0") + (F.col("p1") - F.col("p0")) * k / n
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return bins.join(counts, "bin", "left").select("bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"), count("n_left"), count("n_right"))
