"""Row numbers and exact percentiles of a whole table without one task that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.components import checkpointed


#: Rows of a range that are numbered by one task, and rows of a group whose percentiles are taken directly.
RANGE_ROWS, DIRECT_ROWS = 1_000_000, 2_000_000


def numbered_rows(df: DataFrame, *order: str, name: str = "k", parts: int | None = None) -> DataFrame:
    """Adds name: 1, 2, ... in the given order. Rows are cut into ranges of even size, in number with the rows, ranges are counted,
    and each range's numbers begin after those before it; only one row a range meets in one place."""
    if parts is None:
        df = checkpointed(df)
        parts = max(8, df.count() // RANGE_ROWS)
    cut = checkpointed(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    sizes = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return cut.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).join(F.broadcast(before), "_p").withColumn(
        name, F.col("_r") + F.col("_before")
    ).drop("_p", "_r", "_before")


def running_sum(df: DataFrame, keys: tuple[str, ...], order: str, value: str, name: str, most: int = RANGE_ROWS) -> DataFrame:
    """Adds name: within the keys, the sum of a value up to each row in the order of a column, nulls first; equal ones are one place. A table
    of more than `most` rows is cut into ranges of even size, and a range's sums begin after those before it: no window holds a key's
    rows."""
    parts = -(-df.count() // most)
    if parts <= 1:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())))
    cut = checkpointed(df.repartitionByRange(parts, *keys, F.col(order).asc_nulls_first()).withColumn("_p", F.spark_partition_id()))
    sums = cut.groupBy(*keys, "_p").agg(F.sum(value).alias("_s"))
    before = sums.select(*keys, "_p", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_s")).alias("_before"))
    run = F.sum(value).over(Window.partitionBy(*keys, "_p").orderBy(F.col(order).asc_nulls_first()))
    return cut.withColumn("_run", run).join(before, [*keys, "_p"]).withColumn(name, F.col("_run") + F.col("_before")).drop("_p", "_run", "_before")


def percentiles(df: DataFrame, value: str, pcts: list[float], *by: str, direct: int = DIRECT_ROWS, accuracy: int = 10_000) -> DataFrame:
    """(by, p0, p1, ...): exact percentiles of the present values of each group, interpolated between ranks; null where there are none.

    A group of more than `direct` rows is not brought together: quantile sketches, which are small and merge, bracket each rank within
    a few rows in `accuracy`; values below a bracket are counted, and only those within it are ordered, as distinct values."""
    names = [f"p{k}" for k in range(len(pcts))]
    some = df.select(*by, F.col(value).cast("double").alias("v")).filter("v is not null")
    sizes = checkpointed(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
    large = sizes.filter(F.col("n") > direct)
    least = large.agg(F.min("n")).first()[0]

    def whole(rows: DataFrame) -> DataFrame:
        got = rows.groupBy(*by).agg(F.percentile("v", F.array(*[F.lit(p / 100) for p in pcts])).alias("p"))
        return got.select(*by, *[F.get("p", F.lit(k)).alias(n) for k, n in enumerate(names)])

    if least is None:
        return whole(some)
    few = whole(some.join(large.select(*by), list(by), "left_anti")) if by else None
    some = some.join(large.select(*by), list(by), "left_semi") if by else some
    slack = 2.5 / accuracy + 3 / least
    ends = [min(1.0, max(0.0, p / 100 + s)) for p in pcts for s in (-slack, slack)]
    sketch = checkpointed(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", ends, accuracy).alias("e"), F.min("v").alias("least"), F.max("v").alias("most")))
    asked = sketch.select(*by, "n", F.posexplode(F.array(*[
        F.struct(
            (F.lit(p / 100) * (F.col("n") - 1)).alias("rank"),
            (F.col("least") if ends[2 * k] == 0 else F.get("e", F.lit(2 * k))).alias("lo"), (F.col("most") if ends[2 * k + 1] == 1 else F.get("e", F.lit(2 * k + 1))).alias("hi"),
        ) for k, p in enumerate(pcts)
    ])).alias("k", "a")).select(*by, "k", "a.*")
    near = some.join(F.broadcast(asked), list(by)) if by else some.crossJoin(F.broadcast(asked))
    counts = checkpointed(near.filter(F.col("v") <= F.col("hi")).groupBy(*by, "k", "rank", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("c")))
    placed = running_sum(counts, (*by, "k"), "v", "c", "upto")
    at = lambda r: F.min(F.when(F.col("upto") > r, F.struct("upto", "v")))["v"]
    both = placed.groupBy(*by, "k", "rank").agg(at(F.floor("rank")).alias("a"), at(F.ceil("rank")).alias("b"))
    got = both.select(*by, "k", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - F.floor("rank"))).alias("x"))
    each = checkpointed(got)
    if not each.filter("x is null").isEmpty():
        raise RuntimeError("a rank lies outside its bracket: raise the accuracy")
    out = each.groupBy(*by).agg(*[F.max(F.when(F.col("k") == k, F.col("x"))).alias(n) for k, n in enumerate(names)])
    return out if few is None else out.unionByName(few)
