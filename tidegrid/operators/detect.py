"""Detection pipelines: fields to masks of features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import components, morphology, ranking, stencil
from tidegrid.operators.components import checkpointed


def features(
    field: DataFrame, value: str, height: int, width: int, window: int = 64, threshold: float = 90, mode: str = "local", rm_weak: float | None = None,
    sharpen: bool = False, thin: bool = True, min_size: int = 7, connectivity: int = 2, dilate: bool = False, despur: bool = False, longest_spur: int = 10,
) -> DataFrame:
    """Threshold, weak cells out, sharpening, thinning, cropping (if there is a least size), dilation, a last thinning if there was
    thinning or sharpening, spurs off: each step by its flag."""
    found = stencil.local_threshold(field, value, window, threshold) if mode == "local" else stencil.global_threshold(field, value, threshold)
    if rm_weak is not None:
        found = found.filter(F.col(value) > rm_weak)
    now = checkpointed(found.select("grid_id", "y", "x"))
    if sharpen:
        now = checkpointed(morphology.sharpened(components.label(now), field, value).select("grid_id", "y", "x"))
    if thin:
        now = checkpointed(morphology.thinned(now))
    if min_size > 0:
        now = checkpointed(morphology.cropped(now, height, width, min_size, connectivity))
    if dilate:
        now = morphology.dilated(now, height=height, width=width)
    if thin or sharpen:
        now = morphology.thinned(checkpointed(now))
    if despur:
        now = morphology.despurred(checkpointed(now), longest_spur)
    return now


def automatic(field: DataFrame, value: str, height: int, width: int, window: int = 64, threshold: float = 90, rounds: int = 2) -> dict[str, DataFrame]:
    """Smoothed field, Sobel gradient and features: the median filter until it settles, a buffer around the field's missing cells blanked,
    Sobel, the local threshold and the thinning chain."""
    smooth = checkpointed(stencil.iterated_median(field, value).join(field.select("grid_id", "y", "x", "lat"), ["grid_id", "y", "x"]))
    clear = stencil.buffered(field, value).select("grid_id", "y", "x", F.lit(True).alias("_clear"))
    # blanked cells stay in the table, so that the grid keeps its edges
    blanked = smooth.join(clear, ["grid_id", "y", "x"], "left").withColumn(value, F.when(F.col("_clear"), F.col(value))).drop("_clear")
    edge = checkpointed(stencil.sobel(blanked, value))
    mask = checkpointed(stencil.local_threshold(edge, "sobel", window, threshold).select("grid_id", "y", "x"))
    return {"filtered": smooth, "sobel": edge, "features": morphology.thinning_chain(mask, height, width, rounds)}


def sweep(field: DataFrame, value: str, percentiles: dict[str, float]) -> DataFrame:
    """Global thresholds of several configurations at once: (config, grid_id, y, x)."""
    spark = field.sparkSession
    configs = spark.createDataFrame(list(percentiles.items()), "config string, pct double")
    found = ranking.percentiles(field, value, list(percentiles.values()), "grid_id")
    cuts = found.select("grid_id", F.array(*[f"p{k}" for k in range(len(percentiles))]).alias("c"))
    names = F.array(*[F.lit(k) for k in percentiles])
    each = cuts.select("grid_id", F.explode(F.arrays_zip(names.alias("config"), F.col("c").alias("cut"))).alias("z")).select("grid_id", "z.config", "z.cut")
    return field.join(each.join(F.broadcast(configs.select("config")), "config"), "grid_id").filter(F.col(value) > F.col("cut")).select("config", "grid_id", "y", "x")
