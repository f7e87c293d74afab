"""Reports about a dataset; plots are returned as the small tables that they would show."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import TABLES, Dataset
from ..functions.paths import folder


def info(ds: Dataset) -> DataFrame:
    """One row of counts; width and height are null where images differ."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).alias(c)
    images = ds.images.agg(F.count("*").alias("images"), F.count("maskfile").alias("masks"), one("width"), one("height"))
    rest = [ds.objects.agg(F.count("*").alias("objects")), ds.properties.agg(F.count_distinct("key").alias("property_keys")), ds.matches.agg(F.count_distinct("match").alias("matches"))]
    for r in rest:
        images = images.crossJoin(r)  # one row each
    return images


def images_by_folder(ds: Dataset) -> DataFrame:
    return ds.images.groupBy(folder(F.col("imagefile")).alias("folder")).agg(F.count("*").alias("images"), F.count("maskfile").alias("masks"), F.count_distinct("width", "height").alias("sizes"))


def objects_by_image(ds: Dataset) -> DataFrame:
    """imagefile and its number of objects, images without objects included."""
    counts = ds.objects.groupBy("imagefile").agg(F.count("*").alias("n"))
    return ds.images.select("imagefile").join(counts, "imagefile", "left").select("imagefile", F.coalesce("n", F.lit(0)).alias("objects"))


def dump(ds: Dataset, limit: int | None = None) -> dict[str, DataFrame]:
    return {t: ds.table(t) if limit is None else ds.table(t).limit(limit) for t in TABLES}


def _numeric_if_possible(df: DataFrame, column: str) -> DataFrame:
    if dict(df.dtypes)[column] != "string":
        return df
    number = F.col(column).try_cast("double")
    failed = df.filter(F.col(column).isNotNull() & number.isNull()).isEmpty()
    return df.withColumn(column, number) if failed else df


def histogram(ds: Dataset, query: str, bins: int | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """x and n of a query of one column. bins: numbers are counted in so many equal parts of the limits (or of their range), x being a part's begin; the last part includes its end, and what lies outside is left out."""
    df = ds.sql(query)
    df = _numeric_if_possible(df.toDF("x").dropna(), "x")
    if bins is None:
        return df.groupBy("x").agg(F.count("*").alias("n"))
    df = df.select(F.col("x").try_cast("double").alias("x")).dropna()
    low, high = limits or df.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.groupBy("x").agg(F.count("*").alias("n"))
    step = (high - low) / bins or 1.0
    part = F.least(F.floor((F.col("x") - low) / step), F.lit(bins - 1))
    return df.filter((F.col("x") >= low) & (F.col("x") <= high)).groupBy((F.lit(float(low)) + part * step).alias("x")).agg(F.count("*").alias("n"))


def stacked_histogram(ds: Dataset, query: str) -> DataFrame:
    """x, series and n of a query of two columns."""
    df = _numeric_if_possible(ds.sql(query).toDF("x", "series").dropna(), "x")
    return df.groupBy("x", "series").agg(F.count("*").alias("n"))


def scatter(ds: Dataset, query: str) -> DataFrame:
    """The rows of a query of two columns, without nulls, as numbers where all are."""
    df = ds.sql(query).toDF("x", "y").dropna()
    return _numeric_if_possible(_numeric_if_possible(df, "x"), "y")


strip = scatter


def violin(ds: Dataset, query: str, shares: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """For each x the count and quantiles of y."""
    df = scatter(ds, query)
    return df.groupBy("x").agg(F.count("*").alias("n"), F.percentile(F.col("y").try_cast("double"), F.array(*map(F.lit, shares))).alias("quantiles"))


def violin_density(ds: Dataset, query: str, points: int = 100, bandwidth: float | None = None, cut: float = 2.0, bins: int = 4096) -> DataFrame:
    """x, y, density and n: for each x the Gaussian kernel density of y at evenly spaced points, from `cut` bandwidths below the least value to as much above the greatest.

    The bandwidth is Scott's (standard deviation of the sample times n ** -0.2) unless one is given; without any spread it is 1. Values are counted first. An x with more than
    `bins` different values has them shared out between the two nearest of so many even places, by how near they are; the sums at the
    points then run over counts, never over values.
    """
    df = scatter(ds, query).select("x", F.col("y").try_cast("double").alias("v")).dropna()
    counts = df.groupBy("x", "v").agg(F.count("*").cast("double").alias("w"))
    total, mean = F.sum("w"), F.sum(F.col("v") * F.col("w")) / F.sum("w")
    about = counts.groupBy("x").agg(total.alias("n"), F.count("*").alias("different"), mean.alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    spread = counts.join(about, "x").groupBy("x").agg(F.sum(F.col("w") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))).alias("squares"))
    wide = F.lit(float(bandwidth)) if bandwidth else F.sqrt(F.col("squares") / F.nullif(F.col("n") - 1, F.lit(0.0))) * F.pow("n", F.lit(-0.2))
    about = about.join(spread, "x").withColumn("h", F.when(wide > 0, wide).otherwise(1.0)).withColumn("step", (F.col("high") - F.col("low")) / bins).drop("squares", "mean")
    place = (F.col("v") - F.col("low")) / F.nullif("step", F.lit(0.0))
    k = F.floor(place)
    halves = F.array(F.struct((F.col("low") + k * F.col("step")).alias("v"), (F.col("w") * (1 - place + k)).alias("w")), F.struct((F.col("low") + (k + 1) * F.col("step")).alias("v"), (F.col("w") * (place - k)).alias("w")))
    own = F.array(F.struct("v", "w"))
    few = counts.join(about, "x").select("x", F.explode(F.when(F.col("different") > bins, halves).otherwise(own)).alias("c")).groupBy("x", "c.v").agg(F.sum("c.w").alias("w"))
    few = few.groupBy("x").agg(F.collect_list(F.struct("v", "w")).alias("c")).join(about, "x")  # bins + 2 places at most
    start, end = F.col("low") - cut * F.col("h"), F.col("high") + cut * F.col("h")
    at = few.withColumn("y", F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: start + (end - start) * i / (points - 1))))
    kernel = lambda a, c: a + c["w"] * F.exp(-0.5 * F.pow((F.col("y") - c["v"]) / F.col("h"), F.lit(2.0)))
    return at.select("x", "y", (F.aggregate("c", F.lit(0.0), kernel) / (F.col("n") * F.col("h") * (2 * math.pi) ** 0.5)).alias("density"), F.col("n").cast("long").alias("n"))
