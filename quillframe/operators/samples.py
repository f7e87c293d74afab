"""Rows for training: one per image or object, with all that belongs to it nested inside."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..dataset import Dataset, next_id
from .modify import insert, numbered


def image_samples(ds: Dataset, where_image: str | None = None, where_object: str | None = None) -> DataFrame:
    """imagefile, maskfile, width, height, name, score and objects (by id) of each image."""
    fields = ("objectid", "x1", "y1", "width", "height", "name", "score")
    kept = ds.where("objects", where_object).groupBy("imagefile").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("objects"))
    none = F.array().cast(kept.schema["objects"].dataType)
    return ds.where("images", where_image).join(kept, "imagefile", "left").select("imagefile", "maskfile", "width", "height", "name", "score", F.coalesce("objects", none).alias("objects"))


def object_samples(ds: Dataset, where_object: str | None = None) -> DataFrame:
    """The columns of each object and `properties`, a map; of values with one key the last by id counts."""
    last = ds.properties.filter("key is not null").groupBy("objectid", "key").agg(F.max_by("value", "id").alias("value"))
    maps = last.groupBy("objectid").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("properties"))
    none = F.create_map().cast("map<string,string>")
    return ds.where("objects", where_object).join(maps, "objectid", "left").select(*ds.objects.columns, F.coalesce("properties", none).alias("properties"))


def batches(samples: DataFrame, key: str, size: int, seed: int | None = None) -> DataFrame:
    """samples with `batch` and `place` in it: consecutive by key, or by hash of key and seed."""
    order = [F.col(key)] if seed is None else [F.xxhash64(key, F.lit(seed)), F.col(key)]
    n = numbered(samples, "__n", 0, *order)
    return n.withColumn("batch", F.floor(F.col("__n") / size)).withColumn("place", F.col("__n") % size).drop("__n")


def select_keys(samples: DataFrame, keys: list[str] | tuple[str, ...] | dict[str, str]) -> DataFrame:
    """The named columns in their order; a dict renames them."""
    named = keys if isinstance(keys, dict) else {k: k for k in keys}
    if unknown := [k for k in named if k not in samples.columns]:
        raise ValueError(f"samples have no {', '.join(unknown)}")
    return samples.select(*(F.col(k).alias(v) for k, v in named.items()))


def transformed(samples: DataFrame, transforms: Callable[[DataFrame], DataFrame] | dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One function of all samples, or one of each named column."""
    if callable(transforms):
        return transforms(samples)
    if unknown := [k for k in transforms if k not in samples.columns]:
        raise ValueError(f"samples have no {', '.join(unknown)}")
    return samples.withColumns({k: f(F.col(k)) for k, f in transforms.items()})


def iterate(batched: DataFrame) -> Iterator[list[Row]]:
    """The rows of each batch in order; the driver holds a partition at a time."""
    rows = batched.repartitionByRange("batch", "place").sortWithinPartitions("batch", "place").toLocalIterator(prefetchPartitions=True)
    for _, own in groupby(rows, key=lambda r: r["batch"]):
        yield list(own)


def add_records(ds: Dataset, records: Iterable[tuple[int, str, str]]) -> Dataset:
    """Adds properties (objectid, key, value), such as predictions made for samples; objects must exist."""
    rows = ds.spark.createDataFrame(list(records), "objectid long, key string, value string")
    return add_record_table(ds, rows)


def add_record_table(ds: Dataset, rows: DataFrame) -> Dataset:
    """add_records from a table of any size."""
    lost = rows.join(ds.objects, "objectid", "left_anti").select("objectid").limit(1).collect()
    if lost:
        raise KeyError(f"no object has the id {lost[0][0]}")
    return insert(ds, "properties", numbered(rows, "id", next_id(ds.properties, "id"), "objectid", "key", "value"))
