"""An annotation dataset: five DataFrames and the folder that image paths are relative to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.sql import register

SCHEMAS = {
    "images": "imagefile string, width int, height int, maskfile string, timestamp timestamp, name string, score double",
    "objects": "objectid long, imagefile string, x1 double, y1 double, width double, height double, name string, score double",
    "properties": "id long, objectid long, key string, value string",
    "polygons": "id long, objectid long, x double, y double, name string",
    "matches": "id long, match long, objectid long",
}
TABLES = tuple(SCHEMAS)
CHILDREN = ("properties", "polygons", "matches")


@dataclass(frozen=True)
class Dataset:
    images: DataFrame
    objects: DataFrame
    properties: DataFrame
    polygons: DataFrame
    matches: DataFrame
    rootdir: str = "."

    @classmethod
    def empty(cls, spark: SparkSession, rootdir: str = ".") -> Dataset:
        return cls(*(spark.createDataFrame([], s) for s in SCHEMAS.values()), rootdir)

    @classmethod
    def from_rows(cls, spark: SparkSession, rootdir: str = ".", **rows: list[tuple]) -> Dataset:
        """Tables from lists of tuples; tables not named are empty."""
        return cls(*(spark.createDataFrame(rows.get(t, []), s) for t, s in SCHEMAS.items()), rootdir)

    @classmethod
    def load(cls, spark: SparkSession, path: str, rootdir: str = ".") -> Dataset:
        return cls(*(spark.read.schema(s).parquet(f"{path}/{t}") for t, s in SCHEMAS.items()), rootdir)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        """Five Parquet tables; rows of one image or object lie together, so that later joins on them read few files."""
        near = {"images": "imagefile", "objects": "imagefile"}
        for t in TABLES:
            key = near.get(t, "objectid")
            self.table(t).repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode(mode).parquet(f"{path}/{t}")

    @property
    def spark(self) -> SparkSession:
        return self.images.sparkSession

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)

    def with_(self, **tables: DataFrame | str) -> Dataset:
        """A copy with some tables replaced, cut to their columns and types."""
        cut = {k: (_typed(v, SCHEMAS[k]) if k in SCHEMAS else v) for k, v in tables.items()}
        return replace(self, **cut)

    def views(self, prefix: str = "") -> None:
        """Registers the tables as temporary views for SQL."""
        for f in fields(self):
            if f.name in TABLES:
                self.table(f.name).createOrReplaceTempView(prefix + f.name)

    def sql(self, query: str, **others: Dataset) -> DataFrame:
        """A SELECT over the tables; those of other datasets are named with their key as prefix (`ref_objects`). It can call the functions of functions.sql."""
        register(self.spark)
        self.views()
        for prefix, other in others.items():
            other.views(f"{prefix}_")
        return self.spark.sql(query)

    def where(self, table: str, condition: str | Column | None) -> DataFrame:
        """Rows of a table for which the condition is true; its columns may be written with the table's name."""
        df = self.table(table).alias(table)
        return df if condition is None else df.filter(F.expr(condition) if isinstance(condition, str) else condition)

    def __len__(self) -> int:
        """The number of images."""
        return self.images.count()

    def __getitem__(self, n: int) -> Dataset:
        """The n-th image by path, with all that belongs to it."""
        if n < 0:
            raise IndexError("images count from 0")
        one = self.images.select("imagefile").orderBy("imagefile").offset(n).limit(1)
        if one.isEmpty():
            raise IndexError(f"there is no image {n}")
        out = self.keep_images(one)
        return out.keep_objects(out.objects.join(one, "imagefile", "left_semi"))

    def then(self, operator: Callable, *args: object, **kwargs: object) -> object:
        """operator(self, ...): chains of operators read from left to right, and run when a result is asked for."""
        return operator(self, *args, **kwargs)

    def drop_objects(self, gone: DataFrame) -> Dataset:
        """Without the objects in gone (objectid) and all that belongs to them."""
        ids = gone.select("objectid").distinct()
        return self.with_(**{t: self.table(t).join(ids, "objectid", "left_anti") for t in ("objects", *CHILDREN)})

    def keep_objects(self, kept: DataFrame) -> Dataset:
        ids = kept.select("objectid").distinct()
        return self.drop_objects(self.objects.join(ids, "objectid", "left_anti"))

    def drop_images(self, gone: DataFrame) -> Dataset:
        """Without the images in gone (imagefile) and all their objects."""
        files = gone.select("imagefile").distinct()
        out = self.drop_objects(self.objects.join(files, "imagefile", "left_semi"))
        return out.with_(images=self.images.join(files, "imagefile", "left_anti"))

    def keep_images(self, kept: DataFrame) -> Dataset:
        files = kept.select("imagefile").distinct()
        return self.drop_images(self.images.join(files, "imagefile", "left_anti"))


def _typed(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in schema.split(", "))))


def next_id(df: DataFrame, column: str, first: int = 1) -> int:
    """One more than the largest id, or `first` for an empty table."""
    top = df.agg(F.max(column)).first()[0]
    return first if top is None else top + 1
