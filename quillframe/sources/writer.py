"""Building a dataset row by row, from a program that makes images and objects one after the other."""

from __future__ import annotations

import datetime
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import SCHEMAS, Dataset

_OBJECT = ("objectid", "imagefile", "x1", "y1", "width", "height", "name", "score")


class DatasetWriter:
    """Takes images, objects and matches as dicts, and hands them to Spark in parts of `flush` rows.

    With `ds`, rows are added to that dataset. An image whose imagefile is there already is passed over, as are repeats.
    """

    def __init__(self, spark: SparkSession, ds: Dataset | None = None, rootdir: str = ".", flush: int = 50_000):
        self.spark, self.flush = spark, flush
        self.base = ds if ds is not None else Dataset.empty(spark, rootdir)
        self._held: dict[str, list[tuple]] = {t: [] for t in ("images", "objects", "properties", "matches")}
        self._parts: dict[str, list[DataFrame]] = {t: [] for t in self._held}
        top = lambda t, c, none: none if (x := self.base.table(t).agg(F.max(c)).first()[0]) is None else x
        self._object, self._property, self._match, self._row = top("objects", "objectid", 0), top("properties", "id", 0), top("matches", "match", -1), top("matches", "id", 0)
        self._given: set[int] = set()

    def _add(self, table: str, row: tuple) -> None:
        held = self._held[table]
        held.append(row)
        if len(held) >= self.flush:
            self._parts[table].append(self.spark.createDataFrame(held, SCHEMAS[table]))
            self._held[table] = []

    @staticmethod
    def _check(name: str, value: object, kind: type | tuple[type, ...]) -> None:
        if value is not None and (not isinstance(value, kind) or isinstance(value, bool)):
            raise TypeError(f"{name} must be {getattr(kind, '__name__', kind)}, not {type(value).__name__}")

    def add_image(self, image: Mapping) -> str:
        """imagefile, width and height are needed; maskfile, timestamp (now by default), name and score may be there. Returns imagefile."""
        if not isinstance(image, Mapping):
            raise TypeError(f"an image is a dict, not {type(image).__name__}")
        for key in ("imagefile", "width", "height"):
            if image.get(key) is None:
                raise KeyError(f"{key} is needed")
        if unknown := set(image) - {"imagefile", "width", "height", "maskfile", "timestamp", "name", "score"}:
            raise ValueError(f"an image has no {', '.join(sorted(map(str, unknown)))}")
        for key, kind in (("imagefile", str), ("width", int), ("height", int), ("maskfile", str), ("timestamp", datetime.datetime), ("name", str), ("score", float)):
            self._check(key, image.get(key), kind)
        when = image.get("timestamp") or datetime.datetime.now()
        self._add("images", (image["imagefile"], image["width"], image["height"], image.get("maskfile"), when, image.get("name"), image.get("score")))
        return image["imagefile"]

    def add_object(self, obj: Mapping) -> int:
        """imagefile is needed; a box of whole numbers, name, score and objectid may be there; all else becomes properties. Returns objectid."""
        if not isinstance(obj, Mapping):
            raise TypeError(f"an object is a dict, not {type(obj).__name__}")
        if "imagefile" not in obj:
            raise KeyError("imagefile is needed")
        for key in ("x1", "y1", "width", "height"):
            self._check(key, obj.get(key), int)
        self._check("score", obj.get("score"), float)
        self._check("objectid", obj.get("objectid"), int)
        number = obj.get("objectid")
        if number is None:
            number = self._object + 1
        elif number in self._given:
            raise ValueError(f"objectid {number} is taken")
        self._given.add(number)
        self._object = max(self._object, number)
        box = (None if obj.get(k) is None else float(obj[k]) for k in ("x1", "y1", "width", "height"))
        self._add("objects", (number, obj["imagefile"], *box, obj.get("name"), obj.get("score")))
        for key in obj:
            if key not in _OBJECT:
                self._property += 1
                self._add("properties", (self._property, number, key, str(obj[key])))
        return number

    def add_match(self, objectid: int, match: int | None = None) -> int:
        """Puts an object into a match, or begins a new one. Returns the match."""
        self._check("objectid", objectid, int)
        if match is None:
            match = self._match + 1
        self._match, self._row = max(self._match, match), self._row + 1
        self._add("matches", (self._row, match, objectid))
        return match

    def dataset(self) -> Dataset:
        """The dataset with all that was added so far."""
        new = {}
        for table, held in self._held.items():
            rows = self.spark.createDataFrame(held, SCHEMAS[table])
            for part in self._parts[table]:
                rows = rows.unionByName(part)
            new[table] = rows
        taken = new["objects"].join(self.base.objects, "objectid", "left_semi").select("objectid").limit(1).collect()
        if taken:
            raise ValueError(f"objectid {taken[0][0]} is taken")
        first = new["images"].dropDuplicates(["imagefile"]).join(self.base.images.select("imagefile"), "imagefile", "left_anti").select(*self.base.images.columns)
        return self.base.with_(images=self.base.images.unionByName(first), **{t: self.base.table(t).unionByName(new[t]) for t in ("objects", "properties", "matches")})
