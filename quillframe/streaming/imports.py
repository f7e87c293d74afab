"""A dataset that grows with a stream of annotations, in versions.

Events are rows of EVENT: images, objects, rings (a whole polygon each), properties and matches, in any order, some of them more than once. Objects are named by
the producer's `key`. The first event of an image, an object, a ring (of an object and name), a property (of an object and key) or a match (of a group
and object) counts, later ones are ignored; of several in one batch the smallest by value. An object gets its id when it is first seen, and keeps it: its key is its property SOURCE_KEY. Children that come
before their object wait in the version's table `pending`.

Each batch of the stream is one commit (see versions), which notes the stream's name and the batch. A batch that runs again after a failure
finds itself in the manifest and does nothing; one that died before its commit left nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..dataset import Dataset, next_id
from ..operators.modify import insert, numbered
from ..storage import written
from ..versions import commit, notes, open_table, open_version, versions

#: kind is image, object, ring, property or match. name: of an object, ring or property; value: of a property; match: the producer's name of a group.
EVENT = "kind string, key string, imagefile string, width int, height int, x1 double, y1 double, box_width double, box_height double, name string, score double, value string, match string, xs array<double>, ys array<double>"
SOURCE_KEY, SOURCE_MATCH = "source_key", "source_match"
CHILDREN = ("ring", "property", "match")


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each key, the same one however the rows come."""
    rest = [c for c in rows.columns if c not in by]
    return rows.groupBy(*by).agg(F.min(F.struct(*rest)).alias("r")).select(*by, "r.*") if rest else rows.distinct()


def keys_of(ds: Dataset) -> DataFrame:
    """key and objectid of all objects that a stream brought."""
    return ds.properties.filter(F.col("key") == SOURCE_KEY).select(F.col("value").alias("key"), "objectid")


def applied(ds: Dataset, pending: DataFrame | None, events: DataFrame) -> tuple[Dataset, DataFrame]:
    """The dataset with the events of a batch, and the children that still wait."""
    events = written(events.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in EVENT.split(", ")))))
    images = _first(events.filter("kind = 'image' and imagefile is not null").select("imagefile", "width", "height", "name", "score"), "imagefile").join(ds.images.select("imagefile"), "imagefile", "left_anti")
    ds = insert(ds, "images", images)

    keys = keys_of(ds)
    objects = events.filter("kind = 'object' and key is not null").select("key", "imagefile", "x1", "y1", F.col("box_width").alias("width"), F.col("box_height").alias("height"), "name", "score")
    new = numbered(_first(objects, "key").join(keys, "key", "left_anti"), "objectid", next_id(ds.objects, "objectid"), "key")
    ds = insert(ds, "objects", new)
    named = numbered(new.select("objectid", F.lit(SOURCE_KEY).alias("key"), F.col("key").alias("value")), "id", next_id(ds.properties, "id"), "objectid")
    ds = insert(ds, "properties", named)
    keys = written(keys.union(new.select("key", "objectid")))

    children = events.filter(F.col("kind").isin(*CHILDREN) & F.col("key").isNotNull())
    children = written(children if pending is None else children.unionByName(pending))
    known = children.join(keys, "key")
    waiting = children.join(keys, "key", "left_anti")

    rings = _first(known.filter("kind = 'ring'").select("objectid", "name", "xs", "ys"), "objectid", "name")
    there = ds.polygons.select(F.col("objectid").alias("o"), F.col("name").alias("n")).distinct()
    rings = rings.join(there, (F.col("objectid") == F.col("o")) & F.col("name").eqNullSafe(F.col("n")), "left_anti")
    vertices = rings.select("objectid", "name", F.posexplode(F.arrays_zip("xs", "ys")).alias("k", "p")).select("objectid", "name", "k", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"))
    ds = insert(ds, "polygons", numbered(vertices, "id", next_id(ds.polygons, "id"), "objectid", "name", "k"))

    properties = _first(known.filter("kind = 'property' and name is not null").select("objectid", F.col("name").alias("p"), "value"), "objectid", "p").withColumnRenamed("p", "key").join(ds.properties.select("objectid", "key"), ["objectid", "key"], "left_anti")
    ds = insert(ds, "properties", numbered(properties, "id", next_id(ds.properties, "id"), "objectid", "key"))

    # a match's group is named after the producer's in a property of each of its objects
    groups = known.filter("kind = 'match' and match is not null").select("objectid", "match").distinct()
    held = ds.properties.filter(F.startswith("key", F.lit(f"{SOURCE_MATCH}:"))).select(F.expr(f"substr(key, {len(SOURCE_MATCH) + 2})").alias("match"), "objectid", F.col("value").cast("long").alias("number"))
    groups = groups.join(held.select("match", "objectid"), ["match", "objectid"], "left_anti")
    numbers = held.select("match", "number").distinct()
    fresh = numbered(groups.select("match").distinct().join(numbers, "match", "left_anti"), "number", next_id(ds.matches, "match"), "match")
    members = written(groups.join(numbers.union(fresh.select("match", "number")), "match"))
    ds = insert(ds, "matches", numbered(members.select("objectid", F.col("number").alias("match")), "id", next_id(ds.matches, "id"), "match", "objectid"))
    notes_of = members.select("objectid", F.concat(F.lit(f"{SOURCE_MATCH}:"), "match").alias("key"), F.col("number").cast("string").alias("value"))
    return insert(ds, "properties", numbered(notes_of, "id", next_id(ds.properties, "id"), "objectid", "key")), waiting


def take(spark: SparkSession, path: str, stream: str, batch: int, events: DataFrame, rootdir: str = ".", keep: int | None = 3) -> int:
    """Commits a batch of a stream and returns the version that holds it; a batch that is there already is not taken again."""
    there = versions(spark, path)
    last = notes(spark, path, there[-1]).get("streams", {}) if there else {}
    if there and last.get(stream, -1) >= batch:
        return there[-1]
    ds = open_version(spark, path) if there else Dataset.empty(spark, rootdir)
    pending = open_table(spark, path, "pending") if there else None
    ds, waiting = applied(ds, pending, events)
    return commit(ds, path, there[-1] if there else 0, keep, {"pending": waiting.select(*(x.split(" ")[0] for x in EVENT.split(", ")))}, streams={**last, stream: batch})


def start(events: DataFrame, path: str, checkpoint: str, stream: str = "events", **how: object) -> StreamingQuery:
    """Runs the stream of events into the dataset's versions below path until what is there now is taken. A later call with the same checkpoint goes on from there."""
    run = lambda rows, batch: take(rows.sparkSession, path, stream, batch, rows, **how)
    return events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
