"""Operators that delete images or objects, with all that belongs to them.

A row goes only where its predicate is true: unknown (null) never deletes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.geometry import BOX, has_box, in_ring, overlap_area
from ..functions.paths import last_parts
from ..storage import written
from .pairs import near_boxes


def filter_images_via_another(ds: Dataset, ref: Dataset, level: int | None = None, keep: bool = False) -> Dataset:
    """Deletes images that the other dataset has (keep: those that it lacks); paths may be compared by their last `level` parts."""
    short = lambda df: df.select("imagefile", (F.col("imagefile") if level is None else last_parts(F.col("imagefile"), level)).alias("short"))
    mine, theirs = short(ds.images), short(ref.images).select("short").distinct()
    return ds.drop_images(mine.join(theirs, "short", "left_anti" if keep else "left_semi"))


def filter_images_without_objects(ds: Dataset, where_image: str | None = None) -> Dataset:
    return ds.drop_images(ds.where("images", where_image).join(ds.objects.select("imagefile").distinct(), "imagefile", "left_anti"))


def filter_images_sql(ds: Dataset, query: str, **others: Dataset) -> Dataset:
    """Deletes the images whose imagefile the query returns."""
    return ds.drop_images(ds.sql(query, **others))


def filter_bad_images(ds: Dataset, media: str | None = None) -> Dataset:
    """Deletes images whose image or mask file is missing or can't be decoded by Spark's image source."""
    root = (media or ds.rootdir).rstrip("/")
    read = ds.spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(root)
    good = read.filter("image.height > 0").select(F.expr(f"substring_index(image.origin, '{root}/', -1)").alias("file")).distinct()
    named = ds.images.select("imagefile", F.col("imagefile").alias("file")).union(ds.images.filter("maskfile is not null").select("imagefile", "maskfile"))
    return ds.drop_images(named.join(good, "file", "left_anti"))


def filter_objects_at_image_edges(ds: Dataset, threshold: float = 0.03) -> Dataset:
    """Deletes objects with a vertex (or, without polygons, a box side) in the margin of that share of the image."""
    vertices = ds.polygons.groupBy("objectid").agg(F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    sized = ds.images.select("imagefile", F.col("width").alias("w"), F.col("height").alias("h"))
    o = ds.objects.join(sized, "imagefile").join(vertices, "objectid", "left")
    near = lambda xa, xb, ya, yb, more: (xa < F.col("w") * threshold) | (ya < F.col("h") * threshold) | (xb > F.col("w") + more - F.col("w") * threshold) | (yb > F.col("h") + more - F.col("h") * threshold)
    c = F.col
    by_polygon = near(c("xa"), c("xb"), c("ya"), c("yb"), 0)
    by_box = near(c("x1"), c("x1") + c("width"), c("y1"), c("y1") + c("height"), 1)
    return ds.drop_objects(o.filter(F.when(c("xa").isNotNull(), by_polygon).otherwise(by_box)))


def overlapping_pairs(boxes: DataFrame) -> DataFrame:
    """Pairs a_..., b_... of different objects of an image whose boxes (imagefile, objectid, x1, y1, width, height) share an area, in both orders."""
    real = boxes.select("imagefile", "objectid", *BOX).filter("width > 0 and height > 0")
    return near_boxes(real, real).filter("a_objectid <> b_objectid").filter(overlap_area("a_", "b_") > 0)


def filter_objects_by_intersection(ds: Dataset, threshold: float = 0.1) -> Dataset:
    """Deletes objects of which another object of the image covers more than that share; both of two may go. A box without area goes."""
    boxes = ds.objects.filter(has_box()).select("imagefile", "objectid", "x1", "y1", "width", "height")
    covered = overlapping_pairs(boxes).filter(overlap_area("a_", "b_") > threshold * F.col("a_width") * F.col("a_height")).select(F.col("a_objectid").alias("objectid"))
    flat = boxes.filter("width * height <= 0").select("objectid")
    return ds.drop_objects(covered.union(flat))


def filter_objects_by_name(ds: Dataset, names: list[str], keep: bool = False) -> Dataset:
    listed = F.col("name").isin(names)
    return ds.drop_objects(ds.objects.filter(~listed if keep else listed))


def filter_objects_by_score(ds: Dataset, threshold: float = 0.5) -> Dataset:
    return ds.drop_objects(ds.objects.filter(F.col("score") < round(threshold, 6)))


def filter_objects_inside_certain_objects(ds: Dataset, where_shadowing: str, where_object: str | None = None, keep: bool = False) -> Dataset:
    """Deletes objects whose centre is inside a shadowing object of the image (keep: those whose centre isn't); shadows stay.

    The centre is the mean vertex, or the box's centre; centres meet only shadows whose box they lie in. Shadows with polygons are tested on whole-number vertices, border included,
    shadows without on their open box.
    """
    mean = ds.polygons.groupBy("objectid").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    shadows = ds.where("objects", where_shadowing).select("objectid", "imagefile", *BOX)
    ring = ds.polygons.groupBy("objectid").agg(F.array_sort(F.collect_list(F.struct("id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")))).alias("ring"))
    rings = shadows.select("objectid", "imagefile").join(ring, "objectid")
    around = {"x1": F.array_min("ring.x"), "y1": F.array_min("ring.y"), "width": F.array_max("ring.x") - F.array_min("ring.x"), "height": F.array_max("ring.y") - F.array_min("ring.y")}
    ringed = rings.select("objectid", "imagefile", *(v.cast("double").alias(c) for c, v in around.items()), F.lit(True).alias("ringed"))
    boxed = shadows.join(ring.select("objectid"), "objectid", "left_anti").withColumn("ringed", F.lit(False))
    objects = ds.where("objects", where_object).join(shadows.select("objectid"), "objectid", "left_anti").join(mean, "objectid", "left")
    centred = objects.select("objectid", "imagefile", F.coalesce("mx", F.expr("x1 + width / 2")).alias("cx"), F.coalesce("my", F.expr("y1 + height / 2")).alias("cy"))
    points = centred.select("objectid", "imagefile", F.col("cx").alias("x1"), F.col("cy").alias("y1"), F.lit(0.0).alias("width"), F.lit(0.0).alias("height"))
    near = near_boxes(written(points), written(ringed.unionByName(boxed)))
    open_box = F.expr("a_x1 > b_x1 and a_x1 < b_x1 + b_width and a_y1 > b_y1 and a_y1 < b_y1 + b_height")
    ringed_too = near.join(rings.select(F.col("objectid").alias("b_objectid"), "ring"), "b_objectid", "left")
    inside = ringed_too.filter(F.when(F.col("b_ringed"), in_ring("ring", "a_x1", "a_y1")).otherwise(open_box)).select(F.col("a_objectid").alias("objectid")).distinct()
    return ds.drop_objects(centred.join(inside, "objectid", "left_anti") if keep else inside)


def filter_objects_sql(ds: Dataset, query: str, keep: bool = False, **others: Dataset) -> Dataset:
    """Deletes (keep: keeps) the objects whose objectid the query returns."""
    found = ds.sql(query, **others).select("objectid").distinct()
    return ds.keep_objects(found) if keep else ds.drop_objects(found)
