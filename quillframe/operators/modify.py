"""Operators that change coordinates, names, paths and ids within one dataset."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import CHILDREN, SCHEMAS, Dataset, next_id
from ..functions import paths
from ..functions.geometry import BOX, box_corners, clip_ring, has_box
from ..storage import written
from .pairs import merged_clusters, shapes


def numbered(df: DataFrame, column: str, first: int, *order: str | Column) -> DataFrame:
    """df with ids first, first + 1, ... in the given unique order.

    Rows are sorted into range partitions; a count of each partition then gives its first number, so no task sees all rows.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = written(placed)  # a part that is made again could be cut elsewhere
    counts = placed.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    offsets = counts.select("__part", before.alias("__before"))
    return placed.join(F.broadcast(offsets), "__part").withColumn(column, F.lit(first) + F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def update(ds: Dataset, table: str, assign: dict[str, str], where: str = "true") -> Dataset:
    """UPDATE table SET ... WHERE: values and condition are SQL expressions over the row before the update."""
    df = ds.table(table)
    hit = F.coalesce(F.expr(where), F.lit(False))
    new = {c: F.when(hit, F.expr(e)).otherwise(F.col(c)) for c, e in assign.items()}
    return ds.with_(**{table: df.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))})


def delete(ds: Dataset, table: str, where: str = "true") -> Dataset:
    """DELETE FROM table WHERE, without cascades."""
    return ds.with_(**{table: ds.table(table).filter(~F.coalesce(F.expr(where), F.lit(False)))})


def insert(ds: Dataset, table: str, rows: DataFrame) -> Dataset:
    """INSERT INTO table: columns that rows lack become null."""
    types = dict(x.split(" ") for x in SCHEMAS[table].split(", "))
    return ds.with_(**{table: ds.table(table).union(rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items())))})


def bboxes_to_polygons(ds: Dataset) -> Dataset:
    """Objects without vertices get their box's corners as polygon `bounding box`; those without a box stay as they are."""
    bare = ds.objects.filter(has_box()).join(ds.polygons.select("objectid"), "objectid", "left_anti")
    corners = bare.select("objectid", F.posexplode(box_corners(*map(F.col, BOX))).alias("k", "p"))
    made = numbered(corners, "id", next_id(ds.polygons, "id"), "objectid", "k")
    return insert(ds, "polygons", made.select("id", "objectid", "p.x", "p.y", F.lit("bounding box").alias("name")))


def polygons_to_bboxes(ds: Dataset) -> Dataset:
    """Objects with vertices get the box around all of them."""
    around = ds.polygons.groupBy("objectid").agg(*(f(c).alias(n) for c, f, n in (("x", F.min, "xa"), ("x", F.max, "xb"), ("y", F.min, "ya"), ("y", F.max, "yb"))))
    o = ds.objects.join(around, "objectid", "left")
    has = F.col("xa").isNotNull()
    new = {"x1": "xa", "y1": "ya", "width": "xb - xa", "height": "yb - ya"}
    return ds.with_(objects=o.withColumns({c: F.when(has, F.expr(e)).otherwise(F.col(c)) for c, e in new.items()}))


def expand_objects(ds: Dataset, fraction: float, ratio: float | None = None) -> Dataset:
    """Boxes and polygons grow about their centres by that share; with a ratio (height / width) the short side grows to it first, which counts."""
    if fraction < -0.5:
        raise ValueError("a fraction below -0.5 would turn objects inside out")
    f = F.lit(float(fraction))

    def grown(low: Column, size: Column, more: Column) -> tuple[Column, Column]:
        return low - size * more / 2, size * (1 + more)

    def factors(width: Column, height: Column) -> tuple[Column, Column]:
        """By how much width and height grow in all."""
        if ratio is None:
            return f, f
        tall = height / width < ratio
        used = F.when(tall, width * ratio / height - 1).otherwise(height / width / ratio - 1)
        rest = F.greatest(f - used, F.lit(0.0))
        short, other = (1 + used) * (1 + rest) - 1, rest
        return F.when(tall, other).otherwise(short), F.when(tall, short).otherwise(other)

    more_x, more_y = factors(F.col("width"), F.col("height"))
    x1, width = grown(F.col("x1"), F.col("width"), more_x)
    y1, height = grown(F.col("y1"), F.col("height"), more_y)
    ok = has_box() & (F.col("width") > 0) & (F.col("height") > 0) if ratio else has_box()
    new = {"x1": x1, "y1": y1, "width": width, "height": height}
    objects = ds.objects.select(*((F.when(ok, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in ds.objects.columns))
    around = ds.polygons.groupBy("objectid").agg(F.min("x").alias("xa"), F.max("x").alias("xb"), F.min("y").alias("ya"), F.max("y").alias("yb"))
    p = ds.polygons.join(around, "objectid")
    px, py = factors(F.expr("nullif(xb - xa, 0)"), F.expr("nullif(yb - ya, 0)"))
    move = lambda v, a, b, k: (F.col(a) + F.col(b)) / 2 + (F.col(v) - (F.col(a) + F.col(b)) / 2) * (1 + F.coalesce(k, f))
    return ds.with_(objects=objects, polygons=p.select("id", "objectid", move("x", "xa", "xb", px).alias("x"), move("y", "ya", "yb", py).alias("y"), "name"))


def move_media(ds: Dataset, image_path: str | None = None, mask_path: str | None = None, level: int = 1, where_image: str | None = None) -> Dataset:
    """New paths: the given folder and the last `level` parts. An image whose new path another image has already goes, with its objects; of several the first by old path stays."""
    moved = ds.where("images", where_image).select("imagefile").distinct().withColumn("moves", F.lit(True))
    images = ds.images.join(moved, "imagefile", "left")
    there = lambda folder, c: F.when(F.col("moves") & F.col(c).isNotNull(), F.concat_ws("/", F.lit(folder), paths.last_parts(F.col(c), level))).otherwise(F.col(c))
    images = images.withColumn("new", there(image_path, "imagefile") if image_path else F.col("imagefile")).withColumn("newmask", there(mask_path, "maskfile") if mask_path else F.col("maskfile"))
    rank = F.row_number().over(Window.partitionBy("new").orderBy(F.col("new").eqNullSafe(F.col("imagefile")).desc(), "imagefile"))
    ranked = images.withColumn("rank", rank)
    lost = ranked.filter("rank > 1 and new is not null").select("imagefile")
    kept = ranked.filter("rank = 1 or new is null")
    out = ds.drop_objects(ds.objects.join(lost, "imagefile", "left_semi"))
    names = kept.select("imagefile", "new").filter("imagefile is not null")
    objects = out.objects.join(names, "imagefile", "left").withColumn("imagefile", F.coalesce("new", "imagefile"))
    return out.with_(images=kept.withColumns({"imagefile": F.col("new"), "maskfile": F.col("newmask")}), objects=objects)


def move_rootdir(ds: Dataset, new_rootdir: str, cwd: str = "/") -> Dataset:
    """Paths that were relative to the old root become relative to the new one; relative roots are below `cwd`."""
    import posixpath

    old, new = (posixpath.normpath(posixpath.join(cwd, r)) for r in (ds.rootdir, new_rootdir))
    far = lambda c: F.when(F.col(c).isNotNull(), paths.relative(paths.normal(F.concat(F.lit(old + "/"), F.col(c))), new))
    images = ds.images.withColumns({"imagefile": far("imagefile"), "maskfile": far("maskfile")})
    return ds.with_(images=images, objects=ds.objects.withColumn("imagefile", far("imagefile")), rootdir=new_rootdir)


def rename_objects(ds: Dataset, names: dict[str, str], discard_other: bool = False, where_object: str = "true") -> Dataset:
    """Renames one after the other, so that a name may change more than once; discard_other deletes objects that have none of the names."""
    name = F.col("name")
    for old, new in names.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    hit = F.coalesce(F.expr(where_object), F.lit(False))
    out = ds.with_(objects=ds.objects.withColumn("name", F.when(hit, name).otherwise(F.col("name"))))
    if discard_other:
        gone = ds.objects.filter(hit & ~F.col("name").isin([*names, *names.values()]))
        out = out.drop_objects(gone)
    return out


def resize_annotations(ds: Dataset, width: int | None = None, height: int | None = None, where_image: str | None = None) -> Dataset:
    """Scales boxes and vertices to new image sizes (one size given: the ratio stays), cut to whole numbers. Images that share a mask must be of one size."""
    if width is None and height is None:
        raise ValueError("give a width, a height or both")
    check_mask_sizes(ds)
    scaled = ds.where("images", where_image).select("imagefile", F.col("width").alias("w"), F.col("height").alias("h"))
    kx = F.lit(width) / F.col("w") if width is not None else F.lit(height) / F.col("h")
    ky = F.lit(height) / F.col("h") if height is not None else F.lit(width) / F.col("w")
    scaled = scaled.select("imagefile", kx.alias("kx"), ky.alias("ky"))
    cut = lambda c, k: F.when(F.col(k).isNotNull(), (F.col(c) * F.col(k)).cast("long").cast("double")).otherwise(F.col(c))
    objects = ds.objects.join(scaled, "imagefile", "left")
    of_object = objects.filter("kx is not null").select("objectid", "kx", "ky")
    polygons = ds.polygons.join(of_object, "objectid", "left")
    size = lambda c, k: F.when(F.col(k).isNotNull(), F.round(F.col(c) * F.col(k)).cast("int")).otherwise(F.col(c))
    return ds.with_(
        images=ds.images.join(scaled, "imagefile", "left").withColumns({"width": size("width", "kx"), "height": size("height", "ky")}),
        objects=objects.withColumns({c: cut(c, k) for c, k in (("x1", "kx"), ("y1", "ky"), ("width", "kx"), ("height", "ky"))}),
        polygons=polygons.withColumns({"x": cut("x", "kx"), "y": cut("y", "ky")}),
    )


def check_mask_sizes(ds: Dataset) -> None:
    """Raises an error if images of different sizes share a mask."""
    sizes = ds.images.filter("maskfile is not null").groupBy("maskfile").agg(F.count_distinct("width").alias("w"), F.count_distinct("height").alias("h")).filter("w > 1 or h > 1")
    if bad := [r.maskfile for r in sizes.orderBy("maskfile").limit(5).collect()]:
        raise ValueError(f"images of different sizes share a mask, such as {', '.join(bad)}")


def invalid_objects(ds: Dataset) -> DataFrame:
    """objectid and what is wrong: a box that is known in part, or of negative size, or a polygon of fewer than three vertices or with unknown ones."""
    known = sum((F.col(c).isNotNull().cast("int") for c in BOX), F.lit(0))
    boxes = ds.objects.select("objectid", F.when((known > 0) & (known < 4), "part of a box").when((F.col("width") < 0) | (F.col("height") < 0), "negative size").alias("fault"))
    rings = ds.polygons.groupBy("objectid", "name").agg(F.count("*").alias("n"), F.count_if(F.expr("x is null or y is null")).alias("unknown"))
    polygons = rings.select("objectid", F.when(F.col("unknown") > 0, "unknown vertex").when(F.col("n") < 3, "fewer than three vertices").alias("fault"))
    return boxes.union(polygons).filter("fault is not null").distinct()


def property_to_objects_field(ds: Dataset, field: str, key: str) -> Dataset:
    """Copies a property's value (the first by id) into a column of objects; as `objectid` it renumbers objects in all tables."""
    value = ds.properties.filter(F.col("key") == key).groupBy("objectid").agg(F.min_by("value", "id").alias("v"))
    if value.isEmpty():
        raise ValueError(f"no property has the key {key}")
    kind = dict(x.split(" ") for x in SCHEMAS["objects"].split(", "))[field]
    value = value.select("objectid", F.col("v").try_cast(kind).alias("v"))
    if field != "objectid":
        o = ds.objects.join(value, "objectid", "left")
        has = value.select("objectid", F.lit(True).alias("has"))
        return ds.with_(objects=o.join(has, "objectid", "left").withColumn(field, F.when(F.col("has"), F.col("v")).otherwise(F.col(field))))
    ids = ds.objects.select("objectid").join(value, "objectid", "left").select("objectid", F.coalesce("v", "objectid").alias("new"))
    if not ids.groupBy("new").count().filter("count > 1").isEmpty():
        raise ValueError("new object ids would not be unique")
    changed = lambda df: df.join(ids, "objectid", "left").withColumn("objectid", F.coalesce("new", "objectid"))
    return ds.with_(**{t: changed(ds.table(t)) for t in ("objects", *CHILDREN)})


TRANSFORM = ("kx", "ky", "bx", "by")


def object_transforms(ds: Dataset) -> DataFrame:
    """objectid and its affine transform x' = kx x + bx, y' = ky y + by, as kept in properties; objects without one have none."""
    of = lambda k, default: F.coalesce(F.max(F.when(F.col("key") == k, F.col("value").try_cast("double"))), F.lit(default)).alias(k)
    return ds.properties.filter(F.col("key").isin(*TRANSFORM)).groupBy("objectid").agg(of("kx", 1.0), of("ky", 1.0), of("bx", 0.0), of("by", 0.0))


def update_object_transform(ds: Dataset, change: DataFrame) -> Dataset:
    """Composes objects' transforms with a further one (objectid, kx, ky, bx, by), which is applied after what is there."""
    now = object_transforms(ds).select("objectid", *(F.col(c).alias("o" + c) for c in TRANSFORM))
    c = change.join(now, "objectid", "left")
    old = lambda n, d: F.coalesce("o" + n, F.lit(d))
    new = c.select("objectid", (F.col("kx") * old("kx", 1.0)).alias("kx"), (F.col("ky") * old("ky", 1.0)).alias("ky"), (F.col("kx") * old("bx", 0.0) + F.col("bx")).alias("bx"), (F.col("ky") * old("by", 0.0) + F.col("by")).alias("by"))
    rows = new.select("objectid", F.explode(F.array(*(F.struct(F.lit(t).alias("key"), F.col(t).cast("string").alias("value")) for t in TRANSFORM))).alias("p")).select("objectid", "p.key", "p.value")
    kept = ds.properties.join(rows.select("objectid", "key"), ["objectid", "key"], "left_anti")
    return insert(ds.with_(properties=kept), "properties", numbered(rows, "id", next_id(ds.properties, "id"), "objectid", "key"))


def revert_object_transforms(ds: Dataset) -> Dataset:
    """Takes boxes, vertices and image paths back to before their transforms, and forgets those."""
    t = object_transforms(ds)
    old = ds.properties.filter("key = 'old_imagefile'").groupBy("objectid").agg(F.min_by("value", "id").alias("old"))
    back = lambda c, k, b: F.when(F.col(k).isNotNull(), (F.col(c) - F.col(b)) / F.col(k)).otherwise(F.col(c))
    scale = lambda c, k: F.when(F.col(k).isNotNull(), F.col(c) / F.col(k)).otherwise(F.col(c))
    o = ds.objects.join(t, "objectid", "left").join(old, "objectid", "left")
    objects = o.withColumns({"x1": back("x1", "kx", "bx"), "y1": back("y1", "ky", "by"), "width": scale("width", "kx"), "height": scale("height", "ky"), "imagefile": F.coalesce("old", "imagefile")})
    p = ds.polygons.join(t, "objectid", "left")
    gone = F.col("key").isin(*TRANSFORM, "old_objectid", "old_imagefile")
    return ds.with_(objects=objects, polygons=p.withColumns({"x": back("x", "kx", "bx"), "y": back("y", "ky", "by")}), properties=ds.properties.filter(~F.coalesce(gone, F.lit(False))))


#: Room for the vertices of a ring in the order of an object's clipped rings.
RING = 1 << 32


def clip_objects(ds: Dataset, keep_num_vertices: bool = False) -> Dataset:
    """Boxes and polygons are cut at the image's borders; polygons wholly outside go. Of a polygon that falls into several
    rings, those after the first are named after it with `_part2` and so on. keep_num_vertices moves vertices onto the border instead of cutting edges."""
    sized = ds.images.select("imagefile", F.col("width").alias("w"), F.col("height").alias("h"))
    o = ds.objects.join(sized, "imagefile", "left")
    ok = has_box() & F.col("w").isNotNull() & F.col("h").isNotNull()
    zero = F.lit(0.0)
    x1 = F.greatest(zero, F.least("x1", F.col("w").cast("double")))
    y1 = F.greatest(zero, F.least("y1", F.col("h").cast("double")))
    width = F.greatest(zero, F.least(F.col("width") - x1 + F.col("x1"), F.col("w") - x1))
    height = F.greatest(zero, F.least(F.col("height") - y1 + F.col("y1"), F.col("h") - y1))
    new = {"x1": x1, "y1": y1, "width": width, "height": height}
    objects = o.select(*((F.when(ok, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in ds.objects.columns))
    frame = ds.objects.join(sized, "imagefile").select("objectid", "w", "h")
    p = ds.polygons.join(frame, "objectid", "left")
    out_of = F.expr("x < 0 or y < 0 or x > w or y > h")
    rings = p.groupBy("objectid", "name").agg(F.bool_or(F.coalesce(out_of, F.lit(False))).alias("cut"), F.max("x").alias("xb"), F.min("x").alias("xa"), F.max("y").alias("yb"), F.min("y").alias("ya"))
    touched = rings.filter("cut").select(F.col("objectid").alias("o"), F.col("name").alias("n"), "xa", "xb", "ya", "yb")
    same = (F.col("objectid") == F.col("o")) & F.col("name").eqNullSafe(F.col("n"))
    whole = p.join(touched, same, "left_anti")
    cut = p.join(touched, same).drop("o", "n")
    if keep_num_vertices:
        inside = cut.filter("xb >= 0 and yb >= 0 and xa <= w and ya <= h")
        polygons = whole.select(*ds.polygons.columns).union(inside.select("id", "objectid", F.expr("greatest(0D, least(x, w))"), F.expr("greatest(0D, least(y, h))"), "name"))
        return ds.with_(objects=objects, polygons=polygons)

    points = F.array_sort(F.collect_list(F.struct("id", "x", "y")))
    outline = cut.groupBy("objectid", "name").agg(points.alias("p"), F.first("w").cast("double").alias("w"), F.first("h").cast("double").alias("h"))
    outline = outline.select("objectid", "name", "w", "h", F.transform("p", lambda v: v["x"]).alias("xs"), F.transform("p", lambda v: v["y"]).alias("ys"))

    def clip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("objectid", "k", "x", "y", "name")}
            for r in b.to_pylist():
                for n, ring in enumerate(clip_ring(np.column_stack([r["xs"], r["ys"]]), r["w"], r["h"])):
                    out["objectid"] += [r["objectid"]] * len(ring)
                    out["k"] += range(n * RING, n * RING + len(ring))
                    out["x"] += ring[:, 0].tolist()
                    out["y"] += ring[:, 1].tolist()
                    out["name"] += [r["name"] if not n else f"{r['name'] or ''}_part{n + 1}"] * len(ring)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=list(out))

    clipped = outline.mapInArrow(clip, "objectid long, k long, x double, y double, name string")
    made = numbered(clipped, "id", next_id(ds.polygons, "id"), "objectid", "name", "k")
    return ds.with_(objects=objects, polygons=whole.select(*ds.polygons.columns).union(made.select(*ds.polygons.columns)))


def merge_intersecting_objects(ds: Dataset, threshold: float = 0.5, where_image: str | None = None, where_object: str | None = None) -> Dataset:
    """Within an image, merges objects whose polygons overlap; see merge_groups for what a merged object is. Objects without box and vertices stay apart."""
    ds = bboxes_to_polygons(polygons_to_bboxes(ds))
    images = ds.where("images", where_image).select("imagefile")
    objects = ds.where("objects", where_object).select("objectid", "imagefile").join(images, "imagefile", "left_semi")
    rows = objects.join(ds.polygons.select("id", "objectid", "x", "y", F.coalesce("name", F.lit("")).alias("name")), "objectid")
    return merge_groups(ds, merged_clusters(shapes(rows), threshold))


def merge_groups(ds: Dataset, groups: DataFrame) -> Dataset:
    """Merges objects (objectid, keep: the smallest id of its group).

    The kept object gets the box around all, the single non-null name and score of the group if there is just one (else all as
    `merged_name` and `merged_score`), all vertices (polygons renamed to name and old id), properties whose key has one value, and
    `is_merged`. Matches within a group go, others point to the kept object once.
    """
    groups = written(groups)
    o = ds.objects.join(groups, "objectid")
    distinct = lambda c: F.count_distinct(c)
    made = o.groupBy("keep").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max(F.expr("x1 + width")).alias("x2"), F.max(F.expr("y1 + height")).alias("y2"), F.count("name").alias("names"), F.max("name").alias("one_name"), F.count("score").alias("scores"), F.max("score").alias("one_score"))
    kept = ds.objects.join(made.select(F.col("keep").alias("objectid"), F.col("x1").alias("nx"), F.col("y1").alias("ny"), "x2", "y2", "names", "one_name", "scores", "one_score"), "objectid")
    kept = kept.withColumns({"x1": F.coalesce("nx", "x1"), "y1": F.coalesce("ny", "y1"), "width": F.coalesce(F.expr("x2 - nx"), F.col("width")), "height": F.coalesce(F.expr("y2 - ny"), F.col("height")), "name": F.when(F.col("names") == 1, F.col("one_name")).otherwise(F.col("name")), "score": F.when(F.col("scores") == 1, F.col("one_score")).otherwise(F.col("score"))})
    objects = ds.objects.join(groups, "objectid", "left_anti").unionByName(kept.select(*ds.objects.columns))
    polygons = ds.polygons.join(groups, "objectid", "left").withColumns({"name": F.when(F.col("keep").isNotNull(), F.concat(F.coalesce("name", F.lit("")), F.col("objectid").cast("string"))).otherwise(F.col("name")), "objectid": F.coalesce("keep", "objectid")})
    p = ds.properties.join(groups, "objectid", "left")
    clash = p.filter("keep is not null").groupBy("keep", "key").agg(distinct("value").alias("values")).filter("values > 1").select(F.col("keep").alias("k"), F.col("key").alias("q"))
    mine = p.filter("keep is not null").join(clash, (F.col("keep") == F.col("k")) & (F.col("key") == F.col("q")), "left_anti")
    once = mine.groupBy(F.col("keep").alias("objectid"), "key", "value").agg(F.min("id").alias("id"))
    extra = made.select(F.col("keep").alias("objectid"), F.lit("is_merged").alias("key"), F.lit("1").alias("value"))
    for column, count in (("name", "names"), ("score", "scores")):
        several = made.filter(F.col(count) > 1).select("keep")
        extra = extra.union(o.join(several, "keep", "left_semi").filter(F.col(column).isNotNull()).select("keep", F.lit(f"merged_{column}"), F.col(column).cast("string")))
    extra = numbered(extra.distinct(), "id", next_id(ds.properties, "id"), "objectid", "key", "value")
    columns = ds.properties.columns
    properties = p.filter("keep is null").select(*columns).union(once.select(*columns)).union(extra.select(*columns))
    m = ds.matches.join(groups, "objectid", "left")
    inner = m.groupBy("match").agg(F.count_distinct(F.coalesce("keep", "objectid")).alias("n"), F.bool_or(F.col("keep").isNotNull()).alias("any"))
    dead = inner.filter("any and n = 1").select("match")
    matches = m.join(dead, "match", "left_anti").withColumn("objectid", F.coalesce("keep", "objectid")).groupBy("match", "objectid").agg(F.min("id").alias("id"))
    return ds.with_(objects=objects, polygons=polygons, properties=properties, matches=matches)


def upgrade_whole_numbers(ds: Dataset) -> Dataset:
    """Casts tables with whole-number coordinates of older datasets to today's types; a second call changes nothing."""
    return ds.with_(**{t: ds.table(t) for t in SCHEMAS})


def set_image_name(ds: Dataset, imagefile: str, name: str | None) -> Dataset:
    hit = F.col("imagefile") == imagefile
    return ds.with_(images=ds.images.withColumn("name", F.when(hit, F.lit(name)).otherwise(F.col("name"))))


def unname_object(ds: Dataset, objectid: int) -> Dataset:
    return ds.with_(objects=ds.objects.withColumn("name", F.when(F.col("objectid") == objectid, F.lit(None)).otherwise(F.col("name"))))


def set_property(ds: Dataset, objectid: int, key: str, value: str | None) -> Dataset:
    """One value for the key, or none if value is None."""
    hit = F.coalesce((F.col("objectid") == objectid) & (F.col("key") == key), F.lit(False))
    out = ds.with_(properties=ds.properties.filter(~hit))
    if value is None:
        return out
    return insert(out, "properties", ds.spark.createDataFrame([(next_id(ds.properties, "id"), objectid, key, value)], SCHEMAS["properties"]))


def add_match(ds: Dataset, first: int, second: int) -> Dataset:
    """Joins two objects' groups, or adds one object to the other's group, or makes a new group of both."""
    top = lambda o: ds.matches.filter(F.col("objectid") == o).agg(F.min("match")).first()[0]
    a, b = top(first), top(second)
    if a is not None and b is not None:
        return ds.with_(matches=ds.matches.withColumn("match", F.when(F.col("match") == b, F.lit(a)).otherwise(F.col("match"))))
    match = a if a is not None else b if b is not None else next_id(ds.matches, "match")
    new = [o for o, m in ((first, a), (second, b)) if m is None]
    start = next_id(ds.matches, "id")
    return insert(ds, "matches", ds.spark.createDataFrame([(start + k, match, o) for k, o in enumerate(new)], SCHEMAS["matches"]))


def delete_match(ds: Dataset, match: int) -> Dataset:
    return ds.with_(matches=ds.matches.filter(F.col("match") != match))

