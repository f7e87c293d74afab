"""Operators on annotations and pixels. Pixels are rows (imagefile, height, width, data) of 8-bit grey masks, worked on where they stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import CHILDREN, Dataset, next_id
from ..functions.geometry import BOX, box_corners, has_box
from ..functions.paths import base_name, folder
from ..functions.spans import filled_rings
from ..storage import written
from .modify import TRANSFORM, insert, numbered, update_object_transform


def crop_media(ds: Dataset, x1: float, y1: float, x2: float, y2: float, image_path: str) -> Dataset:
    """Crops all images to one region: sizes change, boxes and vertices move with it."""
    images = ds.images.withColumns({"width": F.lit(int(x2 - x1)), "height": F.lit(int(y2 - y1)), "imagefile": _below(image_path, "imagefile")})
    objects = ds.objects.withColumns({"x1": F.col("x1") - x1, "y1": F.col("y1") - y1, "imagefile": _below(image_path, "imagefile")})
    return ds.with_(images=images, objects=objects, polygons=ds.polygons.withColumns({"x": F.col("x") - x1, "y": F.col("y") - y1}))


def _below(path: str, column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.concat(F.lit(path.rstrip("/") + "/"), F.col(column)))


EDGES = ("distort", "constant", "background", "original")


def crop_frame(edges: str, width: int | None = None, height: int | None = None) -> dict[str, Column]:
    """The crop of an object's box, as expressions: its whole-number region ya, xa, yb, xb, the size cw, ch, and the transform kx, ky, bx, by from image to crop.

    distort stretches the region to the size; constant pads it with black to the size's ratio first, half on each side; background takes
    more of the image instead; original keeps the region's own size. Sides that are not whole numbers move inwards.
    """
    if edges not in EDGES:
        raise ValueError(f"edges must be one of {', '.join(EDGES)}")
    if edges != "original" and not (width and height):
        raise ValueError("a width and a height are needed")
    x1, y1, w, h = (F.col(c) for c in BOX)
    if edges == "background":
        ratio = height / width
        flat = h / w < ratio
        more_y, more_x = F.when(flat, w * ratio - h).otherwise(0.0), F.when(flat, 0.0).otherwise(h / ratio - w)
        x1, y1, w, h = x1 - more_x / 2, y1 - more_y / 2, w + more_x, h + more_y
    whole = lambda c: c.cast("long")
    ya, xa, yb, xb = whole(F.ceil(y1)), whole(F.ceil(x1)), whole(F.floor(y1 + h)), whole(F.floor(x1 + w))
    rows, cols = yb - ya, xb - xa
    pad_x = pad_y = F.lit(0).cast("long")
    full_x, full_y = cols, rows
    if edges == "constant":
        ratio = height / width
        tall = rows > whole(ratio * cols)
        full_x = F.when(tall, whole(rows / ratio)).otherwise(cols)
        full_y = F.when(tall, rows).otherwise(whole(ratio * cols))
        half = lambda c: whole(F.floor(c / 2))
        pad_x, pad_y = half(full_x - cols), half(full_y - rows)
    kx = F.lit(1.0) if edges == "original" else F.lit(float(width)) / full_x
    ky = F.lit(1.0) if edges == "original" else F.lit(float(height)) / full_y
    size = (cols, rows) if edges == "original" else (F.lit(width), F.lit(height))
    return {"ya": ya, "xa": xa, "yb": yb, "xb": xb, "pad_x": pad_x, "pad_y": pad_y, "full_x": full_x, "full_y": full_y, "cw": size[0].cast("int"), "ch": size[1].cast("int"), "kx": kx, "ky": ky, "bx": kx * (pad_x - xa), "by": ky * (pad_y - ya)}


def _frames(ds: Dataset, where_object: str | None, edges: str, width: int | None, height: int | None) -> DataFrame:
    """Objects with a box in an image, with their crops; regions of one pixel or none are an error."""
    kept = ds.where("objects", where_object).filter(has_box()).join(ds.images.select("imagefile"), "imagefile", "left_semi")
    if not kept.filter("width <= 1 or height <= 1").isEmpty():
        raise ValueError("an object's box is too small to be cropped")
    frames = kept.select(*ds.objects.columns, *(v.alias(k) for k, v in crop_frame(edges, width, height).items()))
    if not frames.filter("yb - ya <= 1 or xb - xa <= 1").isEmpty():
        raise ValueError("an object's box is too small to be cropped")
    return frames


def _apply(ds: Dataset, change: DataFrame) -> Dataset:
    """Moves boxes and vertices by transforms (objectid, kx, ky, bx, by), and notes them in properties."""
    c = change.select("objectid", *TRANSFORM)
    o, p = ds.objects.join(c, "objectid"), ds.polygons.join(c, "objectid")
    objects = o.withColumns({"x1": F.expr("x1 * kx + bx"), "y1": F.expr("y1 * ky + by"), "width": F.expr("width * kx"), "height": F.expr("height * ky")})
    out = ds.with_(objects=objects, polygons=p.withColumns({"x": F.expr("x * kx + bx"), "y": F.expr("y * ky + by")}))
    return update_object_transform(out, c)


def crop_objects(
    ds: Dataset, image_path: str, width: int | None = None, height: int | None = None, where_object: str | None = None, by_name: bool = False, edges: str = "distort", where_other_objects: str | None = None, name_in_file: bool = False, mask_path: str | None = None
) -> Dataset:
    """A dataset of one image for each object with a box; each has its object's name and score, and transforms say how to go back.

    where_other_objects: these objects of an image go into each of its crops too, and all objects get fresh ids. Properties
    `original_objectid` and, for the object that is cropped, `cropped` say which is which. See crop_frame for the edges.
    """
    if not ds.properties.filter(F.col("key").isin(*TRANSFORM, "original_objectid", "cropped")).isEmpty():
        raise ValueError("objects have transforms or marks of crops already; revert them first")
    frames = _frames(ds, where_object, edges, width, height)
    named = F.regexp_replace(F.coalesce("name", F.lit("none")), "[^a-zA-Z0-9_.-]", "_")
    number = F.lpad(F.col("objectid").cast("string"), 9, "0")
    file = F.concat(named, F.lit("/"), number) if by_name else F.concat(named, F.lit("-"), number) if name_in_file else number
    below = lambda path, end: F.concat(F.lit(path.rstrip("/") + "/"), file, F.lit(end))
    frames = frames.withColumns({"crop": below(image_path, ".jpg"), "mask": below(mask_path, ".png") if mask_path else F.lit(None).cast("string")})
    if where_other_objects is None:
        members = frames.select(F.col("objectid").alias("frame"), "objectid", F.col("objectid").alias("new"))
    else:
        others = ds.where("objects", where_other_objects).select("objectid", "imagefile")
        more = frames.select(F.col("objectid").alias("frame"), "imagefile").join(others, "imagefile").select("frame", "objectid")
        members = numbered(more.union(frames.select("objectid", "objectid")).distinct(), "new", 1, "frame", "objectid").select("frame", "objectid", "new")
    change = members.join(frames.select(F.col("objectid").alias("frame"), "crop", F.col("imagefile").alias("old"), *TRANSFORM), "frame")
    renamed = lambda t: ds.table(t).join(members.select("objectid", "new"), "objectid").withColumn("objectid", F.col("new"))
    tables = {t: renamed(t) for t in ("objects", *CHILDREN)}
    if where_other_objects is not None:
        tables |= {t: numbered(tables[t].withColumnRenamed("id", "was"), "id", 1, "objectid", "was") for t in CHILDREN}
    out = _apply(ds.with_(**tables), change.select(F.col("new").alias("objectid"), *TRANSFORM))
    masks = ds.images.filter("maskfile is not null").select("imagefile", F.lit(True).alias("masked")).distinct()
    images = frames.join(masks, "imagefile", "left").join(ds.images.select("imagefile", "timestamp").dropDuplicates(["imagefile"]), "imagefile")
    images = images.select(F.col("crop").alias("imagefile"), F.col("cw").alias("width"), F.col("ch").alias("height"), F.when(F.col("masked"), F.col("mask")).alias("maskfile"), "timestamp", "name", "score")
    objects = out.objects.join(change.select(F.col("new").alias("objectid"), "crop"), "objectid").withColumn("imagefile", F.col("crop"))
    note = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"))
    own = F.when(F.col("frame") == F.col("objectid"), F.lit("true"))
    notes = change.select(F.col("new").alias("objectid"), F.explode(F.array(note("original_objectid", F.col("objectid")), note("old_imagefile", F.col("old")), note("cropped", own))).alias("p"))
    made = numbered(notes.select("objectid", "p.key", "p.value").filter("value is not null"), "id", next_id(out.properties, "id"), "objectid", "key")
    return insert(out.with_(images=images, objects=objects), "properties", made)


def tile_places(ds: Dataset, image_path: str, cell_width: int, cell_height: int, rows: int = 5, columns: int = 5, gap: int = 10, where_object: str | None = None, edges: str = "constant", split_by_name: bool = False) -> DataFrame:
    """objectid, old (its image), tile (its collage), left and top of its cell, and the transform from image to collage, for tile_objects()."""
    kept = _frames(ds, where_object, edges, cell_width, cell_height)
    placed = numbered(kept, "n", 0, F.col("name").asc_nulls_first(), F.col("objectid"))
    cells = rows * columns
    if split_by_name:
        names = placed.groupBy("name").agg(F.min("n").alias("first"), F.ceil(F.count("*") / cells).alias("sheets"))
        before = F.sum("sheets").over(Window.orderBy(F.col("name").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))  # a row for each name
        names = names.select(F.col("name").alias("group"), "first", F.coalesce(before, F.lit(0)).alias("before"))
        placed = placed.join(names, F.col("name").eqNullSafe(F.col("group"))).withColumn("n", F.col("n") - F.col("first") + F.col("before") * cells)
    cell = F.col("n") % cells
    left, top = (cell % columns) * (cell_width + gap), F.floor(cell / columns) * (cell_height + gap)
    file = F.concat(F.lit(image_path.rstrip("/") + "/"), F.lpad(F.floor(F.col("n") / cells).cast("string"), 6, "0"), F.lit(".jpg"))
    return placed.select("objectid", F.col("imagefile").alias("old"), file.alias("tile"), left.alias("left"), top.alias("top"), "kx", "ky", (F.col("bx") + left).alias("bx"), (F.col("by") + top).alias("by"))


def tile_objects(ds: Dataset, image_path: str, cell_width: int, cell_height: int, rows: int = 5, columns: int = 5, gap: int = 10, where_object: str | None = None, edges: str = "constant", split_by_name: bool = False) -> Dataset:
    """Packs crops of objects with a box into collages, row by row in order of name; transforms and old paths say how to go back. split_by_name: each name begins a new collage."""
    placed = written(tile_places(ds, image_path, cell_width, cell_height, rows, columns, gap, where_object, edges, split_by_name))
    out = _apply(ds.keep_objects(placed), placed)
    size = (columns * (cell_width + gap) - gap, rows * (cell_height + gap) - gap)
    nothing = lambda kind: F.lit(None).cast(kind)
    images = placed.select("tile").distinct().select(F.col("tile").alias("imagefile"), F.lit(size[0]).alias("width"), F.lit(size[1]).alias("height"), nothing("string").alias("maskfile"), nothing("timestamp").alias("timestamp"), nothing("string").alias("name"), nothing("double").alias("score"))
    objects = out.objects.join(placed.select("objectid", "tile"), "objectid").withColumn("imagefile", F.col("tile"))
    notes = numbered(placed.select("objectid", F.lit("old_imagefile").alias("key"), F.col("old").alias("value")), "id", next_id(out.properties, "id"), "objectid")
    return insert(out.with_(images=images, objects=objects), "properties", notes)


def crop_object_pixels(ds: Dataset, pixels: DataFrame, edges: str, width: int | None = None, height: int | None = None, where_object: str | None = None) -> DataFrame:
    """objectid, height, width and data of each object's crop from pictures (imagefile, height, width, data); what lies outside is black, scaling takes the nearest pixel."""
    frames = _frames(ds, where_object, edges, width, height).select("objectid", "imagefile", *(F.col(c).cast("long").alias(c) for c in ("ya", "xa", "yb", "xb", "pad_x", "pad_y", "full_x", "full_y", "cw", "ch")))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out = []
            for r in some.itertuples():
                whole = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)
                part = np.zeros((r.full_y, r.full_x, whole.shape[2]), np.uint8)
                a, b, c, d = max(r.ya, 0), min(r.yb, r.height), max(r.xa, 0), min(r.xb, r.width)
                if b > a and d > c:
                    part[r.pad_y + a - r.ya : r.pad_y + b - r.ya, r.pad_x + c - r.xa : r.pad_x + d - r.xa] = whole[a:b, c:d]
                part = part[(np.arange(r.ch) * r.full_y // r.ch)[:, None], np.arange(r.cw) * r.full_x // r.cw]
                out.append((r.objectid, r.ch, r.cw, part.tobytes()))
            yield pd.DataFrame(out, columns=["objectid", "height", "width", "data"])

    return frames.join(pixels.select("imagefile", "height", "width", "data"), "imagefile").mapInPandas(cut, "objectid long, height int, width int, data binary")


def write_media(ds: Dataset, image_path: str, mask_path: str | None = None, where_image: str | None = None) -> Dataset:
    """Paths of a copy of the media below new folders; images that the condition leaves out go."""
    out = ds.keep_images(ds.where("images", where_image))
    masks = F.when(F.col("maskfile").isNotNull(), F.concat(F.lit((mask_path or "").rstrip("/") + "/"), base_name(F.col("maskfile")))) if mask_path else F.col("maskfile")
    return out.with_(images=out.images.withColumns({"imagefile": _below(image_path, "imagefile"), "maskfile": masks}), objects=out.objects.withColumn("imagefile", _below(image_path, "imagefile")))


MASK = "imagefile string, height int, width int, data binary"
#: Masks are painted, and go on, in blocks of about so many pixels; one image of more is one block.
BLOCK_PIXELS = 1 << 20


def polygons_to_mask(ds: Dataset, boxes_too: bool = False, skip_empty: bool = False) -> DataFrame:
    """imagefile, height, width and data of each image of known size: polygons filled with 255; where several polygons of one object meet, each counts its part, and sums stop at 255. skip_empty leaves out masks that are black. Of several sizes of an image the smallest counts; vertices without a place don't.

    Images and their rings are rows of one table that is dealt out and sorted by image; tasks paint many images at once.
    """
    known = ds.polygons.filter("x is not null and y is not null").groupBy("objectid", F.coalesce("name", F.lit("")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("p"))
    rings = known.join(ds.objects.select("objectid", "imagefile"), "objectid").select("imagefile", "objectid", "name", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    if boxes_too:
        bare = ds.objects.filter(has_box()).join(ds.polygons.select("objectid"), "objectid", "left_anti").withColumn("p", box_corners(*map(F.col, BOX)))
        rings = rings.unionByName(bare.select("imagefile", "objectid", F.lit("").alias("name"), F.col("p.x").alias("xs"), F.col("p.y").alias("ys")))
    images = ds.images.filter("imagefile is not null and width is not null and height is not null").select("imagefile", F.col("width").alias("w"), F.col("height").alias("h"))
    both = images.unionByName(rings.filter("imagefile is not null"), allowMissingColumns=True)
    order = ("imagefile", "objectid", "name", "w", "h")  # an image goes before its objects
    dealt = both.select(*order, "xs", "ys").repartition("imagefile").sortWithinPartitions(*order)

    def paint(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Masks of whole images; rings of images without a row of their own go."""
        file = rows["imagefile"].combine_chunks().dictionary_encode().indices.to_numpy()
        begin = np.flatnonzero(np.r_[True, file[1:] != file[:-1]])
        sized = rows["w"].is_valid().to_numpy()[begin]
        rows = rows.filter(pa.array(np.repeat(sized, np.diff(np.r_[begin, len(file)])))).combine_chunks()
        begin = np.r_[0, np.cumsum(np.diff(np.r_[begin, len(file)])[sized])].astype(np.int64)
        w, h = (rows[c].take(pa.array(begin[:-1])).to_numpy().astype(np.int64) for c in "wh")
        block = np.cumsum(w * h) // BLOCK_PIXELS
        cuts = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(w)].tolist() if len(w) else []
        for lo, hi in zip(cuts, cuts[1:]):
            own = rows.slice(begin[lo], begin[hi] - begin[lo])
            image, ring = np.repeat(np.arange(hi - lo), np.diff(begin[lo : hi + 1])), own["objectid"].is_valid().to_numpy()
            own, image = own.filter(pa.array(ring)).combine_chunks(), image[ring]
            places = [own[c].combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.float64())) for c in ("xs", "ys")]
            x, y = (p.flatten().to_numpy(zero_copy_only=False) for p in places)
            bounds = np.r_[0, np.cumsum(pc.list_value_length(places[0]).to_numpy())].astype(np.int64)
            at = np.r_[0, np.cumsum(w[lo:hi] * h[lo:hi])]
            found = filled_rings(x, y, bounds, w[lo:hi][image], h[lo:hi][image])
            start = at[image[found[:, 0]]] + found[:, 1] * w[lo:hi][image[found[:, 0]]]
            start, stop = start + found[:, 2], start + found[:, 3] + 1
            ids = own["objectid"].to_numpy()
            first = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (image[1:] != image[:-1])][: len(ids)])
            many = np.diff(np.r_[first, len(ids)])
            single = np.repeat(many == 1, many)[found[:, 0]]
            cover = np.bincount(start[single], minlength=at[-1] + 1) - np.bincount(stop[single], minlength=at[-1] + 1)
            out = np.where(np.cumsum(cover[:-1]) > 0, np.uint8(255), np.uint8(0))
            # objects of several rings, one after the other
            by_ring = np.argsort(found[:, 0], kind="stable")
            edge = np.searchsorted(found[by_ring, 0], np.r_[first, len(ids)])
            for k in np.flatnonzero(many > 1):
                mine = slice(at[image[first[k]]], at[image[first[k]] + 1])
                parts = np.zeros(mine.stop - mine.start, np.int64)
                for s in by_ring[edge[k] : edge[k + 1]]:
                    parts[start[s] - mine.start : stop[s] - mine.start] += 255
                out[mine] = np.minimum(out[mine] + parts // many[k], 255)
            masks = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())
            batch = pa.RecordBatch.from_arrays([rows["imagefile"].take(pa.array(begin[lo:hi])).combine_chunks(), pa.array(h[lo:hi], pa.int32()), pa.array(w[lo:hi], pa.int32()), masks], names=["imagefile", "height", "width", "data"])
            if skip_empty:
                total = np.r_[0, np.cumsum(out > 0)][at]
                batch = batch.filter(pa.array(total[1:] > total[:-1]))
            yield batch

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last image so far
        for b in batches:
            if not b.num_rows:
                continue
            file = b.column("imagefile")
            fresh = file.index(file[-1]).as_py()
            if held and held[-1].column("imagefile")[-1] == file[-1] and not fresh:
                held.append(b)
                continue
            whole = pa.Table.from_batches([*held, b.slice(0, fresh)])
            if whole.num_rows:
                yield from paint(whole)
            held = [b.slice(fresh)]
        if held:
            yield from paint(pa.Table.from_batches(held))

    return dealt.mapInArrow(draw, MASK)


def label_table(mapping: dict[int | str, int]) -> np.ndarray:
    """For each grey value its label, -1 where the mapping has none. Keys are values, or `>N`, `>=N`, `<N`, `<=N`, `[A,B]`."""
    table = np.full(256, -1, np.int64)
    values = np.arange(256)
    for key, label in mapping.items():
        k = str(key).strip()
        if k[:2] == ">=":
            hit = values >= int(k[2:])
        elif k[:2] == "<=":
            hit = values <= int(k[2:])
        elif k[0] == ">":
            hit = values > int(k[1:])
        elif k[0] == "<":
            hit = values < int(k[1:])
        elif k[0] == "[":
            a, b = map(int, k[1:-1].split(","))
            hit = (values >= a) & (values <= b)
        else:
            hit = values == int(k)
        table[hit] = label
    return table


def repaint_mask(masks: DataFrame, mapping: dict[int | str, int], other: int | None = None) -> DataFrame:
    """Masks with grey values replaced; values that the mapping lacks stay, or become `other`."""
    table = label_table(mapping)
    lut = np.where(table >= 0, table, np.arange(256) if other is None else other).astype(np.uint8)

    @F.arrow_udf("binary")
    def paint(data: pa.Array) -> pa.Array:
        valid, at, held = data.buffers()
        if held is None:
            return data
        return pa.Array.from_buffers(data.type, len(data), [valid, at, pa.py_buffer(lut[np.frombuffer(held, np.uint8)])], data.null_count, data.offset)

    return masks.withColumn("data", paint("data"))


def subtract_mask(masks: DataFrame, others: DataFrame) -> DataFrame:
    """Pixelwise difference of masks of one imagefile, modulo 256."""

    @F.pandas_udf("binary")
    def minus(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(x, np.uint8) - np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])

    return masks.join(others.select("imagefile", F.col("data").alias("other")), "imagefile").withColumn("data", minus("data", "other")).drop("other")


def crop_pixels(pixels: DataFrame, x1: int, y1: int, x2: int, y2: int) -> DataFrame:
    """The same region of each mask; what lies outside is black."""

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                whole = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                part = np.zeros((y2 - y1, x2 - x1), np.uint8)
                a, b, c, d = max(y1, 0), min(y2, r.height), max(x1, 0), min(x2, r.width)
                if b > a and d > c:
                    part[a - y1 : b - y1, c - x1 : d - x1] = whole[a:b, c:d]
                out.append((r.imagefile, y2 - y1, x2 - x1, part.tobytes()))
            yield pd.DataFrame(out, columns=["imagefile", "height", "width", "data"])

    return pixels.select("imagefile", "height", "width", "data").mapInPandas(crop, "imagefile string, height int, width int, data binary")


def grid_by_time(ds: Dataset, fps: float = 5.0, folders: list[str] | None = None, num_seconds: float | None = None) -> DataFrame:
    """For each tick and folder the latest image before it: tick, folder, imagefile. Ticks are 1 / fps seconds apart, from the first time stamp up to the last."""
    shot = ds.images.filter("timestamp is not null").select(folder(F.col("imagefile")).alias("folder"), "imagefile", "timestamp")
    if folders:
        shot = shot.filter(F.col("folder").isin(folders))
    step = F.lit(1.0 / fps)
    ends = shot.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    t0 = F.broadcast(ends)  # one row
    at = shot.crossJoin(t0).withColumn("s", F.col("timestamp").cast("double") - F.col("a").cast("double"))
    length = F.col("b").cast("double") - F.col("a").cast("double")
    if num_seconds is not None:
        length = F.least(length, F.lit(float(num_seconds)))
    # an image is shown from the first tick after it until the first tick after its successor in the folder
    first = F.floor(F.col("s") / step).cast("long") + 1
    after = F.lead("s").over(Window.partitionBy("folder").orderBy("s", "imagefile"))
    last = F.coalesce(F.floor(after / step).cast("long"), F.ceil(length / step).cast("long") - 1)
    last = F.least(last, F.ceil(length / step).cast("long") - 1)
    shown = at.withColumn("first", first).withColumn("last", last).filter("first <= last")
    return shown.select(F.explode(F.sequence("first", "last")).alias("tick"), "folder", "imagefile")


def place_in_grid(shown: DataFrame, folders: list[str], columns: int, width: int, height: int) -> DataFrame:
    """shown (tick, folder, imagefile) with x and y, where each folder's cell begins: row by row in the order of folders, in one picture for each tick."""
    place = F.array_position(F.array(*map(F.lit, folders)), F.col("folder")) - 1
    return shown.withColumns({"x": (place % columns * width).cast("int"), "y": (F.floor(place / columns) * height).cast("int")}).filter(place >= 0)


def missing_media(ds: Dataset, root: str | None = None) -> DataFrame:
    """imagefile and file of each image or mask that isn't below the root."""
    root = (root or ds.rootdir).rstrip("/")
    there = ds.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.substring_index("path", root + "/", -1).alias("file"))
    named = ds.images.select("imagefile", F.col("imagefile").alias("file")).union(ds.images.select("imagefile", "maskfile")).filter("file is not null")
    return named.join(there, "file", "left_anti").select("imagefile", "file")
