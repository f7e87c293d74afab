"""Pictures put together from others and from drawings, strip by strip.

A picture is made of strips of STRIP_ROWS rows. Whatever goes into it (other pictures, masks, outlines, fillings) is cut into pieces, each
within one strip: a rectangle of pixels, or a span of one colour. Pieces are dealt by (picture, strip) and sorted by layer, and one task after the other paints
a strip from them, so that no task holds more than a strip and a piece, however large a collage is and whatever is painted on it.
Strips can be written as PNG files part by part (sources.pictures) or joined to whole rows.

Pixels are 8-bit grey, grey with alpha, RGB or RGBA, told apart by the length of the data; painted pictures are RGB. A piece of opacity a
over a pixel p gives a * piece + (1 - a) * p, rounded half up. What lies outside the picture is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions import spans
from .media import crop_object_pixels, label_table, tile_places
from .pairs import outlines, shapes

STRIP_ROWS = 64
PIECE = "picture string, strip int, layer int, z long, part int, top int, left int, rows int, cols int, tall int, alpha double, colour int, data binary"
STRIP = "picture string, strip int, height int, width int, rows int, data binary"
#: Colours of scores 0, 1/4, 1/2, 3/4 and 1, from pale to dark; what lies between them is mixed.
STOPS = ((252, 255, 164), (249, 142, 9), (188, 55, 84), (87, 16, 110), (0, 0, 4))
#: Layers from below.
BACKGROUND, PICTURES, MASKS, OBJECTS = range(4)


def rgb(colour: tuple[int, int, int]) -> int:
    r, g, b = colour
    return r << 16 | g << 8 | b


def score_colour(score: Column, stops: tuple[tuple[int, int, int], ...] = STOPS) -> Column:
    """A score's colour as one number; no score counts as 1."""
    s = F.least(F.greatest(F.coalesce(score, F.lit(1.0)), F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    k = F.least(F.floor(s), F.lit(len(stops) - 2)).cast("int")
    table = lambda c, at: F.element_at(F.array(*(F.lit(x[c]) for x in stops)), at)
    mixed = lambda c: F.floor(table(c, k + 1) + (s - k) * (table(c, k + 2) - table(c, k + 1)) + 0.5).cast("int")
    return mixed(0) * 65536 + mixed(1) * 256 + mixed(2)


def name_colour(name: Column, colours: dict[str, tuple[int, int, int]]) -> Column:
    """A name's colour from a table; other names get one from their hash."""
    out = F.pmod(F.xxhash64(F.coalesce(name, F.lit(""))), F.lit(1 << 24)).cast("int")
    for key, colour in colours.items():
        out = F.when(name == key, F.lit(rgb(colour))).otherwise(out)
    return out


# ---- pieces


def _piece(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = (x.split(" ") for x in PIECE.split(", "))
    return df.select(*((columns[c] if c in columns else F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds))


def blank(pictures: DataFrame, colour: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """The background of each picture (picture, height, width), which also says how large it is."""
    strips = pictures.filter("height > 0 and width > 0").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / STRIP_ROWS).cast("int"))).alias("strip"))
    top = F.col("strip") * STRIP_ROWS
    zero = F.lit(0)
    return _piece(strips, layer=F.lit(BACKGROUND), z=zero, part=zero, top=top, left=zero, rows=F.least(F.lit(STRIP_ROWS), F.col("height") - top), cols=F.col("width"), tall=F.col("height"), alpha=F.lit(1.0), colour=F.lit(rgb(colour)))


def placed(pixels: DataFrame, layer: int = PICTURES) -> DataFrame:
    """Pieces of pictures (picture, z, top, left, height, width, data) that go onto others; with to_height and to_width they are stretched by nearest pixels, with alpha they are so opaque."""
    sized = {"to_height": F.col("height"), "to_width": F.col("width"), "alpha": F.lit(1.0)}
    columns = ("picture", "z", "top", "left", "height", "width", "to_height", "to_width", "alpha", "data")
    rows = pixels.select(*((F.col(c) if c in pixels.columns else sized[c]).alias(c) for c in columns))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                whole = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], -1)
                h, w = r["to_height"], r["to_width"]
                if (h, w) != whole.shape[:2]:
                    whole = whole[(np.arange(h) * r["height"] // h)[:, None], np.arange(w) * r["width"] // w]
                out = []
                for strip in range(max(0, r["top"] // STRIP_ROWS), (r["top"] + h - 1) // STRIP_ROWS + 1):
                    first, last = max(r["top"], strip * STRIP_ROWS), min(r["top"] + h, (strip + 1) * STRIP_ROWS)
                    out.append((r["picture"], strip, layer, r["z"], 0, first, r["left"], last - first, w, None, r["alpha"], None, whole[first - r["top"] : last - r["top"]].tobytes()))
                yield _batch(out)

    return rows.filter("to_height > 0 and to_width > 0").mapInArrow(cut, PIECE)


_ARROW = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[t]) for c, t in (x.split(" ") for x in PIECE.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def drawn(outlined: DataFrame, pictures: DataFrame, thickness: float = 2.0, fill_opacity: float = 0.0) -> DataFrame:
    """Spans of outlines (picture, z, rings, colour): closed lines of that thickness, over fillings of that opacity; pictures: picture, height, width."""
    sized = outlined.join(pictures.select("picture", "height", "width"), "picture")
    flat = lambda c: F.flatten(F.transform("rings", lambda r: r[c]))
    rows = sized.select("picture", "z", "height", "width", "colour", flat("xs").alias("xs"), flat("ys").alias("ys"), F.transform("rings", lambda r: F.size(r["xs"])).alias("n"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                points, cuts = np.column_stack([r["xs"], r["ys"]]).astype(float).reshape(-1, 2), np.cumsum(r["n"])[:-1]
                rings = np.split(points, cuts)
                parts = [(0, fill_opacity, [spans.filled(x, r["width"], r["height"]) for x in rings])] if fill_opacity > 0 else []
                parts += [(1, 1.0, [spans.outline(x, thickness, r["width"], r["height"]) for x in rings])] if thickness > 0 else []
                for part, alpha, found in parts:
                    rows = spans.merged(np.concatenate(found), r["width"])
                    n = len(rows)
                    same = lambda v, t: pa.array(np.full(n, v, t))  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["picture"]] * n, pa.string()), pa.array((rows[:, 0] // STRIP_ROWS).astype(np.int32)), same(OBJECTS, np.int32), same(r["z"], np.int64), same(part, np.int32), pa.array(rows[:, 0].astype(np.int32)),
                         pa.array(rows[:, 1].astype(np.int32)), same(1, np.int32), pa.array((rows[:, 2] - rows[:, 1] + 1).astype(np.int32)), pa.nulls(n, pa.int32()), same(alpha, np.float64), same(r["colour"], np.int32), pa.nulls(n, pa.binary())],
                        schema=_ARROW,
                    )

    return rows.mapInArrow(scan, PIECE)


# ---- painting


def _paint(canvas: np.ndarray, top: int, r: dict) -> None:
    """One piece onto a strip that begins at row `top`."""
    a, b, c, d = max(r["top"] - top, 0), min(r["top"] + r["rows"] - top, len(canvas)), max(r["left"], 0), min(r["left"] + r["cols"], canvas.shape[1])
    if a >= b or c >= d:
        return
    under, alpha = canvas[a:b, c:d], r["alpha"]
    if r["data"] is None:
        colour = np.array([r["colour"] >> 16 & 255, r["colour"] >> 8 & 255, r["colour"] & 255], np.uint8)
    else:
        own = np.frombuffer(r["data"], np.uint8).reshape(r["rows"], r["cols"], -1)
        own = own[a + top - r["top"] : b + top - r["top"], c - r["left"] : d - r["left"]]
        if own.shape[2] in (2, 4):
            alpha, own = alpha * own[..., -1:] / 255.0, own[..., :-1]
        colour = own
    if isinstance(alpha, float) and alpha >= 1:
        under[:] = colour
    else:
        under[:] = np.floor(alpha * colour.astype(float) + (1 - alpha) * under + 0.5)


def composed(*pieces: DataFrame) -> DataFrame:
    """Strips of the pictures whose blank() is among the pieces: picture, strip, height and width of the picture, rows of the strip, data (RGB)."""
    every = pieces[0]
    for more in pieces[1:]:
        every = every.unionByName(more)
    order = ("picture", "strip", "layer", "z", "part", "top", "left")
    dealt = every.filter("strip >= 0").repartition("picture", "strip").sortWithinPartitions(*order)

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = canvas = head = None
        names = _ARROW.names[:-1]

        def strip() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"picture": key[0], "strip": key[1], "height": head["tall"], "width": head["cols"], "rows": head["rows"], "data": canvas.tobytes()}], schema=pa.schema([("picture", pa.string()), ("strip", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("rows", pa.int32()), ("data", pa.binary())]))

        for b in batches:
            small = zip(*(b.column(n).to_pylist() for n in range(len(names))), strict=True)
            for values, pixels in zip(small, b.column(len(names)), strict=True):
                r = dict(zip(names, values, strict=True), data=pixels.as_py() if pixels.is_valid else None)  # pixels of one piece at a time
                if (r["picture"], r["strip"]) != key:
                    if canvas is not None:
                        yield strip()
                    key, head = (r["picture"], r["strip"]), r
                    canvas = np.zeros((r["rows"], r["cols"], 3), np.uint8) if r["layer"] == BACKGROUND else None  # beyond the picture, or of none
                if canvas is not None:
                    _paint(canvas, r["strip"] * STRIP_ROWS, r)
        if canvas is not None:
            yield strip()

    return dealt.mapInArrow(paint, STRIP)


def whole(strips: DataFrame) -> DataFrame:
    """imagefile, height, width and data of pictures that are small enough for a row."""
    parts = F.array_sort(F.collect_list(F.struct("strip", "data")))
    joined = strips.groupBy("picture").agg(F.first("height").alias("height"), F.first("width").alias("width"), parts.alias("p"))
    return joined.select(F.col("picture").alias("imagefile"), "height", "width", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"])).alias("data"))


def colour_counts(strips: DataFrame) -> DataFrame:
    """picture, colour and n: how many pixels of each colour the pictures have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0), b.column(1), strict=True):
                p = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 3).astype(np.int32)
                colours, n = np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(n), pa.string()), pa.array(colours), pa.array(n.astype(np.int64))], names=["picture", "colour", "n"])

    return strips.select("picture", "data").mapInArrow(count, "picture string, colour int, n long").groupBy("picture", "colour").agg(F.sum("n").alias("n"))


def strips_of(pictures: DataFrame) -> DataFrame:
    """Strips of pictures that are rows (imagefile, height, width, data), with their own channels."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, h, w, data in zip(*(b.column(k) for k in range(4)), strict=True):
                name, h, w, data = name.as_py(), h.as_py(), w.as_py(), data.as_buffer()
                line = len(data) // h
                for strip in range(-(-h // STRIP_ROWS)):
                    rows = min(STRIP_ROWS, h - strip * STRIP_ROWS)
                    part = data[strip * STRIP_ROWS * line : (strip * STRIP_ROWS + rows) * line].to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (strip, pa.int32()), (h, pa.int32()), (w, pa.int32()), (rows, pa.int32()), (part, pa.binary()))], names=["picture", "strip", "height", "width", "rows", "data"])

    return pictures.select("imagefile", F.col("height").cast("int"), F.col("width").cast("int"), "data").mapInArrow(cut, STRIP)


# ---- operators


def overlay_objects(
    ds: Dataset, pictures: DataFrame, thickness: float = 2.0, fill_opacity: float = 0.0, colours: dict[str, tuple[int, int, int]] | None = None, masks: DataFrame | None = None, mask_opacity: float = 0.5, mask_colours: dict[int | str, tuple[int, int, int]] | None = None, where_object: str | None = None
) -> DataFrame:
    """Strips of the dataset's images with their objects drawn on them: polygons, or boxes where there are none, by id; colours go by score, or by name if a table is given.

    masks (imagefile, height, width, data) lie below the objects and above the picture, stretched to its size; mask_colours gives the colours of grey
    values or ranges of them (see label_table). pictures: imagefile, height, width, data.
    """
    pictures = pictures.join(ds.images.select("imagefile").distinct(), "imagefile", "left_semi")
    sizes = pictures.select(F.col("imagefile").alias("picture"), "height", "width")
    zero = F.lit(0).cast("int")
    pieces = [blank(sizes), placed(pictures.select(F.col("imagefile").alias("picture"), zero.alias("z"), zero.alias("top"), zero.alias("left"), "height", "width", "data"))]
    if masks is not None:
        over = masks.select(F.col("imagefile").alias("picture"), F.col("height").alias("mh"), F.col("width").alias("mw"), "data").join(sizes, "picture")
        over = over.select("picture", zero.alias("z"), zero.alias("top"), zero.alias("left"), F.col("mh").alias("height"), F.col("mw").alias("width"), F.col("height").alias("to_height"), F.col("width").alias("to_width"), F.lit(float(mask_opacity)).alias("alpha"), "data")
        pieces.append(placed(over if mask_colours is None else coloured(over, mask_colours), MASKS))
    drawable = ds.with_(objects=ds.where("objects", where_object))
    colour = score_colour(F.col("score")) if colours is None else name_colour(F.col("name"), colours)
    found = shapes(outlines(drawable)).select("objectid", F.col("imagefile").alias("picture"), "rings").join(drawable.objects.select("objectid", colour.alias("colour")), "objectid")
    pieces.append(drawn(found.withColumnRenamed("objectid", "z"), sizes, thickness, fill_opacity))
    return composed(*pieces)


def coloured(masks: DataFrame, colours: dict[int | str, tuple[int, int, int]]) -> DataFrame:
    """Grey masks with the colours of their values in `data`; values that the table lacks stay grey."""
    keys = list(colours)
    place = label_table({key: n for n, key in enumerate(keys)})
    table = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
    for n, key in enumerate(keys):
        table[place == n] = colours[key]

    @F.pandas_udf("binary")
    def paint(data):  # noqa: ANN001, ANN202
        return data.map(lambda d: table[np.frombuffer(d, np.uint8)].tobytes())

    return masks.withColumn("data", paint("data"))


def collage_objects(ds: Dataset, pictures: DataFrame, image_path: str, cell_width: int, cell_height: int, rows: int = 5, columns: int = 5, gap: int = 10, where_object: str | None = None, edges: str = "constant", split_by_name: bool = False) -> DataFrame:
    """Strips of the collages that tile_objects() describes with the same parameters, from pictures (imagefile, height, width, data)."""
    places = tile_places(ds, image_path, cell_width, cell_height, rows, columns, gap, where_object, edges, split_by_name)
    crops = crop_object_pixels(ds, pictures, edges, cell_width, cell_height, where_object)
    cells = crops.join(places.select("objectid", F.col("tile").alias("picture"), F.col("left").cast("int").alias("left"), F.col("top").cast("int").alias("top")), "objectid").withColumnRenamed("objectid", "z")
    size = {"height": rows * (cell_height + gap) - gap, "width": columns * (cell_width + gap) - gap}
    sheets = places.select(F.col("tile").alias("picture")).distinct().withColumns({k: F.lit(v) for k, v in size.items()})
    return composed(blank(sheets), placed(cells))


def grid_frames(shown: DataFrame, pictures: DataFrame, columns: int, rows: int, width: int, height: int) -> DataFrame:
    """Strips of one picture for each tick of shown (tick, imagefile, x, y, as place_in_grid() gives them), each image stretched to its cell. Pictures are named by tick."""
    tick = F.lpad(F.col("tick").cast("string"), 9, "0")
    sheets = shown.select(tick.alias("picture")).distinct().withColumns({"height": F.lit(rows * height), "width": F.lit(columns * width)})
    cells = shown.join(pictures.select("imagefile", "height", "width", "data"), "imagefile")
    cells = cells.select(tick.alias("picture"), F.lit(0).alias("z"), F.col("y").alias("top"), F.col("x").alias("left"), "height", "width", F.lit(height).alias("to_height"), F.lit(width).alias("to_width"), "data")
    return composed(blank(sheets), placed(cells))
