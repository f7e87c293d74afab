"""Spans, strips, overlays, collages and PNG files against plain numpy pictures."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.dataset import Dataset
from quillframe.functions import geometry, spans
from quillframe.operators import media, raster
from quillframe.sources import pictures


def painted(found, width, height):
    out = np.zeros((height, width), int)
    for row, a, b in found:
        out[row, a : b + 1] += 1
    return out


def test_fillings_equal_the_mask():
    rnd = np.random.default_rng(1)
    for k in range(300):
        n = rnd.integers(3, 9)
        ring = rnd.uniform(-10, 40, (n, 2)) if k % 3 else rnd.integers(-5, 35, (n, 2)).astype(float)
        found = painted(spans.filled(ring, 30, 25), 30, 25)
        assert found.max(initial=0) <= 1 and (found == geometry.fill(ring, 30, 25)).all()
    assert not len(spans.filled(np.zeros((2, 2)), 10, 10)) and not len(spans.filled(np.full((4, 2), -9.0), 10, 10))


def distance(x, y, p, q):
    d = q - p
    t = np.clip(((x - p[0]) * d[0] + (y - p[1]) * d[1]) / max(d @ d, 1e-12), 0, 1)
    return np.hypot(x - p[0] - t * d[0], y - p[1] - t * d[1])


def test_lines_hold_the_pixels_near_them():
    rnd = np.random.default_rng(2)
    yy, xx = np.mgrid[0:30, 0:40]
    for k in range(200):
        ring = rnd.uniform(-10, 50, (rnd.integers(1, 6), 2)) if k % 2 else rnd.integers(0, 30, (4, 2)).astype(float)
        thickness = float(rnd.choice([1, 2, 3.5, 6]))
        near = np.min([distance(xx, yy, ring[j - 1], ring[j]) for j in range(len(ring))], axis=0)
        found = painted(spans.outline(ring, thickness, 40, 30), 40, 30)
        sure = np.abs(near - thickness / 2) > 1e-6
        assert found.max(initial=0) <= 1 and ((found > 0) == (near <= thickness / 2))[sure].all()
    box = np.array([(2, 3), (10, 3), (10, 8), (2, 8)], float)
    frame = painted(spans.outline(box, 1, 40, 30), 40, 30)
    assert frame.sum() == 2 * 9 + 2 * 4 and frame[3, 2:11].all() and frame[3:9, 10].all() and not frame[4, 5]


def noise(rnd, h, w, c):
    return rnd.integers(0, 256, (h, w, c), np.uint8)


def over(canvas, part, top, left, alpha):
    """Plain painting of one picture onto another."""
    h, w = canvas.shape[:2]
    for y in range(part.shape[0]):
        for x in range(part.shape[1]):
            if 0 <= top + y < h and 0 <= left + x < w:
                p, a = part[y, x].astype(float), alpha
                if len(p) in (2, 4):
                    p, a = p[:-1], alpha * p[-1] / 255
                canvas[top + y, left + x] = np.floor(a * p + (1 - a) * canvas[top + y, left + x] + 0.5)


PIXELS = "picture string, z long, top int, left int, height int, width int, data binary, alpha double"


def test_strips_equal_plain_painting(spark):
    rnd = np.random.default_rng(3)
    sizes = {"a.png": (150, 70), "b.png": (64, 33), "c.png": (1, 5)}
    plain = {k: np.zeros((*s, 3), np.uint8) + np.array([9, 8, 7], np.uint8) for k, s in sizes.items()}
    rows = []
    for z in range(40):
        name = ("a.png", "a.png", "b.png", "c.png", "nowhere.png")[z % 5]
        h, w, c = rnd.integers(1, 90), rnd.integers(1, 40), (1, 2, 3, 4)[z % 4]
        part, top, left, alpha = noise(rnd, h, w, c), int(rnd.integers(-60, 140)), int(rnd.integers(-20, 60)), float(rnd.choice([1.0, 0.3]))
        rows.append((name, z, top, left, int(h), int(w), part.tobytes(), alpha))
        if name in plain:
            over(plain[name], part, top, left, alpha)
    blank = raster.blank(spark.createDataFrame([(k, *s) for k, s in sizes.items()], "picture string, height int, width int"), (9, 8, 7))
    strips = raster.composed(blank, raster.placed(spark.createDataFrame(rows, PIXELS).repartition(5)))
    assert strips.groupBy("picture").count().filter("picture = 'a.png'").first()[1] == 3 and strips.agg(F.max("rows")).first()[0] == raster.STRIP_ROWS
    got = {r.imagefile: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in raster.whole(strips).collect()}
    assert got.keys() == plain.keys() and all((got[k] == plain[k]).all() for k in plain)


def three_pictures(spark):
    rnd = np.random.default_rng(4)
    images = {f"{k}.png": noise(rnd, *size) for k, size in enumerate([(90, 120, 3), (70, 50, 3), (130, 40, 1)])}
    objects = [(1, "0.png", 10.0, 60.0, 50.0, 20.0, "car", 0.5), (2, "0.png", 20.0, 5.0, 30.0, 70.0, "bus", None), (3, "1.png", -5.0, 10.0, 30.0, 30.0, "car", 1.0), (4, "2.png", None, None, None, None, "cat", 0.0), (5, "gone.png", 1.0, 1.0, 5.0, 5.0, "car", 0.1)]
    polygons = [(1, 2, 20.0, 5.0, None), (2, 2, 50.0, 40.0, None), (3, 2, 25.0, 75.0, None), (4, 4, 5.0, 60.0, "p"), (5, 4, 35.0, 61.0, "p"), (6, 4, 20.0, 125.0, "p")]
    ds = Dataset.from_rows(spark, images=[(k, v.shape[1], v.shape[0], None, None, None, None) for k, v in images.items()], objects=objects, polygons=polygons)
    return images, ds, spark.createDataFrame([(k, *v.shape[:2], v.tobytes()) for k, v in images.items()], "imagefile string, height int, width int, data binary")


def test_overlays_of_three_images(spark):
    images, ds, rows = three_pictures(spark)
    mask = np.zeros((45, 60), np.uint8)
    mask[10:30, 5:50] = 7
    masks = spark.createDataFrame([("0.png", 45, 60, mask.tobytes())], "imagefile string, height int, width int, data binary")
    got = {r.imagefile: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in raster.whole(raster.overlay_objects(ds, rows, 3.0, 0.25, {"car": (255, 0, 0), "bus": (0, 255, 0), "cat": (1, 2, 3)}, masks, 0.5, {"7": (10, 20, 30)})).collect()}
    plain = {k: np.repeat(v, 3, 2) if v.shape[2] == 1 else v.copy() for k, v in images.items()}
    large = mask[(np.arange(90) * 45 // 90)[:, None], np.arange(120) * 60 // 120]
    over(plain["0.png"], np.where((large == 7)[..., None], np.array([10, 20, 30]), np.repeat(large[..., None], 3, 2)).astype(np.uint8), 0, 0, 0.5)
    box = lambda x, y, w, h: np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)
    for name, ring, colour in (("0.png", box(10, 60, 50, 20), (255, 0, 0)), ("0.png", np.array([(20, 5), (50, 40), (25, 75)], float), (0, 255, 0)), ("1.png", box(-5, 10, 30, 30), (255, 0, 0)), ("2.png", np.array([(5, 60), (35, 61), (20, 125)], float), (1, 2, 3))):
        h, w = plain[name].shape[:2]
        yy, xx = np.mgrid[0:h, 0:w]
        inside = geometry.fill(ring, w, h)
        plain[name][inside] = np.floor(0.25 * np.array(colour) + 0.75 * plain[name][inside] + 0.5)
        near = np.min([distance(xx, yy, ring[j - 1], ring[j]) for j in range(len(ring))], axis=0)
        plain[name][near <= 1.5 + 1e-9] = colour
    assert got.keys() == plain.keys() and all((got[k] == plain[k]).all() for k in plain)


def test_score_colours(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.25,), (0.375,), (1.0,), (None,), (7.0,)], "s double").select(raster.score_colour(F.col("s"))).collect()]
    mixed = tuple(int(np.floor(a + 0.5 * (b - a) + 0.5)) for a, b in zip(raster.STOPS[1], raster.STOPS[2]))
    assert got == [raster.rgb(x) for x in (raster.STOPS[0], raster.STOPS[1], mixed, raster.STOPS[4], raster.STOPS[4], raster.STOPS[4])]


@pytest.mark.parametrize("edges", ["constant", "distort", "background"])
def test_collages_equal_crops_at_their_places(spark, edges):
    images, ds, rows = three_pictures(spark)
    ds = ds.with_(objects=ds.objects.filter("imagefile <> 'gone.png'"))
    how = dict(cell_width=30, cell_height=40, rows=2, columns=1, gap=5, edges=edges)
    got = {r.imagefile: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in raster.whole(raster.collage_objects(ds, rows, "tiles", **how)).collect()}
    tiled = media.tile_objects(ds, "tiles", **how)
    assert {r.imagefile: (r.height, r.width) for r in tiled.images.collect()} == {k: v.shape[:2] for k, v in got.items()} and len(got) == 2
    crops = {r.objectid: np.frombuffer(r.data, np.uint8).reshape(40, 30, 3) for r in media.crop_object_pixels(ds, rows, edges, 30, 40).collect()}
    plain = {k: np.zeros_like(v) for k, v in got.items()}
    for r in media.tile_places(ds, "tiles", **how).collect():
        plain[r.tile][r.top : r.top + 40, r.left : r.left + 30] = crops[r.objectid]
    assert all((got[k] == plain[k]).all() for k in got) and max(v.max() for v in plain.values()) > 0


def test_grid_frames(spark):
    images, ds, rows = three_pictures(spark)
    shown = spark.createDataFrame([(1, "a", "0.png", 0, 0), (1, "b", "1.png", 20, 0), (2, "b", "2.png", 20, 0)], "tick long, folder string, imagefile string, x int, y int")
    got = {r.imagefile: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in raster.whole(raster.grid_frames(shown, rows, 2, 1, 20, 15)).collect()}
    small = lambda v: np.broadcast_to(v[(np.arange(15) * v.shape[0] // 15)[:, None], np.arange(20) * v.shape[1] // 20], (15, 20, 3))
    assert (got["000000001"] == np.hstack([small(images["0.png"]), small(images["1.png"])])).all()
    assert (got["000000002"][:, 20:] == small(images["2.png"])).all() and not got["000000002"][:, :20].any()


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_files_read_back(spark, tmp_path, channels):
    rnd = np.random.default_rng(channels)
    made = {f"sub/{k}.jpg": noise(rnd, h, w, channels) if k % 2 else np.cumsum(np.ones((h, w, channels), np.uint8) * 3, axis=k % 3, dtype=np.uint8) for k, (h, w) in enumerate([(1, 1), (64, 7), (65, 30), (200, 50)])}
    rows = spark.createDataFrame([(k, *v.shape[:2], v.tobytes()) for k, v in made.items()], "imagefile string, height int, width int, data binary")
    assert pictures.write_pngs(raster.strips_of(rows), f"file://{tmp_path}") == 4
    got = {r.imagefile: r for r in pictures.read_pictures(spark, f"{tmp_path}/sub/*.png", str(tmp_path)).collect()}
    for name, v in made.items():
        r = got[name.replace(".jpg", ".png")]
        assert (r.height, r.width) == v.shape[:2] and bytes(r.data) == v.tobytes(), name


def test_two_channels_and_chunks(spark, tmp_path):
    v = noise(np.random.default_rng(0), 150, 9, 2)
    rows = spark.createDataFrame([("x", 150, 9, v.tobytes())], "imagefile string, height int, width int, data binary")
    assert pictures.write_pngs(raster.strips_of(rows), f"file://{tmp_path}", level=9) == 1
    data, at, kinds, body = (tmp_path / "x.png").read_bytes(), 8, [], b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        kinds.append(kind)
        body += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += n + 12
    assert kinds == [b"IHDR", *[b"IDAT"] * 4, b"IEND"] and len(zlib.decompress(body)) == 150 * 19  # the checksum holds


def test_a_checksum_of_parts():
    a, b = bytes(range(256)) * 9, b"\xff" * 100_000
    assert pictures.adler_of_both(zlib.adler32(a), zlib.adler32(b), len(b)) == zlib.adler32(a + b)
