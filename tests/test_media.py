"""Pixels, grids by time, batches and image files."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.dataset import Dataset
from quillframe.functions.spans import filled
from quillframe.operators import evaluate, filters, media, modify, samples
from quillframe.sources import imports


def png(width, height):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes(width) for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(7, 5))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    ds = Dataset.from_rows(spark, rootdir=str(tmp_path), images=[("a.png", 7, 5, None, None, None, None), ("bad.png", 7, 5, None, None, None, None), ("gone.png", 7, 5, None, None, None, None)])
    assert [r.imagefile for r in filters.filter_bad_images(ds).images.collect()] == ["a.png"]
    assert {(r.imagefile, r.file) for r in media.missing_media(ds).collect()} == {("gone.png", "gone.png")}
    added = imports.add_pictures(Dataset.empty(spark), f"{tmp_path}/a.png", f"{tmp_path}/*.png").images.first()
    assert (added.width, added.height) == (7, 5) and added.maskfile.endswith("/a.png")


def test_masks(spark):
    m = spark.createDataFrame([("a", 2, 3, bytes([1, 2, 3, 4, 5, 6]))], evaluate.MASK)
    cut = media.crop_pixels(m, 1, 0, 4, 2).first()
    assert (cut.height, cut.width, list(cut.data)) == (2, 3, [2, 3, 0, 5, 6, 0])
    assert list(media.subtract_mask(m, spark.createDataFrame([("a", 2, 3, bytes([2] * 6))], evaluate.MASK)).first().data) == [255, 0, 1, 2, 3, 4]
    truth = spark.createDataFrame([("a", 1, 4, bytes([0, 0, 255, 255]))], evaluate.MASK)
    said = spark.createDataFrame([("a", 1, 4, bytes([10, 200, 100, 220]))], evaluate.MASK)
    curve, area = evaluate.evaluate_binary_segmentation(said, truth)
    at = {r.threshold: (r.precision, r.recall) for r in curve.collect()}
    assert at[150] == (0.5, 0.5) and at[210] == (1.0, 0.5) and at[0] == (0.5, 1.0)
    assert 0 < area.first()["area"] <= 1
    ds = Dataset.from_rows(spark, images=[("a", 4, 1, None, None, None, None)])
    scored, whole = evaluate.evaluate_segmentation(ds, media.repaint_mask(said, {">=150": 1, "<150": 0}), media.repaint_mask(truth, {255: 1}), 2)
    assert scored.images.first()["score"] == pytest.approx(1 / 3) and whole.first()["pixel_accuracy"] == 0.5


def test_grid_shows_the_latest_image_of_each_folder(spark):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    ds = Dataset.from_rows(spark, images=[(f, 1, 1, None, t(s), None, None) for f, s in (("x/1", 0), ("x/2", 2.5), ("y/1", 1), ("y/2", 4))])
    shown = {(r.tick, r.folder): r.imagefile for r in media.grid_by_time(ds, fps=1).collect()}
    placed = media.place_in_grid(media.grid_by_time(ds, fps=1), ["y", "x"], 2, 30, 20).filter("tick = 3").collect()
    assert {(r.folder, r.x, r.y) for r in placed} == {("y", 0, 0), ("x", 30, 0)}
    assert shown == {(1, "x"): "x/1", (2, "x"): "x/1", (3, "x"): "x/2", (2, "y"): "y/1", (3, "y"): "y/1"}


def test_crops_tiles_and_paths(spark):
    ds = Dataset.from_rows(spark, images=[("d/a.jpg", 100, 50, "m/a.png", None, None, None)], objects=[(k, "d/a.jpg", 10.0 * k, 5.0, 20.0, 10.0, "car", 0.5) for k in range(3)], properties=[(1, 0, "p", "q")])
    crops = media.crop_objects(ds, "crops", 40, 40)
    assert crops.images.count() == 3 and {(o.x1, o.width) for o in crops.objects.collect()} == {(0.0, 40.0)}
    with pytest.raises(ValueError):
        media.crop_objects(crops, "again", 10, 10)
    back = modify.revert_object_transforms(media.tile_objects(ds, "tiles", 30, 30, rows=1, columns=2))
    assert sorted((o.objectid, round(o.x1, 6), o.imagefile) for o in back.objects.collect()) == [(k, 10.0 * k, "d/a.jpg") for k in range(3)]
    assert media.tile_objects(ds, "tiles", 30, 30, rows=1, columns=2).images.count() == 2
    written = media.write_media(ds, "out", "masks").images.first()
    assert (written.imagefile, written.maskfile) == ("out/d/a.jpg", "masks/a.png")
    b = samples.batches(samples.object_samples(ds), "objectid", 2).orderBy("objectid").collect()
    assert [(r.batch, r.place) for r in b] == [(0, 0), (0, 1), (1, 0)]


FRAMES = [
    # edges, box (y1, x1, y2, x2), height, width; where the box lies in the crop, and its size
    ("original", (-10, 30, 10, 70), None, None, (0, 0, 20, 40), (20, 40)),
    ("original", (40, 170, 60, 210), None, None, (0, 0, 20, 40), (20, 40)),
    ("distort", (40, 30, 60, 70), 40, 40, (0, 0, 40, 40), (40, 40)),
    ("constant", (40, 30, 60, 70), 40, 40, (10, 0, 30, 40), (40, 40)),
    ("constant", (40, 30, 80, 50), 40, 40, (0, 10, 40, 30), (40, 40)),
    ("background", (45, 40, 55, 60), 20, 20, (5, 0, 15, 20), (20, 20)),
    ("background", (40, 45, 60, 55), 20, 20, (0, 5, 20, 15), (20, 20)),
    ("background", (0, 40, 10, 60), 20, 20, (5, 0, 15, 20), (20, 20)),
    ("background", (0, 40, 10, 60), 40, 40, (10, 0, 30, 40), (40, 40)),
]


@pytest.mark.parametrize("edges, roi, height, width, inside, size", FRAMES)
def test_crops_by_edges(spark, edges, roi, height, width, inside, size):
    y1, x1, y2, x2 = map(float, roi)
    ds = Dataset.from_rows(spark, images=[("a", 200, 100, None, None, None, None)], objects=[(1, "a", x1, y1, x2 - x1, y2 - y1, "n", None)])
    out = media.crop_objects(ds, "crops", width, height, edges=edges)
    o, i = out.objects.first(), out.images.first()
    assert (o.y1, o.x1, o.y1 + o.height, o.x1 + o.width) == pytest.approx(inside) and (i.height, i.width) == size
    assert {(p.key, p.value) for p in out.properties.filter("key in ('cropped', 'original_objectid')").collect()} == {("cropped", "true"), ("original_objectid", "1")}
    whole = (np.arange(100)[:, None] + np.arange(200)[None, :]).astype(np.uint8)
    cut = media.crop_object_pixels(ds, spark.createDataFrame([("a", 100, 200, whole.tobytes())], evaluate.MASK), edges, width, height).first()
    part = np.frombuffer(cut.data, np.uint8).reshape(cut.height, cut.width)
    assert part.shape == size
    k = (inside[2] - inside[0]) / (y2 - y1), (inside[3] - inside[1]) / (x2 - x1)
    for y in range(size[0]):
        for x in (0, size[1] // 2, size[1] - 1):
            there = int(np.floor((y - inside[0]) / k[0] + y1)), int(np.floor((x - inside[1]) / k[1] + x1))
            seen = 0 <= there[0] < 100 and 0 <= there[1] < 200 and (edges != "constant" or (inside[0] <= y < inside[2] and inside[1] <= x < inside[3]))
            assert part[y, x] == (whole[there] if seen else 0), (y, x)


def test_crops_need_a_size_and_an_area(spark):
    ds = Dataset.from_rows(spark, images=[("a", 200, 100, None, None, None, None)], objects=[(1, "a", 9.1, 20.0, 2.8, 20.0, None, None)])
    with pytest.raises(ValueError, match="needed"):
        media.crop_objects(ds, "crops", edges="constant")
    with pytest.raises(ValueError, match="small"):
        media.crop_objects(ds, "crops", 20, 20, edges="constant")
    with pytest.raises(ValueError, match="one of"):
        media.crop_objects(ds, "crops", 20, 20, edges="round")


def test_crops_take_other_objects_along(spark):
    ds = Dataset.from_rows(
        spark,
        images=[("a", 200, 100, "m", None, None, None)],
        objects=[(1, "a", 10.0, 10.0, 20.0, 20.0, "car", None), (2, "a", 15.0, 15.0, 5.0, 5.0, "wheel", None), (3, "a", 100.0, 10.0, 20.0, 20.0, "car", 0.5)],
        properties=[(1, 2, "size", "small")],
        polygons=[(1, 2, 15.0, 15.0, "p")],
        matches=[(1, 4, 1), (2, 4, 2)],
    )
    out = media.crop_objects(ds, "crops", 40, 40, where_object="name = 'car'", where_other_objects="name = 'wheel'", name_in_file=True, mask_path="masks")
    got = sorted((o.objectid, o.imagefile, o.name, o.x1, o.width) for o in out.objects.collect())
    assert got == [(1, "crops/car-000000001.jpg", "car", 0.0, 40.0), (2, "crops/car-000000001.jpg", "wheel", 10.0, 10.0), (3, "crops/car-000000003.jpg", "wheel", -170.0, 10.0), (4, "crops/car-000000003.jpg", "car", 0.0, 40.0)]
    assert out.properties.filter("key = 'size'").count() == 2 and out.polygons.count() == 2 and sorted(m.objectid for m in out.matches.collect()) == [1, 2, 3]
    assert {i.maskfile for i in out.images.collect()} == {"masks/car-000000001.png", "masks/car-000000003.png"}
    assert {(p.objectid, p.value) for p in out.properties.filter("key = 'original_objectid'").collect()} == {(1, "1"), (2, "2"), (3, "2"), (4, "3")}


def test_tiles_begin_anew_with_each_name(spark):
    ds = Dataset.from_rows(spark, images=[("a", 900, 100, None, None, None, None)], objects=[(k, "a", 30.0 * k, 5.0, 20.0, 10.0, n, None) for k, n in enumerate([None, "x", "x", "x", "y"])])
    out = media.tile_objects(ds, "t", 40, 40, rows=1, columns=2, split_by_name=True)
    assert {o.objectid: o.imagefile for o in out.objects.collect()} == {0: "t/000000.jpg", 1: "t/000001.jpg", 2: "t/000001.jpg", 3: "t/000002.jpg", 4: "t/000003.jpg"}
    for edges in ("constant", "background", "distort"):
        back = modify.revert_object_transforms(media.tile_objects(ds, "t", 40, 30, edges=edges))
        assert sorted((o.objectid, round(o.x1, 6), round(o.y1, 6), round(o.width, 6), o.imagefile) for o in back.objects.collect()) == [(k, 30.0 * k, 5.0, 20.0, "a") for k in range(5)]


def test_masks_of_empty_images_and_checks(spark):
    ds = Dataset.from_rows(spark, images=[("a", 8, 6, "x", None, None, None), ("b", 4, 2, None, None, None, None), ("c", None, None, None, None, None, None)], objects=[(1, "a", 1.0, 1.0, 3.0, 2.0, None, None)])
    assert {(r.imagefile, len(r.data), max(r.data)) for r in media.polygons_to_mask(ds, boxes_too=True).collect()} == {("a", 48, 255), ("b", 8, 0)}
    assert [r.imagefile for r in media.polygons_to_mask(ds, boxes_too=True, skip_empty=True).collect()] == ["a"]
    good = [("a", 60, 40, "x", None, None, None), ("b", 60, 40, "x", None, None, None), (None, 60, 40, "x", None, None, None), ("d", 300, 500, None, None, None, None), ("e", 400, 600, None, None, None, None)]
    modify.check_mask_sizes(Dataset.from_rows(spark, images=good))
    with pytest.raises(ValueError, match="share a mask"):
        modify.resize_annotations(Dataset.from_rows(spark, images=[*good, ("f", 100, 100, "x", None, None, None)]), width=10)


def test_segmentation_by_class_names(spark):
    truth = spark.createDataFrame([("a", 1, 6, bytes([0, 0, 200, 255, 7, 0]))], evaluate.MASK)
    said = spark.createDataFrame([("a", 1, 6, bytes([1, 2, 2, 2, 1, 9]))], evaluate.MASK)
    ds = Dataset.from_rows(spark, images=[("a", 6, 1, None, None, None, None)])
    out, whole, per_class = evaluate.evaluate_segmentation_by_class(ds, said, truth, {0: "road", ">=200": "car"}, {1: "road", 2: "car"}, "car")
    # the pixels 7 and 9 have no class; of the rest: road is 1 of 2, car 2 of 3
    assert {r["name"]: r.iou for r in per_class.collect()} == {"road": 0.5, "car": pytest.approx(2 / 3)}
    assert out.images.first()["score"] == pytest.approx(2 / 3) and whole.first()["pixel_accuracy"] == 0.75
    with pytest.raises(ValueError, match="only"):
        evaluate.evaluate_segmentation_by_class(ds, said, truth, {0: "road"}, {1: "bus"})


def test_samples_for_training(spark):
    ds = Dataset.from_rows(spark, images=[("a", 1, 1, None, None, None, None)], objects=[(k, "a", None, None, None, None, "n", 0.1 * k) for k in range(7)])
    chosen = samples.transformed(samples.select_keys(samples.object_samples(ds), {"objectid": "id", "score": "score"}), {"score": lambda c: c * 10})
    got = list(samples.iterate(samples.batches(chosen, "id", 3)))
    assert [[r["id"] for r in b] for b in got] == [[0, 1, 2], [3, 4, 5], [6]] and got[1][0]["score"] == pytest.approx(3.0)
    assert sorted(r["id"] for b in samples.iterate(samples.batches(chosen, "id", 2, seed=1)) for r in b) == list(range(7))
    assert samples.transformed(chosen, lambda df: df.filter("id > 4")).count() == 2
    for bad in (lambda: samples.select_keys(chosen, ["absent"]), lambda: samples.transformed(chosen, {"absent": F.abs})):
        with pytest.raises(ValueError):
            bad()
    out = samples.add_records(ds, [(1, "said", "yes"), (2, "said", "no")])
    assert sorted((p.id, p.objectid, p.value) for p in out.properties.collect()) == [(1, 1, "yes"), (2, 2, "no")]
    with pytest.raises(KeyError):
        samples.add_records(ds, [(99, "k", "v")])


def test_interactive_effects(spark):
    ds = Dataset.from_rows(spark, images=[("a", 1, 1, None, None, None, None)], objects=[(k, "a", None, None, None, None, "n", None) for k in range(4)], matches=[(1, 5, 0)])
    one = modify.add_match(ds, 0, 1)
    assert sorted((m.match, m.objectid) for m in one.matches.collect()) == [(5, 0), (5, 1)]
    two = modify.add_match(modify.add_match(one, 2, 3), 1, 2)
    assert {m.match for m in two.matches.collect()} == {5}
    assert modify.set_image_name(ds, "a", "seen").images.first()["name"] == "seen" and modify.unname_object(ds, 1).objects.filter("name is null").count() == 1
    once = modify.set_property(modify.set_property(ds, 1, "k", "v"), 1, "k", "w")
    assert [(p.objectid, p.value) for p in once.properties.collect()] == [(1, "w")] and modify.set_property(once, 1, "k", None).properties.count() == 0
    assert once.properties.filter(F.col("key") == "k").count() == 1 and np.isfinite(1.0)


def test_masks_of_many_images_equal_those_of_one(spark, monkeypatch):
    """Boxes, polygons, objects of several rings, images in several Arrow batches and blocks, against each object painted alone."""
    rnd = np.random.default_rng(3)
    images = [(f"i{k:02}", int(w), int(h), None, None, None, None) for k, (w, h) in enumerate(rnd.integers(1, 40, (30, 2)))] + [("none", None, 5, None, None, None, None)]
    objects = [(k, f"i{int(i):02}", *map(float, rnd.integers(-10, 60, 4) / 2), "x", None) for k, i in enumerate(rnd.integers(0, 25, 120))] + [(500, "lost", 0.0, 0.0, 9.0, 9.0, "x", None)]
    rings = {(k, name): rnd.integers(-20, 80, (int(rnd.integers(1, 7)), 2)) / 2 for k in range(0, 120, 2) for name in ("a", "b", None)[: int(rnd.integers(1, 4))]}
    polygons = [(n, k, *map(float, p), name) for n, (k, name, p) in enumerate((k, name, p) for (k, name), ring in rings.items() for p in ring)] + [(900, 0, None, 1.0, "a")]
    ds = Dataset.from_rows(spark, images=images, objects=objects, polygons=polygons)
    monkeypatch.setattr(media, "BLOCK_PIXELS", 500)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = {r.imagefile: r for r in media.polygons_to_mask(ds, boxes_too=True).collect()}
        some = {r.imagefile for r in media.polygons_to_mask(ds, boxes_too=True, skip_empty=True).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(found) == {f"i{k:02}" for k in range(30)}
    for file, w, h, *_ in images[:-1]:
        total = np.zeros((h, w), int)
        for k, _, x, y, ow, oh, *_ in (o for o in objects if o[1] == file):
            own = [ring for (n, _), ring in rings.items() if n == k] or [np.array([(x, y), (x + ow, y), (x + ow, y + oh), (x, y + oh)])]
            parts = np.zeros((h, w), int)
            for ring in own:
                for row, a, b in filled(ring, w, h).tolist():
                    parts[row, a : b + 1] += 255
            total += parts // len(own)
        assert (found[file].height, found[file].width) == (h, w) and np.array_equal(np.frombuffer(found[file].data, np.uint8).reshape(h, w), np.minimum(total, 255)), file
        assert (file in some) == bool(total.any())


def test_masks_are_painted_without_a_call_for_each_image(spark):
    n = 4000
    ds = Dataset.from_rows(spark)
    ds = ds.with_(images=spark.range(n).selectExpr("cast(id as string) imagefile", "100 width", "75 height", "null maskfile", "null timestamp", "null name", "null score"), objects=spark.range(5 * n).selectExpr("id objectid", f"cast(id % {n} as string) imagefile", "double(id % 60) x1", "double(id % 50) y1", "20.0 width", "15.0 height", "'x' name", "null score"))
    masks = media.polygons_to_mask(ds, boxes_too=True)
    assert "FlatMapGroups" not in masks._jdf.queryExecution().executedPlan().toString()
    both = media.repaint_mask(masks, {"0": 0, ">0": 1})
    scored, _ = evaluate.evaluate_segmentation(ds, both, both, 2)
    assert scored.images.filter("score = 1").count() == n
