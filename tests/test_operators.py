"""Operators on small literal datasets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.dataset import Dataset
from quillframe.functions import geometry, paths
from quillframe.operators import algebra, evaluate, filters, info, media, modify, samples


def image(name, width=800, height=700, **more):
    return (name, width, height, more.get("maskfile"), None, more.get("name"), more.get("score"))


def thing(i, file="a.jpg", box=(None,) * 4, name=None, score=None):
    return (i, file, *map(lambda v: None if v is None else float(v), box), name, score)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture
def three(spark):
    return Dataset.from_rows(
        spark,
        images=[image("a.jpg"), image("b.jpg"), image("c.jpg")],
        objects=[thing(1, "a.jpg", (10, 10, 10, 10), "cat", 0.1), thing(2, "b.jpg", (10, 15, 10, 10), "dog"), thing(3, "b.jpg", (15, 10, 10, 10), "pig", 0.9), thing(4, None, (0, 0, 5, 5), None, 0.5)],
        properties=[(1, 1, "yaw", "10"), (2, 2, "yaw", "20"), (3, 2, "color", "red")],
        polygons=[(k, 2, float(x), float(y), None) for k, (x, y) in enumerate(((10, 15), (20, 15), (20, 25), (10, 25)))],
        matches=[(1, 7, 1), (2, 7, 2)],
    )


def test_cascades_keep_children_in_step(three):
    out = three.drop_images(three.images.filter("imagefile = 'b.jpg'"))
    assert rows(out.objects, "objectid") == [(1,), (4,)]
    assert rows(out.properties, "id") == [(1,)] and out.polygons.count() == 0 and rows(out.matches, "id") == [(1,)]


def test_filters_leave_unknown_values_alone(three):
    assert rows(filters.filter_objects_by_score(three, 0.5).objects, "objectid") == [(2,), (3,), (4,)]
    assert rows(filters.filter_objects_by_name(three, ["cat"]).objects, "objectid") == [(2,), (3,), (4,)]
    assert rows(filters.filter_objects_by_name(three, ["cat"], keep=True).objects, "objectid") == [(1,), (4,)]
    assert rows(filters.filter_images_without_objects(three).images, "imagefile") == [("a.jpg",), ("b.jpg",)]


def test_filter_inside(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg")], objects=[thing(0, box=(40, 20, 40, 20), name="shadow"), thing(1, box=(45, 25, 10, 10), name="in"), thing(2, box=(0, 0, 10, 10), name="out")])
    assert rows(filters.filter_objects_inside_certain_objects(ds, "name = 'shadow'").objects, "objectid") == [(0,), (2,)]
    assert rows(filters.filter_objects_inside_certain_objects(ds, "name = 'shadow'", keep=True).objects, "objectid") == [(0,), (1,)]


def test_boxes_and_polygons(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg")], objects=[thing(1, box=(40, 20, 10, 10)), thing(2, box=(20.5, 30.5, 20.5, 10.5)), thing(3)], polygons=[(1, 1, 40.0, 20.0, None), (2, 1, 40.5, 30.5, None), (3, 1, 50.5, 30.0, None)])
    assert rows(modify.polygons_to_bboxes(ds).objects.filter("objectid = 1"), *geometry.BOX) == [(40.0, 20.0, 10.5, 10.5)]
    made = modify.bboxes_to_polygons(ds).polygons.filter("objectid = 2").orderBy("id")
    assert [(r.x, r.y) for r in made.collect()] == [(20.5, 30.5), (41.0, 30.5), (41.0, 41.0), (20.5, 41.0)]


def test_expand(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg")], objects=[thing(1, box=(40, 20, 10, 10))], polygons=[(k, 1, float(x), float(y), None) for k, (x, y) in enumerate(((40, 20), (50, 20), (50, 30), (40, 30)))])
    plain = modify.expand_objects(ds, 1.0)
    assert rows(plain.objects, *geometry.BOX) == [(35.0, 15.0, 20.0, 20.0)]
    assert rows(plain.polygons, "x", "y") == sorted([(35.0, 15.0), (55.0, 15.0), (55.0, 35.0), (35.0, 35.0)], key=repr)
    assert rows(modify.expand_objects(ds, 1.0, ratio=0.5).objects, *geometry.BOX) == [(35.0, 20.0, 20.0, 10.0)]
    with pytest.raises(ValueError):
        modify.expand_objects(ds, -0.6)


def test_merge_intersecting(spark):
    ds = Dataset.from_rows(
        spark,
        images=[image("a.jpg")],
        objects=[thing(0, box=(10, 10, 10, 10), name="cat", score=0.1), thing(1, box=(10, 15, 10, 10), name="dog"), thing(2, box=(15, 10, 10, 10), name="pika", score=0.2), thing(3, box=(100, 100, 5, 5), name="sheep")],
        properties=[(1, 0, "k", "v"), (2, 1, "k", "v"), (3, 0, "q", "1"), (4, 1, "q", "2")],
        matches=[(1, 1, 0), (2, 1, 1), (3, 2, 1), (4, 2, 3)],
    )
    out = modify.merge_intersecting_objects(ds, 0.1)
    assert rows(out.objects.filter("objectid = 0"), *geometry.BOX) == [(10.0, 10.0, 15.0, 15.0)]
    assert rows(out.objects, "objectid") == [(0,), (3,)]
    assert rows(out.matches, "match", "objectid") == [(2, 0), (2, 3)]
    kept = {(r.key, r.value) for r in out.properties.filter("objectid = 0").collect()}
    assert {("k", "v"), ("is_merged", "1"), ("merged_name", "cat"), ("merged_name", "dog")} <= kept and not any(k == "q" for k, _ in kept)


def test_transforms_round_trip(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg")], objects=[thing(1, box=(45, 25, 10, 10))], properties=[(1, 1, "kx", "2"), (2, 1, "ky", "0.5"), (3, 1, "bx", "5"), (4, 1, "by", "-5")])
    out = modify.revert_object_transforms(ds)
    assert rows(out.objects, *geometry.BOX) == [(20.0, 60.0, 5.0, 20.0)] and out.properties.count() == 0


def test_clip(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg", 200, 100)], objects=[thing(1, box=(-10, 10, 30, 30)), thing(2, box=(190, 90, 30, 30)), thing(3)], polygons=[(1, 3, -10.0, 10.0, None), (2, 3, 10.0, 10.0, None), (3, 3, 10.0, 30.0, None), (4, 3, -10.0, 30.0, None), (5, 1, 300.0, 300.0, None), (6, 1, 310.0, 300.0, None), (7, 1, 310.0, 310.0, None)])
    out = modify.clip_objects(ds)
    assert rows(out.objects.filter("objectid < 3"), *geometry.BOX) == sorted([(0.0, 10.0, 20.0, 30.0), (190.0, 90.0, 10.0, 10.0)], key=repr)
    assert {(r.x, r.y) for r in out.polygons.collect()} == {(0.0, 10.0), (10.0, 10.0), (10.0, 30.0), (0.0, 30.0)}


def test_add_and_split(three):
    double = algebra.add_dataset(three, three)
    assert double.images.count() == 3 and double.objects.count() == 8 and rows(double.matches, "match").count((7,)) == 2
    assert sorted(r[0] for r in rows(double.objects, "objectid")) == list(range(1, 9))
    moved = algebra.add_dataset(three, three, "other")
    assert rows(moved.images.filter("imagefile like 'other/%'"), "imagefile") == [("other/a.jpg",), ("other/b.jpg",), ("other/c.jpg",)]
    parts = algebra.split_dataset(three, {"one": 0.5, "two": 0.5})
    assert rows(parts["one"].images, "imagefile") == [("a.jpg",), ("b.jpg",)] and rows(parts["two"].images, "imagefile") == [("c.jpg",)]
    assert rows(parts["one"].objects, "objectid") == [(1,), (2,), (3,)]


def test_sync(three):
    moved = three.with_(objects=three.objects.filter("objectid < 4").withColumn("objectid", F.col("objectid") + 100))
    assert rows(algebra.sync_objectids(moved, three.with_(objects=three.objects.filter("objectid < 4"))).objects, "objectid") == [(1,), (2,), (3,)]
    shifted = three.with_(polygons=three.polygons.withColumns({"id": 50 - F.col("id"), "x": F.col("x") + 0.5}))
    assert rows(algebra.sync_polygon_ids(shifted, three).polygons, "id") == [(0,), (1,), (2,), (3,)]
    with pytest.raises(Exception, match="more than one way"):
        algebra.sync_polygon_ids(shifted, three, epsilon=50).polygons.collect()
    rounded = three.with_(objects=three.objects.withColumn("x1", F.col("x1") + 0.4))
    assert rows(algebra.sync_rounded_coordinates(rounded, three).objects, "x1") == rows(three.objects, "x1")


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / (a[2] * a[3] + b[2] * b[3] - both)


def test_sync_objectids_equals_greedy_pairs(spark):
    rnd = np.random.default_rng(4)
    files = ["a.jpg", "b.jpg"]
    box = lambda: tuple(float(v) for v in (*rnd.integers(0, 40, 2), *rnd.integers(10, 30, 2)))
    mine = {k: (files[k % 2], box()) for k in range(1, 30)}
    theirs = {100 + k: (files[k % 2], box()) for k in range(25)}
    make = lambda d: Dataset.from_rows(spark, images=[image(f) for f in files], objects=[thing(k, f, b) for k, (f, b) in d.items()])
    new, used = {}, set()
    for score, i, j in sorted(((_iou(b, c), i, j) for i, (f, b) in mine.items() for j, (g, c) in theirs.items() if f == g), key=lambda x: (-x[0], x[1], x[2])):
        if score >= 0.3 and i not in new and j not in used:
            new[i] = j
            used.add(j)
    for n, i in enumerate(k for k in mine if k not in new):
        new[i] = 125 + n
    out = algebra.sync_objectids(make(mine), make(theirs), 0.3)
    assert rows(out.objects, "objectid", "imagefile", "x1") == sorted(((new[i], f, b[0]) for i, (f, b) in mine.items()), key=repr) and len(used) > 5


def test_pairs_of_a_crowded_image_equal_brute_force(spark):
    rnd = np.random.default_rng(7)
    boxes = {k: tuple(float(v) for v in (*rnd.integers(-50, 900, 2), *rnd.integers(1, 60, 2))) for k in range(700)}
    boxes |= {1000: (0.0, 0.0, 900.0, 900.0), 1001: (5.0, 5.0, 0.0, 10.0), 1002: boxes[3]}
    ds = Dataset.from_rows(spark, images=[image("a.jpg"), image("b.jpg")], objects=[thing(k, "a.jpg", b) for k, b in boxes.items()] + [thing(5000, "b.jpg", (0, 0, 900, 900))])
    got = rows(filters.overlapping_pairs(ds.objects), "a_objectid", "b_objectid")
    real = {k: b for k, b in boxes.items() if b[2] * b[3] > 0}
    assert got == sorted(((i, j) for i, a in real.items() for j, b in real.items() if i != j and _iou(a, b) > 0), key=repr)


def test_detection_curves_equal_plain_loops(spark):
    """Average precision of many detections with ties and null scores, counted one by one."""
    rnd = np.random.default_rng(9)
    gt = [thing(k, "a.jpg", (20 * k, 0, 10, 10), "xy"[k % 2]) for k in range(80)]
    det = [thing(1000 + k, "a.jpg", (20 * (k % 90) + int(rnd.integers(0, 6)), 0, 10, 10), "xy"[k % 2], None if k % 17 == 0 else round(float(rnd.random()), 1 + k % 2)) for k in range(300)]
    g, d = (Dataset.from_rows(spark, images=[image("a.jpg")], objects=o) for o in (gt, det))
    judged = {r.objectid: r.outcome for r in evaluate.judged_detections(d, g).collect()}
    got = {r["name"]: (r.n_gt, r.ap) for r in evaluate.average_precision_envelope(d, g).collect()}
    for name in "xy":
        own = sorted((o for o in det if o[6] == name), key=lambda o: (o[7] is None, -(o[7] or 0), o[0]))
        hits = np.cumsum([judged[o[0]] == "tp" for o in own])
        precision = hits / np.arange(1, len(own) + 1)
        envelope = np.maximum.accumulate(precision[::-1])[::-1]
        ap = sum(e for e, o in zip(envelope, own) if judged[o[0]] == "tp") / 40
        assert got[name] == (40, pytest.approx(ap))
    curve = evaluate.precision_recall(d, g, mode="aggregate-classes").collect()
    for r in curve:
        assert r.tp == sum(x.hits for x in curve if x.score >= r.score)


def test_clipped_edges_have_the_clipped_area(spark):
    rnd = np.random.default_rng(3)
    points, rings = [], {}
    for k in range(40):
        centre, half = rnd.uniform(-20, 120, 2), rnd.uniform(5, 40, 2)
        rings[k] = np.array([centre + half * v for v in ((0, -1), (1, 0), (0, 1), (-1, 0))])
        points += [(4 * k + n, k, float(x), float(y), None) for n, (x, y) in enumerate(rings[k])]
    ds = Dataset.from_rows(spark, images=[image("a.jpg", 100, 80)], objects=[thing(k, "a.jpg", (0, 0, 1, 1)) for k in rings], polygons=points)
    got = {}
    for r in modify.clip_objects(ds).polygons.orderBy("id").collect():
        assert 0 <= r.x <= 100 and 0 <= r.y <= 80
        got.setdefault(r.objectid, []).append((r.x, r.y))
    frame = np.array([(0, 0), (100, 0), (100, 80), (0, 80)], float)
    for k, ring in rings.items():
        common, _ = geometry.slab_areas([ring, frame])
        own = np.array(got.get(k, [(0, 0)]))
        area = abs(np.dot(own[:, 0], np.roll(own[:, 1], -1)) - np.dot(np.roll(own[:, 0], -1), own[:, 1])) / 2
        assert area == pytest.approx(common, abs=1e-6)


def test_property_to_id_must_stay_unique(three):
    with pytest.raises(ValueError, match="unique"):
        modify.property_to_objects_field(modify.update(three, "properties", {"value": "'3'"}, "objectid = 1"), "objectid", "yaw")
    with pytest.raises(ValueError):
        modify.property_to_objects_field(three, "name", "absent")


def _ap(spark, gt, det):
    images = [image("a.jpg")]
    g, d = (Dataset.from_rows(spark, images=images, objects=o) for o in (gt, det))
    return evaluate.average_precision_envelope(d, g).first()["ap"], evaluate.average_precision(d, g).first()["ap"]


def test_average_precision(spark):
    a, b, far = (0, 0, 10, 10), (50, 50, 10, 10), (200, 200, 10, 10)
    assert _ap(spark, [thing(1, box=a, name="x")], [thing(1, box=a, name="x", score=1.0)]) == (1.0, 1.0)
    assert _ap(spark, [thing(1, box=a, name="x")], []) == (0.0, pytest.approx(0.0, abs=1e-5))
    one_each = _ap(spark, [thing(1, box=a, name="x"), thing(2, box=b, name="x")], [thing(1, box=a, name="x", score=0.5), thing(2, box=far, name="x", score=0.5)])
    assert one_each == (0.5, pytest.approx(0.25, abs=1e-3))


def test_reports_and_samples(three):
    assert tuple(info.info(three).first()) == (3, 0, 800, 700, 4, 2, 1)
    assert rows(info.histogram(three, "SELECT value FROM properties WHERE key = 'yaw'"), "x", "n") == [(10.0, 1), (20.0, 1)]
    d = algebra.diff(three.keep_objects(three.objects.filter("objectid > 1")), three).first()
    assert (d["objects_remaining"], d["objects_new"], d["objects_deleted"]) == (3, 0, 1)
    assert rows(samples.image_samples(three).select("imagefile", F.size("objects").alias("n")), "imagefile", "n") == [("a.jpg", 1), ("b.jpg", 2), ("c.jpg", 0)]
    assert samples.object_samples(three).filter("objectid = 2").first()["properties"] == {"yaw": "20", "color": "red"}


def test_masks(spark):
    ds = Dataset.from_rows(spark, images=[image("a.jpg", 8, 6)], objects=[thing(1, box=(1, 1, 3, 2))])
    m = media.polygons_to_mask(ds, boxes_too=True).first()
    assert int((np.frombuffer(m.data, np.uint8) == 255).sum()) == 12
    painted = media.repaint_mask(spark.createDataFrame([("a", 1, 3, bytes([0, 100, 255]))], evaluate.MASK), {">=200": 2, 0: 1}).first()
    assert list(painted.data) == [1, 100, 2]
    truth = spark.createDataFrame([("a", 1, 4, bytes([0, 0, 1, 1]))], evaluate.MASK)
    said = spark.createDataFrame([("a", 1, 4, bytes([0, 1, 1, 1]))], evaluate.MASK)
    _, whole = evaluate.segmentation_scores(evaluate.confusion(said, truth, 2))
    assert whole.first()["mean_iou"] == pytest.approx((1 / 2 + 2 / 3) / 2)


def test_slabs_are_exact():
    square = np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)
    diamond = np.array([(2, 0), (4, 2), (2, 4), (0, 2)], float)
    assert geometry.slab_areas([square, diamond]) == pytest.approx((2.0, 10.0))
    assert geometry.polygon_iou(square, square) == pytest.approx(1.0)


def test_paths(spark):
    p = spark.createDataFrame([("/a/b/../c//d.jpg",)], "p string")
    r = p.select(paths.normal(F.col("p")), paths.relative(paths.normal(F.col("p")), "/a/x"), paths.last_parts(F.col("p"), 1), paths.stem(F.col("p"))).first()
    assert tuple(r) == ("/a/c/d.jpg", "../c/d.jpg", "d.jpg", "d")


def test_images_by_number(three):
    assert len(three) == 3 and rows(three[1].objects, "objectid") == [(2,), (3,)] and rows(three[1].images, "imagefile") == [("b.jpg",)]
    for n in (3, -1):
        with pytest.raises(IndexError):
            three[n]


def test_save_and_load(three, tmp_path):
    three.save(str(tmp_path / "ds"))
    again = Dataset.load(three.spark, str(tmp_path / "ds"))
    assert rows(again.objects, "objectid", "x1", "name") == rows(three.objects, "objectid", "x1", "name")


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("bins, bandwidth", [(4096, None), (4096, 0.3), (10**6, None)])
def test_violin_densities_equal_a_direct_sum(spark, bins, bandwidth):
    rnd = np.random.default_rng(5)
    values = {"many": np.concatenate([rnd.normal(0, 1, 4000), rnd.normal(5, 0.5, 2000)]), "few": np.array([1.0, 2.0, 2.0, 7.0]), "one": np.array([3.0]), "same": np.array([4.0, 4.0])}
    rows = [(n, "a", float(v), 0.0, 1.0, 1.0, name, None) for n, (name, v) in enumerate((name, v) for name, own in values.items() for v in own)]
    ds = Dataset.from_rows(spark, images=[image("a")], objects=rows)
    got = {}
    for r in info.violin_density(ds, "SELECT name, x1 FROM objects", points=40, bandwidth=bandwidth, bins=bins).collect():
        got.setdefault(r.x, []).append((r.y, r.density))
    for name, own in values.items():
        h = bandwidth or (own.std(ddof=1) if len(own) > 1 else 0) * len(own) ** -0.2 or 1.0
        at = np.linspace(own.min() - 2 * h, own.max() + 2 * h, 40)
        direct = np.exp(-0.5 * ((at[:, None] - own) / h) ** 2).sum(1) / (len(own) * h * np.sqrt(2 * np.pi))
        y, density = np.array(sorted(got[name])).T
        assert np.allclose(y, at) and np.abs(density - direct).max() < 1e-6


def test_functions_in_sql(spark, three):
    one = lambda text: three.sql(f"SELECT {text} AS v").first().v
    assert one("box_overlap(0, 0, 10, 10, 5, 5, 10, 10)") == 25.0 and one("box_overlap(0, 0, 1, 1, 5, 5, 1, 1)") == 0.0
    assert one("box_iou(0, 0, 10, 10, 5, 5, 10, 10)") == pytest.approx(25 / 175) and one("box_iou(0, 0, 0, 0, 0, 0, 0, 0)") == 0.0 and one("box_iou(null, 0, 0, 0, 0, 0, 0, 0)") in (None, 0.0)
    ring = "array(" + ", ".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in ((0, 0), (10, 0), (10, 10), (5, 4), (0, 10))) + ")"
    assert one(f"ring_area({ring})") == 70.0 and one("ring_area(array())") == 0.0
    held = [one(f"ring_holds({ring}, {x}, {y})") for x, y in ((5, 2), (5, 4), (5, 5), (0, 10), (10, 5), (11, 5), (2, 5))]
    assert held == [True, True, False, True, True, False, True] and one("ring_holds(array(), 1, 1)") is False
    assert one("file_stem('a/b.c/d.e.jpg')") == "d.e" and one("file_stem('x')") == "x"
    rows = three.sql("SELECT c.* FROM VALUES (array(-5D, 5D, 5D, -5D), array(0D, 0D, 10D, 10D)), (null, null) AS t(xs, ys), LATERAL clip_polygon(xs, ys, 20, 20) c").collect()
    assert {(r.ring, r.x, r.y) for r in rows} == {(0, 0.0, 0.0), (0, 5.0, 0.0), (0, 5.0, 10.0), (0, 0.0, 10.0)} and sorted(r.place for r in rows) == [0, 1, 2, 3]
