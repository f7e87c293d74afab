"""Formats as data sources: the same datasets as the import functions, files that filters leave out, committed writes."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.dataset import TABLES, Dataset
from quillframe.sources import exports, formats, imports


def same(a, b):
    return all(sorted(map(tuple, a.table(t).collect()), key=repr) == sorted(map(tuple, b.table(t).collect()), key=repr) for t in TABLES)


LINE = "Car 0.0 1 -1.5 {} 20.5 40 60 1 2 3 4 5 6 0.1"


@pytest.fixture
def kitti(tmp_path):
    (tmp_path / "kitti").mkdir()
    for k in range(6):
        (tmp_path / f"kitti/{k:03}.txt").write_text("" if k == 4 else "\r\n".join([LINE.format(k), "too short", LINE.format(10 + k) + " 0.75"]))
    return tmp_path / "kitti"


def test_kitti(spark, kitti):
    rows = formats.read(spark, "kitti", f"file://{kitti}", partition_bytes=250)
    assert rows.rdd.getNumPartitions() == 3
    got, want = imports.from_kitti_rows(rows), imports.import_kitti(spark, str(kitti))
    assert same(got, want) and got.objects.count() == 10 and got.images.count() == 6
    (kitti / "003.txt").write_bytes(b"\xff\xfe not text")  # a file that no filter lets through is not opened
    assert {r.left for r in rows.filter("stem = '001'").collect()} == {"1", "11"}
    assert rows.filter("stem in ('000', '005') or false").count() == 4 and rows.filter("file like '%/002.txt'").count() == 2
    plan = rows.filter("stem = '001'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and rows.filter("stem = '001'").rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="003.txt"):
        rows.count()


VOC = """<annotation><filename>{0}.jpg</filename><size><width>100</width><height>50</height><depth>3</depth></size>
<object><name>person</name><pose>Left</pose><truncated>1</truncated><bndbox><xmin>{0}.6</xmin><ymin>2</ymin><xmax>30</xmax><ymax>40</ymax></bndbox>
<part><name>head</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>9</xmax><ymax>10</ymax></bndbox></part><part><name>foot</name><bndbox><xmin>15</xmin><ymin>16</ymin><xmax>19</xmax><ymax>20</ymax></bndbox></part></object>
<object><name>dog</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object></annotation>"""


def test_voc(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.xml").write_text(VOC.format(k))
    rows = formats.read(spark, "voc", f"file://{tmp_path}")
    assert same(imports.from_pascal(rows), imports.import_pascal(spark, str(tmp_path))) and imports.from_pascal(rows).polygons.count() == 24
    (tmp_path / "2.xml").write_text("<annotation>")
    assert rows.filter("stem = '1'").first().size.width == 100
    with pytest.raises(Exception, match="2.xml"):
        rows.count()


def test_voc_objects_keep_their_properties(spark):
    """In an order that changes whenever the rows are made again, and where two annotations are of one picture."""
    box = (1.0, 2.0, 3.0, 4.0)
    objects = lambda f: [(f"{f}-{k}", None, None, f"{f}-{k}", None, box, [(f"{f}-{k}", box)]) for k in range(12)]
    rows = spark.createDataFrame([("a" if f == "c" else f, (9, 9), objects(f)) for f in "abc"], imports.PASCAL)
    mixed = F.udf(lambda o: random.sample(o, len(o)), rows.schema["object"].dataType).asNondeterministic()
    ds = imports.from_pascal(rows.withColumn("object", mixed("object")))
    hard = ds.properties.filter("key = 'difficult'").select("objectid", "value")
    assert {(r.name, r.value) for r in ds.objects.join(hard, "objectid").collect()} == {(n, n) for f in "abc" for n in (o[0] for o in objects(f))}
    assert (ds.objects.count(), ds.properties.count(), ds.polygons.count()) == (36, 144, 144)
    named = ds.polygons.select("objectid", F.col("name").alias("part")).distinct().join(ds.objects, "objectid")
    assert named.filter("part = name").count() == named.count() == 36
    assert sorted(r.id for r in ds.properties.collect()) == list(range(1, 145)) and sorted(r.objectid for r in ds.objects.collect()) == list(range(1, 37))


def test_labelme_and_yolo(spark, tmp_path):
    polygons = [(k, 1 + k // 3 % 2, float(7 * k % 40), float(5 * k % 30), "ab"[k // 6] if k < 6 else "b") for k in range(12)]
    ds = Dataset.from_rows(spark, images=[("d/a.jpg", 100, 50, None, None, None, None), ("d/b.jpg", 100, 50, None, None, None, None)], objects=[(1, "d/a.jpg", 10.0, 5.0, 20.0, 10.0, "car & co", None), (2, "d/b.jpg", 0.0, 0.0, 50.0, 50.0, "bus", None)], properties=[(1, 1, "occluded", "true"), (2, 2, "red", "true")], polygons=polygons)
    formats.register(spark)
    path = f"file://{tmp_path}/xml"
    exports.labelme_records(ds, "f").repartition(2).write.format("labelme").mode("append").save(path)
    rows = formats.read(spark, "labelme", path)
    assert sorted(x.name for x in (tmp_path / "xml").iterdir()) == ["a.xml", "b.xml"]
    assert same(imports.from_labelme(rows, "d", names_by_user=True), imports.import_labelme(spark, str(tmp_path / "xml"), "d", names_by_user=True))
    lines = exports.yolo_lines(ds, ["car & co", "bus"])
    lines.write.format("yolo").mode("append").save(f"file://{tmp_path}/yolo")
    assert {x.name: x.read_text() for x in (tmp_path / "yolo").iterdir()} == {f"{r.file}.txt": r.text for r in lines.collect()}
    # an overwrite replaces all files of its kind; one that fails changes nothing
    (tmp_path / "yolo/readme.md").write_text("stays")
    with pytest.raises(Exception, match="two rows"):
        lines.union(lines).write.format("yolo").mode("overwrite").save(f"file://{tmp_path}/yolo")
    assert sorted(x.name for x in (tmp_path / "yolo").iterdir()) == ["a.txt", "b.txt", "readme.md"]
    lines.filter("file = 'b'").write.format("yolo").mode("overwrite").save(f"file://{tmp_path}/yolo")
    assert sorted(x.name for x in (tmp_path / "yolo").iterdir()) == ["b.txt", "readme.md"]
    with pytest.raises(Exception, match="columns are needed"):
        lines.select("file").write.format("yolo").mode("append").save(f"file://{tmp_path}/yolo")
