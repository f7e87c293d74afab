"""A stream of annotations out of order, with repeats and a failure, ends as one import of everything."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe import versions
from quillframe.dataset import Dataset
from quillframe.streaming import imports

NAMES = [x.split(" ")[0] for x in imports.EVENT.split(", ")]


def event(**values):
    return tuple(values.get(c) for c in NAMES)


def some_events():
    rnd = random.Random(3)
    out = [event(kind="image", imagefile=f"{k}.jpg", width=100, height=50 + k) for k in range(6)]
    for k in range(30):
        key = f"cam-{k}"
        out.append(event(kind="object", key=key, imagefile=f"{k % 6}.jpg", x1=float(k), y1=2.0, box_width=3.0, box_height=4.0, name=rnd.choice(["car", "bus", None]), score=None if k % 5 == 0 else k / 30))
        for ring in [None, "a", "b"][: k % 4]:
            n = rnd.randint(3, 6)
            out.append(event(kind="ring", key=key, name=ring, xs=[float(rnd.randint(0, 99)) for _ in range(n)], ys=[float(rnd.randint(0, 49)) for _ in range(n)]))
        out += [event(kind="property", key=key, name=p, value=str(rnd.randint(0, 9))) for p in ("yaw", "color")[: k % 3]]
        if k % 2:
            out.append(event(kind="match", key=key, match=f"pair {k // 4}"))
    return out + [event(kind="ring", key="never comes", xs=[1.0], ys=[1.0]), event(kind="property", key=None, name="x")]


def content(ds):
    """Tables with objects by their keys instead of ids, vertices in order, groups as sets."""
    keys = {r.objectid: r.key for r in imports.keys_of(ds).collect()}
    objects = sorted(((keys[r.objectid], *tuple(r)[1:]) for r in ds.objects.collect()), key=repr)
    rings, groups = {}, {}
    for r in ds.polygons.orderBy("id").collect():
        rings.setdefault((keys[r.objectid], r.name), []).append((r.x, r.y))
    for r in ds.matches.collect():
        groups.setdefault(r.match, set()).add(keys[r.objectid])
    properties = sorted((keys[r.objectid], r.key, r.value) for r in ds.properties.collect() if not r.key.startswith("source_"))
    ids = [r.id for t in ("properties", "polygons", "matches") for r in [ds.table(t).agg(F.count("id").alias("id")).first(), ds.table(t).agg(F.count_distinct("id").alias("id")).first()]]
    assert ids[::2] == ids[1::2] and len(set(keys)) == len(keys)
    return sorted(map(tuple, ds.images.collect()), key=repr), objects, rings, properties, sorted(map(sorted, groups.values()))


def test_a_stream_ends_as_a_batch_import_does(spark, tmp_path, monkeypatch):
    events = some_events()
    whole, waiting = imports.applied(Dataset.empty(spark), None, spark.createDataFrame(events, imports.EVENT))
    want = content(whole)
    assert [r.key for r in waiting.collect()] == ["never comes"] and len(want[1]) == 30 and len(want[4]) > 5

    rnd = random.Random(8)
    order = events * 1
    rnd.shuffle(order)
    source, path = tmp_path / "in", f"file://{tmp_path}/db"
    source.mkdir()

    def arrive(k, rows):
        spark.createDataFrame(rows, imports.EVENT).coalesce(1).write.json(str(tmp_path / f"part{k}"))
        next((tmp_path / f"part{k}").glob("*.json")).rename(source / f"{k}.json")

    step = len(order) // 3 + 1
    for k in range(2):
        arrive(k, order[k * step : (k + 1) * step] + rnd.sample(order[: (k + 1) * step], 10))  # some again

    def run():
        rows = spark.readStream.schema(imports.EVENT).option("maxFilesPerTrigger", 1).json(str(source))
        imports.start(rows, path, str(tmp_path / "checkpoint")).awaitTermination()

    run()
    assert versions.versions(spark, path) == [1, 2] and versions.notes(spark, path, 2) == {"streams": {"events": 1}}
    ids = {r.key: r.objectid for r in imports.keys_of(versions.open_version(spark, path)).collect()}
    assert versions.open_table(spark, path, "pending").count() > 1
    arrive(2, order[2 * step :])

    # the job dies after its commit and before the stream knows: the batch comes again and changes nothing
    real = imports.commit

    def dies(*args, **more):
        real(*args, **more)
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(imports, "commit", dies)
        with pytest.raises(Exception, match="gone"):
            run()
    assert versions.versions(spark, path)[-1] == 3
    run()
    assert versions.versions(spark, path)[-1] == 3
    last = versions.open_version(spark, path)
    assert content(last) == want
    now = {r.key: r.objectid for r in imports.keys_of(last).collect()}
    assert len(now) == 30 and all(now[k] == v for k, v in ids.items()) and 0 < len(ids) < 30
    assert [r.key for r in versions.open_table(spark, path, "pending").collect()] == ["never comes"]
