"""Queries that apply the operators to the derived dataset, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..operators import algebra, evaluate, filters, info, media, modify, samples
from ..functions import dates, paths
from ..sources import exports
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its function's name; sql goes behind the derived tables' WITH clause (a leading comma adds to it)."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            clause = fixtures.with_clause().replace("WITH", "WITH RECURSIVE", 1) if recursive else fixtures.with_clause()
            ORACLE_SQL[f.__name__] = clause + (" " if not sql.lstrip().startswith(",") else "") + sql
        return f

    return add


def _ds(spark: SparkSession, d: str) -> Dataset:
    return fixtures.dataset(spark, d)


def _ids(ds: Dataset) -> DataFrame:
    return ds.objects.select("objectid")


OVERLAP = "greatest(0, least(a.x1 + a.width, b.x1 + b.width) - greatest(a.x1, b.x1)) * greatest(0, least(a.y1 + a.height, b.y1 + b.height) - greatest(a.y1, b.y1))"


# ---- filters ----


@query("SELECT imagefile FROM images WHERE imagefile NOT IN (SELECT imagefile FROM images WHERE name = 'BUILDING')")
def filter_images_via_another(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    ref = ds.with_(images=ds.images.filter("name = 'BUILDING'"))
    return filters.filter_images_via_another(ds, ref).images.select("imagefile")


@query("SELECT imagefile, CAST(width AS INT) AS width FROM images WHERE NOT (imagefile NOT IN (SELECT imagefile FROM objects) AND width > 700)")
def filter_images_without_objects(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_images_without_objects(_ds(spark, d), "images.width > 700").images.select("imagefile", "width")


@query(", gone AS (SELECT imagefile FROM objects GROUP BY 1 HAVING count(*) > 12) SELECT objectid FROM objects WHERE imagefile NOT IN (SELECT imagefile FROM gone)")
def filter_images_sql(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_images_sql(_ds(spark, d), "SELECT imagefile FROM objects GROUP BY 1 HAVING count(*) > 12"))


@query(""", v AS (SELECT objectid, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb FROM polygons GROUP BY 1), gone AS (
  SELECT o.objectid FROM objects o JOIN images i USING (imagefile) LEFT JOIN v USING (objectid)
  WHERE CASE WHEN xa IS NOT NULL THEN xa < i.width * 0.03 OR ya < i.height * 0.03 OR xb > i.width - i.width * 0.03 OR yb > i.height - i.height * 0.03
    ELSE x1 < i.width * 0.03 OR y1 < i.height * 0.03 OR x1 + o.width > i.width + 1 - i.width * 0.03 OR y1 + o.height > i.height + 1 - i.height * 0.03 END)
SELECT objectid FROM objects WHERE objectid NOT IN (SELECT objectid FROM gone)""")
def filter_objects_at_image_edges(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_objects_at_image_edges(_ds(spark, d)))


@query(f"""SELECT objectid FROM objects a WHERE NOT EXISTS (SELECT 1 FROM objects b WHERE a.imagefile = b.imagefile AND a.objectid <> b.objectid AND a.x1 IS NOT NULL AND b.x1 IS NOT NULL AND {OVERLAP} > 0.1 * a.width * a.height)""")
def filter_objects_by_intersection(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_objects_by_intersection(_ds(spark, d)))


@query("SELECT objectid, name FROM objects WHERE coalesce(name NOT IN ('1-URGENT', '2-HIGH'), true)")
def filter_objects_by_name(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_objects_by_name(_ds(spark, d), ["1-URGENT", "2-HIGH"]).objects.select("objectid", "name")


@query("SELECT objectid, name FROM objects WHERE coalesce(name IN ('1-URGENT', '2-HIGH'), true)")
def filter_objects_by_name_keep(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_objects_by_name(_ds(spark, d), ["1-URGENT", "2-HIGH"], keep=True).objects.select("objectid", "name")


@query("SELECT p.id, p.key FROM properties p JOIN objects o USING (objectid) WHERE coalesce(score >= 0.5, true)")
def filter_objects_by_score(spark: SparkSession, d: str) -> DataFrame:
    return filters.filter_objects_by_score(_ds(spark, d), 0.5).properties.select("id", "key")


_CENTRES = """, mean AS (SELECT objectid, avg(x) AS mx, avg(y) AS my FROM polygons GROUP BY 1
), c AS (SELECT o.objectid, imagefile, coalesce(mx, x1 + width / 2) AS cx, coalesce(my, y1 + height / 2) AS cy FROM objects o LEFT JOIN mean USING (objectid) WHERE NOT coalesce({shadow}, false)
), s AS (SELECT * FROM objects WHERE {shadow}
), corners AS (SELECT objectid, id, trunc(x) AS ax, trunc(y) AS ay FROM polygons JOIN s USING (objectid)
), edges AS (SELECT objectid, ax, ay, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS ex, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS ey FROM corners WINDOW w AS (PARTITION BY objectid ORDER BY id)
), ringed AS (SELECT c.objectid FROM c JOIN s USING (imagefile) JOIN edges e ON e.objectid = s.objectid GROUP BY c.objectid, s.objectid
  HAVING bool_or((ex - ax) * (cy - ay) = (ey - ay) * (cx - ax) AND least(ax, ex) <= cx AND cx <= greatest(ax, ex) AND least(ay, ey) <= cy AND cy <= greatest(ay, ey))
    OR count(*) FILTER ((ay > cy) <> (ey > cy) AND cx < (ex - ax) * (cy - ay) / (ey - ay) + ax) % 2 = 1
), boxed AS (SELECT c.objectid FROM c JOIN s USING (imagefile) WHERE s.objectid NOT IN (SELECT objectid FROM edges) AND cx > s.x1 AND cx < s.x1 + s.width AND cy > s.y1 AND cy < s.y1 + s.height
), inside AS (SELECT objectid FROM ringed UNION SELECT objectid FROM boxed)"""


@query(_CENTRES.format(shadow="name = '1-URGENT' AND objectid % 3 <> 0") + "SELECT objectid FROM objects WHERE objectid NOT IN (SELECT objectid FROM inside)")
def filter_objects_inside_boxes(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_objects_inside_certain_objects(_ds(spark, d), "objects.name = '1-URGENT' AND objectid % 3 <> 0"))


@query(_CENTRES.format(shadow="name = '1-URGENT'") + "SELECT objectid FROM objects WHERE name = '1-URGENT' OR objectid IN (SELECT objectid FROM inside)")
def filter_objects_inside_polygons(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_objects_inside_certain_objects(_ds(spark, d), "name = '1-URGENT'", keep=True))


@query("SELECT objectid FROM objects WHERE objectid NOT IN (SELECT objectid FROM properties WHERE key = 'yaw' AND CAST(value AS INT) < 90)")
def filter_objects_sql(spark: SparkSession, d: str) -> DataFrame:
    return _ids(filters.filter_objects_sql(_ds(spark, d), "SELECT objectid FROM properties WHERE key = 'yaw' AND CAST(value AS INT) < 90"))


# ---- one dataset ----


@query("SELECT objectid, name, CASE WHEN width > 200 THEN 0 ELSE score END AS score FROM objects")
def update_rows(spark: SparkSession, d: str) -> DataFrame:
    return modify.update(_ds(spark, d), "objects", {"score": "0"}, "width > 200").objects.select("objectid", "name", "score")


@query("SELECT id, value FROM properties WHERE key <> 'rank'")
def delete_rows(spark: SparkSession, d: str) -> DataFrame:
    return modify.delete(_ds(spark, d), "properties", "key = 'rank'").properties.select("id", "value")


@query("""SELECT objectid, name, count(*) AS n, min(x) AS xa, max(y) AS yb FROM (
  SELECT objectid, name, x, y FROM polygons UNION ALL SELECT objectid, 'bounding box', x1 + dx * width, y1 + dy * height FROM objects, (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) c(dx, dy) WHERE x1 IS NOT NULL AND objectid % 3 <> 0) GROUP BY 1, 2""")
def bboxes_to_polygons(spark: SparkSession, d: str) -> DataFrame:
    p = modify.bboxes_to_polygons(_ds(spark, d)).polygons
    return p.groupBy("objectid", "name").agg(F.count("*").alias("n"), F.min("x").alias("xa"), F.max("y").alias("yb"))


@query("SELECT objectid, CASE WHEN p.id IS NULL THEN x1 ELSE xa END AS x1, CASE WHEN p.id IS NULL THEN width ELSE xb - xa END AS width FROM objects LEFT JOIN (SELECT objectid, min(id) AS id, min(x) AS xa, max(x) AS xb FROM polygons GROUP BY 1) p USING (objectid)")
def polygons_to_bboxes(spark: SparkSession, d: str) -> DataFrame:
    return modify.polygons_to_bboxes(_ds(spark, d)).objects.select("objectid", "x1", "width")


@query("SELECT objectid, x1 - width * 0.25 AS x1, y1 - height * 0.25 AS y1, width * 1.5 AS width, height * 1.5 AS height FROM objects")
def expand_objects(spark: SparkSession, d: str) -> DataFrame:
    return modify.expand_objects(_ds(spark, d), 0.5).objects.select("objectid", "x1", "y1", "width", "height")


@query("SELECT id, cx + (x - cx) * 1.5 AS x, cy + (y - cy) * 1.5 AS y FROM (SELECT *, (min(x) OVER w + max(x) OVER w) / 2 AS cx, (min(y) OVER w + max(y) OVER w) / 2 AS cy FROM polygons WINDOW w AS (PARTITION BY objectid))")
def expand_polygons(spark: SparkSession, d: str) -> DataFrame:
    return modify.expand_objects(_ds(spark, d), 0.5).polygons.select("id", "x", "y")


@query("SELECT objectid, 'all/' || split_part(o.imagefile, '/', 2) AS imagefile, 'there/' || split_part(maskfile, '/', 2) AS maskfile, i.width FROM objects o JOIN images i USING (imagefile)")
def move_media(spark: SparkSession, d: str) -> DataFrame:
    ds = modify.move_media(_ds(spark, d), image_path="all", mask_path="there")
    return ds.objects.select("objectid", "imagefile").join(ds.images.select("imagefile", "maskfile", "width"), "imagefile").select("objectid", "imagefile", "maskfile", "width")


@query("SELECT '../old/' || imagefile AS imagefile, '../old/' || maskfile AS maskfile FROM images")
def move_rootdir(spark: SparkSession, d: str) -> DataFrame:
    return modify.move_rootdir(_ds(spark, d).with_(rootdir="/data/old"), "/data/new").images.select("imagefile", "maskfile")


@query("SELECT objectid, CASE WHEN name IN ('1-URGENT', '2-HIGH') THEN 'top' ELSE name END AS name FROM objects WHERE name IS NULL OR name IN ('1-URGENT', '2-HIGH')")
def rename_objects(spark: SparkSession, d: str) -> DataFrame:
    return modify.rename_objects(_ds(spark, d), {"1-URGENT": "2-HIGH", "2-HIGH": "top"}, discard_other=True).objects.select("objectid", "name")


@query("SELECT objectid, trunc(o.x1 * 320 / i.width) + 0 AS x1, trunc(o.width * 320 / i.width) + 0 AS width, trunc(o.y1 * 320 / i.width) + 0 AS y1 FROM objects o JOIN images i USING (imagefile)")
def resize_annotations(spark: SparkSession, d: str) -> DataFrame:
    return modify.resize_annotations(_ds(spark, d), width=320).objects.select("objectid", "x1", "width", "y1")


@query("SELECT o.objectid, CASE WHEN p.id IS NOT NULL THEN CAST(p.value AS DOUBLE) ELSE score END AS score FROM objects o LEFT JOIN properties p ON o.objectid = p.objectid AND key = 'yaw'")
def property_to_score(spark: SparkSession, d: str) -> DataFrame:
    return modify.property_to_objects_field(_ds(spark, d), "score", "yaw").objects.select("objectid", "score")


@query("SELECT id, objectid + 7 AS objectid FROM matches")
def property_to_objectid(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    more = ds.objects.select((F.col("objectid") + 10**9).alias("id"), "objectid", F.lit("new").alias("key"), (F.col("objectid") + 7).cast("string").alias("value"))
    return modify.property_to_objects_field(modify.insert(ds, "properties", more), "objectid", "new").matches.select("id", "objectid")


@query("SELECT objectid, (x1 - 5) / 2 AS x1, (y1 + 5) / 0.5 AS y1, width / 2 AS width FROM objects")
def revert_object_transforms(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    t = ds.objects.select("objectid", F.lit(2.0).alias("kx"), F.lit(0.5).alias("ky"), F.lit(5.0).alias("bx"), F.lit(-5.0).alias("by"))
    return modify.revert_object_transforms(modify.update_object_transform(ds, t)).objects.select("objectid", "x1", "y1", "width")


@query(""", c AS (SELECT objectid, x1, o.width, i.width AS w, greatest(0, least(x1, i.width)) AS nx FROM objects o JOIN images i USING (imagefile))
SELECT objectid, CASE WHEN x1 IS NOT NULL THEN nx END AS x1, CASE WHEN x1 IS NOT NULL THEN greatest(0, least(width - nx + x1, w - nx)) END AS width FROM c""")
def clip_boxes(spark: SparkSession, d: str) -> DataFrame:
    return modify.clip_objects(_ds(spark, d), keep_num_vertices=True).objects.select("objectid", "x1", "width")


@query(""", p AS (SELECT p.*, i.width AS w, i.height AS h, min(x) OVER o AS xa, max(x) OVER o AS xb, min(y) OVER o AS ya, max(y) OVER o AS yb FROM polygons p JOIN objects USING (objectid) JOIN images i USING (imagefile) WINDOW o AS (PARTITION BY objectid))
SELECT id, greatest(0, least(x, w)) AS x, greatest(0, least(y, h)) AS y FROM p WHERE xb >= 0 AND yb >= 0 AND xa <= w AND ya <= h""")
def clip_polygons(spark: SparkSession, d: str) -> DataFrame:
    return modify.clip_objects(_ds(spark, d), keep_num_vertices=True).polygons.select("id", "x", "y")


_CLIPPED = """, d AS (SELECT objectid, x1 + o.width / 2 AS cx, y1 + o.height / 2 AS cy, o.width / 2 AS a, o.height / 2 AS b, i.width AS w, i.height AS h
  FROM objects o JOIN images i USING (imagefile) WHERE objectid % 3 = 0 AND x1 IS NOT NULL),
e AS (SELECT *, unnest([{px: cx, py: cy - b, qx: cx + a, qy: cy}, {px: cx + a, py: cy, qx: cx, qy: cy + b}, {px: cx, py: cy + b, qx: cx - a, qy: cy}, {px: cx - a, py: cy, qx: cx, qy: cy - b}], recursive := true) FROM d),
p AS (SELECT objectid, w, h, px AS x, py AS y FROM e
  UNION ALL SELECT objectid, w, h, v, py + (v - px) / (qx - px) * (qy - py) FROM (SELECT *, unnest([0, w]) AS v FROM e) WHERE (px - v) * (qx - v) < 0
  UNION ALL SELECT objectid, w, h, px + (v - py) / (qy - py) * (qx - px), v FROM (SELECT *, unnest([0, h]) AS v FROM e) WHERE (py - v) * (qy - v) < 0
  UNION ALL SELECT objectid, w, h, u, v FROM (SELECT *, unnest([0, w]) AS u FROM d) t, LATERAL (SELECT unnest([0, t.h]) AS v) WHERE abs(u - cx) / a + abs(v - cy) / b < 1),
k AS (SELECT DISTINCT objectid, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE x >= 0 AND x <= w AND y >= 0 AND y <= h)
SELECT objectid, count(*) AS n, round(sum(x), 6) AS x FROM k GROUP BY 1 HAVING count(*) > 2"""


@query(_CLIPPED)
def clip_polygon_edges(spark: SparkSession, d: str) -> DataFrame:
    return modify.clip_objects(_ds(spark, d)).polygons.groupBy("objectid").agg(F.count("*").alias("n"), F.round(F.sum("x"), 6).alias("x"))


@query()
def merge_intersecting_objects(spark: SparkSession, d: str) -> DataFrame:
    return modify.merge_intersecting_objects(_ds(spark, d), 0.3).objects.select("objectid", "x1", "y1", "width", "height")


@query("SELECT id, CASE WHEN match = 2 THEN 1 ELSE match END AS match, objectid FROM matches WHERE match <> 5")
def edit_matches(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    one, two = (ds.matches.filter(F.col("match") == m).agg(F.min("objectid")).first()[0] for m in (1, 2))
    return modify.delete_match(modify.add_match(ds, one, two), 5).matches


# ---- datasets ----


@query("SELECT imagefile FROM images ORDER BY imagefile LIMIT 25")
def head_images(spark: SparkSession, d: str) -> DataFrame:
    return algebra.head_images(_ds(spark, d), 25).images.select("imagefile")


@query("SELECT objectid FROM objects WHERE imagefile IN (SELECT imagefile FROM images ORDER BY imagefile DESC LIMIT 25)")
def tail_images(spark: SparkSession, d: str) -> DataFrame:
    return _ids(algebra.tail_images(_ds(spark, d), 25))


@query("SELECT imagefile FROM images ORDER BY md5(imagefile || '0'), imagefile LIMIT 25")
def random_n_images(spark: SparkSession, d: str) -> DataFrame:
    return algebra.random_n_images(_ds(spark, d), 25).images.select("imagefile")


@query("SELECT CASE WHEN n <= ceil(t * 0.6) THEN 'train' ELSE 'test' END AS part, o.objectid FROM objects o JOIN (SELECT imagefile, row_number() OVER (ORDER BY imagefile) AS n, count(*) OVER () AS t FROM images) USING (imagefile)")
def split_dataset(spark: SparkSession, d: str) -> DataFrame:
    parts = algebra.split_dataset(_ds(spark, d), {"train": 0.6, "test": 0.4})
    train, test = (_ids(ds).withColumn("part", F.lit(name)) for name, ds in parts.items())
    return train.union(test)


@query(""", f AS (SELECT imagefile, CAST(('0x' || substr(md5(imagefile || '0'), 1, 8))::BIGINT % 3 AS INT) AS fold FROM images)
SELECT objectid, fold, CAST(t AS INT) AS training FROM objects JOIN f USING (imagefile) CROSS JOIN (VALUES (0), (1), (2)) v(t) WHERE t <> fold""")
def k_fold(spark: SparkSession, d: str) -> DataFrame:
    folds = algebra.k_fold(_ds(spark, d), 3)
    train = [_ids(t).withColumn("training", F.lit(n)) for n, (t, _) in enumerate(folds)]
    own = [_ids(v).withColumn("fold", F.lit(n)) for n, (_, v) in enumerate(folds)]
    return own[0].union(own[1]).union(own[2]).join(train[0].union(train[1]).union(train[2]), "objectid")


@query(""", i AS (SELECT imagefile FROM images UNION SELECT imagefile FROM images WHERE width > 700),
o AS (SELECT objectid, imagefile, name FROM objects UNION ALL SELECT (SELECT max(objectid) FROM objects) + row_number() OVER (ORDER BY objectid), imagefile, name FROM ref_objects)
SELECT o.* FROM o""")
def add_dataset(spark: SparkSession, d: str) -> DataFrame:
    return algebra.add_dataset(_ds(spark, d), fixtures.reference(spark, d)).objects.select("objectid", "imagefile", "name")


@query(""", r AS (SELECT objectid, (SELECT max(objectid) FROM objects) + row_number() OVER (ORDER BY objectid) AS new FROM ref_objects)
SELECT 'properties' AS part, (SELECT max(id) FROM properties) + row_number() OVER (ORDER BY id) AS id, new AS objectid, key || '=' || value AS value FROM properties JOIN r USING (objectid)
UNION ALL SELECT 'matches', (SELECT max(id) FROM matches) + row_number() OVER (ORDER BY id), new, CAST(match + (SELECT max(match) FROM matches) + 1 AS VARCHAR) FROM matches JOIN r USING (objectid)
UNION ALL SELECT 'images', count(*), NULL, NULL FROM images""")
def add_dataset_children(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    out = algebra.add_dataset(ds, fixtures.reference(spark, d))
    new = lambda t, value: out.table(t).join(ds.table(t).select("id"), "id", "left_anti").select(F.lit(t).alias("part"), "id", "objectid", value.alias("value"))
    images = out.images.agg(F.count("*").alias("id")).select(F.lit("images").alias("part"), "id", F.lit(None).cast("long").alias("objectid"), F.lit(None).cast("string").alias("value"))
    return new("properties", F.concat("key", F.lit("="), "value")).union(new("matches", F.col("match").cast("string"))).union(images)


@query("SELECT o.objectid, CASE WHEN r.objectid IS NULL THEN o.name ELSE r.name END AS name, CASE WHEN r.objectid IS NULL THEN o.x1 ELSE r.x1 END AS x1 FROM objects o LEFT JOIN ref_objects r USING (objectid)")
def sync_objects_data(spark: SparkSession, d: str) -> DataFrame:
    return algebra.sync_objects_data(_ds(spark, d), fixtures.reference(spark, d), ["name", "x1"]).objects.select("objectid", "name", "x1")


@query("SELECT o.objectid, CASE WHEN abs(o.x1 - r.x1) < 1 THEN r.x1 ELSE o.x1 END AS x1, o.width FROM objects o LEFT JOIN ref_objects r USING (objectid)")
def sync_rounded_coordinates(spark: SparkSession, d: str) -> DataFrame:
    return algebra.sync_rounded_coordinates(_ds(spark, d), fixtures.reference(spark, d)).objects.select("objectid", "x1", "width")


@query()
def sync_objectids(spark: SparkSession, d: str) -> DataFrame:
    return algebra.sync_objectids(fixtures.predictions(spark, d), fixtures.reference(spark, d)).objects.select("objectid", "imagefile")


@query(f""", edges AS (
  SELECT a.objectid AS a, b.objectid AS b, {OVERLAP} / (a.width * a.height + b.width * b.height - {OVERLAP}) AS s
  FROM det_objects a JOIN ref_objects b ON a.imagefile = b.imagefile AND {OVERLAP} >= 0.3 * (a.width * a.height + b.width * b.height - {OVERLAP})
), rounds AS (
  SELECT a, b, s, false AS taken FROM edges
  UNION ALL SELECT a, b, s, ra = 1 AND rb = 1 FROM (
    SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, a, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY s DESC, a, b) AS rb
    FROM (SELECT *, bool_or(taken) OVER (PARTITION BY a) AS ga, bool_or(taken) OVER (PARTITION BY b) AS gb FROM rounds) WHERE NOT ga AND NOT gb)
), pairs AS (SELECT a, b FROM rounds WHERE taken)
SELECT coalesce(b, greatest((SELECT max(objectid) FROM det_objects), (SELECT max(objectid) FROM ref_objects)) + row_number() OVER (PARTITION BY b IS NULL ORDER BY objectid)) AS objectid, imagefile
FROM det_objects LEFT JOIN pairs ON a = objectid""", recursive=True)
def sync_objectids_boxes(spark: SparkSession, d: str) -> DataFrame:
    mine, theirs = (ds.with_(polygons=ds.polygons.limit(0)) for ds in (fixtures.predictions(spark, d), fixtures.reference(spark, d)))
    return algebra.sync_objectids(mine, theirs, 0.3).objects.select("objectid", "imagefile")


@query(""", far AS (SELECT id, x + 5 AS x, y, 10000000 + (SELECT max(id) FROM polygons) + row_number() OVER (ORDER BY id) AS new FROM polygons WHERE id % 8 = 1)
SELECT id, objectid, x + 0.25 AS x, y FROM polygons WHERE id % 8 <> 1 UNION ALL SELECT new, objectid, far.x, far.y FROM far JOIN polygons USING (id)""")
def sync_polygon_ids(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    shift = F.when(F.col("id") % 8 == 1, 5.0).otherwise(0.25)  # those that move by 5 have no partner
    moved = ds.with_(polygons=ds.polygons.select((F.col("id") + 10**7).alias("id"), "objectid", (F.col("x") + shift).alias("x"), "y", "name"))
    return algebra.sync_polygon_ids(moved, ds, epsilon=1.0).polygons.select("id", "objectid", "x", "y")


@query("""SELECT (SELECT count(*) FROM images WHERE width > 700 AND height < 720) AS images_remaining, (SELECT count(*) FROM images WHERE width > 700 AND height >= 720) AS images_new, (SELECT count(*) FROM images WHERE width <= 700 AND height < 720) AS images_deleted, count_if(r.objectid IS NOT NULL) AS objects_remaining, count_if(r.objectid IS NULL) AS objects_new, 0 AS objects_deleted,
count_if(o.x1 <> r.x1) AS objects_moved, count_if(o.name = r.name) AS objects_not_renamed FROM objects o LEFT JOIN ref_objects r USING (objectid)""")
def diff(spark: SparkSession, d: str) -> DataFrame:
    ds, ref = _ds(spark, d), fixtures.reference(spark, d)
    return algebra.diff(ds.with_(images=ds.images.filter("width > 700")), ref.with_(images=ref.images.filter("height < 720")))


# ---- reports ----


@query("SELECT count(*) AS images, count(maskfile) AS masks, CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height, (SELECT count(*) FROM objects) AS objects, (SELECT count(DISTINCT key) FROM properties) AS property_keys, (SELECT count(DISTINCT match) FROM matches) AS matches FROM images")
def info_counts(spark: SparkSession, d: str) -> DataFrame:
    return info.info(_ds(spark, d))


@query("SELECT split_part(imagefile, '/', 1) AS folder, count(*) AS images, count(maskfile) AS masks, count(DISTINCT (width, height)) AS sizes FROM images GROUP BY 1")
def images_by_folder(spark: SparkSession, d: str) -> DataFrame:
    return info.images_by_folder(_ds(spark, d))


@query("SELECT imagefile, (SELECT count(*) FROM objects o WHERE o.imagefile = i.imagefile) AS objects FROM images i")
def objects_by_image(spark: SparkSession, d: str) -> DataFrame:
    return info.objects_by_image(_ds(spark, d))


@query("SELECT CAST(value AS DOUBLE) AS x, count(*) AS n FROM properties WHERE key = 'yaw' GROUP BY 1")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return info.histogram(_ds(spark, d), "SELECT value FROM properties WHERE key = 'yaw'")


@query("SELECT -20 + least(floor((x1 + 20) / 62), 9) * 62 AS x, count(*) AS n FROM objects WHERE x1 BETWEEN -20 AND 600 GROUP BY 1")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return info.histogram(_ds(spark, d), "SELECT x1 FROM objects", 10, (-20.0, 600.0))


@query("SELECT objectid, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_microseconds(objectid * 1000003), '%Y-%m-%d %H:%M:%S.%f') AS text, objectid % 2 = 0 AS known FROM objects")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    text = dates.time_text(F.timestamp_micros(F.lit(1704067200000000) + F.col("objectid") * 1000003))
    read = dates.parsed_time(F.when(F.col("objectid") % 2 == 0, text).otherwise("no time"))
    same = F.when(read.isNull(), text).otherwise(dates.time_text(read))
    return _ds(spark, d).objects.select("objectid", same.alias("text"), read.isNotNull().alias("known"))


@query("""SELECT a.imagefile, a.objectid, b.objectid AS other FROM objects a JOIN objects b ON a.imagefile = b.imagefile AND a.objectid <> b.objectid WHERE a.x1 < b.x1 + b.width AND b.x1 < a.x1 + a.width AND a.y1 < b.y1 + b.height AND b.y1 < a.y1 + a.height""")
def overlapping_pairs(spark: SparkSession, d: str) -> DataFrame:
    found = filters.overlapping_pairs(_ds(spark, d).objects.filter("x1 is not null"))
    return found.select("imagefile", F.col("a_objectid").alias("objectid"), F.col("b_objectid").alias("other"))


@query("SELECT CAST(p.value AS DOUBLE) AS x, o.name AS series, count(*) AS n FROM properties p JOIN objects o USING (objectid) WHERE key = 'rank' AND o.name IS NOT NULL GROUP BY 1, 2")
def stacked_histogram(spark: SparkSession, d: str) -> DataFrame:
    return info.stacked_histogram(_ds(spark, d), "SELECT value, name FROM properties JOIN objects USING (objectid) WHERE key = 'rank'")


@query("SELECT x1 AS x, y1 AS y FROM objects WHERE x1 IS NOT NULL")
def scatter(spark: SparkSession, d: str) -> DataFrame:
    return info.scatter(_ds(spark, d), "SELECT x1, y1 FROM objects")


@query("SELECT name AS x, count(*) AS n, [quantile_cont(width, 0.0), quantile_cont(width, 0.5), quantile_cont(width, 1.0)] AS quantiles FROM objects WHERE name IS NOT NULL AND width IS NOT NULL GROUP BY 1")
def violin(spark: SparkSession, d: str) -> DataFrame:
    return info.violin(_ds(spark, d), "SELECT name, width FROM objects", (0.0, 0.5, 1.0))


@query(""", g AS (SELECT name AS x, count(*) AS n, stddev_samp(width) * pow(count(*), -0.2) AS h, min(width) AS low, max(width) AS high FROM objects WHERE name IS NOT NULL AND width IS NOT NULL GROUP BY 1),
p AS (SELECT x, n, h, k, low - 2 * h + (high - low + 4 * h) * k / 49 AS y FROM g, (SELECT unnest(range(50)) AS k))
SELECT x, k, n, round(sum(exp(-0.5 * pow((y - width) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 6) AS density FROM p JOIN objects ON name = x WHERE width IS NOT NULL GROUP BY x, k, n""")
def violin_density(spark: SparkSession, d: str) -> DataFrame:
    found = info.violin_density(_ds(spark, d), "SELECT name, width FROM objects", points=50)
    place = F.row_number().over(Window.partitionBy("x").orderBy("y")) - 1  # 50 rows each
    return found.select("x", place.cast("long").alias("k"), "n", F.round("density", 6).alias("density"))


@query("SELECT a.objectid, b.value AS status, c.value AS yaw FROM objects a JOIN properties b ON a.objectid = b.objectid AND b.key = 'status' JOIN properties c ON a.objectid = c.objectid AND c.key = 'yaw'")
def sql_select(spark: SparkSession, d: str) -> DataFrame:
    return _ds(spark, d).sql("SELECT a.objectid, b.value AS status, c.value AS yaw FROM objects a JOIN properties b ON a.objectid = b.objectid AND b.key = 'status' JOIN properties c ON a.objectid = c.objectid AND c.key = 'yaw'")


# ---- evaluation ----

_JUDGED = f""", pairs AS (
  SELECT a.objectid, a.name, a.score, b.objectid AS gt, {OVERLAP} / (a.width * a.height + b.width * b.height - {OVERLAP}) AS iou
  FROM det_objects a JOIN objects b ON a.imagefile = b.imagefile AND a.name = b.name WHERE b.x1 IS NOT NULL
), best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY objectid ORDER BY iou DESC, gt) = 1
), claims AS (SELECT objectid FROM best WHERE iou > 0.5 QUALIFY row_number() OVER (PARTITION BY gt ORDER BY score DESC, objectid) = 1
), judged AS (SELECT d.objectid, d.name, d.score, b.gt IS NOT NULL AS has_gt, c.objectid IS NOT NULL AS tp FROM det_objects d LEFT JOIN best b USING (objectid) LEFT JOIN claims c USING (objectid) WHERE d.name IS NOT NULL
), truth AS (SELECT name, count(*) AS n_gt FROM objects WHERE name IS NOT NULL GROUP BY 1)"""


@query(_JUDGED + """, curve AS (SELECT name, score, objectid, sum(tp::INT) OVER w AS t, row_number() OVER w AS n FROM judged WINDOW w AS (PARTITION BY name ORDER BY score DESC, objectid)
), area AS (SELECT name, t / n_gt - coalesce(lag(t / n_gt) OVER (PARTITION BY name ORDER BY n), 0) AS step, max(t / n) OVER (PARTITION BY name ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM curve JOIN truth USING (name))
SELECT name, n_gt, round(coalesce(sum(step * env), 0), 9) AS ap FROM truth LEFT JOIN area USING (name) GROUP BY 1, 2""")
def evaluate_detection_envelope(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.average_precision_envelope(fixtures.predictions(spark, d), _ds(spark, d))
    return found.select("name", "n_gt", F.round("ap", 9).alias("ap"))


@query(_JUDGED + """, points AS (
  SELECT name, CASE WHEN has_gt THEN score ELSE 0 END AS s, tp::BIGINT AS p, (NOT tp)::BIGINT AS n FROM judged
  UNION ALL SELECT name, 0, n_gt - (SELECT count_if(tp) FROM judged j WHERE j.name = t.name), 0 FROM truth t UNION ALL SELECT name, 0.0001, 0, 1000000 FROM truth
), sums AS (SELECT name, s, sum(p) AS p, sum(n) AS n FROM points GROUP BY 1, 2
), runs AS (SELECT name, s, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY name) AS total FROM sums WINDOW w AS (PARTITION BY name ORDER BY s DESC))
SELECT name, round(sum(p / total * (tp / nullif(tp + fp, 0))), 9) AS ap FROM runs GROUP BY 1""")
def evaluate_detection_by_class(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.average_precision(fixtures.predictions(spark, d), _ds(spark, d))
    return found.select("name", F.round("ap", 9).alias("ap"))


_AREA = """points AS (
  SELECT CASE WHEN has_gt THEN score ELSE 0 END AS s, tp::BIGINT AS p, (NOT tp)::BIGINT AS n FROM {judged}
  UNION ALL SELECT 0, (SELECT count(*) FROM objects) - (SELECT count_if(tp) FROM {judged}), 0 UNION ALL SELECT 0.0001, 0, 1000000
), sums AS (SELECT s, sum(p) AS p, sum(n) AS n FROM points GROUP BY 1), runs AS (SELECT s, p, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS total FROM sums WINDOW w AS (ORDER BY s DESC))
SELECT '{mode}' AS name, round(sum(p / total * (tp / nullif(tp + fp, 0))), 9) AS ap FROM runs"""


@query(_JUDGED.replace("AND a.name = b.name", "").replace("WHERE d.name IS NOT NULL", "").replace("judged", "anyone").replace("pairs", "any_pairs").replace("best", "any_best").replace("claims", "any_claims").replace(", truth AS", ", any_truth AS") + _JUDGED + f""", every AS (SELECT d.score, b.gt IS NOT NULL AS has_gt, c.objectid IS NOT NULL AS tp FROM det_objects d LEFT JOIN best b USING (objectid) LEFT JOIN claims c USING (objectid))
SELECT * FROM (WITH {_AREA.format(judged="anyone", mode="class-agnostic")}) UNION ALL SELECT * FROM (WITH {_AREA.format(judged="every", mode="all")})""")
def evaluate_detection_agnostic(spark: SparkSession, d: str) -> DataFrame:
    a = evaluate.average_precision(fixtures.predictions(spark, d), _ds(spark, d), mode="class-agnostic").withColumn("name", F.lit("class-agnostic"))
    return a.unionByName(evaluate.average_precision(fixtures.predictions(spark, d), _ds(spark, d), mode="aggregate-classes")).select("name", F.round("ap", 9).alias("ap"))


@query(""", b AS (SELECT o.name AS truth, r.name AS said FROM objects o JOIN ref_objects r USING (objectid) WHERE o.name IS NOT NULL AND r.name IS NOT NULL
), n AS (SELECT truth AS name FROM b UNION SELECT said FROM b
), c AS (SELECT name, (SELECT count(*) FROM b WHERE truth = name) AS support, (SELECT count(*) FROM b WHERE said = name) AS predicted, (SELECT count(*) FROM b WHERE truth = name AND said = name) AS tp FROM n
), m AS (SELECT name, tp / nullif(predicted, 0) AS precision, tp / nullif(support, 0) AS recall, 2 * tp / nullif(predicted + support, 0) AS f1, support FROM c
), rows AS (SELECT * FROM m UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT avg((truth = said)::INT) FROM b), (SELECT count(*) FROM b) UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT name, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM rows""")
def evaluate_classification(spark: SparkSession, d: str) -> DataFrame:
    report = evaluate.classification_report(fixtures.reference(spark, d), _ds(spark, d))
    return report.select("name", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")), "support")


# ---- media and samples ----


@query("SELECT objectid, x1 - 100 AS x1, y1 - 50 AS y1 FROM objects")
def crop_media(spark: SparkSession, d: str) -> DataFrame:
    return media.crop_media(_ds(spark, d), 100, 50, 400, 300, "cropped").objects.select("objectid", "x1", "y1")


@query(""", t AS (SELECT objectid, 64 / width AS kx, 48 / height AS ky, -x1 * 64 / width AS ox, -y1 * 48 / height AS oy FROM objects WHERE x1 IS NOT NULL)
SELECT o.objectid, 'crops/' || lpad(CAST(o.objectid AS VARCHAR), 9, '0') || '.jpg' AS imagefile, round(x1 * kx + ox, 6) + 0 AS x1, round(y1 * ky + oy, 6) + 0 AS y1, round(width * kx, 6) AS width, round(kx, 6) AS kx, round(oy, 6) AS oy,
  round((SELECT sum(p.x * kx + ox) FROM polygons p WHERE p.objectid = o.objectid), 4) AS xs FROM objects o JOIN t USING (objectid)""")
def crop_objects(spark: SparkSession, d: str) -> DataFrame:
    ds = media.crop_objects(_ds(spark, d), "crops", 64, 48)
    xs = ds.polygons.groupBy("objectid").agg(F.round(F.sum("x"), 4).alias("xs"))
    o = ds.objects.join(modify.object_transforms(ds), "objectid").join(xs, "objectid", "left")
    return o.select("objectid", "imagefile", *((F.round(c, 6) + 0).alias(c) for c in ("x1", "y1", "width", "kx")), F.round("by", 6).alias("oy"), "xs")


@query(""", f AS (SELECT o.*, CASE WHEN height / width < 0.75 THEN 0 ELSE height / 0.75 - width END AS mx, CASE WHEN height / width < 0.75 THEN width * 0.75 - height ELSE 0 END AS my FROM objects o WHERE x1 IS NOT NULL AND name = '1-URGENT'
), r AS (SELECT objectid AS frame, imagefile, ceil(x1 - mx / 2) AS xa, ceil(y1 - my / 2) AS ya, floor(x1 + width + mx / 2) AS xb, floor(y1 + height + my / 2) AS yb FROM f
), m AS (SELECT frame, objectid FROM r JOIN objects USING (imagefile) WHERE objects.score > 0.8 UNION SELECT frame, frame FROM r)
SELECT row_number() OVER (ORDER BY frame, m.objectid) AS objectid, 'crops/' || lpad(CAST(frame AS VARCHAR), 9, '0') || '.jpg' AS imagefile, round((x1 - xa) * 64 / (xb - xa), 5) + 0 AS x1, round((y1 - ya) * 48 / (yb - ya), 5) + 0 AS y1, round(width * 64 / (xb - xa), 5) AS width FROM m JOIN r USING (frame) JOIN objects o ON o.objectid = m.objectid""")
def crop_with_other_objects(spark: SparkSession, d: str) -> DataFrame:
    ds = media.crop_objects(_ds(spark, d), "crops", 64, 48, where_object="name = '1-URGENT'", edges="background", where_other_objects="score > 0.8")
    return ds.objects.select("objectid", "imagefile", *((F.round(c, 5) + 0).alias(c) for c in ("x1", "y1", "width")))


@query("""SELECT objectid, 'negative size' AS fault FROM objects WHERE objectid % 9 = 0 AND x1 IS NOT NULL UNION SELECT objectid, 'part of a box' FROM objects WHERE objectid % 9 = 1 AND x1 IS NOT NULL UNION SELECT objectid, 'fewer than three vertices' FROM polygons WHERE objectid % 2 = 0""")
def invalid_objects(spark: SparkSession, d: str) -> DataFrame:
    ds = _ds(spark, d)
    bad = ds.objects.withColumns({"width": F.expr("if(objectid % 9 = 0 and x1 is not null, -1D, width)"), "x1": F.expr("if(objectid % 9 = 1, null, x1)")})
    return modify.invalid_objects(ds.with_(objects=bad, polygons=ds.polygons.filter("objectid % 2 = 1 or id % 4 > 1")))


@query("SELECT objectid, round(x1, 6) AS x1, round(y1, 6) AS y1, imagefile FROM objects WHERE x1 IS NOT NULL")
def tile_then_revert(spark: SparkSession, d: str) -> DataFrame:
    ds = media.tile_objects(_ds(spark, d), "tiles", 64, 48)
    return modify.revert_object_transforms(ds).objects.select("objectid", F.round("x1", 6).alias("x1"), F.round("y1", 6).alias("y1"), "imagefile")


@query("SELECT imagefile, count(objectid) AS n, round(coalesce(sum(o.score), 0), 6) AS total FROM images LEFT JOIN objects o USING (imagefile) GROUP BY 1")
def image_samples(spark: SparkSession, d: str) -> DataFrame:
    s = samples.image_samples(_ds(spark, d))
    total = F.aggregate(F.filter("objects", lambda o: o["score"].isNotNull()), F.lit(0.0), lambda a, o: a + o["score"])
    return s.select("imagefile", F.size("objects").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("SELECT o.objectid, max(CASE WHEN key = 'status' THEN value END) AS status, max(CASE WHEN key = 'yaw' THEN value END) AS yaw FROM objects o LEFT JOIN properties p USING (objectid) GROUP BY 1")
def object_samples(spark: SparkSession, d: str) -> DataFrame:
    s = samples.object_samples(_ds(spark, d))
    return s.select("objectid", F.try_element_at("properties", F.lit("status")).alias("status"), F.try_element_at("properties", F.lit("yaw")).alias("yaw"))


@query("SELECT objectid AS id, name AS label, CASE WHEN score > 0.5 THEN 'sure' ELSE 'unsure' END AS score FROM objects")
def selected_samples(spark: SparkSession, d: str) -> DataFrame:
    chosen = samples.select_keys(samples.object_samples(_ds(spark, d)), {"objectid": "id", "name": "label", "score": "score"})
    return samples.transformed(chosen, {"score": lambda c: F.when(c > 0.5, "sure").otherwise("unsure")})


@query("SELECT objectid, floor((row_number() OVER (ORDER BY objectid) - 1) / 64)::BIGINT AS batch, (row_number() OVER (ORDER BY objectid) - 1) % 64 AS place FROM objects")
def batches(spark: SparkSession, d: str) -> DataFrame:
    return samples.batches(samples.object_samples(_ds(spark, d)), "objectid", 64).select("objectid", "batch", "place")


@query("SELECT imagefile, replace(imagefile, '/', '_') AS name FROM images")
def exported_names(spark: SparkSession, d: str) -> DataFrame:
    return _ds(spark, d).images.select("imagefile", paths.exported_name(F.col("imagefile"), 2).alias("name"))


# ---- exports ----


@query(""", i AS (SELECT imagefile, row_number() OVER (ORDER BY imagefile) - 1 AS image_id FROM images),
c AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS category_id FROM (SELECT DISTINCT name FROM objects WHERE name IS NOT NULL)),
p AS (SELECT objectid, min(x) AS xa, max(x) AS xb, min(y) AS ya, max(y) AS yb, string_agg(CAST(trunc(x)::INT AS VARCHAR) || ',' || CAST(trunc(y)::INT AS VARCHAR), ',' ORDER BY id) AS ring FROM polygons GROUP BY 1)
SELECT row_number() OVER (ORDER BY objectid) - 1 AS id, image_id, category_id, CAST(round_even(coalesce(xa, x1), 0) AS INT) AS x, CAST(round_even(coalesce(xb - xa, width), 0) AS INT) AS width, CAST(round_even(coalesce(ya, y1), 0) AS INT) AS y, CAST(round_even(coalesce(yb - ya, height), 0) AS INT) AS height,
round(CASE WHEN ring IS NULL THEN width * height ELSE width * height / 2 END, 6) AS area, coalesce(ring, '') AS ring
FROM objects JOIN i USING (imagefile) JOIN c USING (name) LEFT JOIN p USING (objectid) WHERE x1 IS NOT NULL""")
def coco_annotations(spark: SparkSession, d: str) -> DataFrame:
    a = exports.coco_tables(_ds(spark, d))["annotations"]
    return a.select("id", "image_id", "category_id", *(F.col("bbox")[k].alias(c) for k, c in enumerate(("x", "y", "width", "height"))), F.round("area", 6).alias("area"), F.array_join(F.flatten("segmentation"), ",").alias("ring"))


_SHARE = "CASE WHEN {0} < 0 THEN '-' ELSE '' END || rtrim(rtrim(printf('%.7f', floor(abs({0}) * 1e7 + 1e-6) / 1e7), '0'), '.') || CASE WHEN printf('%.7f', floor(abs({0}) * 1e7 + 1e-6) / 1e7) LIKE '%.0000000' THEN '.0' ELSE '' END"


@query(f"""SELECT replace(split_part(imagefile, '/', 2), '.jpg', '') AS file, string_agg(CASE WHEN o.name = '1-URGENT' THEN '0' ELSE '1' END || ' ' || {' || chr(32) || '.join(_SHARE.format(e) for e in ("((x1 + o.width / 2) / i.width)", "((y1 + o.height / 2) / i.height)", "(o.width / i.width)", "(o.height / i.height)"))}, chr(10) ORDER BY objectid) AS text
FROM objects o JOIN images i USING (imagefile) WHERE x1 IS NOT NULL AND o.name IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def yolo_files(spark: SparkSession, d: str) -> DataFrame:
    return exports.yolo_lines(_ds(spark, d), ["1-URGENT", "2-HIGH"])


# ---- functions in users' SQL ----


@query(f"SELECT objectid FROM objects WHERE objectid NOT IN (SELECT a.objectid FROM objects a JOIN objects b ON a.imagefile = b.imagefile AND a.objectid < b.objectid WHERE {OVERLAP} > 0.3 * (a.width * a.height + b.width * b.height - {OVERLAP}))")
def sql_filter_by_iou(spark: SparkSession, d: str) -> DataFrame:
    text = "SELECT a.objectid FROM objects a JOIN objects b ON a.imagefile = b.imagefile AND a.objectid < b.objectid WHERE box_iou(a.x1, a.y1, a.width, a.height, b.x1, b.y1, b.width, b.height) > 0.3"
    return _ids(filters.filter_objects_sql(_ds(spark, d), text))


@query(""", d AS (SELECT o.objectid, imagefile, x1 + width / 2 AS cx, y1 + height / 2 AS cy, width / 2 AS a, height / 2 AS b FROM objects o WHERE objectid % 3 = 0 AND x1 IS NOT NULL)
SELECT d.objectid, count(o.objectid) AS inside, 2 * d.a * d.b AS area FROM d LEFT JOIN objects o ON o.imagefile = d.imagefile AND o.objectid <> d.objectid AND abs(o.x1 - cx) * b + abs(o.y1 - cy) * a <= a * b GROUP BY ALL""")
def sql_corners_in_rings(spark: SparkSession, d: str) -> DataFrame:
    """How many other objects' first corners each polygon holds."""
    return _ds(spark, d).sql("""
        WITH r AS (SELECT objectid, array_sort(collect_list(struct(id, x, y))) AS p FROM polygons GROUP BY objectid),
        s AS (SELECT r.objectid, o.imagefile, transform(p, v -> named_struct('x', v.x, 'y', v.y)) AS ring FROM r JOIN objects o ON o.objectid = r.objectid)
        SELECT s.objectid, count(o.objectid) AS inside, any_value(ring_area(ring)) AS area
        FROM s LEFT JOIN objects o ON o.imagefile = s.imagefile AND o.objectid <> s.objectid AND ring_holds(s.ring, o.x1, o.y1) GROUP BY s.objectid""")


@query(_CLIPPED)
def sql_clip_polygons(spark: SparkSession, d: str) -> DataFrame:
    return _ds(spark, d).sql("""
        WITH r AS (SELECT objectid, array_sort(collect_list(struct(id, x, y))) AS p FROM polygons GROUP BY objectid),
        s AS (SELECT r.objectid, transform(p, v -> v.x) AS xs, transform(p, v -> v.y) AS ys, double(i.width) AS w, double(i.height) AS h FROM r JOIN objects o ON o.objectid = r.objectid JOIN images i ON i.imagefile = o.imagefile)
        SELECT objectid, count(*) AS n, round(sum(c.x), 6) AS x FROM s, LATERAL clip_polygon(xs, ys, w, h) c GROUP BY objectid""")
