"""An annotation dataset derived from the tables `customer` and `orders`, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..dataset import Dataset

_PATH = "lower(c_mktsegment) || '/' || lpad(CAST(c_custkey AS VARCHAR(12)), 6, '0') || '.jpg'"
_BOX = "CASE WHEN o_orderkey % 11 <> 0 THEN CAST({} AS DOUBLE) END"

SQL = {
    "images": f"""SELECT {_PATH} AS imagefile, CAST(640 + 160 * (c_custkey % 3) AS INT) AS width, CAST(480 + 120 * (c_custkey % 3) AS INT) AS height,
        CASE WHEN c_custkey % 4 <> 0 THEN 'masks/' || lpad(CAST(c_custkey AS VARCHAR(12)), 6, '0') || '.png' END AS maskfile, CAST(NULL AS TIMESTAMP) AS timestamp,
        c_mktsegment AS name, CASE WHEN c_custkey % 5 <> 0 THEN CAST((c_custkey * 17) % 101 AS DOUBLE) / 100 END AS score FROM {{customer}}""",
    "objects": f"""SELECT CAST(o_orderkey AS BIGINT) AS objectid, {_PATH} AS imagefile, {_BOX.format("(o_orderkey * 37) % 600 - 20")} AS x1, {_BOX.format("(o_orderkey * 53) % 440 - 20")} AS y1,
        {_BOX.format("20 + (o_orderkey * 29) % 300")} AS width, {_BOX.format("20 + (o_orderkey * 31) % 200")} AS height,
        CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS name, CASE WHEN o_orderkey % 7 <> 0 THEN CAST((o_orderkey * 41) % 101 AS DOUBLE) / 100 END AS score
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "properties": """SELECT CAST(3 * o_orderkey AS BIGINT) AS id, CAST(o_orderkey AS BIGINT) AS objectid, 'status' AS key, o_orderstatus AS value FROM {orders}
        UNION ALL SELECT CAST(3 * o_orderkey + 1 AS BIGINT), CAST(o_orderkey AS BIGINT), 'yaw', CAST((o_orderkey * 19) % 360 AS VARCHAR(12)) FROM {orders} WHERE o_orderkey % 3 = 0
        UNION ALL SELECT CAST(3 * o_orderkey + 2 AS BIGINT), CAST(o_orderkey AS BIGINT), 'rank', substr(o_orderpriority, 1, 1) FROM {orders} WHERE o_orderkey % 2 = 0""",
    "polygons": " UNION ALL ".join(
        f"SELECT CAST(4 * objectid + {k} AS BIGINT) AS id, objectid, {x} AS x, {y} AS y, CAST(NULL AS VARCHAR(12)) AS name FROM {{objects}} WHERE objectid % 3 = 0 AND x1 IS NOT NULL"
        for k, (x, y) in enumerate((("x1 + width / 2", "y1"), ("x1 + width", "y1 + height / 2"), ("x1 + width / 2", "y1 + height"), ("x1", "y1 + height / 2")))
    ),
    "matches": "SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(floor(o_orderkey / 5) AS BIGINT) AS match, CAST(o_orderkey AS BIGINT) AS objectid FROM {orders} WHERE o_orderkey % 5 < 2",
    "det_objects": "SELECT objectid, imagefile, x1 + (objectid % 7 - 3) * 4 AS x1, y1, width, height, name, CAST((objectid * 41) % 101 AS DOUBLE) / 100 AS score FROM {objects} WHERE objectid % 10 < 8 AND x1 IS NOT NULL",
    "ref_objects": "SELECT objectid, imagefile, CASE WHEN objectid % 4 = 1 THEN x1 + 0.5 ELSE x1 END AS x1, y1, width, height, CASE WHEN objectid % 17 = 0 THEN 'renamed' ELSE name END AS name, score FROM {objects} WHERE objectid % 3 <> 0",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    have = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders")}
    for name, text in SQL.items():
        needed = {t: df for t, df in have.items() if f"{{{t}}}" in text}
        have[name] = spark.sql(text, **needed)
    return have


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    t = tables(spark, sf_dir)
    return Dataset(t["images"], t["objects"], t["properties"], t["polygons"], t["matches"])


def predictions(spark: SparkSession, sf_dir: str) -> Dataset:
    return dataset(spark, sf_dir).with_(objects=tables(spark, sf_dir)["det_objects"])


def reference(spark: SparkSession, sf_dir: str) -> Dataset:
    return dataset(spark, sf_dir).with_(objects=tables(spark, sf_dir)["ref_objects"])


def with_clause() -> str:
    """The same tables as common table expressions over the base tables."""
    plain = {t: t for t in ("customer", "orders", *SQL)}
    return "WITH " + ", ".join(f"{name} AS ({text.format(**plain)})" for name, text in SQL.items())
