"""Functions that users' SQL can call: overlaps, areas and points in polygons as SQL functions, which Spark puts into the plan as expressions, and clipping as a table function.

A ring is an array of structs with x and y, as `array_sort(collect_list(struct(id, x, y)))` gives it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .geometry import clip_ring

_BOXES = "ax DOUBLE, ay DOUBLE, aw DOUBLE, ah DOUBLE, bx DOUBLE, by DOUBLE, bw DOUBLE, bh DOUBLE"
_RING = "ring ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"
#: The vertex behind p, which is the i-th from 0.
_NEXT = "element_at(ring, CAST(if(i + 1 = size(ring), 1, i + 2) AS INT))"
_ON_EDGE = f"""({_NEXT}.x - p.x) * (py - p.y) = ({_NEXT}.y - p.y) * (px - p.x)
    AND px BETWEEN least(p.x, {_NEXT}.x) AND greatest(p.x, {_NEXT}.x) AND py BETWEEN least(p.y, {_NEXT}.y) AND greatest(p.y, {_NEXT}.y)"""
_CROSSED = f"(p.y > py) <> ({_NEXT}.y > py) AND px < ({_NEXT}.x - p.x) * (py - p.y) / nullif({_NEXT}.y - p.y, 0D) + p.x"

#: Parameters, type and body of each function.
FUNCTIONS = {
    "box_overlap": (_BOXES, "DOUBLE", "greatest(0D, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0D, least(ay + ah, by + bh) - greatest(ay, by))"),
    "box_iou": (_BOXES, "DOUBLE", "coalesce(box_overlap(ax, ay, aw, ah, bx, by, bw, bh) / nullif(aw * ah + bw * bh - box_overlap(ax, ay, aw, ah, bx, by, bw, bh), 0D), 0D)"),
    "ring_area": (_RING, "DOUBLE", f"abs(aggregate(transform(ring, (p, i) -> p.x * {_NEXT}.y - {_NEXT}.x * p.y), 0D, (s, x) -> s + x)) / 2"),
    "ring_holds": (f"{_RING}, px DOUBLE, py DOUBLE", "BOOLEAN", f"size(filter(ring, (p, i) -> {_ON_EDGE})) > 0 OR size(filter(ring, (p, i) -> {_CROSSED})) % 2 = 1"),
    "file_stem": ("path STRING", "STRING", "regexp_replace(substring_index(path, '/', -1), '\\\\.[^.]*$', '')"),
}


class ClipPolygon:
    """clip_polygon(xs, ys, width, height): ring, place, x and y of the parts of a polygon within an image."""

    def eval(self, xs: list[float], ys: list[float], width: float, height: float) -> Iterator[tuple]:
        if xs is not None and ys is not None and width is not None and height is not None:
            for n, ring in enumerate(clip_ring(np.column_stack([xs, ys]), float(width), float(height))):
                for k, (x, y) in enumerate(ring.tolist()):
                    yield n, k, x, y


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session, once."""
    if spark.catalog.functionExists("clip_polygon"):
        return
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("clip_polygon", F.udtf(ClipPolygon, returnType="ring int, place int, x double, y double"))
