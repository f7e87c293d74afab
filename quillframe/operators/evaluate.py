"""Evaluation of predictions against ground truth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..functions.geometry import BOX, has_box, iou
from ..storage import written
from .media import MASK, repaint_mask  # noqa: F401
from .pairs import near_boxes

#: Negatives that anchor the precision curve at threshold zero, and their score.
PADDING, PADDING_SCORE = 1_000_000, 0.0001


def judged_detections(pred: Dataset, gt: Dataset, threshold: float = 0.5, where_object_gt: str = "true", agnostic: bool = False, named: bool = True) -> DataFrame:
    """objectid, name, score, has_gt and outcome (tp, fp or ignored) of each detection.

    A detection goes for the ground truth of its image (and name) that it overlaps most, the first by id on a tie. Of detections that
    overlap their choice by more than the threshold the highest score claims it, the smallest id on a tie; later ones are false. Detections
    without a name are left out, unless names don't count (agnostic) or `named` is False: then they are false.
    """
    keys = ["imagefile"] if agnostic else ["imagefile", "name"]
    det = pred.objects.filter("name is not null" if named and not agnostic else "true").select("objectid", "imagefile", "name", "score", *BOX)
    wanted = F.coalesce(F.expr(where_object_gt), F.lit(False))
    truth = gt.objects.filter(has_box()).withColumn("wanted", wanted).select("objectid", *keys, "wanted", *BOX)
    pairs = near_boxes(det.select("objectid", *keys, "score", *BOX), truth, keys).select(F.col("a_objectid").alias("objectid"), F.col("a_score").alias("score"), F.col("b_objectid").alias("gt_id"), F.col("b_wanted").alias("wanted"), iou("a_", "b_").alias("iou"))
    best = pairs.groupBy("objectid").agg(F.max_by(F.struct("gt_id", "wanted", "iou", "score"), F.struct("iou", -F.col("gt_id"))).alias("b")).select("objectid", "b.*")
    hit = best.filter(F.col("iou") > threshold)
    first = hit.withColumn("turn", F.row_number().over(Window.partitionBy("gt_id").orderBy(F.col("score").desc_nulls_last(), "objectid")))
    claims = first.filter("turn = 1").select("objectid", F.when(F.col("wanted"), "tp").otherwise("ignored").alias("claim"))
    seen = det.filter(has_box()).join(truth.select(*keys), keys, "left_semi").select("objectid", F.lit(True).alias("has_gt"))
    return det.join(claims, "objectid", "left").join(seen, "objectid", "left").select("objectid", "name", "score", F.coalesce("has_gt", F.lit(False)).alias("has_gt"), F.coalesce("claim", F.lit("fp")).alias("outcome"))


def _truths(gt: Dataset, where_object_gt: str, group: list[str]) -> DataFrame:
    return gt.objects.filter(where_object_gt).filter("name is not null" if group else "true").groupBy(*group).agg(F.count("*").alias("n_gt"))


#: Parts that a group's scores are cut into.
CHUNKS = 64


def _chunked(df: DataFrame, group: str, score: str) -> DataFrame:
    """df with `chunk`: in which of at most CHUNKS parts of its group's scores, highest first, a row is; nulls are last. Equal scores are in one part."""
    cuts = df.groupBy(group).agg(F.array_distinct(F.percentile_approx(score, [k / CHUNKS for k in range(1, CHUNKS)], 1000)).alias("cuts"))
    above = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<double>")), lambda c: F.col(score) < c))
    return df.join(cuts, group).withColumn("chunk", F.when(F.col(score).isNull(), CHUNKS).otherwise(above)).drop("cuts")


def _running(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df (with chunks) with sums over the rows of the group up to each row, in order. Windows hold one chunk; of each chunk a total goes to a small table of offsets."""
    totals = df.groupBy(group, "chunk").agg(*(F.sum(v).alias(f"all_{k}") for k, v in sums.items()))
    before = Window.partitionBy(group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "chunk", *(F.coalesce(F.sum(f"all_{k}").over(before), F.lit(0)).alias(f"before_{k}") for k in sums))
    up_to = Window.partitionBy(group, "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = df.withColumns({k: F.sum(v).over(up_to) for k, v in sums.items()})
    return within.join(offsets, [group, "chunk"]).withColumns({k: F.col(k) + F.col(f"before_{k}") for k in sums}).drop(*(f"before_{k}" for k in sums))


def average_precision_envelope(pred: Dataset, gt: Dataset, threshold: float = 0.5, where_object_gt: str = "true") -> DataFrame:
    """name, n_gt and ap: the area below the envelope of the precision-recall curve, for each class of the ground truth."""
    hit = (F.col("outcome") == "tp").cast("long")
    d = _chunked(written(judged_detections(pred, gt, threshold, where_object_gt).select("objectid", "name", "score", "outcome")), "name", "score")
    d = _running(d, "name", [F.col("score").desc_nulls_last(), F.col("objectid")], {"tp": hit, "fp": (F.col("outcome") == "fp").cast("long")})
    d = d.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)))
    # the envelope is the highest precision from a row on: of its chunk's rest, and of later chunks
    tops = d.groupBy("name", "chunk").agg(F.max("precision").alias("top"))
    later = tops.select("name", "chunk", F.max("top").over(Window.partitionBy("name").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    rest = Window.partitionBy("name", "chunk").orderBy(F.col("score").asc_nulls_first(), F.col("objectid").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("envelope", F.max("precision").over(rest)).join(later, ["name", "chunk"])
    areas = d.filter("outcome = 'tp'").groupBy("name").agg(F.sum(F.greatest("envelope", F.coalesce("later", F.lit(0.0)))).alias("area"))
    counts = _truths(gt, where_object_gt, ["name"])
    return counts.join(areas, "name", "left").select("name", "n_gt", F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"))


def precision_recall(pred: Dataset, gt: Dataset, threshold: float = 0.5, where_object_gt: str = "true", mode: str = "by-class") -> DataFrame:
    """Counts at each distinct score: name (`all` in the modes that put classes together), score, hits at it, tp and fp at or above it, positives and negatives in all.

    mode: `by-class`, `aggregate-classes` (classes matter for matching only) or `class-agnostic`. Detections without ground truth count at
    score 0, missed positives too, and a fixed number of negatives stands just above it.
    """
    group = ["name"] if mode == "by-class" else []
    label = F.col("name") if group else F.lit("all")
    d = judged_detections(pred, gt, threshold, where_object_gt, mode == "class-agnostic", mode == "by-class").filter("outcome <> 'ignored'")
    score = F.when(F.col("has_gt"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)
    d = written(d.groupBy(label.alias("name"), score.alias("s")).agg(F.count_if(F.expr("outcome = 'tp'")).alias("p"), F.count_if(F.expr("outcome = 'fp'")).alias("n")))
    truths = _truths(gt, where_object_gt, group).select(label.alias("name"), "n_gt")
    found = d.groupBy("name").agg(F.sum("p").alias("found"))
    missed = truths.join(found, "name", "left").select("name", F.lit(0.0).alias("s"), (F.col("n_gt") - F.coalesce("found", F.lit(0))).alias("p"), F.lit(0).cast("long").alias("n"))
    padding = truths.select("name", F.lit(PADDING_SCORE).alias("s"), F.lit(0).cast("long").alias("p"), F.lit(PADDING).cast("long").alias("n"))
    scores = d.unionByName(missed).unionByName(padding).groupBy("name", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).join(truths.select("name"), "name", "left_semi")
    curve = _running(_chunked(scores, "name", "s"), "name", [F.desc("s")], {"tp": F.col("p"), "fp": F.col("n")})
    whole = scores.groupBy("name").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"))
    return curve.join(whole, "name").select("name", F.col("s").alias("score"), F.col("p").alias("hits"), "tp", "fp", "positives", "negatives")


def average_precision(pred: Dataset, gt: Dataset, threshold: float = 0.5, where_object_gt: str = "true", mode: str = "by-class") -> DataFrame:
    """name and ap: precision summed over distinct scores, weighted by the gain in recall."""
    curve = precision_recall(pred, gt, threshold, where_object_gt, mode)
    gain = F.col("hits") / F.nullif("positives", F.lit(0)) * F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))
    return curve.groupBy("name").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("ap"))


def roc_curve(pred: Dataset, gt: Dataset, threshold: float = 0.5, where_object_gt: str = "true", mode: str = "by-class") -> DataFrame:
    c = precision_recall(pred, gt, threshold, where_object_gt, mode)
    return c.select("name", "score", (F.col("fp") / F.nullif("negatives", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("positives", F.lit(0))).alias("tpr"))


def classification_report(pred: Dataset, gt: Dataset) -> DataFrame:
    """name, precision, recall, f1 and support of each class, and rows `accuracy`, `macro avg` and `weighted avg`; objects are paired by id."""
    both = gt.objects.select("objectid", F.col("name").alias("truth")).join(pred.objects.select("objectid", F.col("name").alias("said")), "objectid").filter("truth is not null and said is not null")
    cells = written(both.groupBy("truth", "said").agg(F.count("*").alias("n")))
    right = cells.filter("truth = said").select(F.col("truth").alias("name"), F.col("n").alias("tp"))
    of_truth = cells.groupBy(F.col("truth").alias("name")).agg(F.sum("n").alias("support"))
    of_said = cells.groupBy(F.col("said").alias("name")).agg(F.sum("n").alias("predicted"))
    c = of_truth.join(of_said, "name", "full").join(right, "name", "left").select("name", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "predicted", "tp")))
    share = lambda a, b: F.col(a) / F.nullif(b, F.lit(0))
    c = c.select("name", share("tp", F.col("predicted")).alias("precision"), share("tp", F.col("support")).alias("recall"), (2 * F.col("tp") / F.nullif(F.col("predicted") + F.col("support"), F.lit(0))).alias("f1"), "support")
    total = cells.agg(F.sum("n").alias("support"), (F.sum(F.when(F.expr("truth = said"), F.col("n")).otherwise(0)) / F.sum("n")).alias("f1"))
    weighted = lambda m: (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(m)
    measures = ("precision", "recall", "f1")
    nothing = F.lit(None).cast("double")
    return (
        c.unionByName(total.select(F.lit("accuracy").alias("name"), nothing.alias("precision"), nothing.alias("recall"), "f1", "support"))
        .unionByName(c.agg(*(F.avg(m).alias(m) for m in measures), F.sum("support").alias("support")).withColumn("name", F.lit("macro avg")))
        .unionByName(c.agg(*(weighted(m) for m in measures), F.sum("support").alias("support")).withColumn("name", F.lit("weighted avg")))
    )


def confusion(pred_masks: DataFrame, gt_masks: DataFrame, classes: int) -> DataFrame:
    """imagefile, truth, said and n pixels, from 8-bit masks (imagefile, height, width, data); predictions are resized to the truth by nearest pixel, values of `classes` and above don't count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(*(b.column(c).to_pylist() for c in ("g_height", "g_width", "height", "width")), strict=True)
            cells, of = [], []
            for k, (g, d, (gh, gw, h, w)) in enumerate(zip(b.column("g_data"), b.column("data"), sizes, strict=True)):
                truth, said = np.frombuffer(g.as_buffer(), np.uint8), np.frombuffer(d.as_buffer(), np.uint8)
                if (gh, gw) != (h, w):
                    said = said.reshape(h, w)[(np.arange(gh) * h // gh)[:, None], np.arange(gw) * w // gw].ravel()
                n = np.bincount(np.where((truth < classes) & (said < classes), truth * np.int32(classes) + said, classes * classes), minlength=classes * classes)[: classes * classes]
                cells.append(np.flatnonzero(n))
                of += [n[cells[-1]]]
            place, cell = np.repeat(np.arange(len(cells)), [len(c) for c in cells]), np.concatenate(cells or [np.zeros(0, np.int64)])
            columns = [b.column("imagefile").take(pa.array(place)), pa.array(cell // classes, pa.int32()), pa.array(cell % classes, pa.int32()), pa.array(np.concatenate(of or [cell]), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["imagefile", "truth", "said", "n"])

    truth = gt_masks.select("imagefile", *(F.col(c).alias("g_" + c) for c in ("height", "width", "data")))
    return pred_masks.join(truth, "imagefile").mapInArrow(count, "imagefile string, truth int, said int, n long")


def segmentation_scores(cells: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """From confusion counts: IoU of each class, and pixel accuracy, mean accuracy, frequency-weighted and mean IoU; for each key of `by`, or over all."""
    by = by or []
    t = cells.groupBy(*by, F.col("truth").alias("cls")).agg(F.sum("n").alias("t"), F.sum(F.when(F.expr("truth = said"), F.col("n")).otherwise(0)).alias("tp"))
    s = cells.groupBy(*by, F.col("said").alias("cls")).agg(F.sum("n").alias("s"))
    c = t.join(s, [*by, "cls"], "full").select(*by, "cls", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("t", "tp", "s")))
    c = c.withColumn("iou", F.col("tp") / (F.col("t") + F.col("s") - F.col("tp")))
    whole = c.groupBy(*by).agg((F.sum("tp") / F.sum("t")).alias("pixel_accuracy"), F.avg(F.col("tp") / F.nullif("t", F.lit(0))).alias("mean_accuracy"), (F.sum(F.col("t") * F.col("iou")) / F.sum("t")).alias("weighted_iou"), F.avg("iou").alias("mean_iou"))
    return c.select(*by, "cls", "iou"), whole


def evaluate_segmentation(ds: Dataset, pred_masks: DataFrame, gt_masks: DataFrame, classes: int, record_class: int | None = None) -> tuple[Dataset, DataFrame]:
    """The dataset with each image's score set to its mean IoU (or one class's), and the scores over all images."""
    cells = written(confusion(pred_masks, gt_masks, classes))
    per_class, per_image = segmentation_scores(cells, ["imagefile"])
    score = per_image.select("imagefile", F.col("mean_iou").alias("s")) if record_class is None else per_class.filter(F.col("cls") == record_class).select("imagefile", F.col("iou").alias("s"))
    images = ds.images.join(score, "imagefile", "left").withColumn("score", F.coalesce("s", "score"))
    return ds.with_(images=images), segmentation_scores(cells)[1]


def evaluate_segmentation_by_class(ds: Dataset, pred_masks: DataFrame, gt_masks: DataFrame, gt_mapping: dict[int | str, str], pred_mapping: dict[int | str, str] | None = None, record_class: str | None = None) -> tuple[Dataset, DataFrame, DataFrame]:
    """evaluate_segmentation for masks whose grey values mean classes by name, and the IoU of each class. Keys are as in label_table; values without a class don't count."""
    names = list(dict.fromkeys(gt_mapping.values()))
    if len(names) > 255:
        raise ValueError("an 8-bit mask can't hold so many classes")
    if unknown := set((pred_mapping or {}).values()) - set(names):
        raise ValueError(f"classes of predictions only: {', '.join(sorted(unknown))}")
    painted = lambda masks, mapping: repaint_mask(masks, {k: names.index(v) for k, v in mapping.items()}, other=255)
    said, truth = painted(pred_masks, pred_mapping or gt_mapping), painted(gt_masks, gt_mapping)
    out, whole = evaluate_segmentation(ds, said, truth, len(names), None if record_class is None else names.index(record_class))
    per_class, _ = segmentation_scores(confusion(said, truth, len(names)))
    named = F.element_at(F.array(*map(F.lit, names)), F.col("cls") + 1)
    return out, whole, per_class.select(named.alias("name"), "iou")


def evaluate_binary_segmentation(pred_masks: DataFrame, gt_masks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """threshold, precision and recall for each grey value (truth is 0 or 255, other pixels don't count), and the area below the curve."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            n = np.zeros((2, 256), np.int64)
            for r in rows.itertuples():
                truth, said = np.frombuffer(r.g_data, np.uint8), np.frombuffer(r.data, np.uint8)
                for k, value in enumerate((0, 255)):
                    n[k] += np.bincount(said[truth == value], minlength=256)
            yield pd.DataFrame({"value": np.arange(256), "neg": n[0], "pos": n[1]})

    truth = gt_masks.select("imagefile", F.col("data").alias("g_data"))
    values = pred_masks.join(truth, "imagefile").mapInPandas(count, "value int, neg long, pos long").groupBy("value").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    above = Window.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, -1)  # 256 rows
    c = values.select("value", F.coalesce(F.sum("pos").over(above), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(above), F.lit(0)).alias("fp"), F.sum("pos").over(Window.partitionBy(F.lit(1))).alias("all"))
    curve = c.select(F.col("value").alias("threshold"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif("all", F.lit(0))).alias("recall")).filter("precision is not null and recall is not null")
    rising = Window.orderBy(F.col("threshold").desc())
    last = curve.select(F.max_by("precision", "threshold").alias("p")).select(F.lit(256).alias("threshold"), F.col("p").alias("precision"), F.lit(0.0).alias("recall"))
    steps = curve.unionByName(last).withColumn("area", (F.col("recall") - F.lag("recall").over(rising)) * (F.col("precision") + F.lag("precision").over(rising)) / 2)
    return curve, steps.agg(F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"))
