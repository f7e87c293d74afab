"""Quality classifier: importance resampling from hashed n-gram models of target and raw text.

Two generative models over the same hashed n-grams are counted in one pass: the raw model over all documents, the target model over a
bounded sample of labelled good ones (quality 1 and not toxic, of two thirds of at most `fit_rows` labelled rows). N-grams are single words (A-Z
lower-cased, without a last full stop or comma) in 2**20 buckets, and pairs of neighbouring word shapes (length, case, last character,
repetition of the one or two words before) in 2**16.

A bucket's log ratio is that of its target count to the count that the raw model expects, scaled so that the typical n-gram is at zero, and
drawn towards zero by what chance explains. A document's log weight is the sum of its n-grams' log ratios, for and against it: the log
ratio of both models for the text, taken for `length` words at most (a longer text counts by its mean, so that length itself is neutral).

Documents are sampled without replacement by Gumbel top-k: those with the k largest keys, log weight / temperature + Gumbel noise drawn
from the id. k is given, or foretold by the last third of the labelled rows: the number of documents whose key is above that which parts
good ones from others with the fewest errors. The k-th key is found by counting, digit by digit; documents that tie with it stay.

Defined cases: null and empty texts have log weight 0. Rows that repeat an id each get their own weight, with the same noise. Labels of
ids that several rows have count for each. Without labelled rows of both kinds in the last third, everything is kept. Columns may have any names; those named
`__weight` and `__kept` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..storage import written
from . import kernels as K

WORD_BUCKETS, SHAPES = 1 << 20, 1 << 8
BUCKETS = WORD_BUCKETS + SHAPES * SHAPES

_LAST = np.zeros(256, np.int64)  # 0: a letter, or a byte of one
for _kind, _chars in enumerate((b".,", b"!?", b"#$%&*", b"|", b"0123456789", b")]}\"'>", b";:-_/\\"), 1):
    _LAST[list(_chars)] = _kind


def ngram_buckets(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape-pair bucket of each word of a chunk, and the index of each document's first word."""
    starts, ends, first = K.word_spans(raw, at)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    low, last = K.TO_LOWER[raw], raw[ends - 1]
    trimmed = ends - ((last == 46) | (last == 44)) * (ends - starts > 1)
    words = K.span_hashes(low, starts, trimmed)
    begins = np.zeros(len(words) + 1, bool)
    begins[first] = True
    begins = begins[:-1]
    same = np.zeros((2, len(words)), bool)
    same[0, 1:] = (words[1:] == words[:-1]) & ~begins[1:]
    same[1, 2:] = (words[2:] == words[:-2]) & ~begins[2:] & ~begins[1:-1]
    capitals = (raw[starts] - 65 < 26) & (raw[np.minimum(starts + 1, ends - 1)] - 65 < 26) & (ends - starts > 1)
    shape = _LAST[last] | capitals.astype(np.int64) << 3 | same[0].astype(np.int64) << 4 | same[1].astype(np.int64) << 5 | np.minimum((ends - starts) // 6, 3) << 6
    before = np.concatenate([[0], shape[:-1]])
    before[begins] = 0
    return (words >> np.uint64(44)).astype(np.int64), WORD_BUCKETS + before * SHAPES + shape, first


def _counted(marked: DataFrame) -> DataFrame:
    """bucket, raw and target counts of rows (text, target)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw_counts, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            wanted = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, raw, at in K.text_chunks(b.column(0)):
                words, shapes, first = ngram_buckets(raw, at)
                mine = np.repeat(wanted[lo:hi], np.diff(first))
                for buckets in (words, shapes):
                    raw_counts += np.bincount(buckets, minlength=BUCKETS)
                    if mine.any():
                        target += np.bincount(buckets[mine], minlength=BUCKETS)
        some = np.flatnonzero(raw_counts)
        for part in np.array_split(some, max(1, len(some) // 50_000)):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw_counts[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    counts = marked.mapInArrow(count, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(raw: np.ndarray, target: np.ndarray, z: float = 4.5, prior: float = 0.3) -> np.ndarray:
    """The log ratio of each bucket's n-grams, z standard deviations of chance nearer to 0."""
    out = np.zeros(len(raw))
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, None)):
        r, t = raw[part].astype(float), target[part].astype(float)
        if not t.sum():
            continue
        often = np.flatnonzero(r * (t.sum() / r.sum()) >= 20)  # the typical ratio, weighted by count, of n-grams frequent enough to have one
        often = often if len(often) else np.flatnonzero(r)
        order = often[np.argsort(t[often] / r[often])]
        weight = np.cumsum(r[order])
        typical = order[np.searchsorted(weight, weight[-1] / 2)]
        expected = r * (t[typical] / r[typical] or t.sum() / r.sum())
        ratio = np.log((t + prior) / (expected + prior))
        out[part] = np.sign(ratio) * np.maximum(0, np.abs(ratio) - z / np.sqrt(expected + 1))
    return out


def _weighted(rows: DataFrame, labels: DataFrame, own_id: str, place: int, keep: list[str], fit_rows: int, length: int) -> tuple[DataFrame, DataFrame]:
    """keep (columns of rows) and `weight` of each row; and the sample of labels (label_id, good, held)."""
    spark = rows.sparkSession
    good = (F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    turn = F.xxhash64(F.lit("fit"), "doc_id")
    sample = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(good.cast("int")).alias("good")).orderBy(turn).limit(fit_rows)
    sample = written(sample.select(F.col("doc_id").alias("label_id"), "good", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(3)) == 0).alias("held")))
    text = rows.columns[place]
    # at most fit_rows rows of 12 bytes
    marked = rows.select(own_id, text).join(F.broadcast(sample.filter("good = 1 and not held")), F.col(own_id) == F.col("label_id"), "left").select(text, F.col("label_id").isNotNull().alias("target"))
    counts = _counted(marked).toArrow()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    ratios = spark.sparkContext.broadcast(log_ratios(raw, target).astype(np.float32))
    kept_places = [rows.columns.index(c) for c in keep]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = np.zeros(b.num_rows)
            for lo, hi, data, offsets in K.text_chunks(b.column(place)):
                words, shapes, first = ngram_buckets(data, offsets)
                n = np.diff(first)
                weights[lo:hi] = K.segment_sums(ratios.value[words].astype(float) + ratios.value[shapes], first) * (length / np.maximum(n, length))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept_places), pa.array(weights)], names=[*keep, "weight"])

    schema = StructType([*(rows.schema.fields[k] for k in kept_places), StructField("weight", DoubleType())])
    return rows.mapInArrow(weigh, schema), sample


def best_cut(keys: np.ndarray, good: np.ndarray) -> int | None:
    """The least key of what is taken, so that good rows are parted from others with the fewest errors; midway between the rows around it. None without both kinds."""
    if good.all() or not good.any():
        return None
    order = np.argsort(keys, kind="stable")
    k, g = keys[order], good[order]
    errors = np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum(~g[::-1])[::-1], [0]])
    errors[1:-1][k[1:] == k[:-1]] = len(k) + 1  # no cut between equal keys
    n = int(np.argmin(errors))
    return int(k[0]) if n == 0 else int(k[-1]) + 1 if n == len(k) else int(k[n - 1]) + (int(k[n]) - int(k[n - 1]) + 1) // 2


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, None if there are fewer; 6 counts of at most 2048 digits, whatever the number of rows."""
    if k <= 0:
        return None
    ordered = F.col(column).bitwiseXOR(F.lit(-(2**63)))  # as unsigned
    prefix, rest = 0, df.select(ordered.alias("u"))
    for shift in range(55, -1, -11):
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(2047)
        counts = {r["digit"]: r["n"] for r in rest.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
        for d in sorted(counts, reverse=True):
            if counts[d] >= k:
                break
            k -= counts[d]
        else:
            return None
        prefix |= d << shift
        rest = rest.filter(digit == d)
    return prefix - (1 << 63)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, temperature: float = 1.0, keep: list[str] | None = None, fit_rows: int = 50_000, length: int = 128) -> DataFrame:
    """keep (columns; all of them by default) of docs with __weight, the log weight, and __kept, whether the sample has the row."""
    numbered = [f"c{n}" for n in range(len(docs.columns))]  # by place, so that no name can clash
    place = dict(zip(docs.columns, numbered, strict=True))
    wanted = [c for c in (docs.columns if keep is None else keep) if c not in ("__weight", "__kept")]
    own_id = place[id_col]
    read = docs.toDF(*numbered)
    columns = list(dict.fromkeys([*(place[c] for c in wanted), own_id]))
    used = list(dict.fromkeys([*columns, place[text_col]]))
    rows, sample = _weighted(read.select(*used), labels, own_id, used.index(place[text_col]), columns, fit_rows, length)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), own_id), 11).cast("double") + 0.5) / float(1 << 53)
    key = F.col("weight") / temperature - F.log(-F.log(uniform))
    rows = written(rows.withColumn("key", F.floor(key * 1e6).cast("long")))
    if k is None:
        # at most fit_rows rows on either side
        held = rows.join(F.broadcast(sample.filter("held")), F.col(own_id) == F.col("label_id")).groupBy("label_id").agg(F.max("key").alias("key"), F.max("good").alias("good")).toArrow()
        least = best_cut(held["key"].to_numpy(), held["good"].to_numpy() == 1)
        k = rows.count() if least is None else rows.filter(F.col("key") >= least).count()
    cut = kth_largest(rows, "key", k)
    kept = F.lit(k > 0) if cut is None else F.col("key") >= cut
    return rows.select(*(F.col(place[c]).alias(c) for c in wanted), F.col("weight").alias("__weight"), kept.alias("__kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that the sampler takes; their columns may have any names."""
    numbered = [f"c{k}" for k in range(len(docs.columns))]
    place = dict(zip(docs.columns, numbered, strict=True))
    return resample(docs.toDF(*numbered), labels, place[id_col], place[text_col], **how).filter("__kept").select(*numbered).toDF(*docs.columns)
