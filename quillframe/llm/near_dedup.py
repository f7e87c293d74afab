"""Near-duplicate groups: banded MinHash candidates, odd sketches, confirmation on full shingle sets.

A text's set holds its distinct shingles of `words` words (A-Z lower-cased, words cut at ASCII white space); a text of fewer words has
its whole sequence as one shingle, a text without words the empty set, which is linked with nothing. Sets are linked when
100 * intersection >= percent * union.

1. One pass over the texts makes, for each row, the size and a hash of its set, `bands` band keys of `rows` MinHash values each, and an
   odd sketch: each of the set's SAMPLES smallest hashes (a bottom-k MinHash sample: all of a smaller set) flips one bit of a bitmap, so
   that the bitmaps of two sets differ in the more bits the more samples differ. Rows of equal sets become one node, named by their
   smallest id.
2. Each bucket of a band is searched from its centre, the member with the most company over all its buckets, which a group's original
   is: members are paired with the centre, not with each other. Pairs whose sketches are too far apart go; the rest is confirmed on the
   full sets. Confirmed links make components, so a group of copies costs as many pairs as it has members.
3. Only members of one bucket that are still in different components can add anything. Members outside the bucket's largest component
   meet all others in blocks of bounded size, sketch against sketch. First each sends only its nearest one to be confirmed; then, in
   the components this leaves, all pairs that are near and not joined are. No candidate that could join two components is passed over.

Defined cases: a null text is empty. A row with a null id can't be named as a partner or as a component: it is linked with nothing, its
component is null, and it is kept. Rows that repeat an id with one text are one document; with different texts each text is searched by
itself. Other columns are not read; results have the columns named here only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import remove, written
from . import kernels as K
from .graph import components

SKETCH_BITS, SAMPLES = 2048, 1024
#: Members of a bucket that meet in one block.
BLOCK = 4096
SKETCH_WORDS = SKETCH_BITS // 64


def sketch_far(a, b, percent: int, f=np, least=np.minimum, greatest=np.maximum):  # noqa: ANN001, ANN201
    """Bits in which sketches of sets of a and b elements may differ if the sets are linked, and whether sets of these sizes can be.

    Linked sets have c elements in common at least. If both samples are whole sets that bounds the differing samples exactly, else up to
    4.5 standard deviations of drawing; flips that fall on one bit and cancel out are allowed for likewise. Works on arrays and columns.
    """
    c = f.ceil(percent * (a + b) / (100.0 + percent))
    most = greatest(a, b)
    share = least(SAMPLES / most, a * 0 + 1.0)
    common = c * share - 4.5 * f.sqrt(c * share * (1 - share) * greatest(1 - c / most, a * 0.0))
    flips = least(a, a * 0 + SAMPLES) + least(b, a * 0 + SAMPLES) - 2 * common
    seen = SKETCH_BITS / 2 * (1 - f.exp(-2 * flips / SKETCH_BITS)) + 4.5 * least(flips * (2 / SKETCH_BITS) ** 0.5, a * 0 + SKETCH_BITS**0.5 / 2)
    return least(flips, seen), c <= least(a, b)


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk, and the bounds of each document in them."""
    raw = K.TO_LOWER[raw]
    starts, ends, first = K.word_spans(raw, at)
    hashes = K.span_hashes(raw, starts, ends)
    counts = np.diff(first)
    sizes = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    grams = K.ngram_hashes(hashes, words)
    out = np.empty(bounds[-1], np.uint64)
    for d in range(len(counts)):
        lo, hi = bounds[d], bounds[d + 1]
        if counts[d] >= words:
            out[lo:hi] = grams[first[d] : first[d] + hi - lo]
            out[lo:hi].sort()
        elif hi > lo:
            h = np.array([counts[d]], np.uint64)
            for w in hashes[first[d] : first[d + 1]]:
                h = K.mix64(h * np.uint64(3) + w)
            out[lo] = h[0]
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[bounds[:-1][sizes > 0]] = True
    kept = np.zeros(len(out) + 1, np.int64)
    np.cumsum(fresh, out=kept[1:])
    return out[fresh], kept[bounds]


class Signer:
    """MinHash values by multiply-add permutations of mixed 64-bit hashes, folded into band keys; odd sketches of the smallest hashes."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        random = np.random.default_rng(20240607)
        self.mul = random.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = random.integers(0, 1 << 63, bands * rows, np.uint64)
        self.salt = random.integers(0, 1 << 63, bands * rows, np.uint64)

    def __call__(self, sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each document: hash of the set, band keys, sketch words; zeros for an empty set."""
        n = len(bounds) - 1
        full = np.flatnonzero(np.diff(bounds))
        names, keys, sketch = np.zeros(n, np.uint64), np.zeros((n, self.bands), np.uint64), np.zeros((n, SKETCH_WORDS), np.uint64)
        if not len(full):
            return names, keys, sketch
        at = bounds[:-1][full]
        names[full] = K.mix64(np.add.reduceat(K.mix64(sets ^ np.uint64(0x5851F42D4C957F2D)), at) + np.diff(bounds)[full].astype(np.uint64))
        value = np.empty_like(sets)
        for k, (m, a, s) in enumerate(zip(self.mul, self.add, self.salt, strict=True)):
            np.multiply(sets, m, out=value)
            value += a
            least = K.mix64(np.minimum.reduceat(value, at) ^ s)
            keys[full, k // self.rows] = keys[full, k // self.rows] * K._STEPS[2] + least
        # sets are sorted, so a set's smallest hashes come first
        nth = np.arange(len(sets)) - np.repeat(bounds[:-1], np.diff(bounds))
        drawn = nth < SAMPLES
        owner = np.repeat(np.arange(n), np.diff(bounds))[drawn]
        bit, times = np.unique(owner * SKETCH_BITS + (K.mix64(sets[drawn] ^ K._STEPS[1]) % np.uint64(SKETCH_BITS)).astype(np.int64), return_counts=True)
        bit = bit[times % 2 == 1]
        np.bitwise_or.at(sketch.reshape(-1), bit >> 6, np.uint64(1) << (bit & 63).astype(np.uint64))
        return names, K.mix64(keys), sketch


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat.view(np.int64)))


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """id, n (size of the set), name (its hash), keys and sketch of each row of (id, text).

    The sketch is one column: with a column for each word the plans that carry it grew so large that most of the driver's memory was theirs.
    """
    schema = "id long, n long, name long, keys array<long>, sketch array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for b in batches:
            for lo, hi, raw, at in K.text_chunks(b.column(1)):
                sets, bounds = shingle_sets(raw, at, words)
                names, keys, sketch = signer(sets, bounds)
                per_row = np.where(np.diff(bounds) > 0, bands, 0)
                cuts = np.concatenate([[0], np.cumsum(per_row)])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(names.view(np.int64)), _lists(np.ascontiguousarray(keys[per_row > 0].ravel()), cuts), _lists(sketch.ravel(), np.arange(hi - lo + 1) * SKETCH_WORDS)],
                    names=["id", "n", "name", "keys", "sketch"],
                )

    return docs.mapInArrow(sign, schema)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """id, name and the whole set of each row of (id, text)."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(0, 0)
        for b in batches:
            for lo, hi, raw, at in K.text_chunks(b.column(1)):
                sets, bounds = shingle_sets(raw, at, words)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(signer(sets, bounds)[0].view(np.int64)), _lists(sets, bounds)], names=["id", "name", "shingles"])

    return docs.mapInArrow(sets_of, "id long, name long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes with their names that are linked, on their full sets."""
    side = lambda s: sets.select(F.col("id").alias(s), F.col("name").alias(f"name_{s}"), F.col("shingles").alias(f"set_{s}"))
    both = pairs.join(side("u"), ["u", "name_u"]).join(side("v"), ["v", "name_v"])
    common = F.size(F.array_intersect("set_u", "set_v"))
    return both.filter(100 * common >= percent * (F.size("set_u") + F.size("set_v") - common)).select("u", "v")


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sketches are near, with the names of their sets."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("name").alias(f"name_{s}"), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}"))
    apart = sum((F.bit_count(F.col("sketch_u")[k].bitwiseXOR(F.col("sketch_v")[k])) for k in range(SKETCH_WORDS)), F.lit(0))
    far, can = sketch_far(F.col("n_u"), F.col("n_v"), percent, F, F.least, F.greatest)
    return pairs.join(side("u"), "u").join(side("v"), "v").filter(can & (apart <= far)).select("u", "v", "name_u", "name_v")


def _open_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of one bucket in different components whose sketches are near, with the names of their sets; or only each member's nearest."""
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    in_comp = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"))
    sizes = in_comp.groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("main"))
    several = sizes.filter("comps > 1").select("key", F.col("main.comp").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("parts"))
    open_ = labelled.join(several, "key").join(nodes, "node").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each block has the part-th members outside the main component on the left, and the other-th of all members on the right
    parts = F.sequence(F.lit(0), F.col("parts") - 1)
    right = F.transform(parts, lambda p: F.struct(F.lit(False).alias("left"), p.alias("a"), F.col("part").alias("b")))
    left = F.transform(parts, lambda p: F.struct(F.lit(True).alias("left"), F.col("part").alias("a"), p.alias("b")))
    placed = open_.withColumn("place", F.explode(F.when(F.col("comp") != F.col("main"), F.concat(right, left)).otherwise(right)))
    blocks = placed.select("key", "node", "comp", "name", "n", "sketch", "place.left", "place.a", "place.b").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            place = np.stack([b.column(k).to_numpy() for k in (0, b.num_columns - 2, b.num_columns - 1)])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1
            if held and b.num_rows and any(held[-1].column(k)[-1] != b.column(k)[0] for k in (0, b.num_columns - 2, b.num_columns - 1)):
                yield meet(held)
                held = []
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo and held:
                    yield meet(held)
                    held = []
                held.append(b.slice(lo, hi - lo))
        if held:
            yield meet(held)

    def meet(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        node, comp, name, n, is_left = (t[c].to_numpy() for c in ("node", "comp", "name", "n", "left"))
        sketch = pa.concat_arrays(t["sketch"].chunks).flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH_WORDS)
        rows, others = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        found = []
        for at in range(0, len(rows), 64):
            some = rows[at : at + 64]
            apart = np.zeros((len(some), len(others)), np.int64)
            for k in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[some, k][:, None] ^ sketch[others, k][None, :])
            far, can = sketch_far(n[some][:, None].astype(float), n[others][None, :].astype(float), percent)
            near = can & (apart <= far) & (comp[some][:, None] != comp[others][None, :])
            if nearest:
                best = np.where(near, apart, SKETCH_BITS + 1).argmin(1) if len(others) else np.zeros(0, np.int64)
                i = np.flatnonzero(near[np.arange(len(some)), best]) if len(others) else best
                j = best[i]
            else:
                i, j = np.nonzero(near)
            found.append(np.stack([some[i], others[j]]))
        x, y = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        swap = node[x] < node[y]
        u, v = np.where(swap, y, x), np.where(swap, x, y)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (node[u], node[v], name[u], name[v])], names=["u", "v", "name_u", "name_v"])

    return blocks.mapInArrow(compare, "u long, v long, name_u long, name_v long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 85, bands: int = 24, rows: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links, itself included) and kept (whether that is itself) for each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    signed = written(signatures(docs, words, bands, rows))
    every, signed = signed, signed.filter("id is not null and n > 0")
    # all copies of a set share all its keys, so the smallest id is the same in each of its buckets
    filed = signed.select(F.explode("keys").alias("key"), "name", "id").groupBy("key", "name").agg(F.min("id").alias("node")).select("key", "node").distinct()
    sizes = filed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    sized = written(filed.join(sizes, "key"))
    company = sized.groupBy("node").agg(F.sum("size").alias("company"))
    members = written(sized.join(company, "node").select("key", "node", "company"))
    wanted = written(company.select(F.col("node").alias("id")))
    remove(sized)
    nodes = written(signed.join(wanted, "id", "left_semi").select(F.col("id").alias("node"), "name", "n", "sketch").dropDuplicates(["node", "name"]))
    sets = written(full_sets(docs.filter("id is not null").join(wanted.hint("merge"), "id", "left_semi"), words).groupBy("id", "name").agg(F.first("shingles").alias("shingles")))
    centres = members.groupBy("key").agg(F.min(F.struct((-F.col("company")).alias("others"), "node")).alias("c")).select("key", F.col("c.node").alias("v"))
    star = members.join(centres, "key").filter("node <> v").select(F.col("node").alias("u"), "v").distinct()
    links = written(_confirmed(_near(star, nodes, percent), sets, percent))
    labels = written(components(links))
    remove(links)
    for nearest in (True, False):
        near = written(_open_pairs(members.select("key", "node"), labels, nodes, percent, nearest))
        if near.isEmpty():  # a member without a nearest one has no near one
            remove(near)
            break
        more = written(_confirmed(near, sets, percent))
        remove(near)
        if more.isEmpty():
            remove(more)
            continue
        # new links join components, of which there are far fewer than links
        to = lambda side: labels.select(F.col("node").alias(side), F.col("comp").alias(f"c{side}"))  # noqa: E731, B023
        joined = more.join(to("u"), "u", "left").join(to("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).distinct()
        found = written(components(joined))
        over = found.select(F.col("node").alias("comp"), F.col("comp").alias("over"))
        lone = over.join(labels, over["comp"] == labels["node"], "left_anti").select(F.col("comp").alias("node"), F.col("over").alias("comp"))
        before, labels = labels, written(labels.join(over, "comp", "left").select("node", F.coalesce("over", "comp").alias("comp")).union(lone))
        for old in (before, more, found):
            remove(old)
    for old in (members, nodes, sets, wanted):
        remove(old)
    # only sets that several documents have need a look for the smallest id; as tables, both sides of each join can be split where a key is hot
    shared = written(signed.groupBy("name").agg(F.min("id").alias("node"), F.max("id").alias("last")).filter("node < last").select("name", "node"))
    mine = signed.select("id", "n", "name").join(shared, "name", "left").select("id", "n", F.coalesce("node", "id").alias("node"))
    found = mine.join(labels, "node", "left").select("id", "n", F.coalesce("comp", "node").alias("comp"))
    alone = every.filter("id is null or n = 0").select("id", "n", F.col("id").alias("comp"))
    return found.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.coalesce(F.col("id") == F.col("comp"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """The rows of docs whose document is the one that its group keeps."""
    gone = groups(docs, id_col, text_col, **rule).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")

