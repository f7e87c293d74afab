"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of `window` words (A-Z lower-cased, cut at ASCII white space), words hashed to 2**15 terms.

1. Passage frequencies of all terms, over all documents.
2. A randomised SVD of the TF-IDF passage matrix A: tasks add up A'(A R) for a random R, the driver takes the left singular vectors of
   that sum (terms x rank) and scales them so that no direction dominates. A has the passages of all rows of documents, and of all
   benchmark items, so that each has a vector. Only a caller that sets `fit_docs` gets a fit on about so many documents, drawn by the hash
   of id and text (rows alike in both count once).
3. Every window of every document, half a window apart, goes into that space and is compared with the windows of the benchmark items,
   which are a query set of any size: each block of at most BLOCK_ITEMS items and BLOCK_WORDS words is broadcast and searched in a pass of
   its own over the documents, with the same frequencies and fit; its hits are written before the next block takes its place. Pairs of cosine `min_cosine` or more are candidates.
   Items of fewer words than a window are also compared with windows of their own length, at every word: those that have `min_terms` of
   their weight in such items' terms. So an exact copy, however short, meets a window of its own words.
4. A candidate needs `min_terms` of its own term weight in the item's text. Then the longest common subsequence of words of the item and
   the document around the window decides: `sure` of the item's words are a leak; from `likely` on, half of the answer's words must be
   there in order too. The answer is `answer_col`, or the item's last sentence.

Defined cases: null and empty texts have no passages; items without words match nothing. Repeated rows and items are each judged. Null ids
stay null. An empty benchmark gives an empty result. Other columns are not read. An item is held whole, so one of more than BLOCK_WORDS words
is a block of its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import kernels as K

TERMS = 1 << 15
SLICES = 64
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 1 << 16
#: Passages whose sums are held at once, tasks of the fit at most, and how many of them are added up first.
FIT_PASSAGES, FIT_TASKS, FIT_GROUP = 10_000, 1024, 32
#: Bounds of a block of the query set: its bitmaps are then 82 MB.
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 1_000_000
#: Items (and answers) up to so many words have a mask for each word; masks of longer ones are made as they are looked up.
MASKED_WORDS = 1024


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, raw, at in K.text_chunks(column):
        raw = K.TO_LOWER[raw]
        starts, ends, first = K.word_spans(raw, at)
        yield lo, hi, K.span_hashes(raw, starts, ends), first


def _term(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(49)).astype(np.int32)


def _bit(terms: np.ndarray) -> np.ndarray:
    """The bit of each term in its byte of a bitmap over terms."""
    return np.left_shift(1, terms & 7).astype(np.uint8)


def windows(first: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions of all windows (-1 beyond a document's end) and the document of each; the last one covers the last word."""
    n = np.diff(first)
    count = np.where(n > 0, 1 - (-np.maximum(n - size, 0) // step), 0)
    doc = np.repeat(np.arange(len(n)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][doc] + nth * step
    place = start[:, None] + np.arange(size)
    return np.where(place < first[1:][doc][:, None], place, -1), doc


def _terms_of(place: np.ndarray, terms: np.ndarray) -> np.ndarray:
    return np.where(place >= 0, terms[place], TERMS)


def short_windows(first: np.ndarray, terms: np.ndarray, weights: np.ndarray, known: np.ndarray, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """First word and document of the windows at every word that have a share `least` of their weight in known terms."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, last = np.arange(len(terms)), first[1:][doc]
    end = np.minimum(start + size, last)
    own = weights[terms].astype(np.float64)
    whole, shared = np.append(0, np.cumsum(own)), np.append(0, np.cumsum(own * known[terms]))
    keep = ((start + size <= last) | (start == first[:-1][doc])) & (shared[end] - shared[start] >= least * (whole[end] - whole[start]) - 1e-6)
    return start[keep], doc[keep]


def passage_frequencies(texts: DataFrame, window: int) -> tuple[np.ndarray, int]:
    """In how many passages (side by side, of all rows of the one text column) each term is, and how many passages there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(TERMS + 2, np.int64)
        for b in batches:
            for _, _, words, first in _words(b.column(0)):
                if len(words):
                    place, _ = windows(first, window, window)
                    terms = np.sort(_terms_of(place, _term(words)), axis=1)
                    new = np.ones(terms.shape, bool)
                    new[:, 1:] = terms[:, 1:] != terms[:, :-1]
                    found[: TERMS + 1] += np.bincount(terms[new], minlength=TERMS + 1)
                    found[TERMS + 1] += len(place)
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(found[some])], names=["term", "n"])

    rows = texts.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # TERMS + 2 rows at most
    found = np.zeros(TERMS + 2, np.int64)
    found[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return found[:TERMS], int(found[TERMS + 1])


def latent_space(texts: DataFrame, idf: np.ndarray, window: int, rank: int, oversample: int = 8) -> np.ndarray:
    """Term vectors (with the terms' weights, and a row of zeros for no term) of the leading latent directions of all rows' passages."""
    width = rank + oversample
    shared = texts.sparkSession.sparkContext.broadcast(idf.astype(np.float32))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        random = np.random.default_rng(7).standard_normal((TERMS + 1, width), np.float32) * weights[:, None]
        total = np.zeros((width, TERMS + 1))
        for b in batches:
            for _, _, words, first in _words(b.column(0)):
                if not len(words):
                    continue
                terms = _terms_of(windows(first, window, window)[0], _term(words))
                for part in np.array_split(terms, -(-len(terms) // FIT_PASSAGES)):
                    # a term's weight is the same in all passages, so it is taken out of both products: into random and, at the end, total
                    norms = np.linalg.norm(weights.take(part), axis=1) + 1e-9
                    seen = _sums(random, part) / (norms * norms)[:, None]
                    own = part.ravel().astype(np.int64)
                    for k, column in enumerate(np.ascontiguousarray(seen.T, np.float64)):
                        total[k] += np.bincount(own, np.repeat(column, window), TERMS + 1)
        if not total.any():
            return
        total *= weights
        group = TaskContext.get().partitionId() // FIT_GROUP
        for n, rows in enumerate(np.array_split(total.T[:TERMS], SLICES)):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([group], pa.int32()), pa.array([rows.astype(np.float32).tobytes()], pa.binary())], names=["slice", "part", "rows"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in table["rows"])
        return table.slice(0, 1).set_column(2, "rows", pa.array([total.astype(np.float32).tobytes()], pa.binary()))

    # tasks and groups are bounded, and with them what a group of slices gathers
    schema = "slice int, part int, rows binary"
    sums = texts.coalesce(FIT_TASKS).mapInArrow(add_up, schema).groupBy("slice", "part").applyInArrow(merge, schema)
    parts = sums.groupBy("slice").applyInArrow(merge, schema).collect()
    shared.destroy()
    if not parts:
        return np.zeros((TERMS + 1, rank), np.float32)
    total = np.concatenate([np.frombuffer(r["rows"], np.float32).reshape(-1, width) for r in sorted(parts, key=lambda r: r["slice"])]).astype(np.float64)
    left, values, _ = np.linalg.svd(total, full_matrices=False)
    vectors = left[:, :rank] / np.sqrt(values[:rank] + 1e-9 * (values[0] + 1e-9))
    return np.vstack([vectors * idf[:TERMS, None], np.zeros((1, rank))]).astype(np.float32)


def _sums(vectors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The sum of each row's term vectors."""
    out = vectors.take(terms[:, 0], 0)
    for k in range(1, terms.shape[1]):
        out += vectors.take(terms[:, k], 0)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)


def common_subsequence(pattern: dict, n: int, words: list) -> int:
    """Length of the longest common subsequence; pattern: for each of its words the bits of its places, or a list of them, n: its length."""
    full = (1 << n) - 1
    v = full
    for w in words:
        if m := pattern.get(w):
            u = v & (_mask(m) if isinstance(m, list) else m)
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def bits_of(words: list) -> dict:
    """For each word the bits of its places; with more than MASKED_WORDS words a list of the places, as masks would grow with their square."""
    out: dict = {}
    if len(words) > MASKED_WORDS:
        for k, w in enumerate(words):
            out.setdefault(w, []).append(k)
        return out
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _mask(places: list) -> int:
    """The bits of places in rising order."""
    out = bytearray(places[-1] // 8 + 1)
    for k in places:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


@dataclass
class Item:
    item_id: object
    words: list
    bits: dict
    places: dict
    answer: list
    answer_bits: dict


class Queries:
    """The benchmark in the latent space: unit vectors of its windows and, for each, the item; for each length below a window the vectors' numbers and a mask of the terms."""

    def __init__(self, rows: list[tuple], vectors: np.ndarray, window: int, step: int):
        texts = [t or "" for _, t, _ in rows]
        answers = [a if a is not None else re.split(r"(?<=[.!?])\s+", (t or "").strip())[-1] for _, t, a in rows]
        self.items: list[Item] = []
        vecs, owner, lengths = [], [], []
        masks: dict[int, np.ndarray] = {}
        self.has = np.zeros((len(rows), TERMS // 8 + 1), np.uint8)  # a bit for each term: 82 MB for BLOCK_ITEMS
        for (lo, _, words, first), (_, _, answer_words, answer_first) in zip(_words(pa.array(texts, pa.string())), _words_alike(answers, texts), strict=True):
            for k in range(len(first) - 1):
                own, ans = words[first[k] : first[k + 1]].tolist(), answer_words[answer_first[k] : answer_first[k + 1]].tolist()
                self.items.append(Item(rows[lo + k][0], own, bits_of(own), Counter(own), ans, bits_of(ans)))
                own_terms = _term(words[first[k] : first[k + 1]])
                np.bitwise_or.at(self.has[lo + k], own_terms >> 3, _bit(own_terms))
                if 0 < len(own) < window:
                    masks.setdefault(len(own), np.zeros(TERMS + 1, bool))[own_terms] = True
            place, doc = windows(first, window, step)
            if len(words):
                vecs.append(_unit(_sums(vectors, _terms_of(place, _term(words)))))
                owner.append(doc + lo)
                lengths.append(np.diff(first)[doc])
        self.vectors = np.concatenate(vecs) if vecs else np.zeros((0, vectors.shape[1]), np.float32)
        self.owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.short = {n: (np.flatnonzero(np.concatenate(lengths) == n), mask) for n, mask in masks.items()}


def _words_alike(answers: list[str], texts: list[str]) -> Iterator[tuple]:
    """The answers' words, in the chunks that the texts come in."""
    for lo, hi, _, _ in K.text_chunks(pa.array(texts, pa.string())):
        words, bounds = [], [0]
        for _, _, w, first in _words(pa.array(answers[lo:hi], pa.string())):
            words.append(w)
            bounds += (first[1:] + bounds[-1]).tolist()
        yield lo, hi, np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(bounds)


def item_blocks(rows: Iterable[tuple]) -> Iterator[list[tuple]]:
    """All rows (id, text, answer) in blocks of at most BLOCK_ITEMS items and BLOCK_WORDS words, or of one item; one empty block if there are none."""
    block, held, any_yet = [], 0, False
    for row in rows:
        n = sum(len(t.split()) for t in row[1:] if t is not None)
        if block and (len(block) == BLOCK_ITEMS or held + n > BLOCK_WORDS):
            yield block
            block, held, any_yet = [], 0, True
        block.append(tuple(row))
        held += n
    if block or not any_yet:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", answer_col: str | None = None, window: int = 16, rank: int = 64, fit_docs: int | None = None, min_cosine: float = 0.5, min_terms: float = 0.4, likely: float = 0.6, sure: float = 0.8) -> DataFrame:
    """doc_id, item_id, cosine (of the best candidate window), coverage (of the item's words, in order) and has_answer, for each document and each item that it leaks."""
    answer = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    items = benchmark.select(item_col, F.col(item_text_col).cast("string"), answer.alias("answer"))
    texts = docs.select(F.col(text_col))
    found, passages = passage_frequencies(texts, window)
    idf = np.append(np.log(max(passages, 1) / np.maximum(found, 1)) + 1e-3, 0).astype(np.float32)
    fitted = texts if fit_docs is None else _drawn(docs, id_col, text_col, fit_docs)
    vectors = latent_space(fitted.union(benchmark.select(F.col(item_text_col).cast("string"))), idf, window, rank)
    context = docs.sparkSession.sparkContext
    space = context.broadcast((vectors, idf))
    parts = []
    for block in item_blocks(items.toLocalIterator()):  # one block at a time is in the driver's and the executors' memory
        queries = context.broadcast(Queries(block, vectors, window, window // 2))
        hits = _search(docs.select(F.col(id_col).cast("long"), F.col(text_col)), space, queries, window, min_cosine, min_terms, likely, sure)
        parts.append(written(hits.join(F.broadcast(_names(benchmark, item_col, block)), "item").select("doc_id", "item_id", "cosine", "coverage", "has_answer")))
        queries.destroy()
    space.destroy()
    return reduce(DataFrame.union, parts)


def _drawn(docs: DataFrame, id_col: str, text_col: str, fit_docs: int) -> DataFrame:
    """About fit_docs texts, drawn by the hash of id and text."""
    rate = min(1.0, fit_docs / max(1, docs.count()))
    drawn = F.pmod(F.xxhash64(F.lit("fit"), id_col, text_col), F.lit(1 << 20)) < int(rate * (1 << 20))
    return docs.filter(drawn).select(id_col, text_col).distinct().select(text_col)


def _names(benchmark: DataFrame, item_col: str, block: list[tuple]) -> DataFrame:
    """The ids of a block's items, at most BLOCK_ITEMS rows."""
    return benchmark.sparkSession.createDataFrame([(k, x[0]) for k, x in enumerate(block)], f"item long, item_id {benchmark.schema[item_col].dataType.simpleString()}")


def _search(docs: DataFrame, space: Broadcast, block: Broadcast, window: int, min_cosine: float, min_terms: float, likely: float, sure: float) -> DataFrame:
    """The leaks of one block's items, by their numbers in it, among all of docs (id and text)."""
    schema = "doc_id long, item long, cosine double, coverage double, has_answer boolean"
    least = min(likely, sure)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (vectors, idf), q = space.value, block.value
        for b in batches:
            out: dict[tuple[int, int], tuple[float, float, bool]] = {}
            for lo, _, words, first in _words(b.column(1)):
                if not len(words):
                    continue
                terms = np.append(_term(words), TERMS)  # the last one is that of place -1
                for size, start, doc, targets, owner in _passes(q, terms, first, idf):
                    for rows in np.array_split(np.arange(len(start)), max(1, len(start) // 2000)):
                        place = start[rows][:, None] + np.arange(size)
                        mine = terms[np.where(place < first[1:][doc[rows]][:, None], place, -1)]
                        here = _unit(_sums(vectors, mine))
                        weight, byte, bit = idf[mine], mine >> 3, _bit(mine)
                        whole = weight.sum(1)
                        for begin in range(0, len(targets), QUERY_BLOCK):
                            cosine = here @ targets[begin : begin + QUERY_BLOCK].T
                            found = np.flatnonzero(cosine >= min_cosine)
                            for at in range(0, len(found), CANDIDATE_BLOCK):
                                p, k = np.divmod(found[at : at + CANDIDATE_BLOCK], cosine.shape[1])
                                item = owner[begin + k]
                                new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (item[1:] != item[:-1])))  # an item's windows stand side by side
                                near = np.maximum.reduceat(cosine[p, k], new)
                                p, item = p[new], item[new]
                                held = q.has.ravel().take(item[:, None] * q.has.shape[1] + byte.take(p, 0)) & bit.take(p, 0)
                                shared_weight = (weight.take(p, 0) * (held != 0)).sum(1)
                                for i in np.flatnonzero(shared_weight >= min_terms * whole[p]):
                                    d = int(doc[rows[p[i]]])
                                    _confirm(out, lo + d, int(item[i]), float(near[i]), q.items[item[i]], words, int(start[rows[p[i]]]), size, int(first[d]), int(first[d + 1]))
            hits = [(r, n, *v) for (r, n), v in out.items() if v[1] >= sure or v[1] >= likely and v[2]]
            if hits:
                r, n, cosine, coverage, has = zip(*hits, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array(n, pa.int64()), pa.array(cosine), pa.array(coverage), pa.array(has)], names=["doc_id", "item", "cosine", "coverage", "has_answer"])

    def _passes(q: Queries, terms: np.ndarray, first: np.ndarray, idf: np.ndarray) -> Iterator[tuple]:
        place, doc = windows(first, window, window // 2)
        yield window, place[:, 0], doc, q.vectors, q.owner
        for n, (rows, known) in q.short.items():
            yield n, *short_windows(first, terms[:-1], idf, known, n, min_terms), q.vectors[rows], q.owner[rows]

    def _confirm(out: dict, row: int, n: int, cosine: float, item: Item, words: np.ndarray, start: int, size: int, lo: int, hi: int) -> None:
        before = out.get((row, n), (0.0, 0.0, False))
        best = before[1:]
        if best != (1.0, True) and item.words:
            around = words[max(lo, start - len(item.words)) : min(hi, start + size + len(item.words))].tolist()
            # the item's places whose words are around bound the subsequence; below the lower bound it decides nothing
            if sum(map(item.places.__getitem__, item.places.keys() & around)) >= least * len(item.words) - 1e-6:
                coverage = common_subsequence(item.bits, len(item.words), around) / len(item.words)
                if coverage >= least:
                    best = max(best, (coverage, 2 * common_subsequence(item.answer_bits, len(item.answer), around) >= len(item.answer)))
        out[row, n] = (max(cosine, before[0]), *best)

    return docs.mapInArrow(search, schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that leak no item; rows with a null id stay."""
    gone = leaks(docs, benchmark, id_col=id_col, **how).filter("doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
