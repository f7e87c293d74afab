"""Resampling towards a target distribution with word tries that live within a partition.

A feature is a run of 1 to `longest` neighbouring words, joined by one space; its bucket is the crc32 of its UTF-8 bytes modulo `buckets`.
Each task puts its texts into a trie of words. A node stands for the run of words on its path: it holds how often the run came and the
crc32 of the run's bytes, which its children go on from, so that no feature is ever joined to a string. Buckets' totals of all tries are
summed. From the totals of documents and of target texts comes a gain for each bucket; a second pass walks each document along the paths
of a trie whose nodes have their bucket's gain attached when they are made. When a trie holds TRIE_BYTES its counts go into the task's
totals, or its gains are let go, and it begins anew: memory is bounded, and results don't change.

The weight is the floored mean of a document's gains, the score adds Gumbel noise drawn from the id; of the documents with at least
`min_words` words, those with the highest scores are drawn, a whole percentage of them. Ranks come from range partitions and a small table of offsets.

Defined cases: a null or empty text has no words, no features and weight 0. A null id draws its noise as the empty string and comes last
among equal scores. Rows that repeat an id each count, with the same noise; equal rows get neighbouring ranks. An empty table gives an
empty one; without target texts all target counts are 0. Further columns pass through weighted() and draw(), whatever their names are.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..storage import written

#: Memory of a trie, as estimated from its nodes and their words.
TRIE_BYTES = 64 << 20
_NODE_BYTES = 250
#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 20
#: Bytes as they stand in words: A-Z lower-cased; ASCII characters that aren't letters or digits part words; bytes of other code points stay.
_FOLDED = bytes(k + 32 if 65 <= k <= 90 else k if k >= 128 or 97 <= k <= 122 or 48 <= k <= 57 else 32 for k in range(256))


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about BLOCK_BYTES."""
    folded, at = text.translate(_FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + BLOCK_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


class WordTrie:
    """Nodes are [children, crc32, value]; value_of gives a new node's value from its crc32."""

    def __init__(self, longest: int, value_of: object):
        self.longest, self.value_of = longest, value_of
        self.clear()

    def clear(self) -> None:
        self.top: dict[bytes, list] = {}
        self.held = 0

    def _grow(self, at: list | None, word: bytes) -> list:
        crc = zlib.crc32(word) if at is None else zlib.crc32(word, zlib.crc32(b" ", at[1]))
        node = [{} if self.longest > 1 else None, crc, self.value_of(crc)]
        (self.top if at is None else at[0])[word] = node
        self.held += _NODE_BYTES + len(word)
        return node

    def runs(self, words: list[bytes], starts: int) -> Iterator[list]:
        """The nodes of all runs that begin at the first `starts` words."""
        top, grow, longest = self.top, self._grow, self.longest
        for k in range(starts):
            word = words[k]
            node = top.get(word) or grow(None, word)
            yield node
            for word in words[k + 1 : k + longest]:
                node = node[0].get(word) or grow(node, word)
                yield node

    def walk(self, text: bytes) -> Iterator[tuple[Iterator[list], int]]:
        """For each block of a text the nodes of the runs that begin there, and its number of words."""
        tail: list[bytes] = []
        for words in word_blocks(text):
            both = tail + words
            whole = max(0, len(both) - self.longest + 1)
            yield self.runs(both, whole), len(words)
            tail = both[whole:]
        yield self.runs(tail, len(tail)), 0

    def counts(self, buckets: int) -> np.ndarray:
        """The counts of all nodes by bucket."""
        at, n, levels = [], [], [self.top]
        while levels:
            for children, crc, count in levels.pop().values():
                at.append(crc % buckets)
                n.append(count)
                if children:
                    levels.append(children)
        return np.bincount(np.array(at, np.int64), np.array(n, np.float64), buckets).astype(np.int64)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_string()).cast(pa.large_binary()):
        yield x.as_py() or b""


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket and n: how many features of all texts fall into it; buckets without any are left out."""

    most = TRIE_BYTES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = WordTrie(longest, lambda crc: 0), np.zeros(buckets, np.int64)
        for b in batches:
            for text in _texts(b.column(0)):
                for nodes, _ in trie.walk(text):
                    for node in nodes:
                        node[2] += 1
                    if trie.held > most:
                        total += trie.counts(buckets)
                        trie.clear()
        total += trie.counts(buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])

    return texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of target to documents, smoothed by one, for each bucket: as many numbers as there are buckets."""
    sides = bucket_counts(docs, text_col, longest, buckets).withColumn("t", F.lit(0)).union(bucket_counts(target, target_col, longest, buckets).withColumn("t", F.lit(1)))
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for bucket, n, of_target in sides.collect():  # two rows for each bucket at most
        (t if of_target else s)[bucket] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(y) + 1) * all_s / ((float(x) + 1) * all_t))) for x, y in zip(s, t, strict=True)], np.int64)


ADDED = ("__words", "__features", "__weight")


def weighted(docs: DataFrame, gains: np.ndarray, text_col: str = "text", longest: int = 1) -> DataFrame:
    """docs with their numbers of words and features and their weight, in last place: __words, __features, __weight."""
    k, places = docs.columns.index(text_col), [f"c{n}" for n in range(len(docs.columns))]
    numbered, most = docs.toDF(*places), TRIE_BYTES  # by place, so that no name can clash

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, buckets = gains.tolist(), len(gains)
        trie = WordTrie(longest, lambda crc: gain[crc % buckets])
        for b in batches:
            rows = []
            for text in _texts(b.column(k)):
                words = features = total = 0
                for nodes, n in trie.walk(text):
                    words += n
                    got = [node[2] for node in nodes]
                    features += len(got)
                    total += sum(got)
                    if trie.held > most:
                        trie.clear()
                rows.append((words, features, total // features if features else 0))
            more = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*places, *ADDED])

    out = numbered.mapInArrow(weigh, StructType([*numbered.schema.fields, *(StructField(c, LongType()) for c in ADDED)]))
    return out.toDF(*docs.columns, *ADDED)


def noisy(weight: Column, own_id: Column, seed: str) -> Column:
    """The weight with Gumbel noise, in thousandths, drawn from seed and id."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(own_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranks(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with their place from 1 in the given order as `rank`: sorted range partitions and the counts of those before. No task sees all rows."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = written(placed)  # a part that is made again could be cut elsewhere
    sizes, before = dict(placed.groupBy("__part").count().collect()), 0  # a row for each partition
    offsets = []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    firsts = rows.sparkSession.createDataFrame(offsets, "__part int, __before long")
    return placed.join(F.broadcast(firsts), "__part").withColumn("rank", F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")


def scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: str = "2024", min_words: int = 20, percent: int = 10) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where a document isn't drawn."""
    gains = bucket_gains(docs, target, text_col, target_col, longest, buckets)
    found = weighted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), gains, "text", longest)
    found = written(found.select("doc_id", "__words", F.col("__features").alias("n_features"), F.col("__weight").alias("weight"), noisy(F.col("__weight"), F.col("doc_id"), seed).alias("score")))
    enough = found.filter(F.col("__words") >= min_words)
    most = percent * enough.count() // 100
    placed = ranks(enough, F.col("score").desc(), F.col("doc_id").asc_nulls_last()).withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    return placed.unionByName(found.filter(F.col("__words") < min_words).withColumn("rank", F.lit(None).cast("long"))).drop("__words")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = 1, buckets: int = 10_000, seed: str = "2024", min_words: int = 20, percent: int = 10) -> DataFrame:
    """The drawn rows of docs, with all their columns and the score as `__score`. Rows that tie with the last one in score and id are all drawn."""
    gains = bucket_gains(docs, target, text_col, target_col, longest, buckets)
    places = [f"c{n}" for n in range(len(docs.columns))]
    own_id, own_text = (places[docs.columns.index(c)] for c in (id_col, text_col))
    found = weighted(docs.toDF(*places), gains, own_text, longest).filter(F.col("__words") >= min_words).withColumn("__score", noisy(F.col("__weight"), F.col(own_id), seed))
    keys = written(found.select("__score", F.col(own_id).alias("__id")))
    most = percent * keys.count() // 100
    last = ranks(keys, F.col("__score").desc(), F.col("__id").asc_nulls_last()).filter(F.col("rank") == most).first()
    if last is None:
        return docs.withColumn("__score", F.lit(None).cast("long")).limit(0)
    above = F.col("__score") > last["__score"]
    level = F.col("__score") == last["__score"]
    if last["__id"] is not None:
        level &= F.col(own_id) <= last["__id"]
    return found.filter(above | level).drop(*ADDED).toDF(*docs.columns, "__score")


#: crc32 is not a function of DuckDB: its table comes from the polynomial, and words are taken byte by byte. Lower-casing is of A-Z alone.
CRC_SQL = r"""
crc_table as (
  select list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i::bigint)) as t
), crcs as (
  select w, xor(list_reduce(list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::int, 2))::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint), 4294967295) as crc
  from crc_words, crc_table
)
"""
SQL = (
    r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents
), target as (
  select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from benchmark
), features as (select doc_id, unnest(ws) as w from words), crc_words as (select w from features union select w from target),
"""
    + CRC_SQL
    + r""", s as (select crc % 10000 as bucket, count(*) as s from features join crcs using (w) group by all),
t as (select crc % 10000 as bucket, count(*) as t from target join crcs using (w) group by all),
gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0)::double + 1) * ((select count(*) from features)::double + 10000) / ((coalesce(s, 0)::double + 1) * ((select count(*) from target)::double + 10000))))::bigint as gain
  from s full join t using (bucket)
), sums as (
  select doc_id, count(*) as n, sum(gain)::bigint as total from features join crcs using (w) join gains on bucket = crc % 10000 group by doc_id
), weights as (
  select doc_id, coalesce(n, 0) as n_features, coalesce((total - ((total % n) + n) % n) // n, 0)::bigint as weight, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
  from documents left join sums using (doc_id)
), scored as (
  select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score from weights
), placed as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from placed) then rank end as rank
from scored left join placed using (doc_id)
"""
)
