"""Best-fit packing of token sequences.

Texts are tokenised where they stand; only each piece's length matters for packing. Pieces of one length are interchangeable, so the
packing is found on the histogram of lengths, which has at most `capacity` entries however many documents there are: bins of one
pattern are made as often as the histogram allows. Each pattern is filled greedily (the longest length that fits, again and again); then
the smallest piece of the pattern gives way to two unpacked lengths that fill the room better, if there are such. Ranks within lengths
then say which piece goes to which bin; they come from counts for each input partition and length, so no length is gathered anywhere.

Documents longer than a bin are cut into pieces of `capacity` tokens, of which the first may be shorter.

Defined cases: a null or empty text is the end token alone. Null ids stay null, and repeated rows are packed each by itself. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..storage import written

#: Latin letters, general punctuation and signs, whose classes are the same in the regular expressions of both libraries.
_SAME_CLASSES = re.compile("[^\x00-ſ‐-‧‰-⁞€]")


def _public(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the byte-level BPE as the tokenizers library gives them, a special token's string in a text being that token.

    The rank table is the same vocabulary and several times as fast; texts with other characters than those above, or with a special
    token's string, go to the tokenizers library.
    """

    _made: Encoder | None = None

    def __init__(self) -> None:
        import public_tokenizers

        self.full = Tokenizer.from_file(_public("byte_bpe_50k.json"))
        added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join([*map(re.escape, added), _SAME_CLASSES.pattern]))
        with open(_public("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def shared(cls) -> Encoder:
        cls._made = cls._made or cls()
        return cls._made

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if self.special.search(text):
            return self.plain(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)


def best_two_fit(lengths: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how many bins of each; every length is used as often as it occurs."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        left[length] = n
    at, patterns = capacity, []

    def longest(room: int, free: np.ndarray) -> int:
        fits = np.flatnonzero(free[: room + 1])
        return int(fits[-1]) if len(fits) else 0

    while at > 0:
        if not left[at]:
            at -= 1
            continue
        free, chosen, room = left.copy(), [at], capacity - at
        free[at] -= 1
        while room and (x := longest(room, free)):
            chosen.append(x)
            free[x] -= 1
            room -= x
        if room and len(chosen) > 1:
            least = min(chosen)
            space = room + least
            have = np.flatnonzero(free[: space + 1])
            if len(have):
                other = np.searchsorted(have, space - have, "right") - 1
                partner = np.where(other >= 0, have[np.maximum(other, 0)], 0)
                alone = (partner == have) & (free[have] < 2)  # needs a second one of its own length
                partner = np.where(alone, np.where(other > 0, have[np.maximum(other - 1, 0)], 0), partner)
                both = np.where(partner > 0, have + partner, 0)
                best = int(np.argmax(both))
                if both[best] > least:
                    chosen.remove(least)
                    chosen += [int(have[best]), int(partner[best])]
        need = np.bincount(chosen, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        left[used] -= times * need[used]
        patterns.append((tuple(sorted(chosen, reverse=True)), times))
    return patterns


def _slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, columns of first rank, first sequence and offset, by rank."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    return {length: np.array(own, np.int64).T for length, own in slots.items()}


def pieces_of(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and which piece of its length it is within its partition (part, rank)."""
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, encode = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), Encoder.shared()
        for b in batches:
            rows: list[tuple] = []
            for k in range(b.num_rows):
                doc, ids = b.column(0)[k].as_py(), np.append(encode(b.column(1)[k].as_py() or ""), np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                for n, stop in enumerate(range(head, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if n else 0
                    length = stop - start
                    rows.append((doc, n, start, length, zlib.crc32(ids[start:stop].tobytes()), part, int(ranks[length])))
                    ranks[length] += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = written(pieces_of(docs, id_col, text_col, capacity, end_id))
    counts = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots = _slots(best_two_fit(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = pieces.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for own in np.unique(length):
                first, start, place_of = slots[int(own)]
                rows = np.flatnonzero(length == own)
                slot = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = start[slot] + rank[rows] - first[slot], place_of[slot]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(length.astype(np.int64)), b.column(4), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")).mapInArrow(place, schema)
