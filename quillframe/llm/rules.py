"""Quality rules: decision lists learned by sequential covering on text statistics.

Statistics come from one pass over whole texts. On a bounded sample of labelled rows (`fit_rows` at most) rules that find low quality are
learned one after the other: a rule grows threshold by threshold while that adds the most information on the growing part, loses its last
thresholds while that does not hurt on the pruning part, and stays if it is precise there; the rows that it covers go. The list becomes an
ordered Spark conditional expression over ratios of the statistics.

Before the list come the fixed base rules: fewer than 50 words, or more than half of all words in repeated 3-word windows.

Defined cases: a null text has no words. Rows may repeat, each is judged by itself. Without labels there are no learned rules. Words end at
ASCII white space, lines at \\n; lines without a word never count as copies. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from . import kernels as K

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_same")
#: Ratios that rules test, as SQL over the statistics.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "same": "n_same / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_words, 1)",
}


def _seen_before(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where an equal hash stands earlier in the same group; groups are rising."""
    order = np.lexsort((hashes, groups))
    again = np.zeros(len(order), bool)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (groups[order[1:]] == groups[order[:-1]])
    return again


def _shared(groups: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where an equal hash stands elsewhere in the same group."""
    order = np.lexsort((hashes, groups))
    equal = (hashes[order[1:]] == hashes[order[:-1]]) & (groups[order[1:]] == groups[order[:-1]])
    shared = np.zeros(len(order), bool)
    shared[order[1:]] |= equal
    shared[order[:-1]] |= equal
    return shared


def chunk_stats(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of STATS for each document of a chunk."""
    n = len(at) - 1
    out = np.zeros((n, len(STATS)), np.int64)
    if not len(raw):
        return out
    starts, ends, first = K.word_spans(raw, at)
    out[:, 0] = np.diff(first)
    out[:, 1] = K.segment_sums(K.code_points(raw) & ~K.IS_SPACE[raw], at)
    out[:, 2] = K.segment_sums(_SYMBOL[raw], at)
    out[:, 5] = K.segment_sums((raw >= 65) & (raw <= 90), at)
    words = K.span_hashes(raw, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    out[:, 6] = K.segment_sums(same, first)
    if len(words) >= 3:
        grams = K.ngram_hashes(words, 3)
        inside = doc[2:] == doc[:-2]
        hit = np.zeros(len(words) - 2, bool)
        hit[inside] = _shared(doc[:-2][inside], grams[inside])
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : len(words) - 2 + k] |= hit
        out[:, 4] = K.segment_sums(covered, first)
    cut = raw == 10
    line_starts = np.unique(np.concatenate([at[:-1][np.diff(at) > 0], np.flatnonzero(cut) + 1]))
    line_starts = line_starts[line_starts < len(raw)]
    breaks = np.append(np.flatnonzero(cut), len(raw))
    line_ends = np.minimum(breaks[np.searchsorted(breaks, line_starts)], at[np.searchsorted(at, line_starts, "right")])
    has_word = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(at, line_starts, "right") - 1
    again = _seen_before(line_doc, K.span_hashes(raw, line_starts, line_ends))
    np.add.at(out[:, 3], line_doc[again], 1)
    return out


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, at in K.text_chunks(b.column(1)):
                stats = chunk_stats(raw, at)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(np.ascontiguousarray(c)) for c in stats.T)], names=["doc_id", *STATS])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} long" for s in STATS))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    value: float

    def holds(self, table: dict[str, np.ndarray]) -> np.ndarray:
        return table[self.feature] >= self.value if self.above else table[self.feature] <= self.value

    def column(self) -> Column:
        ratio = F.expr(FEATURES[self.feature])
        return ratio >= self.value if self.above else ratio <= self.value


def _covers(rule: list[Test], table: dict[str, np.ndarray]) -> np.ndarray:
    out = np.ones(len(next(iter(table.values()))), bool)
    for test in rule:
        out &= test.holds(table)
    return out


def _grow(table: dict[str, np.ndarray], bad: np.ndarray) -> list[Test]:
    """Adds the test with the largest information gain until no good row is covered or nothing gains."""
    rule, inside = [], np.ones(len(bad), bool)
    while (~bad & inside).any():
        p, n = (bad & inside).sum(), (~bad & inside).sum()
        best: tuple[float, Test | None] = (1e-9, None)
        for feature, values in table.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            border = np.flatnonzero(v[1:] != v[:-1])  # between border and border + 1
            left_p, left_n = np.cumsum(b)[border], np.cumsum(~b)[border]
            for above, pp, nn in ((False, left_p, left_n), (True, p - left_p, n - left_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - np.log2(p / (p + n))), 0)
                if len(gain) and gain.max() > best[0]:
                    k = border[int(np.argmax(gain))]
                    best = (gain.max(), Test(feature, above, float((v[k] + v[k + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(table)
    return rule


def learn(table: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95) -> list[list[Test]]:
    """Rules in order; a row that one of them covers is of low quality. Every third row is for pruning; a rule that is not precise there is grown anew with other thirds before covering ends. Each rule covers rows that no other does, so it ends."""
    rules: list[list[Test]] = []
    left, third = np.ones(len(bad), bool), np.arange(len(bad)) % 3
    part = lambda rows: {k: v[rows] for k, v in table.items()}

    def worth(rule: list[Test], rows: np.ndarray) -> float:
        hit = _covers(rule, part(rows))
        p, n = (hit & bad[rows]).sum(), (hit & ~bad[rows]).sum()
        return (p - n) / (p + n) if p + n else -1.0

    def grown() -> list[Test] | None:
        for fold in range(3):
            grows, prunes = left & (third != fold), left & (third == fold)
            if not (bad & grows).any():
                continue
            rule = _grow(part(grows), bad[grows])
            while len(rule) > 1 and worth(rule[:-1], prunes) >= worth(rule, prunes):
                rule = rule[:-1]
            if rule and worth(rule, prunes) >= 2 * precision - 1:
                return rule
        return None

    while rule := grown():
        rules.append(rule)
        left &= ~_covers(rule, table)
    return rules


def expression(rules: list[list[Test]]) -> Column:
    """The number (from 1) of the first rule that covers a row, 0 if none does."""
    out = None
    for n, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test = test & t.column()
        out = F.when(test, n) if out is None else out.when(test, n)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, **columns: str) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (the learned rule that covers the row, or 0) and kept, for each row of docs."""
    stats = written(statistics(docs, **columns))
    turn = F.xxhash64(F.lit("fit"), "doc_id")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(turn).limit(fit_rows)
    sample = stats.join(F.broadcast(marks), "doc_id").select("doc_id", "quality", *(F.expr(e).cast("double").alias(f) for f, e in FEATURES.items()))
    rows = sample.orderBy(turn, *FEATURES).limit(fit_rows).toArrow()
    table = {f: rows[f].to_numpy() for f in FEATURES}
    rule = expression(learn(table, rows["quality"].to_numpy() == 0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", *STATS[:5], failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))
