"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without ASCII white space at its ends, with A-Z lower-cased. Runs hold (line hash, documents, holder), bucketed by
hash and sorted within buckets, so that neither a join with runs nor a merge of runs shuffles their rows. Documents come in batches of falling
ids. Each batch is merge-joined with the runs: what they lack (the anti-join) is new and gets its holder, the largest id of the batch that
has it; the rest only adds to the counts. When a level has `fanout` runs they are merged into one run of the next level. Keys of at least
`min_chars` code points that at least `min_docs` documents have then lose all lines outside their holder.

Runs can be kept in a folder, which a later job opens to add its documents to: holders that runs have named stay, and the later documents
lose the lines that are common by then.

Defined cases: a null or empty text is one empty line. A null id counts as one document below all others. Rows that repeat an id count
as one document, and keep or lose lines alike; an id in two jobs counts in each. Further columns pass through, whatever their names are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children, delete, exists, shared_dir, written

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOWERED = str.maketrans(UPPER, LOWER)
_LEAST_ID = -(2**63)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def document_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row for each document and distinct hash of a key of min_chars code points or more: __doc, __line."""
    keys = F.filter(
        F.transform(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), line_key),
        lambda k: F.char_length(k) >= min_chars,
    )
    lines = F.explode(F.array_distinct(F.transform(keys, lambda k: F.unhex(F.md5(k)))))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("__doc"), lines.alias("__line"))


class LineRuns:
    """Levelled sorted runs of (__line, __docs, __holder) in a folder; only the run that saw a line first names its holder.

    All runs are partitions of one table that is bucketed and sorted by line. However many runs are read, they are one scan whose rows are
    dealt by line, so neither a join with them nor a merge of them shuffles their rows. Runs are never changed: a merge makes a new one.
    A numbered manifest says which runs count, and a run of an earlier manifest goes only after the next manifest is there.
    The table's entry in the session's catalogue lasts until close() or drop().
    """

    COLUMNS = "__line binary, __docs long, __holder long"

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = 3):
        """Opens the folder's runs if it has any; without a folder, runs last until drop()."""
        self.spark, self.fanout, self.levels, self.replaced = spark, fanout, [], []
        self.folder = folder.rstrip("/") if folder else shared_dir(spark)
        self.buckets, self.version = int(spark.conf.get("spark.sql.shuffle.partitions")), 0
        done = [int(n.removeprefix("manifest-")) for n in children(spark, self.folder) if n.startswith("manifest-") and exists(spark, f"{self.folder}/{n}/_SUCCESS")]
        self.table = f"line_runs_{uuid.uuid4().hex}"
        if done:
            self.version = max(done)
            rows = spark.read.schema("level int, run string, buckets int").json(f"{self.folder}/manifest-{self.version}").collect()
            self.levels = [[r.run for r in rows if r.level == k] for k in range(max((r.level for r in rows), default=-1) + 1)]
            self.buckets = rows[0].buckets if rows else self.buckets
        self.saved = {run for level in self.levels for run in level}
        spark.sql(f"CREATE TABLE {self.table} ({self.COLUMNS}, __run string) USING parquet PARTITIONED BY (__run) CLUSTERED BY (__line) SORTED BY (__line) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/runs'")
        if done:
            spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    @property
    def live(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def scan(self, runs: list[str]) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("__run").isin(runs)).drop("__run")

    def add(self, batch: DataFrame) -> None:
        """Takes (__line, __docs, __holder), one row for each line of a batch whose documents no earlier batch had."""
        if self.live:
            seen = self.scan(self.live).filter("__holder is not null").select("__line", F.lit(True).alias("__seen"))
            # the part without a partner is the anti-join: lines that are new with this batch
            batch = batch.join(seen.hint("merge"), "__line", "left").select("__line", "__docs", F.when(F.col("__seen").isNull(), F.col("__holder")).alias("__holder"))
        self._keep(0, batch)

    def _keep(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        name = uuid.uuid4().hex
        cut = (F.col(c).cast(t).alias(c) for c, t in (x.split(" ") for x in self.COLUMNS.split(", ")))
        run.select(*cut, F.lit(name).alias("__run")).write.insertInto(self.table)
        here = self.levels[level]
        here.append(name)
        if len(here) >= self.fanout:
            self.levels[level] = []
            self._keep(level + 1, self.merged(here))
            self.replaced += [run for run in here if run in self.saved]
            self._forget([run for run in here if run not in self.saved])

    def merged(self, runs: list[str]) -> DataFrame:
        """One row for each line of the runs."""
        return self.scan(runs).groupBy("__line").agg(F.sum("__docs").alias("__docs"), F.max("__holder").alias("__holder"))

    def totals(self) -> DataFrame:
        return self.merged(self.live)

    def save(self) -> None:
        """Notes in the folder which runs it holds, for a later job; then runs that have been merged go."""
        rows = [(k, run, self.buckets) for k, level in enumerate(self.levels) for run in level]
        manifest = self.spark.createDataFrame(rows, "level int, run string, buckets int").coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.folder}/manifest-{self.version + 1}")  # over what a job left that died here
        self._forget(self.replaced)
        if self.version:
            delete(self.spark, f"{self.folder}/manifest-{self.version}")
        self.version, self.saved, self.replaced = self.version + 1, set(self.live), []

    def _forget(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (__run = '{run}')")
            delete(self.spark, f"{self.folder}/runs/__run={run}")

    def close(self) -> None:
        """Forgets the table; the folder's files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def drop(self) -> None:
        self.close()
        delete(self.spark, self.folder)


def lost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 3, runs_dir: str | None = None) -> DataFrame:
    """For each document that loses lines: __doc and __lost, the hashes of their keys. runs_dir: a folder whose runs count, and get this job's lines too."""
    cuts = docs.agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 1000)).first()[0] or []
    batch_of = sum((F.when(F.col("__doc") < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    lines = written(document_lines(docs, id_col, text_col, min_chars).withColumn("__batch", batch_of), "__batch")
    runs = LineRuns(docs.sparkSession, runs_dir, fanout)
    try:
        for k in range(len(set(cuts)) + 1):
            own = lines.filter(F.col("__batch") == k)
            runs.add(own.groupBy("__line").agg(F.count_distinct("__doc").alias("__docs"), F.max("__doc").alias("__holder")))
        # as a table its size is known, so that Spark broadcasts it while it is small and else joins by sorting and splits hot lines
        common = written(runs.totals().filter(F.col("__docs") >= min_docs))
        if runs_dir:
            runs.save()
    finally:
        if runs_dir:
            runs.close()
        else:
            runs.drop()
    return lines.join(common, "__line").filter(F.col("__doc") != F.col("__holder")).groupBy("__doc").agg(F.collect_set("__line").alias("__lost"))


def kept_text(text: str | None, lost: set[bytes]) -> tuple[str, int, int]:
    """The text without its lost lines, the number of lines before and of those that went. A set is asked for each line: Spark's array functions would search the whole list for each."""
    lines = (text or "").split("\n")
    if not lost:
        return text or "", len(lines), 0
    kept = [x for x in lines if hashlib.md5(x.strip(SPACE).translate(_LOWERED).encode()).digest() not in lost]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def with_lost(docs: DataFrame, lost: DataFrame, id_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID))
    return docs.join(lost, key == lost["__doc"], "left").drop(lost["__doc"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """docs with the text that stays; all columns and rows remain. See lost_lines for the rule's parameters."""
    numbered = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # by place, so that no name can clash
    k, own_id = docs.columns.index(text_col), f"c{docs.columns.index(id_col)}"
    found = with_lost(numbered, lost_lines(numbered, own_id, f"c{k}", **rule), own_id)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [kept_text(t, set(x))[0] if x else t for t, x in zip(b.column(k).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array(texts, b.schema.field(k).type) if i == k else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return found.mapInArrow(clean, numbered.schema).toDF(*docs.columns)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **rule: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 (of the text that stays) for each row of docs."""
    found = with_lost(docs.select(id_col, text_col), lost_lines(docs, id_col, text_col, **rule), id_col)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [kept_text(t, set(x or ())) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0].encode()).hexdigest() for r in rows], pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return found.mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


SQL = r"""
with l as (
  select doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)
), common as (
  select key, max(doc_id) as holder from l where length(key) >= 40 group by key having count(distinct doc_id) >= 5
)
select doc_id, count(*) as n_lines, count(*) filter (holder > doc_id) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (holder is null or holder <= doc_id), '')) as kept_sha256
from l left join common using (key) group by doc_id
"""
