"""Files and intermediate tables in folders that the whole cluster shares."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

CLAIM_SECONDS = 600


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir.

    Where that setting is absent on a single machine (tests, a bench) a folder in the warehouse takes its place. On a cluster it is needed.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.work"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The rows of df, written once as Parquet to the shared folder and read again, so that a lost executor costs no recomputation and lineage ends here."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str) -> tuple:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsc.hadoopConfiguration()), own


def exists(spark: SparkSession, path: str) -> bool:
    files, own = _path(spark, path)
    return files.exists(own)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it doesn't exist."""
    files, own = _path(spark, path)
    return [f.getPath().getName() for f in files.listStatus(own)] if files.exists(own) else []


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    files, own = _path(spark, path)
    files.delete(own, True)


def remove(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing reads any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small text file unless there is one of that name already, and says whether it did. It is there as a whole or not at all.

    Writers claim the name first, as a rename alone would replace a file on some file systems. A claim of over CLAIM_SECONDS without a file is of one that died.
    """
    files, own = _path(spark, path)
    jvm = spark._jvm
    claim = jvm.org.apache.hadoop.fs.Path(f"{path}.claim")
    if not files.exists(own) and files.exists(claim) and time.time() - files.getFileStatus(claim).getModificationTime() / 1000 > CLAIM_SECONDS:
        files.delete(claim, False)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    out = files.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        taken = files.exists(own) or not files.createNewFile(claim)
        if not taken:
            taken = not files.rename(draft, own)
    finally:
        files.delete(draft, False)
    return not taken
