"""Many small files, written and copied by tasks.

Tasks open files with Arrow's file systems (local paths, hdfs, s3, gs), so that nothing passes the driver. A task that runs again writes the
same files again.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    return fs.FileSystem.from_uri(path)


def _stored(rows: DataFrame, path: str) -> int:
    """Writes each row (file, data) to a file below path, and says how many there were."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        made: set[str] = set()
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                target = f"{root.rstrip('/')}/{name}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                with files.open_output_stream(target) as out:
                    out.write(data.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return rows.mapInArrow(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_files(texts: DataFrame, path: str, suffix: str = "") -> int:
    """Writes each row's `text` to the file named `file` and suffix below path."""
    return _stored(texts.select(F.concat("file", F.lit(suffix)).alias("file"), F.encode("text", "utf-8").alias("data")), path)


def copy_files(pairs: DataFrame, source: str, path: str) -> int:
    """Copies each row's `source` (below the source folder) to `file` below path; a missing file is an error."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (have, start), (files, root) = opened(source), opened(path)
        made: set[str] = set()
        for b in batches:
            for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{new}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    files.create_dir(folder, recursive=True)
                    made.add(folder)
                fs.copy_files(f"{start.rstrip('/')}/{old}", target, source_filesystem=have, destination_filesystem=files)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return pairs.select("source", "file").mapInArrow(copy, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def link_files(pairs: DataFrame, source: str, path: str) -> int:
    """Makes a symbolic link at each row's `file` below path to its `source` below the source folder; both must be on a local or mounted file system that all tasks see."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (have, start), (files, root) = opened(source), opened(path)
        if not (isinstance(have, fs.LocalFileSystem) and isinstance(files, fs.LocalFileSystem)):
            raise ValueError("symbolic links need a local file system")
        for b in batches:
            for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                origin, target = f"{start.rstrip('/')}/{old}", f"{root.rstrip('/')}/{new}"
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.stat(origin)  # a missing file is an error
                if not (os.path.islink(target) and os.readlink(target) == origin):  # as a task that runs again finds it
                    os.symlink(origin, target)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    return pairs.select("source", "file").mapInArrow(link, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def png(height: int, width: int, data: bytes) -> bytes:
    """An 8-bit grey picture as a PNG file."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.zeros((height, width + 1), np.uint8)  # each row begins with its filter, none
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(height, width)
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def write_masks(masks: DataFrame, path: str) -> int:
    """Writes masks (imagefile, height, width, data) as PNG files below path, named after imagefile."""

    @F.pandas_udf("binary")
    def encoded(height: pd.Series, width: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([png(h, w, d) for h, w, d in zip(height, width, data, strict=True)])

    name = F.concat(F.regexp_replace("imagefile", r"\.[^./]*$", ""), F.lit(".png"))
    return _stored(masks.select(name.alias("file"), encoded("height", "width", "data").alias("data")), path)


def read_masks(spark: SparkSession, pattern: str, root: str = "") -> DataFrame:
    """imagefile (below root), height, width and data of grey pictures; of coloured ones the first channel. Files that can't be decoded are an error."""

    @F.pandas_udf("binary")
    def first(data: pd.Series, channels: pd.Series) -> pd.Series:
        return pd.Series([d if n == 1 else d[::n] for d, n in zip(data, channels, strict=True)])

    read = spark.read.format("image").option("dropInvalid", False).load(pattern).select("image.*")
    known = F.when(F.col("height") > 0, F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("can't be decoded: "), F.col("origin"))))
    name = F.substring_index(known, root.rstrip("/") + "/", -1) if root else known
    return read.select(name.alias("imagefile"), "height", "width", first("data", "nChannels").alias("data"))
