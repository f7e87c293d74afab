"""Pictures of any size and 1 to 4 channels as PNG files, written strip by strip; pictures read through Spark's image source.

Strips are filtered and deflated by tasks of their own, each to whole bytes that need nothing of other strips. A task that writes a file
strings its strips together in order and keeps one of them at a time; the checksum of the whole comes from those of the strips.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import opened

#: PNG's colour type for each number of channels.
COLOUR_TYPE = {1: 0, 2: 4, 3: 2, 4: 6}
ADLER = 65521


def adler_of_both(first: int, second: int, length: int) -> int:
    """The Adler-32 of two byte strings put together; length is that of the second."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (a1 + a2 - 1) % ADLER | (b1 + b2 + length * (a1 - 1)) % ADLER << 16


def filtered(rows: np.ndarray, alone: bool) -> bytes:
    """Rows (n x width x channels) each behind the number of its filter, the one with the smallest sum of differences. alone: the row before the first is another strip's, so that row takes a filter without it."""
    n, width, channels = rows.shape
    line = rows.reshape(n, -1)
    left = np.zeros_like(line)
    left[:, channels:] = line[:, :-channels]
    up = np.zeros_like(line)
    up[1:] = line[:-1]
    corner = np.zeros_like(line)
    corner[1:, channels:] = line[:-1, :-channels]
    a, b, c = (x.astype(np.int16) for x in (left, up, corner))
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((pa_ <= pb) & (pa_ <= pc), left, np.where(pb <= pc, up, corner))
    ways = np.stack([line, line - left, line - up, line - ((a + b) // 2).astype(np.uint8), line - paeth])
    cost = np.abs(ways.view(np.int8).astype(np.int16)).sum(2, dtype=np.int64)
    if alone:
        cost[2:, 0] = np.iinfo(np.int64).max
    best = cost.argmin(0)
    out = np.empty((n, width * channels + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = ways[best, np.arange(n)]
    return out.tobytes()


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write_pngs(strips: DataFrame, path: str, suffix: str = "", level: int = 6) -> int:
    """Writes pictures (strips as operators.raster gives them) to files below path, named after the picture without its ending and with `suffix` or .png; says how many."""

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name, strip, height, width, rows = (b.column(n)[k].as_py() for n in range(5))
                pixels = np.frombuffer(b.column(5)[k].as_buffer(), np.uint8).reshape(rows, width, -1)
                raw = filtered(pixels, strip > 0)
                zipper = zlib.compressobj(level, zlib.DEFLATED, -15)
                data = zipper.compress(raw) + zipper.flush(zlib.Z_FULL_FLUSH)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((name, pa.string()), (strip, pa.int32()), (height, pa.int32()), (width, pa.int32()), (pixels.shape[2], pa.int32()), (zlib.adler32(raw), pa.int64()), (len(raw), pa.int64()), (data, pa.binary()))],
                    names=["picture", "strip", "height", "width", "channels", "adler", "length", "data"],
                )

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        made: set[str] = set()
        now = out = None
        adler = n = 0

        def finish() -> None:
            out.write(_chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", adler)) + _chunk(b"IEND", b""))
            out.close()

        for b in batches:
            for k in range(b.num_rows):
                name, _, height, width, channels, part, length = (b.column(c)[k].as_py() for c in range(7))
                head = b""
                if name != now:
                    if out:
                        finish()
                    stem = name.rsplit("/", 1)[-1]
                    target = f"{root.rstrip('/')}/{name[: len(name) - len(stem)]}{stem.rsplit('.', 1)[0] or stem}{suffix or '.png'}"
                    folder = target.rsplit("/", 1)[0]
                    if folder not in made:
                        files.create_dir(folder, recursive=True)
                        made.add(folder)
                    now, adler, out, head = name, 1, files.open_output_stream(target, compression=None), b"\x78\x9c"
                    n += 1
                    out.write(b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPE[channels], 0, 0, 0)))
                adler = adler_of_both(adler, part, length)
                out.write(_chunk(b"IDAT", head + b.column(7)[k].as_py()))
        if out:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    zipped = strips.select("picture", "strip", "height", "width", "rows", "data").mapInArrow(deflate, "picture string, strip int, height int, width int, channels int, adler long, length long, data binary")
    return zipped.repartition("picture").sortWithinPartitions("picture", "strip").mapInArrow(store, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_pictures(spark: SparkSession, pattern: str, root: str = "") -> DataFrame:
    """imagefile (below root), height, width and data (grey, RGB or RGBA) of the pictures that match; files that can't be decoded are an error."""

    @F.pandas_udf("binary")
    def turned(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(d: bytes, n: int) -> bytes:
            if n < 3:
                return bytes(d)
            p = np.frombuffer(d, np.uint8).reshape(-1, n)
            return p[:, [2, 1, 0, 3][:n]].tobytes()  # the source has blue first

        return pd.Series([one(d, n) for d, n in zip(data, channels, strict=True)])

    read = spark.read.format("image").option("dropInvalid", False).load(pattern).select("image.*")
    known = F.when(F.col("height") > 0, F.col("origin")).otherwise(F.raise_error(F.concat(F.lit("can't be decoded: "), F.col("origin"))))
    name = F.substring_index(known, root.rstrip("/") + "/", -1) if root else known
    return read.select(name.alias("imagefile"), "height", "width", turned("data", "nChannels").alias("data"))
