"""WARC archives as a Python data source of Spark, read and written by tasks.

`register(spark)` makes the format known as `warc`; records() reads with predicates pushed down.

Reading. Files below the path are dealt to partitions of about `partition_bytes` each (option, 64 MB). A task parses a record's header first. Predicates on
SCHEMA's header columns (record_type, record_id, target_uri, date, content_type, payload_digest, refers_to, content_length) are pushed
down to it by records(), or with the option `pushdown`: equality, in-lists, comparisons, null tests, string starts, ends and parts, and their
negations. (Spark keeps a source's last pushed filters for later queries on the same DataFrame that push none. So a plain load doesn't push, and
records() has a predicate of its own that is always pushed.) A record that predicates refuse is passed over: in plain files the task seeks past its block, in files that this module wrote with gzip past its compressed member, whose length stands in
an extra field of the member's head; other gzip files have to be inflated, but nothing of the block is kept. A read schema without
`payload` and `payload_length` passes over every block. Columns may be any subset of SCHEMA, in any order.

Writing takes any of SCHEMA's columns by name (record_type, record_id and payload for a start). Each task writes files of about
`file_bytes` (option, 256 MB) to a hidden folder, and the commit moves them into place, so that of a task that ran twice only one counts. Options:
`compression` (gzip, one member for each record, or none), `level` (3), `date` for rows without one. response and revisit records hold an HTTP
head, which says how long the full payload is; a revisit holds no payload.

archive() writes tables of pages with revisits: of records with equal payloads of at least `min_bytes` bytes the one with the smallest id is
the response, the others refer to it; smaller ones are all responses.

Defined cases: a null payload is empty; a null URL has no header; control characters and blanks of a URL are percent-encoded. A null id
has no number in its record id, and such rows revisit the smallest id if there is one, else all are responses, as are rows that repeat
the smallest id. An empty table gives an archive without records. Extra columns are passed over. A file that breaks off, or that isn't WARC, is an error that names it.
"""

from __future__ import annotations

import datetime
import gzip
import io
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..storage import shared_dir

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, headers map<string,string>, payload_length long, payload binary"
#: Columns that are one header's value.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_length": "content-length"}
WRITTEN_AS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPES = ("response", "revisit", "request")
#: The gzip extra field's two letters for a member's length, and the length of a gzip head with that field.
_LENGTH_FIELD, _HEAD = b"SL", 24
#: Bytes of a member that are read before it is known whether its record is wanted.
PEEK_BYTES = 1 << 14
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000

Record = dict[str, object]


# ---- headers and predicates


def parse_header(source: io.BufferedIOBase, where: str) -> dict[str, str] | None:
    """The next record's headers, names in lower case; None at the end. Lines that go on an earlier header are joined with it."""
    line = source.readline()
    while line in (b"\r\n", b"\n"):
        line = source.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"{where}: no WARC record begins with {line[:40]!r}")
    found: dict[str, str] = {}
    name = ""
    while (line := source.readline()) not in (b"\r\n", b"\n"):
        if not line:
            raise ValueError(f"{where}: a header breaks off")
        text = line.decode("utf-8", "replace").strip("\r\n")
        if text[:1] in (" ", "\t") and name:
            found[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        found[name] = value.strip()
    if not found.get("content-length", "").isdigit():
        raise ValueError(f"{where}: a record has no Content-Length")
    return found


def column_value(headers: dict[str, str], column: str) -> object:
    value = headers.get(HEADER_OF[column])
    return int(value) if column == "content_length" and value is not None else value


_TESTS: dict[type, Callable[[object, object], bool]] = {
    D.EqualTo: lambda a, b: a == b, D.GreaterThan: lambda a, b: a > b, D.GreaterThanOrEqual: lambda a, b: a >= b, D.LessThan: lambda a, b: a < b, D.LessThanOrEqual: lambda a, b: a <= b,
    D.In: lambda a, b: a in b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a,
}


def predicate(found: D.Filter) -> Callable[[dict[str, str]], bool | None] | None:
    """A test of headers that is true, false or unknown (None), as in SQL; None for a filter that headers can't decide."""
    if isinstance(found, D.Not):
        inner = predicate(found.child)
        return inner and (lambda h: None if (x := inner(h)) is None else not x)
    column = found.attribute[0] if len(getattr(found, "attribute", ())) == 1 else None
    if column not in HEADER_OF:
        return None
    if isinstance(found, D.IsNull):
        return lambda h: column_value(h, column) is None
    if isinstance(found, D.IsNotNull):
        return lambda h: column_value(h, column) is not None
    if isinstance(found, D.EqualNullSafe):
        return lambda h: column_value(h, column) == found.value
    test = _TESTS.get(type(found))
    if test is None or found.value is None:
        return None
    return lambda h: None if (x := column_value(h, column)) is None else test(x, found.value)


# ---- reading


class _Skipping:
    """What a task knows of the records it wants: which headers, and how much of a block."""

    def __init__(self, columns: Sequence[str], tests: Sequence[Callable]):
        self.columns, self.tests = columns, tests
        self.payload, self.blocks = "payload" in columns, "payload" in columns or "payload_length" in columns

    def wants(self, headers: dict[str, str]) -> bool:
        return all(t(headers) for t in self.tests)

    def row(self, headers: dict[str, str], block: bytes | None) -> Record:
        out: Record = {c: column_value(headers, c) for c in self.columns if c in HEADER_OF}
        if "headers" in self.columns:
            out["headers"] = list(headers.items())
        if block is not None:
            payload, length = block, len(block)
            if headers.get("warc-type") in HTTP_TYPES and block.startswith(b"HTTP/"):
                head, _, payload = block.partition(b"\r\n\r\n")
                said = [line.partition(b":")[2].strip() for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
                length = int(said[0]) if said and said[0].isdigit() else len(payload)
            out |= {"payload": payload, "payload_length": length}
        return out


def _sequential(source: io.BufferedIOBase, own: _Skipping, where: str) -> Iterator[Record]:
    """Records of a plain stream; blocks that aren't wanted are passed over by a seek."""
    while (headers := parse_header(source, where)) is not None:
        size = int(headers["content-length"])
        if own.wants(headers):
            block = None
            if own.blocks:
                block = source.read(size)
                if len(block) < size:
                    raise ValueError(f"{where}: a block breaks off")
            else:
                source.seek(size, io.SEEK_CUR)
            yield own.row(headers, block)
        else:
            source.seek(size, io.SEEK_CUR)


def _member_length(head: bytes) -> int:
    """The length of a gzip member that says so in its extra field, else 0."""
    if len(head) < _HEAD or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:14] != _LENGTH_FIELD:
        return 0
    return struct.unpack("<Q", head[16:24])[0]


def _members(file: pa.NativeFile, size: int, own: _Skipping, where: str) -> Iterator[Record]:
    """Records of a gzip file: member by member where their lengths are known, the rest as one stream."""
    at = 0
    while at < size:
        file.seek(at)
        start = file.read(PEEK_BYTES)
        length = _member_length(start)
        if not length:
            file.seek(at)
            with gzip.GzipFile(fileobj=file) as rest:
                yield from _sequential(rest, own, where)
            return
        if at + length > size:
            raise ValueError(f"{where}: a member breaks off")
        inflater = zlib.decompressobj(31)
        seen = inflater.decompress(start[:length], PEEK_BYTES)
        whole = b"\r\n\r\n" in seen
        headers = parse_header(io.BytesIO(seen), where) if whole else None
        if not whole or own.wants(headers) and own.blocks:
            more = file.read(length - len(start)) if length > len(start) else b""
            data = seen + inflater.decompress(inflater.unconsumed_tail + more) + inflater.flush()
            if not inflater.eof:
                raise ValueError(f"{where}: a member breaks off")
            yield from _sequential(io.BytesIO(data), own, where)
        elif own.wants(headers):
            yield own.row(headers, None)
        at += length


class FileGroup(D.InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.fields, self.path = schema, options["path"]
        self.bytes = int(options.get("partition_bytes", 64 << 20))
        self.filters: list[D.Filter] = []

    def partitions(self) -> list[FileGroup]:
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        below = lambda p: p[len(root) :].split("/") if p != root else [""]
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(x.startswith(("_", ".")) for x in below(f.path)))
        groups: list[list[tuple[str, int]]] = [[]]
        for f in found:
            if groups[-1] and sum(n for _, n in groups[-1]) + f[1] > self.bytes:
                groups.append([])
            groups[-1].append(f)
        return [FileGroup(g) for g in groups]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        columns = self.fields.names
        own, arrow = _Skipping(columns, [predicate(f) for f in self.filters]), to_arrow_schema(self.fields)
        files, rows, held = fs.FileSystem.from_uri(self.path)[0], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)

        for name, size in partition.files:
            with files.open_input_file(name) as file:
                for row in _members(file, size, own, name) if name.endswith(".gz") else _sequential(io.BufferedReader(file, 1 << 20), own, name):
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 500
                    if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class PushingReader(WarcReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if predicate(f) is None:
                yield f
            else:
                self.filters.append(f)


def records(spark: SparkSession, path: str, *columns: str, **options: object) -> DataFrame:
    """The given columns (all by default) of the records below path. Filters on header columns are pushed down."""
    register(spark)
    kinds = dict(x.split(" ") for x in SCHEMA.split(", "))
    columns = columns or tuple(kinds)
    read = spark.read.format("warc").schema(", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys((*columns, "content_length")))).option("pushdown", "true")
    return read.options(**options).load(path).filter("content_length is not null").select(*columns)


# ---- writing


def _clean(value: str) -> str:
    """A header's value on one line, without blanks at its ends: control characters and blanks as percent signs and their code."""
    if value.isprintable() and " " not in value:
        return value
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in value)


def record(row: Record, date: str) -> bytes:
    """A record's bytes from its columns."""
    kind, payload = row.get("record_type") or "resource", row.get("payload") or b""
    lines = {WRITTEN_AS[c]: _clean(str(row[c])) for c in WRITTEN_AS if row.get(c) is not None} | {"WARC-Type": kind}
    lines.setdefault("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>")
    lines.setdefault("WARC-Date", date)
    block = payload
    if kind in ("response", "revisit"):
        length = row["payload_length"] if row.get("payload_length") is not None else len(payload)
        block = b"HTTP/1.1 200 OK\r\nContent-Type: %s\r\nContent-Length: %d\r\n\r\n" % (_clean(row.get("content_type") or "text/html;charset=utf-8").encode(), length)
        block += payload if kind == "response" else b""
        lines["Content-Type"] = f"application/http;msgtype={'response' if kind == 'response' else 'response-head'}"
    elif row.get("content_type"):
        lines["Content-Type"] = _clean(row["content_type"])
    if kind == "revisit":
        lines["WARC-Profile"] = REVISIT_PROFILE
    lines |= {k: _clean(v) for k, v in (row.get("headers") or ()) if k.lower() not in {x.lower() for x in lines} and k.lower() != "content-length"}
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items())
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that says in an extra field how long it is as a whole."""
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(data) + deflater.flush()
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHQ", 12, _LENGTH_FIELD, 8, _HEAD + len(body) + len(tail)) + body + tail


class Written(D.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(D.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.zip, self.level = options.get("compression", "gzip") == "gzip", int(options.get("level", 3))
        self.most, self.job = int(options.get("file_bytes", 256 << 20)), uuid.uuid4().hex
        self.date = options.get("date") or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def _place(self) -> tuple[fs.FileSystem, str, str]:
        files, root = fs.FileSystem.from_uri(self.path)
        return files, root.rstrip("/"), f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, hidden = self._place()
        files.create_dir(hidden, recursive=True)
        task, names, out, size = TaskContext.get(), [], None, 0
        try:
            for b in iterator:
                for row in b.to_pylist():
                    if out is None or size >= self.most:
                        if out:
                            out.close()
                        names.append(f"part-{task.partitionId():05}-{len(names):03}-{uuid.uuid4().hex}.warc{'.gz' if self.zip else ''}")
                        out, size = files.open_output_stream(f"{hidden}/{names[-1]}", compression=None), 0
                    data = record(row, self.date)
                    data = member(data, self.level) if self.zip else data
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root, hidden = self._place()
        files.create_dir(root, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File] if self.overwrite else []
        for m in messages:
            for name in m.names if m else ():
                files.move(f"{hidden}/{name}", f"{root}/{name}")
        for path in old:
            files.delete_file(path)
        self._sweep(files, hidden)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, hidden = self._place()
        self._sweep(files, hidden)

    def _sweep(self, files: fs.FileSystem, hidden: str) -> None:
        """What stays in the hidden folder is of tasks that ran twice or failed."""
        if files.get_file_info(hidden).type == fs.FileType.Directory:
            files.delete_dir(hidden)


class WarcSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return (PushingReader if self.options.get("pushdown") == "true" else WarcReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format `warc` known to the session, and lets Spark push filters down to Python data sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# ---- archives of pages


def archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 100, **options: str) -> None:
    """Writes pages to WARC files below path, with revisits instead of repeated payloads."""
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8").alias("payload"))
    known = rows.select("id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= min_bytes)
    first = known.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1 and first is not null").select("digest", "first")
    found = rows.withColumn("digest", F.sha2("payload", 256)).join(first, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    records = found.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("id").alias("record_id"), F.col("url").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, name("first")).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_length"), F.when(~again, F.col("payload")).alias("payload"),
    )
    records.write.format("warc").options(**options).mode("append").save(path)


def digests(pages: DataFrame, path: str | None = None, **rule: object) -> DataFrame:
    """Writes an archive of pages and reads it back: page_id, payload_bytes, payload_digest, record_type and refers_to for each record. Responses' bytes are counted and hashed anew, revisits' come from their headers."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    archive(pages, path, **rule)
    read = records(pages.sparkSession, path, "record_type", "record_id", "payload_digest", "refers_to", "payload_length", "payload")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    full = F.col("record_type") == "response"
    return read.select(
        number("record_id").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha256(payload) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id > first then 'revisit' else 'response' end as record_type, case when page_id > first then first end as refers_to
from d left join f using (payload_digest)
"""
