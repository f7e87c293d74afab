"""Annotation formats as Python data sources: `kitti`, `voc` and `labelme` to read, `yolo` and `labelme` to write.

Reading. read() gives the rows that sources.imports makes datasets of (from_kitti_rows, from_pascal, from_labelme), with the path of each row's file. Files are
dealt to partitions of about `partition_bytes` (option, 16 MB). Filters on `file` and `stem` are pushed down and decide which files are
read at all: equality, in-lists, starts, ends and parts of the text. (Spark keeps the filters that were pushed last for later queries on the same DataFrame that push none;
read() has one of its own that is always pushed, and a plain load pushes none.)

Writing takes rows of `file` (without its ending) and `text`, each a whole file, as sources.exports makes them. Tasks write to a hidden folder and the commit
moves the files into place, so nothing of a failed job is seen, and of a task that ran twice one result counts. Two rows of one name are an error.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructType

from .files import opened
from .imports import KITTI, LABELME, PASCAL

BATCH_ROWS = 5000


def stem_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def by_schema(element: ElementTree.Element, kind: DataType) -> object:
    """An XML element as a value of the type: a struct of its children, an array of all that have a name, or its text."""
    if isinstance(kind, StructType):
        out = {}
        for f in kind:
            found = element.findall(f.name)
            if isinstance(f.dataType, ArrayType):
                out[f.name] = [by_schema(x, f.dataType.elementType) for x in found] or None
            else:
                out[f.name] = by_schema(found[0], f.dataType) if found else None
        return out
    text = (element.text or "").strip()
    if not text:
        return None
    return float(text) if isinstance(kind, DoubleType) else int(text) if isinstance(kind, IntegerType) else text


def kitti_rows(data: bytes, fields: StructType) -> Iterator[dict]:
    """Fields of each line of 15 or 16; a file without any gives a row without a place."""
    found = [(n, line.strip().split()) for n, line in enumerate(re.split("\r?\n", data.decode()))]
    rows = [{"place": n, **dict(zip(KITTI, f, strict=False))} for n, f in found if len(f) >= 15]
    return iter(rows or [{"place": None}])


def xml_rows(data: bytes, fields: StructType) -> Iterator[dict]:
    return iter([by_schema(ElementTree.fromstring(data), fields)])


#: Ending, columns behind file and stem, and rows of a file's content for the columns that are read.
READERS: dict[str, tuple[str, str, Callable[[bytes, StructType], Iterator[dict]]]] = {
    "kitti": (".txt", "place int, " + ", ".join(f"{c} string" for c in KITTI), kitti_rows),
    "voc": (".xml", PASCAL, xml_rows),
    "labelme": (".xml", LABELME, xml_rows),
}
ENDINGS = {"yolo": ".txt", "labelme": ".xml"}

_TESTS: dict[type, Callable[[str, object], bool]] = {D.EqualTo: lambda a, b: a == b, D.In: lambda a, b: a in b, D.StringStartsWith: lambda a, b: a.startswith(b), D.StringEndsWith: lambda a, b: a.endswith(b), D.StringContains: lambda a, b: b in a}


def _wanted(found: D.Filter) -> Callable[[str], bool] | None:
    """A test of a file's path; None for filters on what is in files."""
    column = getattr(found, "attribute", (None,))
    if column == ("file",) and isinstance(found, D.IsNotNull):
        return lambda path: True
    test = _TESTS.get(type(found))
    if test is None or column not in (("file",), ("stem",)):
        return None
    of = (lambda path: path) if column == ("file",) else stem_of
    return lambda path: test(of(path), found.value)


class Group(D.InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class FormatReader(D.DataSourceReader):
    def __init__(self, name: str, schema: StructType, options: dict[str, str]):
        self.name, self.fields, self.path = name, schema, options["path"]
        self.bytes = int(options.get("partition_bytes", 16 << 20))
        self.filters: list[D.Filter] = []

    def partitions(self) -> list[Group]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else files.get_file_info(fs.FileSelector(root, recursive=True))
        tests = [_wanted(f) for f in self.filters]
        ending = READERS[self.name][0]
        found = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(ending) and not f.path[len(root) :].lstrip("/").startswith(("_", ".")) and all(t(f.path) for t in tests))
        groups: list[list[str]] = [[]]
        held = 0
        for path, size in found:
            if groups[-1] and held + size > self.bytes:
                groups.append([])
                held = 0
            groups[-1].append(path)
            held += size
        return [Group(g) for g in groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        files, arrow, rows = opened(self.path)[0], to_arrow_schema(self.fields), []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in arrow], schema=arrow)
        for path in partition.files:
            with files.open_input_stream(path, compression=None) as file:
                data = file.read()
            try:
                rows += [{**r, "file": path, "stem": stem_of(path)} for r in READERS[self.name][2](data, self.fields)]
            except (ValueError, ElementTree.ParseError) as e:
                raise ValueError(f"{path}: {e}") from e
            if len(rows) >= BATCH_ROWS:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


class PushingReader(FormatReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:
        for f in filters:
            if _wanted(f) is None:
                yield f
            else:
                self.filters.append(f)


class Written(D.WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class FilesWriter(D.DataSourceArrowWriter):
    def __init__(self, name: str, schema: StructType, options: dict[str, str], overwrite: bool):
        if missing := {"file", "text"} - set(schema.names):
            raise ValueError(f"columns are needed: {', '.join(sorted(missing))}")
        self.ending, self.path, self.overwrite, self.job = ENDINGS[name], options["path"], overwrite, uuid.uuid4().hex

    def _hidden(self, root: str) -> str:
        return f"{root.rstrip('/')}/_temporary-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = opened(self.path)
        task, names = f"{self._hidden(root)}/{uuid.uuid4().hex}", []
        for b in iterator:
            for name, text in zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True):
                target = f"{task}/{name}{self.ending}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(target, compression=None) as out:
                    out.write((text or "").encode())
                names.append(target)
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        hidden = self._hidden(root)
        moves = [(n, f"{root.rstrip('/')}/{n[len(hidden) + 34 :]}") for m in messages if m for n in m.names]
        if len({target for _, target in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows are for one file")
        if self.overwrite and files.get_file_info(root).type == fs.FileType.Directory:
            for f in files.get_file_info(fs.FileSelector(root, recursive=True)):
                if f.type == fs.FileType.File and f.path.endswith(self.ending) and "/_temporary-" not in f.path:
                    files.delete_file(f.path)
        for source, target in moves:
            files.create_dir(target.rsplit("/", 1)[0], recursive=True)
            files.move(source, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.path)
        if files.get_file_info(self._hidden(root)).type == fs.FileType.Directory:
            files.delete_dir(self._hidden(root))


class _Format(D.DataSource):
    def schema(self) -> str:
        return f"file string, stem string, {READERS[self.name()][1]}"

    def reader(self, schema: StructType) -> FormatReader:
        return (PushingReader if self.options.get("pushdown") == "true" else FormatReader)(self.name(), schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.name(), schema, dict(self.options), overwrite)


class KittiSource(_Format):
    @classmethod
    def name(cls) -> str:
        return "kitti"


class VocSource(_Format):
    @classmethod
    def name(cls) -> str:
        return "voc"


class LabelmeSource(_Format):
    @classmethod
    def name(cls) -> str:
        return "labelme"


class YoloSource(_Format):
    @classmethod
    def name(cls) -> str:
        return "yolo"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark push filters down to Python data sources."""
    for source in (KittiSource, VocSource, LabelmeSource, YoloSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, name: str, path: str, **options: object) -> DataFrame:
    """Rows of the files below path; filters on file and stem decide which files are read."""
    register(spark)
    return spark.read.format(name).option("pushdown", "true").options(**options).load(path).filter("file is not null")
