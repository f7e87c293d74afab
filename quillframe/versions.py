"""Datasets in versions: a commit leaves earlier versions as they are, and is there as a whole or not at all.

A folder holds snapshots (five Parquet tables each) and manifests. A commit writes a new snapshot first, and then the manifest of the next
number, which names it. A job that dies before that leaves a snapshot that nothing names, and the version before stays the latest. A number
is claimed by one writer only; of two that began from the same version the second gets an error, and can look at the first one's result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from .dataset import Dataset
from .storage import children, create, delete


class Conflict(RuntimeError):
    """Another writer has committed a version in the meantime."""


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of all versions, rising."""
    return sorted(int(n.removeprefix("version-").removesuffix(".json")) for n in children(spark, f"{path}/manifests") if n.startswith("version-") and n.endswith(".json"))


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/manifests/version-{version:09}.json", wholetext=True).first()[0])


def open_version(spark: SparkSession, path: str, version: int | None = None) -> Dataset:
    """A version of the dataset, the latest by default."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"{path} has no version {'at all' if version is None else version}")
    found = _manifest(spark, path, there[-1] if version is None else version)
    return Dataset.load(spark, f"{path}/snapshots/{found['snapshot']}", found["rootdir"])


def notes(spark: SparkSession, path: str, version: int) -> dict:
    """What a version's commit noted."""
    return _manifest(spark, path, version).get("notes", {})


def open_table(spark: SparkSession, path: str, name: str, version: int | None = None) -> DataFrame | None:
    """A further table of a version (the latest by default), if it has one of that name."""
    found = _manifest(spark, path, versions(spark, path)[-1] if version is None else version)
    schema = found.get("tables", {}).get(name)
    return None if schema is None else spark.read.schema(schema).parquet(f"{path}/snapshots/{found['snapshot']}/{name}")


def commit(ds: Dataset, path: str, parent: int | None = None, keep: int | None = None, tables: dict[str, DataFrame] | None = None, **notes: object) -> int:
    """Adds the dataset as a version and returns its number. parent: the version that it was made from (the latest by default; 0: none yet). keep: so many versions stay, older ones go. tables: further ones that belong to the version."""
    spark = ds.spark
    parent = max(versions(spark, path), default=0) if parent is None else parent
    number = parent + 1
    snapshot = f"{number:09}-{uuid.uuid4().hex}"
    ds.save(f"{path}/snapshots/{snapshot}")
    for name, df in (tables or {}).items():
        df.write.parquet(f"{path}/snapshots/{snapshot}/{name}")
    kinds = {name: ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) for name, df in (tables or {}).items()}
    if not create(spark, f"{path}/manifests/version-{number:09}.json", json.dumps({"snapshot": snapshot, "rootdir": ds.rootdir, "tables": kinds, "notes": notes})):
        delete(spark, f"{path}/snapshots/{snapshot}")
        raise Conflict(f"{path} has a version {number} already")
    if keep is not None:
        expire(spark, path, keep)
    return number


def expire(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes all versions but the last `keep`, and snapshots up to the latest version that no manifest names. Later ones may be of writers that are at work."""
    if keep < 1:
        raise ValueError("the latest version can't be deleted")
    there = versions(spark, path)
    for number in there[:-keep]:
        delete(spark, f"{path}/manifests/version-{number:09}.json")
    named = {_manifest(spark, path, n)["snapshot"] for n in there[-keep:]}
    for snapshot in children(spark, f"{path}/snapshots"):
        if snapshot not in named and int(snapshot.split("-")[0]) <= max(there, default=0):
            delete(spark, f"{path}/snapshots/{snapshot}")
