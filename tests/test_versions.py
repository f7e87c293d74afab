"""Versions of a dataset: earlier ones stay, a crash leaves the latest, one of two writers wins."""

import pytest

from quillframe import storage, versions
from quillframe.dataset import Dataset
from quillframe.storage import children


def one(spark, *names):
    return Dataset.from_rows(spark, rootdir="here", images=[(n, 1, 1, None, None, None, None) for n in names])


def names(ds):
    return sorted(r.imagefile for r in ds.images.collect())


def test_versions_are_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    assert versions.versions(spark, path) == []
    with pytest.raises(ValueError):
        versions.open_version(spark, path)
    assert [versions.commit(one(spark, *"abc"[: k + 1]), path) for k in range(3)] == [1, 2, 3]
    assert [names(versions.open_version(spark, path, k)) for k in (1, 2, None)] == [["a"], ["a", "b"], ["a", "b", "c"]] and versions.open_version(spark, path).rootdir == "here"
    # a version made from itself: its tables are read while the next one is written
    now = versions.open_version(spark, path)
    assert versions.commit(now.with_(images=now.images.filter("imagefile <> 'b'")), path, keep=2) == 4
    assert versions.versions(spark, path) == [3, 4] and names(versions.open_version(spark, path)) == ["a", "c"] and len(children(spark, f"{path}/snapshots")) == 2
    with pytest.raises(ValueError):
        versions.open_version(spark, path, 1)


def test_a_crash_between_tables_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/db"
    versions.commit(one(spark, "a"), path)

    def dies(self, target, mode="errorifexists"):
        self.images.write.parquet(f"{target}/images")
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(Dataset, "save", dies)
        with pytest.raises(OSError):
            versions.commit(one(spark, "a", "b"), path)
    assert versions.versions(spark, path) == [1] and names(versions.open_version(spark, path)) == ["a"] and len(children(spark, f"{path}/snapshots")) == 2
    assert versions.commit(one(spark, "c"), path) == 2
    versions.expire(spark, path, 1)
    assert names(versions.open_version(spark, path)) == ["c"] and len(children(spark, f"{path}/snapshots")) == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    versions.commit(one(spark, "a"), path)
    assert versions.commit(one(spark, "first"), path, parent=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(one(spark, "second"), path, parent=1)
    assert names(versions.open_version(spark, path)) == ["first"] and len(children(spark, f"{path}/snapshots")) == 2


def test_a_claim_of_a_writer_that_died_is_taken_over(spark, tmp_path, monkeypatch):
    (tmp_path / "x.claim").touch()
    assert not storage.create(spark, f"file://{tmp_path}/x", "late")
    monkeypatch.setattr(storage, "CLAIM_SECONDS", -10)
    assert storage.create(spark, f"file://{tmp_path}/x", "mine") and not storage.create(spark, f"file://{tmp_path}/x", "again")
    assert (tmp_path / "x").read_text() == "mine"
