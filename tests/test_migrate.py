"""Catalogues of older schema versions: brought up to date once, and only where something is missing."""

from pathlib import Path

import pytest

from cuesheet.operators import migrate, store
from cuesheet.sources import sample

SF = "/root/testdata/sf0.001"


def files(path):
    return sorted(str(p.relative_to(path)) for p in Path(path).rglob("*") if p.is_file() and not p.name.startswith("."))


def rows_of(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


@pytest.fixture
def c(spark):
    return sample.catalogue(spark, SF)


def test_entries_without_songs_are_migrated_once(spark, c, tmp_path):
    c.entries.drop("song_id").write.parquet(str(tmp_path / "song_entries"))
    c.videos.write.parquet(str(tmp_path / "videos"))
    c.channels.write.parquet(str(tmp_path / "channels"))
    assert migrate.tables(spark, str(tmp_path)).entries.where("song_id is not null").count() == 0
    assert migrate.migrate(spark, str(tmp_path))
    now = migrate.tables(spark, str(tmp_path))
    assert rows_of(now.songs) == rows_of(c.songs) and rows_of(now.entries.select(c.entries.columns)) == rows_of(c.entries)
    assert migrate.manifest(spark, str(tmp_path))["version"] == migrate.VERSION
    before = files(tmp_path)
    assert not migrate.migrate(spark, str(tmp_path)) and files(tmp_path) == before
    assert migrate.vacuum(spark, str(tmp_path)) == ["song_entries"] and migrate.vacuum(spark, str(tmp_path)) == []
    assert rows_of(migrate.tables(spark, str(tmp_path)).entries.select(c.entries.columns)) == rows_of(c.entries)


def test_files_of_both_versions_keep_their_ids(spark, c, tmp_path):
    own = c.entries.where("entry_id % 2 = 0").selectExpr("*").withColumn("song_id", c.entries["song_id"] + 0)
    c.entries.where("entry_id % 2 = 1").drop("song_id").write.parquet(str(tmp_path / "song_entries"))
    own.write.mode("append").parquet(str(tmp_path / "song_entries"))
    for name, rows in (("videos", c.videos), ("channels", c.channels), ("songs", c.songs)):
        rows.write.parquet(str(tmp_path / name))
    assert migrate.migrate(spark, str(tmp_path))
    now = migrate.tables(spark, str(tmp_path))
    assert rows_of(now.entries.select("entry_id", "song_id")) == rows_of(c.entries.select("entry_id", "song_id")) and rows_of(now.songs) == rows_of(c.songs)


def test_nothing_to_fill_in(spark, c, tmp_path):
    """A complete old catalogue gets its version and keeps its rows; an empty folder becomes empty tables; a later gap is filled."""
    store.write(c, str(tmp_path / "full"))
    assert migrate.migrate(spark, str(tmp_path / "full")) and not migrate.migrate(spark, str(tmp_path / "full"))
    assert rows_of(migrate.tables(spark, str(tmp_path / "full")).entries.select(c.entries.columns)) == rows_of(c.entries)
    empty = str(tmp_path / "empty")
    assert migrate.migrate(spark, empty) and not migrate.migrate(spark, empty)
    assert [t.count() for t in vars(migrate.tables(spark, empty)).values()] == [0, 0, 0, 0]
    said = migrate.manifest(spark, str(tmp_path / "full"))["tables"]
    c.entries.limit(5).drop("song_id").withColumn("entry_id", c.entries["entry_id"] + 10**9).write.mode("append").parquet(str(tmp_path / "full" / said["song_entries"]))
    assert migrate.migrate(spark, str(tmp_path / "full"))
    assert migrate.tables(spark, str(tmp_path / "full")).entries.where("song_id is null").count() == 0


def test_a_migration_that_breaks_off_changes_nothing(spark, c, tmp_path, monkeypatch):
    c.entries.drop("song_id").write.parquet(str(tmp_path / "song_entries"))
    c.videos.write.parquet(str(tmp_path / "videos"))
    with monkeypatch.context() as m:
        m.setattr(migrate, "_write_manifest", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            migrate.migrate(spark, str(tmp_path))
    assert migrate.manifest(spark, str(tmp_path)) == {"version": 1, "tables": {"channels": None, "videos": "videos", "songs": None, "song_entries": "song_entries"}}
    assert migrate.migrate(spark, str(tmp_path)) and len(migrate.vacuum(spark, str(tmp_path))) == 4
    with pytest.raises(ValueError, match="version 9"):
        migrate._write_manifest(spark, str(tmp_path), {"version": 9, "tables": {}})
        migrate.migrate(spark, str(tmp_path))
