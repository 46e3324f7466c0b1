"""Stored catalogues of several schema versions: reading them, and bringing them up to date once.

A catalogue is a folder with a folder for each table, and a file that names its schema version
and the folders of its tables. It is replaced last, so that a migration that breaks off leaves
the catalogue as it was. One without that file is of version 1: its entries may lack song_id,
in all of their files or in some, and tables may be missing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from cuesheet.operators import store
from cuesheet.scratch import exists, files_of
from cuesheet.sources.sample import Catalogue

VERSION = 2
MANIFEST = "catalogue.json"


def manifest(spark: SparkSession, path: str) -> dict:
    """The schema version of the catalogue at path, and the folder of each table; null where there is none."""
    if exists(spark, f"{path}/{MANIFEST}"):
        return json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{MANIFEST}").collect()))
    return {"version": 1, "tables": {name: name if exists(spark, f"{path}/{name}") else None for name in store.TABLES}}


def _write_manifest(spark: SparkSession, path: str, said: dict) -> None:
    files, place = files_of(spark, f"{path}/{MANIFEST}")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{MANIFEST}-{uuid.uuid4().hex}")
    out = files.create(fresh)
    try:
        out.write(json.dumps(said).encode())
    finally:
        out.close()
    files.delete(place, False)
    files.rename(fresh, place)


def tables(spark: SparkSession, path: str) -> Catalogue:
    """The catalogue at path as it is, in today's columns: those that files lack are null, tables that are missing are empty."""
    said = manifest(spark, path)["tables"]
    read = lambda name, columns: spark.createDataFrame([], columns) if said[name] is None else spark.read.schema(columns).parquet(f"{path}/{said[name]}")
    return Catalogue(*[read(name, columns) for name, columns in store.TABLES.items()])


def migrate(spark: SparkSession, path: str) -> bool:
    """Bring the catalogue at path to VERSION: all tables with all columns, and a song for every entry. Returns whether anything was written.

    Songs are only filled in where there are entries, and no songs or entries without one. A catalogue that is up to date is left alone.
    """
    said = manifest(spark, path)
    if said["version"] > VERSION:
        raise ValueError(f"the catalogue at {path} is of version {said['version']}, this is {VERSION}")
    c = tables(spark, path)
    incomplete = store.needs_backfill(c.songs, c.entries).first()[0]
    old = said["version"] < VERSION
    if not (incomplete or old):
        return False
    songs, entries = store.backfilled(c.entries, c.videos, c.songs) if incomplete else (c.songs, c.entries)
    changed: dict[str, DataFrame] = {name: rows for name, rows in zip(store.TABLES, (c.channels, c.videos, songs, entries), strict=True) if said["tables"][name] is None}
    if incomplete or old:
        changed |= {"songs": songs, "song_entries": entries}
    now = dict(said["tables"])
    for name, rows in changed.items():
        now[name] = f"{name}-{uuid.uuid4().hex[:12]}"
        rows.select(*[f.name for f in spark.createDataFrame([], store.TABLES[name]).schema]).write.parquet(f"{path}/{now[name]}")
    _write_manifest(spark, path, {"version": VERSION, "tables": now})
    return True


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete folders of tables that the catalogue doesn't name any more, and return their names."""
    said, (files, place) = manifest(spark, path), files_of(spark, path)
    found = [s.getPath() for s in files.listStatus(place) if s.isDirectory()]
    stale = [p for p in found if p.getName() not in said["tables"].values() and p.getName().split("-")[0] in store.TABLES]
    for p in stale:
        files.delete(p, True)
    return sorted(p.getName() for p in stale)
