"""Flat search, lists and counts over the catalogue."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.sources.sample import Catalogue

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COLUMNS = [
    "song_id", "canonical_song_title", "normalized_song_title", "raw_song_title", "timestamp_text", "seconds", "jump_url",
    "video_id", "video_title", "published_at", "channel_id", "channel_title",
]


def joined(c: Catalogue) -> DataFrame:
    """A row for each entry that has a song, with its video and channel; entry_id is kept to settle ties."""
    songs = c.songs.select("song_id", "canonical_song_title", F.col("normalized_song_title").alias("_normal"))
    videos = c.videos.select("video_id", "channel_id", F.col("title").alias("video_title"), "published_at")
    rows = c.entries.drop("normalized_song_title").join(songs, "song_id").join(videos, "video_id").join(c.channels, "channel_id")
    return rows.withColumnRenamed("_normal", "normalized_song_title").select(*COLUMNS, "entry_id")


def channel_filter(query: str) -> Column:
    """Title contains the query, A-Z in either case, or the id is the query."""
    low = lambda c: F.translate(c, UPPER, LOWER)
    return low(F.col("channel_title")).contains(low(F.lit(query))) | (F.col("channel_id") == query)


def song_filter(normal: Column, query: Column) -> Column:
    """A normal title that answers a normalised query.

    A query of ASCII letters, digits, spaces, _ and - has to be the title, or to stand after
    a delimiter, or at the start with a delimiter after it. Any other may stand anywhere.
    """
    starts = [normal.startswith(F.concat(query, F.lit(d))) for d in " /-:"]
    inside = [normal.contains(F.concat(F.lit(d), query)) for d in " /-|"]
    words = reduce(or_, [normal == query, *starts, *inside])
    return F.when(query.rlike(r"^[A-Za-z0-9 _-]+\z"), words).otherwise(normal.contains(query))


def limited(rows: DataFrame, order: list[Column], limit: int | None, offset: int = 0, rank: str = "rank") -> DataFrame:
    """The first rows in order, numbered from 1 (after the offset); all rows, in order, without a limit or with a negative one."""
    ordered = rows.orderBy(*order)
    if limit is None or limit < 0:
        return ordered
    page = ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)
    return page.withColumn(rank, (F.row_number().over(Window.orderBy(*order)) + offset).cast("bigint"))


def search(c: Catalogue, song: str | None = None, channel: str | None = None, limit: int | None = 50) -> DataFrame:
    """Entries by song and channel: equal titles first, then prefixes, then others; without a song, by canonical title."""
    rows = joined(c)
    query = text.normalize_title(F.lit(song or ""))
    wanted = [song_filter(F.col("normalized_song_title"), query) | (query == "")] if song else []
    wanted += [channel_filter(channel)] if channel else []
    if wanted:
        rows = rows.where(reduce(and_, wanted))
    normal = F.col("normalized_song_title")
    relevance = F.when(query == "", F.col("canonical_song_title")).when(normal == query, "0").when(normal.startswith(query), "1").otherwise("2")
    order = [relevance, F.col("channel_title"), normal, F.desc_nulls_last("published_at"), F.col("seconds"), F.col("video_id"), F.col("entry_id")]
    return limited(rows, order, limit).drop("entry_id")


def search_legacy(c: Catalogue, song: str, limit: int = 25) -> DataFrame:
    """Entries whose normal title contains the query, equal ones and prefixes first, newest first."""
    query, normal = text.normalize_title(F.lit(song)), F.col("normalized_song_title")
    relevance = F.when(normal == query, 0).when(normal.startswith(query), 1).otherwise(2)
    order = [relevance, normal, F.desc_nulls_last("published_at"), F.col("seconds"), F.col("video_id"), F.col("entry_id")]
    return limited(joined(c).where(normal.contains(query)), order, limit).drop("entry_id")


def list_songs(c: Catalogue, channel: str | None = None, limit: int | None = 100) -> DataFrame:
    """Songs with their numbers of entries and videos and their latest date; songs without entries too."""
    channels = c.channels.where(channel_filter(channel)) if channel else c.channels
    used = c.entries.join(c.videos.select("video_id", "published_at"), "video_id", "left").groupBy("song_id")
    used = used.agg(F.count("entry_id").alias("entry_count"), F.count_distinct("video_id").alias("video_count"), F.max("published_at").alias("latest_published_at"))
    rows = c.songs.join(channels, "channel_id").join(used, "song_id", "left")
    counts = [F.coalesce(n, F.lit(0)).alias(n) for n in ("entry_count", "video_count")]
    rows = rows.select("song_id", "channel_id", "channel_title", "canonical_song_title", "normalized_song_title", *counts, "latest_published_at")
    return limited(rows, [F.col("channel_title"), F.col("normalized_song_title"), F.col("channel_id")], limit)


def list_channels(c: Catalogue) -> DataFrame:
    """Channels with their numbers of videos, songs and entries, each counted before it is joined."""
    videos = c.videos.groupBy("channel_id").agg(F.count(F.lit(1)).alias("video_count"))
    songs = c.songs.groupBy("channel_id").agg(F.count(F.lit(1)).alias("song_count"))
    entries = c.entries.join(c.videos.select("video_id", "channel_id"), "video_id").groupBy("channel_id").agg(F.count(F.lit(1)).alias("entry_count"))
    rows = c.channels
    for counted in (videos, songs, entries):
        rows = rows.join(counted, "channel_id", "left")
    return rows.na.fill(0, ["video_count", "song_count", "entry_count"]).orderBy("channel_title", "channel_id")


def stats(c: Catalogue) -> DataFrame:
    """One row: numbers of channels, videos, songs and entries."""
    names = {"channels": c.channels, "videos": c.videos, "songs": c.songs, "song_entries": c.entries}
    counted = [df.agg(F.count(F.lit(1)).alias("n")).withColumn("name", F.lit(name)) for name, df in names.items()]
    every = reduce(DataFrame.unionByName, counted)
    return every.agg(*[F.sum(F.when(F.col("name") == name, F.col("n")).otherwise(0)).alias(name) for name in names])
