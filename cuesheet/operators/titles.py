"""An index of the characters of normal titles, and the catalogue in buckets.

Postings are rows (gram, normalized_song_title) for every three characters in a row of every different
title, sorted by gram, so that a query reads a few row groups. A title that contains a query has all of its
grams: the titles that all of a query's postings name are looked at, all others aren't. Queries
of fewer characters scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import search
from cuesheet.sources.sample import Catalogue

GRAM = 3


def postings(songs: DataFrame) -> DataFrame:
    """(gram, normalized_song_title) of the titles of songs, in order of gram; to be written as it is."""
    titles = songs.select("normalized_song_title").where(F.char_length("normalized_song_title") >= GRAM).distinct()
    at = F.sequence(F.lit(1), F.char_length("normalized_song_title") - (GRAM - 1))
    grams = F.array_distinct(F.transform(at, lambda k: F.substring("normalized_song_title", k, F.lit(GRAM))))
    rows = titles.select(F.explode(grams).alias("gram"), "normalized_song_title")
    return rows.repartitionByRange("gram", "normalized_song_title").sortWithinPartitions("gram", "normalized_song_title")


def query_grams(spark: SparkSession, song: str) -> list[str]:
    """The different grams of a query's normal form; none if it is too short for the index."""
    normal = spark.range(1).select(text.normalize_title(F.lit(song))).first()[0] or ""
    return sorted({normal[k : k + GRAM] for k in range(len(normal) - GRAM + 1)})


def candidates(index: DataFrame, grams: list[str]) -> DataFrame:
    """(normalized_song_title) of the titles that have all grams."""
    found = index.where(F.col("gram").isin(grams)).groupBy("normalized_song_title").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(grams)).select("normalized_song_title")


def search_indexed(c: Catalogue, index: DataFrame, song: str, channel: str | None = None, limit: int | None = 50) -> DataFrame:
    """search.search() of a song, for which only the songs of the index's candidates are read and joined."""
    grams = query_grams(index.sparkSession, song)
    if grams:
        c = Catalogue(c.channels, c.videos, c.songs.join(candidates(index, grams), "normalized_song_title", "left_semi"), c.entries)
    return search.search(c, song, channel, limit)


def in_buckets(c: Catalogue, name: str, path: str, buckets: int) -> Catalogue:
    """The catalogue as tables whose songs and entries are bucketed and sorted by song_id: joins and groups by song_id need no exchange."""
    spark = c.songs.sparkSession
    for table, rows in (("songs", c.songs), ("entries", c.entries)):
        (rows.repartition(buckets, "song_id").write.bucketBy(buckets, "song_id").sortBy("song_id")
         .mode("overwrite").option("path", f"{path}/{table}").saveAsTable(f"{name}_{table}"))
    return Catalogue(c.channels, c.videos, spark.table(f"{name}_songs"), spark.table(f"{name}_entries"))


def counted(index: DataFrame, songs: DataFrame, queries: tuple[str, ...]) -> DataFrame:
    """(query, titles, looked_at, found): how many titles there are, how many the index leaves for each query, and how many of these answer it."""
    spark = index.sparkSession
    titles = songs.select("normalized_song_title").distinct()
    total = titles.count()
    rows = []
    for song in queries:
        grams = query_grams(spark, song)
        left = candidates(index, grams) if grams else titles
        hit = search.song_filter(F.col("normalized_song_title"), text.normalize_title(F.lit(song)))
        rows.append(left.agg(F.lit(song).alias("query"), F.lit(total).cast("bigint").alias("titles"), F.count(F.lit(1)).alias("looked_at"), F.count_if(hit).alias("found")))
    return reduce(DataFrame.union, rows)
