"""The index of titles against a scan for queries of all forms, and plans over buckets."""

import re

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import search, titles
from cuesheet.plans import api
from cuesheet.shipping import ship
from cuesheet.sources import sample

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("song", ["red", "RED ", "re", "", "(x)", "widget", "widget / l", "d w", "old-gear", "hot gear - piano", "/ s", "zzz", "怪物", "ﬁx", "%_"])
def test_index_equals_a_scan(spark, song):
    c = sample.catalogue(spark, SF)
    index = api.title_index(spark, SF)
    got, want = (sorted(map(str, f.drop("rank").collect())) for f in (titles.search_indexed(c, index, song, limit=None), search.search(c, song, limit=None)))
    assert got == want


def test_a_query_reads_its_grams_only(spark):
    found = titles.candidates(api.title_index(spark, SF), ["old", "ld "])
    plan = found._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[In\(gram, \[ld ,old\]\)\]", plan)
    rows = {r.query: r for r in api.f2_titles_looked_at(spark, SF).collect()}
    assert 0 < rows["old g"].looked_at < rows["old g"].titles / 2 and rows["o"].looked_at == rows["o"].titles and rows["no such title"].looked_at == 0
    assert all(r.found <= r.looked_at for r in rows.values())


def test_short_and_repeated_titles(spark):
    songs = spark.createDataFrame([("",), ("ab",), ("aaaa",), ("aaaa",), ("abcabc",), (None,)], "normalized_song_title string")
    rows = [tuple(r) for r in titles.postings(songs).collect()]
    assert rows == [("aaa", "aaaa"), ("abc", "abcabc"), ("bca", "abcabc"), ("cab", "abcabc")]
    assert [r[0] for r in titles.candidates(titles.postings(songs), ["abc", "cab"]).collect()] == ["abcabc"]


def by_song(df):
    """Exchanges that deal rows by song_id, once the plan has run."""
    df.write.format("noop").mode("overwrite").save()
    return len(re.findall(r"Exchange hashpartitioning\(song_id#", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))))


def test_buckets_spare_the_exchange(spark):
    ship(spark)
    c = sample.catalogue(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plain = c.entries.groupBy("song_id").agg(F.count("entry_id").alias("n")).join(c.songs, "song_id", "right")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        b = api.bucketed(spark, SF)
        grouped = b.entries.groupBy("song_id").agg(F.count("entry_id").alias("n")).join(b.songs, "song_id", "right")
        assert by_song(plain) >= 1 and by_song(grouped) == 0
        assert by_song(api.w1_bucketed(spark, SF)) == 0
        assert sorted(map(str, grouped.select("song_id", "n").collect())) == sorted(map(str, plain.select("song_id", "n").collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert by_song(api.q4_bucketed(spark, SF)) == 0  # videos are few here, and broadcast
