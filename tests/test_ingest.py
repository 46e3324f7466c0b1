"""The incremental index against the batch one, in any order of batches; replacing entries in place."""

import random

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import store, timeline
from cuesheet.plans import catalogue
from cuesheet.shipping import ship
from cuesheet.sources import sample
from cuesheet.streaming import ingest

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def comments_of(spark, seed):
    """A few hundred comments of made-up lines on 40 videos, from 0 to 12 comments each."""
    rng = random.Random(seed)
    parts = ["0:30 KING", "1:30 QUEEN / B", "2:30 JACK / C", "12:30 MC", "Setlist", "text", "", "---", "0:45 setlist ACE", "1:00:05 夜 / YOASOBI", "5:00 KING", "5:00 KING"]
    rows = [(f"w{v}", k, "\n".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for v in range(40) for k in range(rng.randint(0, 12))]
    return spark.createDataFrame([*rows, ("w1", 50, None), ("other", 0, "0:30 KING\n1:30 QUEEN")], "video_id string, comment_pos long, text string")


def test_blocks_equal_those_of_windows(spark):
    """best_block() and timeline.candidates() choose the same block of every comment."""
    comments = comments_of(spark, 3).union(spark.createDataFrame([*catalogue.COMMENTS], "video_id string, comment_pos bigint, text string")).union(sample.comments(spark, SF).limit(300)).where("text is not null")
    want = {(r.video_id, r.comment_pos): (r.has_marker, r.score, r.n_entries, r.start_line) for r in timeline.candidates(comments).collect()}
    got = {}
    for r in ingest.parsed(comments).where("lines is not null").collect():
        found = ingest.best_block([x.asDict() for x in r.lines])
        if found:
            got[r.video_id, r.comment_pos] = (*found["rank"], found["entries"][0]["entry_id"])
    assert got == want and len(want) > 100


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_equals_batch_in_any_order_and_after_restarts(spark, tmp_path, seed):
    ship(spark)
    comments = comments_of(spark, seed)
    videos = spark.createDataFrame([(f"w{v}", "Karaoke" if v % 5 else "Game") for v in range(40)], "video_id string, title string")
    deal = comments.withColumn("batch", F.abs(F.xxhash64("video_id", "comment_pos", F.lit(seed))) % 4)
    order = random.Random(seed).sample(range(4), 4)
    columns = ["video_id", "entry_id", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title", "jump_url"]
    landed = tmp_path / "landed"
    for done, number in enumerate(order, 1):
        deal.where(F.col("batch") == number).drop("batch").coalesce(1).write.parquet(str(landed / str(number)))
        ingest.run(spark, str(landed / "*"), str(tmp_path / "out"), str(tmp_path / "state"), comments.schema, videos, max_comments=5, buckets=8)  # each run restarts the stream
        so_far = deal.where(F.col("batch").isin(order[:done])).drop("batch")
        want = rows_of(timeline.index(so_far, videos, max_comments=5), *columns)
        got = rows_of(spark.read.parquet(str(tmp_path / "out")), *columns)
        stale = {r[0] for r in got} - {r[0] for r in want}  # a video keeps its entries when comments before push out the only timeline
        assert [r for r in got if r[0] not in stale] == want
    assert len(want) > 50
    ingest.run(spark, str(landed / "*"), str(tmp_path / "out"), str(tmp_path / "state"), comments.schema, videos, max_comments=5, buckets=8)
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *columns) == got  # nothing new, nothing done


def test_a_batch_reads_its_own_comments_only(spark, tmp_path):
    ship(spark)
    comments = sample.comments(spark, SF)
    videos = sample.videos(spark, SF)
    read = []
    for number in range(3):
        comments.where(F.abs(F.hash("video_id", "comment_pos")) % 3 == number).coalesce(1).write.parquet(str(tmp_path / "landed" / str(number)))
        ingest.run(spark, str(tmp_path / "landed" / "*"), str(tmp_path / "out"), str(tmp_path / "state"), comments.schema, videos, all_videos=True)
        before = sum(read)
        log = sorted((tmp_path / "state" / "offsets").glob("[0-9]*"))
        read.append(len(log) - before)
    assert read == [1, 1, 1]
    assert sum(1 for _ in (tmp_path / "state" / "sources" / "0").glob("[0-9]*")) == 3  # one file a batch, none again
    columns = ["video_id", "seconds", "normalized_song_title"]
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), *columns) == rows_of(timeline.index(comments, videos, all_videos=True), *columns)


def test_replacing_leaves_other_files_alone(spark, tmp_path):
    path = str(tmp_path / "entries")
    entries = spark.createDataFrame([(f"v{v}", s, f"t{s}") for v in range(200) for s in range(3)], "video_id string, seconds long, title string")
    assert store.replace_in_place(entries, path, 16) == list(range(16))
    files = lambda: {f"{f.parent.name}/{f.name}" for f in (tmp_path / "entries").glob("bucket=*/*.parquet")}
    before = files()
    new = spark.createDataFrame([("v7", 9, "new"), ("v7", 10, "new"), ("v999", 1, "added")], entries.schema)
    touched = store.replace_in_place(new, path, 16)
    assert 1 <= len(touched) <= 2 and {f.split("/")[0] for f in before - files()} == {f"bucket={k}" for k in touched} and len(before - files()) == len(touched)
    got = rows_of(spark.read.parquet(path), "video_id", "seconds", "title")
    assert got == sorted([(f"v{v}", s, f"t{s}") for v in range(200) if v != 7 for s in range(3)] + [tuple(r) for r in new.collect()])
    assert store.replace_in_place(new, path, 16) == touched and rows_of(spark.read.parquet(path), "video_id", "seconds", "title") == got
    now = files()
    assert store.replace_in_place(new.limit(0), path, 16) == [] and files() == now
