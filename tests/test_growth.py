"""Work that grows with the tables only: what the reports of round 3 found to grow faster."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import clean, group, store, timeline
from cuesheet.sources import sample
from cuesheet.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def walked(rows):
    """The updates of one time one by one, each looking at all other rows."""
    held, out = [r[3] for r in rows], {}
    for i, (_, _, entry_id, _, new, probable, changed) in enumerate(rows):
        if probable and changed:
            if any(j != i and h == new for j, h in enumerate(held)):
                probable = False
            else:
                held[i] = new
        out[entry_id] = probable
    return out


def test_updates_of_many_times_are_settled_in_one_pass():
    rng, rows, want = random.Random(5), [], {}
    for v in range(60):
        own = [(f"v{v // 2}", v % 2, 1000 * v + k, rng.choice("abcdef"), rng.choice("abcdef"), rng.random() < 0.8, rng.random() < 0.8) for k in range(rng.randint(1, 9))]
        rows, want = rows + own, want | walked(own)
    made = pd.DataFrame(rows, columns=["video_id", "seconds", "entry_id", "normalized_song_title", "new_normal", "probable", "changed"])
    for size in (1, 7, len(made)):
        got = pd.concat(clean._settle(made[k : k + size].reset_index(drop=True) for k in range(0, len(made), size)))
        assert dict(zip(got["entry_id"], got["probable"], strict=True)) == want


def test_pruning_calls_no_function_for_each_time(spark):
    _, after = clean.prune(sample.catalogue(spark, SF))
    assert "FlatMapGroupsInPandas" not in plan_of(after.entries) and "rlike" not in plan_of(after.entries).lower()


def test_entries_know_their_songs_without_meeting_them(spark):
    c = sample.catalogue(spark, SF)
    songs, entries = store.rebuilt(c.entries, c.videos)
    named = store.with_song_ids(c.entries, c.videos, store.numbered(store.songs_of(c.entries, c.videos)))
    ids = lambda df: sorted((r.entry_id, str(r.song_id)) for r in df.select("entry_id", "song_id").collect())
    assert ids(entries) == ids(named)
    old = store.numbered(store.songs_of(c.entries, c.videos))
    assert sorted(map(tuple, songs.select(*old.columns).collect())) == sorted(map(tuple, old.collect()))
    odd = spark.createDataFrame([(1, "v", "", "A"), (2, "v", "x", "X"), (3, "w", "x", "x"), (4, "w", None, "n"), (5, "none", "x", "x")], "entry_id long, video_id string, normalized_song_title string, raw_song_title string")
    videos = spark.createDataFrame([("v", "c"), ("w", None)], "video_id string, channel_id string")
    songs, entries = store.rebuilt(odd.withColumn("song_id", F.lit(0)), videos)
    old = store.numbered(store.songs_of(odd, videos))
    assert ids(entries) == ids(store.with_song_ids(odd.withColumn("song_id", F.lit(0)), videos, old))
    assert sorted(map(str, songs.select(*old.columns).collect())) == sorted(map(str, old.collect()))


def test_lines_of_a_video_move_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(store.with_own_songs(sample.entries(spark, SF), sample.videos(spark, SF)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # lines and parts by part, lines by video; orders and customers by customer, videos by video
    assert plan.count("Exchange hashpartitioning") == 6


def test_folding_looks_at_few_ranges():
    assert all(len(text.MAY_BE_MORE) < 60 and any(a <= c <= b for a, b in zip(text.MAY_BE_MORE[1::3], text.MAY_BE_MORE[3::3], strict=True)) for c in text.TO_MORE)


def test_a_video_is_one_value_of_state():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    place, state = ingest.best_comment(2), State()

    def given(*rows):
        frame = pd.DataFrame([(at, json.dumps(rank) if rank else None, f"e{at}" if rank else None) for at, rank in rows], columns=["comment_pos", "rank", "entries"])
        return [tuple(r) for made in place(("v",), iter([frame]), state) for r in made.itertuples(index=False)]

    assert given((5, [False, 40, 2]), (7, None)) == [("v", 5, "e5")]
    assert given((5, [False, 40, 2])) == []  # comes again
    assert given((6, [True, 1040, 2])) == [("v", 6, "e6")] and [r[0] for r in json.loads(state.get[0])] == [5, 6]
    assert given((1, None)) == [("v", 5, "e5")]  # pushes 6 out
    assert given((2, None)) == [] and [r[0] for r in json.loads(state.get[0])] == [1, 2]


def test_grouping_sorts_narrow_rows_and_names_titles_not_entries(spark):
    rows = group.grouped_rows(sample.catalogue(spark, SF))
    scans = [line for line in plan_of(rows).splitlines() if "FileScan" in line and "/grouped-" in line]
    assert scans and all("title:bigint" in line and "video_title" not in line and "raw_song_title" not in line for line in scans)
    twice = rows.union(rows.withColumn("seq", F.col("seq") + 10**12))
    one, two = group.counted_titles(rows), group.counted_titles(twice)
    assert one.count() == two.count() < rows.count() and two.agg(F.sum("n")).first()[0] == 2 * rows.count()
    names = lambda df: sorted(map(str, group.display_titles(df).collect()))
    assert names(one) == names(two) == names(rows.withColumn("n", F.lit(1)))


def test_backfilled_entries_meet_only_songs_of_other_ids(spark):
    c = sample.catalogue(spark, SF)
    songs = c.songs.where("song_id % 3 > 0").withColumn("song_id", F.when(F.col("song_id") % 3 == 1, -F.col("song_id")).otherwise(F.col("song_id")))
    cleared = c.entries.withColumn("song_id", F.when(F.col("entry_id") % 5 == 0, F.col("song_id")))
    after, entries = store.backfilled(cleared, c.videos, songs)
    want = store.with_song_ids(cleared.withColumnRenamed("song_id", "_own"), c.videos, after).withColumn("song_id", F.coalesce("_own", "song_id"))
    ids = lambda df: sorted((r.entry_id, r.song_id) for r in df.select("entry_id", "song_id").collect())
    assert ids(entries) == ids(want) and entries.where("song_id < 0").count() > 0
    assert after.count() == c.songs.count() and not [f for f in entries.inputFiles() if "/songs/" in f]


def test_what_lines_say_is_judged_once(spark):
    odd = ["0:30 KING / A", "1:30 KING / A", "1) 0:30 Set  List", "[3] 0:10 set list / x", " 0:45 タイム スタンプ ", "songs list", "---", "・・ ", "", "0:30 ---", "0:30", "- 1:02:03 [7] Time stamps", "٣) 0:30 ſetlist", "0:30 KING / A\u2003", "MC", "0:50 MC", "KING / A"]
    rows = [(f"v{v}", 0, "\n".join(odd[v % 3 :])) for v in range(40)]
    comments = spark.createDataFrame(rows, "video_id string, comment_pos bigint, text string")
    made = timeline.lines(comments)
    assert "rlike" not in plan_of(made).lower()
    (said,) = {f.rpartition("/")[0] for f in made.inputFiles() if "/said-" in f}
    assert spark.read.parquet(said).count() < len(odd) < made.count()
    each = comments.select("video_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).select("video_id", "line_no", ingest.parsed_line(F.col("line")).alias("x"))
    want = each.select("video_id", "line_no", "x.entry", "x.marker", "x.plain", "x.clock", "x.seconds", "x.raw", "x.normal", "x.separated")
    when = lambda c: F.when(F.col("is_entry"), F.col(c))
    got = made.select("video_id", "line_no", "is_entry", "is_marker", "is_plain", when("timestamp_text"), "seconds", when("raw_song_title"), when("normalized_song_title"), "has_artist")
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))


def test_videos_share_a_state():
    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    place, state = ingest.best_comment(2), State()

    def given(*rows):
        frame = pd.DataFrame([(v, at, json.dumps(rank) if rank else None, f"{v}{at}" if rank else None) for v, at, rank in rows], columns=["video_id", "comment_pos", "rank", "entries"])
        return [tuple(r) for made in place((0,), iter([frame[k : k + 2].reset_index(drop=True) for k in range(0, len(frame), 2)]), state) for r in made.itertuples(index=False)]

    assert given(("v", 5, [False, 40, 2]), ("w", 5, [True, 1040, 2]), ("v", 6, [False, 60, 3]), ("x", 1, None)) == [("v", 6, "v6"), ("w", 5, "w5")]
    assert given(("w", 7, [True, 1060, 3])) == [("w", 7, "w7")]
    assert given(("v", 1, None), ("w", 5, None)) == [("v", 5, "v5")]  # pushes 6 out; w keeps 7
    assert sorted((r[3], r[0]) for r in json.loads(state.get[0])) == [("v", 1), ("v", 5), ("w", 5), ("w", 7), ("x", 1)]


def test_a_batch_judges_texts_once_and_states_stay_dealt(spark, tmp_path):
    landed, out, state = (str(tmp_path / name) for name in ("landed", "out", "state"))
    comments = sample.comments(spark, SF).where("crc32(video_id) % 4 = 0")
    rows = ingest.records(comments)
    assert "rlike" not in plan_of(rows).lower() and rows.count() == comments.count()
    videos = sample.videos(spark, SF)
    some = videos.where("crc32(video_id) % 4 = 0 and crc32(video_id) % 8 = 0")
    comments.union(comments).coalesce(1).write.parquet(f"{landed}/0")  # each comment comes twice in a batch
    ingest.run(spark, f"{landed}/*", out, state, comments.schema, some, all_videos=True)
    states = lambda: spark.read.parquet(f"{state}/states").first().states
    first = states()
    assert 1 <= first == max(1, some.count() // ingest.STATE_VIDEOS) and not (tmp_path / "state" / "records").exists()
    comments.coalesce(1).write.parquet(f"{landed}/1")
    ingest.run(spark, f"{landed}/*", out, state, comments.schema, videos.union(videos.select(F.concat(F.lit("more"), "video_id"), *videos.columns[1:])), all_videos=True)
    assert states() == first
    columns = ["video_id", "entry_id", "seconds", "normalized_song_title"]
    rows_of = lambda df: sorted(tuple(r) for r in df.select(*columns).collect())
    assert rows_of(spark.read.parquet(out)) == rows_of(timeline.index(comments, videos, all_videos=True))


def test_entries_that_stay_meet_the_touched_videos_only(spark):
    columns = "entry_id long, video_id string, seconds long, normalized_song_title string, raw_song_title string, song_id long"
    entries = spark.createDataFrame([(1, "v", 1, "x", "X", 7), (2, "w", 1, "x", "X", 7), (3, "w", 2, "x", "x", None), (4, "none", 1, "y", "Y", 8), (5, "v", 2, "z", "Z", 9)], columns)
    videos = spark.createDataFrame([("v", "c"), ("w", "c")], "video_id string, channel_id string")
    songs = spark.createDataFrame([(7, "c", "X", "x"), (8, "c", "Y", "y"), (9, "c", "Z", "z")], "song_id long, channel_id string, canonical_song_title string, normalized_song_title string")
    new = spark.createDataFrame([(6, "v", 3, "x", "X", None), (7, "v", 4, "z", "Zed", None)], columns)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        after, replaced = store.replace_videos(entries, new, songs, videos)
        kept = plan_of(replaced).split("SortMergeJoin")[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in kept.splitlines()[0]  # nothing stands between it and the result
    named = {r.normalized_song_title: r for r in after.collect()}
    assert set(named) == {"x", "y", "z"} and named["x"].song_id == 7 and named["z"].song_id != 9 and named["z"].canonical_song_title == "Zed"
    assert {r.entry_id: r.song_id for r in replaced.collect()} == {2: 7, 3: None, 4: 8, 6: 7, 7: named["z"].song_id}


def test_many_touched_videos_are_hashed(spark, monkeypatch):
    c = sample.catalogue(spark, SF)
    new = c.entries.where("entry_id % 3 = 0").withColumn("seconds", F.col("seconds") + 1)
    got = lambda: sorted(map(str, store.replace_videos(c.entries, new, c.songs, c.videos)[1].select(*c.entries.columns).collect()))
    sorted_ = got()
    monkeypatch.setattr(store, "MOST_SORTED", 0)
    assert "ShuffledHashJoin [video_id" in plan_of(store.replace_videos(c.entries, new, c.songs, c.videos)[1]) and got() == sorted_
