"""Clean-up of stored entries: those that are no songs, and timelines that a better comment has."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.operators import store, timeline
from cuesheet.scratch import keep
from cuesheet.sources.sample import Catalogue


def doubtful_entries(c: Catalogue) -> DataFrame:
    """(entry_id, raw_song_title, entry_count, video_id): the only entries of their songs that look doubtful, by the songs that they have now."""
    counted = c.entries.where("song_id is not null").groupBy("song_id").agg(F.count("entry_id").alias("entry_count"), F.max(F.struct("entry_id", "raw_song_title", "video_id")).alias("only"))
    rows = counted.where("entry_count <= 1").join(c.songs.select("song_id", F.col("normalized_song_title").alias("song_normal")), "song_id")
    rows = rows.where(text.is_doubtful(F.col("only.raw_song_title"), F.col("song_normal")))
    return rows.select("only.entry_id", "only.raw_song_title", "entry_count", "only.video_id")


TIME = ["video_id", "seconds"]
TITLE = ["raw_song_title", "normalized_song_title"]


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(video_id, entry_id, probable) of rows that come by time of a video and entry_id: an update whose new key another row holds at that time fails, and its row goes."""
    rest = None
    for batch in chain(batches, [None]):
        rows = rest if batch is None else batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rows is None or rows.empty:
            continue
        same = rows["video_id"].eq(rows["video_id"].shift()) & rows["seconds"].eq(rows["seconds"].shift())
        starts = (~same).to_numpy().nonzero()[0].tolist()
        done = len(rows) if batch is None else starts[-1]  # the last time may go on in the next batch
        probable = rows["probable"].tolist()
        held, new, changed = rows["normalized_song_title"].tolist(), rows["new_normal"].tolist(), rows["changed"].tolist()
        for start, end in zip(starts, [*starts[1:], len(rows)], strict=True):
            if start >= done:
                break
            holders = Counter(held[start:end])
            for i in range(start, end):
                if probable[i] and changed[i]:
                    if holders[new[i]] > (held[i] == new[i]):
                        probable[i] = False
                    else:
                        holders[held[i]] -= 1
                        holders[new[i]] += 1
        yield pd.DataFrame({"video_id": rows["video_id"][:done], "entry_id": rows["entry_id"][:done], "probable": probable[:done]})
        rest = rows[done:].reset_index(drop=True)


def _cleaned(entries: DataFrame) -> DataFrame:
    """(*TITLE, new_raw, new_normal, probable, changed, meets) of each different title; meets: the title is updated, or is one that updated ones get."""
    made = entries.select(*TITLE).distinct().withColumn("new_raw", text.clean_title(F.col("raw_song_title")))
    made = made.withColumn("new_normal", text.normalize_title(F.col("new_raw")))
    made = made.withColumn("probable", text.is_probable_title(F.col("new_raw"), F.col("new_normal")))
    made = keep(made.withColumn("changed", (F.col("new_raw") != F.col("raw_song_title")) | (F.col("new_normal") != F.col("normalized_song_title"))), "cleaned")
    got = made.where("changed and probable").select(F.col("new_normal").alias("normalized_song_title"), F.lit(True).alias("_got")).distinct()
    made = made.join(got, "normalized_song_title", "left")
    return keep(made.withColumn("meets", F.coalesce(F.col("changed") & F.col("probable"), F.lit(False)) | F.coalesce("_got", F.lit(False))).drop("_got"), "titles")


def prune(c: Catalogue) -> tuple[DataFrame, Catalogue]:
    """(entries to drop, catalogue without them and with songs made anew). Kept entries get their cleaned titles.

    Titles are cleaned once each. Only entries whose titles are updated, or are what others become, can meet at a time; all
    others move once, by video, to lose those of its entries that are dropped.
    """
    made = _cleaned(c.entries)
    equal = [F.col(f"e.{t}").eqNullSafe(F.col(f"m.{t}")) for t in TITLE]
    rows = c.entries.alias("e").join(made.alias("m"), equal).select("e.*", "new_raw", "new_normal", "probable", "changed", "meets")
    meeting = keep(rows.where("meets").select(*TIME, "entry_id", "normalized_song_title", "new_normal", "probable", "changed"), "meeting")
    disputed = meeting.join(meeting.where("changed and probable").select(*TIME).distinct(), TIME, "left_semi")
    disputed = disputed.repartition(*TIME).sortWithinPartitions(*TIME, "entry_id")
    failed = disputed.mapInPandas(_settle, "video_id string, entry_id long, probable boolean").where("not probable")
    lost = rows.where("not probable").select("video_id", "entry_id").union(failed.select("video_id", "entry_id"))
    bad = keep(lost.union(doubtful_entries(c).select("video_id", "entry_id")).distinct(), "bad")
    dropped = bad.groupBy("video_id").agg(F.collect_set("entry_id").alias("_dropped"))
    kept = rows.join(dropped, "video_id", "left").where(~F.coalesce(F.array_contains("_dropped", F.col("entry_id")), F.lit(False)))
    kept = kept.withColumn("raw_song_title", F.col("new_raw")).withColumn("normalized_song_title", F.col("new_normal")).select(*c.entries.columns)
    songs, entries = store.rebuilt(kept, c.videos)
    return bad.select("entry_id"), Catalogue(c.channels, c.videos, songs, entries)


def rebuild_best(stored: DataFrame, comments: DataFrame) -> DataFrame:
    """One row of counts after each video keeps only its best stored comment: videos_changed, entries_before, _after, _removed.

    stored are entries (video_id, ...); comments are the distinct stored comments (video_id,
    text), of which equally good ones are taken in order of their text.
    """
    place = Window.partitionBy("video_id").orderBy("text")
    rows = comments.select("video_id", "text").distinct().withColumn("comment_pos", F.row_number().over(place).cast("bigint"))
    new = store.insert_ignore(timeline.best_entries(rows)).groupBy("video_id").agg(F.count(F.lit(1)).alias("new"))
    old = stored.groupBy("video_id").agg(F.count(F.lit(1)).alias("old"))
    both = old.join(new, "video_id", "full")
    after = F.coalesce("new", "old")
    counts = both.agg(F.count("new").alias("videos_changed"), F.coalesce(F.sum("old"), F.lit(0)).alias("entries_before"), F.coalesce(F.sum(after), F.lit(0)).alias("entries_after"))
    return counts.withColumn("entries_removed", F.col("entries_before") - F.col("entries_after"))
