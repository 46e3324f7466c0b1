"""Incremental indexing: comments as a stream of landed files, with the candidates of each video as keyed state.

Two streams work one after the other, each with a checkpoint of its own. The first takes a batch's
comments and finds the best block of each without state, as the batch index does: what lines say is
judged once for each different text. It writes a record a comment, to files that go when the second
stream has them. The second keeps, for each video (applyInPandasWithState, RocksDB), the records of
the comments that were looked at: their places, and their best blocks of entries if they have one. A call
costs Spark's Python worker some milliseconds, whatever it does, so STATE_VIDEOS videos or so share a state
and a call; their number of states is set when the index is new. Only the first max_comments places of a
video count, so it has at most that many records, whichever batches and order they came in; a comment
that comes again replaces itself. When the video's best comment changes, its entries are given out and
replace the video's entries in the stored table, in the buckets of the touched videos only. The work of
a batch follows its own comments and the states that they share, not all those of earlier ones.

Written entries may lag behind the state by one batch if a run breaks off; the next run
repeats that batch with the same result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from cuesheet import scratch
from cuesheet.functions import text
from cuesheet.operators import store, timeline

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BLOCK = "array<struct<entry_id: long, clock: string, seconds: long, raw: string, normal: string>>"
RECORD = "video_id string, comment_pos long, rank string, entries string"
BUCKETS = 64
STATE_VIDEOS = 128


def parsed_line(line: Column) -> Column:
    """One line as a struct: what timeline.lines() says of it. This, parsed() and best_block() are the plain walk that the windows have to agree with."""

    def kinds(x: Column) -> Column:
        entry = F.coalesce(text.is_probable_title(x["raw"], x["normal"]), F.lit(False))
        marker = text.is_marker(line)
        return text.let(entry, lambda e: F.struct(
            e.alias("entry"), marker.alias("marker"), (~e & ~marker & ~text.is_blank_or_decoration(line)).alias("plain"),
            F.when(e, x["clock"]).alias("clock"), F.when(e, text.seconds(x["clock"])).alias("seconds"), F.when(e, x["raw"]).alias("raw"), F.when(e, x["normal"]).alias("normal"),
            (e & text.has_separator(F.coalesce(x["raw"], F.lit("")))).alias("separated"),
        ))

    def titled(clock: Column) -> Column:
        raw = F.when(clock != "", text.clean_title(F.regexp_extract(line, timeline.LINE, 2)))
        return text.let(raw, lambda r: text.let(F.struct(F.when(clock != "", clock).alias("clock"), r.alias("raw"), text.normalize_title(r).alias("normal")), kinds))

    return text.let(F.regexp_extract(line, timeline.LINE, 1), titled)


def parsed(comments: DataFrame) -> DataFrame:
    """(video_id, comment_pos, lines) of comments; comments with fewer than two clock times have no lines that matter."""
    lines = F.transform(F.split("text", timeline.LINE_END), parsed_line)
    return comments.select("video_id", F.col("comment_pos").cast("long").alias("comment_pos"), F.when(text.clock_count(F.col("text")) >= 2, lines).alias("lines"))


def best_block(lines: list[dict]) -> dict | None:
    """The best block of a comment's lines, as timeline.candidates() chooses it: its rank among a video's comments, and its entries."""
    marked, best = any(x["marker"] for x in lines), None
    last_entry, last_marker, plain, plain_at_marker = -1, -1, 0, 0
    for at, x in enumerate(lines):
        plain += x["plain"]
        if x["marker"]:
            last_marker, plain_at_marker = at, plain
        if not x["entry"]:
            continue
        starts = last_marker > last_entry and plain - plain_at_marker <= timeline.SKIPPED if marked else last_entry < 0 or last_entry != at - 1
        last_entry = at
        if not starts:
            continue
        end = next((k for k in range(at, len(lines)) if not lines[k]["entry"]), len(lines))
        times = [y["seconds"] for y in lines[at:end]]
        found = (end - at, max(times) - min(times), -at)
        if end - at >= 2 and (best is None or found > best):
            best = found
    if best is None:
        return None
    n, span, at = best[0], best[1], -best[2]
    entries = [{"entry_id": k, **{c: lines[k][c] for c in ("clock", "seconds", "raw", "normal")}} for k in range(at, at + n)]
    score = 1000 * marked + 20 * n + 3 * sum(bool(y["separated"]) for y in lines[at : at + n]) + min(int(span // 600), 20)
    return {"rank": [marked, score, n], "entries": entries}


def records(comments: DataFrame) -> DataFrame:
    """(video_id, comment_pos, rank, entries) of comments: the rank among a video's comments and the entries of the best block, as JSON; null without one."""
    lines = timeline.best_block_lines(comments)
    entry = F.struct(F.col("line_no").cast("long").alias("entry_id"), F.col("timestamp_text").alias("clock"), "seconds", F.col("raw_song_title").alias("raw"), F.col("normalized_song_title").alias("normal"))
    rank = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("has_marker", "score", "n_entries")]), F.lit("]"))
    found = lines.groupBy(*timeline.COMMENT).agg(F.first(rank).alias("rank"), F.to_json(F.sort_array(F.collect_list(entry))).alias("entries"))
    return comments.select(*timeline.COMMENT).join(found, timeline.COMMENT, "left")


def best_comment(most: int | None) -> Callable:
    """A function for applyInPandasWithState: per state the records (place, rank, entries, video) of the first `most` comments of its videos, and what was given out last.

    A state's rows name their videos; without a column video_id they are of the one that the key names.
    """

    def place(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        records, given = map(json.loads, state.get) if state.exists else ([], {})
        known: dict[str, dict] = {}
        for r in records:
            known.setdefault(r[3], {})[r[0]] = r
        touched = set()
        for frame in frames:
            of = frame["video_id"].tolist() if "video_id" in frame else [key[0]] * len(frame)
            for video, at, rank, entries in zip(of, frame["comment_pos"].tolist(), frame["rank"].tolist(), frame["entries"].tolist(), strict=True):
                known.setdefault(video, {})[at] = [at, json.loads(rank), entries, video] if isinstance(rank, str) else [at, None, None, video]
                touched.add(video)
        out = []
        for video in sorted(touched):
            first = [known[video][at] for at in sorted(known[video])[:most]]
            known[video] = {r[0]: r for r in first}
            best = max((r for r in first if r[1]), key=lambda r: (r[1], -r[0]), default=None)
            now = [best[0], hashlib.md5(best[2].encode()).hexdigest()] if best else None
            if best and now != given.get(video):
                given[video] = now
                out.append((video, best[0], best[2]))
        state.update((json.dumps([r for of in known.values() for r in of.values()]), json.dumps(given)))
        if out:
            yield pd.DataFrame(out, columns=["video_id", "comment_pos", "entries"])

    return place


def best_comments(rows: DataFrame, most: int | None, states: int) -> DataFrame:
    """The entries of each video whose best comment changes. The videos are dealt to so many states."""
    shared = rows.withColumn("state", (F.crc32(F.col("video_id").cast("binary")) % states).cast("int"))
    given = shared.groupBy("state").applyInPandasWithState(best_comment(most), "video_id string, comment_pos long, entries string", "records string, given string", "update", GroupStateTimeout.NoTimeout)
    made = given.select("video_id", "comment_pos", F.inline(F.from_json("entries", BLOCK)))
    return made.toDF("video_id", "comment_pos", "entry_id", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title")


def _states(spark: SparkSession, path: str, wanted: DataFrame) -> int:
    """How many states an index has: set once, by the number of its first videos, as a video has to stay in its state."""
    if not scratch.exists(spark, f"{path}/_SUCCESS"):
        spark.range(1).select(F.lit(max(1, wanted.count() // STATE_VIDEOS)).alias("states")).coalesce(1).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).first().states


def run(spark: SparkSession, landed: str, out: str, state: str, schema: StructType, videos: DataFrame, max_comments: int | None = 100, all_videos: bool = False, files_a_batch: int = 1000, buckets: int = BUCKETS) -> None:
    """Index all comment files under landed that weren't read before, into the table of entries at out."""
    wanted = (videos if all_videos else videos.where(text.is_stream_title(F.col("title")))).select("video_id").distinct()
    wanted = scratch.keep(wanted, "wanted")
    states = _states(spark, f"{state}/states", wanted)
    parsed_at = f"{state}/records"
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)

    def parse(comments: DataFrame, number: int) -> None:
        path = f"{parsed_at}/{number}"
        scratch.remove(spark, path)  # of a run that broke off
        once = lambda: scratch.keep(comments.join(wanted, "video_id", "left_semi").withColumn("comment_pos", F.col("comment_pos").cast("long")).dropDuplicates(timeline.COMMENT), "batch")
        scratch.settled(lambda: records(once()), "records", path)

    def write(entries: DataFrame, number: int) -> None:
        kept = store.insert_ignore(entries).withColumn("jump_url", text.jump_url(F.col("video_id"), F.col("seconds")))
        store.replace_in_place(kept, out, buckets)

    def follow(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
        rows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(landed)
        follow(stream, parse, f"{state}/parsing")
        if scratch.exists(spark, parsed_at):
            stream = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", files_a_batch).parquet(f"{parsed_at}/*")
            follow(best_comments(stream, max_comments, states), write, state)
            scratch.remove(spark, parsed_at)
    finally:
        scratch.drop(wanted)
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
