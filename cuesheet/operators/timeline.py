"""From comments to timeline entries: lines, blocks of consecutive entries, and the best comment of each video.

Comments are rows (video_id, comment_pos, text). Everything is windows within one
comment or one video, so nothing wider than a comment meets in a task.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions import text
from cuesheet.functions.text import CLOCK, SPACE, rx
from cuesheet.operators.store import insert_ignore
from cuesheet.scratch import drop, keep

COMMENT = ["video_id", "comment_pos"]
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
LINE = rx(rf"^{SPACE}*(?:[-*+>~#]|\d+[.)\]]|\[{SPACE}*\d+{SPACE}*\])?{SPACE}*({CLOCK}){SPACE}*(.+?){SPACE}*\z")
SKIPPED = 5


def lines(comments: DataFrame) -> DataFrame:
    """A row for each line of each comment: line_no (from 0), timestamp_text, seconds, said (what follows the clock time; without one the whole line), titles, and what the line is.

    Lines are written once, and what is said is looked into once, however many lines say it.
    """
    rows = comments.select(*COMMENT, F.posexplode(F.split("text", LINE_END)).alias("line_no", "line"))
    clock = F.regexp_extract("line", LINE, 1)
    rows = text.settled(rows.withColumn("timestamp_text", F.when(clock != "", clock)), ["timestamp_text"])
    timed = F.col("timestamp_text").isNotNull()
    rows = keep(rows.select(*COMMENT, "line_no", "timestamp_text", timed.alias("timed"), F.when(timed, F.regexp_extract("line", LINE, 2)).otherwise(F.col("line")).alias("said")), "lines")
    rows = rows.join(_judged(rows.select("timed", "said").distinct()), ["timed", "said"])
    return rows.withColumn("seconds", F.when(F.col("is_entry"), text.seconds(F.col("timestamp_text")))).drop("timed")


def _judged(said: DataFrame) -> DataFrame:
    """said (timed, said) with titles, is_entry, is_marker, is_plain and has_artist, written.

    Marks and clock times hold no letters, so a marker is in what follows them if it is in the line; and a line with a clock time is never blank.
    """
    rows = said.withColumn("raw_song_title", F.when(F.col("timed"), text.clean_title(F.col("said"))))
    rows = text.settled(rows.withColumn("normalized_song_title", text.normalize_title(F.col("raw_song_title"))), ["raw_song_title", "normalized_song_title"])
    entry = F.coalesce(text.is_probable_title(F.col("raw_song_title"), F.col("normalized_song_title")), F.lit(False))
    rows = rows.withColumn("is_entry", entry).withColumn("is_marker", text.is_marker(F.col("said")))
    rows = rows.withColumn("is_plain", ~F.col("is_entry") & ~F.col("is_marker") & (F.col("timed") | ~text.is_blank_or_decoration(F.col("said"))))
    rows = rows.withColumn("has_artist", F.col("is_entry") & text.has_separator(F.coalesce("raw_song_title", F.lit(""))))
    return keep(rows, "said")


def entry_lines(comments: DataFrame) -> DataFrame:
    """The lines that are entries, whatever their comment."""
    return lines(comments).where("is_entry").select(*COMMENT, "line_no", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title")


def located(comments: DataFrame, together: list[str] = COMMENT) -> DataFrame:
    """lines() of comments, dealt by the columns in together, with at least two clock times, with has_marker, run (number of lines so far that are no entries), starts (whether a block
    starts here), and of the entries from here to the end of the run: n_entries, span, artist_lines.

    In a comment with marker lines a block starts at the first entry after each marker, if
    at most SKIPPED other lines come before it; in one without, after every line that is no entry.
    """
    rows = lines(comments.where(text.clock_count(F.col("text")) >= 2)).drop("said").repartition(*together)
    line = Window.partitionBy(*COMMENT).orderBy("line_no")
    so_far, before = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "run": F.sum((~F.col("is_entry")).cast("int")).over(so_far),
        "plain_lines": F.sum(F.col("is_plain").cast("int")).over(so_far),
        "has_marker": F.max("is_marker").over(Window.partitionBy(*COMMENT)),
        "last_marker": F.max(F.when(F.col("is_marker"), F.col("line_no"))).over(so_far),
        "last_entry": F.coalesce(F.max(F.when(F.col("is_entry"), F.col("line_no"))).over(before), F.lit(-1)),
    })
    rows = rows.withColumn("plain_at_marker", F.max(F.when(F.col("is_marker"), F.col("plain_lines"))).over(so_far))
    after_marker = (F.col("last_marker") > F.col("last_entry")) & (F.col("plain_lines") - F.col("plain_at_marker") <= SKIPPED)
    first_of_run = (F.col("last_entry") < 0) | (F.col("last_entry") != F.col("line_no") - 1)
    starts = F.col("is_entry") & F.coalesce(F.when(F.col("has_marker"), after_marker).otherwise(first_of_run), F.lit(False))
    rest = Window.partitionBy(*COMMENT, "run").orderBy("line_no").rowsBetween(0, Window.unboundedFollowing)
    own = F.when(F.col("is_entry"), F.col("seconds"))
    return rows.withColumns({
        "starts": starts,
        "n_entries": F.sum(F.col("is_entry").cast("int")).over(rest).cast("bigint"),
        "span": F.max(own).over(rest) - F.min(own).over(rest),
        "artist_lines": F.sum(F.col("has_artist").cast("int")).over(rest).cast("bigint"),
    }).drop("plain_lines", "last_marker", "last_entry", "plain_at_marker")


def blocks(comments: DataFrame) -> DataFrame:
    """Blocks of at least two consecutive entries: run and start_line (where the block's entries are), n_entries, span, artist_lines, has_marker."""
    found = located(comments).where(F.col("starts") & (F.col("n_entries") >= 2))
    return found.select(*COMMENT, F.col("line_no").alias("start_line"), "run", "n_entries", "span", "artist_lines", "has_marker")


def scored() -> Column:
    return (F.col("has_marker").cast("int") * 1000 + F.col("n_entries") * 20 + F.col("artist_lines") * 3 + F.least(F.floor(F.col("span") / 600), F.lit(20))).cast("bigint")


def candidates(comments: DataFrame) -> DataFrame:
    """The best block of each comment that has one, by entries, then span, then place; with its score."""
    best = Window.partitionBy(*COMMENT).orderBy(F.desc("n_entries"), F.desc("span"), "start_line")
    return blocks(comments).withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n").withColumn("score", scored())


def best_comments(found: DataFrame) -> DataFrame:
    """The best candidate of each video: with a marker, then by score, then entries, then place."""
    order = Window.partitionBy("video_id").orderBy(F.desc("has_marker"), F.desc("score"), F.desc("n_entries"), "comment_pos")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_block_lines(comments: DataFrame, together: list[str] = COMMENT) -> DataFrame:
    """The lines of each comment's best block, as candidates() chooses it, in one pass over the lines: with n_entries, span, minus_line (of the block's first line), artist_lines, has_marker and score of the block."""
    rows = located(comments, together)
    rank = F.struct("n_entries", "span", (-F.col("line_no")).alias("minus_line"), "artist_lines", "run", "has_marker")
    head = F.when(F.col("starts") & (F.col("n_entries") >= 2), rank)
    rows = rows.withColumn("block", F.max(head).over(Window.partitionBy(*COMMENT))).where(F.col("block").isNotNull() & F.col("is_entry"))
    rows = rows.select(*COMMENT, "line_no", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title", F.col("run").alias("own_run"), "block.*")
    return rows.where((F.col("own_run") == F.col("run")) & (F.col("line_no") >= -F.col("minus_line"))).withColumn("score", scored())


def best_entries(comments: DataFrame) -> DataFrame:
    """The entries of best_comments(candidates(comments)), one row each, in one pass over the lines; entry_id is the line's number in its comment, and heads says that it is the first of its video's."""
    rows = best_block_lines(comments, ["video_id"])
    order = F.struct("has_marker", "score", "n_entries", (-F.col("comment_pos")).alias("minus_pos"))
    kept = rows.withColumn("order", order).withColumn("best", F.max("order").over(Window.partitionBy("video_id"))).where("order = best")
    return kept.select("video_id", "comment_pos", F.col("line_no").cast("bigint").alias("entry_id"), "timestamp_text", "seconds", "raw_song_title", "normalized_song_title", (F.col("line_no") == -F.col("minus_line")).alias("heads"))


def index(comments: DataFrame, videos: DataFrame, max_comments: int | None = 100, all_videos: bool = False) -> DataFrame:
    """The entries that indexing stores: of each wanted video the best comment's, first of equal keys, with jump URLs.

    Only the first max_comments comments of a video are looked at; without all_videos only
    videos whose title looks like a song stream.
    """
    found = best_entries(_looked_at(comments, _wanted(videos, all_videos), max_comments))
    return _stored(found).drop("heads")


def _stored(found: DataFrame) -> DataFrame:
    return insert_ignore(found).withColumn("jump_url", text.jump_url(F.col("video_id"), F.col("seconds")))


def _wanted(videos: DataFrame, all_videos: bool) -> DataFrame:
    return videos if all_videos else videos.where(text.is_stream_title(F.col("title")))


def _looked_at(comments: DataFrame, wanted: DataFrame, max_comments: int | None) -> DataFrame:
    rows = comments.join(wanted.select("video_id"), "video_id", "left_semi")
    return rows if max_comments is None else capped(rows, ["video_id"], "comment_pos", max_comments)


COUNTERS = ("videos_seen", "videos_indexed", "videos_skipped", "comments_seen", "timeline_comments", "entries_inserted")


def index_run(comments: DataFrame, videos: DataFrame, max_comments: int | None = 100, all_videos: bool = False, disabled: DataFrame | None = None) -> tuple[DataFrame, dict[str, int]]:
    """(entries, counters) of a run: index(), written once, and what was counted while it was written.

    The counters are observed in the indexing plan itself, so comments are read and parsed once. A video whose comments are
    disabled (video_id) is indexed and skipped, both. timeline_comments: videos with a timeline.
    """
    spark = videos.sparkSession
    seen, looked, written = Observation(), Observation(), Observation()
    one = F.count(F.lit(1))
    streamed = F.lit(True) if all_videos else F.coalesce(text.is_stream_title(F.col("title")), F.lit(False))
    off = spark.createDataFrame([], "video_id string") if disabled is None else disabled.select("video_id").distinct()
    marked = videos.join(off.withColumn("_off", F.lit(True)), "video_id", "left").withColumn("_streamed", streamed)
    marked = marked.observe(seen, one.alias("videos_seen"), F.count_if("_streamed").alias("videos_indexed"), F.count_if(~F.col("_streamed") | F.col("_off")).alias("videos_skipped"))
    wanted = keep(marked.where(F.col("_streamed") & F.col("_off").isNull()).select("video_id"), "wanted")
    rows = _looked_at(comments, wanted, max_comments).observe(looked, one.alias("comments_seen"))
    found = _stored(best_entries(rows)).observe(written, one.alias("entries_inserted"), F.count_if("heads").alias("timeline_comments"))
    entries = keep(found.drop("heads"), "entries")
    counted = _observed(seen) | _observed(looked) | _observed(written)
    drop(wanted)
    return entries, {k: counted.get(k) or 0 for k in COUNTERS}


def _observed(counted: Observation) -> dict[str, int]:
    """What was counted; nothing if the plan was found empty before it ran."""
    try:
        return counted.get
    except Py4JJavaError:
        return {}


def stats_row(spark: SparkSession, counters: dict[str, int]) -> DataFrame:
    """Counters as a row."""
    return spark.createDataFrame([tuple(counters[k] for k in COUNTERS)], ", ".join(f"{k} long" for k in COUNTERS))


def merged_stats(total: dict[str, int], child: dict[str, int]) -> dict[str, int]:
    """total with a child's counters added, all but videos_seen: the caller has counted the videos that it saw."""
    return {k: total[k] + (child[k] if k != "videos_seen" else 0) for k in COUNTERS}


def capped(rows: DataFrame, parent: list[str], order: str, n: int) -> DataFrame:
    """The first n rows of each parent."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*parent).orderBy(order))).where(F.col("_n") <= n).drop("_n")
