"""Landed API responses as rows: uploads, videos, comments and channels, from one JSON payload a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet import scratch
from cuesheet.functions import text

from . import paged, sample
from .sample import read

SNIPPET = "title string, channelId string, channelTitle string, publishedAt string, videoOwnerChannelId string, videoOwnerChannelTitle string"
UPLOADS = f"struct<items: array<struct<snippet: struct<{SNIPPET.replace(' string', ': string')}>, contentDetails: struct<videoId: string, videoPublishedAt: string>>>>"
VIDEOS = f"struct<items: array<struct<id: string, snippet: struct<{SNIPPET.replace(' string', ': string')}>>>>"
COMMENTS = "struct<items: array<struct<id: string, snippet: struct<topLevelComment: struct<id: string, snippet: struct<textDisplay: string, authorDisplayName: string, publishedAt: string>>>>>>"
CHANNELS = "struct<items: array<struct<id: string, snippet: struct<title: string>, contentDetails: struct<relatedPlaylists: struct<uploads: string>>>>>"


def given(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def items(payloads: DataFrame, schema: str) -> DataFrame:
    """A row for each item of each payload (page_no, payload), with its place in its page. What isn't JSON has no items."""
    parsed = payloads.withColumn("_page", F.from_json("payload", schema))
    return parsed.select(*[c for c in payloads.columns if c != "payload"], F.posexplode("_page.items").alias("item_no", "item"))


def uploads(payloads: DataFrame) -> DataFrame:
    """Uploaded videos in page order; items without a video id are left out."""
    return uploads_of(items(payloads, UPLOADS))


def uploads_of(rows: DataFrame, *carry: str) -> DataFrame:
    """uploads() of items, with the columns named in carry."""
    s, d = F.col("item.snippet"), F.col("item.contentDetails")
    return rows.where(F.coalesce(d["videoId"], F.lit("")) != "").select(
        *carry, "page_no", "item_no", d["videoId"].alias("video_id"), F.coalesce(s["title"], F.lit("")).alias("title"),
        F.coalesce(given(s["videoOwnerChannelId"]), s["channelId"], F.lit("")).alias("channel_id"),
        F.coalesce(given(s["videoOwnerChannelTitle"]), s["channelTitle"], F.lit("")).alias("channel_title"),
        F.coalesce(given(d["videoPublishedAt"]), s["publishedAt"]).alias("published_at"),
    )


def videos(payloads: DataFrame) -> DataFrame:
    """Videos by id; missing fields are empty, a missing date is null."""
    s = F.col("item.snippet")
    fields = [F.coalesce(s[n], F.lit("")).alias(a) for n, a in (("title", "title"), ("channelId", "channel_id"), ("channelTitle", "channel_title"))]
    return items(payloads, VIDEOS).select(F.col("item.id").alias("video_id"), *fields, s["publishedAt"].alias("published_at"))


def comments(payloads: DataFrame) -> DataFrame:
    """Top-level comments of payloads (video_id, page_no, payload); comment_pos is their place over all pages of a video."""
    c = F.col("item.snippet.topLevelComment")
    rows = items(payloads, COMMENTS).withColumn("comment_pos", (F.col("page_no") * 1000 + F.col("item_no")).cast("bigint"))
    return rows.select("video_id", "comment_pos", c["id"].alias("comment_id"), F.coalesce(c["snippet"]["textDisplay"], F.lit("")).alias("text"), F.coalesce(c["snippet"]["authorDisplayName"], F.lit("")).alias("author"), c["snippet"]["publishedAt"].alias("published_at"))


def channels(payloads: DataFrame) -> DataFrame:
    """Channels that have an uploads playlist."""
    rows = items(payloads, CHANNELS).select(F.col("item.id").alias("channel_id"), F.coalesce("item.snippet.title", F.lit("")).alias("channel_title"), F.col("item.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist_id"))
    return rows.where(F.coalesce("uploads_playlist_id", F.lit("")) != "")


def resolved(inputs: DataFrame, pages: DataFrame, answers: DataFrame) -> DataFrame:
    """(channel, channel_id, channel_title, uploads_playlist_id, asked) for each input (channel): what it names, null if nothing.

    A URL that doesn't name an id is looked up in pages (url, html) first, and only the id in its page
    counts if it has one. Else what names an id is asked as id, and anything else as handle, as it is and
    then with @. answers (kind: id or handle, key, payload) are the API's; one without an uploads
    playlist is no answer. asked: the kind and key that answered.
    """
    bare = text.strip(F.col("channel"))
    named = inputs.select("channel", bare.alias("_bare"), text.channel_input(F.col("channel")).alias("_named"), bare.rlike("(?i)^https?://").alias("_url")).distinct()
    looked = named.join(pages.select(F.col("url").alias("_bare"), text.channel_id_of_page(F.col("html")).alias("_page_id")).groupBy("_bare").agg(F.max("_page_id").alias("_page_id")), "_bare", "left")
    name, is_id = F.col("_named"), F.col("_named").startswith("UC")
    ask = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    candidates = (
        F.when(F.col("_url") & ~is_id & F.col("_page_id").isNotNull(), F.array(ask("id", F.col("_page_id"))))
        .when(is_id, F.array(ask("id", name)))
        .when(name.startswith("@"), F.array(ask("handle", name)))
        .otherwise(F.array(ask("handle", name), ask("handle", F.concat(F.lit("@"), name))))
    )
    tried = looked.select("channel", F.posexplode(candidates).alias("at", "c")).select("channel", "at", "c.kind", "c.key")
    first = items(answers, CHANNELS).where("item_no = 0")
    known = first.select("kind", "key", F.col("item.id").alias("channel_id"), F.coalesce("item.snippet.title", F.lit("")).alias("channel_title"), F.col("item.contentDetails.relatedPlaylists.uploads").alias("uploads_playlist_id"))
    known = known.where(F.coalesce("uploads_playlist_id", F.lit("")) != "")
    found = tried.join(known, ["kind", "key"], "left")
    answer = F.struct("channel_id", "channel_title", "uploads_playlist_id", F.concat_ws(" ", "kind", "key").alias("asked"))
    best = found.groupBy("channel").agg(F.min_by(answer, F.when(F.col("channel_id").isNotNull(), F.col("at"))).alias("a"))
    return best.select("channel", "a.*")


def sample_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload pages made of the customers, fifty a page, some fields missing or empty."""
    key = F.col("c_custkey")
    snippet = F.struct(
        F.col("c_name").alias("title"), F.col("c_mktsegment").alias("channelId"), F.lit("shared").alias("channelTitle"), F.lit("2024-01-01").alias("publishedAt"),
        F.when(key % 3 == 0, "").when(key % 3 == 1, F.concat(F.lit("UC"), F.col("c_nationkey").cast("string"))).alias("videoOwnerChannelId"),
    )
    details = F.struct(F.when(key % 7 > 0, F.concat(F.lit("c"), key.cast("string"))).alias("videoId"), F.when(key % 5 > 0, "2024-02-02").alias("videoPublishedAt"))
    rows = read(spark, sf_dir, "customer").select((key / 50).cast("bigint").alias("page_no"), key, F.struct(snippet.alias("snippet"), details.alias("contentDetails")).alias("item"))
    pages = rows.groupBy("page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "item"))), lambda x: x["item"]).alias("items"))
    return pages.select("page_no", F.to_json(F.struct("items")).alias("payload"))


def sample_video_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each of the sample's videos, some fields missing."""
    n = F.regexp_extract("video_id", "[0-9]+", 0).cast("bigint")
    snippet = F.struct(F.when(n % 5 > 0, F.col("title")).alias("title"), F.col("channel_id").alias("channelId"), F.when(n % 7 > 0, F.col("channel_title")).alias("channelTitle"), F.col("published_at").alias("publishedAt"))
    rows = sample.videos(spark, sf_dir).join(sample.channels(spark, sf_dir), "channel_id")
    return rows.select(F.lit(0).alias("page_no"), F.to_json(F.struct(F.array(F.struct(F.col("video_id").alias("id"), snippet.alias("snippet"))).alias("items"))).alias("payload"))


def sample_comment_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of comments for each of the sample's videos, some texts and dates missing."""
    name = F.concat_ws("-", "video_id", F.col("comment_pos").cast("string"))
    n = F.char_length("text")
    snippet = F.struct(F.when(n % 9 > 0, F.col("text")).alias("textDisplay"), F.when(n % 2 > 0, F.lit("someone")).alias("authorDisplayName"), F.when(n % 3 > 0, F.lit("2024-03-03")).alias("publishedAt"))
    item = F.struct(F.lit("thread").alias("id"), F.struct(F.struct(name.alias("id"), snippet.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    pages = sample.comments(spark, sf_dir).groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("comment_pos", item.alias("item")))), lambda x: x["item"]).alias("items"))
    return pages.select("video_id", F.lit(2).alias("page_no"), F.to_json(F.struct("items")).alias("payload"))


def sample_channel_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response for each of the sample's channels; every fourth has no uploads."""
    n = F.substring("channel_id", 3, 3).cast("int")
    details = F.struct(F.struct(F.when(n % 4 > 0, F.concat(F.lit("UU"), F.substring("channel_id", 3, 3))).alias("uploads")).alias("relatedPlaylists"))
    item = F.struct(F.col("channel_id").alias("id"), F.struct(F.when(n % 3 > 0, F.col("channel_title")).alias("title")).alias("snippet"), details.alias("contentDetails"))
    return sample.channels(spark, sf_dir).select(F.lit(0).alias("page_no"), F.to_json(F.struct(F.array(item).alias("items"))).alias("payload"))


UPLOADS_A_PAGE, COMMENTS_A_PAGE = 50, 1
PARENTS_A_BUCKET = 20_000


def _paged(rows: DataFrame, item: Column, size: int) -> DataFrame:
    """(parent, page_no, token, body) of rows (parent, order): answers with size items a page, each but the last naming the next one's token. Items are put in order once, and no parent's items meet in one row."""
    at = Window.partitionBy("parent").orderBy("order")
    placed = rows.select("parent", "order", item.alias("item")).withColumns({"n": F.row_number().over(at) - 1, "goes_on": F.lead("order").over(at).isNotNull()})
    placed = placed.withColumn("page_no", F.floor(F.col("n") / size).cast("int"))
    if size == 1:
        made = placed.select("parent", "page_no", F.array("item").alias("items"), "goes_on")
    else:
        items_ = F.transform(F.sort_array(F.collect_list(F.struct("order", "item"))), lambda x: x["item"])
        made = placed.groupBy("parent", "page_no").agg(items_.alias("items"), F.min("goes_on").alias("goes_on"))
    token = lambda n: F.when(n > 0, F.concat(F.lit("page"), n.cast("string")))
    following = F.when(F.col("goes_on"), token(F.col("page_no") + 1))
    return made.select("parent", "page_no", token(F.col("page_no")).alias("token"), F.to_json(F.struct("items", following.alias("nextPageToken"))).alias("body"))


def sample_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of an API that has the sample's channels and videos: uploads of each channel, comments of each video.

    Every 7th upload has no video; videos whose number is a multiple of 13 have comments switched off, of
    101 don't exist, and of 11 answer at the third attempt only.
    """
    videos = sample.videos(spark, sf_dir).withColumn("n", F.substring("video_id", 2, 20).cast("bigint"))
    snippet = F.struct(F.col("title"), F.col("channel_id").alias("channelId"), F.lit("shared").alias("channelTitle"), F.col("published_at").alias("publishedAt"))
    upload = F.struct(snippet.alias("snippet"), F.struct(F.when(F.col("n") % 7 > 0, F.col("video_id")).alias("videoId")).alias("contentDetails"))
    uploads = _paged(videos.select("*", F.concat(F.lit("UU"), F.substring("channel_id", 3, 3)).alias("parent"), F.col("n").alias("order")), upload, UPLOADS_A_PAGE)
    rows = sample.comments(spark, sf_dir).withColumn("name", F.concat_ws("-", "video_id", F.col("comment_pos").cast("string")))
    said = F.struct(F.col("text").alias("textDisplay"), F.lit("someone").alias("authorDisplayName"), F.lit("2024-03-03").alias("publishedAt"))
    thread = F.struct(F.struct(F.struct(F.col("name").alias("id"), said.alias("snippet")).alias("topLevelComment")).alias("snippet"))
    comments = _paged(rows.select("*", F.col("video_id").alias("parent"), F.col("comment_pos").alias("order")), thread, COMMENTS_A_PAGE)
    n = F.substring("parent", 2, 20).cast("bigint")
    refused = F.lit('{"error": {"errors": [{"reason": "commentsDisabled"}], "message": "switched off"}}')
    gone = F.lit('{"error": {"message": "no such video"}}')
    comments = comments.select(
        F.lit("commentThreads").alias("endpoint"), "parent", "token", F.when(n % 101 == 0, 404).when(n % 13 == 0, 403).otherwise(200).alias("status"),
        F.when(n % 101 == 0, gone).when(n % 13 == 0, refused).otherwise(F.col("body")).alias("body"), F.when(n % 11 == 0, 2).otherwise(0).alias("troubles"),
    )
    uploads = uploads.select(F.lit("playlistItems").alias("endpoint"), "parent", "token", F.lit(200).alias("status"), "body", F.lit(0).alias("troubles"))
    return uploads.union(comments)


_landed: dict[tuple[str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of sample_responses, written once for an application and table folder; made anew if it is gone."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed or not scratch.exists(spark, f"{_landed[key]}/_SUCCESS"):
        _landed[key] = scratch.new_path(spark, "responses")
        parents = sample.videos(spark, sf_dir).count()
        paged.land(sample_responses(spark, sf_dir), _landed[key], max(1, -(-parents // PARENTS_A_BUCKET)))
    return _landed[key]


def paged_comments(spark: SparkSession, folder: str, most: int | None = None, **options) -> DataFrame:
    """Comments of all videos that have them, at most `most` of each; comment_pos is their place over a video's pages."""
    pages = paged.read(spark, folder, "commentThreads", missing="skip", **({} if most is None else {"most": most}), **options)
    return comments(pages.where("outcome = 'page'").select(F.col("parent").alias("video_id"), "page_no", "payload"))


def paged_uploads(spark: SparkSession, folder: str, most: int | None = None, **options) -> DataFrame:
    """Uploads of all playlists, at most `most` of each, with playlist_id."""
    pages = paged.read(spark, folder, "playlistItems", **({} if most is None else {"most": most}), **options)
    rows = items(pages.select(F.col("parent").alias("playlist_id"), "page_no", "payload"), UPLOADS)
    return uploads_of(rows, "playlist_id")


def sample_channel_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, key, payload) of the sample's channels by id, and by a handle: the title, after @ for odd ones. Every fourth has no uploads."""
    n = F.substring("channel_id", 3, 3).cast("int")
    handle = F.concat(F.when(n % 2 == 1, "@").otherwise(""), F.col("channel_title"))
    keys = F.array(F.struct(F.lit("id").alias("kind"), F.col("channel_id").alias("key")), F.struct(F.lit("handle").alias("kind"), handle.alias("key")))
    names = sample.channels(spark, sf_dir).select("channel_id", F.explode(keys).alias("k")).select("channel_id", "k.*")
    payloads = sample_channel_payloads(spark, sf_dir).withColumn("channel_id", F.get_json_object("payload", "$.items[0].id"))
    return payloads.join(names, "channel_id").select("kind", "key", "payload")


def sample_channel_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(inputs, pages): ids, titles, handles and URLs of the sample's channels and of pages; every second page's source names a channel."""
    c = sample.channels(spark, sf_dir)
    site = "https://www.youtube.com/"
    forms = F.array("channel_id", "channel_title", F.concat(F.lit("@"), "channel_title"), F.concat(F.lit(f" {site}channel/"), "channel_id"), F.concat(F.lit(f"{site}@"), "channel_title"), F.concat(F.lit(f"{site}c/"), "channel_title"))
    pages = read(spark, sf_dir, "pages").select("url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('"channelId":"UC'), F.lpad((F.col("page_id") % 40).cast("string"), 3, "0"), F.lit('"'))).otherwise("").alias("html"))
    return c.select(F.explode(forms).alias("channel")).union(pages.select("url")), pages
