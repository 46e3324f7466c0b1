"""The registered queries over the sample catalogue, one for each operator. Keys are the names they are known by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.functions import identity, text
from cuesheet.operators import clean, group, links, search, store, timeline
from cuesheet.plans import api, oracles
from cuesheet.scratch import keep
from cuesheet.sources import landing, sample

# Titles that the order tables don't have: their forms are what the text functions are about.
TITLES = (
    "KING", "怪物 / YOASOBI", "ファンサ", "星街すいせい - Stellar Stellar", "0:00 - 3:20 KING", "MC", "Legend", "Legend / Foo", "KICK BACK - 米津玄師",
    "【YOASOBI】アイドル", "回る空うさぎ / Orangestar w/ もかん", "君の知らない物語 -piano ver.", "Forever", "Long Live", "「夜に駆ける」/ YOASOBI", "アンコール",
    "encore", "01. Song One", "(2) Song Two", "［3］ Song / Three", "[4] Four / Five", "12曲目 Song", "7【Bracket】 Song", "5[Song Name] extra", "3番のみ[Title]rest",
    "1/24 today", "1,000人", "-- Deco --", "Straße / Größe", "ΣΊΣΥΦΟΣ", "\"quoted\"", "op: theme", "what? / who", "what?", "a=b", "歌 | 歌手", "A & B / C feat. D",
    "Song / X and Y", "Song – Version live", "　wide　space　", "12怪物 / X", "x", "", "Song (live ver.)", "Remix", "アイドル / ado × lisa", "Song / A, B & C with D",
    "歌" + " ピアノ" * 5, "曲" + " (live ver.)" * 9, "abcdefghij", "xbcdefghiy", "abcdexfghij", "Near / orangestar", "Near / 0rangestaz", "Near / orngestar", "Near / kemu", "Near / kamu",
)
CLOCKS = ("0:12", "1:02:03", "12:34", "0:99", "１２:３４", "5", "1:2:3:4", "a:b", "")
CHANNELS = (
    "@handle", "UCabc", "https://www.youtube.com/@name", "https://www.youtube.com/channel/UC123", "https://www.youtube.com/c/Some/", "http://youtube.com",
    " https://www.youtube.com/user/x?y=1 ", "HTTPS://WWW.YOUTUBE.COM/@Up", "plain name", "",
)
COMMENTS = (
    ("g1", 0, "00:12:34 KING\n1:05:21 怪物 / YOASOBI\n12:45 - ファンサ\n01:23:10　星街すいせい - Stellar Stellar"),
    ("g2", 0, "0:30 KING\n5:00 MC\n6:00 怪物 / YOASOBI\n10:00 夜に駆ける / YOASOBI"),
    ("g3", 0, "セットリスト\n0:30 KING\n5:00 MC\n6:00 怪物 / YOASOBI\n10:00 夜に駆ける / YOASOBI"),
    ("g4", 0, "0:30 KING"),
    ("g5", 0, "setlist\na\nb\nc\nd\ne\nf\n0:30 KING\n1:30 QUEEN"),
    ("g6", 0, "setlist\na\nb\n\n---\nc\nd\ne\n0:30 KING\n1:30 QUEEN"),
    ("g7", 0, "0:30 KING / A\n1:30 QUEEN / B\n2:30 JACK / C"), ("g7", 1, "time stamps\n0:30 KING\n1:30 QUEEN"),
    ("g8", 0, "0:30 setlist KING\n1:30 QUEEN\ntext\n2:30 JACK\n3:30 ACE\n4:30 TEN"),
)


def rows_of(spark: SparkSession, values: tuple, schema: str) -> DataFrame:
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct raw titles of the sample and TITLES."""
    return sample.raw_entries(spark, sf_dir).select(F.col("raw_song_title").alias("title")).union(rows_of(spark, TITLES, "title string")).distinct()


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw_titles and all different lines of the documents."""
    lines = sample.read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("title"))
    return raw_titles(spark, sf_dir).union(lines).distinct()


def all_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.comments(spark, sf_dir).union(rows_of(spark, COMMENTS, "video_id string, comment_pos bigint, text string"))


def identified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.identify(raw_titles(spark, sf_dir), "title")


def over_titles(name: str, *columns: Callable[[Column], Column]) -> Callable:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return titles(spark, sf_dir).select("title", *[c(F.col("title")).alias(n) for n, c in zip(name.split(), columns, strict=True)])

    return query


def with_catalogue(f: Callable[[sample.Catalogue], DataFrame]) -> Callable:
    return lambda spark, sf_dir: f(sample.catalogue(spark, sf_dir))


def t4_probable(spark, sf_dir):
    rows = titles(spark, sf_dir).withColumn("raw", text.clean_title(F.col("title"))).withColumn("normal", text.normalize_title(F.col("raw")))
    return rows.select("title", text.is_probable_title(F.col("raw"), F.col("normal")).alias("probable"), text.is_non_song(F.col("raw"), F.col("normal")).alias("non_song"))


def snk1_upsert_channel(spark, sf_dir):
    old = sample.channels(spark, sf_dir)
    new = sample.videos(spark, sf_dir).groupBy("channel_id").agg(F.count(F.lit(1)).alias("at")).where("at % 2 = 0")
    new = new.select("channel_id", F.concat(F.lit("renamed "), "channel_id").alias("channel_title"), "at")
    added = rows_of(spark, (("UCnew", "first", 1), ("UCnew", "second", 2)), "channel_id string, channel_title string, at bigint")
    return store.upsert(old, new.unionByName(added), ["channel_id"], "at")


def snk2_upsert_video(spark, sf_dir):
    old = sample.videos(spark, sf_dir)
    new = old.where(F.col("title").startswith("Karaoke 1")).withColumn("title", F.concat(F.col("title"), F.lit(" again"))).withColumn("at", F.lit(1).cast("bigint"))
    return store.upsert(old, new, ["video_id"], "at")


def snk5_replace_video(spark, sf_dir):
    c = sample.catalogue(spark, sf_dir)
    _, entries = store.replace_videos(c.entries, api.again(c), c.songs, c.videos)
    return entries.select("video_id", "seconds", "raw_song_title", "normalized_song_title", "song_id", "jump_url")


def snk6_orphans(spark, sf_dir):
    c = sample.catalogue(spark, sf_dir)
    return store.orphans(c.songs, c.entries.where(F.col("seconds") < 900)).select("song_id", "channel_id", "normalized_song_title")


def snk7_backfill(spark, sf_dir):
    c = sample.catalogue(spark, sf_dir)
    cleared = c.entries.withColumn("song_id", F.when(F.col("entry_id") % 3 > 0, F.col("song_id")))
    some = c.songs.join(cleared.where("song_id is not null").select("song_id"), "song_id", "left_semi").select(*c.songs.columns)
    songs, entries = store.backfilled(cleared, c.videos, some)
    return songs.join(entries.groupBy("song_id").agg(F.count(F.lit(1)).alias("entry_count")), "song_id").select("song_id", "channel_id", "normalized_song_title", "canonical_song_title", "entry_count")


def f7_artist_match(spark, sf_dir):
    rows = identified(spark, sf_dir)
    match = lambda q: identity.artist_matches(F.col("artist_keys"), text.compact_key(F.lit(q)))
    return rows.select("title", match("YOASOBI").alias("yoasobi"), match("eco").alias("eco"), match("economy class").alias("economy_class"), match("").alias("empty"))


def t21_similar_pairs(spark, sf_dir):
    pairs = links.near_pairs(identified(spark, sf_dir), "merge_key", [], 6).select(F.col("one").alias("merge_key"), "other")
    return pairs.where(identity.is_similar_key(F.col("merge_key"), F.col("other")))


def t23_token_pairs(spark, sf_dir):
    tokens = identified(spark, sf_dir).select(F.explode("artist_keys").alias("token"))
    pairs = links.near_pairs(tokens, "token", [], 4).select(F.col("one").alias("token"), "other")
    return pairs.where(identity.are_near_tokens(F.col("token"), F.col("other")))


def q9_index(spark, sf_dir):
    found = timeline.index(sample.comments(spark, sf_dir), sample.videos(spark, sf_dir))
    return found.select("video_id", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title", "jump_url")


def q8_rebuild_stats(spark, sf_dir):
    stored = sample.catalogue(spark, sf_dir).entries
    return clean.rebuild_best(stored, sample.comments(spark, sf_dir).select("video_id", "text"))


def a10_best_comment(spark, sf_dir):
    best = timeline.best_comments(timeline.candidates(all_comments(spark, sf_dir)))
    return best.select("video_id", "comment_pos", "n_entries", "span", "artist_lines", "has_marker", "score")


def a9_channel_nesting(spark, sf_dir):
    rows = search.joined(sample.catalogue(spark, sf_dir)).withColumn("title_key", F.substring_index("canonical_song_title", " ", 2))
    nested = group.nested_channels(rows, "title_key").select("title_key", F.posexplode("channels").alias("channel_pos", "c"))
    entries = F.array_join(F.transform("c.entries", lambda e: e["entry_id"].cast("string")), ",")
    return nested.select("title_key", F.col("channel_pos").cast("bigint").alias("channel_pos"), "c.channel_id", entries.alias("entry_ids"))


QUERY_KEYS = ("red", "redwidget", "kin", "歌")


def o10_relevance(spark, sf_dir):
    rows = identified(spark, sf_dir).select("title", F.array("merge_key").alias("keys"), "merge_key")
    return rows.select("title", *[identity.group_relevance(F.col("keys"), F.col("merge_key"), F.lit(q), F.lit(q)).cast("bigint").alias(f"q{i}") for i, q in enumerate(QUERY_KEYS)])


def f13_group_filter(spark, sf_dir):
    rows = identified(spark, sf_dir).select("title", F.array("merge_key").alias("keys"), "merge_key")
    return rows.select("title", *[identity.group_matches(F.col("keys"), F.col("merge_key"), F.lit(q), F.lit(q)).alias(f"q{i}") for i, q in enumerate(QUERY_KEYS)])


def _grouped(spark, sf_dir, **kw):
    return group.grouped_rows(sample.catalogue(spark, sf_dir), **kw)


def a7_display_title(spark, sf_dir):
    """By channel and merge key, so that SQL can say the same."""
    rows = _by_key(spark, sf_dir)
    return group.display_titles(rows).select(F.col("channel_id"), F.col("group_seq").alias("merge_key"), "display_title")


def a8_display_artist(spark, sf_dir):
    rows = _by_key(spark, sf_dir)
    return group.display_artists(rows).select(F.col("channel_id"), F.col("group_seq").alias("merge_key"), "display_artist")


def _by_key(spark, sf_dir):
    rows = search.joined(sample.catalogue(spark, sf_dir))
    rows = rows.join(identity.identify(rows.select("raw_song_title").distinct()), "raw_song_title")
    return rows.withColumn("group_seq", F.col("merge_key")).withColumn("seq", F.col("entry_id")).withColumn("n", F.lit(1))


def o9_entry_order(spark, sf_dir):
    return group.entries_in_order(_by_key(spark, sf_dir)).select("channel_id", F.col("group_seq").alias("merge_key"), "entry_id", "pos")


def s1_key_union(spark, sf_dir):
    rows = identified(spark, sf_dir).groupBy("merge_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("artist_keys")))).alias("keys"))
    return rows.select("merge_key", F.array_join("keys", "|").alias("artist_keys"))


def s2_key_overlap(spark, sf_dir):
    """Pairs of a merge key's artist sets that share an artist: different sets only, met by their artists."""
    sets = identified(spark, sf_dir).where(F.size("artist_keys") > 0).select("merge_key", "artist_keys").distinct()
    by_artist = sets.select("merge_key", F.array_join("artist_keys", "|").alias("left_keys"), F.explode("artist_keys").alias("artist"))
    both = by_artist.join(by_artist.withColumnRenamed("left_keys", "right_keys"), ["merge_key", "artist"])
    return both.select("merge_key", "left_keys", "right_keys").distinct()


def with_odd_entries(c: sample.Catalogue) -> sample.Catalogue:
    """The catalogue with some more entries of videos whose id ends with 3: a title that cleaning turns into another's, one that is no song, a doubtful one alone, and one that many videos have."""
    first = c.entries.where(F.col("video_id").endswith("3") & (F.col("entry_id") % sample.LINES_PER_VIDEO == 1))
    titles = F.array(F.lit("[Clash] extra"), F.lit("Clash"), F.lit("MC"), F.concat(F.lit("goods "), "video_id"), F.lit("bgm"))
    odd = first.select("*", F.posexplode(titles).alias("at", "title"))
    odd = odd.withColumns({"entry_id": F.col("entry_id") + 500 + F.col("at"), "seconds": F.lit(99999).cast("bigint"), "raw_song_title": F.col("title"), "normalized_song_title": text.normalize_title(F.col("title"))})
    odd = keep(store.with_own_songs(odd.select(*c.entries.columns), c.videos), "odd")
    entries = c.entries.unionByName(odd)
    return sample.Catalogue(c.channels, c.videos, store.own_songs(entries, c.videos), entries)


def q7_prune(spark, sf_dir):
    bad, after = clean.prune(with_odd_entries(sample.catalogue(spark, sf_dir)))
    return after.entries.groupBy("song_id").agg(F.count(F.lit(1)).alias("entry_count"), F.min("raw_song_title").alias("least_title"))


def q7_pruned_entries(spark, sf_dir):
    return clean.prune(with_odd_entries(sample.catalogue(spark, sf_dir)))[0]


def q10_cross_channel(spark, sf_dir):
    return group.combined_groups(group.combine(group.groups(_grouped(spark, sf_dir)))).select("song_key", "display_title", "display_artist", F.array_join("title_keys", ",").alias("title_keys"), "n_entries", "channel_count")


def t10_blocks(spark, sf_dir):
    return timeline.blocks(all_comments(spark, sf_dir)).select("video_id", "comment_pos", F.col("start_line").cast("bigint").alias("start_line"), "n_entries", "span", "artist_lines", "has_marker")


def t11_candidates(spark, sf_dir):
    return timeline.candidates(all_comments(spark, sf_dir)).select("video_id", "comment_pos", F.col("start_line").cast("bigint").alias("start_line"), "n_entries", "span", "artist_lines", "has_marker", "score")


def t9_lines(spark, sf_dir):
    return timeline.entry_lines(all_comments(spark, sf_dir)).withColumn("line_no", F.col("line_no").cast("bigint"))


def f8_cap(spark, sf_dir):
    return timeline.capped(sample.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], "turn", 3)


def src_uploads(spark, sf_dir):
    return landing.uploads(landing.sample_payloads(spark, sf_dir)).select("video_id", "title", "channel_id", "channel_title", "published_at")


def src4_channel_page(spark, sf_dir):
    pages = sample.read(spark, sf_dir, "pages").select("page_id", "url", F.concat("html", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('"channelId":"UC'), F.col("page_id").cast("string"), F.lit('"'))).otherwise("")).alias("html"))
    return pages.select("page_id", text.channel_id_of_page(F.col("html")).alias("channel_id"), text.channel_input(F.col("url")).alias("channel_input"))


def a14_merged_stats(spark, sf_dir):
    """Runs over the videos of even and of odd numbers, merged into the counters of a caller that saw all videos; every 13th has its comments disabled."""
    videos, n = sample.videos(spark, sf_dir), F.substring("video_id", 2, 20).cast("bigint")
    total = dict.fromkeys(timeline.COUNTERS, 0) | {"videos_seen": videos.count()}
    for k in (0, 1):
        _, counters = timeline.index_run(sample.comments(spark, sf_dir), videos.where(n % 2 == k), disabled=videos.where(n % 13 == 0))
        total = timeline.merged_stats(total, counters)
    return timeline.stats_row(spark, total)


def t1_seconds(spark, sf_dir):
    """Clock texts of the sample's entries, of its videos (h:mm:ss made of their numbers), and odd ones."""
    n = F.substring("video_id", 2, 20).cast("bigint")
    long = F.concat_ws(":", (n % 30).cast("string"), F.lpad((n % 60).cast("string"), 2, "0"), F.lpad((n % 77).cast("string"), 2, "0"))
    clocks = rows_of(spark, CLOCKS, "clock string").union(sample.raw_entries(spark, sf_dir).select("timestamp_text")).union(sample.videos(spark, sf_dir).select(long)).distinct()
    return clocks.select("clock", text.seconds(F.col("clock")).alias("seconds"))


def snk8_rebuild(spark, sf_dir):
    c = sample.catalogue(spark, sf_dir)
    songs, entries = store.rebuilt(c.entries.where(F.col("seconds") >= 600), c.videos)
    return songs.join(entries.groupBy("song_id").agg(F.count(F.lit(1)).alias("entry_count")), "song_id").select("song_id", "channel_id", "normalized_song_title", "canonical_song_title", "entry_count")


def js1_json_extract(spark, sf_dir):
    rows = sample.read(spark, sf_dir, "events")
    return rows.select("event_id", F.get_json_object("props", "$.k").alias("k"))


def w1_song_count(c):
    return c.entries.select("entry_id", "song_id", F.count("entry_id").over(Window.partitionBy("song_id")).alias("entry_count"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_search_ascii": with_catalogue(lambda c: search.search(c, "red", limit=50)),
    "q1_search_substring": with_catalogue(lambda c: search.search(c, "widget / l", limit=50)),
    "q1_search_channel": with_catalogue(lambda c: search.search(c, "blue", "nation_2", limit=50)),
    "q1_no_query_ordinal": with_catalogue(lambda c: search.search(c, limit=50)),
    "q3_search_legacy": with_catalogue(lambda c: search.search_legacy(c, "old", limit=25)),
    "q4_list_songs": with_catalogue(lambda c: search.list_songs(c, limit=None)),
    "q4_list_songs_channel": with_catalogue(lambda c: search.list_songs(c, "NATION_1", limit=100)),
    "q5_list_channels": with_catalogue(search.list_channels),
    "q6_stats": with_catalogue(search.stats),
    "snk1_upsert_channel": snk1_upsert_channel,
    "snk2_upsert_video": snk2_upsert_video,
    "snk3_canonical_title": with_catalogue(lambda c: c.songs.select("song_id", "channel_id", "normalized_song_title", "canonical_song_title")),
    "snk4_insert_ignore": with_catalogue(lambda c: c.entries.select("entry_id", "song_id", "video_id", "seconds", "raw_song_title", "normalized_song_title", "jump_url")),
    "snk5_replace_video": snk5_replace_video,
    "snk6_orphans": snk6_orphans,
    "snk7_backfill": snk7_backfill,
    "snk8_rebuild": snk8_rebuild,
    "snk9_needs_backfill": with_catalogue(lambda c: store.needs_backfill(c.songs, c.entries.withColumn("song_id", F.when(F.col("entry_id") % 1000 != 5, F.col("song_id"))))),
    "w1_song_count": with_catalogue(w1_song_count),
    "a5_low_confidence": with_catalogue(lambda c: clean.doubtful_entries(with_odd_entries(c)).drop("video_id")),
    "p2_urls": lambda s, d: sample.videos(s, d).select("video_id", "url", text.jump_url(F.col("video_id"), F.char_length("title")).alias("jump_url")),
    "p3_date": lambda s, d: sample.videos(s, d).select("video_id", text.shown_date(F.when(~F.col("video_id").endswith("5"), F.col("published_at")).otherwise("")).alias("shown")),
    "f6_title_filter": lambda s, d: sample.videos(s, d).where(text.is_stream_title(F.col("title"))).select("video_id", "title"),
    "f7_artist_match": f7_artist_match,
    "f8_cap": f8_cap,
    "f10_low_conf": lambda s, d: titles(s, d).select("title", text.is_doubtful(F.col("title"), text.normalize_title(F.col("title"))).alias("doubtful")),
    "o8_page": with_catalogue(lambda c: search.limited(c.songs.groupBy("normalized_song_title").agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.col("normalized_song_title")], 20, 20)),
    "t1_seconds": t1_seconds,
    "t2_clean": over_titles("cleaned", text.clean_title),
    "t3_normalize": over_titles("normal", text.normalize_title),
    "t4_probable": t4_probable,
    "t14_compact": over_titles("compact", text.compact_key),
    "t17_artist_tokens": lambda s, d: identified(s, d).select("title", F.array_join("artists", "|").alias("artists"), F.array_join("artist_keys", "|").alias("artist_keys")),
    "t20_canonical": lambda s, d: raw_titles(s, d).select("title", identity.merge_title(F.col("title")).alias("merged")),
    "t21_similar_pairs": t21_similar_pairs,
    "t23_token_pairs": t23_token_pairs,
    "t28_channel_input": lambda s, d: rows_of(s, CHANNELS, "channel string").union(sample.read(s, d, "pages").select("url")).distinct().select("channel", text.channel_input(F.col("channel")).alias("named")),
    "t9_lines": t9_lines,
    "t10_blocks": t10_blocks,
    "t11_candidates": t11_candidates,
    "a10_best_comment": a10_best_comment,
    "q9_index": q9_index,
    "q8_rebuild_stats": q8_rebuild_stats,
    "t15_identity": lambda s, d: identified(s, d).select("title", "song_title", "artist_text", "source", "ambiguous", "artist_key", "merge_key"),
    "a7_display_title": a7_display_title,
    "a8_display_artist": a8_display_artist,
    "o9_entry_order": o9_entry_order,
    "a9_channel_nesting": a9_channel_nesting,
    "o10_relevance": o10_relevance,
    "f13_group_filter": f13_group_filter,
    "q7_prune": q7_prune,
    "q7_pruned_entries": q7_pruned_entries,
    "q2_grouped_channel": with_catalogue(lambda c: group.search_grouped(c, channel="NATION_1")),
    "q2_grouped_song": with_catalogue(lambda c: group.search_grouped(c, song="red")),
    "q2_grouped_artist": with_catalogue(lambda c: group.search_grouped(c, artist="PROMO")),
    "q10_cross_channel": q10_cross_channel,
    "q2_channel_entries": with_catalogue(lambda c: group.search_grouped_entries(c, channel="NATION_1")),
    "q2_song_entries": with_catalogue(lambda c: group.search_grouped_entries(c, song="red")),
    "a14_index_stats": lambda s, d: timeline.stats_row(s, timeline.index_run(sample.comments(s, d), sample.videos(s, d), max_comments=1)[1]),
    "a14_merged_stats": a14_merged_stats,
    "src1_videos": lambda s, d: landing.videos(landing.sample_video_payloads(s, d)),
    "src2_comments": lambda s, d: landing.comments(landing.sample_comment_payloads(s, d)),
    "src4_channels": lambda s, d: landing.channels(landing.sample_channel_payloads(s, d)),
    "s1_key_union": s1_key_union,
    "s2_key_overlap": s2_key_overlap,
    "js1_json_extract": js1_json_extract,
    "src3_uploads": src_uploads,
    "src4_channel_page": src4_channel_page,
} | api.QUERIES

ORACLES = oracles.build(TITLES, CLOCKS, CHANNELS, COMMENTS, QUERY_KEYS) | api.ORACLES
ORACLES |= {"q9_stream_index": ORACLES["q9_index"], "snk10_migrated": ORACLES["snk7_backfill"], "q4_bucketed": ORACLES["q4_list_songs"], "w1_bucketed": ORACLES["w1_song_count"], "snk5_in_place": f"select * exclude (song_id) from ({ORACLES['snk5_replace_video']})"}
ORACLES |= {f"q1_indexed_{form}": ORACLES[f"q1_search_{form}"] for form in ("ascii", "substring", "channel")}
