"""Golden cases of the text functions, and all catalogue queries against DuckDB at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuesheet.functions import identity, text
from cuesheet.operators import clean, group, links, search, store, timeline
from cuesheet.plans import catalogue, oracles
from cuesheet.sources import sample

SF = "/root/testdata/sf0.001"


def values(spark, column, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").coalesce(1)
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_entries(spark):
    rows = [("v", 0, "00:12:34 KING\n1:05:21 怪物 / YOASOBI\n12:45 - ファンサ\n01:23:10　星街すいせい - Stellar Stellar\n5:00 Legend\n5:00 Legend / Foo\n0:99 KING\n0:00 - 3:20 KING\n5:00 MC")]
    found = timeline.entry_lines(spark.createDataFrame(rows, "video_id string, comment_pos bigint, text string")).orderBy("line_no").collect()
    assert [(r.seconds, r.raw_song_title, r.normalized_song_title) for r in found] == [
        (754, "KING", "king"), (3921, "怪物 / YOASOBI", "怪物 / yoasobi"), (765, "ファンサ", "ファンサ"),
        (4990, "星街すいせい - Stellar Stellar", "星街すいせい - stellar stellar"), (300, "Legend / Foo", "legend / foo"), (99, "KING", "king"),
    ]


def test_candidates(spark):
    rows = timeline.candidates(spark.createDataFrame([*catalogue.COMMENTS], "video_id string, comment_pos bigint, text string"))
    found = {(r.video_id, r.comment_pos): (r.n_entries, r.has_marker, r.score) for r in rows.collect()}
    assert found["g1", 0] == (4, False, 93)
    assert found["g2", 0][0] == 2
    assert ("g3", 0) not in found and ("g4", 0) not in found and ("g5", 0) not in found
    assert found["g6", 0][:2] == (2, True)
    best = {r.video_id: r.comment_pos for r in timeline.best_comments(rows).collect()}
    assert best["g7"] == 1


@pytest.mark.parametrize(
    ("raw", "song", "artist", "source"),
    [
        ("怪物 / YOASOBI", "怪物", "YOASOBI", "slash"), ("KICK BACK - 米津玄師", "KICK BACK", "米津玄師", "dash_artist_last"), ("【YOASOBI】アイドル", "アイドル", "YOASOBI", "bracket"),
        ("星街すいせい - Stellar Stellar", "Stellar Stellar", "星街すいせい", "dash_artist_first"), ("「夜に駆ける」/ YOASOBI", "YOASOBI", "夜に駆ける", "bracket"),
    ],
)
def test_identity(spark, raw, song, artist, source):
    row = identity.identify(spark.createDataFrame([(raw,)], "raw_song_title string")).first()
    assert (row.song_title, row.artist_text, row.source) == (song, artist, source)


def test_merge_titles(spark):
    assert values(spark, identity.merge_title, "Forever", "Long Live", "君の知らない物語 -piano ver.") == ["Fore", "Long Live", "君の知らない物語"]
    assert values(spark, identity.merge_title, "歌" + " ピアノ" * 5, "曲" + " (live ver.)" * 9, None) == ["歌", "曲", None]
    row = identity.identify(spark.createDataFrame([("回る空うさぎ / Orangestar w/ もかん",)], "raw_song_title string")).first()
    assert row.artists[0] == "Orangestar" and row.artist_key == "orangestar|もかん"


def test_folding_is_full_for_every_code_point(spark, duck):
    """Spark's and SQL's folding equal Python's casefold, code point by code point and in words."""
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(signs[k : k + 64]) for k in range(0, len(signs), 64)] + ["ﬁn ﬀ ﬃ STRAẞE", "ᏣᎳᎩ ꭰꮿ", "İstanbul ΣΊΣΥΦΟΣ", "plain ASCII Text", "", "ŉ ǰ ΐ և", "\U00010400\U00016e40"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    got = {r.i: r.folded for r in df.select("i", text.fold(F.col("x")).alias("folded")).collect()}
    assert [i for i, t in enumerate(texts) if got[i] != t.casefold()] == []
    frame = pd.DataFrame({"i": range(len(texts)), "x": texts})
    found = dict(duck.sql(f"select i, {oracles.fold('x')} as folded from frame").fetchall())
    assert [i for i, t in enumerate(texts) if found[i] != t.casefold()] == [] and len(frame) == len(texts)
    assert df.select(text.fold(F.lit(None).cast("string")).alias("n")).first().n is None


def test_song_filter(spark):
    hit = lambda q: lambda x: search.song_filter(x, F.lit(q))
    assert values(spark, hit("king"), "king", "king / x", "the kingdom", "kingdom", "viking") == [True, True, True, False, False]
    assert values(spark, hit("怪"), "怪物 / yoasobi", "king") == [True, False]


def test_nulls_and_empty_titles(spark):
    assert values(spark, text.clean_title, None, "", "   ") == [None, "", ""]
    assert values(spark, text.seconds, None, "x", "1:2:3:4") == [None, None, None]


def test_edit_distance():
    assert [group.edits(a, b) for a, b in (("abc", "abc"), ("abc", "abd"), ("abc", "cab"), ("", "ab"), ("abcd", "wxyz"), ("abcdef", "bcdefa"))] == [0, 1, 2, 2, 3, 2]


def test_greedy_groups():
    g = group.Groups()
    assert [g.place(*p) for p in (("song", ""), ("song", "a"), ("song", "b"), ("other", "a"), ("others", "a"), ("longkey", "z"), ("longkex", "z"))] == [0, 0, 0, 1, 2, 3, 3]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def alike(a, b):
    short, d = min(len(a), len(b)), distance(a, b)
    return a == b or (short >= 6 and d <= 1) or (short >= 9 and d <= 2)


def one_artist(a, b):
    left, right = {t for t in a.split("|") if t}, {t for t in b.split("|") if t}
    if a == b or not left or not right or left & right:
        return True
    if len(left) != len(right):
        return False
    for token in sorted(left):
        match = next((t for t in sorted(right) if min(len(token), len(t)) >= 4 and distance(token, t) <= 2), None)
        if match is None:
            return False
        right.remove(match)
    return True


def most(counted, then):
    """The most frequent text, of equally frequent ones the one that is last by then; empty without any."""
    return max(counted, key=lambda t: (counted[t], then(t)), default="")


def walked(rows, across):
    """Groups (lists of rows) of the greedy walk, by looking at all groups for every row."""
    groups = []
    for r in rows:
        own = [g for g in groups if g["channel"] == r.channel_id]
        born = {(g["song"], g["born"]): g for g in own}
        found = born.get((r.merge_key, r.artist_key))
        if found is None and not r.artist_key:
            found = next((g for g in own if g["song"] == r.merge_key), None)
        elif found is None:
            found = born.get((r.merge_key, ""))
            found = found or next((g for g in own if g["song"] == r.merge_key and one_artist(g["artist"], r.artist_key)), None)
            found = found or next((g for g in own if g["artist"] == r.artist_key and alike(g["song"], r.merge_key)), None)
        if found is None:
            found = {"channel": r.channel_id, "song": r.merge_key, "born": r.artist_key, "artist": r.artist_key, "rows": []}
            groups.append(found)
        found["artist"] = found["artist"] or r.artist_key
        found["rows"].append(r)
    newest = lambda rs: sorted(rs, key=lambda r: (r.published_at or "", r.seconds or 0), reverse=True)
    for g in groups:
        g["title"] = most(Counter(r.merged for r in g["rows"]), lambda t: (-len(t), t.casefold()))
        g["shown"] = most(Counter(r.artists[0] for r in g["rows"] if r.artists), lambda t: (-len(t), [-ord(c) for c in t.casefold()]))
        g["rows"] = newest(g["rows"])
    if not across:
        return groups
    joined = []
    for g in groups:
        target = next((t for t in joined if (one_artist(t["artist"], g["artist"]) if t["song"] == g["song"] else g["artist"] and t["artist"] == g["artist"] and alike(t["song"], g["song"]))), None)
        if target is None:
            joined.append(dict(g))
            continue
        target["rows"] = newest(target["rows"] + g["rows"])
        target["title"] = min(target["title"], g["title"], key=len)
        if not target["shown"] and g["shown"]:
            target["shown"], target["artist"] = g["shown"], g["artist"]
    return joined


@pytest.fixture(scope="session")
def tangled(spark):
    """A few hundred entries whose titles and artists are near each other, in no order."""
    rng = np.random.default_rng(8)
    songs = ["orange road", "orange roads", "orage road", "orange rode", "blue", "blues", "longer title here", "longer titel here", "long title here", "歌", "歌詞"]
    artists = ["", "", "aimer", "aimers", "aimee", "ado", "ado & aimer", "lisa x ado", "yoasobi", "yoasoby", "YOASOBI feat. ado"]
    entries = []
    for i in range(500):
        song, artist = rng.choice(songs), rng.choice(artists)
        entries.append((i, f"v{rng.integers(40)}", f"{i % 50}:00", int(i % 50) * 60, song + (f" / {artist}" if artist else ""), "", ""))
    entries = spark.createDataFrame(entries, "entry_id long, video_id string, timestamp_text string, seconds long, raw_song_title string, source_comment string, jump_url string")
    entries = entries.withColumn("normalized_song_title", text.normalize_title(F.col("raw_song_title")))
    videos = spark.createDataFrame([(f"v{i}", f"UC{i % 4}", "t", None if i % 9 == 0 else f"2024-01-{1 + i % 7:02d}", "u") for i in range(40)], "video_id string, channel_id string, title string, published_at string, url string")
    channels = spark.createDataFrame([(f"UC{i}", f"Channel {'ba'[i % 2]}{i}") for i in range(4)], "channel_id string, channel_title string")
    made, linked = store.rebuilt(store.insert_ignore(entries), videos)
    return sample.Catalogue(channels, videos, made, linked)


@pytest.mark.parametrize("asked", [{}, {"channel": "Channel"}, {"artist": "aimer"}, {"song": "orange road"}, {"song": "歌", "channel": "UC1"}])
def test_grouped_search_equals_a_plain_walk(spark, tangled, asked):
    rows = search.joined(tangled)
    rows = rows.where(search.channel_filter(asked["channel"])) if "channel" in asked else rows
    rows = identity.identify(rows).withColumn("merged", identity.merge_title(F.col("song_title")))
    if "artist" in asked:
        rows = rows.where(~F.col("ambiguous") & identity.artist_matches(F.col("artist_keys"), text.compact_key(F.lit(asked["artist"]))))
    rows = rows.orderBy(*[F.expr(o) if " desc" not in o else F.desc_nulls_last(o.split()[0]) for o in group.ROW_ORDER.split(", ")]).collect()
    want = walked(rows, "channel" not in asked)
    page = group.search_grouped(tangled, **asked, limit=10_000).orderBy("rank").collect()
    found = group.search_grouped_entries(tangled, **asked, limit=10_000).orderBy("rank", "pos").collect()
    got = {}
    for r in found:
        got.setdefault(r.rank, []).append(r)
    entries = {rank: [r.entry_id for r in rs] for rank, rs in got.items()}
    assert [p.n_entries for p in page] == [len(entries[p.rank]) for p in page]
    if "song" in asked:
        want = [g for g in want if [r.entry_id for r in g["rows"]] in entries.values()]
        assert len(want) == len(entries) and asked["song"].replace(" ", "") in {p.song_key for p in page}
    assert sorted(entries.values()) == sorted([r.entry_id for r in g["rows"]] for g in want)
    keys = {tuple(r.entry_id for r in g["rows"]): (g["song"], g["title"], g["shown"]) for g in want}
    for p in page:
        assert keys[tuple(entries[p.rank])] == (p.song_key, p.song_title, p.artist)
        by_channel = {}
        for r in got[p.rank]:
            by_channel.setdefault(r.channel_id, []).append(r)
        titles = {f"UC{i}": f"channel {'ba'[i % 2]}{i}" for i in range(4)}
        order = sorted(by_channel, key=lambda c: (-len(by_channel[c]), titles[c]))
        assert all(r.channel_pos == order.index(r.channel_id) for r in got[p.rank])
        assert all([r.in_channel for r in rs] == list(range(1, len(rs) + 1)) for rs in by_channel.values())
        assert p.channel_count == (1 if "channel" in asked else len(by_channel))
    fold = lambda p: (p.channel_title.casefold(), p.song_title.casefold(), p.artist.casefold())
    if "song" in asked:
        query, query_key = text.normalize_title(F.lit(asked["song"])), text.compact_key(F.lit(asked["song"]))
        by_rank = spark.createDataFrame([(p.rank, p.title_keys.split(","), p.song_key) for p in page], "rank long, keys array<string>, song_key string")
        relevance = {r.rank: r.relevance for r in by_rank.select("rank", identity.group_relevance(F.col("keys"), F.col("song_key"), query, query_key).alias("relevance")).collect()}
        placed = [(relevance[p.rank], *fold(p)) for p in page]
        assert placed == sorted(placed) and (asked["song"] != "orange road" or len(set(relevance.values())) > 1)
    elif "artist" in asked:
        placed = [(*fold(p)[1:], fold(p)[0], -p.n_entries) for p in page]
        assert placed == sorted(placed) and len(placed) > 3
    else:
        assert [(-p.n_entries, *fold(p)) for p in page] == sorted((-p.n_entries, *fold(p)) for p in page)


def test_pairs_are_placed_as_all_rows_are(spark):
    """At most two rows of a pair go through the greedy step, and every row gets the group that a walk over all rows gives it."""
    rng = np.random.default_rng(21)
    songs = ["longsonga", "longsongb", "longsongc", "longtonga", "longtongz", "shorty", "shorts", "x"]
    artists = ["", "aimer", "aimers", "ado", "ado|aimer", "yoasobi", "lisa", "lisaa"]
    rows, want, most = [], {}, 0
    for channel in range(60):
        state, n = group.Groups(), 0
        weights = rng.dirichlet(np.full(len(songs) * len(artists), 0.15))
        names = []
        for seq in range(int(rng.integers(1, 120))):
            key, artist = divmod(int(rng.choice(len(weights), p=weights)), len(artists))
            found = state.place(songs[key], artists[artist])
            if found == len(names):
                names.append(seq)
            rows.append((f"c{channel}", songs[key], artists[artist], seq * 10 + 3))
            want[f"c{channel}", seq * 10 + 3] = names[found] * 10 + 3
            n += 1
    given = spark.createDataFrame(rows, "channel_id string, merge_key string, artist_key string, seq long")
    sent = group.sent_rows(given)
    assert sent.groupBy(*group.PAIR).count().where("count > 2").count() == 0 and sent.count() < given.count() / 2
    placed = group.placed_pairs(sent)
    found = given.join(placed, group.PAIR).where("seq >= from_seq and (to_seq is null or seq < to_seq)").collect()
    assert len(found) == len(rows) and {(r.channel_id, r.seq): r.group_seq for r in found} == want
    assert placed.groupBy(*group.PAIR).count().where("count > 1").count() > 5  # pairs that change groups


def test_rows_sent_do_not_grow_with_rows(spark):
    pairs = [("c", f"longsong{k % 4}", a) for k in range(8) for a in ("", "aimer", "ado")]
    some = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs * 3)], "channel_id string, merge_key string, artist_key string, seq long")
    many = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs * 60)], some.schema)
    assert group.sent_rows(some).count() == group.sent_rows(many).count() <= 2 * len(set(pairs))


def test_cross_channel_filters_come_first(spark, tangled):
    """A song query filters groups before they are joined across channels."""
    page = group.search_grouped(tangled, song="blue", limit=100).collect()
    assert page and all(any(k.startswith("blue") for k in p.title_keys.split(",")) for p in page)


def test_near_pairs_are_all_pairs(spark):
    rng = np.random.default_rng(2)
    keys = sorted({"".join(rng.choice(list("abc"), int(n))) for n in rng.integers(3, 12, 250)})
    rows = spark.createDataFrame([(k, i % 2) for i, k in enumerate(keys)], "key string, side int")
    got = {(r.one, r.other) for r in links.near_pairs(rows, "key", [], 4).collect()}
    assert got == {(a, b) for a in keys for b in keys if a < b and min(len(a), len(b)) >= 4 and distance(a, b) <= 2}
    by_side = {(r.side, r.one, r.other) for r in links.near_pairs(rows, "key", ["side"], 6).collect()}
    side = {k: i % 2 for i, k in enumerate(keys)}
    assert by_side == {(side[a], a, b) for a, b in got if min(len(a), len(b)) >= 6 and side[a] == side[b]}


def test_compatible_artists():
    keys = ["", "ado", "aimer", "aimers", "ado|aimer", "adoo|aimerz", "yoasobi", "yoasoby|x", "orangestar", "0rangestaz", "a|b", "b|c"]
    assert all(group.compatible(a, b) == one_artist(a, b) for a in keys for b in keys)
    assert group.compatible("orangestar", "0rangestaz") and not group.compatible("ado", "adoo") and not group.compatible("a|b", "c")


def test_tables_are_created_once(spark):
    spark.sql("create database if not exists made")
    store.create_tables(spark, "made")
    store.create_tables(spark, "made")
    assert {r.tableName for r in spark.sql("show tables in made").collect()} == set(store.TABLES)
    assert spark.table("made.song_entries").columns == ["entry_id", "song_id", "video_id", "timestamp_text", "seconds", "raw_song_title", "normalized_song_title", "source_comment", "jump_url"]
    spark.sql("drop database made cascade")


def test_index_counters(spark):
    """All that a run counts, against the reference's rules: a disabled video is indexed and skipped, and merging leaves videos_seen alone."""
    comments, videos = sample.comments(spark, SF), sample.videos(spark, SF)
    off = videos.where(F.col("video_id").endswith("6"))
    entries, one = timeline.index_run(comments, videos, all_videos=True, disabled=off)
    want = timeline.index(comments.join(off, "video_id", "left_anti"), videos, all_videos=True)
    assert sorted(map(str, entries.select(sorted(want.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))
    n = videos.count()
    assert one["videos_seen"] == one["videos_indexed"] == n and one["videos_skipped"] == off.count() > 0
    assert one["comments_seen"] == comments.join(off, "video_id", "left_anti").count()
    assert one["entries_inserted"] == want.count() and one["timeline_comments"] == want.select("video_id").distinct().count() > 0
    assert timeline.merged_stats(one, one) == {k: v if k == "videos_seen" else 2 * v for k, v in one.items()}
    none, zero = timeline.index_run(comments, videos.limit(0))
    assert none.count() == 0 and set(zero.values()) == {0}
    silent, counted = timeline.index_run(comments.limit(0), videos, all_videos=True)
    assert silent.count() == 0 and counted == dict.fromkeys(timeline.COUNTERS, 0) | {"videos_seen": n, "videos_indexed": n}


def test_pruning_settles_clashes(spark):
    c = catalogue.with_odd_entries(sample.catalogue(spark, SF))
    bad = clean.prune(c)[0].join(c.entries, "entry_id").groupBy("raw_song_title").count().collect()
    found = {r.raw_song_title.split()[0] for r in bad}
    assert {"[Clash]", "MC", "goods"} <= found and "Clash" not in found


def test_store_is_idempotent(spark):
    c = sample.catalogue(spark, SF)
    keys = c.entries.select(*store.ENTRY_KEY)
    assert keys.count() == keys.distinct().count()
    assert store.insert_ignore(c.entries, c.entries).count() == 0
    assert store.orphans(c.songs, c.entries).count() == 0
    assert clean.prune(c)[0].count() == 0


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in row) for row in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLES[name]).df()
    assert canonical(got) == canonical(want)
