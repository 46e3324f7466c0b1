"""Songs grouped by identity: greedily within a channel, then across channels.

The greedy steps depend on the order of rows, but rows only influence each other if they
have one song key, or one artist and similar song keys. So song keys are joined to
components over such pairs first.

Of a component the greedy step needs at most two rows of each (song key, artist key), however
many there are. Which group such a pair joins changes only when a group is born, or when a group
without artist gets one. A group is born at the first row of a pair: later on the pair has an
answer, and answers don't get lost. Only a group that was born with an empty artist key can get an artist,
from the first row with its song key and an artist after its birth, which is the first row of some pair
after the first one of (song key, ''). The step goes through these rows in order and gives, for each pair, from which row on it
joins which group; all rows then find their group by their pair and place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import identity, text
from cuesheet.operators import links, search
from cuesheet.scratch import keep
from cuesheet.sources.sample import Catalogue

ROW_ORDER = "canonical_song_title, channel_title, normalized_song_title, published_at desc nulls last, seconds, video_id, entry_id"


def edits(a: str, b: str, most: int = 2) -> int:
    """Edit distance of two strings, or most + 1 if it is larger: cells outside a band of that width can't count."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        last, row = row, {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            row[j] = min(last.get(j, most) + 1, row.get(j - 1, most) + 1, last.get(j - 1, most + 1 if j else i - 1) + (j == 0 or x != b[j - 1]))
    return min(row.get(len(b), most + 1), most + 1)


def similar(a: str, b: str) -> bool:
    shorter = min(len(a), len(b))
    return a == b or (shorter >= 6 and edits(a, b) <= (2 if shorter >= 9 else 1))


def near(a: str, b: str) -> bool:
    return a == b or (min(len(a), len(b)) >= 4 and edits(a, b) <= 2)


def compatible(a: str, b: str) -> bool:
    """Whether two artist keys may be one artist: equal, unknown, sharing a token, or token by token nearly equal (tokens in order)."""
    left, right = sorted(set(a.split("|")) - {""}), sorted(set(b.split("|")) - {""})
    if a == b or not left or not right or set(left) & set(right):
        return True
    if len(left) != len(right):
        return False
    for token in left:
        match = next((t for t in right if near(token, t)), None)
        if match is None:
            return False
        right.remove(match)
    return True


class Groups:
    """Groups of one channel's component in order of birth, found by song key or by artist key instead of by looking at all."""

    def __init__(self):
        self.song, self.artist, self.born = [], [], {}  # by group; (song key, artist key at birth) -> group
        self.of_song, self.of_artist = {}, {}
        self.changed = False  # whether the last place() made a group, or gave one an artist

    def place(self, key: str, artist: str) -> int:
        found = self._find(key, artist)
        self.changed = found is None or bool(artist and not self.artist[found])
        if found is None:
            found = self.born[key, artist] = len(self.song)
            self.song.append(key)
            self.artist.append(artist)
            self.of_song.setdefault(key, []).append(found)
            if artist:
                self.of_artist.setdefault(artist, []).append(found)
        elif artist and not self.artist[found]:
            self.artist[found] = artist
            self.of_artist.setdefault(artist, []).append(found)
        return found

    def _find(self, key: str, artist: str) -> int | None:
        if (key, artist) in self.born:
            return self.born[key, artist]
        same_song = self.of_song.get(key, [])
        if not artist:
            return same_song[0] if same_song else None
        if (key, "") in self.born:
            return self.born[key, ""]
        same = next((g for g in same_song if compatible(self.artist[g], artist)), None)
        return same if same is not None else next((g for g in sorted(self.of_artist.get(artist, [])) if similar(self.song[g], key)), None)


def _streamed(state: type, place: Callable, columns: list[str]):
    """A function for mapInPandas: what place(state, row) lists, for rows that come component by component, each with a state of its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, state()
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.component != now:
                    now, own = row.component, state()
                out += place(own, row)
            yield pd.DataFrame(out, columns=columns)

    return run


def _in_components(rows: DataFrame, order: str) -> DataFrame:
    return rows.repartition("component").sortWithinPartitions("component", order)


def _with_component(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows (merge_key, artist_key, ...) with component, a name of all song keys within by that may share a group with theirs."""
    name = lambda key: F.concat_ws("\x1f", *by, key)
    pairs = links.near_pairs(rows.where("artist_key <> ''"), "merge_key", [*by, "artist_key"], 6)
    pairs = pairs.where(identity.is_similar_key(F.col("one"), F.col("other"))).select(name("one").alias("a"), name("other").alias("b"))
    found = links.connected(pairs).withColumnRenamed("id", "name")
    named = rows.withColumn("name", name("merge_key")).join(found, "name", "left")
    return named.withColumn("component", F.coalesce("component", "name")).drop("name")


class _Channel(Groups):
    """Groups that are named by the seq of the row that they were born with, and what each pair's rows join from some row on."""

    def __init__(self):
        super().__init__()
        self.names: list[int] = []
        self.answers: dict[tuple[str, str], int] = {}
        self.with_song, self.with_artist = {}, {}  # pairs

    def placed(self, row) -> list[tuple]:
        pair = row.merge_key, row.artist_key
        found = self.place(*pair)
        if found == len(self.names):
            self.names.append(row.seq)
        if pair not in self.answers:
            self.with_song.setdefault(pair[0], []).append(pair)
            self.with_artist.setdefault(pair[1], []).append(pair)
        now = {pair: found}
        if self.changed:
            others = [*self.with_song.get(self.song[found], []), *(self.with_artist.get(self.artist[found], []) if self.artist[found] else [])]
            now |= {other: self._find(*other) for other in others if other != pair}
        out = [(row.channel_id, *p, row.seq, self.names[g]) for p, g in now.items() if self.answers.get(p) != g]
        self.answers |= now
        return out


PAIR = ["channel_id", "merge_key", "artist_key"]


def sent_rows(rows: DataFrame) -> DataFrame:
    """(*PAIR, seq): the rows that the greedy step needs, the first of each pair and its first one after that of the song key without artist."""
    firsts = keep(rows.groupBy(*PAIR).agg(F.min("seq").alias("seq")), "firsts")  # few, whose size is known to the join
    blank = firsts.where("artist_key = ''").select("channel_id", "merge_key", F.col("seq").alias("_blank"))
    after = rows.where("artist_key <> ''").select(*PAIR, "seq").join(blank, PAIR[:2]).where("seq > _blank")
    return firsts.union(after.groupBy(*PAIR).agg(F.min("seq").alias("seq"))).distinct()


def placed_pairs(sent: DataFrame) -> DataFrame:
    """(*PAIR, from_seq, to_seq, group_seq): the group that a pair's rows join from from_seq up to before to_seq (null: to the end)."""
    firsts = keep(_with_component(sent.select(*PAIR).distinct(), ["channel_id"]), "components")
    schema = "channel_id string, merge_key string, artist_key string, from_seq long, group_seq long"
    walked = sent.join(firsts, PAIR)
    found = _in_components(walked, "seq").mapInPandas(_streamed(_Channel, _Channel.placed, [*PAIR, "from_seq", "group_seq"]), schema)
    return found.withColumn("to_seq", F.lead("from_seq").over(Window.partitionBy(*PAIR).orderBy("from_seq")))


TITLE = ["raw_song_title", "song_title", "artists", "artist_keys", "artist_key", "merge_key"]


def _with_place(rows: DataFrame, column: str, name: str) -> DataFrame:
    """rows with name, the place of column's value among the different ones."""
    places = rows.select(F.col(column).alias("_value")).distinct().orderBy("_value").withColumn(name, F.monotonically_increasing_id())
    return rows.join(places, F.col(column).eqNullSafe(F.col("_value"))).drop("_value")


def ordered_rows(c: Catalogue, channels: DataFrame, titles: DataFrame) -> DataFrame:
    """(seq, channel_id, title, published_at, seconds, entry_id) of the entries with these channels and titles (raw_song_title, title); seq is a row's place in ROW_ORDER.

    What many entries share moves as numbers: a title's, and the places of titles of songs and channels among the different ones.
    """
    songs = keep(_with_place(_with_place(c.songs.select("song_id", "canonical_song_title", "normalized_song_title"), "canonical_song_title", "song_at"), "normalized_song_title", "normal_at").select("song_id", "song_at", "normal_at"), "places")
    channels = keep(_with_place(channels, "channel_title", "channel_at").select("channel_id", "channel_at"), "places")
    videos = c.videos.select("video_id", "channel_id", "published_at").join(channels, "channel_id")
    rows = c.entries.select("entry_id", "song_id", "video_id", "seconds", "raw_song_title").join(titles, "raw_song_title").drop("raw_song_title")
    rows = rows.join(songs, "song_id").drop("song_id").join(videos, "video_id")
    order = ["song_at", "channel_at", "normal_at", F.desc_nulls_last("published_at"), "seconds", "video_id", "entry_id"]
    return rows.orderBy(*order).select(F.monotonically_increasing_id().alias("seq"), "channel_id", "title", "published_at", "seconds", "entry_id")


def grouped_rows(c: Catalogue, channel: str | None = None, artist: str | None = None) -> DataFrame:
    """Entries with their identity and group (channel_id, group_seq); seq is a row's place in ROW_ORDER, group_seq that of its group's first row.

    The rows are written once, because seq comes from a sort, and without what follows from their title and channel.
    """
    channels = c.channels.where(search.channel_filter(channel)) if channel else c.channels
    titles = identity.identify(c.entries.select("raw_song_title").distinct())
    if artist and artist.strip():
        titles = titles.where(~F.col("ambiguous") & identity.artist_matches(F.col("artist_keys"), text.compact_key(F.lit(artist.strip()))))
    titles = keep(titles.select(*TITLE).withColumn("title", F.monotonically_increasing_id()), "titles")
    rows = keep(ordered_rows(c, channels, titles.select("raw_song_title", "title")), "grouped")
    rows = rows.join(titles, "title").drop("title").join(channels, "channel_id")
    placed = keep(placed_pairs(keep(sent_rows(rows), "sent")), "placed")
    found = rows.join(placed, PAIR).where((F.col("seq") >= F.col("from_seq")) & (F.col("to_seq").isNull() | (F.col("seq") < F.col("to_seq"))))
    return found.drop("from_seq", "to_seq")


GROUP = ["channel_id", "group_seq"]


def counted_titles(rows: DataFrame) -> DataFrame:
    """A row for each title of a group instead of one for each entry: seq is the first one's, n their number."""
    return rows.groupBy(*GROUP, "channel_title", *TITLE).agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))


def _mode(rows: DataFrame, given: Column, value: Column, *order: Column) -> DataFrame:
    """The most frequent value of each group, of rows that stand for n entries; equally frequent ones in the given order. value is computed once for what is given."""
    added = [F.sum("n").alias("n"), F.min("seq").alias("first")]
    once = rows.withColumn("given", given).groupBy(*GROUP, "given").agg(F.sum("n").alias("n"), F.min("seq").alias("seq"))
    counted = once.withColumn("value", value).where(F.col("value").isNotNull()).groupBy(*GROUP, "value").agg(*added)
    best = Window.partitionBy(*GROUP).orderBy(F.desc("n"), *order)
    return counted.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*GROUP, "value")


def display_titles(rows: DataFrame) -> DataFrame:
    """The title to show for each group of rows that stand for n entries: most frequent, then shortest, then last in folded order."""
    return _mode(rows, F.col("song_title"), identity.merge_title(F.col("given")), F.char_length("value"), F.desc(text.fold(F.col("value"))), F.col("first")).withColumnRenamed("value", "display_title")


def display_artists(rows: DataFrame) -> DataFrame:
    """The first artist to show for each group of rows that stand for n entries: most frequent, then shortest, then first in folded order."""
    return _mode(rows, F.get("artists", F.lit(0)), F.col("given"), F.char_length("value"), text.fold(F.col("value")), F.col("first")).withColumnRenamed("value", "display_artist")


def groups(rows: DataFrame) -> DataFrame:
    """A row for each group with its keys, display names and number of entries; place orders groups by their first row."""
    rows = keep(counted_titles(rows), "counted")
    first = lambda c: F.min_by(c, "seq")
    made = rows.groupBy(*GROUP).agg(
        F.first("channel_title").alias("channel_title"), F.min("seq").alias("place"), first("merge_key").alias("song_key"),
        F.coalesce(F.min_by("artist_key", F.when(F.col("artist_key") != "", F.col("seq"))), F.lit("")).alias("artist_key"),
        F.array_sort(F.collect_set("merge_key")).alias("title_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("artist_keys")))).alias("artist_keys"),
        F.sum("n").alias("n_entries"),
    )
    made = made.join(display_titles(rows), GROUP).join(display_artists(rows), GROUP, "left")
    return keep(made.withColumn("display_artist", F.coalesce("display_artist", F.lit(""))), "groups")


class _Combined:
    """Cross-channel groups of one component, in order of birth."""

    def __init__(self):
        self.by_song, self.by_artist, self.artist, self.song, self.shown, self.names = {}, {}, [], [], [], []

    def placed(self, row) -> list[tuple]:
        key, artist = row.merge_key, row.artist_key
        target = next((t for t in self.by_song.get(key, []) if compatible(self.artist[t], artist)), None)
        if artist:
            other = next((t for t in sorted(self.by_artist.get(artist, [])) if self.song[t] != key and similar(self.song[t], key)), None)
            target = other if target is None or (other is not None and other < target) else target
        if target is None:
            target = len(self.song)
            self.names.append(row.at)
            self.song.append(key)
            self.artist.append(artist)
            self.shown.append(row.display_artist)
            self.by_song.setdefault(key, []).append(target)
            self.by_artist.setdefault(artist, []).append(target)
        elif not self.shown[target] and row.display_artist:
            self.by_artist.get(self.artist[target], []).remove(target)
            self.shown[target], self.artist[target] = row.display_artist, artist
            self.by_artist.setdefault(artist, []).append(target)
        return [(row.channel_id, row.group_seq, self.names[target])]


def combine(made: DataFrame) -> DataFrame:
    """Groups of all channels with combined, which names the cross-channel group that each joins by its first one's place."""
    at = made.select(*GROUP, F.col("place").alias("at"), F.col("song_key").alias("merge_key"), "artist_key", "display_artist")
    placed = _in_components(_with_component(at, []), "at").mapInPandas(_streamed(_Combined, _Combined.placed, [*GROUP, "combined"]), "channel_id string, group_seq long, combined long")
    return made.join(placed, GROUP)


def combined_groups(rows: DataFrame) -> DataFrame:
    """A row for each cross-channel group of rows from combine(): keys of all, shortest title, first artist, numbers of entries and channels."""
    return rows.groupBy("combined").agg(
        F.min("place").alias("place"),
        F.min_by("channel_id", "place").alias("channel_id"), F.min_by("channel_title", "place").alias("channel_title"),
        F.min_by("song_key", "place").alias("song_key"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("title_keys")))).alias("title_keys"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("artist_keys")))).alias("artist_keys"),
        F.min_by("display_title", F.struct(F.char_length("display_title"), "place")).alias("display_title"),
        F.coalesce(F.min_by("display_artist", F.when(F.col("display_artist") != "", F.col("place"))), F.lit("")).alias("display_artist"),
        F.sum("n_entries").alias("n_entries"), F.count_distinct("channel_id").alias("channel_count"),
    )


def search_grouped(c: Catalogue, song: str | None = None, channel: str | None = None, artist: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of song groups. Songs are filtered after grouping, because groups depend on all rows of a channel."""
    return _page(c, song, channel, artist, limit, offset)[0].drop("combined")


def search_grouped_entries(c: Catalogue, song: str | None = None, channel: str | None = None, artist: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """The entries of search_grouped's page: rank, pos (in the group, newest first), channel_pos and in_channel (the same by channel, largest first, from 0), channel_id, entry_id."""
    page, rows, placed = _page(c, song, channel, artist, limit, offset)
    rows = rows.join(keep(placed.select(*GROUP, "combined", "place").join(page.select("rank", "combined"), "combined"), "shown"), GROUP)
    newest = [F.desc(F.coalesce("published_at", F.lit(""))), F.desc(F.coalesce("seconds", F.lit(0))), F.col("place"), F.col("seq")]
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("rank").orderBy(*newest)))
    rows = rows.withColumn("in_channel", F.row_number().over(Window.partitionBy("rank", "channel_id").orderBy("pos")))
    by_channel = rows.groupBy("rank", "channel_id").agg(F.count(F.lit(1)).alias("n"), F.first("channel_title").alias("channel_title"), F.min("pos").alias("first_pos"))
    largest = Window.partitionBy("rank").orderBy(F.desc("n"), text.fold(F.col("channel_title")), "first_pos")
    by_channel = by_channel.select("rank", "channel_id", (F.row_number().over(largest) - 1).alias("channel_pos"))
    found = rows.join(by_channel, ["rank", "channel_id"])
    return found.select("rank", "entry_id", "channel_id", *[F.col(n).cast("bigint").alias(n) for n in ("pos", "channel_pos", "in_channel")])


def _page(c: Catalogue, song: str | None, channel: str | None, artist: str | None, limit: int, offset: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(page of groups, with combined; entries with their groups; groups with combined and place)."""
    rows = grouped_rows(c, channel, artist)
    made = groups(rows)
    query, query_key = text.normalize_title(F.lit(song or "")), text.compact_key(F.lit(song or ""))
    if song:
        made = made.where((query == "") | identity.group_matches(F.col("title_keys"), F.col("song_key"), query, query_key))
    if channel:
        placed = made.withColumn("combined", F.col("place"))
        shown = placed.withColumn("channel_count", F.lit(1).cast("bigint"))
    else:
        placed = keep(combine(made), "combined")
        shown = combined_groups(placed)
    names = {n: text.fold(F.col(n)) for n in ("channel_title", "display_title", "display_artist")}
    relevance = identity.group_relevance(F.col("title_keys"), F.col("song_key"), query, query_key)
    if song:
        order = [F.when(query != "", relevance), names["channel_title"], names["display_title"], names["display_artist"]]
    elif artist:
        order = [names["display_title"], names["display_artist"], names["channel_title"], F.desc("n_entries")]
    else:
        order = [F.desc("n_entries"), names["channel_title"], names["display_title"], names["display_artist"]]
    page = search.limited(shown, [*order, F.col("place")], limit, offset)
    page = page.select("rank", F.col("display_title").alias("song_title"), F.col("display_artist").alias("artist"), "channel_id", "channel_title", "song_key", F.array_join("title_keys", ",").alias("title_keys"), F.array_join("artist_keys", "|").alias("artist_keys"), "n_entries", "channel_count", "combined")
    return page, rows, placed


def entries_in_order(rows: DataFrame) -> DataFrame:
    """Entries with pos, their place in their group: newest video first, later in the video first, ties as they were."""
    order = Window.partitionBy(*GROUP).orderBy(F.desc(F.coalesce("published_at", F.lit(""))), F.desc(F.coalesce("seconds", F.lit(0))), "seq")
    return rows.withColumn("pos", F.row_number().over(order).cast("bigint"))


def nested_channels(entries: DataFrame, key: str) -> DataFrame:
    """(key, channels): for each value of key the channels with their entries, newest first; channels by number of entries, then title."""
    newest = lambda a, b: F.when((a["published"] > b["published"]) | ((a["published"] == b["published"]) & (a["seconds"] > b["seconds"])), -1).when((a["published"] == b["published"]) & (a["seconds"] == b["seconds"]), F.when(a["entry_id"] < b["entry_id"], -1).otherwise(1)).otherwise(1)
    entry = F.struct(F.coalesce("published_at", F.lit("")).alias("published"), F.coalesce("seconds", F.lit(0)).alias("seconds"), "entry_id")
    by_channel = entries.groupBy(key, "channel_id").agg(F.first("channel_title").alias("channel_title"), F.array_sort(F.collect_list(entry), newest).alias("entries"))
    channel = F.struct((-F.size("entries")).alias("minus_n"), text.fold(F.coalesce("channel_title", F.lit(""))).alias("folded"), "channel_id", "channel_title", "entries")
    return by_channel.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(channel)), lambda x: x.dropFields("minus_n", "folded")).alias("channels"))
