"""Song and artist identity of a raw title, as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .text import SPACE, clean_title, compact_key, filled, is_short_ascii, let, rx, settled, strip

DISTANCE = 2


def is_version_note(value: Column) -> Column:
    latin = "|".join(rf"\b{filled(w)}\b" for w in words.VERSION_WORDS)
    return value.rlike(rx(f"{latin}|{'|'.join(words.VERSION_KANA)}", "idU"))


def is_likely_artist(value: Column) -> Column:
    few_words = F.size(F.filter(F.split(value, rx(f"{SPACE}+")), lambda w: w != "")) <= 5
    calls = value.rlike("[?？!！]")

    def key_fits(key: Column) -> Column:
        n = F.char_length(key)
        return n.between(2, 48) & ~key.isin(*words.ENCORES) & ~(calls & (n > 12))

    return let(compact_key(value), key_fits) & ~is_version_note(value) & few_words


def artist_tokens(artist: Column) -> Column:
    """The likely artists in an artist text, in order."""
    cleaned = F.transform(F.split(artist, rx(filled(words.ARTIST_SPLIT), "idU")), clean_title)
    return F.filter(cleaned, lambda t: (t != "") & is_likely_artist(t))


def merge_title(title: Column) -> Column:
    """The title without version notes at its end, however many; itself if nothing would remain."""
    cut = lambda x: strip(F.regexp_replace(x, rx(filled(words.VERSION_TAIL) + r"\z", "idU"), ""))

    def again(acc: Column, _: Column) -> Column:
        return F.when(acc["done"], acc).otherwise(let(cut(acc["title"]), lambda x: F.struct(x.alias("title"), (x == acc["title"]).alias("done"))))

    def shortened(cleaned: Column) -> Column:
        start = F.struct(cleaned.alias("title"), F.lit(False).alias("done"))
        rounds = F.sequence(F.lit(0), F.char_length(cleaned))
        out = F.aggregate(rounds, start, again, lambda acc: acc["title"])
        return F.coalesce(F.nullif(clean_title(out), F.lit("")), cleaned)

    return let(clean_title(title), shortened)


def halves(value: Column, pattern: str) -> tuple[Column, Column]:
    """The stripped parts before and after the first match; null parts without one."""
    parts = F.split(value, rx(pattern), 2)
    return strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))


def identify(df: DataFrame, raw: str = "raw_song_title") -> DataFrame:
    """df with song_title, artist_text, artists, artist_keys, artist_key, merge_key, source and ambiguous of column raw.

    In steps of named columns, so that each is computed once.
    """
    work = df.withColumn("_original", strip(F.replace(F.col(raw), F.lit("　"), F.lit(" "))))
    work = work.withColumn("_clean", clean_title(F.col("_original")))
    bracket = rx(rf"^{SPACE}*[\[【『「［](.{{1,50}})[\]】』」］]{SPACE}*(.+)\z")
    work = work.withColumns({"_b_artist": clean_title(F.regexp_extract("_original", bracket, 1)), "_b_song": clean_title(F.regexp_extract("_original", bracket, 2))})
    for name, pattern in (("s", rf"{SPACE}*[/／]{SPACE}*"), ("p", rf"{SPACE}*[|｜]{SPACE}*"), ("d", rf"{SPACE}+(?:-|–|—){SPACE}+")):
        left, right = halves(F.col("_clean"), pattern)
        both = (left != "") & (right != "")
        work = work.withColumns({f"_{name}_left": F.when(both, clean_title(left)), f"_{name}_right": F.when(both, clean_title(right))})
    plain = F.col("_d_left").isNotNull() & ~is_version_note(F.col("_d_right"))
    first = plain & compact_key(F.col("_d_left")).isin(*words.KNOWN_ARTISTS)
    last = plain & (compact_key(F.col("_d_right")).isin(*words.KNOWN_ARTISTS) | is_likely_artist(F.col("_d_right")))
    choices = [
        ("bracket", (F.col("_b_song") != "") & is_likely_artist(F.col("_b_artist")), "_b_song", "_b_artist"),
        ("slash", F.col("_s_left").isNotNull(), "_s_left", "_s_right"),
        ("pipe", F.col("_p_left").isNotNull(), "_p_left", "_p_right"),
        ("dash_artist_first", first, "_d_right", "_d_left"),
        ("dash_artist_last", last, "_d_left", "_d_right"),
    ]
    source = F.coalesce(*[F.when(condition, F.lit(name)) for name, condition, _, _ in choices], F.lit("none"))
    work = work.withColumn("source", source)
    pick = lambda at, other: F.coalesce(*[F.when(F.col("source") == c[0], F.col(c[at])) for c in choices], other)
    work = work.withColumns({"song_title": clean_title(pick(2, F.col("_clean"))), "artist_text": clean_title(pick(3, F.lit("")))})
    work = work.withColumn("artists", artist_tokens(F.col("artist_text")))
    keys = F.array_sort(F.array_distinct(F.filter(F.transform("artists", compact_key), lambda k: k != "")))
    work = work.withColumn("artist_keys", keys)
    ambiguous = compact_key(F.col("song_title")).isin(*words.ENCORES) & (F.size("artist_keys") == 0)
    work = work.withColumns({"artist_key": F.array_join("artist_keys", "|"), "ambiguous": ambiguous, "merge_key": compact_key(merge_title(F.col("song_title")))})
    made = ["song_title", "artist_text", "artists", "artist_keys", "artist_key", "merge_key", "source", "ambiguous"]
    return settled(work.drop(*[c for c in work.columns if c.startswith("_")]), made)


def is_similar_key(left: Column, right: Column) -> Column:
    """Equal keys, or one edit apart from six characters on, or two from nine on."""
    shorter = F.least(F.char_length(left), F.char_length(right))
    d = F.levenshtein(left, right, DISTANCE)
    return (left == right) | ((shorter >= 6) & d.between(0, 1)) | ((shorter >= 9) & (d == 2))


def are_near_tokens(left: Column, right: Column) -> Column:
    return (left == right) | ((F.least(F.char_length(left), F.char_length(right)) >= 4) & (F.levenshtein(left, right, DISTANCE) >= 0))


def artist_matches(keys: Column, query_key: Column) -> Column:
    """Whether an artist query's key names one of the keys: short ones exactly, others by containment either way."""
    wide = ~is_short_ascii(query_key) & F.exists(keys, lambda k: (k != "") & (k.contains(query_key) | query_key.contains(k)))
    return (query_key == "") | F.array_contains(keys, query_key) | wide


def any_key(keys: Column, *tests) -> Column:
    return F.exists(keys, lambda k: reduce(or_, (t(k) for t in tests)))


def group_matches(title_keys: Column, group_key: Column, query: Column, query_key: Column) -> Column:
    """Whether a group of songs answers a query: an empty title key is contained in any longer query."""
    similar = lambda k: is_similar_key(k, query_key)
    short = any_key(title_keys, lambda k: k.startswith(query_key), similar)
    wide = any_key(title_keys, lambda k: k.contains(query_key), lambda k: query_key.contains(k), similar) | group_key.contains(query)
    return F.when(query_key == "", True).when(is_short_ascii(query_key), short).otherwise(wide)


def group_relevance(title_keys: Column, group_key: Column, query: Column, query_key: Column) -> Column:
    """0 equal, 1 prefix, 2 contained, 3 similar, 4 query in the group's key, 5 otherwise."""
    return (
        F.when(F.array_contains(title_keys, query_key), 0)
        .when(any_key(title_keys, lambda k: k.startswith(query_key)), 1)
        .when(any_key(title_keys, lambda k: k.contains(query_key)), 2)
        .when(any_key(title_keys, lambda k: is_similar_key(k, query_key)), 3)
        .when(group_key.contains(query), 4)
        .otherwise(5)
    )
