"""DuckDB SQL of grouped search: the greedy grouping as a plain walk, a row at a time, by recursion. Meant for small tables.

The recursion carries, for each channel, the list of its groups; the walk across channels carries the
list of joined groups. Neither knows of components, of pairs or of row ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from cuesheet.plans.oracles import channel_like, fold, q, similar

ORDER = "canonical_song_title, channel_title, normalized_song_title, published_at desc nulls last, seconds, video_id, entry_id"


def near(a: str, b: str) -> str:
    return f"({a} = {b} or (least(length({a}), length({b})) >= 4 and levenshtein({a}, {b}) <= 2))"


def compatible(a: str, b: str) -> str:
    """Equal, unknown, with a common artist, or each artist of a in turn near one of b's that is left."""
    left, right = f"string_split({a}, '|')", f"string_split({b}, '|')"
    match = f"list_filter(acc, lambda y: {near('t[1]', 'y')})"
    rest = f"case when acc is null or len({match}) = 0 then null else list_filter(acc, lambda x: x <> {match}[1]) end"
    in_turn = f"list_reduce(list_transform({left}, lambda one: [one]), lambda acc, t: {rest}, {right}) is not null"
    return f"({a} = {b} or {a} = '' or {b} = '' or list_has_any({left}, {right}) or (len({left}) = len({right}) and {in_turn}))"


def first(condition: str) -> str:
    """The number of the first group (g) that meets the condition."""
    return f"list_filter(range(1, len(groups) + 1), lambda i: {condition.replace('g.', 'groups[i].')})[1]"


def walked(where: str) -> tuple[str, ...]:
    """CTEs to wk_groups: a row for each group of a channel, by a walk over the rows that meet where."""
    same = "g.song = merge_key"
    find = f"""coalesce({first(f"{same} and g.born = artist_key")}, case when artist_key = '' then {first(same)} else coalesce(
      {first(f"{same} and g.born = ''")}, {first(f"{same} and {compatible('g.artist', 'artist_key')}")}, {first(f"g.artist = artist_key and {similar('g.song', 'merge_key')}")}) end)"""
    return (
        f"""wk_rows as materialized (
  select *, row_number() over (partition by channel_id order by seq) as k from (
    select j.*, i.merge_key, i.artist_key, i.artist_keys, i.merged, i.first_artist, i.ambiguous, row_number() over (order by {ORDER}) as seq
    from fx_joined j join identities i on i.title = j.raw_song_title where {where}))""",
        f"""wk_walk(channel_id, k, found, groups) as (
  select distinct channel_id, cast(0 as bigint), cast(0 as bigint), cast([] as struct(song varchar, born varchar, artist varchar)[]) from wk_rows
  union all
  select channel_id, k, coalesce(place, len(groups) + 1),
    case when place is null then list_append(groups, {{'song': merge_key, 'born': artist_key, 'artist': artist_key}})
      when artist_key <> '' and groups[place].artist = '' then list_transform(groups, lambda g, i: case when i = place then {{'song': g.song, 'born': g.born, 'artist': artist_key}} else g end)
      else groups end
  from (select w.channel_id, r.k, merge_key, artist_key, groups, {find} as place from wk_walk w join wk_rows r on r.channel_id = w.channel_id and r.k = w.k + 1))""",
        "wk_placed as materialized (select r.*, w.found as g from wk_rows r join (select channel_id, k, found from wk_walk) w on w.channel_id = r.channel_id and w.k = r.k)",
        f"""wk_titles as (select * from (select *, row_number() over (partition by channel_id, g order by n desc, length(merged), {fold("merged")} desc, first) as place
  from (select channel_id, g, merged, count(*) as n, min(seq) as first from wk_placed where merged is not null group by all)) where place = 1)""",
        f"""wk_artists as (select * from (select *, row_number() over (partition by channel_id, g order by n desc, length(first_artist), {fold("first_artist")}, first) as place
  from (select channel_id, g, first_artist, count(*) as n, min(seq) as first from wk_placed where first_artist is not null group by all)) where place = 1)""",
        """wk_groups as materialized (
  select s.*, t.merged as display_title, coalesce(a.first_artist, '') as display_artist
  from (select channel_id, g, any_value(channel_title) as channel_title, min(seq) as place, arg_min(merge_key, seq) as song_key, coalesce(arg_min(artist_key, seq) filter (artist_key <> ''), '') as artist_key,
    list_sort(list(distinct merge_key)) as title_keys, list_sort(list_distinct(flatten(list(artist_keys)))) as artist_keys, count(*) as n_entries from wk_placed group by channel_id, g) s
  join wk_titles t using (channel_id, g) left join wk_artists a using (channel_id, g))""",
    )


def joined(where: str = "true") -> tuple[str, ...]:
    """CTEs to wk_shown, the groups that meet where joined across channels, and wk_joined, which of them each group joins."""
    same = "g.song = song_key"
    find = first(f"case when {same} then {compatible('g.artist', 'artist_key')} else artist_key <> '' and g.artist = artist_key and {similar('g.song', 'song_key')} end")
    return (
        f"wk_wanted as materialized (select *, row_number() over (order by place) as k from wk_groups where {where})",
        f"""wk_across(k, found, groups) as (
  select cast(0 as bigint), cast(0 as bigint), cast([] as struct(song varchar, artist varchar, shown varchar)[])
  union all
  select k, coalesce(target, len(groups) + 1),
    case when target is null then list_append(groups, {{'song': song_key, 'artist': artist_key, 'shown': display_artist}})
      when groups[target].shown = '' and display_artist <> '' then list_transform(groups, lambda g, i: case when i = target then {{'song': g.song, 'artist': artist_key, 'shown': display_artist}} else g end)
      else groups end
  from (select r.k, song_key, artist_key, display_artist, groups, {find} as target from wk_across w join wk_wanted r on r.k = w.k + 1))""",
        "wk_joined as materialized (select r.*, w.found as combined from wk_wanted r join (select k, found from wk_across) w using (k))",
        """wk_shown as (
  select combined, min(place) as place, arg_min(channel_id, place) as channel_id, arg_min(channel_title, place) as channel_title, arg_min(song_key, place) as song_key,
    list_sort(list_distinct(flatten(list(title_keys)))) as title_keys, list_sort(list_distinct(flatten(list(artist_keys)))) as artist_keys,
    arg_min(display_title, (length(display_title), place)) as display_title, coalesce(arg_min(display_artist, place) filter (display_artist <> ''), '') as display_artist,
    cast(sum(n_entries) as bigint) as n_entries, count(distinct channel_id) as channel_count
  from wk_joined group by combined)""",
    )


def apart() -> tuple[str, ...]:
    """The same of groups that aren't joined across channels."""
    return "wk_joined as materialized (select *, place as combined from wk_groups)", "wk_shown as (select combined, place, channel_id, channel_title, song_key, title_keys, artist_keys, display_title, display_artist, n_entries, cast(1 as bigint) as channel_count from wk_joined)"


def page(order: str, limit: int = 50) -> str:
    return f"""wk_page as (select *, row_number() over (order by {order}, place) as rank from wk_shown order by rank limit {limit})"""


PAGE = """select cast(rank as bigint) as rank, display_title as song_title, display_artist as artist, channel_id, channel_title, song_key, array_to_string(title_keys, ',') as title_keys,
  array_to_string(artist_keys, '|') as artist_keys, n_entries, channel_count from wk_page"""
ENTRIES = f"""select rank, entry_id, channel_id, pos, channel_pos, in_channel from wk_listed join (
  select rank, channel_id, row_number() over (partition by rank order by n desc, {fold("channel_title")}, first_pos) - 1 as channel_pos
  from (select rank, channel_id, any_value(channel_title) as channel_title, count(*) as n, min(pos) as first_pos from wk_listed group by rank, channel_id)) using (rank, channel_id)"""
LISTED = """wk_listed as materialized (
  select *, row_number() over (partition by rank, channel_id order by pos) as in_channel from (
    select p.rank, e.entry_id, e.channel_id, e.channel_title, row_number() over (partition by p.rank order by coalesce(e.published_at, '') desc, coalesce(e.seconds, 0) desc, j.place, e.seq) as pos
    from wk_page p join wk_joined j using (combined) join wk_placed e on e.channel_id = j.channel_id and e.g = j.g))"""


def build(identified: Callable[..., str], artist_match: Callable[[str], str], song: str, channel: str, artist: str) -> dict[str, str]:
    names = [fold(c) for c in ("channel_title", "display_title", "display_artist")]
    word, wanted = q(song), q(song.replace(" ", ""))
    any_key = lambda test: f"len(list_filter(title_keys, lambda k: {test})) > 0"
    alike = similar("k", wanted)
    match = any_key(f"starts_with(k, {wanted}) or {alike}") if len(song) <= 4 else f"({any_key(f'contains(k, {wanted}) or contains({wanted}, k) or {alike}')} or contains(song_key, {word}))"
    relevance = f"""case when list_contains(title_keys, {wanted}) then 0 when {any_key(f"starts_with(k, {wanted})")} then 1 when {any_key(f"contains(k, {wanted})")} then 2 when {any_key(alike)} then 3 when contains(song_key, {word}) then 4 else 5 end"""
    by_size = f"n_entries desc, {', '.join(names)}"
    in_channel = (*walked(channel_like(channel)), *apart(), page(by_size))
    by_song = (*walked("true"), *joined(match), page(f"{relevance}, {', '.join(names)}"))
    by_artist = (*walked(f"not ambiguous and {artist_match(artist)}"), *joined(), page(f"{names[1]}, {names[2]}, {names[0]}, n_entries desc"))
    return {
        "q2_grouped_channel": identified(PAGE, *in_channel),
        "q2_grouped_song": identified(PAGE, *by_song),
        "q2_grouped_artist": identified(PAGE, *by_artist),
        "q2_channel_entries": identified(ENTRIES, *in_channel, LISTED),
        "q2_song_entries": identified(ENTRIES, *by_song, LISTED),
        "q10_cross_channel": identified("select song_key, display_title, display_artist, array_to_string(title_keys, ',') as title_keys, n_entries, channel_count from wk_shown", *walked("true"), *joined()),
    }
