"""DuckDB SQL of the queries, written in RE2's dialect: no look-around, Unicode classes spelled out."""

from __future__ import annotations

import functools
import re

from cuesheet.functions import words

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
W = r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
D = r"\p{Nd}"
CLOCK = rf"(?:{D}{{1,2}}:)?{D}{{1,2}}:{D}{{2}}"


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def filled(pattern: str) -> str:
    return pattern.format(s=W, d=D)


def sub(x: str, pattern: str, by: str = "", every: bool = False) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}{', ' + q('g') if every else ''})"


def matches(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def any_of(x: str, parts: tuple[str, ...]) -> str:
    return matches(x, "|".join(map(re.escape, parts)))


def strip(x: str) -> str:
    return sub(x, f"^{W}+|{W}+$", "", True)


def squeeze(x: str) -> str:
    return sub(x, f"{W}+", " ", True)


@functools.cache
def fold(x: str) -> str:
    """Full case folding: every code point that becomes several is replaced on its own, all others are translated."""
    changed = [(chr(c), chr(c).casefold()) for c in range(0x80, 0x110000) if chr(c).casefold() != chr(c)]
    for sign, several in changed:
        if len(several) > 1:
            x = f"replace({x}, '{sign}', '{several}')"
    single = [(a, b) for a, b in changed if len(b) == 1]
    before, after = (UPPER + "".join(a for a, _ in single), LOWER + "".join(b for _, b in single))
    return f"translate({x}, '{before}', '{after}')"


def unnumbered(x: str) -> str:
    return sub(x, rf"^{W}*(?:(?:{filled(words.NUMBERED)}){W}*|{D}{{1,3}}([\[【［]))", r"\1")


def undecorated(x: str) -> str:
    edge = f"[{W[1:-1]}{words.DECORATION}]+"
    return sub(sub(x, "^" + edge), edge + "$")


def slash(x: str) -> str:
    return f"(contains({x}, '/') or contains({x}, '／'))"


def cleaned(x: str, name: str) -> list[tuple[str, str]]:
    """Steps (column, expression), each over those before, to the cleaned title of x."""
    a, inside, r1, r2, bare, trimmed = (f"{name}_{k}" for k in ("a", "in", "r1", "r2", "b", "c"))
    after = lambda mark: f"trim(regexp_extract({a}, {q(f'(?s)^[^{mark}]*[{mark}](.*)$')}, 1), '[]［］ ')"
    return [
        (a, strip(x)),
        (inside, f"regexp_extract({a}, {q(rf'^{W}*(?:{D}+番のみ{W}*)?[\[［](.+?)[\]］].*$')}, 1)"),
        (r1, after("\\[")),
        (r2, after("［")),
        (bare, f"""case when {inside} <> '' then {inside} when contains({a}, '[') then case when {slash(r1)} then {r1} else {a} end
    when contains({a}, '［') then case when {slash(r2)} then {r2} else {a} end else {a} end"""),
        (trimmed, f"trim({undecorated(unnumbered(bare))}, '[]［］')"),
        (name, strip(squeeze(f"case when {slash(trimmed)} then {sub(trimmed, rf'^{D}{{1,3}}([A-Za-z{words.KANA_TO_HAN}])', chr(92) + '1')} else {trimmed} end"))),
    ]


def layered(source: str, *steps) -> str:
    """source with the columns of all steps, one subquery each: DuckDB would repeat the expressions of aliases."""
    for step in steps:
        for name, expression in [step] if isinstance(step, tuple) else step:
            source = f"(select *, {expression} as {name} from {source})"
    return source


def normal(x: str) -> str:
    out = sub(sub(unnumbered(f"replace({x}, '　', ' ')"), r"[(\[{<].*?[)\]}>]", " ", True), "[【（「『〈《].*?[】）」』〉》]", " ", True)
    return strip(fold(squeeze(undecorated(out))))


def key(x: str) -> str:
    return sub(normal(x), r"[^\p{L}\p{N}]+", "", True)


def separated(x: str) -> str:
    return matches(x, filled(words.SEPARATOR))


def quoted(x: str) -> str:
    return "(" + " or ".join(f"(starts_with({strip(x)}, {q(a)}) and ends_with({strip(x)}, {q(b)}))" for a, b in words.QUOTES) + ")"


def non_song(raw: str, norm: str) -> str:
    compact = f"replace({norm}, ' ', '')"
    starts = " or ".join(f"starts_with({compact}, {q(s)})" for s in words.NON_SONG_STARTS)
    return f"""({compact} in ({", ".join(map(q, words.NON_SONG_WHOLE))}) or {any_of(norm, words.NON_SONG_PARTS)} or {any_of(fold(raw), words.NON_SONG_PARTS)}
    or {matches(raw, "[=＝]")} or {matches(norm, "[?？]")} or {starts} or ({quoted(raw)} and not {separated(raw)}))"""


def probable(raw: str, norm: str) -> str:
    clock = matches(raw, rf"(?:^|[^{D}]){CLOCK}(?:$|[^{D}])")
    date = matches(raw, rf"^{W}*{D}{{1,2}}/{D}{{1,2}}")
    people = matches(raw, rf"{D}[{D},]*{W}*人")
    return f"""(length(replace({norm}, ' ', '')) >= 2 and not {clock} and not ({date} and not {separated(raw)}) and not {people}
    and ({separated(raw)} or (not {non_song(raw, norm)} and {matches(norm, words.LETTER_OR_CJK)})))"""


def doubtful(title: str, norm: str) -> str:
    people = f"(contains({title}, '人') and {matches(title, D)})"
    return f"(not {matches(title, '[/／–—|｜]| - ')} and ({any_of(fold(norm), words.DOUBTFUL_PARTS)} or {matches(title, '[?？]')} or {people}))"


def seconds(clock: str) -> str:
    parts = f"string_split(translate({strip(clock)}, '０１２３４５６７８９', '0123456789'), ':')"
    n = [f"try_cast({parts}[{i}] as bigint)" for i in (1, 2, 3)]
    return f"case len({parts}) when 2 then {n[0]} * 60 + {n[1]} when 3 then {n[0]} * 3600 + {n[1]} * 60 + {n[2]} end"


def similar(a: str, b: str) -> str:
    return f"({a} = {b} or (least(length({a}), length({b})) >= 6 and levenshtein({a}, {b}) <= 1) or (least(length({a}), length({b})) >= 9 and levenshtein({a}, {b}) = 2))"


def values(rows: tuple, columns: str) -> str:
    made = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in (row if isinstance(row, tuple) else (row,))) + ")" for row in rows)
    return f"(select * from (values {made}) as given({columns}))"


SONG_ID = "cast('0x' || substr(md5(channel_id || chr(31) || normalized_song_title), 1, 15) as bigint)"
SAMPLE = f"""
fx_channels as (select concat('UC', lpad(cast(n_nationkey as varchar), 3, '0')) as channel_id, n_name as channel_title from nation),
fx_videos as (
  select concat('v', cast(o_orderkey as varchar)) as video_id, concat('UC', lpad(cast(c_nationkey as varchar), 3, '0')) as channel_id,
    concat(case when o_orderkey % 3 = 0 then 'Karaoke ' else 'Game ' end, o_orderpriority) as title,
    case when o_orderkey % 17 <> 0 then concat(substr(cast(o_orderdate as varchar), 1, 10), 'T00:00:00Z') end as published_at,
    concat('https://www.youtube.com/watch?v=v', cast(o_orderkey as varchar)) as url
  from orders join customer on c_custkey = o_custkey),
fx_raw as (
  select cast(l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as bigint) as entry_id,
    concat('v', cast(l_orderkey as varchar)) as video_id, cast(l_linenumber * 300 as bigint) as seconds, concat(cast(l_linenumber * 5 as varchar), ':00') as timestamp_text,
    concat(p_name, case when p_size % 5 = 0 then ' -piano ver.' else '' end, case when p_size % 3 = 0 then '' else concat(' / ', p_type) end) as raw_song_title
  from lineitem join part on p_partkey = l_partkey),
fx_norms as (select raw_song_title, {normal("raw_song_title")} as normalized_song_title from (select distinct raw_song_title from fx_raw)),
fx_kept as (
  select * from (select *, row_number() over (partition by video_id, seconds, normalized_song_title order by entry_id) as n from fx_raw join fx_norms using (raw_song_title)) where n = 1),
fx_placed as (select k.*, channel_id, {SONG_ID} as song_id, concat('https://www.youtube.com/watch?v=', video_id, '&t=', cast(seconds as varchar), 's') as jump_url from fx_kept k join fx_videos using (video_id)),
fx_songs as (
  select channel_id, normalized_song_title, arg_min(raw_song_title, entry_id) as canonical_song_title, {SONG_ID} as song_id from fx_placed group by channel_id, normalized_song_title),
fx_joined as (
  select s.song_id, canonical_song_title, s.normalized_song_title, raw_song_title, timestamp_text, seconds, jump_url, e.video_id, v.title as video_title, published_at, c.channel_id, channel_title, entry_id
  from fx_placed e join fx_songs s on s.song_id = e.song_id join fx_videos v on v.video_id = e.video_id join fx_channels c on c.channel_id = v.channel_id),
fx_lines as (
  select video_id, entry_id % 2 as comment_pos, entry_id, concat(timestamp_text, ' ', case when entry_id % 11 = 0 then 'MC' else raw_song_title end) as line from fx_raw),
fx_comments as (
  select video_id, comment_pos, concat(case when max(entry_id) % 3 = 0 then concat('Setlist', chr(10)) else '' end, string_agg(line, chr(10) order by entry_id)) as text
  from fx_lines group by video_id, comment_pos)"""


def over(body: str, *more: str) -> str:
    return "with recursive " + ",\n".join((SAMPLE.strip(), *more)) + "\n" + body


def searched(where: str, order: str, limit: int) -> str:
    order += ", video_id, entry_id"
    return over(f"select * exclude (entry_id), cast(row_number() over (order by {order}) as bigint) as rank from (select * from fx_joined where {where} order by {order} limit {limit})")


def word_match(query: str) -> str:
    n = "normalized_song_title"
    return f"({n} = '{query}' or " + " or ".join([f"starts_with({n}, '{query}{d}')" for d in " /-:"] + [f"contains({n}, '{d}{query}')" for d in " /-|"]) + ")"


def relevance(query: str) -> str:
    return f"case when normalized_song_title = '{query}' then 0 when starts_with(normalized_song_title, '{query}') then 1 else 2 end"


AFTER = "channel_title, normalized_song_title, published_at desc nulls last, seconds"


def channel_like(query: str) -> str:
    return f"(contains(translate(channel_title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{query.lower()}') or channel_id = '{query}')"


def song_list(where: str, limit: int | None) -> str:
    rank = "" if limit is None else ", cast(row_number() over (order by channel_title, normalized_song_title, channel_id) as bigint) as rank"
    return over(f"""select *{rank} from (select song_id, channel_id, channel_title, canonical_song_title, normalized_song_title, count(entry_id) as entry_count, count(distinct video_id) as video_count,
  max(published_at) as latest_published_at from fx_songs join fx_channels using (channel_id) left join (select song_id, entry_id, video_id, published_at from fx_placed left join fx_videos using (video_id)) using (song_id)
where {where} group by all order by channel_title, normalized_song_title, channel_id{"" if limit is None else f" limit {limit}"})""")


def song_counts(where: str) -> str:
    return over(f"select {SONG_ID} as song_id, channel_id, normalized_song_title, arg_min(raw_song_title, entry_id) as canonical_song_title, count(*) as entry_count from fx_placed where {where} group by channel_id, normalized_song_title")


def build(titles: tuple, clocks: tuple, channels: tuple, comments: tuple, query_keys: tuple) -> dict[str, str]:
    from cuesheet.plans import walks  # which is made of this module's pieces

    raw_titles = f"raw_titles as (select raw_song_title as title from fx_raw union select title from {values(titles, 'title')})"
    all_titles = "titles as (select title from raw_titles union select unnest(string_split(text, chr(10))) from documents)"
    over_titles = lambda columns: over(f"select title, {columns} from titles", raw_titles, all_titles)

    version_tail = filled(words.VERSION_TAIL)
    word = "|".join(rf"\b{filled(w)}\b" for w in words.VERSION_WORDS)
    note = lambda x: matches(x, f"(?i){word}|{'|'.join(words.VERSION_KANA)}")

    def likely(x: str) -> str:
        n = f"length({key(x)})"
        return f"""({n} between 2 and 48 and {key(x)} not in ({", ".join(map(q, words.ENCORES))}) and not {note(x)} and not ({matches(x, "[?？!！]")} and {n} > 12)
          and len(list_filter(regexp_split_to_array({x}, {q(W + "+")}), lambda w: w <> '')) <= 5)"""

    def merged_steps(x: str) -> list:
        return [*cleaned(x, "m0"), ("m1", strip(sub("m0", f"(?i)(?:{version_tail})+$"))), *cleaned("m1", "m2"), ("merged", "case when m2 <> '' then m2 else m0 end")]

    def halves(name: str, pattern: str) -> list[tuple[str, str]]:
        """Steps to {name}_l and {name}_r, what is before and after the first match in c, cleaned, and {name}_ok, whether both are there."""
        m, x, y = f"{name}_m", f"{name}_x", f"{name}_y"
        return [
            (m, f"regexp_extract(c, {q(pattern)})"),
            (x, f"case when {m} <> '' then {strip(f'substr(c, 1, instr(c, {m}) - 1)')} else '' end"),
            (y, f"case when {m} <> '' then {strip(f'substr(c, instr(c, {m}) + length({m}))')} else '' end"),
            (f"{name}_ok", f"{x} <> '' and {y} <> ''"), *cleaned(x, f"{name}_l"), *cleaned(y, f"{name}_r"),
        ]

    bracket = rf"^{W}*[\[【『「［](.{{1,50}})[\]】』」］]{W}*(.+)$"
    split = "(?i)" + filled(words.ARTIST_SPLIT)
    known = ", ".join(map(q, words.KNOWN_ARTISTS))
    parts = layered("raw_titles", ("o", strip("replace(title, '　', ' ')")), cleaned("o", "c"), cleaned(f"regexp_extract(o, {q(bracket)}, 1)", "b_artist"), cleaned(f"regexp_extract(o, {q(bracket)}, 2)", "b_song"),
                    halves("s", f"{W}*[/／]{W}*"), halves("p", f"{W}*[|｜]{W}*"), halves("d", f"{W}+(?:-|–|—){W}+"))
    sources = f"""case when b_song <> '' and {likely("b_artist")} then 'bracket' when s_ok then 'slash' when p_ok then 'pipe'
    when d_ok and not {note("d_r")} and {key("d_l")} in ({known}) then 'dash_artist_first' when d_ok and not {note("d_r")} and ({key("d_r")} in ({known}) or {likely("d_r")}) then 'dash_artist_last' else 'none' end"""
    pick = lambda *c: "case source " + " ".join(f"when '{k}' then {v}" for k, v in zip(("bracket", "slash", "pipe", "dash_artist_first", "dash_artist_last"), c, strict=False)) + f" else {c[-1]} end"
    picked = layered("id_parts", ("source", sources), ("song0", pick("b_song", "s_l", "p_l", "d_r", "d_l", "c")), ("artist0", pick("b_artist", "s_r", "p_r", "d_l", "d_r", "''")), cleaned("song0", "song_title"), cleaned("artist0", "artist_text"))
    tokens = layered(f"(select title, unnest(regexp_split_to_array(artist_text, {q(split)})) as t0, generate_subscripts(regexp_split_to_array(artist_text, {q(split)}), 1) as i from id_picked)", cleaned("t0", "token"), ("token_key", key("token")))
    identity = f"""
id_parts as materialized (select * from {parts}),
id_picked as materialized (select title, source, song_title, artist_text from {picked}),
id_tokens as materialized (select title, i, token, token_key from {tokens}),
id_artists as (
  select title, string_agg(token, '|' order by i) as artists, arg_min(token, i) as first_artist, string_agg(distinct token_key, '|' order by token_key) filter (token_key <> '') as artist_key,
    list_sort(list(distinct token_key) filter (token_key <> '')) as artist_keys
  from id_tokens where token <> '' and {likely("token")} group by title),
id_merged as materialized (select title, song_title, source, artist_text, merged from {layered("id_picked", merged_steps("song_title"))}),
identities as materialized (
  select m.title, song_title, artist_text, source, merged, {key("merged")} as merge_key, coalesce(artists, '') as artists, coalesce(artist_key, '') as artist_key, coalesce(artist_keys, []) as artist_keys,
    first_artist, {key("song_title")} in ({", ".join(map(q, words.ENCORES))}) and coalesce(artist_key, '') = '' as ambiguous
  from id_merged m left join id_artists using (title))"""
    identified = lambda body, *more: over(body, raw_titles, identity.strip(), *more)

    line = rf"^{W}*(?:[-*+>~#]|{D}+[.)\]]|\[{W}*{D}+{W}*\])?{W}*({CLOCK}){W}*(.+?){W}*$"
    doubled = sub("text", rf"([^{D}:])", r"\1\1", True)
    timeline = f"""
tl_comments as (select video_id, comment_pos, text from COMMENTS),
tl_lines0 as materialized (
  select video_id, comment_pos, line_no - 1 as line_no, parts[line_no] as line
  from (select video_id, comment_pos, parts, unnest(range(1, len(parts) + 1)) as line_no from (select *, regexp_split_to_array(text, {q(chr(13) + chr(10) + "|[" + r"\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}" + "]")}) as parts from tl_comments))),
tl_texts as materialized (
  select line, timestamp_text, raw, norm, timestamp_text is not null and {probable("raw", "norm")} as is_entry, {matches("line", "(?i)" + filled(words.MARKER))} as is_marker,
    {matches(strip("line"), f"^[-=*_~{W[1:-1]}・ー‐-―]*$")} as is_blank
  from {layered("(select distinct line from tl_lines0)", ("timestamp_text", f"nullif(regexp_extract(line, {q(line)}, 1), '')"), cleaned(f"regexp_extract(line, {q(line)}, 2)", "raw"), ("norm", normal("raw")))}),
tl_lines as (
  select l.*, timestamp_text, raw as raw_song_title, norm as normalized_song_title, is_entry, is_marker, not is_entry and not is_marker and not is_blank as is_plain,
    case when is_entry then {seconds("timestamp_text")} end as seconds from tl_lines0 l join tl_texts using (line)),
tl_wide as (
  select *, sum(cast(not is_entry as int)) over so_far as run, sum(cast(is_plain as int)) over so_far as plain_lines, bool_or(is_marker) over (partition by video_id, comment_pos) as has_marker,
    coalesce(lag(is_entry) over (partition by video_id, comment_pos order by line_no), false) as follows
  from tl_lines where (video_id, comment_pos) in (select (video_id, comment_pos) from tl_comments where len(regexp_extract_all({doubled}, {q(rf"(?:^|[^{D}]){CLOCK}(?:$|[^{D}])")})) >= 2)
  window so_far as (partition by video_id, comment_pos order by line_no rows between unbounded preceding and current row)),
tl_next as materialized (
  select *, min(line_no) filter (is_entry) over ahead as next_entry, min(plain_lines) filter (is_entry) over ahead - plain_lines as plain_before
  from tl_wide window ahead as (partition by video_id, comment_pos order by line_no rows between current row and unbounded following)),
tl_starts as (
  select distinct video_id, comment_pos, next_entry as line_no from tl_next where is_marker and plain_before <= 5
  union select video_id, comment_pos, line_no from tl_next where is_entry and not has_marker and not follows),
tl_blocks as (
  select s.video_id, s.comment_pos, cast(s.line_no as bigint) as start_line, any_value(h.run) as run, count(*) as n_entries, cast(max(e.seconds) - min(e.seconds) as bigint) as span,
    count(*) filter ({separated("e.raw_song_title")}) as artist_lines, any_value(h.has_marker) as has_marker
  from tl_starts s join tl_next h on h.video_id = s.video_id and h.comment_pos = s.comment_pos and h.line_no = s.line_no
  join tl_next e on e.video_id = s.video_id and e.comment_pos = s.comment_pos and e.run = h.run and e.is_entry and e.line_no >= s.line_no
  group by s.video_id, s.comment_pos, s.line_no having count(*) >= 2),
tl_candidates as (
  select * exclude (n), cast(cast(has_marker as int) * 1000 + n_entries * 20 + artist_lines * 3 + least(span // 600, 20) as bigint) as score
  from (select *, row_number() over (partition by video_id, comment_pos order by n_entries desc, span desc, start_line) as n from tl_blocks) where n = 1),
tl_best as (
  select * exclude (n) from (select *, row_number() over (partition by video_id order by has_marker desc, score desc, n_entries desc, comment_pos) as n from tl_candidates) where n = 1),
tl_entries as (
  select b.video_id, l.line_no as entry_id, l.timestamp_text, l.seconds, l.raw_song_title, l.normalized_song_title
  from tl_best b join tl_next l on l.video_id = b.video_id and l.comment_pos = b.comment_pos and l.run = b.run and l.is_entry and l.line_no >= b.start_line),
tl_kept as (
  select * exclude (n) from (select *, row_number() over (partition by video_id, seconds, normalized_song_title order by entry_id) as n from tl_entries) where n = 1)"""
    given = f"(select * from fx_comments union all select video_id, comment_pos, text from {values(comments, 'video_id, comment_pos, text')})"
    lined = lambda body, source=given: over(body, timeline.strip().replace("COMMENTS", source))
    keyed = "keyed as (select j.*, i.merge_key, i.merged, i.first_artist from fx_joined j join identities i on i.title = j.raw_song_title)"

    def matching(query: str) -> str:
        return over_identities([f"case when {q(k)} = '' then true when {matches(q(k), '^[A-Za-z0-9]{1,4}$')} then starts_with(merge_key, {q(k)}) or {similar('merge_key', q(k))} else contains(merge_key, {q(k)}) or contains({q(k)}, merge_key) or {similar('merge_key', q(k))} end" for k in query])

    def over_identities(columns: list[str]) -> str:
        return identified("select title, " + ", ".join(f"{c} as q{i}" for i, c in enumerate(columns)) + " from identities")

    def artist_match(query_key: str) -> str:
        if not query_key:
            return "true"
        wide = "false" if len(query_key) <= 4 else f"len(list_filter(artist_keys, lambda k: contains(k, {q(query_key)}) or contains({q(query_key)}, k))) > 0"
        return f"(list_contains(artist_keys, {q(query_key)}) or {wide})"

    again = """again as (select * from fx_placed where ends_with(video_id, '7') and entry_id % 2 = 1),
stays as (select * from fx_placed where video_id not in (select video_id from again)),
mixed as (select video_id, seconds, raw_song_title, normalized_song_title, song_id, jump_url from stays
  union all select video_id, seconds + 30, raw_song_title, normalized_song_title, song_id, concat('https://www.youtube.com/watch?v=', video_id, '&t=', cast(seconds + 30 as varchar), 's') from again)"""
    odd = f"""odd0 as (
  select entry_id + 500 + which as entry_id, video_id, title as raw_song_title, case which when 0 then 'extra' else lower(title) end as normalized_song_title, which
  from (select entry_id, video_id, unnest(range(5)) as which, unnest(['[Clash] extra', 'Clash', 'MC', 'goods ' || video_id, 'bgm']) as title from fx_placed where ends_with(video_id, '3') and entry_id % 1000 = 1)),
odd as (select o.*, channel_id, {SONG_ID} as song_id, which = 1 or (which = 4 and count(*) over (partition by channel_id, which) > 1) as kept from odd0 o join fx_videos using (video_id)),
stored as (select entry_id, song_id, raw_song_title, normalized_song_title from fx_placed union all select entry_id, song_id, raw_song_title, normalized_song_title from odd)"""
    counted = """counts as (select (select count(*) from fx_placed) as b, (select count(distinct video_id) from tl_kept) as v,
  (select count(*) from fx_placed where video_id not in (select video_id from tl_kept)) + (select count(*) from tl_kept) as a)"""
    bare = strip("channel")
    path = f"list_filter(string_split(regexp_extract({bare}, '(?is)^https?://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')"
    named = f"case when {matches(bare, '(?i)^https?://')} and len({path}) > 0 then case when starts_with({path}[1], '@') then {path}[1] when {path}[1] = 'channel' and len({path}) > 1 then {path}[2] else {path}[-1] end else {bare} end"
    page = "html || case when page_id % 3 = 0 then '\"channelId\":\"UC' || cast(page_id as varchar) || '\"' else '' end"
    found = ", ".join(f"nullif(regexp_extract({page}, {q(p)}, 1), '')" for p in words.CHANNEL_PAGE)
    return {
        "q1_search_ascii": searched(word_match("red"), f"{relevance('red')}, {AFTER}", 50),
        "q1_search_substring": searched("contains(normalized_song_title, 'widget / l')", f"{relevance('widget / l')}, {AFTER}", 50),
        "q1_search_channel": searched(f"{word_match('blue')} and {channel_like('nation_2')}", f"{relevance('blue')}, {AFTER}", 50),
        "q1_no_query_ordinal": searched("true", f"canonical_song_title, {AFTER}", 50),
        "q3_search_legacy": searched("contains(normalized_song_title, 'old')", f"{relevance('old')}, normalized_song_title, published_at desc nulls last, seconds", 25),
        "q4_list_songs": song_list("true", None),
        "q4_list_songs_channel": song_list(channel_like("NATION_1"), 100),
        "q5_list_channels": over("""select channel_id, channel_title, coalesce(v, 0) as video_count, coalesce(s, 0) as song_count, coalesce(e, 0) as entry_count from fx_channels
  left join (select channel_id, count(*) as v from fx_videos group by 1) using (channel_id) left join (select channel_id, count(*) as s from fx_songs group by 1) using (channel_id)
  left join (select channel_id, count(*) as e from fx_placed group by 1) using (channel_id)"""),
        "q6_stats": over("select (select count(*) from fx_channels) as channels, (select count(*) from fx_videos) as videos, (select count(*) from fx_songs) as songs, (select count(*) from fx_placed) as song_entries"),
        "snk1_upsert_channel": over("""select channel_id, case when n % 2 = 0 then 'renamed ' || channel_id else channel_title end as channel_title
from fx_channels left join (select channel_id, count(*) as n from fx_videos group by 1) using (channel_id) union all select 'UCnew', 'second'"""),
        "snk2_upsert_video": over("select video_id, channel_id, case when starts_with(title, 'Karaoke 1') then title || ' again' else title end as title, published_at, url from fx_videos"),
        "snk3_canonical_title": over("select song_id, channel_id, normalized_song_title, canonical_song_title from fx_songs"),
        "snk4_insert_ignore": over("select entry_id, song_id, video_id, seconds, raw_song_title, normalized_song_title, jump_url from fx_placed"),
        "snk5_replace_video": over("select * from mixed", again),
        "snk6_orphans": over("select song_id, channel_id, normalized_song_title from fx_songs where song_id not in (select song_id from fx_placed where seconds < 900)"),
        "snk7_backfill": song_counts("true"),
        "snk8_rebuild": song_counts("seconds >= 600"),
        "snk9_needs_backfill": "select true as needs_backfill",
        "w1_song_count": over("select entry_id, song_id, count(*) over (partition by song_id) as entry_count from fx_placed"),
        "a5_low_confidence": over(f"select entry_id, raw_song_title, entry_count from (select *, count(*) over (partition by song_id) as entry_count from stored) where entry_count <= 1 and {doubtful('raw_song_title', 'normalized_song_title')}", odd),
        "p2_urls": over("select video_id, url, url || '&t=' || cast(length(title) as varchar) || 's' as jump_url from fx_videos"),
        "p3_date": over("select video_id, substr(coalesce(nullif(case when ends_with(video_id, '5') then '' else published_at end, ''), 'unknown'), 1, 10) as shown from fx_videos"),
        "f6_title_filter": over(f"select video_id, title from fx_videos where {any_of(fold('title'), words.STREAM_PARTS)}"),
        "f7_artist_match": identified(f"select title, {artist_match('yoasobi')} as yoasobi, {artist_match('eco')} as eco, {artist_match('economyclass')} as economy_class, true as empty from identities"),
        "f8_cap": "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn) as n from conversations) where n <= 3",
        "f10_low_conf": over(f"select title, {doubtful('title', 'n')} as doubtful from {layered('titles', ('n', normal('title')))}", raw_titles, all_titles),
        "o8_page": over("""select *, cast(row_number() over (order by n desc, normalized_song_title) + 20 as bigint) as rank
from (select normalized_song_title, count(*) as n from fx_songs group by 1 order by n desc, 1 limit 20 offset 20)"""),
        "t1_seconds": over(f"""select clock, {seconds('clock')} as seconds from (select clock from {values(clocks, 'clock')} union select timestamp_text from fx_raw
  union select concat(n % 30, ':', lpad(cast(n % 60 as varchar), 2, '0'), ':', lpad(cast(n % 77 as varchar), 2, '0')) from (select cast(substr(video_id, 2) as bigint) as n from fx_videos))"""),
        "t2_clean": over(f"select title, cleaned from {layered('titles', cleaned('title', 'cleaned'))}", raw_titles, all_titles),
        "t3_normalize": over_titles(f"{normal('title')} as normal"),
        "t4_probable": over(f"select title, {probable('r', 'n')} as probable, {non_song('r', 'n')} as non_song from {layered('titles', cleaned('title', 'r'), ('n', normal('r')))}", raw_titles, all_titles),
        "t14_compact": over_titles(f"{key('title')} as compact"),
        "t17_artist_tokens": identified("select title, artists, artist_key as artist_keys from identities"),
        "t20_canonical": over(f"select title, merged from {layered('raw_titles', merged_steps('title'))}", raw_titles),
        "t21_similar_pairs": identified(f"""select a.merge_key, b.merge_key as other from (select distinct merge_key from identities where merge_key <> '') a join (select distinct merge_key from identities where merge_key <> '') b
  on a.merge_key < b.merge_key and {similar("a.merge_key", "b.merge_key")}"""),
        "t23_token_pairs": identified("""select a.token, b.token as other from tokens a join tokens b on a.token < b.token and least(length(a.token), length(b.token)) >= 4 and levenshtein(a.token, b.token) <= 2""", "tokens as (select distinct unnest(artist_keys) as token from identities)"),
        "t28_channel_input": f"select channel, {named} as named from (select channel from {values(channels, 'channel')} union select url from pages)",
        "t9_lines": lined("select video_id, comment_pos, cast(line_no as bigint) as line_no, timestamp_text, seconds, raw_song_title, normalized_song_title from tl_lines where is_entry"),
        "t10_blocks": lined("select video_id, comment_pos, start_line, n_entries, span, artist_lines, has_marker from tl_blocks"),
        "t11_candidates": lined("select video_id, comment_pos, start_line, n_entries, span, artist_lines, has_marker, score from tl_candidates"),
        "a10_best_comment": lined("select video_id, comment_pos, n_entries, span, artist_lines, has_marker, score from tl_best"),
        "q9_index": lined("select video_id, timestamp_text, seconds, raw_song_title, normalized_song_title, concat('https://www.youtube.com/watch?v=', video_id, '&t=', cast(seconds as varchar), 's') as jump_url from tl_kept", "(select c.* from fx_comments c join fx_videos v using (video_id) where starts_with(v.title, 'Karaoke'))"),
        "q8_rebuild_stats": lined("select v as videos_changed, b as entries_before, a as entries_after, b - a as entries_removed from counts", "(select video_id, cast(row_number() over (partition by video_id order by text) as bigint) as comment_pos, text from (select distinct video_id, text from fx_comments))").replace("\nselect v as", ",\n" + counted + "\nselect v as"),
        "t15_identity": identified("select title, song_title, artist_text, source, ambiguous, artist_key, merge_key from identities"),
        "a7_display_title": identified(f"""select channel_id, merge_key, merged as display_title from (select *, row_number() over (partition by channel_id, merge_key order by n desc, length(merged), {fold("merged")} desc, first) as r
  from (select channel_id, merge_key, merged, count(*) as n, min(entry_id) as first from keyed group by all)) where r = 1""", keyed),
        "a8_display_artist": identified(f"""select channel_id, merge_key, first_artist as display_artist from (select *, row_number() over (partition by channel_id, merge_key order by n desc, length(first_artist), {fold("first_artist")}, first) as r
  from (select channel_id, merge_key, first_artist, count(*) as n, min(entry_id) as first from keyed where first_artist is not null group by all)) where r = 1""", keyed),
        "o9_entry_order": identified("select channel_id, merge_key, entry_id, row_number() over (partition by channel_id, merge_key order by coalesce(published_at, '') desc, seconds desc, entry_id) as pos from keyed", keyed),
        "a9_channel_nesting": over("""select title_key, row_number() over (partition by title_key order by n desc, lower(channel_title), channel_id) - 1 as channel_pos, channel_id, entry_ids
from (select array_to_string(string_split(canonical_song_title, ' ')[1:2], ' ') as title_key, channel_id, any_value(channel_title) as channel_title, count(*) as n,
  string_agg(cast(entry_id as varchar), ',' order by coalesce(published_at, '') desc, seconds desc, entry_id) as entry_ids from fx_joined group by 1, 2)"""),
        "o10_relevance": over_identities([f"cast(case when merge_key = {q(k)} then 0 when starts_with(merge_key, {q(k)}) then 1 when contains(merge_key, {q(k)}) then 2 when {similar('merge_key', q(k))} then 3 else 5 end as bigint)" for k in query_keys]),
        "f13_group_filter": matching(query_keys),
        "s1_key_union": identified("""select g.merge_key, coalesce(string_agg(distinct k, '|' order by k), '') as artist_keys from (select distinct merge_key from identities) g
  left join (select merge_key, unnest(artist_keys) as k from identities) i using (merge_key) group by g.merge_key"""),
        "s2_key_overlap": identified("""select a.merge_key, a.artist_key as left_keys, b.artist_key as right_keys from pairs a join pairs b on a.merge_key = b.merge_key and list_has_any(a.artist_keys, b.artist_keys)""", "pairs as (select distinct merge_key, artist_key, artist_keys from identities where len(artist_keys) > 0)"),
        "q7_prune": over("select song_id, count(*) as entry_count, min(raw_song_title) as least_title from (select song_id, raw_song_title from fx_placed union all select song_id, raw_song_title from odd where kept) group by song_id", odd),
        "q7_pruned_entries": over("select entry_id from odd where not kept", odd),
        "a14_index_stats": lined(f"""select (select count(*) from fx_videos) as videos_seen, (select count(*) from fx_videos where {any_of(fold('title'), words.STREAM_PARTS)}) as videos_indexed,
  (select count(*) from fx_videos where not {any_of(fold('title'), words.STREAM_PARTS)}) as videos_skipped, (select count(*) from tl_comments) as comments_seen, (select count(distinct video_id) from tl_kept) as timeline_comments,
  (select count(*) from tl_kept) as entries_inserted""", f"(select * exclude (n) from (select c.*, row_number() over (partition by video_id order by comment_pos) as n from fx_comments c join fx_videos v using (video_id) where {any_of(fold('v.title'), words.STREAM_PARTS)}) where n = 1)"),
        "a14_merged_stats": lined(f"""select (select count(*) from fx_videos) as videos_seen, (select count(*) from a14_videos where streamed) as videos_indexed,
  (select count(*) from a14_videos where not streamed) + (select count(*) from a14_videos where n % 13 = 0 and streamed) as videos_skipped, (select count(*) from tl_comments) as comments_seen,
  (select count(distinct video_id) from tl_kept) as timeline_comments, (select count(*) from tl_kept) as entries_inserted
  from (select 1)""", f"""(select * exclude (n, streamed) from (select c.*, n, streamed from fx_comments c join (select video_id, cast(substr(video_id, 2) as bigint) as n, {any_of(fold('title'), words.STREAM_PARTS)} as streamed from fx_videos) using (video_id)) where n % 13 <> 0 and streamed)""").replace("tl_comments as (", f"a14_videos as (select video_id, cast(substr(video_id, 2) as bigint) as n, {any_of(fold('title'), words.STREAM_PARTS)} as streamed from fx_videos),\ntl_comments as (", 1),
        "src1_videos": over("""select video_id, case when o % 5 > 0 then title else '' end as title, channel_id, case when o % 7 > 0 then channel_title else '' end as channel_title, published_at
  from (select v.*, cast(substr(video_id, 2) as bigint) as o, channel_title from fx_videos v join fx_channels using (channel_id))"""),
        "src2_comments": over("""select video_id, cast(2000 + row_number() over (partition by video_id order by comment_pos) - 1 as bigint) as comment_pos, video_id || '-' || cast(comment_pos as varchar) as comment_id,
  case when length(text) % 9 > 0 then text else '' end as text, case when length(text) % 2 > 0 then 'someone' else '' end as author, case when length(text) % 3 > 0 then '2024-03-03' end as published_at from fx_comments"""),
        "src4_channels": over("""select channel_id, case when cast(substr(channel_id, 3) as int) % 3 > 0 then channel_title else '' end as channel_title, 'UU' || substr(channel_id, 3) as uploads_playlist_id
  from fx_channels where cast(substr(channel_id, 3) as int) % 4 > 0"""),
        "js1_json_extract": "select event_id, json_extract_string(props, '$.k') as k from events",
        "src3_uploads": """select 'c' || cast(c_custkey as varchar) as video_id, c_name as title, case when c_custkey % 3 = 1 then 'UC' || cast(c_nationkey as varchar) else c_mktsegment end as channel_id,
  'shared' as channel_title, case when c_custkey % 5 > 0 then '2024-02-02' else '2024-01-01' end as published_at from customer where c_custkey % 7 > 0""",
        **walks.build(identified, artist_match, "red", "NATION_1", "promo"),
        "src4_channel_page": f"select page_id, coalesce({found}) as channel_id, {named.replace('channel', 'url').replace(q('url'), q('channel'))} as channel_input from pages",
    }
