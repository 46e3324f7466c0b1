"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import licenses, mixing, warc
from .license_texts import DIGESTS, KNOWN


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def mixing_sql(table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars", power: float = 0.5, epochs: float = 1.0, seed: int = 17) -> str:
    steps = mixing.poisson_steps()
    hexed = lambda text, n: f"cast('0x' || substr(md5({text}), 1, {n}) as bigint)"
    uniform = lambda text: f"cast({hexed(text, mixing.HEX52)} as double) / {1 << 52}.0"
    return f"""
with recursive sizes as (
  select source, count(*) as n_docs, {"sqrt(cast(count(*) as double))" if power == 0.5 else f"pow(cast(count(*) as double), {power})"} as weight from {table} group by source),
totals as (select cast(sum(n_docs) as double) as all_docs, sum(weight) as all_weight from sizes),
full_rates as (select source, {epochs} * all_docs * weight / all_weight / n_docs as rate from sizes, totals),
rates as (select source, greatest(1, ceil(rate / {mixing.MAX_RATE})) as parts, rate / greatest(1, ceil(rate / {mixing.MAX_RATE})) as rate from full_rates),
cdf(source, rate, k, term, total) as (
  select source, rate, 0, exp(-rate), exp(-rate) from rates
  union all
  select source, rate, k + 1, term * rate / (k + 1), total + term * rate / (k + 1) from cdf where k < {steps}),
steps as (select source, list(distinct total) filter (total < 1) as totals from cdf group by source),
named as (select d.*, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as name, totals, parts
  from {table} d join steps s on d.source is not distinct from s.source join rates r on d.source is not distinct from r.source),
drawn as (
  select *, cast(list_sum(list_transform(range(1, cast(parts as bigint) + 1), lambda part: len(list_filter(totals, lambda x: x <= case when part = 1 then {uniform(f"'{seed}:' || name")} else {uniform(f"'{seed}:' || name || ':' || cast(part as varchar)")} end)))) as bigint) as n
  from named),
copies as (select name, {columns}, cast(unnest(range(1, n + 1)) as integer) as mix_copy from drawn)
select {columns}, mix_copy, {hexed("'" + str(seed) + "-order:' || name || ':' || cast(mix_copy as varchar)", 15)} as mix_key from copies
"""


def canonical_sql(text: str) -> str:
    out = f"translate(coalesce({text}, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    out = f"replace({out}, chr(13), '')"
    for pattern in (licenses.COPYRIGHT_LINE, licenses.RESERVED_LINE):
        out = f"regexp_replace({out}, {quoted(pattern)}, chr(10), 'g')"
    out = f"' ' || regexp_replace({out}, {quoted(licenses.OTHER_SIGNS)}, ' ', 'g') || ' '"
    for old, new in licenses.SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out}, ' ')"


def licenses_sql() -> str:
    values = ", ".join(f"({quoted(k.split('#')[0])}, {quoted(v)})" for k, v in sorted(KNOWN.items()))
    digests = ", ".join(f"({quoted(v)}, {quoted(k)})" for k, v in sorted(DIGESTS.items()))
    return f"""
with known(license_id, license_text) as (values {values}),
registry as (
  select digest, min(license_id) as license_id from (select sha256({canonical_sql("license_text")}) as digest, license_id from known union all select * from (values {digests})) group by digest),
lines as (
  select r.n, sha256({canonical_sql("line")}) as digest
  from (select n, unnest(string_split(coalesce(text, ''), chr(10))) as line from (select row_number() over () as n, text from documents)) r),
hits as (select n, string_agg(distinct license_id, ',' order by license_id) as found, count(*) as n_found from lines join registry using (digest) group by n),
rows as (select row_number() over () as n, doc_id, sha256({canonical_sql("text")}) as text_digest from documents)
select rows.doc_id, rows.text_digest, registry.license_id as text_license, coalesce(hits.found, '') as line_licenses, coalesce(hits.n_found, 0) as n_license_lines
from rows left join registry on registry.digest = rows.text_digest left join hits on hits.n = rows.n
"""


def chat_sql() -> str:
    return """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
numbered as (
  select *, row_number() over w as pos, count(*) over (partition by conv_id) as n,
         regexp_replace(text, '([<\\[])(\\\\*)(/?s>|/?INST\\]|\\|[A-Za-z_]+\\||<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g') as body,
         regexp_replace(role, '([<\\[])(\\\\*)(/?s>|/?INST\\]|\\|[A-Za-z_]+\\||<SYS>>|</SYS>>)', '\\1\\\\\\2\\3', 'g') as shown
  from turns window w as (partition by conv_id order by turn nulls first, role, text)),
sized as (select *, length(shown) + length(body) + length('<s>[INST][/INST]</s>') as chars from numbered),
running as (select *, sum(chars) over (partition by conv_id order by pos) as so_far from sized)
select conv_id, cast(count(*) as bigint) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(so_far) filter (role = 'assistant' or pos = n) as bigint) as formatted_chars
from running group by conv_id
"""


def minhash_sql(shingle: int = 3, percent: int = 85) -> str:
    """Exact components by a recursive walk over the exact links; meant for small tables."""
    return f"""
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < {shingle} then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - {shingle} + 2), lambda i: array_to_string(w[i:i + {shingle - 1}], ' '))) end as s from words),
items as (select doc_id, len(s) as n, unnest(s) as item from sets),
ranked as (
  select doc_id, n, item, row_number() over (partition by doc_id order by df, item) as r
  from items join (select item, count(*) as df from items group by item) using (item)),
heads as (select doc_id, n, item from ranked where r <= n - ceil({percent} * n / 100.0) + 1),
pairs as (select distinct a.doc_id as a, b.doc_id as b from heads a join heads b on a.item = b.item and a.doc_id < b.doc_id and a.n * 100 >= b.n * {percent} and b.n * 100 >= a.n * {percent}),
shared as (select a, b, count(*) as k from pairs join items x on x.doc_id = a join items y on y.doc_id = b and y.item = x.item group by a, b),
links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where k * 100 >= (len(x.s) + len(y.s) - k) * {percent}),
both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select doc_id, doc_id from sets union select r.a, e.b from reach r join both_ways e on e.a = r.b),
least as (select a, min(b) as c from reach group by a)
select doc_id, cast(len(s) as bigint) as n_shingles, c as component_id, doc_id = c as kept from sets join least on a = doc_id
"""


def warc_sql() -> str:
    letters = " || ".join(f"substr('{warc.ALPHABET}', cast((cast('0x' || substr(h, {1 + 5 * i}, 5) as bigint) >> {s}) & 31 as integer) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0))
    return f"""
with hashed as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(encode(coalesce(html, ''))) as h from pages),
firsts as (select h, min(page_id) as first_id from hashed group by h)
select page_id, cast(n as bigint) as payload_bytes, {letters} as payload_digest,
       case when page_id > first_id then 'revisit' else 'response' end as record_type,
       case when page_id > first_id then first_id end as refers_to
from hashed join firsts using (h)
"""


ORACLES = {
    "op1_minhash_near_dedup": minhash_sql(),
    "op3_warc": warc_sql(),
    "op6_mixing": mixing_sql(),
    "op7_license_scan": licenses_sql(),
    "op9_chat_formatting": chat_sql(),
}
