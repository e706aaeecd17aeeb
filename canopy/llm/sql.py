"""DuckDB twins of the operators that SQL can express."""

WARC = """
with p as (
  select page_id, url, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n from pages
), d as (
  select page_id, url, cast(n as bigint) as payload_bytes, sha256(h) as payload_digest,
         min(page_id) over (partition by sha256(h)) as first_page
  from p
)
select page_id, url, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_page then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_page then first_page end as refers_to
from d
"""

# Words as in the contract; the windows of items joined with the windows of documents word for word.
DECONTAMINATE = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), iw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), windows as (
  select distinct item_id, least(len(w), 10) as size, array_to_string(list_slice(w, s, s + 9), ' ') as words
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) as s from iw)
), sizes as (select distinct size from windows
), places as (
  select doc_id, size, s, array_to_string(list_slice(w, s, s + size - 1), ' ') as words
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from dw, sizes where len(w) >= size)
), hits as (
  select distinct doc_id, item_id, s, size from places join windows using (size, words)
), spots as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from hits) group by doc_id
), items as (
  select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids
  from (select distinct doc_id, cast(item_id as varchar) as i from hits) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join spots using (doc_id) left join items using (doc_id)
"""

# Sets of 5-word shingles, all pairs with a common shingle compared, components by reachability over links.
JACCARD = r"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingles as (
  select distinct doc_id, array_to_string(list_slice(w, s, s + 4), ' ') as g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as s from dw)
), sizes as (select doc_id, count(*) as n from shingles group by doc_id
), sets as (select doc_id, md5(string_agg(g, '|' order by g)) as k from shingles group by doc_id
), heads as (select k, min(doc_id) as head from sets group by k
), own as (select s.doc_id, s.g from shingles s join heads h on s.doc_id = h.head
), common as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared from own a join own b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
  select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * shared >= 80 * (p.n + q.n - shared)
), edges as (select x, y from links union select y, x from links
), reach(x, y) as (
  select head, head from heads union select r.x, e.y from reach r join edges e on r.y = e.x
), lowest as (select y, min(x) as low from reach group by y)
select dw.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(low, dw.doc_id) as component_id
from dw left join sizes using (doc_id) left join sets using (doc_id) left join heads using (k) left join lowest on lowest.y = head
"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 of an expression, byte by byte through the table of its polynomial."""
    table = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        table.append(byte)
    digit = lambda at: f"(strpos('0123456789ABCDEF', substr(hex({text}), {at}, 1)) - 1)"
    values = f"list_transform(range(0, cast(length(hex({text})) // 2 as bigint)), lambda k: cast(16 * {digit('2 * k + 1')} + {digit('2 * k + 2')} as bigint))"
    step = f"xor(c >> 8, cast(list_extract({table}, (xor(c, b) & 255) + 1) as bigint))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {values}), lambda c, b: {step}), cast(4294967295 as bigint))"


# Matches of words with earlier ones at every lag up to a quarter of the text, their unbroken stretches, and of the periods
# of one stretch the smallest.
PERIODIC = rf"""
with split as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), hashed as materialized (select doc_id, w, cast(len(w) as bigint) as n, {_crc32("cast(doc_id as varchar)")} as h from split
), sized as (select *, (h // 10) % n as a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) as p from hashed where n > 0
), words as materialized (
  select doc_id, n, i, case when h % 10 = 0 and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word
  from (select *, unnest(range(0, n)) as i from sized)
), matches as (
  select x.doc_id, x.i, x.i - y.i as q from words x join words y on x.doc_id = y.doc_id and x.word = y.word and y.i < x.i and 4 * (x.i - y.i) <= x.n
), stretches as (
  select doc_id, q, min(i) - q as start, count(*) + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from matches) group by doc_id, q, island
), runs as materialized (
  select doc_id, start, length, min(q) as period from stretches where length >= greatest(6, 4 * q) group by doc_id, start, length
), listed as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from runs group by doc_id
), best as (
  select * from (select *, row_number() over (partition by doc_id order by cast(length as hugeint) * 1000000000000 // period desc, start, period) as place from runs) where place = 1
), dropped as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as words from words anti join dropped using (doc_id, i) group by doc_id
)
select split.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from split left join listed using (doc_id) left join best using (doc_id) left join kept using (doc_id)
"""

# Words one edit apart: one is the other with a character left out, or both are equal without their k-th character.
SPELLING = rf"""
with recursive found as materialized (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) as run from documents)
  where length(run) >= 7 group by all
), hashed as materialized (
  select run, times, {_crc32("cast(doc_id as varchar) || ':' || run")} as h from found
), counted as (
  select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, times from hashed
), words as materialized (
  select word, cast(sum(times) as bigint) as n from counted where length(word) >= 7 group by word having sum(times) >= 2
), gaps as materialized (
  select word, k, substr(word, 1, k - 1) || substr(word, k + 1) as rest from (select word, unnest(range(1, length(word) + 1)) as k from words)
), shorter as (select distinct g.word, w.word as near from gaps g join words w on w.word = g.rest
), near as (
  select word, near from shorter union all select near, word from shorter
  union all select distinct a.word, b.word from gaps a join gaps b on a.rest = b.rest and a.k = b.k and a.word <> b.word
), best as (
  select *, row_number() over (partition by x.word order by y.n desc, x.near) as place, count(*) over (partition by x.word) as n_near
  from near x join (select word as near, n as form_n from words) z using (near) join (select word as near, n from words) y using (near)
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 10 * w.n then near end as form, case when form_n >= 10 * w.n then form_n end as form_n
  from words w left join (select word, near, form_n, n_near from best where place = 1) b using (word)
), chain(word, spot) as (
  select word, word from forms union all select c.word, f.form from chain c join forms f on f.word = c.spot where f.form is not null
), ends as (select c.word, c.spot as root from chain c join forms f on f.word = c.spot where f.form is null)
select word, form, root, n, cast(n_near as bigint) as n_near, form_n from forms join ends using (word)
"""
