"""DuckDB SQL for the markup forest (self-joins where the Spark plan uses windows)."""

from __future__ import annotations

from canopy.sources.markup import CONTAINERS, OPAQUE

_TAGS = ", ".join(f"'{tag}'" for tag in CONTAINERS)

_TOKENS = rf"""tok0 as materialized (
  select url as file_path, regexp_extract_all(regexp_replace(html, '{OPAQUE}', '', 'g'), '\n|</?[a-zA-Z][^>]*>') as toks from pages),
tok1 as (select file_path, unnest(toks) as token, generate_subscripts(toks, 1) as pos from tok0),
tok as materialized (
  select *, lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag, token like '</%' as closing,
    lower(regexp_extract(token, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) in ({_TAGS}) as container,
    length(token) - length(replace(token, chr(10), '')) as breaks from tok1),
run as materialized (
  select *, sum(case when not container then 0 when closing then -1 else 1 end) over w as balance,
    sum(case when tag <> '' and not closing then 1 else 0 end) over w as opens,
    1 + sum(breaks) over w - breaks as line
  from tok window w as (partition by file_path order by pos rows unbounded preceding)),
lev as materialized (select *, case when container then balance + (case when closing then 1 else 0 end) end as lvl from run),
nxt as (select a.file_path, a.pos, min(b.pos) as end_pos from lev a join lev b
  on a.file_path = b.file_path and a.lvl = b.lvl and b.pos > a.pos where a.container and not a.closing group by 1, 2),
pair as materialized (select a.*, b.tag as end_tag, b.closing as end_closes, b.opens as end_opens, b.line as end_line
  from lev a left join nxt using (file_path, pos) left join lev b on b.file_path = a.file_path and b.pos = nxt.end_pos),
page as materialized (select file_path, max(opens) as page_opens, max(line + breaks) as page_lines, min(balance) as lowest,
  max(case when container and not closing and (end_tag <> tag or not end_closes) then 1 else 0 end) as clash
  from pair group by file_path)"""

_NODES = rf"""nod as materialized (
  select file_path, cast(opens - 1 as bigint) as node_id, cast(balance - (case when container then 1 else 0 end) as int) as depth,
    tag as type, token, cast(line as int) as start_line, container, pos,
    cast(case when container then coalesce(end_line, page_lines) else line end as int) as end_line,
    cast(case when container then coalesce(end_opens, page_opens) - opens else 0 end as bigint) as descendant_count
  from pair join page using (file_path) where lowest >= 0 and clash = 0 and not closing and tag <> ''),
par as materialized (select c.*, (select max(p.node_id) from nod p where p.file_path = c.file_path and p.container
  and p.depth = c.depth - 1 and p.node_id < c.node_id) as parent_id from nod c),
kids as (select file_path, parent_id, count(*) as n from par where parent_id is not null group by 1, 2),
ast as materialized (
  select par.file_path, node_id, par.parent_id, depth,
    case when type = 'a' and regexp_matches(token, '\bhref=') then regexp_extract(token, 'href="([^"]*)"', 1)
      when type in ('article', 'nav', 'footer') then type else '' end as name,
    type,
    case when type = 'a' and regexp_matches(token, '\bhref=') then 'EXTERNAL_IMPORT'
      when type in ('article', 'nav', 'footer') then 'DEFINITION_CLASS' else 'MARKUP_ELEMENT' end as semantic_type,
    start_line, end_line, descendant_count, cast(coalesce(n, 0) as bigint) as children_count, token
  from par left join kids on kids.file_path = par.file_path and kids.parent_id = par.node_id)"""

COLUMNS = """file_path, node_id, parent_id, depth, name, type, semantic_type, start_line, end_line, descendant_count,
  children_count"""


def over_pages(query: str) -> str:
    """``query`` over ``ast``, the markup node table."""
    return f"with {_TOKENS}, {_NODES} {query}"


def over_tokens(query: str) -> str:
    """``query`` over ``page``, the per-page verdict of the pairing rule."""
    return f"with {_TOKENS} {query}"
