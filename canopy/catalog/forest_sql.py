"""DuckDB SQL for the derived node tables, as the oracle queries use them."""

from __future__ import annotations

from canopy.sources.forest import SNAPSHOTS

SCOPE_FOREST = """
with li as (
  select l_orderkey, l_partkey,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) as ln
  from lineitem),
co as (
  select c_custkey, c_name, n_name,
    concat(r_name, '/', n_name, case when c_custkey % 10 = 0 then '_test.go' else '.go' end) as fp
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where {CUST}),
od as (
  select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, fp
  from orders join co on o_custkey = c_custkey
  where {ORD}),
raw as (
  select fp as file_path, 0 as depth, -1 as k1, -1 as k2, -1 as k3, max(n_name) as name,
    'source_file' as type, 'DEFINITION_MODULE' as semantic_type from co group by fp
  union all
  select fp, 1, c_custkey, -1, -1, c_name,
    case when c_custkey % 2 = 0 then 'function_declaration' else 'method_declaration' end,
    'DEFINITION_FUNCTION' from co
  union all
  select fp, 2, o_custkey, o_orderkey, -1, o_orderpriority,
    case o_orderstatus when 'F' then 'if_statement' when 'O' then 'for_statement' else 'return_statement' end,
    case o_orderstatus when 'F' then 'FLOW_CONDITIONAL' when 'O' then 'FLOW_LOOP' else 'FLOW_JUMP' end
  from od
  union all
  select fp, 3, o_custkey, o_orderkey, ln, p_brand, 'call_expression', 'COMPUTATION_CALL'
  from li join od on l_orderkey = o_orderkey join part on l_partkey = p_partkey),
num as (
  select raw.*, row_number() over (partition by file_path order by k1, k2, k3) - 1 as node_id from raw),
cnt as (
  select num.*,
    count(*) over (partition by file_path) - 1 as d0,
    count(*) over (partition by file_path, k1) - 1 as d1,
    count(*) over (partition by file_path, k1, k2) - 1 as d2,
    sum(case when depth = 1 then 1 else 0 end) over (partition by file_path) as c0,
    sum(case when depth = 2 then 1 else 0 end) over (partition by file_path, k1) as c1,
    max(case when depth = 1 then node_id end) over (partition by file_path order by node_id) as p1,
    max(case when depth = 2 then node_id end) over (partition by file_path order by node_id) as p2
  from num),
fin as (
  select cnt.*, case depth when 0 then d0 when 1 then d1 when 2 then d2 else 0 end as dc from cnt)
select file_path,
  cast(node_id as bigint) as node_id,
  cast(case depth when 0 then null when 1 then 0 when 2 then p1 else p2 end as bigint) as parent_id,
  cast(depth as int) as depth, name, type, semantic_type,
  cast(1 + floor(node_id / 2.0) as int) as start_line,
  cast(1 + floor((node_id + dc) / 2.0) as int) as end_line,
  cast(dc as bigint) as descendant_count,
  cast(case depth when 0 then c0 when 1 then c1 when 2 then d2 else 0 end as bigint) as children_count,
  concat(type, ' ', name) as peek
from fin
"""

TYPE_FOREST = """
with li as (
  select l_orderkey, l_partkey, l_returnflag,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      l_quantity, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus) as ln
  from lineitem),
co as (
  select c_custkey, c_name, case when c_custkey % 4 = 0 then 'I' else 'S' end as tk,
    concat(r_name, '/', n_name, case when c_custkey % 10 = 0 then '_gen.go' else '.go' end) as fp
  from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  where {CUST}),
od as (
  select o_orderkey, o_custkey, o_orderpriority, fp, tk
  from orders join co on o_custkey = c_custkey
  where {ORD}),
raw as (
  select fp as file_path, 0 as depth, -1 as k1, -1 as k2, -1 as k3, -1 as k4, fp as name,
    'source_file' as type, '' as peek from co group by fp
  union all
  select fp, 1, c_custkey, -1, -1, -1, c_name, 'type_spec', c_name from co
  union all
  select fp, 2, c_custkey, 0, -1, -1, '', case tk when 'I' then 'interface_type' else 'struct_type' end, '' from co
  union all
  select fp, 3, c_custkey, 0, 0, -1, '', 'field_declaration_list', '' from co where tk = 'S'
  union all
  select fp, case tk when 'I' then 3 else 4 end, o_custkey, 0, o_orderkey + 1, -1,
    concat('m', cast(o_orderkey % 50 as string)),
    case tk when 'I' then 'method_elem' else 'field_declaration' end, o_orderpriority
  from od
  union all
  select fp, 5, o_custkey, 0, o_orderkey + 1, ln, '',
    case l_returnflag when 'A' then 'qualified_type' when 'N' then 'pointer_type' else 'type_identifier' end,
    concat(p_type, '.', p_brand)
  from li join od on l_orderkey = o_orderkey join part on l_partkey = p_partkey where tk = 'S'),
num as (
  select raw.*, row_number() over (partition by file_path order by k1, k2, k3, k4) - 1 as node_id from raw),
par as (
  select num.*,
    max(case when depth = 1 then node_id end) over (partition by file_path order by node_id) as p1,
    max(case when depth = 2 then node_id end) over (partition by file_path order by node_id) as p2,
    max(case when type = 'field_declaration_list' then node_id end) over (partition by file_path order by node_id) as p3,
    max(case when depth = 4 then node_id end) over (partition by file_path order by node_id) as p4
  from num)
select file_path,
  cast(node_id as bigint) as node_id,
  cast(case depth when 0 then null when 1 then 0 when 2 then p1 when 3 then p2 when 4 then p3 else p4 end as bigint) as parent_id,
  cast(depth as int) as depth, name, type, peek,
  cast(1 + node_id as int) as start_line
from par
"""

# The branch rules shared by the complexity queries.
IS_CONDITIONAL = """(n.semantic_type = 'FLOW_CONDITIONAL' and (n.type like '%_statement' or n.type like '%_clause'
  or n.type like '%_expression' or n.type like '%_arm' or n.type like '%_case' or n.type like '%_branch'))"""
IS_LOOP = """(n.semantic_type = 'FLOW_LOOP' and (n.type like '%_statement' or n.type like '%_expression'
  or n.type like '%_loop'))"""


def forest(kind: str = "scope", snapshot: str = "current") -> str:
    customers, orders = SNAPSHOTS[snapshot]
    sql = {"scope": SCOPE_FOREST, "type": TYPE_FOREST}[kind]
    return sql.replace("{CUST}", customers).replace("{ORD}", orders)


def with_forests(query: str, **views: tuple[str, str]) -> str:
    """``query`` with one materialised CTE per name -> (kind, snapshot)."""
    ctes = ", ".join(f"{name} as materialized ({forest(*which)})" for name, which in views.items())
    return f"with {ctes} {query}"
