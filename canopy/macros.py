"""The query surface as SQL table functions: ``select * from function_callers('**/*.go', 'x')``.

Each macro is a temporary SQL function over views of the node table. Spark puts the arguments into the body before it
plans, so constants fold: a glob becomes one regular expression and a literal head that reaches the Parquet filter, and a row
number up to ``n`` becomes a top-n. Macros of parents, types and whole-table measures read views that the DataFrame operators
define; a path filter goes through these down to the scan.

Arguments keep the names of the DataFrame form and can be given by name. Several globs are several calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.functions import predicates as P
from canopy.nodes import NODE_SCHEMA, require_nodes
from canopy.operators import lookup, metrics, types
from canopy.operators.planning import PLANNING_SCHEMA
from canopy.plans.enclosing import BITS, LINES
from canopy.sources.corpus import node_manifest

# --- globs -----------------------------------------------------------------

# A bracket class is fenced first, so that its signs are neither escaped as wildcards nor taken for them. The fences are
# control characters, which paths don't hold.
_IN_CLASS = "(?![^\\u0001]*\\u0003)"  # what follows is not the rest of a class
_GLOB_STEPS = (
    ("\\[(?:([!^])(?=[^\\]/]+\\]))?([^\\]/]+)\\]", "\\u0001$1\\u0002$2\\u0003"),
    ("([\\\\.+(){}|^$\\[\\]&~])", "\\\\$1"),
    (f"\\*\\*/{_IN_CLASS}", "\\u0004"),
    (f"\\*\\*{_IN_CLASS}", "\\u0005"),
    (f"\\*{_IN_CLASS}", "\\u0006"),
    (f"\\?{_IN_CLASS}", "\\u0007"),
    ("\\u0001(?:!|\\\\\\^)\\u0002", "[^/"),
    ("\\u0001\\u0002", "["),
    ("\\u0003", "]"),
    ("\\u0004", "(?:.*/)?"),
    ("\\u0005", ".*"),
    ("\\u0006", "[^/]*"),
    ("\\u0007", "[^/]"),
)


def _text(value: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _glob_functions() -> list[str]:
    regex = "glob"
    for pattern, put in _GLOB_STEPS:
        # Java reads \\uXXXX in patterns; replacements need the sign itself.
        regex = f"regexp_replace({regex}, {_text(pattern)}, {_text(put.encode().decode('unicode_escape') if put.startswith(chr(92) + 'u') else put)})"
    head = _text("(?s)^(?:(?![*?]|\\[[^\\]/]+\\]).)*")
    return [
        f"create or replace temporary function glob_regex(glob string) returns string return concat('\\\\A', {regex}, '\\\\z')",
        f"create or replace temporary function glob_head(glob string) returns string return regexp_extract(glob, {head}, 0)",
        """create or replace temporary function glob_matches(path string, glob string) returns boolean
        return case when glob in ('**', '**/*') then path is not null else startswith(path, glob_head(glob)) and path rlike glob_regex(glob) end""",
    ]


# --- bodies ----------------------------------------------------------------


def _codes(*codes: str) -> str:
    return "semantic_type in (" + ", ".join(map(_text, codes)) + ")"


def _plain_like(pattern: str) -> str:
    """A LIKE pattern in which a backslash is an ordinary character."""
    return f"replace({pattern}, '\\\\', '\\\\\\\\')"


_KINDS = {
    "calls": _codes(P.CALL),
    "imports": _codes(P.IMPORT),
    "definitions": _codes(*P.DEFINITIONS),
    "loops": _codes(P.LOOP),
    "conditionals": _codes(P.CONDITIONAL),
    "strings": _codes(P.STRING),
    "comments": _codes(P.COMMENT),
}
_IN_ORDER = "order by file_path, start_line nulls last, node_id"
_NOT_GENERATED = "file_path not like '%.pb.go' and file_path not like '%_gen.go'"
_RECEIVER = _text("\\*?(\\w+)$")

_CALLERS = f"""
with calls as (
  select distinct file_path, start_line as call_line from {{ast}}
  where {_codes(P.CALL)} and name = func_name and glob_matches(file_path, file_pattern)
), scopes as (
  select file_path, start_line as def_start, end_line as def_end, max(struct(node_id, name, semantic_type as kind)) as scope
  from {{ast}} left semi join (select distinct file_path from calls) using (file_path)
  where {_codes(P.FUNCTION, P.CLASS, P.MODULE)} and name <> '' and glob_matches(file_path, file_pattern)
  group by file_path, start_line, end_line
), spots as (
  select file_path, shiftleft(bigint(def_end - def_start), {BITS}) + ({(1 << BITS) - 1}L - def_start) as rank,
    explode({LINES.cover_sql("def_start", "def_end")}) as spot
  from scopes
), registered as (
  select file_path, spot.level, spot.block, min(rank) as rank from spots group by all
), asked as (
  select file_path, call_line, explode({LINES.all_blocks_sql("call_line")}) as spot from calls
), hits as (
  select /*+ merge(r) */ a.file_path, a.call_line, r.rank from asked a
  join registered r on r.file_path = a.file_path and r.level = a.spot.level and r.block = a.spot.block
  union all select file_path, call_line, cast(null as bigint) from calls
), best as (
  select file_path, call_line, min(rank) as rank from hits group by all
), bounds as (
  select file_path, call_line, int({(1 << BITS) - 1}L - (rank & {(1 << BITS) - 1}L)) as def_start, int(shiftright(rank, {BITS})) as span from best
)
select b.file_path, b.call_line, s.scope.name, s.scope.kind
from bounds b left join scopes s on s.file_path = b.file_path and s.def_start = b.def_start and s.def_end = b.def_start + b.span
order by b.file_path, b.call_line"""

_MODULES = f"""
with raw as (
  select distinct file_path, regexp_extract(peek, concat('from (', package_prefix, '[a-zA-Z0-9_.]*)'), 1) as target
  from {{ast}}
  where {_codes(P.IMPORT)} and glob_matches(file_path, file_pattern) and peek like {_plain_like("concat('%from ', package_prefix, '%')")}
), edges as (
  select replace(replace(regexp_extract(file_path, concat('((?:', package_prefix, {_text(")[a-zA-Z0-9_./]*)" + chr(92) + ".py$")}), 1), '/', '.'), '__init__', '') as source, target
  from raw where target <> ''
), counted as (
  select source, target, count(*) as copies from edges where source <> '' group by all
), loads as (
  select target, sum(copies) as fan_in from counted group by all
)
select source, c.target, fan_in from counted c join loads l on l.target = c.target
lateral view explode(sequence(1L, copies)) as copy
order by source, c.target"""

_SHAPES = f"""select file_path, name, semantic_type as kind, end_line - start_line + 1 as lines, descendant_count as complexity,
    children_count as children, count(*) as copies
  from {{ast}}_revisions
  where snapshot_id = {{rev}} and glob_matches(file_path, structural_diff.file) and {_codes(*P.DEFINITIONS)}
    and depth <= {P.TOP_LEVEL_DEPTH} and name <> '' group by all"""

_DIFF = f"""
with older as ({_SHAPES.replace("{rev}", "from_rev")}), newer as ({_SHAPES.replace("{rev}", "to_rev")}), pairs as (
  select coalesce(n.file_path, o.file_path) as file_path, coalesce(n.name, o.name) as name, coalesce(n.kind, o.kind) as kind,
    case when o.copies is null then 'added' when n.copies is null then 'removed'
      when n.complexity <> o.complexity or n.children <> o.children then 'modified' else 'unchanged' end as change,
    o.lines as old_lines, n.lines as new_lines, o.complexity as old_complexity, n.complexity as new_complexity,
    coalesce(n.complexity, 0) - coalesce(o.complexity, 0) as complexity_delta,
    coalesce(o.copies, 1) * coalesce(n.copies, 1) as pairs
  from newer n full outer join older o on n.file_path = o.file_path and n.name = o.name and n.kind = o.kind
)
select file_path, name, kind, change, old_lines, new_lines, old_complexity, new_complexity, complexity_delta
from pairs lateral view explode(sequence(1L, pairs)) as copy
where change <> 'unchanged' order by file_path, change, name, old_complexity, new_complexity"""

_CHANGED = f"""
with statuses as (
  select coalesce(n.file_path, o.file_path) as changed_path,
    case when o.content_hash is null then 'added' when n.content_hash is null then 'deleted' when n.content_hash <> o.content_hash then 'modified' end as status
  from (select * from {{ast}}_manifests where snapshot_id = to_rev) n
  full outer join (select * from {{ast}}_manifests where snapshot_id = from_rev) o on n.file_path = o.file_path
), paths as (
  select file_path, split(file_path, '/') as parts from (select distinct file_path from {{ast}} where glob_matches(file_path, file_pattern))
), suffixes as (
  select file_path, explode(array_distinct(transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts) - i + 1), '/')))) as changed_path from paths
), files as (
  select file_path, status from suffixes join (select * from statuses where status in ('added', 'modified')) using (changed_path)
), wanted as (select distinct file_path from files
), defs as (
  select file_path, name, semantic_type as kind, start_line, end_line - start_line + 1 as lines from {{ast}}
  left semi join wanted using (file_path)
  where glob_matches(file_path, file_pattern) and {_codes(*P.DEFINITIONS)} and depth <= {P.TOP_LEVEL_DEPTH} and name <> ''
), measured as (
  select file_path, name, cyclomatic from function_metrics left semi join wanted using (file_path) where glob_matches(file_path, file_pattern)
)
select d.file_path, d.name, d.kind, d.lines, coalesce(m.cyclomatic, 0) as cyclomatic, f.status
from defs d join files f on f.file_path = d.file_path
left join measured m on m.file_path = d.file_path and m.name = d.name
order by cyclomatic desc, d.file_path, d.start_line, d.name, d.lines"""

_DRIFT = """
with pins as (
  select p.task_id, symbol_name, file_path, line_start, captured_at from planning_context p
  where p.task_id = planning_drift.task_id and line_start is not null
), lines as (
  select name as symbol_name, file_path, start_line, count(*) as times from {ast}
  left semi join (select distinct symbol_name, file_path from pins) w on name = w.symbol_name and {ast}.file_path = w.file_path
  group by all
)
select p.task_id, p.symbol_name, p.file_path, line_start, start_line, captured_at, abs(start_line - line_start) as drift
from pins p join lines l on l.symbol_name = p.symbol_name and l.file_path = p.file_path
lateral view explode(sequence(1L, times)) as copy
where start_line <> line_start order by drift desc, p.file_path, p.symbol_name, start_line"""

_MISSING = """
with pins as (
  select symbol_name, file_path, p.role from planning_context p where p.task_id = missing_symbols.task_id
)
select symbol_name, file_path, role from pins p
where not exists (select 1 from {ast} a where a.name = p.symbol_name and a.file_path = p.file_path)"""

_IMPLS = f"""
with names as (
  select m.name as method_name, count(*) as times
  from (select file_path, node_id from {{ast}} where type = 'type_spec' and name = iface_name) s
  join (select file_path, node_id, parent_id from {{ast}} where type = 'interface_type') b on b.file_path = s.file_path and b.parent_id = s.node_id
  join (select file_path, parent_id, name from {{ast}} where type = 'method_elem') m on m.file_path = b.file_path and m.parent_id = b.node_id
  group by all
)
select regexp_extract(try_element_at(parameters, 1).name, {_RECEIVER}, 1) as receiver, method_name, file_path, start_line
from {{ast}} join names on name = method_name
lateral view explode(sequence(1L, times)) as copy
where type = 'method_declaration' and file_path not like '%_test.go'
order by receiver nulls last, method_name, file_path, start_line"""

_USAGE = " ".join(f"when {_text(kind)} then {_text(usage)}" for kind, usage in types.USAGE_KINDS.items())

#: Name -> (arguments, columns, body). ``{ast}`` is the node view.
MACROS = {
    "find_definitions": (
        "file_pattern string, name_pattern string default '%'",
        "file_path string, name string, kind string, start_line int, end_line int, signature string",
        f"""select file_path, name, semantic_type, start_line, end_line, peek from {{ast}}
        where glob_matches(file_path, file_pattern) and name <> ''
          and case when name_pattern = '%' then {_codes(P.FUNCTION, P.CLASS, P.MODULE)} and depth <= {P.TOP_LEVEL_DEPTH}
            else {_codes(*P.DEFINITIONS)} and name like {_plain_like("name_pattern")} end {_IN_ORDER}""",
    ),
    "find_calls": (
        "file_pattern string, name_pattern string default '%'",
        "file_path string, name string, start_line int, call_expression string",
        f"""select file_path, name, start_line, peek from {{ast}}
        where glob_matches(file_path, file_pattern) and {_codes(P.CALL)} and name like {_plain_like("name_pattern")} {_IN_ORDER}""",
    ),
    "find_imports": (
        "file_pattern string",
        "file_path string, name string, import_statement string, start_line int",
        f"select file_path, name, peek, start_line from {{ast}} where glob_matches(file_path, file_pattern) and {_codes(P.IMPORT)} {_IN_ORDER}",
    ),
    "find_in_ast": (
        "file_pattern string, kind string, name_pattern string default '%'",
        "file_path string, name string, start_line int, context string",
        f"""select file_path, name, start_line, peek from {{ast}} where glob_matches(file_path, file_pattern)
        and case find_in_ast.kind {" ".join(f"when {_text(kind)} then {test}" for kind, test in _KINDS.items())} else false end
        and name like {_plain_like("name_pattern")} {_IN_ORDER}""",
    ),
    "code_structure": (
        "file_pattern string",
        """file_path string, name string, kind string, start_line int, end_line int, line_count int, descendant_count bigint,
        children_count bigint, cyclomatic_complexity bigint""",
        "select * from {ast}_structure where glob_matches(file_path, file_pattern)",
    ),
    "complexity_hotspots": (
        "file_pattern string, n int default 20",
        "file_path string, name string, lines int, cyclomatic bigint, conditionals bigint, loops bigint, return_count bigint, max_depth int",
        """select file_path, name, lines, cyclomatic, conditionals, loops, return_count, max_depth
        from (select *, row_number() over (order by cyclomatic desc, file_path, node_id) as place
          from function_metrics where glob_matches(file_path, file_pattern)) where place <= n order by place""",
    ),
    "function_callers": ("file_pattern string, func_name string", "file_path string, call_line int, caller_name string, caller_kind string", _CALLERS),
    "module_dependencies": ("file_pattern string, package_prefix string", "source_module string, target_module string, fan_in bigint", _MODULES),
    "structural_diff": (
        "file string, from_rev string, to_rev string, repo string default '.'",
        """file_path string, name string, kind string, change string, old_lines int, new_lines int, old_complexity bigint, new_complexity bigint,
        complexity_delta bigint""",
        _DIFF,
    ),
    "changed_function_summary": (
        "from_rev string, to_rev string, file_pattern string, repo string default '.'",
        "file_path string, name string, kind string, lines int, cyclomatic bigint, change_status string",
        _CHANGED,
    ),
    "search_symbols": (
        "symbol string, n int default 30",
        "name string, kind string, file_path string, line int",
        f"""select name, kind, file_path, line from (select *, row_number() over (order by file_path, line, name, kind) as place from {{ast}}_symbols
        where name ilike {_plain_like("concat('%', symbol, '%')")} and kind in ({", ".join(map(_text, lookup.SYMBOL_KINDS))})) where place <= n order by place""",
    ),
    "table_stats": ("", "node_count bigint, file_count bigint", "select count(*), count(distinct file_path) from {ast}"),
    "go_struct_fields": (
        "",
        "struct_name string, field_name string, field_type string, type_kind string, file_path string",
        "select * from go_struct_fields",
    ),
    "go_func_signatures": (
        "",
        "name string, receiver string, returns string, params array<struct<name: string, type: string>>, file_path string, start_line int",
        "select * from go_func_signatures",
    ),
    "go_type_flow": (
        "type_name string",
        "usage_kind string, file_path string, start_line int, peek string",
        f"""select case type {_USAGE} else type end, file_path, start_line, peek from {{ast}}
        where (name = type_name or peek ilike {_plain_like("concat('%', type_name, '%')")}) and type not in ({", ".join(map(_text, types.NOT_A_USAGE))})
        order by file_path, start_line, node_id""",
    ),
    "go_external_types": ("", "external_type string, usage_count bigint, file_count bigint", "select * from go_external_types"),
    "go_interfaces": ("", "iface_name string, method_count bigint, exported boolean, file_path string", "select * from go_interfaces"),
    "go_interface_impls": ("iface_name string", "receiver string, method_name string, file_path string, start_line int", _IMPLS),
    "capture_planning_context": (
        "task_id string, role string, pattern string, name_like string, captured_at timestamp default null",
        ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in PLANNING_SCHEMA.fields),
        f"""select capture_planning_context.task_id, capture_planning_context.role,
          case semantic_type when {_text(P.FUNCTION)} then 'function' when {_text(P.CLASS)} then 'type' else 'file' end,
          name, file_path, start_line, end_line, peek, coalesce(capture_planning_context.captured_at, current_timestamp())
        from {{ast}} where glob_matches(file_path, pattern) and {_codes(P.FUNCTION, P.CLASS)} and name ilike {_plain_like("name_like")}
          and file_path not like '%_test.go'""",
    ),
    "planning_drift": (
        "task_id string",
        """task_id string, symbol_name string, file_path string, planned_line int, current_line int, captured_at timestamp, drift_lines int""",
        _DRIFT,
    ),
    "missing_symbols": ("task_id string", "symbol_name string, file_path string, role string", _MISSING),
    "orientation": (
        "task_id string",
        "task_id string, role string, symbol_kind string, symbol_name string, file_path string, line_start int, line_end int",
        """select p.task_id, p.role, symbol_kind, symbol_name, file_path, line_start, line_end from planning_context p
        where p.task_id = orientation.task_id and p.role in ('modify', 'implement') order by p.role, file_path, line_start nulls last""",
    ),
    "capture_quality": (
        "task_id string",
        "captured bigint, missing_signature bigint",
        "select count(*), count_if(signature is null or trim(signature) = '') from planning_context p where p.task_id = capture_quality.task_id",
    ),
}

#: Macros that ask the snapshots, or the pinned symbols.
OVER_REVISIONS = ("structural_diff", "changed_function_summary")
OVER_PINS = ("planning_drift", "missing_symbols", "orientation", "capture_quality")


def _manifests(revisions: DataFrame) -> DataFrame:
    """(snapshot_id, file_path, content_hash): the manifest of every snapshot."""
    tagged = revisions.withColumn("file_path", F.struct("snapshot_id", "file_path"))
    return node_manifest(tagged).select("file_path.snapshot_id", "file_path.file_path", "content_hash")


def register_macros(nodes: DataFrame, *, revisions: DataFrame | None = None, planned: DataFrame | None = None, name: str = "ast") -> list[str]:
    """Make the macros over a node table known to ``spark.sql``; the names of what was made.

    ``revisions`` is a node table with a ``snapshot_id`` and ``planned`` the pinned symbols; without them the macros that
    ask them are not made, and an empty node table is an error where pinned symbols would seem to be gone. Columns that
    ``nodes`` lacks are NULL. All are temporary: views and functions of this session, bound to these tables.
    """
    spark = nodes.sparkSession
    if planned is not None:
        require_nodes(nodes)
    nodes = nodes.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields if f.name not in nodes.columns))
    views = {
        name: nodes,
        f"{name}_symbols": lookup.symbols(nodes),
        f"{name}_structure": metrics.code_structure(nodes, "**"),
        "function_metrics": metrics.function_metrics(nodes),
        "go_struct_fields": types.struct_fields(nodes),
        "go_func_signatures": types.function_signatures(nodes),
        "go_external_types": types.external_types(nodes),
        "go_interfaces": types.interfaces(nodes),
    }
    if revisions is not None:
        views |= {f"{name}_revisions": revisions, f"{name}_manifests": _manifests(revisions)}
    if planned is not None:
        views["planning_context"] = planned
    for view, df in views.items():
        df.createOrReplaceTempView(view)
    made = [m for m in MACROS if (revisions is not None or m not in OVER_REVISIONS) and (planned is not None or m not in OVER_PINS)]
    for statement in _glob_functions():
        spark.sql(statement)
    for macro in made:
        spark.sql(macro_statement(macro, name))
    return made


def macro_statement(macro: str, name: str = "ast") -> str:
    arguments, columns, body = MACROS[macro]
    return f"create or replace temporary function {macro}({arguments}) returns table({columns}) return {body.replace('{ast}', name)}"


def sql(spark: SparkSession, macro: str, *arguments: str) -> DataFrame:
    """``select * from macro(...)`` with string arguments."""
    return spark.sql(f"select * from {macro}({', '.join(map(_text, arguments))})")
