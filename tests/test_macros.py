"""SQL table functions give the rows of the DataFrame form, and plan as well."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy import api, macros
from canopy.catalog.structure import captured, changes, pages_as_nodes, scope, tagged, types_of
from canopy.functions.patterns import path_matches

FOLDER = "/root/testdata/sf0.001"
GLOBS = ["**", "**/*", "**/*.go", "*", "*.go", "src/**", "src/*.go", "a?c", "[ab]*.go", "[!ab]*", "[^ab]?", "src/[a-c][!x]/**/z.go", "a+b(c).{d}", "a|b$", "x[", "x[]y", "[!]", "[*?]", "a.b", "**/x/**", "w\\d", "[&~^a]", "a**b", "**.go"]
PATHS = ["a", "abc", "a.go", "b.go", "x.go", "src/a.go", "src/b/c.go", "src/ax/z.go", "src/ay/z.go", "src/ay/q/z.go", "a+b(c).{d}", "a|b$", "x[", "x[]y", "!", "*", "?", "a.b", "axb", "q/x/y", "x/y", "w\\d", "w1", "&", "~", "^", "", "ab", "a/b", "axyb", None]


@pytest.fixture
def over(spark):
    """The macros over the scope forest, its snapshots and pinned symbols."""
    macros.register_macros(scope(spark, FOLDER), revisions=tagged(spark, FOLDER), planned=captured(spark, FOLDER))
    return spark


def same(sql_form, frame, ordered=True):
    assert sql_form.columns == frame.columns
    assert [t for _, t in sql_form.dtypes] == [t for _, t in frame.dtypes]
    got, want = rows(sql_form), rows(frame)
    assert want, "proves nothing"
    key = lambda r: repr(r)
    assert (got == want) if ordered else (sorted(got, key=key) == sorted(want, key=key))


def test_globs_match_as_in_the_dataframe_form(spark):
    for statement in macros._glob_functions():
        spark.sql(statement)
    spark.createDataFrame([(p,) for p in PATHS], "file_path string").createOrReplaceTempView("some_paths")
    for glob in GLOBS:
        want = rows(spark.table("some_paths").where(path_matches(glob)))
        got = rows(spark.sql(f"select * from some_paths where glob_matches(file_path, {macros._text(glob)})"))
        assert sorted(got) == sorted(want), glob


def test_scans(over):
    nodes = scope(over, FOLDER)
    for glob in ("**", "ASIA/**", "**/*.go", "[!B-Z]*/*.go"):
        same(macros.sql(over, "find_definitions", glob), api.find_definitions(nodes, glob))
        same(macros.sql(over, "find_calls", glob, "Brand#1%"), api.find_calls(nodes, glob, "Brand#1%"))
    same(macros.sql(over, "find_definitions", "**", "Customer#%1"), api.find_definitions(nodes, "**", "Customer#%1"))
    for kind in ("calls", "definitions", "loops", "conditionals"):
        same(macros.sql(over, "find_in_ast", "**", kind), api.find_in_ast(nodes, "**", kind))
    assert macros.sql(over, "find_in_ast", "**", "no such kind").count() == 0
    same(over.sql("select * from search_symbols(symbol => 'oMeR#0000000', n => 5)"), api.search_symbols(nodes, "oMeR#0000000", 5))
    same(over.sql("select * from table_stats()"), api.table_stats(nodes))


def test_measures_and_callers(over):
    nodes = scope(over, FOLDER)
    same(macros.sql(over, "code_structure", "ASIA/**"), api.code_structure(nodes, "ASIA/**"))
    same(over.sql("select * from complexity_hotspots('**/*.go', 7)"), api.complexity_hotspots(nodes, "**/*.go", 7))
    same(macros.sql(over, "complexity_hotspots", "ASIA/**"), api.complexity_hotspots(nodes, "ASIA/**"))
    for glob in ("**", "ASIA/**"):
        same(macros.sql(over, "function_callers", glob, "Brand#23"), api.function_callers(nodes, glob, "Brand#23"))
    joined = over.sql("""select h.name, c.call_line from complexity_hotspots('**', 3) h
      join function_callers(file_pattern => '**', func_name => 'Brand#23') c on c.caller_name = h.name""")
    assert joined.columns == ["name", "call_line"]


def test_unenclosed_calls_and_equal_scopes(spark, nodes_of):
    nodes = nodes_of([
        {"node_id": 0, "semantic_type": "DEFINITION_FUNCTION", "name": "outer", "start_line": 2, "end_line": 9},
        {"node_id": 1, "semantic_type": "DEFINITION_FUNCTION", "name": "inner", "start_line": 2, "end_line": 9},
        {"node_id": 2, "semantic_type": "COMPUTATION_CALL", "name": "f", "start_line": 3},
        {"node_id": 3, "semantic_type": "COMPUTATION_CALL", "name": "f", "start_line": 3},
        {"node_id": 4, "semantic_type": "COMPUTATION_CALL", "name": "f", "start_line": 40},
    ])
    macros.register_macros(nodes, name="tiny")
    same(macros.sql(spark, "function_callers", "**", "f"), api.function_callers(nodes, "**", "f"))
    assert rows(macros.sql(spark, "function_callers", "**", "f")) == [("a.go", 3, "inner", "DEFINITION_FUNCTION"), ("a.go", 40, None, None)]


def test_snapshots_and_pins(over):
    old, new, now = scope(over, FOLDER, "old"), scope(over, FOLDER, "new"), scope(over, FOLDER)
    for glob in ("**", "ASIA/**"):
        same(macros.sql(over, "structural_diff", glob, "old", "new"), api.structural_diff(old, new, glob), ordered=False)
        same(macros.sql(over, "changed_function_summary", "old", "new", glob), api.changed_function_summary(now, changes(over, FOLDER), glob))
    pins = captured(over, FOLDER)
    same(macros.sql(over, "planning_drift", "T1"), api.planning_drift(pins, now, "T1").withColumn("captured_at", F.col("captured_at").cast("timestamp")))
    same(macros.sql(over, "orientation", "T1"), api.orientation(pins, "T1"))
    same(macros.sql(over, "capture_quality", "T1"), api.capture_quality(pins, "T1"))
    fewer = new.where("node_id % 3 <> 0")
    macros.register_macros(fewer, planned=pins)
    same(macros.sql(over, "missing_symbols", "T2"), api.missing_symbols(pins, fewer, "T2"), ordered=False)
    assert macros.sql(over, "missing_symbols", "no such task").count() == 0
    macros.register_macros(now, revisions=tagged(over, FOLDER), planned=pins)
    at = over.sql("select * from capture_planning_context('T9', 'modify', 'ASIA/**', 'customer#%', timestamp '2024-01-01')")
    want = api.capture_planning_context(now, "T9", "modify", "ASIA/**", "customer#%", F.lit("2024-01-01").cast("timestamp"))
    same(at, want, ordered=False)
    stamped = over.sql("select * from capture_planning_context('T9', 'modify', '**', 'customer#%')").first()
    assert abs(stamped.captured_at - dt.datetime.now()) < dt.timedelta(days=1)


def test_an_empty_node_table_is_refused(spark):
    with pytest.raises(ValueError, match="empty"):
        macros.register_macros(scope(spark, FOLDER).where("false"), planned=captured(spark, FOLDER))


def test_types(spark):
    nodes = types_of(spark, FOLDER)
    made = macros.register_macros(nodes)
    assert "structural_diff" not in made and "planning_drift" not in made
    same(spark.sql("select * from go_struct_fields()"), api.go_struct_fields(nodes))
    same(spark.sql("select * from go_external_types()"), api.go_external_types(nodes))
    same(spark.sql("select * from go_interfaces()"), api.go_interfaces(nodes))
    same(macros.sql(spark, "go_type_flow", "economy.BRAND#1"), api.go_type_flow(nodes, "economy.BRAND#1"))


def test_interface_impls_and_signatures(spark, nodes_of):
    receiver = [{"name": "r *T", "type": "receiver"}, {"name": "x", "type": "int"}]
    nodes = nodes_of([
        {"node_id": 0, "type": "type_spec", "name": "I"},
        {"node_id": 1, "parent_id": 0, "type": "interface_type"},
        {"node_id": 2, "parent_id": 1, "type": "method_elem", "name": "M"},
        {"node_id": 3, "parent_id": 1, "type": "method_elem", "name": "M"},
        {"node_id": 4, "type": "method_declaration", "name": "M", "parameters": receiver, "start_line": 7},
        {"node_id": 5, "type": "method_declaration", "name": "N", "parameters": receiver},
        {"node_id": 6, "type": "method_declaration", "name": "M", "parameters": None, "start_line": 3},
    ])
    macros.register_macros(nodes)
    same(macros.sql(spark, "go_interface_impls", "I"), api.go_interface_impls(nodes, "I"))
    same(spark.sql("select * from go_func_signatures()"), api.go_func_signatures(nodes))


def test_imports_and_modules(spark):
    pages = pages_as_nodes(spark, FOLDER)
    macros.register_macros(pages)
    same(macros.sql(spark, "find_imports", "**"), api.find_imports(pages, "**"))
    same(macros.sql(spark, "find_in_ast", "**", "imports", "/T%"), api.find_in_ast(pages, "**", "imports", "/T%"))
    modules = pages.selectExpr(
        *[c for c in pages.columns if c not in ("file_path", "peek")],
        "concat('src/pkg/m', pmod(hash(file_path), 9), if(pmod(hash(file_path), 2) = 0, '/__init__.py', '.py')) as file_path",
        "concat('from pkg.', substr(name, 2, 2), ' import x') as peek",
    )
    macros.register_macros(modules)
    same(macros.sql(spark, "module_dependencies", "**/*.py", "pkg"), api.module_dependencies(modules, "**/*.py", "pkg"))


def test_arguments_reach_the_scan(over):
    def plan(text):
        over.conf.set("spark.sql.maxMetadataStringLength", "4000")
        return over.sql(text)._jdf.queryExecution().executedPlan().toString()

    for macro in ("complexity_hotspots('ASIA/**', 5)", "code_structure('ASIA/**')", "function_callers('ASIA/**', 'Brand#23')", "find_calls('ASIA/**')"):
        text = plan(f"select * from {macro}")
        scans = [line for line in text.splitlines() if "FileScan" in line]
        assert scans and all("StringStartsWith(file_path,ASIA/)" in line for line in scans), macro
        assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text, macro
    assert "TakeOrderedAndProject" in plan("select * from complexity_hotspots('**', 5)")
    assert "EqualTo(name,Brand#23)" in plan("select * from function_callers('**', 'Brand#23')")
    assert "NestedLoop" not in plan("select * from planning_drift('T1')")


def test_quotes_in_arguments_are_text(over):
    assert macros.sql(over, "find_calls", "**", "it's \\ %").count() == 0
