"""Rules of the structure operators that the given tables cannot show."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy.functions.patterns import path_matches, slug_of
from canopy.nodes import require_nodes
from canopy.operators import callers, deps, diff, lookup, metrics, planning, types
from canopy.sources import corpus, markup, stores

FUNC, CLASS, CALL = "DEFINITION_FUNCTION", "DEFINITION_CLASS", "COMPUTATION_CALL"


def test_null_and_empty_names(nodes_of):
    kinds = [FUNC, CALL, "EXTERNAL_IMPORT", "FLOW_LOOP"]
    nodes = nodes_of([{"name": n, "semantic_type": k} for k in kinds for n in (None, "", "x")])
    assert rows(lookup.find_definitions(nodes, "**"), "name") == [("x",)]
    assert rows(lookup.find_calls(nodes, "**"), "name") == [("",), ("x",)]
    assert rows(lookup.find_imports(nodes, "**"), "name") == [(None,), ("",), ("x",)]
    assert rows(lookup.find_in_tree(nodes, "**", "loops"), "name") == [("",), ("x",)]
    assert rows(lookup.find_in_tree(nodes, "**", "unknown")) == []


def test_definition_depth_only_matters_without_a_name(nodes_of):
    nodes = nodes_of([{"name": "deep", "semantic_type": FUNC, "depth": 5}, {"name": "var", "semantic_type": "DEFINITION_VARIABLE"}])
    assert rows(lookup.find_definitions(nodes, "**")) == []
    assert rows(lookup.find_definitions(nodes, "**", "%e%"), "name") == [("deep",)]
    assert rows(lookup.find_definitions(nodes, "**", "v%"), "name") == [("var",)]


def test_a_backslash_in_like_is_plain_text(nodes_of):
    nodes = nodes_of([{"name": "a\\b", "semantic_type": CALL}, {"name": "a_b", "semantic_type": CALL}])
    assert rows(lookup.find_calls(nodes, "**", "a\\b"), "name") == [("a\\b",)]


@pytest.mark.parametrize(
    "glob,want",
    [
        ("**/*.go", ["a/b.go", "c.go", "a/x/d.go"]),
        ("a/*.go", ["a/b.go"]),
        ("a/**/*.go", ["a/b.go", "a/x/d.go"]),
        ("a/**", ["a/b.go", "a/x/d.go", "a/e.py"]),
        ("?.go", ["c.go"]),
        (["c.go", "**/*.py"], ["c.go", "a/e.py"]),
    ],
)
def test_globs(spark, glob, want):
    paths = spark.createDataFrame([(p,) for p in ("a/b.go", "c.go", "a/x/d.go", "a/e.py")], "file_path string")
    assert sorted(r.file_path for r in paths.where(path_matches(glob)).collect()) == sorted(want)


def test_leaf_function_is_null_in_structure_and_one_in_hotspots(nodes_of):
    nodes = nodes_of([{"name": "leaf", "semantic_type": FUNC, "type": "function_declaration"},
                      {"name": "K", "semantic_type": CLASS}])
    assert rows(metrics.code_structure(nodes, "**"), "name", "cyclomatic_complexity") == [("leaf", None), ("K", None)]
    assert rows(metrics.complexity_hotspots(nodes, "**"), "name", "cyclomatic", "max_depth") == [("leaf", 1, 0)]


def test_callers_one_row_per_line_smallest_scope_and_unenclosed(nodes_of):
    nodes = nodes_of(
        [
            {"name": "outer", "semantic_type": CLASS, "start_line": 1, "end_line": 20},
            {"name": "inner", "semantic_type": FUNC, "start_line": 5, "end_line": 9},
            {"name": "f", "semantic_type": CALL, "start_line": 6},
            {"name": "f", "semantic_type": CALL, "start_line": 6},
            {"name": "f", "semantic_type": CALL, "start_line": 15},
            {"name": "f", "semantic_type": CALL, "start_line": 40},
            {"name": "", "semantic_type": FUNC, "start_line": 15, "end_line": 15},
        ]
    )
    assert rows(callers.function_callers(nodes, "**", "f"), "call_line", "caller_name", "caller_kind") == [
        (6, "inner", FUNC), (15, "outer", CLASS), (40, None, None),
    ]


def test_package_init_keeps_its_trailing_dot_and_fan_in_counts_edges(nodes_of):
    imp = {"semantic_type": "EXTERNAL_IMPORT"}
    nodes = nodes_of(
        [
            {**imp, "file_path": "src/pkg/__init__.py", "peek": "from pkg.a import x"},
            {**imp, "file_path": "src/pkg/__init__.py", "peek": "from pkg.a import y"},
            {**imp, "file_path": "src/pkg/b.py", "peek": "from pkg.a import x"},
            {**imp, "file_path": "other/b.py", "peek": "from pkg.a import x"},
        ]
    )
    assert rows(deps.module_dependencies(nodes, "**/*.py", "pkg")) == [("pkg.", "pkg.a", 2), ("pkg.b", "pkg.a", 2)]


def test_structural_diff_pairs_repeated_names(nodes_of):
    old = nodes_of([{"name": "f", "semantic_type": FUNC, "descendant_count": c} for c in (1, 2)])
    new = nodes_of([{"name": "f", "semantic_type": FUNC, "descendant_count": c} for c in (1, 3)] + [{"name": "g", "semantic_type": FUNC}])
    got = rows(diff.structural_diff(old, new), "name", "change", "old_complexity", "new_complexity", "complexity_delta")
    # Four pairs of f, of which (1, 1) is unchanged.
    assert sorted(got, key=str) == sorted(
        [("f", "modified", 1, 3, 2), ("f", "modified", 2, 1, -1), ("f", "modified", 2, 3, 1), ("g", "added", None, 0, 0)], key=str
    )


def test_signatures_without_parameters_and_test_file_wildcard(nodes_of):
    method = {"type": "method_declaration", "name": "m"}
    nodes = nodes_of([{**method, "parameters": []}, {**method, "parameters": [("q *DB", "receiver"), ("a", "int")]},
                      {**method, "file_path": "latest.go"}, {**method, "file_path": "x.pb.go"}])
    got = rows(types.function_signatures(nodes), "receiver", "params")
    assert got == [(None, []), ("DB", [("a", "int")])]


def test_drift_counts_every_node_and_missing_is_by_file(nodes_of):
    nodes = nodes_of([{"name": "f", "semantic_type": FUNC, "start_line": 3}, {"name": "f", "semantic_type": CALL, "start_line": 9},
                      {"name": "f", "semantic_type": CALL, "start_line": 9}, {"name": "g", "file_path": "b.go"}])
    pins = nodes.sparkSession.createDataFrame(
        [("T", "modify", "function", "f", "a.go", 3, 4, "", None), ("T", "modify", "function", "g", "a.go", 1, 1, None, None),
         ("U", "depends-on", "type", "h", "a.go", None, None, " ", None)], planning.PLANNING_SCHEMA)
    assert rows(planning.planning_drift(pins, nodes, "T"), "symbol_name", "current_line", "drift_lines") == [("f", 9, 6)] * 2
    assert rows(planning.missing_symbols(pins, nodes, "T")) == [("g", "a.go", "modify")]
    assert rows(planning.capture_quality(pins, "T")) == [(2, 2)]
    assert rows(planning.orientation(pins, "U")) == []
    with pytest.raises(ValueError, match="empty"):
        require_nodes(nodes.limit(0))


def test_external_types_and_their_files(nodes_of):
    nodes = nodes_of([{"type": "qualified_type", "peek": "arrow.Record", "file_path": f"f{i % 60}.go"} for i in range(90)])
    assert rows(types.external_types(nodes)) == [("arrow.Record", 90, 60)]
    files = rows(types.external_type_files(nodes), "file_path", "uses")
    assert sorted(files) == sorted((f"f{i}.go", 2 if i < 30 else 1) for i in range(60))


def test_every_edit_changes_the_manifest(spark, nodes_of):
    base = {"file_path": "a", "node_id": 1, "parent_id": 0, "depth": 1, "name": "f", "type": "t", "semantic_type": "s", "start_line": 1,
            "end_line": 9, "descendant_count": 2, "children_count": 1, "peek": "p", "parameters": [("x", "y")], "signature_type": "g"}
    other = {"node_id": 2, "parent_id": 1, "depth": 2, "name": "g", "type": "u", "semantic_type": "r", "start_line": 5, "end_line": 13,
             "descendant_count": 3, "children_count": 2, "peek": "q", "parameters": [("x", "z")], "signature_type": "h"}
    hash_of = lambda row: corpus.node_manifest(nodes_of([row])).first().content_hash
    seen = {hash_of(base)} | {hash_of(base | {k: v}) for k, v in other.items()}
    seen |= {hash_of(base | {k: None}) for k in ("name", "type", "peek", "signature_type", "parameters")}
    assert len(seen) == 1 + len(other) + 5


def test_a_shift_of_lines_is_an_edit(spark, nodes_of):
    lines = lambda a, b: nodes_of([{"file_path": "a.go", "name": "f", "semantic_type": FUNC, "start_line": a, "end_line": b}])
    old, new = lines(1, 9), lines(5, 13)
    changed = corpus.file_changes(corpus.node_manifest(old), corpus.node_manifest(new))
    assert rows(changed) == [("a.go", "modified")]
    fresh = stores.refresh(old, changed, new)
    assert rows(fresh, "start_line", "end_line") == [(5, 13)]
    pins = planning.capture_planning_context(old, "T", "modify", "**", "f", F.lit("2024-01-01").cast("timestamp"))
    assert rows(planning.planning_drift(pins, fresh, "T"), "planned_line", "current_line", "drift_lines") == [(1, 5, 4)]


def test_refresh_and_deleted_files(spark, nodes_of):
    old = nodes_of([{"file_path": f, "name": "old"} for f in ("a", "b", "c")])
    new = nodes_of([{"file_path": f, "name": "new"} for f in ("a", "d", "c")])
    manifest = spark.createDataFrame([("a", "modified"), ("b", "deleted"), ("d", "added")], "file_path string, status string")
    got = lambda **k: sorted(rows(stores.refresh(old, manifest, new, **k), "file_path", "name"))
    assert got() == [("a", "new"), ("c", "old"), ("d", "new")]
    assert got(keep_deleted=True) == [("a", "new"), ("b", "old"), ("c", "old"), ("d", "new")]


def test_a_refresh_moves_no_nodes_for_a_short_manifest(spark, nodes_of):
    old = nodes_of([{"file_path": f"f{i}", "name": "old"} for i in range(300)])
    new = old.where("node_id > 0").withColumn("name", F.expr("if(node_id < 9, 'new', name)"))
    changed = corpus.file_changes(corpus.node_manifest(old), corpus.node_manifest(new))
    fresh = stores.refresh(old, changed, new)
    assert "Exchange hashpartitioning" not in fresh._jdf.queryExecution().executedPlan().toString()
    assert sorted(rows(fresh, "file_path", "name")) == sorted((f"f{i}", "new" if i < 9 else "old") for i in range(1, 300))


def test_planning_store_replay_changes_nothing(spark, nodes_of, tmp_path):
    path = str(tmp_path / "pins")
    nodes = nodes_of([{"name": n, "semantic_type": FUNC} for n in ("f", "g")])
    at = F.lit("2024-01-01").cast("timestamp")
    capture = lambda task, role="modify", name="%": planning.capture_planning_context(nodes, task, role, "**", name, at)
    read = lambda *c: sorted(rows(stores.read_planning_context(spark, path), *c))
    assert read() == [] and not stores.table_exists(spark, path)
    for task in ("T1", "T2", "T1"):
        stores.write_planning_context(spark, path, [task], capture(task))
    assert read("task_id", "symbol_name") == [("T1", "f"), ("T1", "g"), ("T2", "f"), ("T2", "g")]
    stores.write_planning_context(spark, path, ["T1"], capture("T1", "modify", "f"), capture("T1", "implement", "g"))
    assert read("task_id", "role", "symbol_name") == [("T1", "implement", "g"), ("T1", "modify", "f"), ("T2", "modify", "f"), ("T2", "modify", "g")]
    stores.write_planning_context(spark, path, ["T2"], capture("T2", "modify", "nothing"))
    assert read("task_id", "symbol_name") == [("T1", "f"), ("T1", "g")]
    assert stores.table_exists(spark, path) and not stores.table_exists(spark, path + "x")


def test_versioned_table_swaps_whole_versions(spark, tmp_path):
    schema = spark.range(0).schema
    store = stores.VersionedTable(spark, str(tmp_path / "t"), schema)
    assert store.read().count() == 0
    store.write(spark.range(3), 1)
    seen = store.read()
    store.write(stores.replace_by_key(store.read(), spark.range(2, 5), ["id"]), 2)
    assert seen.count() == 3 and sorted(r.id for r in store.read().collect()) == [0, 1, 2, 3, 4]


def test_markup_rule_on_hand_made_pages(spark):
    pages = spark.createDataFrame(
        [
            ("ok", '<ul><li>a<p>b</li><li><A HREF="x"\nhref="/t">c</a></li></ul>\n<br><nav>'),
            ("neg", "<div></div></div>"),
            ("clash", "<ul><li></ul></li>"),
            ("script", '<div><script>var t="</div></div>";</script><!-- </div> --></div>'),
            ("bare", "no tags"),
        ],
        "url string, html string",
    )
    got = markup.markup_nodes(pages, peek="full")
    columns = ["node_id", "parent_id", "depth", "type", "descendant_count", "children_count", "start_line", "end_line"]
    assert rows(got.where("file_path = 'ok'").orderBy("node_id"), *columns) == [
        (0, None, 0, "ul", 4, 2, 1, 2),
        (1, 0, 1, "li", 1, 1, 1, 1),
        (2, 1, 2, "p", 0, 0, 1, 1),
        (3, 0, 1, "li", 1, 1, 1, 2),
        (4, 3, 2, "a", 0, 0, 1, 2),
        (5, None, 0, "br", 0, 0, 3, 3),
        (6, None, 0, "nav", 0, 0, 3, 3),
    ]
    assert rows(got.where("type = 'a'"), "name", "semantic_type") == [("/t", "EXTERNAL_IMPORT")]
    assert sorted(rows(markup.markup_rejects(pages))) == [("clash", "mismatched pair"), ("neg", "negative depth")]
    assert rows(got.where("file_path = 'script'"), "type") == [("div",)]


def test_corpus_scan_skips_excluded_folders(spark, tmp_path):
    for name in ("a.go", "x/b.go", "vendor/c.go", "gen/d.go", "x/vendor/e.go", "n.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"é {name}")
    files = corpus.scan_corpus(spark, str(tmp_path), "go")
    assert sorted(rows(files, "file_path", "text")) == [(n, f"é {n}") for n in ("a.go", "x/b.go", "x/vendor/e.go")]
    assert corpus.changed_files(corpus.corpus_manifest(files), F.lit("2000-01-01").cast("timestamp")).count() == 3
    assert rows(corpus.dominant_extension(files, "file_path")) == [("go", 3)]
    (tmp_path / "x" / "bad.go").write_bytes(b"c\xe9")
    assert sorted(rows(corpus.scan_corpus(spark, str(tmp_path), "go"), "file_path")) == [("a.go",), ("x/b.go",), ("x/vendor/e.go",)]
    assert rows(corpus.scan_rejects(spark, str(tmp_path), "go")) == [("x/bad.go", "not UTF-8")]
    assert corpus.scan_corpus(spark, str(tmp_path / "vendor"), "py").count() == 0


def test_slug_rule(spark):
    df = spark.createDataFrame([("docs/My Plan.md",), ("P8-002-Pipe",)], "p string")
    assert rows(df.select(slug_of(F.col("p")))) == [("my-plan",), ("p8-002-pipe",)]


def test_views_answer_sql(spark, nodes_of):
    from canopy.api import register_views

    nodes = nodes_of([{"name": "f", "semantic_type": FUNC, "type": "function_declaration"}])
    register_views(nodes)
    got = spark.sql("select name, kind from ast_symbols join function_metrics using (name, file_path) where cyclomatic = 1")
    assert rows(got) == [("f", "function")]


def test_slices_of_a_page_give_the_nodes_of_the_whole(spark, monkeypatch):
    rng = random.Random(7)

    def page(size):
        out, stack = [], []
        for _ in range(size):
            kind = rng.random()
            if kind < 0.4:
                stack.append(rng.choice(["div", "ul", "li"]))
                out.append(f"<{stack[-1]}>")
            elif kind < 0.75 and stack:
                out.append(f"</{stack.pop()}>")
            else:
                out.append(rng.choice(["<p>", "\n", "<br>", "</b>", '<a href="/x">t</a>']))
        if rng.random() < 0.7:
            out += [f"</{tag}>" for tag in reversed(stack)]
        return "".join(out)

    pages = [(f"u{k}", page(rng.choice([3, 40, 300]))) for k in range(25)]
    pages += [("neg", page(30) + "</div>" * 40), ("clash", "<div><ul>" + page(4) + "</div></ul>"), ("flat", "<p>" * 100), ("deep", "<div>" * 60 + "</div>" * 60), ("open", "<div><p>" * 50)]
    df = spark.createDataFrame(pages, "url string, html string")
    shown = ["file_path", "node_id", "parent_id", "depth", "type", "start_line", "end_line", "descendant_count", "children_count"]
    whole, rejects = sorted(rows(markup.markup_nodes(df), *shown), key=repr), sorted(rows(markup.markup_rejects(df)))
    monkeypatch.setattr(markup, "SLICE", 4)
    assert sorted(rows(markup.markup_nodes(df, sliced=True), *shown), key=repr) == whole
    assert sorted(rows(markup.markup_rejects(df, sliced=True))) == rejects
    assert len(rejects) >= 2 and len(whole) > 500
    children = {}
    for file, _, parent, *_ in whole:
        children[file, parent] = children.get((file, parent), 0) + 1
    assert all(children.get((r[0], r[1]), 0) == r[8] for r in whole)
    for file, node, parent, depth, *_ in whole:
        earlier = [r[1] for r in whole if r[0] == file and r[1] < node and r[3] == depth - 1]
        assert parent == (max(earlier) if depth else None)
