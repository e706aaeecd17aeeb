"""The shared plans against brute force on small, awkward inputs."""

import random
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy.plans import blocks, copies, enclosing, numbering, subtrees, suffixes
from canopy.sources.forest import built_forest


def test_cover_is_exact(spark):
    grid = blocks.Grid(base=0, step=2, levels=3)
    random.seed(1)
    ranges = [(a, b) for a in range(0, 40, 3) for b in range(a - 2, 70, 7)] + [(5, 5), (0, 255), (3, 2), (63, 64)]
    df = spark.createDataFrame(ranges, "a bigint, b bigint").select("a", "b", grid.cover("a", "b").alias("c"))
    for a, b, cover in rows(df):
        covered = [n for level, block in cover for n in range(block << (2 * level), (block + 1) << (2 * level))]
        assert sorted(covered) == list(range(a, b + 1)), (a, b)


def _random_tree(seed, size):
    """A random pre-order tree with many nested functions."""
    rng = random.Random(seed)
    depth, nodes = 0, []
    for i in range(size):
        depth = rng.randint(0, min(depth + 1, 12)) if i else 0
        kind = rng.choice(["FUNC", "if", "for", "ret", "call"])
        nodes.append([i, depth, kind])
    for i, node in enumerate(nodes):
        below = 0
        while i + below + 1 < size and nodes[i + below + 1][1] > node[1]:
            below += 1
        node.append(below)
    return nodes


@pytest.mark.parametrize("base,step,levels", [(2, 1, 3), (8, 6, 4)])
def test_subtrees_equal_brute_force(spark, nodes_of, monkeypatch, base, step, levels):
    monkeypatch.setattr(subtrees, "GRID", blocks.Grid(base, step, levels))
    codes = {"FUNC": ("DEFINITION_FUNCTION", "function_declaration"), "if": ("FLOW_CONDITIONAL", "if_statement"),
             "for": ("FLOW_LOOP", "for_loop"), "ret": ("FLOW_JUMP", "return_statement"), "call": ("COMPUTATION_CALL", "x")}
    trees = {f"f{n}.go": _random_tree(n, size) for n, size in enumerate((1, 40, 700))}
    nodes = nodes_of(
        [{"file_path": f, "node_id": i, "depth": d, "semantic_type": codes[k][0], "type": codes[k][1], "name": "n", "descendant_count": c}
         for f, tree in trees.items() for i, d, k, c in tree]
    )
    measured = subtrees.subtree_measures(
        nodes, nodes.where("semantic_type = 'DEFINITION_FUNCTION'"), ["nodes", "conditionals", "loops", "return_count", "deepest"], []
    )
    got = {(r.file_path, r.node_id): tuple(r)[2:] for r in measured.collect()}
    want = {}
    for f, tree in trees.items():
        for i, _, kind, c in tree:
            if kind == "FUNC":
                below = tree[i + 1 : i + 1 + c]
                kinds = [k for _, _, k, _ in below]
                want[f, i] = (c, kinds.count("if"), kinds.count("for"), kinds.count("ret"), max((d for _, d, _, _ in below), default=None))
    assert got == want


@pytest.mark.parametrize("step,levels", [(4, 5), (1, 3)])
def test_innermost_equals_brute_force(spark, monkeypatch, step, levels):
    monkeypatch.setattr(enclosing, "LINES", blocks.Grid(0, step, levels))
    rng = random.Random(5)
    scopes = [("f", i, a := rng.randint(1, 300), a + rng.choice([0, 3, 40, 500])) for i in range(60)]
    points = [("f", rng.randint(1, 900)) for _ in range(200)] + [("g", 7)]
    ranges = spark.createDataFrame(scopes, "file string, id int, lo int, hi int")
    found = enclosing.innermost(
        spark.createDataFrame(points, "file string, at int"), ranges, ["file"], "at", "lo", "hi"
    )
    want = {
        (f, p): min(((hi - lo, -lo, lo, hi) for g, i, lo, hi in scopes if g == f and lo <= p <= hi), default=(0, 0, None, None))[2:]
        for f, p in points
    }
    assert {(r.file, r.at): (r.lo, r.hi) for r in found.collect()} == want


def test_tasks_of_innermost_join_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(enclosing, "TASK_ROWS", 100, raising=False)
    ranges = spark.range(40).selectExpr("concat('f', id - id) as file", "int(id * 10) as lo", "int(id * 10 + 8) as hi")
    points = spark.range(400).selectExpr("concat('f', id - id) as file", "int(id) as at")
    found = enclosing.innermost(points, ranges, ["file"], "at", "lo", "hi")
    dealt = re.findall(r"hashpartitioning\(file[^,]*, level[^,]*, block[^,]*, (\d+)\), REPARTITION_BY_NUM", found._jdf.queryExecution().executedPlan().toString())
    assert dealt == ["12", "12"]  # 400 lines ask for 3 blocks each
    assert {(r.at, r.lo) for r in found.collect()} == {(p, p - p % 10 if p % 10 < 9 else None) for p in range(400)}


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_running_sum_with_a_hot_key_and_copies(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(numbering, "COPY_BLOCK", 7)
    rng = random.Random(2)
    # One key holds most rows, and a third of them are one repeated row.
    data = [("hot", rng.randint(0, 50), rng.randint(0, 9)) for _ in range(200)] + [("hot", 20, 3)] * 100
    data += [(f"k{i}", 1, i) for i in range(30)] + [(None, 1, 4), (None, 2, None)]
    data = [(k, o, v) for k, o, v in data]
    df = spark.createDataFrame(data, "k string, o int, v int")
    got = numbering.running_sum(df, ["k"], ["o", "v"], "v", "before", hot_rows=hot_rows)
    want, totals = [], {}
    for k, o, v in sorted(data, key=lambda r: (r[0] or "", r[1], -1 if r[2] is None else r[2])):
        want.append((k, o, v, totals.get(k, 0)))
        totals[k] = totals.get(k, 0) + (v or 0)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows(got), key=key) == sorted(want, key=key)
    numbers = rows(numbering.numbered(df, ["k"], ["o", "v"], "n", hot_rows=hot_rows).groupBy("k").agg(F.sort_array(F.collect_list("n"))))
    assert all(ns == list(range(1, len(ns) + 1)) for _, ns in numbers)


def test_copies_in_order(spark, monkeypatch):
    monkeypatch.setattr(copies, "BLOCK", 4)
    df = spark.createDataFrame([("b", 9), ("a", 1), ("c", 4)], "k string, n bigint")
    assert [r.k for r in copies.copies_in_order(df, "n", ["k"]).collect()] == ["a"] + ["b"] * 9 + ["c"] * 4


def test_suffix_join_equals_the_theta_join(spark):
    paths = ["a/b/c.go", "b/c.go", "c.go", "xc.go", "/a/b/c.go", "a//c.go", "a/"]
    ends = ["c.go", "b/c.go", "/c.go", "a/b/c.go", "", "z"]
    found = suffixes.match_suffix(
        spark.createDataFrame([(p,) for p in paths], "file_path string"), spark.createDataFrame([(e,) for e in ends], "changed_path string")
    )
    want = sorted((e, p) for p in paths for e in ends if p == e or p.endswith("/" + e))
    assert sorted((r.changed_path, r.file_path) for r in found.collect()) == want


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_nested_loops_and_push_filters(spark):
    from canopy.operators import callers, diff, lookup, metrics

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    nodes = built_forest(spark, "/root/testdata/sf0.001")
    for df in (metrics.complexity_hotspots(nodes, "**"), callers.function_callers(nodes, "**", "Brand#1"),
               diff.changed_function_summary(nodes, spark.createDataFrame([("a", "added")], "file_path string, status string"), "**")):
        plan = _plan(df)
        assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    calls = _plan(lookup.find_calls(nodes, "ASIA/*.go", "Brand#1%"))
    assert "StringStartsWith(file_path,ASIA/)" in calls and "StringStartsWith(name,Brand#1)" in calls
    schema = calls.split("ReadSchema: ")[1]
    assert "descendant_count" not in schema and "parameters" not in schema


def _below(plan: str, node: str) -> str:
    """What a plan's text shows below the first line with ``node``."""
    return plan[plan.index(node) :]


def test_narrow_questions_restrict_the_tree_first(spark):
    from pyspark.sql import functions as F

    from canopy.operators import callers, diff, planning

    nodes = built_forest(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pins = planning.capture_planning_context(nodes, "T", "modify", "**", "customer#%", F.lit("2024-01-01").cast("timestamp"))
        changed = spark.createDataFrame([("a.go", "added")], "file_path string, status string")
        for df in (planning.planning_drift(pins, nodes, "T"), planning.missing_symbols(pins, nodes, "T"),
                   diff.changed_function_summary(nodes, changed, "**"), callers.function_callers(nodes, "**", "Brand#1")):
            assert "LeftSemi" in _plan(df)
        # The subtree join and the grouping of lines stand above the restriction.
        assert "LeftSemi" in _below(_plan(diff.changed_function_summary(nodes, changed, "**")), ">= first")
        assert "LeftSemi" in _below(_plan(planning.planning_drift(pins, nodes, "T")), "HashAggregate")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
