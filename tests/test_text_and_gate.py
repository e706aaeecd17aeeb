"""Rules of the text scans, artifacts, links and gate checks."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from canopy.functions import text as X
from canopy.functions.patterns import is_valid_slug
from canopy.operators import gate, textscan


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_valid_slugs(spark):
    good = ["my-plan", "P1-004-server", "plan123", "a", ".."]
    bad = ["../evil", "../../etc/passwd", "foo/bar", "foo\\bar", "./local", "a/b/c", "", None]
    assert column(spark, good + bad, is_valid_slug) == [True] * len(good) + [False] * len(bad)


def test_unavailable_messages_in_any_case(spark):
    yes = ["Error: MODEL IS NOT SUPPORTED here", "sorry, Access To This Model is restricted", "not supported via this route"]
    no = ["invalid token", "connection refused", "rate limit exceeded", ""]
    assert column(spark, yes + no, X.contains_any) == [True] * 3 + [False] * 4


def test_terms_are_replaced_in_turn(spark):
    got = column(spark, ["multi_replace_string_in_file, replace_string_in_file; read_file"], X.translate_terms)
    assert got == ["multiedit, edit; view"]


def test_destructive_commands(spark):
    check = lambda v: X.is_destructive(v, r"\.audit")
    yes = ["rm -rf .audit/x", "find . -name y -delete .audit", "git  clean -fd .audit", "Remove-Item .audit"]
    no = ["ls .audit", "rm other", "rm x\nls .audit", "cat .audit; rm x"]
    assert column(spark, yes + no, check) == [True] * 4 + [False] * 4


def test_first_label_takes_the_first_valid_line(spark):
    label = lambda v: X.first_label(v, "Verdict", ("PASSED", "CONDITIONAL", "FAILED"))
    texts = ["x\nVerdict: FAILED\nVerdict: PASSED", " Verdict: PASSED", "**Verdict: PASSED", "Verdict: maybe\nVerdict:  CONDITIONAL!", ""]
    assert column(spark, texts, label) == ["FAILED", "", "", "CONDITIONAL", ""]


def test_lines_and_words(spark):
    assert column(spark, ["a x a\nb\na\n", "", "b"], lambda v: X.matching_lines(v, "a")) == [2, 0, 0]
    assert column(spark, ["  one\ttwo\n\nthree ", "", " "], X.word_count) == [3, 0, 0]


def test_clean_path(spark):
    cases = {"a/../b": "b", "a/../../b": "../b", "./a//b/": "a/b", "/../a": "/a", "": ".", "..": "..", "../../x": "../../x", "a/..": "."}
    assert column(spark, list(cases), X.clean_path) == list(cases.values())


ARTIFACT = "title string, slug string, source string, summary string, api_surface string, constraints string, anti_patterns string, minimal_examples string, referenced_by array<string>"


def test_artifact_errors_come_in_order(spark):
    ok = ["T", "s", "src", "sum", "api", "con", "anti", None, ["docs/tasks/a.md"]]
    bad = {
        1: ("a/b", "invalid slug"),
        0: (" \t", 'required field "title" is empty'),
        6: (None, 'required field "anti_patterns" is empty'),
        8: (["ok.md", "x/../../y.md"], "invalid referenced_by path"),
    }
    data = [tuple(ok)] + [tuple(v if i == at else o for i, o in enumerate(ok)) for at, (v, _) in bad.items()]
    got = rows(textscan.validate_artifacts(spark.createDataFrame(data, ARTIFACT)), "error")
    assert [e for (e,) in got] == [None] + [e for _, e in bad.values()]
    made = textscan.assemble_artifacts(spark.createDataFrame(data, ARTIFACT), F.lit("2025-02-03"), "me").collect()
    assert [m.path for m in made] == ["docs/artifacts/2025-02-03-s.md"]
    assert made[0].links == "[a](../tasks/a.md)" and "Minimal" not in made[0].content
    assert made[0].word_count == len(made[0].content.split())


def test_links_are_injected_once(spark):
    docs = spark.createDataFrame([("t1", "# One\nbody\nmore"), ("t2", "# Two"), ("t3", "no title")], "task string, text string")
    links = spark.createDataFrame(
        [("a.md", "t1"), ("a.md", "t1"), ("b.md", "t1"), ("a.md", "t2"), ("a.md", "t3"), ("a.md", "t9")], "artifact string, task string"
    )
    outcome = lambda d: sorted(rows(textscan.link_outcomes(links, d, "artifact", "task", "text")))
    first = [("t1", "a.md", "injected"), ("t1", "b.md", "injected"), ("t2", "a.md", "injected"), ("t3", "a.md", "malformed"), ("t9", "a.md", "not_found")]
    assert outcome(docs) == first
    once = textscan.inject_links(links, docs, "artifact", "task", "text")
    texts = dict(rows(once, "task", "text"))
    line = "> **Prerequisite:** Read `{}` before writing any code in this phase."
    assert texts["t1"] == f"# One\n{line.format('a.md')}\n{line.format('b.md')}\nbody\nmore"
    assert texts["t2"] == f"# Two\n{line.format('a.md')}\n" and texts["t3"] == "no title"
    assert [o for _, _, o in outcome(once)] == ["already_present"] * 3 + ["malformed", "not_found"]
    assert dict(rows(textscan.inject_links(links, once, "artifact", "task", "text"), "task", "text")) == texts


def test_done_markers(spark):
    texts = ["**Status:** Done", "Status: completed", "Status: Not Done", "Status: Open", "x\nStatus: Done."]
    assert column(spark, texts, gate.is_done) == [True, True, True, False, True]
    assert column(spark, texts, lambda v: gate.is_done(v, strict=True)) == [True, True, False, False, True]


def test_threshold_cuts_decimals(spark):
    df = spark.createDataFrame([("a", 79.9), ("b", 80.0), ("c", None)], "k string, v double")
    assert rows(gate.threshold_check(df, "k", "v", 80), "severity") == [("fail",), ("pass",), ("warn",)]


@pytest.mark.parametrize("strict,want", [(False, (0, 1, True)), (True, (2, 0, False))])
def test_annotations_warn_or_fail(spark, strict, want):
    counts = spark.createDataFrame([(2, 1)], "assumptions bigint, todos bigint")
    assert rows(gate.roll_up(gate.annotation_check(counts, strict))) == [want]


def test_gate_passes_without_failures_and_without_checks(spark):
    checks = spark.createDataFrame([("a", "warn", ""), ("b", "pass", "")], "check string, severity string, message string")
    assert rows(gate.roll_up(checks)) == [(0, 1, True)]
    assert rows(gate.roll_up(checks.where("false"))) == [(0, 0, True)]


def test_next_sequence(spark):
    names = spark.createDataFrame([("P1-001-a.md",), ("P1-003-b.md",), ("P2-1200-c.md",), ("readme.md",)], "name string")
    assert sorted(rows(gate.next_task_sequence(names, "name"))) == [("1", "004"), ("2", "1201")]


def test_dependency_chains_have_their_true_length(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("x", "y"), ("x", "b"), ("p", "q"), ("q", "p"), ("r", "p"), ("r", "a"), ("s", "s"), ("n", None)]
    edges += [(f"t{k}", f"t{k + 1}") for k in range(45)] + [("t3", "t40")]
    found = gate.dependency_chains(spark.createDataFrame(edges, "id string, depends_on string"))
    got = {i: (c, o, y) for i, c, o, y in rows(found)}
    want = {"a": 4, "b": 3, "c": 2, "d": 1, "x": 4} | {f"t{k}": 45 - k for k in range(45)}
    assert got == {i: (n, n > 3, False) for i, n in want.items()} | {i: (None, True, True) for i in "pqrs"}
    assert gate.dependency_chains(spark.createDataFrame([], "id string, depends_on string")).count() == 0


@pytest.mark.parametrize("dependants", [100_000, 3])
def test_chains_of_layered_graphs_keep_tables_as_small_as_the_edges(spark, monkeypatch, dependants):
    monkeypatch.setattr(gate, "DEPENDANTS", dependants)
    rng, layers, wide = random.Random(3), 40, 12
    edges = {(k * wide + i, (k + 1) * wide + rng.randrange(wide)) for k in range(layers) for i in range(wide) for _ in range(3)}
    edges |= {(rng.randrange(0, 200), rng.randrange(250, layers * wide)) for _ in range(40)}  # links over many layers
    edges |= {(9000 + k, 300) for k in range(60)}  # many that depend on one
    edges |= {(5000, 5001), (5001, 5002), (5002, 5000), (5003, 5000), (5003, 7), (5004, 5003), (4, 4 + wide)}
    below = {}
    for task, dependency in edges:
        below.setdefault(task, set()).add(dependency)
    want, open_ = {}, dict(below)
    while ready := [t for t, ds in open_.items() if all(d in want or d not in below for d in ds)]:
        want |= {t: 1 + max(want.get(d, 0) for d in open_[t]) for t in ready}
        for t in ready:
            del open_[t]
    sizes = []
    monkeypatch.setattr(gate, "written", lambda df, keep=gate.written: (table := keep(df), sizes.append(table.count()))[0])
    found = rows(gate.dependency_chains(spark.createDataFrame(list(edges), "id bigint, depends_on bigint")))
    assert sorted(found, key=repr) == sorted([(t, n, n > 3, False) for t, n in want.items()] + [(t, None, True, True) for t in open_], key=repr)
    assert set(open_) == {5000, 5001, 5002, 5003, 5004} and max(want.values()) == layers
    assert max(sizes) <= len(edges)


def test_status_of_another_line_does_not_count(spark):
    df = spark.createDataFrame([("Status:\n\nDone when x",), ("**Status:** Done",), ("- Status : completed",)], "t string")
    assert [r[0] for r in df.select(gate.is_done(F.col("t"), strict=True)).collect()] == [False, True, True]


def test_terms_of_a_table_equal_brute_force(spark):
    rng = random.Random(9)
    some = lambda low, high: "".join(rng.choice("abcé🙂 ") for _ in range(rng.randint(low, high)))
    terms = [(t, t.upper()) for t in {some(1, 9) for _ in range(300)}] + [("abcab", "x"), ("abcab", "x"), ("abcab", "y"), ("", "z"), (None, "z"), ("zzzz", "never")]
    texts = [(k % 7, some(0, 60), 1) for k in range(120)] + [(1, None, 1), (None, "abcab", 1), (2, "a", 1), (2, "a", 1)]
    got = textscan.banned_terms_of(
        spark.createDataFrame(texts, "grp int, body string, gram int"), "grp", "body", spark.createDataFrame(terms, "term string, replacement string")
    )
    want = {}
    for grp, body, _ in texts:
        for term, replacement in {t for t in terms if t[0]}:
            if body is not None and term in body:
                want[grp, term, replacement] = want.get((grp, term, replacement), 0) + 1
    assert sorted(rows(got), key=repr) == sorted(((*k, n) for k, n in want.items()), key=repr)
    none = textscan.banned_terms_of(spark.createDataFrame(texts, "grp int, body string, gram int"), "grp", "body", spark.createDataFrame([], "term string, replacement string"))
    assert none.count() == 0 and none.columns == got.columns


def test_texts_that_share_only_part_of_a_term_are_not_looked_up(spark, monkeypatch):
    kept, written = [], textscan.written
    monkeypatch.setattr(textscan, "written", lambda df: kept.append(written(df)) or kept[-1])
    texts = spark.createDataFrame([(k, f"a relation {k} of stations") for k in range(9)] + [(9, "an operation")], "k int, body string")
    terms = spark.createDataFrame([("operation", "x"), ("nation", "y")], "term string, replacement string")
    assert sorted(rows(textscan.banned_terms_of(texts, "k", "body", terms))) == [(9, "operation", "x", 1)]
    hits = next(df for df in kept if df.columns == ["gram", "_row"])
    assert hits.select("_row").distinct().count() == 1
