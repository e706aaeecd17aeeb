"""Readers of task documents and reports, and globs with classes."""

import random
import re

from conftest import rows
from pyspark.sql import functions as F

from canopy.functions.patterns import path_matches
from canopy.operators import gate
from canopy.sources import records

TASK = """# P2-014: Pipe reader

## Status
Status: In Progress
Depends on: P2-001 (types), P1-003 (files)
Blocks: P2-020 (x)

## Tests
| Test | What It Verifies |
|------|-----------------|
| `TestPipe` | a |
| `TestPipe_Nil` | b |

## Files
| File | Action | Description |
|------|--------|-------------|
| `a/b.go` | Create | c |
| `gen/x.go` | Generated | d |
"""

REPORT = """# Report: x

**Plan:** p-1
**Reviewer:** pool/m
**Iteration:** 3
**Date:** 2026-01-02

| # | Attack Vector | Result | Notes |
|---|---|---|---|
| 1 | False assumptions | PASSED | a |
| 2 | Edge cases | FAILED | b |

Verdict: PASSED
quoted above

Verdict: FAILED

"""


def test_task_documents(spark):
    df = spark.createDataFrame([(1, TASK), (2, "no task"), (3, None)], "k int, body string")
    got = {r.k: r for r in records.read_tasks(df, "body").collect()}
    one = got[1]
    assert (one.task_id, one.title, one.status, one.depends_on, one.blocks) == ("P2-014", "Pipe reader", "In Progress", ["P2-001", "P1-003"], ["P2-020"])
    assert [tuple(f) for f in one.files] == [("a/b.go", "Create"), ("gen/x.go", "Generated")] and one.tests == ["TestPipe", "TestPipe_Nil"]
    assert (got[2].task_id, got[2].status, got[2].depends_on, got[3].task_id) == (None, None, [], None)
    edges = records.task_edges(records.read_tasks(df, "body"))
    assert sorted(rows(gate.dependency_chains(edges), "id", "chain")) == [("P2-014", 1)]
    assert rows(records.task_sizes(records.read_tasks(df.where("k = 1"), "body"))) == [("P2-014", 2, 2)]


def test_reports(spark):
    df = spark.createDataFrame([(1, REPORT), (2, REPORT + "more"), (3, None)], "k int, body string")
    got = {r.k: r for r in records.read_reports(df, "body").collect()}
    assert (got[1].plan_slug, got[1].reviewer, got[1].iteration, got[1].date, got[1].verdict) == ("p-1", "pool/m", 3, "2026-01-02", "FAILED")
    assert got[2].verdict is None and got[3].plan_slug is None
    assert rows(records.report_rows(records.read_reports(df.where("k = 1"), "body")), "number", "vector", "result") == [
        (1, "False assumptions", "PASSED"), (2, "Edge cases", "FAILED")]


def test_glob_classes(spark):
    df = spark.createDataFrame([("a1.go",), ("b2.go",), ("c/d3.go",), ("[x].go",), ("e-.go",)], "file_path string")
    match = lambda glob: sorted(r[0] for r in df.where(path_matches(glob)).collect())
    assert match("[ab][0-9].go") == ["a1.go", "b2.go"] and match("[!a]?.go") == ["b2.go", "e-.go"]
    assert match("**/*[1-3].go") == ["a1.go", "b2.go", "c/d3.go"] and match("[[]x].go") == ["[x].go"]


ISSUES = """# Report: x

## Critical Issues (must fix before implementation)

### Edge cases
Empty input
crashes.

### Security
---

## Major Issues (should fix before proceeding)

None.

---

Verdict: FAILED
"""


def test_issues_of_a_report(spark):
    texts = [(1, ISSUES), (2, ISSUES.replace("None.", "### Failure modes\r\nRetry.\n\n### x")), (3, "no report"), (4, None), (5, "## Major Issues\n### only\n## Critical Issues\n### last")]
    got = sorted(rows(records.report_issues(spark.createDataFrame(texts, "id int, body string"), "body"), "id", "severity", "number", "title", "detail"))
    first = [("critical", 1, "Edge cases", "Empty input\ncrashes."), ("critical", 2, "Security", "")]
    assert got == [(1, *first[0]), (1, *first[1]), (2, *first[0]), (2, *first[1]), (2, "major", 1, "Failure modes", "Retry."), (2, "major", 2, "x", ""),
                   (5, "critical", 1, "last", ""), (5, "major", 1, "only", "")]


def test_a_filter_on_task_sizes_searches_no_document_twice(spark):
    df = spark.createDataFrame([(1, TASK)], "k int, body string").where("length(body) > 0")
    limits = gate.size_limits(records.task_sizes(records.read_tasks(df, "body")).withColumn("files", F.col("files") * 9), "task_id", "files", "tests")
    assert rows(limits) == [("P2-014", 18, 2, True, False)]
    plan = limits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("`(Test[^`") == 1


def test_sections_end_at_the_next_heading_or_with_the_text(spark):
    pieces = ["## Files", "## Notes", "##Files", "### x", "a", "", " ## Files", "## Files of", "b\r", "\u2028## c"]
    rng = random.Random(4)
    texts = [("\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))),) for _ in range(400)]

    def section(text):
        found = re.search(r"(?s)(?:\A|\n)## Files[^\n]*\n(.*?)(?=\n## |\Z)", text)
        return found[1] if found else ""

    got = spark.createDataFrame(texts, "body string").select("body", records._section(F.col("body"), "Files")).collect()
    assert [r[1] for r in got] == [section(r[0]) for r in got]
