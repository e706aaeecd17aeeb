"""Readers for the two kinds of documents that gates look at: task documents and review reports.

Each looks at the whole text of a row with built-in expressions; a missing part is NULL or an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.text import trimmed
from canopy.operators.review import VERDICTS

# The parts of a task document and of a review report.
TASK_ID = r"P\d+-\d+"
TABLE_PATH = r"(?m)^\|\s*`([^`\n]+)`\s*\|\s*(Create|Modify|Delete|Generated)\b"
TABLE_TEST = r"(?m)^\|\s*`(Test[^`\n]*)`\s*\|"
VECTOR = rf"(?m)^\|\s*(\d+)\s*\|\s*([^|\n]+?)\s*\|\s*({'|'.join(VERDICTS)})\s*\|"
VERDICT_LINE = rf"(?:\A|\n)Verdict:[ \t]*({'|'.join(VERDICTS)})\s*\z"


def _field(text: Column, label: str) -> Column:
    """The rest of the first line that begins with ``label``."""
    found = trimmed(F.regexp_extract(text, rf"(?m)^{label}[ \t]*([^\r\n]*)", 1))
    return F.when(found != "", found)


def _section(text: Column, title: str) -> Column:
    """What stands below a second-level heading, up to the next one."""
    return F.regexp_extract(text, rf"(?:\A|\n)## {title}[^\n]*\n([^\n]*+(?:\n(?!## )[^\n]*+)*+)", 1)


def read_tasks(documents: DataFrame, text: str) -> DataFrame:
    """Task documents: id, title, status, depends_on, blocks, files (path, action) and tests, beside the other columns."""
    body = F.col(text)
    ids = lambda label: F.regexp_extract_all(F.coalesce(_field(body, label), F.lit("")), F.lit(f"({TASK_ID})"), 1)
    files = _section(body, "Files")
    paths, actions = (F.regexp_extract_all(files, F.lit(TABLE_PATH), k) for k in (1, 2))
    task = F.regexp_extract(body, rf"(?m)^# ({TASK_ID}):", 1)
    return documents.select(
        *[c for c in documents.columns if c != text],
        F.when(task != "", task).alias("task_id"), _field(body, rf"# {TASK_ID}:").alias("title"), _field(body, "Status:").alias("status"),
        ids("Depends on:").alias("depends_on"), ids("Blocks:").alias("blocks"),
        F.arrays_zip(paths.alias("path"), actions.alias("action")).alias("files"), F.regexp_extract_all(body, F.lit(TABLE_TEST), 1).alias("tests"),
    )


def task_edges(tasks: DataFrame) -> DataFrame:
    """(id, depends_on) rows for ``gate.dependency_chains``."""
    return tasks.select(F.col("task_id").alias("id"), F.explode("depends_on").alias("depends_on"))


def task_sizes(tasks: DataFrame) -> DataFrame:
    """(task_id, files, tests) counts for ``gate.size_limits``.

    The counts come out of a generator, so that a filter on them stays above it: pushed below, it would build and search
    each document a second time.
    """
    sizes = [F.size(c).cast("bigint").alias(c) for c in ("files", "tests")]
    return tasks.select("task_id", F.inline(F.array(F.struct(*sizes))))


def read_reports(documents: DataFrame, text: str) -> DataFrame:
    """Review reports: plan, reviewer, iteration, date, verdict (the last line, else NULL) and vectors (number, vector, result)."""
    body = F.col(text)
    numbers, names, results = (F.regexp_extract_all(body, F.lit(VECTOR), k) for k in (1, 2, 3))
    verdict = F.regexp_extract(body, VERDICT_LINE, 1)
    head = lambda label: _field(body, rf"\*\*{label}:\*\*")
    return documents.select(
        *[c for c in documents.columns if c != text],
        head("Plan").alias("plan_slug"), head("Reviewer").alias("reviewer"), head("Iteration").try_cast("bigint").alias("iteration"),
        head("Date").alias("date"), F.when(verdict != "", verdict).alias("verdict"),
        F.arrays_zip(numbers.alias("number"), names.alias("vector"), results.alias("result")).alias("vectors"),
    )


def report_rows(reports: DataFrame) -> DataFrame:
    """One row per vector of a report, for ``review.report_consistency`` and ``review.worst_verdict``."""
    return reports.select(*[c for c in reports.columns if c != "vectors"], F.explode("vectors").alias("v")).select(
        *[c for c in reports.columns if c != "vectors"], F.col("v.number").cast("int").alias("number"), "v.vector", "v.result"
    )


# The sections of a report that list issues, and their severity.
ISSUE_SECTIONS = {"critical": "Critical Issues", "major": "Major Issues"}


def report_issues(documents: DataFrame, text: str) -> DataFrame:
    """One row per issue that a report lists: severity, place in its section from 1, title and detail, beside the other columns.

    An issue is a third-level heading and what stands below it; a section without headings, such as one that says "None.",
    lists none.
    """
    body = F.col(text)

    def issues(severity: str, title: str) -> Column:
        section = F.regexp_replace(_section(body, title), r"(?s)(?:\A|\n)---[ \t\r]*(?:\n.*)?\z", "")  # a rule ends it
        parts = F.slice(F.split(section, r"(?m)^### "), 2, 1 << 30)  # what stands before the first heading is no issue
        return F.transform(parts, lambda part, at: F.struct(
            F.lit(severity).alias("severity"), (at + 1).alias("number"),
            trimmed(F.substring_index(part, "\n", 1)).alias("title"), trimmed(F.regexp_replace(part, r"\A[^\n]*", "")).alias("detail")))

    sections = [issues(severity, title) for severity, title in ISSUE_SECTIONS.items()]
    kept = [c for c in documents.columns if c != text]
    return documents.select(*kept, F.explode(F.concat(*sections)).alias("_issue")).select(*kept, "_issue.*")
