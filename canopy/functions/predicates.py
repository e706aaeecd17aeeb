"""Column predicates over node tables (semantic codes, branches, exclusions)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Semantic codes of the node table.
FUNCTION = "DEFINITION_FUNCTION"
CLASS = "DEFINITION_CLASS"
MODULE = "DEFINITION_MODULE"
TYPE = "DEFINITION_TYPE"
VARIABLE = "DEFINITION_VARIABLE"
CALL = "COMPUTATION_CALL"
CONDITIONAL = "FLOW_CONDITIONAL"
LOOP = "FLOW_LOOP"
JUMP = "FLOW_JUMP"
IMPORT = "EXTERNAL_IMPORT"
STRING = "LITERAL_STRING"
COMMENT = "METADATA_COMMENT"
DEFINITIONS = (FUNCTION, CLASS, MODULE, TYPE, VARIABLE)

# Grammar-type endings that make a conditional or a loop a real branch.
CONDITIONAL_ENDINGS = ("_statement", "_clause", "_expression", "_arm", "_case", "_branch")
LOOP_ENDINGS = ("_statement", "_expression", "_loop")

TOP_LEVEL_DEPTH = 2


def _code(*codes: str) -> Column:
    return F.col("semantic_type").isin(*codes)


def is_definition() -> Column:
    return _code(*DEFINITIONS)


def is_function_definition() -> Column:
    return _code(FUNCTION)


def is_class_definition() -> Column:
    return _code(CLASS)


def is_module_definition() -> Column:
    return _code(MODULE)


def is_call() -> Column:
    return _code(CALL)


def is_import() -> Column:
    return _code(IMPORT)


def is_loop() -> Column:
    return _code(LOOP)


def is_conditional() -> Column:
    return _code(CONDITIONAL)


def is_string_literal() -> Column:
    return _code(STRING)


def is_comment() -> Column:
    return _code(COMMENT)


KINDS = {
    "calls": is_call,
    "imports": is_import,
    "definitions": is_definition,
    "loops": is_loop,
    "conditionals": is_conditional,
    "strings": is_string_literal,
    "comments": is_comment,
}


def of_kind(kind: str) -> Column:
    """Predicate for a kind name; an unknown kind selects nothing."""
    return KINDS[kind]() if kind in KINDS else F.lit(False)


def _type_ends(endings: tuple[str, ...]) -> Column:
    # '_' is a LIKE wildcard here: any one character before the word.
    return reduce(or_, [F.col("type").like(f"%{ending}") for ending in endings])


def is_branch() -> Column:
    return is_conditional() & _type_ends(CONDITIONAL_ENDINGS)


def is_repeat() -> Column:
    return is_loop() & _type_ends(LOOP_ENDINGS)


def is_return() -> Column:
    return F.col("type") == "return_statement"


def is_named() -> Column:
    """Neither NULL nor empty."""
    return F.col("name") != ""


def is_top_level() -> Column:
    return F.col("depth") <= TOP_LEVEL_DEPTH


def is_test_file(path: str = "file_path") -> Column:
    # '_' is a wildcard, so latest.go counts as a test file too.
    return F.col(path).like("%_test.go")


def is_generated_file(path: str = "file_path") -> Column:
    return F.col(path).like("%.pb.go") | F.col(path).like("%_gen.go")


def is_test_name(name: str = "name") -> Column:
    return reduce(or_, [F.col(name).like(p) for p in ("Test%", "Benchmark%", "Example%")])


def is_exported(name: str) -> Column:
    """First character equals its upper case; digits and symbols count as exported."""
    first = F.substring(F.col(name), 1, 1)
    return first == F.upper(first)
