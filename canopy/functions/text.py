"""Text scans and rewrites as column expressions; each looks at the whole text of a row."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode, as a character class that Java and RE2 read alike.
WHITE_SPACE = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Messages that mean a reviewer is blocked by policy.
UNAVAILABLE_MESSAGES = (
    "model is not supported",
    "model not supported",
    "not available for your organization",
    "not enabled for your organization",
    "access to this model",
    "model access denied",
    "this model is not available",
    "not supported via",
)

# Tool-name replacements, longer names before the names they contain.
TOOL_NAMES = (
    ("multi_replace_string_in_file", "multiedit"),
    ("replace_string_in_file", "edit"),
    ("runSubagent", "agent"),
    ("run_in_terminal", "bash"),
    ("create_file", "write"),
    ("manage_todo_list", "todos"),
    ("read_file", "view"),
    ("grep_search", "grep"),
    ("list_dir", "ls"),
    ("file_search", "glob"),
)

# Commands that delete, as alternatives of one pattern.
DESTRUCTIVE = r"rm|rmdir|Remove-Item|find.*-delete|git\s+clean"


def contains_any(text: Column, needles: Iterable[str] = UNAVAILABLE_MESSAGES) -> Column:
    """Whether the text holds any of the (lower-case) needles, in any case."""
    lowered = F.lower(text)
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(lowered, n))


def is_destructive(command: Column, protected: str) -> Column:
    """Whether a command deletes something under the protected path (a pattern), on one line."""
    return command.rlike(rf"({DESTRUCTIVE}).*{protected}")


def translate_terms(text: Column, pairs: Sequence[tuple[str, str]] = TOOL_NAMES) -> Column:
    """Replace terms one after the other, so an earlier result can be replaced again."""
    for term, replacement in pairs:
        text = F.replace(text, F.lit(term), F.lit(replacement))
    return text


def first_label(text: Column, label: str, values: Sequence[str]) -> Column:
    """The value on the first line ``label: value`` with a known value, else ``''``."""
    return F.regexp_extract(text, rf"(?m)^{label}:\s*({'|'.join(values)})", 1)


def matching_lines(text: Column, pattern: str) -> Column:
    """Number of lines that match, as grep -c counts them."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern))).cast("bigint")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, f"{WHITE_SPACE}+"), lambda w: w != "")).cast("bigint")


def clean_path(path: Column) -> Column:
    """Shortest equal path: no ``.``, no empty parts, ``..`` resolved where it can be."""
    rooted = path.startswith("/")

    def step(done: Column, part: Column) -> Column:
        can_pop = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return (
            F.when(part.isin("", "."), done)
            .when((part == "..") & can_pop, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when((part == "..") & rooted, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(joined == "", ".").otherwise(joined)
