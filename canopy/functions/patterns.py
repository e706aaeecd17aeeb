"""Path globs, LIKE patterns and slugs as column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _glob_regex(glob: str) -> str:
    pieces = re.split(r"(\*\*/|\*\*|\*|\?|\[[!^]?[^\]/]+\])", glob)
    wild = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return r"\A" + "".join(wild.get(piece) or _class_regex(piece) or re.escape(piece) for piece in pieces) + r"\z"


def _class_regex(piece: str) -> str | None:
    """A bracket class of a glob: ranges stay, ``!`` negates, all else is literal."""
    if not re.fullmatch(r"\[[!^]?[^\]/]+\]", piece):
        return None
    negated = piece[1] in "!^" and len(piece) > 3
    return "[" + ("^/" if negated else "") + re.sub(r"([\\\[&^~])", r"\\\1", piece[1 + negated : -1]) + "]"


def _one_glob(column: Column, glob: str) -> Column:
    fixed = re.split(r"[*?]|\[(?=[^\]/]+\])", glob, maxsplit=1)[0]
    if fixed == glob:
        return column == glob
    if glob in ("**", "**/*"):
        return column.isNotNull()
    matched = column.rlike(_glob_regex(glob))
    # The literal head reaches the Parquet row-group filter; the regex cannot.
    return column.startswith(fixed) & matched if fixed else matched


def path_matches(patterns: str | Iterable[str], path: str = "file_path") -> Column:
    """Path glob, or any of several globs. ``**`` crosses folders, ``*`` does not."""
    globs = [patterns] if isinstance(patterns, str) else list(patterns)
    return reduce(or_, [_one_glob(F.col(path), glob) for glob in globs])


def like(column: Column, pattern: str) -> Column:
    """LIKE where a backslash is an ordinary character."""
    return column.like(pattern.replace("\\", "\\\\"))


def ilike(column: Column, pattern: str) -> Column:
    """Case-insensitive LIKE where a backslash is an ordinary character."""
    return column.ilike(pattern.replace("\\", "\\\\"))


def slug_of(path: Column) -> Column:
    """Base name without ``.md``, lower-cased, spaces as hyphens."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.translate(F.lower(F.regexp_replace(base, r"\.md$", "")), " ", "-")


def is_valid_slug(slug: Column) -> Column:
    """A plain file stem: not empty and without path separators."""
    return F.coalesce((slug != "") & ~slug.rlike(r"[/\\]"), F.lit(False))
