"""Scans over text corpora, artifact assembly, and back-links into documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.functions.patterns import is_valid_slug
from canopy.functions.text import clean_path, matching_lines, trimmed, word_count
from canopy.session import written


def count_matching_lines(files: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, hits) of the files with at least one matching line."""
    return files.select(key, matching_lines(F.col(text), pattern).alias("hits")).where("hits > 0")


def total_matching_lines(files: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """One row: files with a match and matching lines in all."""
    hits = count_matching_lines(files, key, text, pattern)
    return hits.agg(F.count("*").alias("files"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))


def count_marked_files(files: DataFrame, text: str, markers: dict[str, str]) -> DataFrame:
    """One row: for each marker (column -> pattern), the number of files that hold it."""
    return files.agg(*[F.count_if(F.col(text).rlike(pattern)).alias(name) for name, pattern in markers.items()])


def banned_terms(texts: DataFrame, group: str, text: str, terms: Sequence[tuple[str, str]]) -> DataFrame:
    """Banned terms per group with their replacement and the number of texts that use them."""
    table = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(r).alias("replacement")) for t, r in terms])
    used = F.filter(table, lambda t: F.contains(F.col(text), t["term"]))
    return (
        texts.select(group, F.explode(used).alias("t"))
        .groupBy(group, F.col("t.term").alias("term"), F.col("t.replacement").alias("replacement"))
        .agg(F.count("*").alias("texts"))
    )


#: Characters of a gram that terms are looked up by. With 4, most texts that hold the gram of a term do not hold the term.
GRAM = 6


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text, cut from its characters in one pass."""

    def runs(signs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(signs) - size + 1, F.lit(1)))
        return F.when(F.size(signs) >= size, F.array_distinct(F.transform(starts, lambda at: F.array_join(F.slice(signs, at, size), ""))))

    # As an argument of a lambda the characters are taken apart once, not once for every run.
    each = F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), runs)[0]
    return F.coalesce(each, F.array().cast("array<string>"))


def banned_terms_of(texts: DataFrame, group: str, text: str, terms: DataFrame) -> DataFrame:
    """``banned_terms`` with the terms from a table (term, replacement) of any size.

    Each term is looked up by one of its grams, the one that the fewest texts have; a term with a gram that no text has
    is never looked up. Texts and terms meet by equal grams, and only these pairs are searched for the whole term. Terms
    shorter than a gram are a gram of their own length. Empty and NULL terms are none; a term listed twice counts once.
    """
    rows = texts.select(F.col(group).alias("_group"), F.col(text).alias("_text")).where("_text is not null")
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()))
    listed = written(terms.select("term", "replacement").where("term <> ''").distinct().withColumn("_size", F.least(F.length("term"), F.lit(GRAM))))
    sizes = sorted(row[0] for row in listed.select("_size").distinct().collect())  # at most GRAM of them
    if not sizes:
        return rows.select(F.col("_group").alias(group), F.lit("").alias("term"), F.lit("").alias("replacement"), F.lit(0).cast("bigint").alias("texts")).limit(0)
    keys = reduce(DataFrame.unionByName, [listed.where(F.col("_size") == k).select("term", "replacement", F.explode(_grams(F.col("term"), k)).alias("gram")) for k in sizes])
    found = rows.select("_row", F.explode(F.concat(*[_grams(F.col("_text"), k) for k in sizes])).alias("gram"))
    hits = written(found.join(keys.select("gram").distinct(), "gram", "left_semi"))
    # A gram that no text has counts 0 and is the rarest.
    counts = hits.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = keys.join(counts, "gram", "left").groupBy("term", "replacement").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
    lookups = written(rarest.where("key.n > 0").select("term", "replacement", F.col("key.gram").alias("gram")))
    pairs = hits.join(lookups, "gram").select("_row", "term", "replacement")
    used = pairs.join(rows, "_row").where(F.contains("_text", F.col("term")))
    return used.groupBy(F.col("_group").alias(group), "term", "replacement").agg(F.count("*").alias("texts"))


# The fields an artifact must fill, in the order they are checked.
REQUIRED_FIELDS = ("title", "source", "summary", "api_surface", "constraints", "anti_patterns")


def _is_blank(column: Column) -> Column:
    return F.coalesce(trimmed(column) == "", F.lit(True))


def validate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Add ``error``: NULL for a valid artifact, else the first problem found."""
    error = F.when(~is_valid_slug(F.col("slug")), F.lit("invalid slug"))
    for name in REQUIRED_FIELDS:
        error = error.when(_is_blank(F.col(name)), F.lit(f'required field "{name}" is empty'))
    escaping = F.exists("referenced_by", lambda path: F.contains(clean_path(path), F.lit("..")))
    return artifacts.withColumn("error", error.when(escaping, F.lit("invalid referenced_by path")))


def _link(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.concat(F.lit("["), F.regexp_replace(base, r"\.md$", ""), F.lit("](../tasks/"), base, F.lit(")"))


# The layout of an artifact document.
def assemble_artifacts(artifacts: DataFrame, date: Column, produced_by: str) -> DataFrame:
    """Valid artifacts with path, links, document text and its word count."""
    lit, col = F.lit, F.col
    links = F.array_join(F.transform("referenced_by", _link), ", ")
    sections = [
        ("Summary", "summary"), ("API Surface / Key Facts", "api_surface"),
        ("Constraints", "constraints"), ("Anti-Patterns", "anti_patterns"),
    ]
    head = F.concat(
        lit("# Artifact: "), col("title"), lit("\n\n**Primary Source:** "), col("source"), lit("\n**Date:** "), date,
        lit(f"\n**Produced by:** {produced_by}\n**Referenced by:** "), col("links"), lit("\n\n---\n"),
    )
    body = [F.concat(lit(f"\n## {title}\n"), col(name), lit("\n")) for title, name in sections]
    examples = F.when(
        ~_is_blank(col("minimal_examples")), F.concat(lit("\n## Minimal Examples\n"), col("minimal_examples"), lit("\n"))
    ).otherwise("")
    valid = validate_artifacts(artifacts).where("error is null").withColumn("links", links)
    written = valid.withColumn("content", reduce(F.concat, [head, *body, examples]))
    path = F.concat(lit("docs/artifacts/"), date, lit("-"), col("slug"), lit(".md"))
    return written.select("slug", path.alias("path"), "links", "content", word_count(col("content")).alias("word_count"))


# The line that links a document to an artifact, and a pattern for it.
def _marker(artifact: Column) -> Column:
    return F.concat(F.lit("> **Prerequisite:** Read `"), artifact, F.lit("`"))


LINKED = r"> \*\*Prerequisite:\*\* Read `([^`]*)`"


def link_outcomes(
    links: DataFrame, documents: DataFrame, artifact: str, task: str, text: str, title_mark: str = "# "
) -> DataFrame:
    """What adding each link (artifact, task) to its document does.

    Outcome: injected, already_present, not_found, or malformed (the document
    does not begin with a title line). Repeated links count once. Only the
    links a text holds go into the join, not the text. Artifact paths hold no
    backtick.
    """
    wanted = links.select(artifact, task).distinct()
    held = F.regexp_extract_all(text, F.lit(LINKED), F.lit(1))
    known = documents.select(task, held.alias("_held"), F.col(text).startswith(title_mark).alias("_titled"))
    looked_up = wanted.join(known, task, "left")
    outcome = (
        F.when(F.col("_titled").isNull(), "not_found")
        .when(F.array_contains("_held", F.col(artifact)), "already_present")
        .when(~F.col("_titled"), "malformed")
        .otherwise("injected")
    )
    return looked_up.select(task, artifact, outcome.alias("outcome"))


def inject_links(
    links: DataFrame, documents: DataFrame, artifact: str, task: str, text: str, title_mark: str = "# "
) -> DataFrame:
    """Documents (task, text) with the missing links put below the title; running it again changes nothing."""
    block = F.concat(F.lit("\n"), _marker(F.col(artifact)), F.lit(" before writing any code in this phase."))
    added = (
        link_outcomes(links, documents, artifact, task, text, title_mark)
        .where("outcome = 'injected'")
        .groupBy(task)
        .agg(F.array_join(F.array_sort(F.collect_list(block)), "").alias("_blocks"))
    )
    title = F.substring_index(F.col(text), "\n", 1)
    rest = F.expr(f"substring({text}, length(substring_index({text}, '\\n', 1)) + 2)")
    return documents.join(added, task, "left").select(
        *[c for c in documents.columns if c != text],
        F.when(F.col("_blocks").isNull(), F.col(text))
        .otherwise(F.concat(title, F.col("_blocks"), F.lit("\n"), rest))
        .alias(text),
    )
