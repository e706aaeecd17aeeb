"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses. Built-in functions only.

A text is cut, without losing a character, into sections (ended by a blank line), paragraphs (ended by a line break)
and clauses (ended by a sign other than a comma and white space, or after 40 characters). A leaf is the SHA-256 of a clause; each node above is
the SHA-256 of its children's digests. The fingerprint is one string::

    <root, 64 hex>/<section, 16 hex>;<paragraph, 12 hex>.<leaf, 8 hex>.<leaf>...;<paragraph>...

Equal roots mean equal texts; where roots differ, the branches with differing digests locate the edits.

Defined cases: a null text counts as empty; an empty text has one empty section and no leaf; two fingerprints without
leaves have the likeness 1; documents with equal ids follow each other by text; a null id sorts first; a single document
is its own successor; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import prepare

SECTION_END, PARAGRAPH_END, CLAUSE_END = r"(?<=\n\n)(?!\n)", r"(?<=\n)(?!\n)", r"(?s)(?<=[^\p{L}\p{N}\s,]\s)(?=\S)|(?<=\G.{40})"


def _sha(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.split(text, pattern, -1), lambda piece: piece != "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside a lambda Spark evaluates every mention of an expression."""
    return F.transform(F.array(value), use)[0]


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text."""
    # Each level yields the digest of a node followed by the printed form of its children.
    def paragraph(piece):
        leaves = F.transform(_pieces(piece, CLAUSE_END), _sha)
        return _once(leaves, lambda own: F.concat(_sha(F.array_join(own, "")), F.lit("."), F.array_join(F.transform(own, lambda d: F.substring(d, 1, 8)), ".")))

    def section(piece):
        def node(own):
            digest = _sha(F.array_join(F.transform(own, lambda n: F.substring(n, 1, 64)), ""))
            printed = F.transform(own, lambda n: F.concat(F.substring(n, 1, 12), F.substring(n, 65, 1 << 30)))
            return F.concat(digest, F.lit(";"), F.array_join(printed, ";"))

        return _once(F.transform(_pieces(piece, PARAGRAPH_END), paragraph), node)

    def whole(own):
        root_ = _sha(F.array_join(F.transform(own, lambda s: F.substring(s, 1, 64)), ""))
        printed = F.transform(own, lambda s: F.concat(F.substring(s, 1, 16), F.substring(s, 65, 1 << 30)))
        return F.concat(root_, F.lit("/"), F.array_join(printed, "/"))

    return _once(F.transform(_pieces(F.coalesce(text, F.lit("")), SECTION_END), section), whole)


def root(print_: Column) -> Column:
    return F.substring(print_, 1, 64)


def leaves(print_: Column) -> Column:
    """The leaf digests in text order."""
    return F.regexp_extract_all(print_, F.lit(r"\.([0-9a-f]{8})"), 1)


def paragraphs(print_: Column) -> Column:
    """The paragraph digests in text order."""
    return F.regexp_extract_all(print_, F.lit(r";([0-9a-f]{12})"), 1)


def likeness(one: Column, other: Column) -> Column:
    """Share of common leaves, 2 |A and B| / (|A| + |B|) over distinct leaves; 1 for equal roots."""
    a, b = F.array_distinct(leaves(one)), F.array_distinct(leaves(other))
    share = 2.0 * F.size(F.array_intersect(a, b)) / F.greatest(F.size(a) + F.size(b), F.lit(1))
    return F.when(root(one) == root(other), F.lit(1.0)).otherwise(share)


def edited_paragraphs(one: Column, other: Column) -> Column:
    """Positions, from 0, of the paragraphs of ``one`` that ``other`` has nowhere: where ``one`` was edited."""
    theirs, mine = paragraphs(other), paragraphs(one)
    at = F.transform(mine, lambda digest, k: F.when(~F.array_contains(theirs, digest), k))
    return F.when(root(one) == root(other), F.array().cast("array<int>")).otherwise(F.array_compact(at))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above ``value``: first among every k-th bound, then among the next k."""
    k = max(1, round(len(bounds) ** 0.5))
    pieces = [bounds[at : at + k] for at in range(0, len(bounds), k)]
    numbers = lambda values: F.array(*(F.lit(b) for b in values)).cast("array<bigint>")
    below = lambda values: F.size(F.filter(values, lambda b: b <= value))
    if not bounds:
        return F.lit(0)
    piece = below(numbers(p[0] for p in pieces))
    inside = F.array(*(numbers(p) for p in pieces))[F.greatest(piece - 1, F.lit(0))]
    return F.when(piece == 0, 0).otherwise((piece - 1) * k + below(inside))


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Every row with a struct ``next`` of ``columns`` from the row that follows by ``key`` (and ``columns`` on ties).

    The last row is followed by the first. Rows are dealt into ranges of the key, with bounds from approximate quantiles
    (4 per shuffle partition, so one short list on the driver); windows run inside a range, and the heads of the ranges,
    one row each, close the gaps.
    """
    spark = docs.sparkSession
    prepare(spark)
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    dealt = docs.withColumn("_range", F.when(F.col(key).isNull(), F.lit(0)).otherwise(_range_of(F.col(key), sorted(set(found or [])))))
    value = F.struct(*columns)  # only for the heads: beside the columns it would double what the window's exchange carries
    order = Window.partitionBy("_range").orderBy(F.col(key), *(F.col(c) for c in columns))
    rows = dealt.withColumns({f"_next_{c}": F.lead(c).over(order) for c in columns} | {"_has_next": F.lead(F.lit(True)).over(order)})
    # The head of a range: its rows with the smallest key, of which there are few, then the smallest by columns.
    least = dealt.groupBy("_range").agg(F.min(key).alias("_least"), F.max(F.col(key).isNull()).alias("_none"))
    least = least.select(F.col("_range").alias("_r"), F.when(~F.col("_none"), F.col("_least")).alias("_least"))
    heads = dealt.join(F.broadcast(least), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_least"))).groupBy("_range").agg(F.min(value).alias("_head"))
    # One row per range, so one task may order them.
    circle = Window.orderBy("_range")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = heads.select("_range", F.coalesce(F.lead("_head").over(circle), F.first("_head").over(whole)).alias("_head"))
    # The window has dealt the rows by range already, so this join adds no exchange of texts.
    near = F.struct(*(F.col(f"_next_{c}").alias(c) for c in columns))
    return rows.join(follows, "_range").withColumn("next", F.when(F.col("_has_next"), near).otherwise(F.col("_head"))).drop("_range", "_head", "_has_next", *(f"_next_{c}" for c in columns))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)``, of each text with its last half replaced by the next one's begin, and
    the likeness of a text to its edited form and to the next text."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    rows = with_next(rows, "doc_id", ["text", "fingerprint"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("next_print"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"),
    )
