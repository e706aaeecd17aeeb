"""Duplicate passages by content-defined chunking.

A gear hash rolls over the bytes of a text; a chunk ends where some low bits of the hash are zero, so a boundary depends on
the few bytes before it alone and chunks fall back into step after an insertion. Chunks are compared by digest over the
whole corpus: the document with the smallest id keeps a chunk, in all others it is a duplicate. Neighbouring duplicate
chunks form spans. What the first and last chunk of a passage leave uncovered is found by comparison: a span is extended to
either side as far as its text equals the text around the kept chunk. Spans that then meet are one, and spans of some
length are the repeated passages.

Defined cases: null and empty texts have no chunks; a repeated row is the same document and no duplicate of itself;
rows without a doc_id keep nothing, but are compared; repeats inside one document are left alone; cuts never split a
character; texts of any length are cut as a whole; extra columns are ignored. Texts are told apart by 64 bits when the
surroundings of a span are looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, pinned, utf8

#: Chunks have at least SHORTEST bytes, a boundary in every 2**BITS positions on average, and at most LONGEST bytes.
SHORTEST, BITS, LONGEST = 16, 5, 128
#: The lowest of these bits. A bit of the hash depends on the bytes not further back than its number.
LOWEST_BIT = 11
#: Spans of fewer characters are no repeated passage.
SHORTEST_SPAN = 96
#: Characters beside a span that are compared. Equal texts part from the next boundary on, which is nearer but for odds of
#: one in millions, or for texts of few different bytes.
REACH = 512
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, np.uint32)


def gear_hashes(raw: np.ndarray) -> np.ndarray:
    """The gear hash after every byte: sum of ``GEAR[byte] << distance`` over the last 32 bytes.

    The sum over 2k bytes is that over k bytes plus the shifted one that ends k bytes earlier, so five doublings do.
    """
    total = GEAR[raw]
    for k in (1, 2, 4, 8, 16):
        before = total[:-k] << np.uint32(k)
        total[k:] = total[k:] + before
    return total


def cut_points(text: bytes) -> list[int]:
    """The ends of the chunks of a text, in bytes."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.flatnonzero(gear_hashes(raw) & np.uint32(((1 << BITS) - 1) << LOWEST_BIT) == 0) + 1
    within = (raw & 0xC0) == 0x80  # bytes inside a character
    ends = ends[(ends == len(raw)) | ~within[np.minimum(ends, len(raw) - 1)]]
    cuts, last = [], 0
    for end in [*ends.tolist(), len(raw)]:
        while end - last > LONGEST:
            at = last + LONGEST
            while within[at]:
                at -= 1
            cuts.append(at)
            last = at
        if end - last >= SHORTEST or (end == len(raw) and end > last):
            cuts.append(end)
            last = end
    return cuts


CHUNKS = "doc_id long, _row long, _key long, at int, start int, end int, high long, low long"


def chunks(docs: DataFrame) -> DataFrame:
    """One row per chunk of ``docs(doc_id, text)``: number, code point range, and a 128-bit digest."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        source, at, start, end, digests = [], [], [], [], []

        def made() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(source, pa.int64())
            columns = [*(batch.column(c).take(rows) for c in ("doc_id", "_row", "_key")), pa.array(at, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays([*columns, pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], [f.split()[0] for f in CHUNKS.split(", ")])

        for row, text in enumerate(utf8(batch.column("text"))):
            if not text:
                continue
            cuts = cut_points(text)
            places = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])[[0, *cuts]].tolist()
            digests += [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip([0, *cuts], cuts)]
            source += [row] * len(cuts)
            at += range(len(cuts))
            start += places[:-1]
            end += places[1:]
            if len(at) > 100_000:
                yield made()
                source, at, start, end, digests = [], [], [], [], []
        if at:
            yield made()

    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.xxhash64("text").alias("_key"), "text")
    return over_batches(rows, run, CHUNKS)


def _common(one: str, other: str) -> int:
    """How many characters two texts begin with together."""
    low, high = 0, min(len(one), len(other))
    while low < high:
        middle = (low + high + 1) // 2
        if one[:middle] == other[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _extended(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """``spans`` with ``start`` and ``end`` moved outwards as far as the text equals that around the kept chunks.

    ``own_key`` and ``first``, ``last`` say where a span's text and the kept chunks at its ends stand. Of every text that
    is asked only the stretches beside these places are taken, each once.
    """
    place = lambda which, key, at, right: F.struct(F.lit(which).alias("which"), F.col(key).alias("key"), at.alias("at"), F.lit(right).alias("right"))
    places = F.array(
        place(0, "own_key", F.col("start"), False), place(1, "first.key", F.col("first.start"), False),
        place(2, "own_key", F.col("end"), True), place(3, "last.key", F.col("last.end"), True),
    )
    asked = spans.select("_row", "run", F.explode(places).alias("p")).select("_row", "run", "p.*")
    wanted = asked.groupBy("key").agg(F.collect_set(F.struct("at", "right")).alias("wanted"))
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("key"), "text").dropDuplicates(["key"])
    beside = texts.join(wanted, "key").select("key", "text", F.explode("wanted").alias("w"))
    left = F.substring("text", F.greatest(F.col("w.at") - REACH, F.lit(0)) + 1, F.least("w.at", F.lit(REACH)))
    beside = pinned(beside.select("key", "w.at", "w.right", F.when(F.col("w.right"), F.substring("text", F.col("w.at") + 1, F.lit(REACH))).otherwise(F.reverse(left)).alias("beside")))
    found = asked.join(beside, ["key", "at", "right"]).groupBy("_row", "run")
    sides = found.agg(*[F.max(F.when(F.col("which") == k, F.col("beside"))).alias(f"s{k}") for k in range(4)])

    def compare(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        columns = [batch.column(f"s{k}").to_pylist() for k in range(4)]
        more = [[_common(a, b) for a, b in zip(columns[k], columns[k + 1])] for k in (0, 2)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("run"), *(pa.array(m, pa.int32()) for m in more)], ["_row", "run", "before", "behind"])

    more = over_batches(sides, compare, "_row long, run long, before int, behind int")
    wider = spans.join(more, ["_row", "run"]).withColumns({"start": F.col("start") - F.col("before"), "end": F.col("end") + F.col("behind")})
    # Spans of one text that meet now are one.
    earlier = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    apart = wider.withColumn("_apart", F.coalesce(F.col("start") > F.max("end").over(earlier), F.lit(True)).cast("int"))
    joined = apart.withColumn("_group", F.sum("_apart").over(so_far)).groupBy("_row", "_group")
    return joined.agg(
        F.first("doc_id").alias("doc_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_chunks").alias("n_chunks"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"),
    )


def repeated_spans(docs: DataFrame, shortest: int = SHORTEST_SPAN) -> DataFrame:
    """``(doc_id, start, end, n_chunks, first_doc_ids)``: one row per repeated passage of a document that does not keep it.

    ``start`` and ``end`` are code points; ``first_doc_ids`` are the documents that keep the chunks. Counting sums
    before its shuffle. A chunk that a third of all documents hold meets one row in the join; as the keepers are
    written first, both sides of it are exchanges and adaptive execution can split the chunk's rows.
    """
    pieces = pinned(chunks(docs))
    held = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.col("_key").alias("key"), "start", "end"))
    keeper = pieces.groupBy("high", "low").agg(F.min(held).alias("kept"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and kept is not null")
    again = pieces.join(pinned(keeper.select("high", "low", "kept")), ["high", "low"]).where("doc_id is null or doc_id > kept.doc_id")
    run = F.col("at") - F.row_number().over(Window.partitionBy("_row").orderBy("at"))  # a group is one text
    spans = again.withColumn("run", run.cast("long")).groupBy("_row", "run")
    spans = spans.agg(
        F.first("doc_id").alias("doc_id"), F.first("_key").alias("own_key"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_chunks"), F.array_sort(F.collect_set("kept.doc_id")).alias("first_doc_ids"),
        F.min_by("kept", "at").alias("first"), F.max_by("kept", "at").alias("last"),
    )
    spans = _extended(pinned(spans), docs)
    return spans.where(F.col("end") - F.col("start") >= shortest).select("doc_id", "start", "end", "n_chunks", "first_doc_ids")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the texts of ``spans`` taken out. ``doc_id`` must be unique in ``docs``; other columns stay."""
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    # What lies between the spans: from the end of one to the begin of the next.
    begins = F.concat(F.array(F.lit(0)), F.col("_spans.end"))
    ends = F.concat(F.col("_spans.start"), F.array(F.length("text")))
    kept = F.array_join(F.zip_with(begins, ends, lambda a, b: F.substring(F.col("text"), a + 1, b - a)), "")
    return docs.join(own, "doc_id", "left").withColumn("text", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept)).drop("_spans")
