"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

A window is 10 consecutive item words; an item of fewer words is one window. The set of a window are its shingles of 3
words (a shorter window is one shingle). Shingles are ordered by rarity over all documents; as a window must be contained
as a whole, its prefix is one shingle, the rarest. Documents offer only shingles that are some window's prefix, with
their position and the words around. The join on the shingle is filtered by the length bound (the window fits into
the document) and the positional bound (it begins inside), then the words are compared one by one.

Windows are worked off in blocks of bounded size, so what is sent to the tasks does not grow with the benchmark.

Defined cases: a null or empty text has no words; items without words and null texts have no window; repeated items
are one item, items with equal words all count; a document repeated under one id yields one row each; a null
doc_id or item_id stays null (a null item_id counts as a hit but is not listed); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, pinned, utf8

WINDOW = 10
SHINGLE = 3
#: Windows whose words and shingles are sent to the tasks at once.
BLOCK_WINDOWS = 100_000

#: Byte by byte: lower case for A-Z, a space for what separates words.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``(window, words, items)``: the distinct windows, a running number, their words, and the items that have them."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items, windows = [], []
        for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text"))):
            words = [w.decode("utf-8") for w in words_of(text)]
            for at in range(max(len(words) - WINDOW + 1, min(len(words), 1))):
                items.append(item)
                windows.append(words[at : at + WINDOW])
                if len(windows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(windows, pa.list_(pa.string()))], ["item_id", "words"])
                    items, windows = [], []
        if windows:
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(windows, pa.list_(pa.string()))], ["item_id", "words"])

    rows = over_batches(benchmark.select("item_id", "text"), run, "item_id long, words array<string>")
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("items")).withColumn("window", F.monotonically_increasing_id())


class Block:
    """The words and shingles of one block of windows: what tasks need to look at documents."""

    def __init__(self, windows: list[list[str]]):
        vocabulary: dict[bytes, int] = {}
        self.ids = [[vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in words] for words in windows]
        self.vocabulary = vocabulary
        self.base = len(vocabulary) + 1

    def keys(self, ids: np.ndarray, size: int) -> np.ndarray:
        """One number per shingle of ``size`` words that begins in ``ids``; exact, as the ids are dense."""
        n = len(ids) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key = np.zeros(n, np.int64)
        known = np.ones(n, bool)
        for k in range(size):
            part = ids[k : k + n]
            known &= part > 0
            key = key * self.base + part
        return np.where(known, key * 4 + size, -1)

    def text_ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def shingles(self, ids: list[int]) -> np.ndarray:
        return self.keys(np.array(ids, np.int64), min(SHINGLE, len(ids)))


def _among(own: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where ``own`` holds one of the sorted ``keys``. Most entries are -1 and are not looked up."""
    known = np.flatnonzero(own >= 0)
    if not len(keys) or not len(known):
        return known[:0]
    found = own[known]
    return known[keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found]


def _sizes(block: Block) -> list[int]:
    return sorted({min(SHINGLE, len(ids)) for ids in block.ids})


def shingle_counts(docs: DataFrame, block: Block) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents. Bounded by the block, counted over all rows."""
    keys = np.unique(np.concatenate([block.shingles(ids) for ids in block.ids]))
    sizes = _sizes(block)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for text in utf8(batch.column("text")):
            ids = block.text_ids(words_of(text))
            found += [own[_among(own, keys)] for own in (block.keys(ids, size) for size in sizes)]
        key, count = np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["key", "n"])

    rows = over_batches(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {row.key: row.n for row in rows.collect()}


def prefixes(block: Block, counts: dict[int, int]) -> list[tuple[int, int]]:
    """Of each window of the block: its rarest shingle and where that begins in the window."""
    out = []
    for ids in block.ids:
        keys = block.shingles(ids).tolist()
        at = min(range(len(keys)), key=lambda k: (counts.get(keys[k], 0), keys[k], k))
        out.append((keys[at], at))
    return out


ANCHORS = "doc_id long, _row long, n_words long, anchors array<struct<key:bigint,at:int,begin:int,context:array<int>>>"
_ANCHOR = pa.list_(pa.struct([("key", pa.int64()), ("at", pa.int32()), ("begin", pa.int32()), ("context", pa.list_(pa.int32()))]))


def document_anchors(docs: DataFrame, block: Block, prefix_keys: np.ndarray) -> DataFrame:
    """One row per document with its prefix shingles: key, position, and the word ids up to a window's length around."""
    sizes = _sizes(block)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts, anchors = [], []
        for text in utf8(batch.column("text")):
            ids = block.text_ids(words_of(text))
            own = []
            for size in sizes:
                keys = block.keys(ids, size)
                for at in _among(keys, prefix_keys).tolist():
                    begin = max(0, at - WINDOW + 1)
                    own.append({"key": int(keys[at]), "at": at, "begin": begin, "context": ids[begin : at + WINDOW].astype(np.int32)})
            counts.append(len(ids))
            anchors.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("_row"), pa.array(counts, pa.int64()), pa.array(anchors, _ANCHOR)],
            ["doc_id", "_row", "n_words", "anchors"],
        )

    return over_batches(docs.select("doc_id", "_row", "text"), run, ANCHORS)


def _hits(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """``(_row, start, size, items)`` for each place where a window occurs.

    ``windows(key, offset, ids, items)`` is a block. A shingle that a third of all documents hold is a hot key of the
    documents only, so adaptive execution can split it or send the block.
    """
    anchors = documents.select("_row", "n_words", F.explode("anchors").alias("a")).select("_row", "n_words", "a.*")
    joined = anchors.join(windows, "key")
    start = F.col("at") - F.col("offset")
    size = F.size("ids")
    joined = joined.where((start >= 0) & (start + size <= F.col("n_words")))
    joined = joined.where(F.slice("context", start - F.col("begin") + 1, size) == F.col("ids"))
    return joined.select("_row", start.alias("start"), size.alias("size"), "items")


def _window_table(spark: SparkSession, chosen: list[tuple[int, int]], ids: list[list[int]], items: list[list[int]]) -> DataFrame:
    """``(key, offset, ids, items)`` of a block's windows. Arrow takes it to the JVM without Python workers in the executors."""
    keys, offsets = zip(*chosen) if chosen else ((), ())
    columns = [pa.array(keys, pa.int64()), pa.array(offsets, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))]
    return spark.createDataFrame(pa.table(columns, ["key", "offset", "ids", "items"]), "key long, offset int, ids array<int>, items array<bigint>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_words, n_hit, n_items, items (sorted as strings), contaminated."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    windows = pinned(item_windows(benchmark))
    n_blocks = max(1, -(-windows.count() // block_windows))
    per_doc, hits = None, []
    for number in range(n_blocks):
        rows = windows.where(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == number).orderBy("words").collect()
        block = Block([row.words for row in rows])
        counts = shingle_counts(docs, block) if rows else {}
        chosen = prefixes(block, counts)
        part = _window_table(spark, chosen, block.ids, [row.items for row in rows])
        anchors = pinned(document_anchors(docs, block, np.array(sorted({key for key, _ in chosen}), np.int64)))
        per_doc = per_doc or anchors.select("doc_id", "_row", "n_words")
        hits.append(_hits(anchors, part))
    found = hits[0]
    for more in hits[1:]:
        found = found.union(more)
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))))
    found = found.groupBy("_row").agg(
        F.collect_set(F.struct("start", "size")).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )  # a group is bounded by the windows of one text
    found = found.select("_row", F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.col("items").cast("array<string>")).alias("items"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return per_doc.join(found, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
