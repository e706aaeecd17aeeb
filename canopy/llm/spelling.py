"""Spelling variants: words one edit apart, found by a bidirectional FM-index search scheme over the delimited vocabulary.

If two words are one inserted, deleted or replaced character apart, the one half of a word or the other stands untouched in
both. So a search matches one half exactly and goes on over the other half with one error: first half first and then
to the right, or last half first and then to the left. A match is always an interval of ranks in the sorted suffixes, and
one more character on either side of it narrows the interval by two rank queries.

The vocabulary grows with the corpus, so the index is kept in shards. For searches to the right the words are sorted, for
those to the left the reversed words are, and each shard is a range of that order: an FM-index of a bounded number of
words, whatever begins they have in common. Words with the same untouched half stand next to each other, so a search goes to
the one or few shards that its half reaches into. Searches of one shard are cut into blocks of bounded size. Each direction
counts near words of its own only: those to the right share the first half, those to the left don't.

Defined cases: null and empty texts have no words; a null doc_id plants misspellings like an empty string; repeated rows
count as often as they occur; texts of any length are read whole; a word without near words has 0 of them, no form and is
its own root; an empty vocabulary gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, pinned, prepare, utf8

#: Code points and occurrences that make a word.
SHORTEST, LEAST = 7, 2
#: A form occurs at least so many times as often as its variant.
OUTNUMBERS = 10
#: Words of one shard, and searches that one task takes on.
SHARD_WORDS, SEARCHES = 20_000, 40_000
#: Searches that go on together, and the width from which an interval is asked by character, not by member.
_TOGETHER, _WIDE = 4096, 12
_RUN = re.compile("[a-zÀ-ÿ]+")


# --- the vocabulary ---


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, misspell: bool = False) -> DataFrame:
    """``(word, n)``: the words of ``docs(doc_id, text)`` of at least ``shortest`` code points and ``least`` occurrences.

    A word is a run of letters A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z. ``misspell`` leaves a character out of
    about every 31st pair of document and word. Each batch sums its words before the shuffle.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            if not text:
                continue
            own = Counter(_RUN.findall(text.lower().decode()))  # on bytes lower() knows A-Z only
            head = zlib.crc32(b"%s:" % ("" if doc_id is None else str(doc_id)).encode())
            for word, n in own.items():
                if len(word) < shortest:
                    continue
                if misspell and (h := zlib.crc32(word.encode(), head)) % 31 == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < shortest:
                        continue
                total[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    words = over_batches(docs.select("doc_id", "text"), run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


# --- the index of one shard ---


class Index:
    """One direction of the FM-index: distinct words, each read from its first character on.

    The indexed text is every word backwards behind a delimiter, as a ring. ``step`` turns the bound of an interval into
    that of the matches that have one character more.
    """

    def __init__(self, words: list[str]):
        text = "".join("\0" + word[::-1] for word in words)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        n = self.size = len(codes)
        # Rotations sorted by twice as many characters in each round.
        rank, known, width = codes.astype(np.int64), 0, 1
        while known < n:
            if width > 2 * n:
                raise ValueError("words of an index must be distinct")
            values, rank = np.unique(rank * n + np.roll(rank, -width), return_inverse=True)
            known, width = len(values), 2 * width
        place = np.empty(n, np.int64)
        place[rank] = np.arange(n)
        self.before = codes[place - 1].astype(np.int64)  # the transform: what stands before each rotation
        self.ranks = np.sort(self.before * n + np.arange(n))
        self.n_words = len(words)
        self.word_at = np.searchsorted(np.flatnonzero(codes == 0), place[: len(words)])

    def step(self, code: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ranks, code * self.size + bound)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of codes per word, with delimiters behind it and -1 for characters of no indexed word; the lengths."""
        sizes = np.array([len(word) for word in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        out = np.zeros((len(words), int(sizes.max(initial=0)) + 2), np.int64)
        out[np.arange(out.shape[1]) < sizes[:, None]] = np.where(self.alphabet[at] == points, at, -1)
        return out, sizes

    def extensions(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """What can follow matches: ``(which, code, low, high)``, sorted by ``which``, the interval's number."""
        wide = np.flatnonzero(high - low > _WIDE)
        code = np.arange(1, len(self.alphabet))
        lows, highs = (self.step(code, bound[wide, None]) for bound in (low, high))
        row, column = np.nonzero(highs > lows)
        parts = [(wide[row], code[column], lows[row, column], highs[row, column])]
        narrow = np.flatnonzero(high - low <= _WIDE)
        widths = (high - low)[narrow]
        member = np.arange(widths.sum()) - np.repeat(np.cumsum(widths) - widths, widths) + np.repeat(low[narrow], widths)
        which, own = np.repeat(narrow, widths), self.before[member]
        inside = own > 0
        at = self.step(own[inside], member[inside])
        parts.append((which[inside], own[inside], at, at + 1))
        which, *rest = (np.concatenate(columns) for columns in zip(*parts))
        order = np.argsort(which, kind="stable")
        return which[order], *(column[order] for column in rest)

    def _finish(self, query: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(row, word)`` of matches that go on without an error to the delimiter."""
        while len(row):
            code = query[row, at]
            low, high = self.step(code, low), self.step(code, high)
            ended = (code == 0) & (high > low)
            yield row[ended], self.word_at[low[ended]]
            on = (code != 0) & (high > low)
            row, low, high, at = row[on], low[on], high[on], at[on] + 1

    def one_edit(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, indexed word) one edit apart, the first ``exact`` characters of each word untouched.

        Each pair comes once: of equal neighbouring characters the last is the one inserted or deleted.
        """
        found = [(np.zeros(0, np.int64),) * 2]
        for begin in range(0, len(words), _TOGETHER):
            query, sizes = self.codes(words[begin : begin + _TOGETHER])
            begins = exact[begin : begin + _TOGETHER]
            row = np.arange(len(sizes))
            low, high = np.zeros(len(row), np.int64), np.full(len(row), self.n_words)
            for t in range(query.shape[1] - 1):
                if not len(row):
                    break
                own = np.flatnonzero(begins[row] <= t)
                if len(own):
                    r, a, b = row[own], low[own], high[own]
                    here, inner = query[r, t], t < sizes[r]
                    gone = inner & (here != query[r, t + 1])
                    keys, which = np.unique(a * (self.size + 1) + b, return_inverse=True)
                    part, code, lows, highs = self.extensions(keys // (self.size + 1), keys % (self.size + 1))
                    first = np.searchsorted(part, np.arange(len(keys) + 1))
                    counts = np.diff(first)[which]
                    source = np.repeat(np.arange(len(r)), counts)
                    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[which], counts)
                    other = code[at] != here[source]
                    source, at = source[other], at[other]
                    swap = inner[source]
                    tries = (
                        (r[gone], a[gone], b[gone], t + 1),
                        (r[source[swap]], lows[at[swap]], highs[at[swap]], t + 1),
                        (r[source], lows[at], highs[at], t),
                    )
                    for rows, lo, hi, go_on in tries:
                        found += [(begin + x, y) for x, y in self._finish(query, rows, lo, hi, np.full(len(rows), go_on))]
                code = query[row, t]
                low, high = self.step(code, low), self.step(code, high)
                on = (high > low) & (code != 0)
                row, low, high = row[on], low[on], high[on]
        return tuple(np.concatenate(column) for column in zip(*found))


def _untouched(word: str, forward: bool) -> int:
    """How many characters of a word, as it is read, a search of this direction matches without an error."""
    return len(word) // 2 if forward else len(word) - len(word) // 2


def search(forward: bool, words: list[str], n: list[int], asked: list[str]) -> pa.Table:
    """``(word, n_near, form, form_n)`` of the ``asked`` words with near ones among ``words``, all as read in a direction."""
    exact = np.array([_untouched(word, forward) for word in asked], np.int64)
    row, near = Index(words).one_edit(asked, exact) if words else (np.zeros(0, np.int64),) * 2
    if not forward:
        # What shares the first half as well has been found to the right.
        own = [not words[y].endswith(asked[x][exact[x] :]) for x, y in zip(row.tolist(), near.tolist())]
        row, near = row[own], near[own]
    written = words if forward else [word[::-1] for word in words]
    order = np.empty(len(words), np.int64)
    order[sorted(range(len(words)), key=written.__getitem__)] = np.arange(len(words))
    times = np.array(n, np.int64)
    best = np.lexsort((order[near], -times[near], row))
    row, near = row[best], near[best]
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else row
    counts = np.diff(np.append(first, len(row)))
    chosen = near[first].tolist()
    names = [asked[x] if forward else asked[x][::-1] for x in row[first].tolist()]
    columns = [pa.array(names, pa.string()), pa.array(counts, pa.int64()), pa.array([written[y] for y in chosen], pa.string()), pa.array(times[near[first]], pa.int64())]
    return pa.table(columns, ["word", "n_near", "form", "form_n"])


# --- searches in shards ---


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, searches: int = SEARCHES) -> DataFrame:
    """``(word, n_near, form, form_n)`` of the words with near ones: their number, and the most frequent of them.

    ``words(word, n)`` has one row per word and is read more than once, so it should be a written table. On ties ``form``
    is the smallest in code-point order. The driver holds the first word of each shard and direction.
    """
    spark = words.sparkSession
    prepare(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words.count() // shard_words))
    shards, bounds = {}, {}
    for forward, read in ((True, F.col("word")), (False, F.reverse("word"))):
        dealt = words.select(read.alias("read"), "n").repartitionByRange(parts, "read")
        shards[forward] = pinned(dealt.select(F.lit(forward).alias("forward"), F.spark_partition_id().alias("shard"), "read", "n"))
        heads = shards[forward].groupBy("shard").agg(F.min("read").alias("least")).orderBy("least").collect()
        bounds[forward] = ([row.least for row in heads], [row.shard for row in heads])

    def route(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = []
        for word in batch.column("word").to_pylist():
            for forward, (least, names) in bounds.items():
                read = word if forward else word[::-1]
                half = read[: _untouched(word, forward)]
                first, last = max(bisect_right(least, half) - 1, 0), bisect_left(least, half + "\U0010ffff")
                found += [(forward, name, read) for name in names[first:last]]
        kinds = (pa.bool_(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], ["forward", "shard", "read"])

    asked = pinned(over_batches(words.select("word"), route, "forward boolean, shard int, read string"))
    blocks = asked.groupBy("forward", "shard").agg(F.ceil(F.count(F.lit(1)) / searches).alias("blocks"))
    asked = asked.join(blocks, ["forward", "shard"]).select("forward", "shard", F.pmod(F.xxhash64("read"), "blocks").alias("block"), "read", F.lit(None).cast("long").alias("n"))
    indexed = shards[True].union(shards[False]).join(blocks, ["forward", "shard"])
    indexed = indexed.select("forward", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "read", "n")

    def task(group: pa.Table) -> pa.Table:
        reads, n = group.column("read").to_pylist(), group.column("n").to_pylist()
        own = [(read, k) for read, k in zip(reads, n) if k is not None]
        return search(group.column("forward")[0].as_py(), [r for r, _ in own], [k for _, k in own], [r for r, k in zip(reads, n) if k is None])

    # A number of partitions of its own: few bytes here are much work, and partitions must not be put together by bytes.
    tasks = indexed.union(asked).repartition(2 * parts, "forward", "shard", "block")
    found = tasks.groupBy("forward", "shard", "block").applyInArrow(task, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for links ``forms(word, form)`` without cycles: the last word that the links lead to.

    Each round doubles the way, so the few links of a chain of growing counts take a few rounds.
    """
    found = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = pinned(found.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        found = longer.select("word", "root")
        if not longer.where("_moved").limit(1).count():
            return found


def variants(words: DataFrame, outnumbers: int = OUTNUMBERS, shard_words: int = SHARD_WORDS, searches: int = SEARCHES) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` per row of a written table ``words(word, n)``.

    The form of a word is its most frequent near word, if that occurs ``outnumbers`` times as often; the root is where the
    forms lead. Every link multiplies the count, so they can't go round.
    """
    if outnumbers < 2:
        raise ValueError("a form must outnumber its variants")
    near = words.join(near_words(words, shard_words, searches), "word", "left")
    has = F.col("form_n") >= outnumbers * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    near = pinned(near)
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
