"""Periodic runs: stretches of words that repeat with a period, found online over sparse diagonals.

Words are taken one by one. An earlier occurrence of the word, ``q`` words back, is a match on the diagonal of lag ``q``.
A diagonal with matches is active and has a match length; the next word adds one or ends it, and a diagonal that ends with
enough matches emits its run at once. What keeps the diagonals sparse, without losing a run:

* A run of period ``q`` and exponent 4 or more has ``2 q`` neighbouring places at which the word also stands ``q`` and
  ``2 q`` back. One of them is a multiple of a power of two above ``q``. So a place ``i`` opens diagonals only for lags
  below the largest power of two that divides ``i``, and only where both words agree: ``n log n`` tries in all.
  The matches before that place are found by walking back.
* While a diagonal of lag ``p`` holds all words from ``i - q`` to ``i``, and ``p`` divides ``q``, lag ``q`` can't outlive it
  and ends with the same run. It is not opened, so each run comes out once, with its smallest period.

Defined cases: null, empty and wordless texts have no words and no runs, and collapse to an empty text; texts of any
length are searched whole; repeated rows and null ids stay (a null doc_id never plants a run); extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, utf8

#: A run has at least SHORTEST words and EXPONENT periods. The places tried suffice for exponents from 4 on.
SHORTEST, EXPONENT = 6, 4
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])


def earlier(ids: np.ndarray) -> np.ndarray:
    """For each word the place of its last earlier occurrence, or -1."""
    order = np.argsort(ids, kind="stable")
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out = np.full(len(ids), -1, np.int64)
    out[order[again + 1]] = order[again]
    return out


def runs(ids: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """The runs ``(start, length, period)`` of a sequence of word numbers, by start, then period."""
    if exponent < EXPONENT:
        raise ValueError("places are tried for runs of at least 4 periods")
    n = len(ids)
    before = earlier(ids)
    place = np.arange(n)
    # Where a diagonal may open: the nearest earlier occurrence is close enough.
    opens = (before >= 0) & (place - before < (place & -place))
    words, back = ids.tolist(), before.tolist()
    found = []
    matches: dict[int, int] = {}  # of the active diagonals: lag -> match length up to this word

    def emit(lag: int, end: int) -> None:
        length = matches.pop(lag) + lag
        if length >= max(shortest, exponent * lag):
            found.append((end - length, length, lag))

    reached = 0
    for first in np.flatnonzero(opens).tolist():
        i = max(first, reached)
        if i > first:
            continue  # taken while a diagonal was active
        while i < n:
            word = words[i]
            for lag in list(matches):
                if word == words[i - lag]:
                    matches[lag] += 1
                else:
                    emit(lag, i)
            if opens[i]:
                reach, j = i & -i, back[i]
                while j >= 0 and i - j < reach:
                    lag = i - j
                    if lag <= j and words[j - lag] == word and lag not in matches:
                        if not any(lag % p == 0 and m + p > lag for p, m in matches.items()):
                            k = i - 1
                            while k >= lag and words[k] == words[k - lag]:
                                k -= 1
                            matches[lag] = i - k
                    j = back[j]
            i += 1
            if not matches:
                break
        reached = i
    for lag in list(matches):
        emit(lag, n)
    return sorted(found, key=lambda run: (run[0], run[2]))


def planted(words: list, doc_id: int | None) -> list:
    """The words, in every tenth document (by the CRC of its id) with a period put in from some word on."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    return words[:begin] + [words[begin + k % period] for k in range(n - begin)]


def find_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT, plant: bool = False) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)`` per row of ``docs(doc_id, text)``.

    ``runs`` are sorted by start, then period. ``collapsed`` is the text, words joined by one space, of which every run
    keeps only its first period. A word is what white space of ASCII parts. ``plant`` puts periods into every tenth
    document first. A document is one row of the input, so it is searched in the task that reads it; nothing is shuffled.
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes, found, texts = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            words = text.split() if text else []  # bytes.split() knows the white space 20, 09-0D only
            if plant:
                words = planted(words, doc_id)
            numbers = defaultdict(count().__next__)
            own = runs(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), shortest, exponent)
            if own:
                keep = np.ones(len(words), bool)
                for start, length, period in own:
                    keep[start + period : start + length] = False
                texts.append(b" ".join(compress(words, keep.tolist())))
            else:
                texts.append(b" ".join(words))
            sizes.append(len(words))
            found.append([{"start": s, "length": m, "period": p} for s, m, p in own])
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(_RUN)), pa.array(texts, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return over_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, RUNS)


def strongest(own: Column) -> Column:
    """Of ``runs`` the one with the greatest exact length / period, then the smallest start, then period; null for none."""
    # The runs come by start and period, so only a greater ratio replaces the one held.
    better = lambda held, run: held.isNull() | (run["length"] * held["period"] > held["length"] * run["period"])
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(own, none, lambda held, run: F.when(better(held, run), run).otherwise(held))


def digests(found: DataFrame) -> DataFrame:
    """Per row of ``find_runs``: the number of runs, the strongest one, and digests of the runs and of the collapsed text."""
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    lines = F.array_join(F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))), "")
    rows = found.withColumn("_best", strongest(F.col("runs")))
    best = [F.col(f"_best.{name}").alias(name) for name in ("start", "length", "period")]
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *best,
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
