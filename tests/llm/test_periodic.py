"""Periodic runs against brute force over all lags, and the digests against the contract's wording."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from canopy.llm import periodic


def has_period(words, start, end, q):
    return all(words[k] == words[k - q] for k in range(start + q, end))


def brute(words, shortest=6, exponent=4):
    """Every stretch with a smallest period that no neighbour extends."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(shortest, exponent * q) and (start == 0 or words[start - 1] != words[start - 1 + q]):
                if not any(has_period(words, start, end, p) for p in range(1, q)):
                    found.append((start, end - start, q))
            start += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def sequences():
    rng = random.Random(12)
    for size in (0, 1, 2, 5, 6, 7, 30):
        yield [0] * size
    for letters in (1, 2, 3, 5):
        for _ in range(150):
            yield [rng.randrange(letters) for _ in range(rng.randrange(60))]
    for _ in range(250):  # periods within periods, broken here and there
        inner = [rng.randrange(3) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 7)
        own = (inner + [rng.randrange(4)] * rng.randrange(3)) * rng.randrange(1, 8)
        own = [rng.randrange(3) for _ in range(rng.randrange(6))] + own + [rng.randrange(3) for _ in range(rng.randrange(6))]
        if own and rng.random() < 0.5:
            own[rng.randrange(len(own))] = 9
        yield own[:160]


def test_runs_equal_brute_force():
    total = 0
    for words in sequences():
        got = periodic.runs(np.array(words, np.int64))
        assert got == brute(words), words
        total += len(got)
    assert total > 300


@pytest.mark.parametrize("shortest, exponent", [(1, 4), (10, 5), (2, 6)])
def test_other_bounds_equal_brute_force(shortest, exponent):
    for words in list(sequences())[::5]:
        assert periodic.runs(np.array(words, np.int64), shortest, exponent) == brute(words, shortest, exponent)


def test_long_texts_need_few_steps():
    import time

    start = time.time()
    n = 200_000
    assert periodic.runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    block = list(range(1000))
    assert periodic.runs(np.array(block * 100, np.int64)) == [(0, 100_000, 1000)]
    assert periodic.runs(np.arange(n)) == []
    assert time.time() - start < 20
    with pytest.raises(ValueError):
        periodic.runs(np.zeros(9, np.int64), 6, 3)


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = brute(words)
    dropped = {k for s, m, q in own for k in range(s + q, s + m)}
    best = max(own, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    return (
        doc_id, len(own), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{m},{q}\n" for s, m, q in own)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_digests_equal_the_contract(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b É c d".split(" ")) for _ in range(rng.randrange(80))) for _ in range(150)]
    texts += [None, "", " \t\n", "a " * 40, "x y x y " * 9, "\x1c \x1c \x1c \x1c \x1c \x1c z", "a b " * 3 + "a a a a a a a " + "a b " * 9]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "u " * 9, 1, "x"), (None, None, 1, "x"), (5, "q r " * 8, 1, "x"), (5, "q r " * 8, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int, collapsed string")
    got = [tuple(r) for r in periodic.digests(periodic.find_runs(docs, plant=True)).collect()]
    assert sorted(got, key=repr) == sorted((expected(i, t) for i, t, *_ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 15
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and t for i, t, *_ in rows)
    assert periodic.digests(periodic.find_runs(docs.limit(0))).count() == 0


def test_collapsed_text_keeps_one_period(spark):
    docs = spark.createDataFrame([(1, "so a b a b a b a b it ends")], "doc_id long, text string")
    row = periodic.find_runs(docs).first()
    assert row.collapsed == "so a b it ends" and [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.n_words == 11
