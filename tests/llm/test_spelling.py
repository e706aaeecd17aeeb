"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from canopy.llm import spelling
from canopy.llm.common import pinned


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def some_words(rng, count, letters="abÉ", low=7, high=10):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(count)})


@pytest.mark.parametrize("letters", ["ab", "abcdé", "abcdefghijklmnopqrstuvwxyzßÿ"])
def test_index_finds_what_is_one_edit_away(letters):
    rng = random.Random(len(letters))
    words = some_words(rng, 250, letters)
    asked = words + some_words(rng, 50, letters + "×", 2, 9)
    for exact in (0, 2, 4):
        index = spelling.Index(words)
        rows, near = index.one_edit(asked, np.minimum(exact, [len(w) for w in asked]))
        got = sorted(zip(rows.tolist(), near.tolist()))
        assert len(got) == len(set(got))

        def kept(x, y):
            k = min(exact, len(x))
            # An edit behind the exact part: both begin alike, and the rest is one edit apart.
            return x[:k] == y[:k] and one_edit(x[k:], y[k:])

        assert got == [(i, j) for i, x in enumerate(asked) for j, y in enumerate(words) if kept(x, y)]


def test_one_word_and_repeated_words():
    got = spelling.Index(["abc"]).one_edit(["abd", "abc", "bc"], np.zeros(3, np.int64))
    assert sorted(zip(*(a.tolist() for a in got))) == [(0, 0), (2, 0)]
    with pytest.raises(ValueError):
        spelling.Index(["ab", "ab"])


def grouped(counts):
    """The contract, word by word."""
    for word, n in counts.items():
        near = [w for w in counts if one_edit(word, w)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        yield word, n, len(near), *((best, counts[best]) if best and counts[best] >= 10 * n else (None, None))


def with_roots(rows):
    rows = list(rows)
    form = {r[0]: r[3] for r in rows}

    def root(word):
        return word if form[word] is None else root(form[word])

    return sorted(((*r, root(r[0])) for r in rows), key=repr)


@pytest.mark.parametrize("shard, searches", [(20_000, 40_000), (9, 4)])
def test_variants_equal_brute_force(spark, shard, searches):
    rng = random.Random(8)
    words = some_words(rng, 120, "abé") + ["stumble" + w for w in some_words(rng, 120, "ab", 1, 5)]  # a crowded half
    counts = {w: rng.choice([2, 3, 20, 30, 200, 300, 2500]) for w in words}
    rows = pinned(spark.createDataFrame(list(counts.items()), "word string, n long"))
    got = spelling.variants(rows, shard_words=shard, searches=searches).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == with_roots(grouped(counts))
    assert sum(r.form is not None for r in got.collect()) > 20
    assert any(r.form is not None and r.root != r.form for r in got.collect())


def counted(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def test_whole_tables_equal_brute_force(spark):
    rng = random.Random(4)
    base = some_words(rng, 40, "abÉÀn", 6, 9) + ["Journée", "JOURNÉE", "journee", "straße!", "naïvement", "ÀÉÎÕÜßÿ"]
    texts = [" ".join(rng.choice(base) for _ in range(rng.randrange(120))) for _ in range(60)]
    texts += [None, "", "1 2 ×÷ …", "abcdefgh\x00abcdefgh", "long" * 40_000 + " long"]
    rows = [(k, t, 1, "x") for k, t in enumerate(texts)] + [(None, "journee journee abcdefgi", 1, "x"), (3, texts[3], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int, word string")
    words = pinned(spelling.vocabulary(docs, misspell=True))
    want = counted([r[:2] for r in rows])
    assert {r.word: r.n for r in words.collect()} == want
    got = spelling.variants(words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(r) for r in got), key=repr) == with_roots(grouped(want))
    plain = {r.word: r.n for r in spelling.vocabulary(docs).collect()}
    assert plain["journée"] > 1 and plain["abcdefgh"] == 2
    empty = pinned(spelling.vocabulary(docs.limit(0)))
    assert spelling.variants(empty).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(empty, outnumbers=1)
