"""Encoding by reused chunks against the tokenizers library."""

import hashlib
import random
import sys

import numpy as np
import pytest
import tokenizers

from canopy.llm import chunk_bpe
from canopy.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
SIGNS = ["a", "Bc", "é", "'s", "'re", "'", "ll", " ", "  ", "\n", "\t", " \n", " ", " ", "\x1c", "\x85", "7", "½", "٣", ".", "!!", "—", "日本", "한", "😀", "é", "​", "ǅ", "the", " of", "ß"]


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def encoded(texts, parts=None):
    return [numbers(ids) for ids in chunk_bpe.encode_texts(texts, parts or [{}] * len(texts), PATH)]


def numbers(ids):
    return np.frombuffer(ids, np.int32).tolist()


def some_text(rng, size):
    return "".join(rng.choice(SIGNS) for _ in range(size))


@pytest.fixture
def small_chunks(monkeypatch):
    """Chunks of a few bytes, so that joins are many."""
    monkeypatch.setattr(chunk_bpe, "SHORTEST", 3)
    monkeypatch.setattr(chunk_bpe, "BITS", 2)


def test_words_are_cut_as_the_library_cuts_them():
    signs = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + [chr(c) for c in range(0x3000, 0x110000, 97) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}b {c} 1{c}2 '{c}s  {c}{c}\n" for c in signs]
    for a in range(0, len(texts), 2000):
        assert encoded(texts[a : a + 2000]) == [e.ids for e in LIBRARY.encode_batch(texts[a : a + 2000], add_special_tokens=False)]


def test_texts_equal_the_library():
    rng = random.Random(11)
    texts = ["", " ", "  ", "\n", " \n", "'", "''s", "it's we'll 'tis", "a" * 5000, "ab " * 3000, " " * 300 + "x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext"]
    texts += [some_text(rng, rng.randrange(60)) for _ in range(3000)]
    texts.append("".join(chr(rng.randrange(32, 0xD800)) for _ in range(20_000)))
    assert encoded(texts) == [ids_of(t) for t in texts]
    own = chunk_bpe.tokenizer(PATH)
    ids = [ids_of(text) for text in texts] + [[rng.randrange(50257) for _ in range(9)] for _ in range(500)]
    data = own.decode_all(np.concatenate(ids).astype(np.int32), np.array([len(i) for i in ids]))
    assert [d.decode("utf-8", "replace") for d in data] == [LIBRARY.decode(i, skip_special_tokens=False) for i in ids]
    assert own.decode(np.array(ids[4], np.int32).tobytes()) == data[4]


def test_both_ways_of_merging_agree():
    own, rng = chunk_bpe.tokenizer(PATH), random.Random(5)
    words = [bytes(rng.choice(b"aehtnrs \xc3\xa9") for _ in range(rng.randrange(1, 33))) for _ in range(2000)]
    assert own.merge(words) == [own.merge_long(word) for word in words]
    long = b"the " * 30_000 + b"a" * 70_001
    assert own.decode(own.merge_long(long)) == long


def test_joins_of_reused_chunks_are_repaired(small_chunks):
    rng = random.Random(2)
    reused = 0
    for _ in range(3000):
        text = some_text(rng, rng.randrange(1, 50))
        raw, start, known = text.encode(), 0, {}
        for end in chunk_bpe.cuts(raw):
            piece = raw[start:end]
            start = end
            if rng.random() < 0.8:
                known[chunk_bpe.digest(piece)] = chunk_bpe.encode_chunks([piece.decode()], PATH)[0]
        plan = chunk_bpe.plan_text(text, known, chunk_bpe.tokenizer(PATH))
        reused += sum(bool(item) for item in plan.items)
        assert numbers(chunk_bpe.fill([plan], chunk_bpe.tokenizer(PATH))[0]) == ids_of(text), text
    assert reused > 3000


def test_chunks_fall_into_step_after_an_insertion():
    raw = np.random.default_rng(1).integers(97, 123, 60_000, np.uint8).tobytes()
    pieces = lambda t: [t[a:b] for a, b in zip([0, *chunk_bpe.cuts(t)], chunk_bpe.cuts(t))]
    one, other = pieces(raw), pieces(raw[:100] + b"xy" + raw[100:])
    assert b"".join(other) == raw[:100] + b"xy" + raw[100:]
    assert len(set(one) & set(other)) > len(one) - 5 and chunk_bpe.cuts(b"") == []


def test_round_trip_equals_the_library(spark):
    rng = random.Random(7)
    base = [some_text(rng, 400) for _ in range(6)]
    texts = [rng.choice(base)[: rng.randrange(900)] + some_text(rng, 5) + rng.choice(base) + rng.choice(["", "<|endoftext|>", " "]) for _ in range(60)]
    texts += [None, "", base[0], base[0], "x" * 30_000, "ab cd " * 40_000, "\x00 \x00"]
    rows = [(k, t, 1, [2]) for k, t in enumerate(texts)] + [(None, base[1], 1, [2]), (None, None, 1, [2]), (3, texts[3], 1, [2])]
    docs = spark.createDataFrame(rows, "doc_id int, text string, _key int, ids array<int>")
    assert chunk_bpe.shared_chunks(docs, PATH).count() > 5
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = [(i, len(ids_of(t or "")), sha(",".join(map(str, ids_of(t or "")))), sha(t or "")) for i, t, *_ in rows]
    got = [tuple(r) for r in chunk_bpe.round_trip(docs, PATH).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert chunk_bpe.round_trip(docs.limit(0), PATH).count() == 0
    ids = {r.doc_id: list(r.ids) for r in chunk_bpe.encode(docs, PATH).collect() if r.doc_id is not None}
    assert all(ids[k] == ids_of(t or "") for k, t in enumerate(texts))


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        chunk_bpe.Tokenizer(tokenizer_path("word_bpe_49k.json"))


def test_work_per_new_unit_is_done_in_arrays():
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(9)) + rng.choice(["", "", ",", ".\nEl"]) for _ in range(20_000))
    encoded([text[:100]])
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        found = chunk_bpe.encode_texts([text], [{}], PATH)
    finally:
        sys.setprofile(None)
    assert numbers(found[0]) == ids_of(text)
    assert calls < 20_000  # 8 and more for each unit when every one was looked at by itself


def test_units_are_cut_as_the_pattern_cuts_them():
    rng = random.Random(8)
    signs = [s for s in SIGNS if " " not in s] + ["s", "t", "ve", "'d", "S", "\x00"]
    units = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 7))) for _ in range(20_000)]
    units = [u for u in units if not u[0].isspace() and not u[-1].isspace()]
    for some in (units, [u for u in units if u.isascii()]):
        text = "".join(" " + u for u in some)
        words = [len(w.encode()) for u in some for w in chunk_bpe._WORD.findall(" " + u)]
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = chunk_bpe.unit_words(text, raw)
        assert np.flatnonzero(begins).tolist() == (np.cumsum(words) - words).tolist()


@pytest.mark.parametrize("cache", [1, 2, 50, 2000])
def test_few_kept_units_change_nothing(monkeypatch, cache):
    monkeypatch.setattr(chunk_bpe, "CACHE", cache)
    own, rng = chunk_bpe.Tokenizer(PATH), random.Random(cache)
    for _ in range(25):
        texts = [" ".join(some_text(rng, rng.randrange(4)) + rng.choice(["x", "xy", "\x00", "a\x00", "a" * rng.randrange(40)]) for _ in range(40)) for _ in range(5)]
        plans = [chunk_bpe.plan_text(text, {}, own) for text in texts]
        assert [numbers(ids) for ids in chunk_bpe.fill(plans, own)] == [ids_of(t) for t in texts]
        assert own.units.n <= max(cache, 1) * 3 // 2


def test_units_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(chunk_bpe.Units, "mixed", lambda self, keys: np.zeros(len(keys), np.uint64))
    own, text = chunk_bpe.Tokenizer(PATH), "x b b\x00 ab b ab abc b\x00\x00 abcdefghi abcdefghj abcdefghi b"
    for _ in range(2):
        assert numbers(chunk_bpe.fill([chunk_bpe.plan_text(text, {}, own)], own)[0]) == ids_of(text)


def test_long_texts_are_cut_at_clean_spaces(monkeypatch):
    monkeypatch.setattr(chunk_bpe, "PASS_BYTES", 12)
    rng = random.Random(4)
    texts = [some_text(rng, 120) for _ in range(300)] + ["ab " * 50, " " * 40, "a" * 40 + " b" * 40]
    assert encoded(texts) == [ids_of(t) for t in texts]
