"""BPE encoding that reuses content-defined chunks, after a tokenizer file of merges, and its decoding.

A rolling hash cuts every text into chunks, at places that the bytes before them decide alone. Chunks that occur more than
once in the corpus are encoded once; all other text is encoded where it stands. A chunk's tokens are right inside a text
only where the text has the same word boundaries as the chunk on its own, so every join is repaired: from the last sure
boundary on, words are cut out of the whole text one after the other until one of them ends where the chunk, cut on its
own, has a boundary as well. How a text is cut behind a boundary depends on what follows alone, so from there on both
agree exactly, up to the last boundary of the chunk that two more characters of it confirm. A chunk that never
agrees is encoded like other text.

Words are split by the pattern of byte-level tokenizers. A single space between two other signs always begins a
word, so text is cut there first, and what lies between, a unit, is looked up as a whole, all units of many texts at once
in arrays. New units are cut into words and merged together: each step merges the first of the pairs of lowest rank in
every unit, but never across the begin of a word. Other text is cut by the pattern itself. Ids are kept as bytes, four each.

Defined cases: a null or empty text has no tokens and decodes to an empty text; the strings of special tokens become
these tokens, the longest first; texts of any length are encoded whole; repeated rows and null ids stay; extra columns
are ignored. Chunks are told apart by 128 bits.
"""

from __future__ import annotations

import functools
import heapq
import json
import struct
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import over_batches, pinned, prepare, utf8

#: Chunks have at least SHORTEST bytes and a boundary in every 2**BITS places behind them on average.
SHORTEST, BITS = 64, 8
#: Bytes of text whose new words are merged together.
PASS_BYTES = 1 << 20
#: Units between spaces, and words of other text, that one worker keeps encoded; longer words than KEPT_CHARS are not kept.
CACHE, KEPT_CHARS = 3 << 16, 64
#: Numbers of 8 bytes that hold a unit and its length. Longer units are cut by the pattern.
KEY_LONGS = 4
#: Words and units that take up to these many columns, one a byte and one between two words, are merged in arrays. Of the
#: others, units are cut by the pattern and words merged with a heap.
MATRIX_WIDTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32)
#: Classes of signs.
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_TWO_LONGS = struct.Struct(">qq").unpack
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, np.uint32)
#: The pattern of byte-level pre-tokenizers (fixed value).
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CLEAN_SPACE = regex.compile(r"(?r)(?<=\S) (?=\S)")  # searched from the right


# --- chunks ---


def cuts(text: bytes) -> list[int]:
    """The ends of the chunks of a text, in bytes: where the hash of the last 32 bytes has its top bits zero."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return []
    total = _GEAR[raw]
    for k in (1, 2, 4, 8, 16):  # the sum over 2k bytes is that over k bytes and the one k bytes earlier, shifted
        before = total[:-k] << np.uint32(k)
        total[k:] = total[k:] + before
    ends = np.flatnonzero(total >> np.uint32(32 - BITS) == 0) + 1
    ends = ends[ends < len(raw)]
    ends = ends[(raw[ends] & 0xC0) != 0x80]  # never inside a character
    out, last = [], 0
    for end in ends.tolist():
        if end - last >= SHORTEST:
            out.append(end)
            last = end
    return [*out, len(raw)]


def digest(piece: bytes) -> tuple[int, int]:
    return _TWO_LONGS(xxhash.xxh3_128_digest(piece))


# --- the tokenizer ---


@functools.cache
def byte_signs() -> list[str]:
    """The sign that stands for each byte in byte-level vocabularies: itself if it prints, else the next one from 256 on."""
    prints = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(byte if byte in prints else next(others)) for byte in range(256)]


def _keep_half(cache: dict) -> None:
    """Let the older half of a full cache go."""
    if len(cache) > CACHE:
        for key in list(islice(cache, CACHE // 2)):
            del cache[key]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``starts``, ``starts + 1``, ... of all spans, ``sizes`` each."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Units:
    """Ids of units in an open hash table, the next slot on a clash; when CACHE are exceeded, the half used last stays.

    A key is the unit itself, padded with zeros, and its length, so units are told apart exactly.
    """

    def __init__(self) -> None:
        bits = max((2 * CACHE).bit_length(), 4)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._clear()

    def _clear(self) -> None:
        slots = self._mask + 1
        self.keys, self.n = np.zeros((slots, KEY_LONGS), np.uint64), 0  # no key is zero, as it has a length
        self.starts, self.counts, self.used = np.zeros(slots, np.int32), np.zeros(slots, np.int32), np.zeros(slots, np.int32)
        self.pool, self.turn = np.empty(0, np.int32), 1

    def mixed(self, keys: np.ndarray) -> np.ndarray:
        out = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for k in range(1, KEY_LONGS):
            out = (out ^ (out >> np.uint64(29)) ^ keys[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        return out

    def find(self, keys: np.ndarray, mixed: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 of those that aren't kept."""
        at = (mixed >> self._shift).astype(np.int64)
        here = self.keys[at]
        out = np.where((here == keys).all(1), at, -1)
        going = np.flatnonzero((out < 0) & (here[:, -1] != 0))
        while len(going):
            at[going] = (at[going] + 1) & self._mask
            here = self.keys[at[going]]
            hit = (here == keys[going]).all(1)
            out[going[hit]] = at[going[hit]]
            going = going[~hit & (here[:, -1] != 0)]
        self.used[out[out >= 0]] = self.turn
        return out

    def add(self, keys: np.ndarray, mixed: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Keep different units, ``counts`` of all ``ids`` each."""
        if self.n + len(keys) > CACHE:
            self._let_go()
        keys, mixed, counts = keys[:CACHE], mixed[:CACHE], counts[:CACHE]
        starts = len(self.pool) + np.cumsum(counts) - counts
        self.pool = np.concatenate([self.pool, ids[: counts.sum()]])
        self._put(keys, mixed, starts, counts, np.full(len(keys), self.turn))
        self.turn += 1

    def _put(self, keys: np.ndarray, mixed: np.ndarray, starts: np.ndarray, counts: np.ndarray, used: np.ndarray) -> None:
        self.n += len(keys)
        at, left = (mixed >> self._shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = first & (self.keys[at, -1] == 0)
            slot, own = at[put], left[put]
            self.keys[slot], self.starts[slot], self.counts[slot], self.used[slot] = keys[own], starts[own], counts[own], used[own]
            left, at = left[~put], (at[~put] + 1) & self._mask

    def _let_go(self) -> None:
        slots = np.flatnonzero(self.keys[:, -1])
        used = self.used[slots]
        if len(slots) > CACHE // 2:
            slots = slots[used > np.partition(used, -(CACHE // 2))[-(CACHE // 2)]]
        keys, counts, used, pool = self.keys[slots], self.counts[slots].astype(np.int64), self.used[slots], self.pool
        ids, turn = pool[_spans(self.starts[slots].astype(np.int64), counts)], self.turn
        self._clear()
        self.pool, self.turn = ids, turn
        self._put(keys, self.mixed(keys), np.cumsum(counts) - counts, counts, used)


@functools.cache
def _classes() -> np.ndarray:
    """The class of every code point, as the pattern knows them."""
    table = np.full(0x110000, _OTHER, np.uint8)
    for begin, end in ((0, 0xD800), (0xE000, 0x110000)):
        signs = "".join(map(chr, range(begin, end)))
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for run in regex.finditer(pattern, signs):
                table[begin + run.start() : begin + run.end()] = kind
    return table


def unit_words(text: str, raw: np.ndarray) -> np.ndarray:
    """Whether a word begins at each byte of units, a space before each. Units hold no spaces, nor white space at their ends."""
    lead = None if len(raw) == len(text) else np.flatnonzero((raw & 0xC0) != 0x80)
    points = raw if lead is None else np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    begins = np.ones(len(points), bool)
    begins[1:] = kind[1:] != kind[:-1]
    blank = kind == _SPACE
    begins[1:-1] |= blank[:-2] & blank[1:-1] & ~blank[2:]  # the last white space before a word stands alone
    spaces = points == ord(" ")
    begins[1:][spaces[:-1]] = False
    marks = np.flatnonzero(points == ord("'"))
    marks = marks[(kind[marks - 1] != _OTHER) & ~spaces[marks - 1]]  # the apostrophe begins a word
    if len(marks):
        ahead = np.append(points, np.zeros(2, points.dtype))
        one, two = ahead[marks + 1], ahead[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (np.isin(one, [ord(c) for c in "rv"]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        begins[marks[short | long] + 1] = False
        begins[marks[long] + 2] = False
        ends = np.concatenate([marks[short] + 2, marks[long] + 3])
        begins[ends[ends < len(begins)]] = True
    if lead is None:
        return begins
    out = np.zeros(len(raw), bool)
    out[lead] = begins
    return out


class Tokenizer:
    """Byte-level BPE of a tokenizer file: words to ids, ids to bytes, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        plain = not spec.get("normalizer") and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
        if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("only plain byte-level BPE is supported")
        vocab = model["vocab"]
        byte_of = {sign: byte for byte, sign in enumerate(byte_signs())}
        size = 1 + max([*vocab.values(), *(t["id"] for t in added)])
        self.tokens = [b""] * size
        for token, k in vocab.items():
            self.tokens[k] = bytes(byte_of[sign] for sign in token)
        for token in added:
            self.tokens[token["id"]] = token["content"].encode()
        self.specials = {t["content"]: t["id"] for t in added}
        ordered = sorted(map(regex.escape, self.specials), key=len, reverse=True)
        self.special = regex.compile("|".join(ordered)) if ordered else None
        self.of_byte = np.array([vocab[sign] for sign in byte_signs()], np.int32)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.size = size
        keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.none = len(pairs)
        self.rank_of = dict(zip(keys.tolist(), range(len(pairs))))
        self._table(keys)
        self.sizes = np.array([len(token) for token in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.words: dict[str, bytes] = {}
        self.units = Units()

    def _table(self, keys: np.ndarray) -> None:
        """Ranks by pair in an open hash table, eight slots a pair, the next slot on a clash."""
        bits = max(int(8 * len(keys)).bit_length(), 4)
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, -1, np.int64)
        self._ranks = np.full(1 << bits, self.none, np.int32)
        rank, at = np.arange(len(keys)), self._slot(keys)
        while len(rank):
            free = self._keys[at] < 0
            first = np.zeros(len(rank), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self._keys[at[put]], self._ranks[at[put]] = keys[rank[put]], rank[put]
            rank, at = rank[~put], (at[~put] + 1) & self._mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` for those that are never merged."""
        key = left * self.size + right
        at = self._slot(key)
        seen = self._keys[at]
        out = np.where(seen == key, self._ranks[at], self.none)
        going = np.flatnonzero((seen != key) & (seen >= 0))
        while len(going):
            at[going] = (at[going] + 1) & self._mask
            seen = self._keys[at[going]]
            hit = seen == key[going]
            out[going[hit]] = self._ranks[at[going[hit]]]
            going = going[~hit & (seen >= 0)]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of words, all merged at once."""
        raw, sizes = np.frombuffer(b"".join(words), np.uint8), np.array([len(word) for word in words], np.int64)
        ids, counts = self._merge_rows(raw, sizes, np.zeros(len(raw), bool))
        ends, data = 4 * np.cumsum(counts), ids.tobytes()
        out = [data[a:b] for a, b in zip((ends - 4 * counts).tolist(), ends.tolist())]
        for at in np.flatnonzero(sizes > MATRIX_WIDTHS[-1]).tolist():
            out[at] = self.merge_long(words[at])
        return out

    def _merge_rows(self, raw: np.ndarray, sizes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``raw``, cut into rows of ``sizes`` bytes, no pair merged whose right part has ``begins``, and how many each
        row has; none for rows that take more columns than all widths."""
        starts = np.cumsum(sizes) - sizes
        before = np.concatenate([[0], np.cumsum(begins)])
        widths = sizes + before[starts + sizes] - before[starts]
        counts, classes, least = np.zeros(len(sizes), np.int64), [], 0
        for width in MATRIX_WIDTHS:
            own = np.flatnonzero((widths > least) & (widths <= width))
            least = width
            if len(own):
                row, at = np.repeat(np.arange(len(own)), sizes[own]), _spans(starts[own], sizes[own])
                column = at - starts[own][row] + before[at + 1] - before[starts[own]][row]
                parts = np.full((len(own), width + 1), -1, np.int32)
                parts[row, column] = self.of_byte[raw[at]]
                ids, counts[own] = self._merge_matrix(parts)
                classes.append((own, ids))
        ends = np.cumsum(counts)
        out = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for own, ids in classes:
            out[_spans((ends - counts)[own], counts[own])] = ids
        return out, counts

    def _merge_matrix(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of rows of parts, and how many each row has. Negative parts stand between words, the last column of all is one.

        A step takes one part from every row that still merges. Parts stay in their columns and know their neighbours.
        """
        n, width = parts.shape
        inside = (parts[:, :-1] >= 0) & (parts[:, 1:] >= 0)
        ranks = np.full((n, width), self.none, np.int32)
        ranks[:, :-1][inside] = self.rank(parts[:, :-1][inside].astype(np.int64), parts[:, 1:][inside].astype(np.int64))
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))  # of the first column the last one, which is none
        done, rows = parts.copy(), np.arange(n)
        while True:
            best_at = ranks.argmin(1)
            base = np.arange(0, ranks.size, width)
            on = np.flatnonzero(ranks.ravel()[base + best_at] < self.none)
            if len(on) < 0.75 * len(rows):
                if not len(on):
                    done[rows] = parts
                    break
                off = np.ones(len(rows), bool)
                off[on] = False
                done[rows[off]] = parts[off]
                rows, parts, ranks, after, before, best_at = rows[on], parts[on], ranks[on], after[on], before[on], best_at[on]
                base, on = np.arange(0, ranks.size, width), np.arange(len(rows))
            base = base[on]
            p, r, a, b = parts.ravel(), ranks.ravel(), after.ravel(), before.ravel()  # views
            at = base + best_at[on]
            right = base + a[at]
            new = self.merged[r[at]]
            p[at], p[right], r[right] = new, -1, self.none
            column = a[right]
            a[at] = column
            following = base + column
            b[following] = best_at[on]
            column = b[at]
            former = base + np.where(column < 0, width - 1, column)
            left, left_at = np.concatenate([new, p[former]]).astype(np.int64), np.concatenate([at, former])
            other = np.concatenate([p[following], new]).astype(np.int64)
            rank = np.full(len(left), self.none, np.int32)
            some = np.flatnonzero((left >= 0) & (other >= 0))
            rank[some] = self.rank(left[some], other[some])
            r[left_at] = rank
        kept = done >= 0
        return done[kept], kept.sum(1)

    def merge_long(self, word: bytes) -> bytes:
        """The ids of one word in n log n steps."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(at: int) -> None:
            right = after[at]
            if right < n:
                rank = self.rank_of.get(ids[at] * self.size + ids[right])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, ids[at], ids[right]))

        for at in range(n):
            offer(at)
        while heap:
            rank, at, left, right = heapq.heappop(heap)
            other = after[at]
            if ids[at] != left or other >= n or ids[other] != right:
                continue  # one of the two has been merged since
            ids[at], ids[other] = int(self.merged[rank]), -1
            after[at] = after[other]
            if after[at] < n:
                before[after[at]] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return np.array([k for k in ids if k >= 0], np.int32).tobytes()

    def encode_tails(self, tails: list[str]) -> list[bytes]:
        """The ids of stretches of text that begin with a space at the begin of a word and end where a word ends."""
        text = "".join(tails)
        data, lengths = text.encode(), np.array([len(tail) for tail in tails], np.int64)
        raw = np.frombuffer(data, np.uint8)
        points = raw if len(raw) == len(text) else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        places = np.flatnonzero(points == ord(" "))
        kinds, edge = _classes(), np.cumsum(lengths)
        blank_after = kinds[points[np.minimum(places + 1, len(points) - 1)]] == _SPACE
        clean = ~blank_after & (kinds[points[places - 1]] != _SPACE)
        heads = np.searchsorted(places, edge - lengths)
        clean[heads] = True
        begins = np.flatnonzero(clean)
        starts = (places if points is raw else np.flatnonzero(raw == ord(" ")))[begins]
        sizes = np.diff(starts, append=len(raw))
        first = np.searchsorted(begins, heads)  # the first unit of each tail
        odd = blank_after[begins] | (sizes > 8 * KEY_LONGS)  # one with white space at an end or more than one space, or a long one
        odd[np.searchsorted(begins, np.flatnonzero(~clean)) - 1] = True
        odd[np.append(first[1:], len(begins))[kinds[points[edge - 1]] == _SPACE] - 1] = True

        counts, at = np.zeros(len(begins), np.int64), np.zeros(len(begins), np.int64)
        plain = np.flatnonzero(~odd)
        keys = self._keys_of(raw, starts[plain], sizes[plain])
        mixed = self.units.mixed(keys)
        slots = self.units.find(keys, mixed)
        old, new = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        counts[plain[old]], at[plain[old]] = self.units.counts[slots[old]], self.units.starts[slots[old]]
        pools = [self.units.pool]
        if len(new):
            new = new[np.argsort(mixed[new], kind="stable")]
            other = np.append(True, (keys[new[1:]] != keys[new[:-1]]).any(1))
            one, group = new[other], np.cumsum(other) - 1
            ids, count = self._encode_units(raw, starts[plain[one]], sizes[plain[one]])
            counts[plain[new]], at[plain[new]] = count[group], len(pools[0]) + (np.cumsum(count) - count)[group]
            pools.append(ids)
            done = count > 0
            self.units.add(keys[one[done]], mixed[one[done]], count[done], ids)
        rest = np.flatnonzero(counts == 0)
        if len(rest):
            pieces = [data[a:b].decode() for a, b in zip(starts[rest].tolist(), (starts + sizes)[rest].tolist())]
            found = self.encode_pieces(set(pieces))
            lists = [found[piece] for piece in pieces]
            counts[rest] = [len(ids) // 4 for ids in lists]
            at[rest] = sum(map(len, pools)) + np.cumsum(counts[rest]) - counts[rest]
            pools.append(np.frombuffer(b"".join(lists), np.int32))
        out = np.concatenate(pools)[_spans(at, counts)].tobytes()
        ends = 4 * np.append(0, np.cumsum(counts))[np.append(first, len(begins))]
        return [out[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def _keys_of(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Keys of units behind a space: their bytes, then zeros, the length in the last byte."""
        padded = np.append(raw, np.zeros(8 * KEY_LONGS + 1, np.uint8))
        longs = np.lib.stride_tricks.as_strided(padded.view(np.uint8)[:8].view("<u8"), (len(padded) - 7,), (1,))
        masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        out = np.empty((len(starts), KEY_LONGS), np.uint64)
        for k in range(KEY_LONGS):
            out[:, k] = longs[starts + 1 + 8 * k] & masks[np.clip(sizes - 1 - 8 * k, 0, 8)]
        out[:, -1] |= (sizes - 1).astype(np.uint64) << np.uint64(56)
        return out

    def _encode_units(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units with their spaces, and how many each has; none for those that take too many columns."""
        raw = raw[_spans(starts, sizes)]
        begins = unit_words(raw.tobytes().decode(), raw)
        begins[np.cumsum(sizes) - sizes] = False
        return self._merge_rows(raw, sizes, begins)

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of other pieces of text: cut into words, new words merged together."""
        _keep_half(self.words)
        words, cut = self.words, {piece: _WORD.findall(piece) for piece in pieces}
        new = [*{word for own in cut.values() for word in own}.difference(words)]
        words.update(zip(new, self.merge([word.encode() for word in new])))
        out = {piece: b"".join([words[word] for word in own]) for piece, own in cut.items()}
        for word in [word for word in new if len(word) > KEPT_CHARS]:
            del words[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[k] for k in np.frombuffer(ids, np.int32).tolist()])

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of texts, ``counts`` ids each."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        shift = self.starts[ids] - (ends - sizes)
        data = self.blob[np.arange(len(shift) and ends[-1]) + np.repeat(shift, sizes)].tobytes()
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


# --- one text ---


class _Plan:
    """What a text consists of: ready ids, words, and stretches that begin and end at clean spaces."""

    def __init__(self) -> None:
        self.items: list = []
        self.tails: list = []  # (place in items, text from a space on that begins a word)
        self.words: list = []  # (place in items, piece)

    def ids(self, ids: bytes) -> None:
        self.items.append(ids)

    def word(self, piece: str) -> None:
        self.words.append((len(self.items), piece))
        self.items.append(b"")

    def stretch(self, text: str) -> None:
        """Text from a boundary to a clean space or the end of the text."""
        at = 0 if text[0] == " " else text.find(" ")
        while at > 0 and (at + 1 == len(text) or text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if at:  # what stands before the first clean space has no space before it
            self.word(text[:at] if at > 0 else text)
        while at >= 0:
            space = _CLEAN_SPACE.search(text, at + 1, at + PASS_BYTES) if len(text) - at > PASS_BYTES else None
            end = space.start() if space else len(text)
            self.tails.append((len(self.items), text[at:end]))
            self.items.append(b"")
            at = end if space else -1


def _plain(plan: _Plan, text: str, a: int, b: int) -> None:
    """Text between two boundaries ``a`` and ``b`` of its words."""
    if a < b:
        space = _CLEAN_SPACE.search(text, a, min(b + 2, len(text)))  # b itself may be one
        if space is not None and space.start() > a:
            plan.stretch(text[a : space.start()])
            a = space.start()
        if b == len(text):
            if a < b:
                plan.stretch(text[a:b])
            return
    while a < b:
        match = _WORD.match(text, a)
        plan.word(match[0])
        a = match.end()


def plan_section(plan: _Plan, text: str, parts: dict[tuple[int, int], bytes], own: Tokenizer) -> None:
    """Plan a text without special strings; ``parts`` has the ids of chunks that were encoded before."""
    raw = text.encode()
    ends = cuts(raw) if parts else []
    done, start, at = 0, 0, 0  # a boundary up to which all is planned; the chunk's begin in bytes and characters
    for end in ends:
        piece = raw[start:end]
        size = len(piece.decode())
        known = parts.get(digest(piece))
        if known is not None:
            held = piece[: own.sizes[np.frombuffer(known, np.int32)].sum()]
            sure = at + len(held.decode())  # the chunk's own boundary up to which it is sure
            space = _CLEAN_SPACE.search(text, done, min(at + 2, len(text)))
            true, mine = space.start() if space else done, at
            while true != mine and max(true, mine) <= sure:
                if true < mine:
                    true = _WORD.match(text, true).end()
                else:
                    mine = _WORD.match(text, mine, at + size).end()
            if true == mine and true < sure:
                _plain(plan, text, done, true)
                skip, k = len(text[at:true].encode()), 0
                for token in np.frombuffer(known, np.int32).tolist() if skip else ():
                    if skip <= 0:
                        break
                    skip -= len(own.tokens[token])
                    k += 1
                plan.ids(known[4 * k :])
                done = sure
        start, at = end, at + size
    _plain(plan, text, done, len(text))


def plan_text(text: str, parts: dict, own: Tokenizer) -> _Plan:
    plan, begin = _Plan(), 0
    for match in own.special.finditer(text) if own.special else ():
        plan_section(plan, text[begin : match.start()], parts, own)
        plan.ids(np.int32(own.specials[match[0]]).tobytes())
        begin = match.end()
    plan_section(plan, text[begin:], parts, own)
    return plan


def fill(plans: list[_Plan], own: Tokenizer) -> list[bytes]:
    """The ids of planned texts, the words new to this worker merged together."""
    ids = own.encode_pieces({piece for plan in plans for _, piece in plan.words})
    for plan in plans:
        for at, piece in plan.words:
            plan.items[at] = ids[piece]
    tails = [(plan, at, text) for plan in plans for at, text in plan.tails]
    for a, b in _passes([len(text) for _, _, text in tails]):
        for (plan, at, _), found in zip(tails[a:b], own.encode_tails([text for _, _, text in tails[a:b]])):
            plan.items[at] = found
    return [b"".join(plan.items) for plan in plans]


def encode_texts(texts: list[str], parts: list[dict], path: str) -> list[bytes]:
    """The ids of texts, ``parts`` holding the ids of the shared chunks of each."""
    own = tokenizer(path)
    return fill([plan_text(text, known, own) for text, known in zip(texts, parts)], own)


def sure_end(text: str) -> int:
    """Where a chunk's last boundary is that two more characters confirm; 0 if none."""
    last = 0
    space = _CLEAN_SPACE.search(text, 0, max(len(text) - 1, 0))
    at = space.start() if space else 0
    while at <= len(text) - 2:
        last = at
        at = _WORD.match(text, at).end()
    return last


def encode_chunks(pieces: list[str], path: str) -> list[bytes]:
    """The ids of chunks, each up to its sure end."""
    own, plans = tokenizer(path), []
    for piece in pieces:
        plans.append(_Plan())
        _plain(plans[-1], piece, 0, sure_end(piece))
    return fill(plans, own)


# --- the corpus ---


def _passes(sizes: list[int]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for at, size in enumerate(sizes):
        if total and total + size > PASS_BYTES:
            yield begin, at
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _id_lists(lists: list[bytes]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(ids) // 4 for ids in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(lists), np.int32)))


def _sections(text: bytes, own: Tokenizer) -> list[bytes]:
    if own.special is None:
        return [text]
    return [part.encode() for part in own.special.split(text.decode())] if any(s.encode() in text for s in own.specials) else [text]


def shared_chunks(docs: DataFrame, path: str) -> DataFrame:
    """``(high, low, ids)`` of the chunks that occur more than once in ``docs(text)``: each encoded once, up to where it is sure.
    ``ids`` are 32-bit numbers in bytes.

    Occurrences are summed in every batch and before the shuffle, so a chunk of any number of copies is a few rows.
    """

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, found = tokenizer(path), {}
        for text in utf8(batch.column("text")):
            for section in _sections(text, own) if text else ():
                start = 0
                for end in cuts(section):
                    piece = section[start:end]
                    found[piece] = found.get(piece, 0) + 1
                    start = end
        keys = [digest(piece) for piece in found]
        columns = [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array(list(found), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["high", "low", "n", "piece"])

    def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pieces = [piece.decode() for piece in batch.column("piece").to_pylist()]
        for a, b in _passes([len(piece) for piece in pieces]):
            ids = pa.array(encode_chunks(pieces[a:b], path), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("high")[a:b], batch.column("low")[a:b], ids], ["high", "low", "ids"])

    pieces = over_batches(docs.select("text"), cut, "high long, low long, n long, piece binary")
    pieces = pieces.groupBy("high", "low").agg(F.sum("n").alias("n"), F.first("piece").alias("piece")).where("n > 1")
    return over_batches(pieces.select("high", "low", "piece"), encode, "high long, low long, ids binary").where(F.octet_length("ids") > 0)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` of every text of ``docs(doc_id, text)`` by the tokenizer file at ``path``, the same on every machine.

    Texts are known by a 64-bit hash while their chunks are looked up; texts that fall together get each other's chunks
    offered, which does no harm. Equal texts look theirs up once.
    """
    prepare(docs.sparkSession)
    shared = pinned(shared_chunks(docs, path))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_key", F.xxhash64("text"))

    def refer(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, found = tokenizer(path), set()
        for key, text in zip(batch.column("_key").to_pylist(), utf8(batch.column("text"))):
            for section in _sections(text, own):
                start = 0
                for end in cuts(section):
                    found.add((key, *digest(section[start:end])))
                    start = end
        columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(columns, ["_key", "high", "low"])

    chunks = over_batches(rows.select("_key", "text"), refer, "_key long, high long, low long")
    # Most chunks are not shared and go here; a chunk that many texts share meets one row, and equal texts are one set.
    known = chunks.join(shared, ["high", "low"]).groupBy("_key").agg(F.collect_set(F.struct("high", "low", "ids")).alias("parts"))
    # Written first: with an exchange on either side adaptive execution can split a text that many rows have.
    known = pinned(known)

    def pack(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        packed = pa.array([squeeze(text) for text in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_key"), packed], ["doc_id", "_key", "packed"])

    def fill_in(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        loosen = zstandard.ZstdDecompressor().decompress
        texts, column = [loosen(packed) for packed in batch.column("packed").to_pylist()], batch.column("parts")
        for a, b in _passes([len(text) for text in texts]):
            parts = [{(p["high"], p["low"]): p["ids"] for p in own or ()} for own in column[a:b].to_pylist()]
            lists = encode_texts([text.decode() for text in texts[a:b]], parts, path)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], _id_lists(lists)], ["doc_id", "ids"])

    # Texts cross the shuffle packed, which halves what it writes.
    packed = over_batches(rows.select(F.col("doc_id").cast("long"), "_key", "text"), pack, "doc_id long, _key long, packed binary")
    joined = packed.join(known, "_key", "left").select("doc_id", "packed", "parts")
    return over_batches(joined, fill_in, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(ids)`` with the column ``text`` in place of ``ids``; bytes that are no UTF-8 become replacement signs."""
    kept = [c for c in encoded.columns if c not in ("ids", "text")]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        lengths = batch.column("ids").value_lengths().fill_null(0).to_pylist()
        for a, b in _passes([4 * n for n in lengths]):
            part = batch.slice(a, b - a)
            ids = part.column("ids").flatten().to_numpy(zero_copy_only=False)
            texts = [data.decode("utf-8", "replace") for data in own.decode_all(ids, np.array(lengths[a:b], np.int64))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.select(*kept).dtypes)
    return over_batches(encoded.select(*kept, "ids"), run, f"{schema}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, digest the ids, decode, digest the text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    encoded = encode(docs, path).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(encoded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
