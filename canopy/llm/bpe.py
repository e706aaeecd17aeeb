"""Byte-level BPE with a vectorised pre-tokenizer.

Code points become class symbols through one table. A scan of composed transition functions over fixed blocks then finds
the state before every symbol, and with it the token boundaries, without a regular expression. The slices between
boundaries go through cached pair merging. The byte offset of every token is kept and places its bytes when decoding.

Defined cases: a null or empty text has no tokens and decodes to no bytes; special tokens in a text are ordinary text;
texts of any length are processed whole; repeated rows and null ids stay; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import emptied_by, over_batches, utf8

#: Code points of one pass of the scan; a longer text is a pass of its own.
PASS_CHARS = 1 << 18
#: Slices that one worker keeps merged.
CACHE_SLICES = 1 << 18
#: Slices up to this many bytes are merged over plain lists, longer ones with a heap.
SHORT_SLICE = 64
#: Length of the scan's blocks.
BLOCK = 256

# Symbols of the scan. The contraction symbols stand for an apostrophe that 1 or 2 fitting letters follow.
RESET, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, JOIN, LONE = range(9)
# States: what the current token is. JOINED is a space that the next token takes in; LEFT1 and LEFT2 are inside a
# contraction with so many letters to come; DONE is right behind one.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINED, LEFT2, LEFT1, DONE = range(9)
STATES = 9


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """``step[symbol, state]`` is the next state, ``cut[symbol, state]`` tells that a token begins at the symbol."""
    step, cut = np.zeros((9, STATES), np.uint8), np.ones((9, STATES), bool)
    step[RESET] = START
    for symbol, run in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[symbol] = run
        cut[symbol, [run, JOINED]] = False
    step[LETTER, LEFT2], step[LETTER, LEFT1] = LEFT1, DONE
    cut[LETTER, [LEFT2, LEFT1]] = False
    for symbol, left in ((SHORT, LEFT1), (LONG, LEFT2)):
        step[symbol] = left  # the apostrophe begins a token, so the contraction holds
        step[symbol, [IN_OTHERS, JOINED]] = IN_OTHERS  # it goes on with other signs or follows a joined space
        cut[symbol, [IN_OTHERS, JOINED]] = False
    step[SPACE], step[JOIN], step[LONE] = IN_SPACES, JOINED, START
    cut[SPACE, IN_SPACES] = False
    return step, cut


STEP, CUT = _transitions()


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    for symbol, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[[ord(c) for c in regex.findall(pattern, points)]] = symbol
    return table


def symbols(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """The scan's symbol of every code point; ``resets`` are the positions before the texts."""
    out = classes()[points]
    out[resets] = RESET
    after = np.append(out[1:], RESET)
    ends = (out == SPACE) & (after != SPACE) & (after != RESET)
    out[ends] = np.where(points[ends] == ord(" "), JOIN, LONE)
    marks = np.flatnonzero((points == ord("'")) & (out == OTHER))
    if len(marks):
        ahead = np.append(points, [0, 0])
        one, two = ahead[marks + 1], ahead[marks + 2]
        out[marks[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pairs = np.isin(one.astype(np.int64) << 32 | two, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")])
        out[marks[pairs]] = LONG
    return out


def boundaries(syms: np.ndarray) -> np.ndarray:
    """Whether a token begins at each symbol.

    The transition function of a block is composed symbol by symbol for all blocks at once, the functions of the blocks
    are chained, and a second walk gives the states inside the blocks. Composition is associative, so the blocks can be
    cut anywhere.
    """
    n = len(syms)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.intp)
    grid[:n] = syms
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T) * STATES
    flat = STEP.ravel().astype(np.intp)
    functions = np.tile(np.arange(STATES), (blocks, 1))
    for row in grid:
        functions = flat.take(row[:, None] + functions)
    state = np.empty(blocks, np.intp)
    now = START
    for k, f in enumerate(functions.tolist()):
        state[k] = now
        now = f[now]
    begins = np.empty((BLOCK, blocks), bool)
    cut = CUT.ravel()
    for k, row in enumerate(grid):
        at = row + state
        begins[k] = cut.take(at)
        state = flat.take(at)
    return begins.T.ravel()[:n]


class Merger(dict):
    """Token ids of a slice of bytes, merged on first use and kept for later ones."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE_SLICES:
            for key in list(islice(self, CACHE_SLICES // 2)):
                del self[key]
        whole = self.ranks.get(piece)
        ids = (whole,) if whole is not None else self.merged(piece) if len(piece) <= SHORT_SLICE else self.merged_by_heap(piece)
        self[piece] = ids
        return ids

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none is in the vocabulary."""
        rank, none = self.ranks.get, len(self.ranks) + 1
        cuts = list(range(len(piece) + 1))
        pairs = [rank(piece[a : a + 2], none) for a in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) != none:
            at = pairs.index(low)
            del cuts[at + 1], pairs[at]
            if at < len(pairs):
                pairs[at] = rank(piece[cuts[at] : cuts[at + 2]], none)
            if at:
                pairs[at - 1] = rank(piece[cuts[at - 1] : cuts[at + 1]], none)
        return tuple([self.ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])])

    def merged_by_heap(self, piece: bytes) -> tuple[int, ...]:
        """The same for long slices, in n log n steps."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that begins here
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = []

        def offer(at: int) -> None:
            middle = end[at]
            if middle < n and (rank := ranks.get(piece[at : end[middle]])) is not None:
                heapq.heappush(heap, (rank, at, middle, end[middle]))

        for at in range(n):
            offer(at)
        while heap:
            _, at, middle, stop = heapq.heappop(heap)
            if not alive[at] or end[at] != middle or end[middle] != stop:
                continue  # one of the two has been merged since
            alive[middle] = False
            end[at] = stop
            if stop < n:
                before[stop] = at
            offer(at)
            if before[at] >= 0:
                offer(before[at])
        return tuple(ranks[piece[at : end[at]]] for at in range(n) if alive[at])


@functools.cache
def vocabulary(path: str) -> tuple[Merger, np.ndarray, np.ndarray]:
    """Of a rank file: the merger, all token bytes in one array, and where each token begins in it."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    sizes = np.array([len(t) for t in tokens], np.int64)
    return Merger(ranks), np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


emptied_by[__name__] = vocabulary.cache_clear


def encode_texts(texts: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For UTF-8 texts: tokens per text, all ids, and the byte offset of every token in its text."""
    merger, _, starts = vocabulary(path)
    glued = b"\n" + b"\n".join(texts) + b"\n"
    points = np.frombuffer(glued.decode("utf-8").encode("utf-32-le"), np.uint32)
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
    byte_at = np.concatenate([[0], np.cumsum(width)])
    text_bytes = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    resets = np.searchsorted(byte_at, text_bytes)
    begins = boundaries(symbols(points, resets))
    begins[resets] = True
    cuts = byte_at[np.flatnonzero(begins)].tolist()
    pieces = [glued[a:b] for a, b in zip(cuts, cuts[1:])]
    lookup = merger.__getitem__
    is_reset = np.isin(np.array(cuts[:-1]), text_bytes)
    merged = [() if skip else lookup(piece) for piece, skip in zip(pieces, is_reset.tolist())]
    ids = np.fromiter(chain.from_iterable(merged), np.int32)
    per_piece = np.fromiter(map(len, merged), np.int64, len(merged))
    first_piece = np.flatnonzero(is_reset)
    tokens_before = np.concatenate([[0], np.cumsum(per_piece)])
    counts = np.diff(np.append(tokens_before[first_piece], len(ids)))
    lengths = (starts[1:] - starts[:-1])[ids]
    offsets = np.cumsum(lengths) - lengths
    at = np.cumsum(counts) - counts
    base = np.zeros(len(counts), np.int64)
    base[counts > 0] = offsets[at[counts > 0]] if len(ids) else 0
    return counts, ids, (offsets - np.repeat(base, counts)).astype(np.int32)


def decode_ids(counts: np.ndarray, ids: np.ndarray, offsets: np.ndarray, path: str) -> list[bytes]:
    """The bytes of every text: each token's bytes at its offset."""
    _, blob, starts = vocabulary(path)
    lengths = (starts[1:] - starts[:-1])[ids]
    ends = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    last = ends[some + 1] - 1
    sizes[some] = offsets[last] + lengths[last]
    text_at = np.concatenate([[0], np.cumsum(sizes)])
    place = offsets + np.repeat(text_at[:-1], counts)
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros(text_at[-1], np.uint8)
    out[np.repeat(place, lengths) + inside] = blob[np.repeat(starts[ids], lengths) + inside]
    data = out.tobytes()
    return [data[a:b] for a, b in zip(text_at.tolist(), text_at[1:].tolist())]


def _passes(sizes: list[int]):
    """Ranges of rows with at most PASS_CHARS together, or one row."""
    begin = total = 0
    for at, size in enumerate(sizes):
        if total and total + size > PASS_CHARS:
            yield begin, at
            begin, total = at, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, ids, offsets)`` of every text of ``docs(doc_id, text)``; offsets are bytes from the text's begin."""

    def run(batch: pa.RecordBatch):
        texts = [t or b"" for t in utf8(batch.column("text"))]
        for a, b in _passes([len(t) for t in texts]):
            counts, ids, offsets = encode_texts(texts[a:b], ranks_path)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(values)) for values in (ids, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], *lists], ["doc_id", "ids", "offsets"])

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded(doc_id, ids, offsets)`` with the column ``bytes`` of the decoded texts; other columns stay."""
    kept = [c for c in encoded.columns if c not in ("ids", "offsets")]

    def run(batch: pa.RecordBatch):
        lengths = batch.column("ids").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in _passes((3 * lengths).tolist()):
            part = batch.slice(a, b - a)
            ids, offsets = (part.column(c).flatten().to_numpy() for c in ("ids", "offsets"))
            data = decode_ids(lengths[a:b], ids, offsets, ranks_path)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(data, pa.binary())], [*kept, "bytes"])

    schema = ", ".join(f"{n} {t}" for n, t in encoded.select(*kept).dtypes)
    return over_batches(encoded, run, f"{schema}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode, digest the ids, decode, digest the bytes."""
    encoded = encode(docs, ranks_path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), "ids", "offsets"
    )
    return decode(encoded, ranks_path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
