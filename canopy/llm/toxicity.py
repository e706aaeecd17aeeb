"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist for documents only, so tokens get theirs first: in toxic documents a token is labelled toxic when its word
or the begin of its word occurs in many toxic and in almost no clean documents of the sample. The field (two states,
features word, begins of 4 to 6 letters and ending) is trained on these token labels; its marginals are then summed and
maximised per document, and a logistic curve fitted to the document labels turns both into the score.

Defined cases: null and empty texts have no tokens and get the score of a document without toxic tokens; without labels
of both kinds the score is the share of toxic labels (0.5 without any); repeated rows are scored alike; a null doc_id
counts as held out; texts of any length are scored whole; extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import fold, labelled_sample, over_batches, utf8

#: Labelled documents to learn from, at most.
SAMPLE_ROWS = 4000
#: Token sequences to train on, at most, and their length.
SEQUENCES, SEQUENCE = 20_000, 32
BUCKETS = 1 << 18
STEPS = 60
TOKEN = re.compile(r"\w+")
#: Words whose emission score one worker keeps.
CACHED_WORDS = 1 << 16


def features(word: str) -> list[int]:
    """Hashed features of a lower-case word. Bucket 0 is the bias."""
    parts = ["w" + word, *("b" + word[:k] for k in (4, 5, 6) if len(word) >= k), "e" + word[-3:]]
    return [0, *(1 + zlib.crc32(p.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for p in parts)]


def _begins(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


def token_lexicon(texts: list[list[str]], labels: list[int]) -> set[str]:
    """Words and word begins (marked by ``*``) that set toxic documents of the sample apart."""
    n = [labels.count(k) for k in (0, 1)]
    parts_of = lambda words: {part for word in set(words) for part in _begins(word)}
    toxic: Counter = Counter()
    for words, label in zip(texts, labels):
        if label:
            toxic.update(parts_of(words))
    support = max(4, 0.01 * n[1])
    frequent = {part: k for part, k in toxic.items() if k >= support}
    clean: Counter = Counter()
    for words, label in zip(texts, labels):
        if not label:
            clean.update(parts_of(words) & frequent.keys())
    return {part for part, k in frequent.items() if (k / n[1]) > 20 * (clean[part] + 0.25) / (n[0] + 0.5)}


class Field:
    """A two-state chain: ``weights`` per feature for state toxic against clean, ``moves[from, to]``."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(toxic) of every token. ``scores`` are the emissions of all sequences, one behind the other.

        Forward and backward messages are log odds; each step moves all sequences that are long enough at once.
        """
        out = np.empty(len(scores))
        order = np.argsort(-lengths, kind="stable")
        begins, lengths = np.cumsum(lengths) - lengths, lengths[order]
        starts = begins[order]
        if not len(lengths) or not lengths[0]:
            return out
        running = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # sequences with more than t tokens
        (a00, a01), (a10, a11) = np.exp(self.moves)
        forward = np.empty(len(scores))
        at = starts[: running[0]]
        message = scores[at]
        forward[at] = message
        for t in range(1, lengths[0]):
            k = running[t]
            e = np.exp(np.minimum(message[:k], 500))
            message = scores[starts[:k] + t] + np.log((a11 * e + a01) / (a10 * e + a00))
            forward[starts[:k] + t] = message
        back = np.zeros(0)
        for t in range(lengths[0] - 1, -1, -1):
            k = running[t]
            message = np.zeros(k)
            if len(back):
                e = np.exp(np.minimum(back, 500))
                message[: len(back)] = np.log((a11 * e + a10) / (a01 * e + a00))
            at = starts[:k] + t
            out[at] = forward[at] + message
            back = message + scores[at]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train_field(sequences: list[list[str]], tags: list[list[int]], steps: int = STEPS) -> Field:
    """Maximise the conditional likelihood of the tags with AdaGrad. The pair marginals give the gradient of the moves."""
    n, width = len(sequences), SEQUENCE
    index: dict[str, list[int]] = {}
    flat_features, flat_tokens = array("i"), array("i")
    y = np.zeros((n, width))
    mask = np.zeros((n, width), bool)
    for i, (words, own) in enumerate(zip(sequences, tags)):
        for t, word in enumerate(words):
            found = index.get(word)
            if found is None:
                found = index[word] = features(word)
            flat_features.extend(found)
            flat_tokens.extend([i * width + t] * len(found))
        y[i, : len(own)] = own
        mask[i, : len(words)] = True
    feature, token = np.frombuffer(flat_features, np.int32), np.frombuffer(flat_tokens, np.int32)
    weights, moves = np.zeros(BUCKETS), np.zeros((2, 2))
    past_w, past_m = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    weights[0] = -2.0
    both = mask[:, 1:] & mask[:, :-1]
    gold = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    for _ in range(steps):
        s = np.bincount(token, weights[feature], n * width).reshape(n, width)
        emit = np.stack([np.zeros_like(s), s], -1)
        emit[~mask] = 0
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = emit[:, 0]
        for t in range(1, width):
            step = np.logaddexp(forward[:, t - 1, 0, None] + moves[0], forward[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            forward[:, t] = np.where(mask[:, t, None], step, forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            ahead = backward[:, t + 1] + emit[:, t + 1]
            step = np.logaddexp(ahead[:, 0, None] + moves[:, 0], ahead[:, 1, None] + moves[:, 1])
            backward[:, t] = np.where(mask[:, t + 1, None], step, backward[:, t + 1])
        total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        p = np.exp(forward[..., 1] + backward[..., 1] - total[:, None])
        error = np.where(mask, y - p, 0).ravel()
        gradient = np.bincount(feature, error[token], BUCKETS) - 1e-3 * weights
        pair = forward[:, :-1, :, None] + moves + (emit + backward)[:, 1:, None, :] - total[:, None, None, None]
        expected = np.exp(pair)[both].sum(0)
        past_w += gradient**2
        past_m += (gold - expected) ** 2
        weights += 0.5 * gradient / np.sqrt(past_w)
        moves += 0.1 * (gold - expected) / np.sqrt(past_m)
    return Field(weights.astype(np.float32), moves)


class Emissions(dict):
    """Emission scores of words, computed once."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        score = float(self.weights[features(word)].sum())
        if len(self) < CACHED_WORDS:
            self[word] = score
        return score


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression; the last is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
    return w


class Tagger:
    """The trained field with the curve from marginals to document scores."""

    def __init__(self, field: Field | None, curve: np.ndarray, share: float):
        self.field, self.curve, self.share = field, curve, share
        self.emissions: Emissions | None = None

    def __getstate__(self):
        return self.field, self.curve, self.share

    def __setstate__(self, state):
        self.__init__(*state)

    def tag(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The marginals of every text's tokens. The words of one text are held at a time."""
        if self.emissions is None:
            self.emissions = Emissions(self.field.weights)
        lookup = self.emissions.__getitem__
        scores = [np.fromiter(map(lookup, words), np.float64, len(words)) for words in texts]
        lengths = np.array([len(s) for s in scores], np.int64)
        return np.split(self.field.marginals(np.concatenate(scores), lengths), np.cumsum(lengths)[:-1]) if scores else []

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        found = summary(marginals)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([found, np.ones(len(found))]) @ self.curve, -30, 30)))


def summary(marginals: list[np.ndarray]) -> np.ndarray:
    """Per document: the largest marginal, and the damped sum of those that are not mere noise."""
    return np.array([(m.max(), np.log1p(m[m > 0.05].sum())) if len(m) else (0.0, 0.0) for m in marginals]).reshape(-1, 2)


def words_of(text: bytes | None) -> list[str]:
    return TOKEN.findall(text.decode("utf-8").lower()) if text else []


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Tagger:
    """Learn from at most ``sample_rows`` labelled documents outside fold 0."""
    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    share = sum(y for _, y in sample) / len(sample) if sample else 0.5
    if not sample or not 0 < share < 1:
        return Tagger(None, np.zeros(3), share)
    unique = dict(sample)
    texts, y = [list(map(sys.intern, words_of(text))) for text in unique], [int(v > 0) for v in unique.values()]
    lexicon = token_lexicon(texts, y)
    sequences, tags, plain = [], [], []
    for words, label in zip(texts, y):
        for at in range(0, len(words), SEQUENCE):
            own = words[at : at + SEQUENCE]
            tag = [int(label and any(part in lexicon for part in _begins(word))) for word in own]
            if any(tag):
                sequences.append(own)
                tags.append(tag)
            else:
                plain.append(own)
    sequences, tags = sequences[: SEQUENCES // 2], tags[: SEQUENCES // 2]
    rest = plain[:: max(1, -(-len(plain) // (SEQUENCES - len(sequences))))]
    field = train_field(sequences + rest, tags + [[0] * len(words) for words in rest])
    tagger = Tagger(field, np.zeros(3), share)
    tagger.curve = logistic(summary(tagger.tag(texts)), np.array(y, float), ridge=0.01)
    return tagger


SCORED = "doc_id long, score double, n_toxic long, spans array<struct<start:int,end:int>>"


def score_documents(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """``(doc_id, held_out, score, predicted, n_toxic, spans)``; spans are code point offsets of toxic tokens, joined
    where neighbours are both toxic."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = utf8(batch.column("text"))
        if tagger.field is None:
            scores, counts, spans = [tagger.share] * len(raw), [0] * len(raw), [[]] * len(raw)
        else:
            marginals = tagger.tag(words_of(text) for text in raw)
            scores = tagger.score(marginals)
            counts = [int((m > 0.5).sum()) for m in marginals]
            spans = [_spans(text, m) if k else [] for text, m, k in zip(raw, marginals, counts)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(spans, kind)], ["doc_id", "score", "n_toxic", "spans"]
        )

    out = over_batches(docs.select("doc_id", "text"), run, SCORED)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "spans")


def _spans(text: bytes, marginals: np.ndarray) -> list[dict]:
    plain = text.decode("utf-8")
    lower = plain.lower()
    out: list[dict] = []
    before = False
    found = list(TOKEN.finditer(lower))
    shift = _shifts(plain) if len(lower) != len(plain) else None
    for match, p in zip(found, marginals):
        if p > 0.5:
            start, end = (match.start(), match.end()) if shift is None else (shift[match.start()], shift[match.end() - 1] + 1)
            if before:
                out[-1]["end"] = end
            else:
                out.append({"start": start, "end": end})
        before = p > 0.5
    return out


def _shifts(plain: str) -> list[int]:
    """For texts whose lower case has another length: the original position of every lower-case character."""
    return [at for at, c in enumerate(plain) for _ in c.lower()]


def without_toxic(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, with all their columns; texts are not shuffled."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = utf8(batch.column("text"))
        scores = np.full(len(texts), tagger.share) if tagger.field is None else tagger.score(tagger.tag(words_of(text) for text in texts))
        yield batch.filter(pa.array(scores < 0.5))

    return over_batches(docs, run, docs.schema)
