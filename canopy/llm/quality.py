"""Text quality by a small byte-level convolutional network in numpy.

Every byte of a text is one position. Its code is the byte itself, with a second set of codes for bytes inside a repeat
(the four bytes that end there occurred a short distance before). Learned filters span ``WIDTH`` codes; their rectified
responses are averaged over chunks of 256 positions that overlap by half, the chunks are max-pooled over the whole
document, and a logistic unit combines the pooled responses into one probability.

Defined cases: null and empty texts have no chunk and get the probability of all-zero responses; a text shorter than a
filter is padded with zero bytes; without labels of both kinds the score is the share of good labels (0.5 without
any); a null doc_id counts as held out; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import fold, labelled_sample, over_batches, utf8

#: Labelled documents to learn from, at most.
SAMPLE_ROWS = 3000
FILTERS, WIDTH = 8, 6
HALF = 128
CODES = 512
EPOCHS, BATCH = 8, 32
#: Repeats are looked for up to this distance.
DISTANCES = range(2, 22)
#: A document is good from this probability on.
THRESHOLD = 0.3
#: Bytes that are scored at once; a longer text is scored alone, in pieces that overlap by a filter.
PASS_BYTES = 1 << 20


def codes(raw: np.ndarray) -> np.ndarray:
    """The code of every byte: 256 more inside a repeat."""
    out = raw.astype(np.int16)
    if len(raw) > 4:
        wide = raw.astype(np.uint32)
        grams = wide[3:] | wide[2:-1] << 8 | wide[1:-2] << 16 | wide[:-3] << 24
        again = np.zeros(len(grams), bool)
        for d in DISTANCES:
            again[d:] |= grams[d:] == grams[:-d]
        out[3:][again] += 256
    return out


class Network:
    """``filters[j, code, f]`` is what code at position j of filter f adds; ``bias`` and ``out`` follow."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.filters = draw.normal(0, 0.05, (WIDTH, CODES, FILTERS)).astype(np.float32)
        self.bias = np.full(FILTERS, 0.05, np.float32)
        self.out = draw.normal(0, 0.3, FILTERS + 1).astype(np.float32)
        self.out[-1] = 0

    def responses(self, code: np.ndarray) -> np.ndarray:
        """Rectified responses at every position; the code array is padded by a filter's rest."""
        n = len(code)
        padded = np.concatenate([code, np.zeros(WIDTH - 1, code.dtype)])
        total = np.take(self.filters[0], padded[:n], axis=0)
        for j in range(1, WIDTH):
            total += np.take(self.filters[j], padded[j : n + j], axis=0)
        total += self.bias
        return np.maximum(total, 0, out=total)

    def pooled(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one text: the pooled responses, the chunk that gave each, and all chunk means."""
        halves, sizes = [], []
        step = PASS_BYTES // HALF * HALF
        for at in range(0, len(code), step):
            piece = code[at : at + step + WIDTH - 1]
            found = self.responses(piece)[: min(step, len(code) - at)]
            edges = np.arange(0, len(found), HALF)
            halves.append(np.add.reduceat(found, edges, axis=0))
            sizes.append(np.diff(np.append(edges, len(found))))
        halves, sizes = np.concatenate(halves), np.concatenate(sizes)
        if len(halves) > 1:  # a chunk is two neighbouring halves
            halves, sizes = halves[:-1] + halves[1:], sizes[:-1] + sizes[1:]
        means = halves / sizes[:, None]
        best = means.argmax(0)
        return means[best, np.arange(FILTERS)], best, means

    def features(self, text: bytes | None) -> np.ndarray:
        return self.pooled(codes(np.frombuffer(text, np.uint8)))[0] if text else np.zeros(FILTERS, np.float32)

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out[:-1] + self.out[-1]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(sample: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Minimise the log loss with Adam. Max-pooling sends the gradient of a filter to one chunk of each text."""
    net = Network(seed)
    texts = [codes(np.frombuffer(text, np.uint8)) for text, _ in sample]
    y = np.array([label for _, label in sample], np.float64)
    net.out[-1] = np.log(y.mean() / (1 - y.mean()))
    parts = [net.filters, net.bias, net.out]
    first, second = [np.zeros(p.shape) for p in parts], [np.zeros(p.shape) for p in parts]
    draw = np.random.default_rng(seed)
    step = 0
    for epoch in range(epochs):
        rate = 0.02 if epoch < epochs * 0.6 else 0.005
        order = draw.permutation(len(texts))
        for begin in range(0, len(order), BATCH):
            gradient = [np.zeros(p.shape) for p in parts]
            where, what = [], []
            own = order[begin : begin + BATCH]
            for i in own:
                code = texts[i]
                if not len(code):
                    gradient[2][-1] += net.probability(np.zeros(FILTERS)) - y[i]
                    continue
                features, best, _ = net.pooled(code)
                error = float(net.probability(features)) - y[i]
                gradient[2][:-1] += error * features
                gradient[2][-1] += error
                for f in range(FILTERS):
                    a, b = best[f] * HALF, min(best[f] * HALF + 2 * HALF, len(code))
                    piece = np.concatenate([code[a : b + WIDTH - 1], np.zeros(max(0, b + WIDTH - 1 - len(code)), code.dtype)])
                    rows = sum(net.filters[j, piece[j : j + b - a], f] for j in range(WIDTH)) + net.bias[f]
                    active = np.flatnonzero(rows > 0)
                    share = error * net.out[f] / (b - a)
                    gradient[1][f] += share * len(active)
                    for j in range(WIDTH):
                        where.append((j * CODES + piece[active + j].astype(np.int64)) * FILTERS + f)
                        what.append(np.full(len(active), share))
            if where:
                gradient[0] = np.bincount(np.concatenate(where), np.concatenate(what), WIDTH * CODES * FILTERS).reshape(parts[0].shape)
            step += 1
            for p, g, m, v in zip(parts, gradient, first, second):
                g = g / len(own) + 1e-5 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    def __init__(self, net: Network | None, share: float):
        self.net, self.share = net, share

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        return self.net.probability(np.array([self.net.features(text) for text in texts], np.float32).reshape(-1, FILTERS))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Scorer:
    """Learn from at most ``sample_rows`` labelled documents outside fold 0."""
    sample = list(dict(labelled_sample(docs, labels, "quality", sample_rows)).items())
    share = sum(y for _, y in sample) / len(sample) if sample else 0.5
    return Scorer(train(sample) if sample and 0 < share < 1 else None, share)


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of ``docs(doc_id, text)``."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(utf8(batch.column("text"))), pa.float64())], ["doc_id", "score"])

    out = over_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
