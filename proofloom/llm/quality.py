"""Quality by attention-based multiple-instance learning: a document is a bag of passages with one label.

A text is cut into passages of ``PASSAGE`` bytes, to its end. Each passage is described by the shares of
byte kinds and by how its words repeat, and a small layer encodes that. Gated attention (a tanh branch
times a sigmoid branch) gives every passage a weight; the weights of a document sum to one, and the
weighted mean of its encoded passages is scored by a logistic unit. Only document labels are needed: the
attention learns which passages speak for the label. Encoder, attention and score are trained together by
Adam in numpy on about ``FIT_ROWS`` labelled documents outside the held-out fold; fitting and scoring read all
passages of a document. Fitting keeps 60 bytes a passage, a fifth of the sampled texts.

Null and empty texts are one empty passage and get the score the network gives that. Labels for unknown
documents and null labels teach nothing; if no two labels differ, every score is the share of label 1
(1 without labels). Repeated rows score alike; of an id with several labels or texts the smallest teach. An
empty table gives an empty table. Only doc_id and text of the documents are read; other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import fit_sample, fold_bucket, utf8

PASSAGE = 320
FIT_ROWS = 4000
ENCODED = 12
ATTENTION = 8
STEPS = 400
BATCH = 256
RATE = 0.02
MODULUS, HELD = 4, 2
#: Score from which a document counts as good.
GOOD = 0.7
_KINDS = 9  # upper, lower, digit, blank, line end, end of clause, exclamation, other mark, beyond ASCII
FEATURES = _KINDS + 6


def _kind_table() -> np.ndarray:
    kind = np.full(256, 8, np.uint8)
    kind[:128] = 7
    for k, members in enumerate((range(65, 91), range(97, 123), range(48, 58), b" \t\r\v\f", b"\n", b".,;:?", b"!")):
        kind[list(members)] = k
    return kind


_KIND = _kind_table()


class Network(NamedTuple):
    shift: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    what: np.ndarray  # tanh branch
    gate: np.ndarray  # sigmoid branch
    pick: np.ndarray
    score: np.ndarray
    score_bias: np.ndarray


def describe(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of each text, and where each text's rows start."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts], np.int64)
    starts = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    row = 0
    for text in texts:
        if not text:
            row += 1
            continue
        data = np.frombuffer(text, np.uint8)
        kinds = _KIND[data]
        edges = np.arange(0, len(text), PASSAGE)
        sizes = np.diff(np.append(edges, len(text)))
        own = out[row : row + len(edges)]
        slot = np.repeat(np.arange(len(edges)) * _KINDS, sizes) + kinds
        own[:, :_KINDS] = np.bincount(slot, minlength=len(edges) * _KINDS).reshape(-1, _KINDS) / sizes[:, None]
        twice = np.append(False, (data[1:] == data[:-1]) & (kinds[1:] >= 6) & (kinds[1:] < 8))
        own[:, _KINDS] = np.add.reduceat(twice, edges, dtype=np.int64) / sizes
        letters = own[:, 0] + own[:, 1] + own[:, 8]
        own[:, _KINDS + 1] = own[:, 0] / np.maximum(letters, 1e-3)
        for i, at in enumerate(edges.tolist()):
            words = text[at : at + PASSAGE].split()
            n = len(words)
            if n:
                own[i, _KINDS + 2 :] = len(set(words)) / n, sum(map(eq, words, words[1:])) / n, sizes[i] / n / 10, sizes[i] / PASSAGE
        row += len(edges)
    return out, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class _Pass(NamedTuple):
    x: np.ndarray
    h: np.ndarray
    t: np.ndarray
    g: np.ndarray
    weight: np.ndarray
    bag: np.ndarray
    p: np.ndarray


def _forward(net: Network, rows: np.ndarray, starts: np.ndarray) -> _Pass:
    x = (rows - net.shift) / net.scale
    h = np.tanh(x @ net.encode + net.encode_bias)
    t, g = np.tanh(h @ net.what), _sigmoid(h @ net.gate)
    raw = (t * g) @ net.pick
    sizes = np.diff(np.append(starts, len(rows)))
    raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
    weight = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
    bag = np.add.reduceat(h * weight[:, None], starts)
    return _Pass(x, h, t, g, weight, bag, _sigmoid(bag @ net.score + net.score_bias[0]))


def attention(net: Network, rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the bags and weights of their passages."""
    done = _forward(net, rows, starts)
    return done.p, done.weight


def gradient(net: Network, rows: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> Network:
    """Of the mean log loss of the bags."""
    f = _forward(net, rows, starts)
    sizes = np.diff(np.append(starts, len(rows)))
    error = (f.p - labels) / len(labels)
    into_bag = np.repeat(error[:, None] * net.score, sizes, axis=0)
    along = (into_bag * f.h).sum(axis=1)
    mean = np.repeat(np.add.reduceat(along * f.weight, starts), sizes)
    raw = f.weight * (along - mean)
    dt = raw[:, None] * net.pick * f.g * (1 - f.t**2)
    dg = raw[:, None] * net.pick * f.t * f.g * (1 - f.g)
    dh = (into_bag * f.weight[:, None] + dt @ net.what.T + dg @ net.gate.T) * (1 - f.h**2)
    zero = np.zeros_like(net.shift)
    return Network(zero, zero, f.x.T @ dh, dh.sum(axis=0), f.h.T @ dt, f.h.T @ dg, (f.t * f.g).T @ raw, f.bag.T @ error, np.array([error.sum()]))


def train(rows: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = STEPS, seed: int = 42) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    net = Network(
        rows.mean(axis=0), rows.std(axis=0) + 1e-2, draw(FEATURES, ENCODED), np.zeros(ENCODED), draw(ENCODED, ATTENTION), draw(ENCODED, ATTENTION),
        draw(ATTENTION), draw(ENCODED), np.zeros(1),
    )
    ends = np.append(starts[1:], len(rows))
    first, second = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    for step in range(1, steps + 1):
        bags = rng.choice(len(labels), min(BATCH, len(labels)), replace=False)
        at = np.concatenate([np.arange(starts[b], ends[b]) for b in bags])
        sizes = (ends - starts)[bags]
        grad = gradient(net, rows[at], np.cumsum(sizes) - sizes, labels[bags])
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for k in range(2, len(net)):
            g, m, v = grad[k] + 1e-4 * net[k], first[k], second[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net[k][...] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def _fit_bags(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows, starts = describe(utf8(part.column(1)))
        bags = [rows[a:b].tobytes() for a, b in zip(starts, np.append(starts[1:], len(rows)))]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(bags, pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS) -> Network | float:
    """A trained network, or the score of every document where the labels don't differ."""
    sample = fit_sample(docs, labels, "quality", MODULUS, HELD, rows)
    found = sample.select("doc_id", "text", F.col("label").cast("double")).mapInArrow(_fit_bags, "doc_id long, label double, bag binary").toPandas().sort_values("doc_id")
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        return float(y[0]) if len(y) else 1.0
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in found["bag"]]
    sizes = np.array([len(b) for b in bags])
    return train(np.concatenate(bags).astype(float), np.cumsum(sizes) - sizes, y, steps)


def score(docs: DataFrame, net: Network | float, score_column: str = "quality_score", passage_column: str = "best_passage") -> DataFrame:
    """Every column of ``docs``, the score, and the first byte of the passage with the largest weight. The two names are replaced."""
    out = docs.drop(score_column, passage_column).withColumns({score_column: F.lit(0.0), passage_column: F.lit(0).cast("long")})
    at = out.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, starts = describe(utf8(part.column(at)))
            if not len(starts):
                continue
            if isinstance(net, float):
                p, best = np.full(len(starts), net), np.zeros(len(starts), np.int64)
            else:
                p, weight = attention(net, rows, starts)
                ends = np.append(starts[1:], len(rows))
                best = np.array([int(weight[a:b].argmax()) * PASSAGE for a, b in zip(starts, ends)], np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[: part.num_columns - 2], pa.array(np.clip(p, 0, 1)), pa.array(best)], schema=part.schema)

    return out.mapInArrow(run, out.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, best_passage."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    held = (fold_bucket("doc_id", MODULUS) == HELD).alias("held_out")
    return scored.select("doc_id", held, F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD).cast("int").alias("predicted"), "best_passage")
