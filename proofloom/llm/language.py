"""Language identification: a bidirectional gated recurrent network that labels every byte position.

Each direction is one gated recurrent layer over bytes (A-Z folded); the two states of a position give
class probabilities for that position. Texts are read whole, as consecutive windows of ``WINDOW`` bytes, so
that a very long text costs no more a byte than a short one. Each direction comes to a window with the state
it has after the ``LEAD`` bytes next to the window on that side, and a document's probabilities are the means
over all its positions. The network is trained in numpy by backpropagation through time, with Adam, on spans
of ``SPAN`` bytes drawn from all places of a sample of about ``FIT_ROWS`` documents whose language is known
and whose fold is not held out; a fixed seed makes reruns agree. Every document is scored.

Null texts, empty texts and texts without a letter (of the Unicode category L) are ``und`` with score 0. A
null language teaches nothing; with no language at all every document is ``und``. Repeated rows get equal
results; of an id with several languages or texts the smallest teach. A null id is kept, an empty table gives
an empty table. Only doc_id, text and lang (for learning) are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import fit_sample, fold_bucket, strings

#: Bytes that are labelled together, and bytes beside them that each direction reads first.
WINDOW = 192
LEAD = 32
STATE = 8
#: Documents that the network learns from, about; bytes of a span, and passes of Adam.
FIT_ROWS = 2000
SPAN = 64
STEPS = 120
BATCH = 128
RATE = 0.02
MODULUS, HELD = 3, 1
UNKNOWN = "und"
#: Windows that go through the network together.
TOGETHER = 1024
_LETTER = regex.compile(r"\p{L}")


class Network(NamedTuple):
    """Per direction: input rows of the three gates by byte, state matrices; then the read-out."""

    inputs: np.ndarray  # direction, gate, byte, state
    states: np.ndarray  # direction, gate, state, state
    out: np.ndarray  # 2 * state, language
    out_bias: np.ndarray  # language


def fresh(languages: int, seed: int = 42) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    return Network(draw(0.3, 2, 3, 256, STATE), draw(0.3, 2, 3, STATE, STATE), draw(0.3, 2 * STATE, languages), np.zeros(languages, np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _traced(net: Network, way: int, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, row, state) of one direction for windows x (row, time), in text order, with what the gradient needs."""
    rows, steps = x.shape
    out, trace = np.empty((steps, rows, STATE), np.float32), []
    h = np.zeros((rows, STATE), np.float32)
    update, reset, fresh_ = net.inputs[way]
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        at = x[:, t]
        back = np.matmul(h, net.states[way])
        z = _sigmoid(update[at] + back[0])
        r = _sigmoid(reset[at] + back[1])
        n = np.tanh(fresh_[at] + r * back[2])
        trace.append((t, h, z, r, n, back[2]))
        h = np.add(n, z * (h - n), out=out[t])
    return out, trace


def _states(net: Network, way: int, x: np.ndarray, inside: np.ndarray, out: np.ndarray) -> None:
    """The same states without a trace, in place, into ``out`` (time, row, state); outside a text the state is zero."""
    rows, steps = x.shape
    outside = np.ascontiguousarray(~inside.T)
    some = outside.any(axis=1)
    half = np.array([0.5, 0.5, 1], np.float32)  # a sigmoid is a tanh of half its argument
    table = (net.inputs[way] * half[:, None, None]).reshape(-1, STATE)
    inner = net.states[way] * half[:, None, None]
    at = np.arange(3)[:, None] * 256 + x.T[:, None, :].astype(np.intp)
    h = np.zeros((rows, STATE), np.float32)
    gates, back = np.empty((3, rows, STATE), np.float32), np.empty((3, rows, STATE), np.float32)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        np.take(table, at[t], axis=0, out=gates, mode="clip")
        np.matmul(h, inner, out=back)
        both = gates[:2]
        both += back[:2]
        np.tanh(both, out=both)
        both += np.float32(1)
        both *= np.float32(0.5)
        z, r, n = gates
        r *= back[2]
        n += r
        np.tanh(n, out=n)
        np.subtract(h, n, out=r)
        r *= z
        h = np.add(n, r, out=out[t])
        if some[t]:
            h[outside[t]] = 0


def probabilities(net: Network, x: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """(language, time, row) for the inner positions of windows x (row, time) with ``LEAD`` bytes on both sides."""
    rows, steps = x.shape
    ahead, behind = np.empty((2, steps - LEAD, rows, STATE), np.float32)
    _states(net, 0, x[:, : steps - LEAD], inside[:, : steps - LEAD], ahead)
    _states(net, 1, x[:, LEAD:], inside[:, LEAD:], behind)
    read = net.out.reshape(2, STATE, -1)
    steps -= 2 * LEAD
    scores = np.ascontiguousarray((ahead[LEAD:].reshape(-1, STATE) @ read[0] + behind[:steps].reshape(-1, STATE) @ read[1]).T)
    scores += net.out_bias[:, None]
    scores -= scores.max(axis=0)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=0)
    return scores.reshape(-1, steps, rows)


def gradient(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, Network]:
    """Mean cross-entropy over all positions of windows x with languages y, and its gradient through time."""
    ways = [_traced(net, way, x) for way in (0, 1)]
    states = np.concatenate([w[0] for w in ways], axis=2)
    scores = states @ net.out + net.out_bias
    scores -= scores.max(axis=2, keepdims=True)
    share = np.exp(scores)
    share /= share.sum(axis=2, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-np.log(share[:, rows, y] + 1e-9).mean())
    error = share
    error[:, rows, y] -= 1
    error /= share.shape[0] * share.shape[1]
    flat = error.reshape(-1, error.shape[2])
    grad = Network(*(np.zeros_like(p) for p in net))
    grad.out[:] = states.reshape(len(flat), -1).T @ flat
    grad.out_bias[:] = flat.sum(axis=0)
    into = error @ net.out.T
    for way in (0, 1):
        dh = np.zeros((len(y), STATE), np.float32)
        for t, h, z, r, n, inner in reversed(ways[way][1]):
            dh = dh + into[t, :, way * STATE : (way + 1) * STATE]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            di = dn * r
            at = x[:, t]
            for gate, d in enumerate((dz, dr, dn)):
                for k in range(STATE):
                    grad.inputs[way, gate, :, k] += np.bincount(at, d[:, k], 256)
            for gate, d in enumerate((dz, dr, di)):
                grad.states[way, gate] += h.T @ d
            dh = dh * z + dz @ net.states[way, 0].T + dr @ net.states[way, 1].T + di @ net.states[way, 2].T
    return loss, grad


def train(texts: list[bytes], y: np.ndarray, languages: int, steps: int = STEPS, seed: int = 42) -> Network:
    """From texts with languages y. Each language is drawn equally often, then a text, then a place in it."""
    net = fresh(languages, seed)
    rng = np.random.default_rng(seed)
    pools = [np.flatnonzero(y == k) for k in range(languages)]
    folded = [t.lower().ljust(SPAN, b"\0") for t in texts]
    first = [np.zeros_like(p) for p in net]
    second = [np.zeros_like(p) for p in net]
    for step in range(1, steps + 1):
        rows = np.concatenate([rng.choice(pool, -(-BATCH // languages)) for pool in pools])
        places = [int(rng.integers(0, len(folded[r]) - SPAN + 1)) for r in rows]
        x = np.frombuffer(b"".join([folded[r][p : p + SPAN] for r, p in zip(rows, places)]), np.uint8).reshape(-1, SPAN)
        _, grad = gradient(net, x, y[rows])
        norm = float(np.sqrt(sum((g * g).sum() for g in grad)))
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / steps))
        for p, g, m, v in zip(net, grad, first, second):
            g = g * min(1.0, 1 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts with the bytes beside them (row, time), which of those are in the text, and the number of windows of each text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    wide, rows, inside = WINDOW + 2 * LEAD, [np.zeros((0, WINDOW + 2 * LEAD), np.uint8)], [np.zeros((0, WINDOW + 2 * LEAD), bool)]
    for text, n in zip(texts, counts.tolist()):
        if n:
            data = np.frombuffer(bytes(LEAD) + text.lower().ljust(n * WINDOW, b"\0") + bytes(LEAD), np.uint8)
            rows.append(np.lib.stride_tricks.sliding_window_view(data, wide)[::WINDOW])
            at = np.arange(n)[:, None] * WINDOW + np.arange(-LEAD, WINDOW + LEAD)
            inside.append((at >= 0) & (at < len(text)))
    return np.concatenate(rows), np.concatenate(inside), counts


def pooled(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text the mean probabilities over its positions, and how many positions each language is the label of."""
    x, inside, counts = windows(texts)
    languages = len(net.out_bias)
    lengths = np.array([len(t) for t in texts], np.int64)
    sums, votes = np.zeros((len(x), languages)), np.zeros((len(x), languages), np.int64)
    for a in range(0, len(x), TOGETHER):
        b = min(len(x), a + TOGETHER)
        share = probabilities(net, x[a:b], inside[a:b])
        live = inside[a:b, LEAD:-LEAD]
        if not live.all():
            share *= live.T
        sums[a:b] = share.sum(axis=1).T
        best = share.max(axis=0)
        votes[a:b] = ((share == best) & (best > 0)).sum(axis=1).T
    owner = np.repeat(np.arange(len(texts)), counts)
    out, seen = np.zeros((len(texts), languages)), np.zeros((len(texts), languages), np.int64)
    np.add.at(out, owner, sums)
    np.add.at(seen, owner, votes)
    return out / np.maximum(1, lengths)[:, None], seen


def fit(docs: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS) -> tuple[list[str], Network | None]:
    sample = fit_sample(docs, docs, "lang", MODULUS, HELD, rows).filter("text <> ''")
    found = sample.toPandas().sort_values("doc_id")
    languages = sorted(set(found["label"]))
    if not languages:
        return [], None
    y = np.searchsorted(np.array(languages), found["label"].to_numpy())
    return languages, train([t.encode() for t in found["text"]], y, len(languages), steps)


def identify(docs: DataFrame, rows: int = FIT_ROWS, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_positions (bytes labelled), position_share (of those with the label lang_pred)."""
    languages, net = fit(docs, rows, steps)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = strings(part.column(2))
            known = [net is not None and _LETTER.search(t) is not None for t in texts]
            data = [t.encode() if k else b"" for t, k in zip(texts, known)]
            lengths = np.array([len(d) for d in data], np.int64)
            if net is None:
                best, score, share = [], np.zeros(len(texts)), np.zeros(len(texts))
            else:
                means, votes = pooled(net, data)
                best = means.argmax(axis=1)
                at = np.arange(len(texts))
                score = np.where(known, np.clip(means[at, best], 0, 1), 0.0)
                share = votes[at, best] / np.maximum(1, lengths)
            named = [languages[best[i]] if k else UNKNOWN for i, k in enumerate(known)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(named, pa.string()), pa.array(score), pa.array(lengths), pa.array(share)],
                names=["doc_id", "held_out", "lang_pred", "score", "n_positions", "position_share"],
            )

    read = docs.select(F.col("doc_id").cast("long"), (fold_bucket("doc_id", MODULUS) == HELD).alias("held_out"), F.col("text").cast("string"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_positions long, position_share double")
