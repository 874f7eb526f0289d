"""Toxicity by a weighted lexicon: one Aho-Corasick pass over folded text, normalised by length.

Folding maps look-alike letters of other scripts and digits that stand for letters to Latin letters, folds
case and full-width forms, and turns everything else into blanks, so ``1d10t`` and a Cyrillic ``о`` match
what they imitate. Entries are whole words or beginnings of words; where several match one word, the
heaviest counts. A match inside an exception phrase (entry with its neighbour word) does not count.

The lexicon is learned from about ``FIT_ROWS`` labelled documents outside the held-out fold, copies counted
once. Spark counts, for every word and word beginning, the toxic and other documents that have it; entries
are those whose smoothed log-odds pass ``MIN_WEIGHT`` and whose share of toxic documents would come by chance
with a probability under exp(-``EVIDENCE``), however few of all toxic documents have them, without those that
a shorter entry already covers. The lexicon has no size of its own: an entry takes ``MIN_DOCS`` sampled
documents at least, so the sample bounds it. An exception phrase is a match with its neighbour that occurs in
other documents and in no toxic one. The score is a logistic unit on
the matched weight as it is, by the square root of the length and by the length; its few coefficients are
fitted on scores that each half of the sample gets from the lexicon of the other half. Every document is
scored, whole.

Null and empty texts match nothing and get the score of that. Without two differing labels the score is the
share of toxic labels (0 without labels). Repeated rows score alike; of an id with several labels or texts the
smallest teach. An empty table gives an empty table; other columns of the documents stay as they are.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import cut, discard, fit_sample, fold_bucket, strings

#: Labelled documents that the lexicon is learned from, about.
FIT_ROWS = 4000
#: Characters of a word beginning that can be an entry.
STEMS = (4, 5, 6)
MIN_WEIGHT = 2.5
MIN_DOCS = 4
#: Bound on the logarithm of the probability that chance gives an entry its toxic documents (1e-7).
EVIDENCE = 16.0
MODULUS, HELD = 5, 0
# Letters that look alike, and digits and signs that stand for letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "3", "и": "u", "й": "u", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ү": "y",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i",
}


class _Folding(dict):
    """A translate table that works out a character on first sight."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKC", chr(code)).casefold():
            c = _LOOKALIKES.get(c, c)
            c = _LOOKALIKES.get(c, c)
            out += c if c.isalpha() else " "
        if unicodedata.category(chr(code)) in ("Cf", "Mn"):  # joiners and marks hide inside words
            out = ""
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str) -> str:
    """Folded words, one blank before and after each. A bar or dollar sign by itself is no letter."""
    return f" {' '.join([w for w in text.translate(_FOLDING).split() if w not in ('i', 's')])} "


class Lexicon(NamedTuple):
    weights: dict[str, float]  # entries begin with a blank; whole words end with one too
    exceptions: frozenset[str]  # "entry's word next word" or "word before entry's word", between blanks


class Matcher:
    def __init__(self, lexicon: Lexicon):
        self.exceptions = lexicon.exceptions
        self.automaton = ahocorasick.Automaton()
        for entry, weight in lexicon.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        self.live = bool(lexicon.weights)
        if self.live:
            self.automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """Start of each matched word -> its weight."""
        found: dict[int, float] = {}
        if self.live:
            for end, (length, weight) in self.automaton.iter(folded):
                at = end - length + 1
                if found.get(at, 0.0) < weight:
                    found[at] = weight
        return found

    def contexts(self, folded: str, at: int) -> tuple[str, str]:
        """The matched word with the word after it and with the word before it, between blanks."""
        stop = folded.index(" ", at + 1)
        after = folded.find(" ", stop + 1)
        return folded[at : after + 1] if after > 0 else folded[at : stop + 1] + " ", folded[max(0, folded.rfind(" ", 0, at)) : stop + 1]

    def total(self, folded: str) -> tuple[float, int]:
        """Summed weight of the matches that count, and their number."""
        found = self.matches(folded)
        if self.exceptions and found:
            found = {at: w for at, w in found.items() if not self.exceptions.intersection(self.contexts(folded, at))}
        return sum(found.values()), len(found)


def signals(weight: float, matches: int, words: int) -> list[float]:
    """What the logistic unit reads: matched weight by length in three ways, and the constant."""
    words = max(1, words)
    return [math.log1p(weight), weight / math.sqrt(words), min(10.0, 100 * weight / words), float(matches > 0), 1.0]


def _candidates(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in STEMS if len(word) >= n)
    return out


def _count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """entry, half, toxic, docs: counted within the task first."""
    seen: dict[tuple[int, int], Counter] = defaultdict(Counter)
    for part in parts:
        for text, half, toxic in zip(strings(part.column(0)), part.column(1).to_pylist(), part.column(2).to_pylist()):
            seen[half, toxic].update(_candidates(fold(text)))
    for (half, toxic), counts in seen.items():
        n = len(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array([half] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["entry", "half", "toxic", "docs"],
        )


def evidence(a: int, b: int, toxic: int, other: int) -> float:
    """Minus the logarithm of the Chernoff bound on so many toxic documents among a + b, 0 if fewer than expected."""
    rate, n = toxic / max(1, toxic + other), a + b
    if not n or a <= rate * n:
        return 0.0
    return a * math.log(a / n / rate) + (b * math.log(b / n / (1 - rate)) if b else 0.0)


def choose(rows: list[tuple[str, int, int]], toxic: int, other: int, least: float = EVIDENCE) -> dict[str, float]:
    """Entries and weights from (entry, toxic documents, other documents).

    Of a word and its beginnings the longest that still has nearly all the documents stays, and nothing that
    a kept beginning covers.
    """
    weights, seen = {}, {}
    for entry, a, b in rows:
        w = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (other - b + 0.5))
        if a >= MIN_DOCS and w >= MIN_WEIGHT and evidence(a, b, toxic, other) >= least:
            weights[entry], seen[entry] = w, a
    shorter = {e: [e[:n] for n in (s + 1 for s in STEMS) if n < len(e.rstrip()) + (e[-1] == " ") and e[:n] in weights] for e in weights}
    general = {s for e in weights for s in shorter[e] if seen[e] >= 0.95 * seen[s]}
    kept: dict[str, float] = {}
    for entry in sorted(weights, key=lambda e: (len(e), e)):
        if entry not in general and not any(s in kept and weights[s] >= weights[entry] - 0.7 for s in shorter[entry]):
            kept[entry] = round(weights[entry], 6)
    return kept


def lexicons(sample: DataFrame) -> tuple[list[dict[str, float]], list[int]]:
    """The entries of both halves and of the whole sample, and its numbers of toxic and other documents.

    Only entries that may pass in a half or in the whole leave Spark. A half has half the documents, so half
    the evidence is asked of it.
    """
    counted = sample.select("text", "half", "label").mapInArrow(_count, "entry string, half int, toxic int, docs long")
    part = lambda half, toxic: F.sum(F.when((F.col("half") == half) & (F.col("toxic") == toxic), F.col("docs")).otherwise(0))
    totals = counted.groupBy("entry").agg(*(part(h, t).alias(f"d{h}{t}") for h in (0, 1) for t in (1, 0)))
    sizes = {(r["half"], r["label"]): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    n = [sizes.get((0, t), 0) + sizes.get((1, t), 0) for t in (1, 0)]

    def passes(in_toxic: Column, in_other: Column, toxic: int, other: int, least: float) -> Column:
        odds = F.log((in_toxic + 0.5) / (F.lit(toxic) - in_toxic + 0.5)) - F.log((in_other + 0.5) / (F.lit(other) - in_other + 0.5))
        rate, both = toxic / max(1, toxic + other), in_toxic + in_other
        gain = in_toxic * F.log(in_toxic / both / F.lit(rate)) + F.when(in_other > 0, in_other * F.log(in_other / both / F.lit(1 - rate))).otherwise(0.0)
        return (in_toxic >= MIN_DOCS) & (odds >= MIN_WEIGHT - 1e-6) & (gain >= least - 1e-6)

    if not n[0] or not n[1]:
        return [{}, {}, {}], n
    both = [(F.col(f"d{h}1"), F.col(f"d{h}0"), sizes.get((h, 1), 0), sizes.get((h, 0), 0)) for h in (0, 1)]
    live = passes(F.col("d01") + F.col("d11"), F.col("d00") + F.col("d10"), *n, EVIDENCE)
    for a, b, toxic, other in both:
        if toxic and other:
            live = live | passes(a, b, toxic, other, EVIDENCE / 2)
    best = sorted(map(tuple, totals.filter(live).select("entry", "d01", "d00", "d11", "d10").collect()))
    halves = [choose([(r[0], r[1 + 2 * h], r[2 + 2 * h]) for r in best], *both[h][2:], EVIDENCE / 2) for h in (0, 1)]
    return [*halves, choose([(r[0], r[1] + r[3], r[2] + r[4]) for r in best], *n)], n


def _phrases(weights: dict[str, float]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(Lexicon(weights, frozenset()))
        for part in parts:
            rows = []
            for text, toxic in zip(strings(part.column(0)), part.column(2).to_pylist()):
                folded = fold(text)
                found = {c for at in matcher.matches(folded) for c in matcher.contexts(folded, at)}
                rows += [(c, toxic) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["phrase", "toxic"])

    return run


def exception_phrases(sample: DataFrame, weights: dict[str, float]) -> frozenset[str]:
    found = sample.select("text", "half", "label").mapInArrow(_phrases(weights), "phrase string, toxic int")
    per = found.groupBy("phrase").agg(F.count_if(F.col("toxic") == 0).alias("other"), F.count_if(F.col("toxic") == 1).alias("bad"))
    return frozenset(r["phrase"] for r in per.filter((F.col("other") >= MIN_DOCS) & (F.col("bad") == 0)).collect())


def _cross_signals(halves: list[Lexicon]):
    """Signals of each document under the lexicon of the half it is not in."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matchers = [Matcher(x) for x in halves]
        for part in parts:
            rows = []
            for text, half in zip(strings(part.column(0)), part.column(1).to_pylist()):
                folded = fold(text)
                rows.append(signals(*matchers[1 - half].total(folded), len(folded.split())))
            yield pa.RecordBatch.from_arrays([part.column(2), part.column(3), pa.array(rows, pa.list_(pa.float64()))], names=["toxic", "doc_id", "signals"])

    return run


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic unit, by Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = 1e-2 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    coefficients: list[float]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | float:
    sample = fit_sample(docs, labels, "toxic", MODULUS, HELD, rows)
    sample = sample.groupBy("text", "label").agg(F.min("doc_id").alias("doc_id"))  # copies are no further evidence
    sample = cut(sample.select("text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), F.col("label").cast("int"), "doc_id"))
    words, (toxic, other) = lexicons(sample)
    if not toxic or not other:
        discard(sample)
        return 1.0 if toxic else 0.0
    exceptions = exception_phrases(sample, words[2])
    cross = [Lexicon(w, exceptions) for w in words[:2]]
    found = sample.mapInArrow(_cross_signals(cross), "toxic int, doc_id long, signals array<double>").toPandas().sort_values("doc_id")
    discard(sample)
    coefficients = calibrate(np.array(found["signals"].tolist()), found["toxic"].to_numpy(float))
    return Model(Lexicon(words[2], exceptions), coefficients.tolist())


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """Every column of ``docs`` (among them text) and toxicity, n_matches."""
    out = docs.drop("toxicity", "n_matches").withColumns({"toxicity": F.lit(0.0), "n_matches": F.lit(0).cast("long")})
    at = out.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(model, float):
            matcher, w = Matcher(Lexicon({}, frozenset())), None
        else:
            matcher, w = Matcher(model.lexicon), np.array(model.coefficients)
        for part in parts:
            x, hits = [], []
            for text in strings(part.column(at)):
                folded = fold(text)
                weight, n = matcher.total(folded)
                x.append(signals(weight, n, len(folded.split())))
                hits.append(n)
            p = np.full(len(x), model) if w is None else 1 / (1 + np.exp(-np.clip(np.array(x).reshape(-1, len(w)) @ w, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[: part.num_columns - 2], pa.array(p, pa.float64()), pa.array(hits, pa.int64())], schema=part.schema)

    return out.mapInArrow(run, out.schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_matches."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    held = (fold_bucket("doc_id", MODULUS) == HELD).alias("held_out")
    return scored.select("doc_id", held, F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "n_matches")
