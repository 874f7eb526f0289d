"""License scans by ordered signature rules over whole texts.

A rule is a regular expression with a label, a priority and the words that open it; ``signatures`` has them,
written by hand. Texts are lower-cased (A-Z) and matched as UTF-8 bytes. A rule runs only where one of its
words occurs. Overlapping detections are settled in the order of priority, then length, then place: a
detection that lies inside one already kept goes, unless it is of a base rule; base rules report every place
where their words stand one after another, and hide only detections of their own label.

Words are runs of ASCII letters and digits and of all bytes above ASCII. Null and empty texts have no
words and no detections. Rows are independent: repeated rows repeat, a very long text is one row like any
other, a null doc_id stays null, an empty table gives an empty table, and other columns are not read.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm import signatures
from proofloom.llm.common import batches, utf8

GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
EDGE = rb"(?<![0-9a-z\x80-\xff])(?:%s)(?![0-9a-z\x80-\xff])"
_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


class Rule(NamedTuple):
    label: str
    pattern: re.Pattern
    priority: int
    confidence: float
    keywords: frozenset[bytes]  # words of which one must occur
    also: frozenset[bytes] = frozenset()  # if any, one of these too
    base: bool = False


def phrase(words: str) -> bytes:
    return EDGE % GAP.join(re.escape(w.encode()) for w in words.split())


def _signature(body: str) -> re.Pattern:
    return re.compile(EDGE % body.encode().replace(b" ?", b"(?:%s)?" % GAP).replace(b" ", GAP), re.DOTALL)


def _lines(table: str) -> Iterator[tuple[str, frozenset[bytes], str]]:
    for line in table.strip().splitlines():
        label, keywords, body = line.split(" ", 2)
        yield label, frozenset(k.encode() for k in keywords.split(",")), body


@functools.lru_cache(maxsize=1)
def ordered_rules() -> list[Rule]:
    """All rules, the base phrases first."""
    made = [Rule(label, re.compile(phrase(words)), 100, 0.9, frozenset([words.split()[0].encode()]), base=True) for words, label in BASE.items()]
    made += [Rule(label, _signature(body), 95, 1.0, keys) for label, keys, body in _lines(signatures.SENTENCES)]
    made += [Rule(label, re.compile(body.encode(), re.DOTALL), 85, 0.9, keys) for label, keys, body in _lines(signatures.ADDRESSES)]
    for form, needed, priority, confidence in signatures.CONTEXTS:
        made += [Rule(label, _signature(form.format(body)), priority, confidence, keys, frozenset(needed.encode().split(b","))) for label, keys, body in _lines(signatures.IDENTIFIERS)]
    made += [Rule(label, _signature(body), 45, 0.75, keys) for label, keys, body in _lines(signatures.NAMES)]
    return made


@functools.lru_cache(maxsize=1)
def rules() -> dict[bytes, list[int]]:
    """Places of the rules in ``ordered_rules`` by the words that open them."""
    by: dict[bytes, list[int]] = {}
    for k, rule in enumerate(ordered_rules()):
        for word in rule.keywords:
            by.setdefault(word, []).append(k)
    return by


class Detection(NamedTuple):
    start: int
    end: int
    rule: Rule


class Cover:
    """Spans none of which lies inside another, so starts and ends both ascend."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def has(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end

    def add(self, start: int, end: int) -> None:
        if not self.has(start, end):
            inner = slice(bisect_left(self.starts, start), bisect_right(self.ends, end))
            self.starts[inner], self.ends[inner] = [start], [end]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def detect(text: bytes, words: list[bytes]) -> list[Detection]:
    """Settled detections of a lower-cased text and its words, by place."""
    every, by = ordered_rules(), rules()
    known = set(words)
    opened = sorted({k for word in by.keys() & known for k in by[word] if not every[k].also or every[k].also & known})
    found = [Detection(m.start(), m.end(), every[k]) for k in opened for m in every[k].pattern.finditer(text)]
    return settle(found)


def settle(found: list[Detection]) -> list[Detection]:
    """What stays of overlapping detections, by place."""
    found = sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.start, d.rule.label))
    hidden, of_base, kept = Cover(), {}, []
    for d in found:
        if d.rule.base:
            of_base.setdefault(d.rule.label, Cover()).add(d.start, d.end)
        else:
            own = of_base.get(d.rule.label)
            if hidden.has(d.start, d.end) or own is not None and own.has(d.start, d.end):
                continue
            hidden.add(d.start, d.end)
        kept.append(d)
    return sorted(kept, key=lambda d: (d.start, d.end, d.rule.label))


def word_places(text: bytes, starts: list[int]) -> list[int]:
    """For ascending byte offsets of word starts, the number of words before each."""
    out, at, words = [], 0, 0
    for start in starts:
        words += len(words_of(text[at:start]))
        out.append(words)
        at = start
    return out


KIND = "doc_id long, n_words long, detections array<struct<label:string,base:boolean,priority:int,confidence:double,word:long,start:long,end:long>>"
SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        (
            "detections",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("base", pa.bool_()),
                        ("priority", pa.int32()),
                        ("confidence", pa.float64()),
                        ("word", pa.int64()),
                        ("start", pa.int64()),
                        ("end", pa.int64()),
                    ]
                )
            ),
        ),
    ]
)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, detections (byte spans, the word they start at, label, priority) of every whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part):
            for i, raw in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                text = raw.lower()
                words = words_of(text)
                found = detect(text, words)
                spans = [
                    {"label": d.rule.label, "base": d.rule.base, "priority": d.rule.priority, "confidence": d.rule.confidence, "word": w, "start": d.start, "end": d.end}
                    for d, w in zip(found, word_places(text, [d.start for d in found]))
                ]
                yield 200 * len(spans), i, len(words), spans

        for part in parts:
            yield from batches(rows(part), SCANNED)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, KIND)


def report(docs: DataFrame) -> DataFrame:
    """Counts, first and last base words, labels and a confidence for each document."""
    base = F.filter("detections", lambda d: d["base"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    places = F.transform(base, lambda d: d["word"])
    return scan(docs).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("detections")).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )
