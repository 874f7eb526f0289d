"""Search of many questions in blocks of texts: no pair of question and text leaves the task that finds it.

A block holds texts of one institution and language, dealt by their ids, as numbers of a vocabulary of its own: one row of
about ``BLOCK_BYTES`` of text. Questions come in slices of about ``SLICE``; each block meets each slice once. A task lists
the places of each word of its block and answers its slice question by question: a match is a set of bits, one a text,
combined word by word; the worth of alternatives is a row of small counts, added up word by word. What leaves the task is
a count and a smallest id, or the k best, for each question; these are combined over the blocks.

So disk and shuffles grow with blocks times slices, never with matching pairs, and nothing is left out or sampled.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofloom.functions import stems
from proofloom.functions import text as tx
from proofloom.functions.lexical import OPERATOR, fts_configuration
from proofloom.sources.stored import stored

BLOCK_BYTES = 24_000_000
SLICE = 65_536
#: A word of at least one text in so many has a row of bits, and of counts, of its own.
DENSE = 32
PLACE = ["institution_id", "language"]
IDS = ["chunk_id", "document_id", "chunk_index"]
GROUP = [*PLACE, "block", "slice"]


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def plain(text: str) -> str:
    """``tx.normalize``, quick for plain letters."""
    return " ".join(text.lower().split()) if text.isascii() else tx.normalize(text)


class _Numbers(dict):
    """Number of each word's lexeme, from 1 in the order they come; 0 for words without content."""

    def __init__(self, configuration: str):
        self.configuration, self.of = configuration, {"": 0}

    def __missing__(self, word: str) -> int:
        self[word] = found = self.of.setdefault(stems.lexeme(word, self.configuration), len(self.of))
        return found


class _Plain(_Numbers):
    """Number of each word as it is, an empty one too."""

    def __init__(self, configuration: str):
        super().__init__(configuration)
        self.of = {None: 0}

    def __missing__(self, word: str) -> int:
        self[word] = found = self.of.setdefault(word, len(self.of))
        return found


def build(chunks: DataFrame, n_bytes: int | None = None) -> DataFrame:
    """Stored blocks of the lexemes of chunks (institution_id, language, chunk_id, document_id, chunk_index, content).

    ``n_bytes``: about how much text the chunks of the largest institution and language have; without it, it is counted.
    """
    if n_bytes is None:
        n_bytes = chunks.groupBy(*PLACE).agg(F.sum(F.octet_length("content")).alias("n")).agg(F.max("n")).first()[0]
    return _dealt(chunks, "content", max(1, -(-(n_bytes or 0) // BLOCK_BYTES)))


def build_sets(sets: DataFrame, n_blocks: int) -> DataFrame:
    """Stored blocks of sets (institution_id, language, chunk_id, document_id, chunk_index, words), their words as they are."""
    return _dealt(sets, "words", n_blocks)


def _dealt(chunks: DataFrame, column: str, n_blocks: int) -> DataFrame:
    kind = {f.name: f.dataType.simpleString() for f in chunks.schema}
    schema = ", ".join([*(f"{c} {kind[c]}" for c in PLACE), "block int", *(f"{c} array<{kind[c]}>" for c in IDS), "vocabulary array<string>", "lengths array<int>", "tokens array<int>"])
    dealt = chunks.select(*PLACE, fts_configuration(F.col("language")).alias("configuration"), F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int").alias("block"), *IDS, column)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        numbers = (_Numbers if column == "content" else _Plain)(table.column("configuration")[0].as_py())
        read = (lambda text: tx.words(plain(text))) if column == "content" else list
        lengths, tokens = [], []
        for batch in table.select([column]).to_batches(4096):
            flat: list[int] = []
            for text in batch.column(0).to_pylist():
                own = [numbers[w] for w in read(text)] if text else []
                lengths.append(len(own))
                flat += own
            tokens.append(np.array(flat, np.int32))
        lists = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        columns = {c: k.cast(table.schema.field(c).type) for c, k in zip(PLACE, (pa.array([x.as_py()]) for x in key[:2]))}
        columns["block"] = pa.array([key[2].as_py()], pa.int32())
        for c in IDS:
            ids = table.column(c).combine_chunks()
            columns[c] = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        columns["vocabulary"] = lists(list(numbers.of)[1:], pa.string())
        columns["lengths"], columns["tokens"] = lists(np.array(lengths, np.int32), pa.int32()), lists(np.concatenate(tokens), pa.int32())
        return pa.table(columns)

    return stored(dealt.groupBy(*PLACE, "block").applyInArrow(pack, schema))


class Block:
    """The texts of a block in the order of ``by``, with the places of each word."""

    def __init__(self, table: pa.Table, by: list[str]):
        one = lambda c: table.column(c)[0].values
        self.ids = {c: one(c) for c in IDS}
        lengths, self.tokens = one("lengths").to_numpy(), one("tokens").to_numpy()
        self.n, self.longest = len(lengths), int(lengths.max(initial=0))
        self.row = np.asarray(pa.compute.sort_indices(pa.table({c: self.ids[c] for c in by}), [(c, "ascending") for c in by]))  # of each place in the order
        slot = np.empty(self.n, np.int32)
        slot[self.row] = np.arange(self.n, dtype=np.int32)
        self.text = np.repeat(slot, lengths)  # of each token
        self.number = {w: i for i, w in enumerate(table.column("vocabulary")[0].as_py(), 1)}
        self.order = np.argsort(self.tokens, kind="stable").astype(np.int32)
        self.start = np.searchsorted(self.tokens[self.order], np.arange(len(self.number) + 2))
        self.held: dict[int, np.ndarray] = {}
        self.width = -(-self.n // 64) * 8
        self.all = np.packbits(np.arange(self.width * 8) < self.n, bitorder="little")

    def places(self, number: int) -> np.ndarray:
        return self.order[self.start[number] : self.start[number + 1]]

    def id(self, column: str, slots: np.ndarray) -> pa.Array:
        return self.ids[column].take(pa.array(self.row[slots]))

    # ---- bits

    def _set(self, texts: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width, np.uint8)
        np.bitwise_or.at(out, texts >> 3, np.left_shift(1, texts & 7).astype(np.uint8))
        return out

    def word(self, number: int) -> np.ndarray:
        """Bits of the texts with a word."""
        if (found := self.held.get(number)) is None:
            found = self._set(self.text[self.places(number)])
            if (self.start[number + 1] - self.start[number]) * DENSE >= self.n:
                self.held[number] = found
        return found

    def phrase(self, words: list[str]) -> np.ndarray | None:
        """Bits of the texts with the words beside each other, an empty one stands for any; none if no text has them."""
        numbers = [(i, self.number.get(w)) for i, w in enumerate(words) if w]
        if any(k is None for _, k in numbers):
            return None
        if len(words) == 1 and numbers:
            return self.word(numbers[0][1])
        if not numbers:  # any words at all, so many of them
            return self._set(np.flatnonzero(np.bincount(self.text, minlength=self.n) >= len(words)))
        at, rarest = min(numbers, key=lambda x: self.start[x[1] + 1] - self.start[x[1]])
        first = self.places(rarest) - at
        first = first[(first >= 0) & (first + len(words) <= len(self.tokens))]
        first = first[self.text[first] == self.text[first + len(words) - 1]]
        for i, k in numbers:
            first = first[self.tokens[first + i] == k]
        return self._set(self.text[first]) if len(first) else None

    def matching(self, query: str) -> np.ndarray | None:
        """Bits of the texts that satisfy a query as ``lexeme_query`` writes it; None if there are none."""
        groups: list[list[str]] = []
        for unit in query.split("\n"):
            if unit[0] == "|" and groups:
                groups[-1].append(unit)
            else:
                groups.append([unit])
        out = None
        for group in groups:
            hit, shared = None, True
            for unit in group:
                bits = self.phrase(unit[2:].split(" "))
                if unit[1] == "-":
                    bits = self.all if bits is None else self.all & ~bits
                if bits is None:
                    continue
                if hit is None:
                    hit = bits
                elif shared:
                    hit, shared = hit | bits, False
                else:
                    hit |= bits
            if hit is None:
                return None
            out = hit if out is None else out & hit
        return out

    # ---- counts

    def worth(self, words: list[str]) -> np.ndarray:
        """Of each text how many of its places hold one of the (distinct) words."""
        kind = np.uint8 if self.longest < 256 else np.uint16 if self.longest < 65536 else np.uint32
        out, rare = np.zeros(self.n, kind), []
        for w in words:
            if (k := self.number.get(w)) is None:
                continue
            if (counts := self.held.get(k)) is None:
                texts = self.text[self.places(k)]
                if len(texts) * DENSE < self.n:
                    rare.append(texts)
                    continue
                counts = self.held[k] = np.bincount(texts, minlength=self.n).astype(kind)
            out += counts
        if rare:
            np.add.at(out, np.concatenate(rare), kind(1))
        return out

    def best(self, words: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Slots and worth of the k texts of most worth over 0, the first ones where it is equal."""
        worth = self.worth(words)
        least, most = 0, int(worth.max(initial=0))
        if not most:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        while least < most:  # the largest worth that k texts reach
            middle = (least + most + 1) // 2
            if np.count_nonzero(worth >= middle) >= k:
                least = middle
            else:
                most = middle - 1
        slots = np.flatnonzero(worth > least)
        if least:
            slots = np.sort(np.concatenate([slots, np.flatnonzero(worth == least)[: k - len(slots)]]))
        own = worth[slots].astype(np.int64)
        return slots, own


_PART = re.compile(r'-?"[^"]*"|-?[^\s"]+')
_NEGATED = re.compile(r'-["\w]')


def lexeme_query(text: str, configuration: str) -> str:
    """A query as ``retrieval.parse_websearch`` and ``postings.lexeme_units`` read it, a line each unit: & or | (alternative of the one before), + or - (negated), the lexemes."""
    lines, before = [], ""
    for part in _PART.findall(text):
        last, before = before, part.lower()
        if before == OPERATOR:
            continue
        words = [stems.lexeme(w, configuration) for w in tx.words(part)]
        full = [i for i, w in enumerate(words) if w]
        if full:
            lines.append(("|" if last == OPERATOR else "&") + ("-" if _NEGATED.match(part) else "+") + " ".join(words[full[0] : full[-1] + 1]))
    return "\n".join(lines)


@F.pandas_udf(StringType())
def _written(texts: pd.Series, configurations: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else lexeme_query(t, c) for t, c in zip(texts, configurations)], dtype=object)


def met(questions: DataFrame, blocks: DataFrame, answer: Callable[[Block, pa.Table], pa.Table], by: list[str], schema: str, size: int | None = None) -> DataFrame:
    """What ``answer`` gives for each block, in the order of ``by``, and each slice of the questions of its institution and language. ``size``: of a slice.

    ``questions``: question_id, institution_id, language and what ``answer`` reads; a stored table.
    """
    n_slices = max(1, -(-questions.count() // (size or SLICE)))
    n_blocks = blocks.groupBy(*PLACE).agg((F.max("block") + 1).alias("n"))
    sliced = questions.withColumn("slice", F.pmod(F.xxhash64("question_id"), F.lit(n_slices)).cast("int"))
    sliced = sliced.join(F.broadcast(n_blocks), PLACE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).drop("n")
    copies = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))))
    empty = _arrow(_parsed(schema)).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return empty
        return answer(Block(left, by), right)

    return copies.groupBy(*GROUP).cogroup(sliced.groupBy(*GROUP)).applyInArrow(run, schema)


def _parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def match_counts(variants: DataFrame, blocks: DataFrame) -> DataFrame:
    """question_id, n_chunks, first_chunk of the variants that match chunks. ``variants``: question_id, institution_id, language, input; one a question."""
    query = _written(F.col("input"), fts_configuration(F.col("language")))
    asked = stored(variants.select("question_id", *PLACE, query.alias("query"))).filter("query <> ''")
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, n_chunks bigint, first_chunk {blocks.schema['chunk_id'].dataType.elementType.simpleString()}"

    def answer(block: Block, questions: pa.Table) -> pa.Table:
        rows, counts, slots = [], [], []
        for i, query in enumerate(questions.column("query").to_pylist()):
            bits = block.matching(query)
            if bits is None or not (n := int(np.bitwise_count(bits.view(np.uint64)).sum())):
                continue
            at = int((bits != 0).argmax())
            rows.append(i), counts.append(n), slots.append(at * 8 + (int(bits[at]) & -int(bits[at])).bit_length() - 1)
        own = questions.column("question_id").combine_chunks().take(pa.array(rows, pa.int64()))
        return pa.table({"question_id": own, "n_chunks": pa.array(counts, pa.int64()), "first_chunk": block.id("chunk_id", np.array(slots, np.int64))})

    each = met(asked, blocks, answer, ["chunk_id"], schema)
    return each.groupBy("question_id").agg(F.sum("n_chunks").alias("n_chunks"), F.min("first_chunk").alias("first_chunk"))


def top_alternatives(questions: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, document_id, chunk_index, worth, rank of the k chunks with most places of any of the lexemes.

    ``questions``: question_id, institution_id, language, lexemes. Ties fall by document_id, chunk_index, chunk_id.
    """
    order = ["document_id", "chunk_index", "chunk_id"]
    some = questions.withColumn("lexemes", F.array_distinct(F.filter("lexemes", lambda t: t != ""))).filter(F.size("lexemes") > 0)
    asked = stored(some.select("question_id", *PLACE, F.array_join("lexemes", " ").alias("query")))
    kind = {c: blocks.schema[c].dataType.elementType.simpleString() for c in IDS}
    entry = "struct<" + ", ".join(["less: int", *(f"{c}: {kind[c]}" for c in order)]) + ">"
    schema = f"question_id {asked.schema['question_id'].dataType.simpleString()}, best array<{entry}>"

    def answer(block: Block, questions: pa.Table) -> pa.Table:
        rows, slots, worths, ends = [], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [0]
        for i, query in enumerate(questions.column("query").to_pylist()):
            own, worth = block.best(query.split(" "), k)
            if len(own):
                rows.append(i), slots.append(own), worths.append(worth), ends.append(ends[-1] + len(own))
        at = np.concatenate(slots)
        parts = [pa.array(-np.concatenate(worths), pa.int32()), *(block.id(c, at) for c in order)]
        best = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["less", *order]))
        return pa.table({"question_id": questions.column("question_id").combine_chunks().take(pa.array(rows, pa.int64())), "best": best})

    each = met(asked, blocks, answer, order, schema).groupBy("question_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    flat = each.select("question_id", F.posexplode("best").alias("at", "b"))
    return flat.select("question_id", *(F.col(f"b.{c}").alias(c) for c in IDS), (-F.col("b.less")).alias("worth"), (F.col("at") + 1).alias("rank"))
