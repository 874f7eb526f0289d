"""Reading order of recognised words: lines by vertical overlap, columns by wide gaps, cells that run on.

Each page is a group of bounded size, so its words are handled together in one Arrow batch.
"""

from __future__ import annotations

from statistics import median
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

# Overlap and centre shares, gap factors, and limits for joining lines.
OVERLAP, CENTRE = 0.45, 0.35
GAP_CHARS, GAP_LINES, OUTLIER = 3.0, 1.0, 2.75
NEXT_GAP, LEFT, RIGHT = 0.8, 0.6, 0.35


class Word(NamedTuple):
    text: str
    left: float
    top: float
    width: float
    height: float

    @property
    def middle(self) -> float:
        return self.top + self.height / 2


class Line:
    """Words that share a band of the page; centre and height are medians."""

    def __init__(self, word: Word):
        self.words = [word]

    @property
    def centre(self) -> float:
        return median(w.middle for w in self.words)

    @property
    def height(self) -> float:
        return median(w.height for w in self.words)

    def fit(self, word: Word) -> tuple[float, float] | None:
        """(overlap, minus distance) where the word belongs to the band."""
        top, bottom = self.centre - self.height / 2, self.centre + self.height / 2
        shared = min(bottom, word.top + word.height) - max(top, word.top)
        part = shared / max(1e-9, min(self.height, word.height))
        distance = abs(self.centre - word.middle)
        return (part, -distance) if part >= OVERLAP or distance <= CENTRE * max(self.height, word.height) else None

    def cells(self) -> list[list[Word]]:
        row = sorted(self.words, key=lambda w: (w.left, w.top))
        gaps = [b.left - a.left - a.width for a, b in zip(row, row[1:])]
        normal = [g for g in gaps if g >= 0]
        char = median(w.width / max(1, len(w.text)) for w in row)
        limit = max(GAP_CHARS * char, GAP_LINES * self.height)
        if len(normal) > 2:
            limit = max(limit, OUTLIER * median(normal))
        out = [[row[0]]]
        for gap, word in zip(gaps, row[1:]):
            out.append([word]) if gap > limit else out[-1].append(word)
        return out


def page_lines(words: list[Word]) -> list[str]:
    """Text lines from top to bottom, columns separated by a bar. A word without width or height counts as one unit wide or high; none is lost."""
    lines: list[Line] = []
    for word in sorted((w._replace(width=max(1, w.width), height=max(1, w.height)) for w in words if w.text.strip()), key=lambda w: (w.middle, w.left)):
        fits = [(fit, -i) for i, line in enumerate(lines) if (fit := line.fit(word))]
        if fits:
            lines[-max(fits)[1]].words.append(word)
        else:
            lines.append(Line(word))
    lines.sort(key=lambda x: x.centre)
    cells = [line.cells() for line in lines]
    text = [[" ".join(w.text for w in cell) for cell in row] for row in cells]
    used: set[int] = set()
    for i in range(len(lines) - 1):
        row, after = cells[i], cells[i + 1]
        if i in used or len(row) != 1 or len(after) < 2:
            continue
        high = max(lines[i].height, lines[i + 1].height)
        gap = lines[i + 1].centre - lines[i].centre - high
        edge = lambda cell: max(w.left + w.width for w in cell)
        aligned = abs(row[0][0].left - after[0][0].left) <= LEFT * high
        as_wide = edge(row[0]) <= after[1][0].left + RIGHT * high
        if gap <= NEXT_GAP * high and aligned and as_wide:
            text[i + 1][0] = f"{text[i][0]} {text[i + 1][0]}"
            used.add(i)
    return [" | ".join(t) for i, t in enumerate(text) if i not in used]


def reconstruct(words: DataFrame) -> DataFrame:
    """document_id, page_number, line_index, line from words with text, left, top, width, height."""

    def page(group: pd.DataFrame) -> pd.DataFrame:
        found = page_lines([Word(*row) for row in group[["text", "left", "top", "width", "height"]].itertuples(index=False)])
        first = group.iloc[0]
        return pd.DataFrame({"document_id": first["document_id"], "page_number": first["page_number"], "line_index": range(len(found)), "line": found})

    return words.groupBy("document_id", "page_number").applyInPandas(page, "document_id long, page_number int, line_index int, line string")
