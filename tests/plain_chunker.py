"""The chunker once more, as plain Python over one text: what the Column version must equal."""

import re
from itertools import groupby
from typing import NamedTuple

from proofloom.operators.chunking import COLUMNS, FALLBACK, LIST_ITEM, MARKDOWN_HEADING, NUMBERED_HEADING, OVERLAP, PAGE, SIZE, STRUCTURED

_BREAK = re.compile(r"\r\n|\r|\n")
_GAP = re.compile(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)")


class Piece(NamedTuple):
    start: int
    end: int
    page: int
    kind: str
    section: str | None


def _line_kind(line: str, before: bool, after: bool, rest: bool) -> str:
    if COLUMNS in line:
        return "table_row"
    if re.match(LIST_ITEM, line):
        return "list_item"
    letters = [c for c in line if c.isalpha()]
    shouted = len(letters) >= 3 and sum(map(str.isupper, letters)) >= 0.8 * len(letters)
    alone = before and after and rest and 1 <= len(line.split()) <= 8 and len(line) <= 80 and line[-1] not in ".!?;,"
    marked = re.match(MARKDOWN_HEADING, line) or re.match(NUMBERED_HEADING, line)
    return "heading" if marked or alone or (len(line) <= 120 and (shouted or line.endswith(":"))) else "paragraph"


def pieces(text: str) -> list:
    """Headings, rows and items line by line, and paragraphs as runs of lines."""
    base = 0
    for page, body in enumerate(text.split(PAGE), 1):
        spans, at = [], 0
        for stop, following in [(m.start(), m.end()) for m in _BREAK.finditer(body)] + [(len(body), len(body))]:
            raw = body[at:stop]
            bare = raw.strip()
            first = base + at + len(raw) - len(raw.lstrip()) if bare else base + at
            if bare or stop < len(body) or at < len(body) or not spans:
                spans.append((first, bare))
            at = following
        last = max((i for i, (_, bare) in enumerate(spans) if bare), default=-1)
        section, kinds = None, []
        for i, (first, bare) in enumerate(spans):
            if bare:
                before, after = i == 0 or not spans[i - 1][1], i + 1 < len(spans) and not spans[i + 1][1]
                kinds.append((_line_kind(bare, before, after, i < last), first, first + len(bare), bare))
            else:
                kinds.append(("blank", first, first, ""))
        for (kind, _), run in groupby(enumerate(kinds), key=lambda e: (e[1][0], e[0] if e[1][0] != "paragraph" else -1)):
            own = [row for _, row in run]
            if kind == "blank":
                continue
            if kind == "heading":
                section = own[0][3]
            yield Piece(own[0][1], own[-1][2], page, kind, section)
        base += len(body) + 1


def windows(text: str, start: int, end: int, size: int, overlap: int) :
    """Windows of at most ``size`` over a long piece, cut at the last line break, else blank, past the overlap."""
    at = start
    while at < end:
        stop = min(at + size, end)
        if stop < end:
            zone = text[at + overlap : stop]
            found = max((m.end() for m in _BREAK.finditer(zone)), default=0) or max(zone.rfind(" "), zone.rfind("\t")) + 1
            stop = at + overlap + found if found else stop
        yield at, stop
        if stop == end and at + size >= end:
            return
        at = max(stop - overlap, at + 1)


def chunk_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple]:
    """(start, end, page, section, structure type, strategy) of each chunk."""
    out: list[tuple] = []
    held: list[Piece] = []

    def put(start: int, end: int, like: Piece, kind: str, strategy: str) -> None:
        body = text[start:end]
        if bare := body.strip():
            first = start + len(body) - len(body.lstrip())
            out.append((first, first + len(bare), like.page, like.section, kind, strategy))

    def release() -> None:
        if held:
            kind = held[0].kind
            put(held[0].start, held[-1].end, held[0], "list_block" if kind == "list_item" and len(held) > 1 else kind, STRUCTURED)
            held.clear()

    for piece in pieces(text):
        if piece.end - piece.start > size:
            release()
            for a, b in windows(text, piece.start, piece.end, size, overlap):
                put(a, b, piece, "fallback_fragment", FALLBACK)
            continue
        if piece.kind in ("heading", "table_row"):
            release()
            put(piece.start, piece.end, piece, piece.kind, STRUCTURED)
            continue
        if held:
            last = held[-1]
            apart = piece.kind == "list_item" and _GAP.search(text[last.end : piece.start])
            if (last.page, last.section, last.kind) != (piece.page, piece.section, piece.kind) or apart or piece.end - held[0].start > size:
                release()
        held.append(piece)
    release()
    return out
