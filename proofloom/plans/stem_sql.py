"""English stems in SQL, step by step from the published description: the twin of ``functions.stems`` for DuckDB."""

from __future__ import annotations

from proofloom.functions import stems

_VOWEL = "[aeiouy]"


def _quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _but(n: int, w: str = "w") -> str:
    """A word without its last letters."""
    return f"left({w}, length({w}) - {n})"


def _short(w: str) -> str:
    return f"(regexp_matches({w}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches({w}, '^[aeiouy][^aeiouy]$'))"


def _endings(table: dict[str, str], region: str, more: dict[str, str]) -> str:
    """Of all endings the longest that the word has is replaced, if it lies within the region; ``more`` has endings with rules of their own."""
    parts = []
    for end in sorted([*table, *more], key=len, reverse=True):
        done = more[end] if end in more else f"{_but(len(end))} || '{table[end]}'"
        parts.append(f"WHEN ends_with(w, '{end}') THEN CASE WHEN length(w) - {len(end)} >= {region} THEN {done} ELSE w END")
    return f"CASE {' '.join(parts)} ELSE w END"


def _region(w: str) -> str:
    rest = f"'^.*?{_VOWEL}[^aeiouy](.*)$'"
    return f"CASE WHEN regexp_matches({w}, {rest}) THEN length({w}) - length(regexp_extract({w}, {rest}, 1)) ELSE length({w}) END"


def english(words: str) -> str:
    """A query for word, lexeme of the distinct words that ``words`` selects as word."""
    fixed = " ".join(f"WHEN word = '{a}' THEN '{b}'" for a, b in stems._EXCEPTIONS.items())
    start = (
        f"SELECT word, CASE WHEN length(word) <= 2 OR word IN ({_quoted(sorted(stems._INVARIANT))}) THEN word {fixed} END AS known, "
        rf"regexp_replace(word, '(^|{_VOWEL})y', '\1Y', 'g') AS w FROM (SELECT DISTINCT word FROM ({words}))"
    )
    prefix = "'^(gener|commun|arsen)'"
    first = f"SELECT *, CASE WHEN regexp_matches(w, {prefix}) THEN length(regexp_extract(w, {prefix})) ELSE {_region('w')} END AS p1 FROM ({start})"
    second = f"SELECT *, p1 + {_region('substr(w, p1 + 1)')} AS p2 FROM ({first})"
    plural = (
        f"CASE WHEN ends_with(w, 'sses') THEN {_but(2)} WHEN ends_with(w, 'ied') OR ends_with(w, 'ies') THEN CASE WHEN length(w) > 4 THEN {_but(2)} ELSE {_but(1)} END "
        f"WHEN ends_with(w, 's') AND NOT regexp_matches(w, '[us]s$') AND regexp_matches({_but(2)}, '{_VOWEL}') THEN {_but(1)} ELSE w END"
    )
    kept = "CASE WHEN known IS NULL AND w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') THEN w ELSE known END"
    doubled = "|".join(stems._DOUBLES)
    opened = (
        f"CASE WHEN regexp_matches(st, '(at|bl|iz)$') THEN st || 'e' WHEN regexp_matches(st, '({doubled})$') THEN {_but(1, 'st')} WHEN {_short('st')} AND p1 >= length(st) THEN st || 'e' ELSE st END"
    )
    cut = "CASE WHEN regexp_matches(w, '(ingly|edly|ing|ed)$') THEN left(w, length(w) - length(regexp_extract(w, '(ingly|edly|ing|ed)$'))) ELSE '' END"
    past = (
        f"CASE WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(w) - length(regexp_extract(w, 'eed(?:ly)?$')) >= p1 THEN left(w, length(w) - length(regexp_extract(w, 'eed(?:ly)?$'))) || 'ee' ELSE w END "
        f"WHEN regexp_matches(st, '{_VOWEL}') THEN {opened} ELSE w END"
    )
    last_y = f"CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$') THEN {_but(1)} || 'i' ELSE w END"
    two = _endings(stems._STEP2, "p1", {"ogi": f"CASE WHEN ends_with(w, 'logi') THEN {_but(1)} ELSE w END", "li": f"CASE WHEN regexp_matches(w, '[cdeghkmnrt]li$') THEN {_but(2)} ELSE w END"})
    three = _endings(stems._STEP3, "p1", {"ative": f"CASE WHEN length(w) - 5 >= p2 THEN {_but(5)} ELSE w END"})
    four = _endings(dict.fromkeys(stems._STEP4, ""), "p2", {"ion": f"CASE WHEN regexp_matches(w, '[st]ion$') THEN {_but(3)} ELSE w END"})
    five = (
        f"CASE WHEN ends_with(w, 'e') AND (length(w) - 1 >= p2 OR (length(w) - 1 >= p1 AND NOT {_short(_but(1))})) THEN {_but(1)} WHEN ends_with(w, 'll') AND length(w) - 1 >= p2 THEN {_but(1)} ELSE w END"
    )
    step = lambda expression, source: f"SELECT word, known, p1, p2, {expression} AS w FROM ({source})"
    body = step(plural, second)
    body = f"SELECT word, {kept} AS known, p1, p2, w, {cut} AS st FROM ({body})"
    body = step(past, body)
    for expression in (last_y, two, three, four, five):
        body = step(expression, body)
    return f"SELECT word, coalesce(known, lower(w)) AS lexeme FROM ({body})"
