"""Lexical units as Columns: canonical tokens, informative terms and query plans, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS = 12

# Words without content, by language, in normalised form.
FUNCTIONAL = {
    "pt": "a o as os um uma de do da dos das ao aos em no na nos nas pelo pela para por com ate se e ou que "
    "qual quais quando onde como quem sao ser posso pode devo deve",
    "en": "a an the of to in on for with from at and or what which when where how who is are does do can should have has",
}
# Written ordinals from first to tenth.
ORDINALS = {
    "pt": "primeiro segundo terceiro quarto quinto sexto setimo oitavo nono decimo",
    "en": "first second third fourth fifth sixth seventh eighth ninth tenth",
}
# Fixed value: the word that joins alternatives in the query language.
OPERATOR = "or"
#: Priority of the four query variants.
PRIORITY = {"exact": 4, "reduced_and": 3, "canonical_relaxed_and": 2, "reduced_or": 1}

_RANGE = r"\d+\s*(?:a|-|–|—)\s*\d+"
_ORDINAL = {"pt": r"\d+\.?[oa](?![a-z0-9])", "en": r"\d+(?:st|nd|rd|th)(?![a-z0-9])"}


def _written(family: str) -> dict[str, int]:
    found = {w: n for n, w in enumerate(ORDINALS[family].split(), 1)}
    if family == "pt":
        found |= {w[:-1] + "a": n for w, n in list(found.items())}
    return found


def family(language: Column) -> Column:
    """Primary subtag of a language code."""
    return F.split_part(F.replace(F.lower(F.trim(language)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))


def functional_words(language: Column) -> Column:
    """The language's words without content; null where it has no list."""
    whole, primary = F.lower(F.trim(language)), F.split_part(F.lower(F.trim(language)), F.lit("-"), F.lit(1))
    lists = {k: F.split(F.lit(v), " ") for k, v in FUNCTIONAL.items()}
    return reduce(lambda out, k: F.when((whole == k) | (primary == k), lists[k]).otherwise(out), lists, F.lit(None).cast("array<string>"))


def _surfaces(normalized: Column, language: Column) -> Column:
    word = r"[^\W_]+"
    plain = F.regexp_extract_all(normalized, F.lit(f"(?U)({_RANGE}|{word})"), F.lit(0))
    chosen = plain
    for name, pattern in _ORDINAL.items():
        own = F.regexp_extract_all(normalized, F.lit(f"(?U)({_RANGE}|{pattern}|{word})"), F.lit(0))
        chosen = F.when(family(language) == name, own).otherwise(chosen)
    return chosen


def _number(text: Column) -> Column:
    return text.cast("decimal(38,0)").cast("string")


def tokens(normalized: Column, language: Column) -> Column:
    """array<struct<surface, canonical, position, kind, lo, hi>> of a normalised text, left to right.

    A range is one unit with its ends beside it; a written or numeric ordinal is ``ord:N``.
    """
    written = {f: F.str_to_map(F.lit(" ".join(f"{w}:{n}" for w, n in _written(f).items())), F.lit(" "), F.lit(":")) for f in ORDINALS}
    fam = family(language)

    def unit(surface: Column, position: Column) -> Column:
        numeric = F.regexp_extract(surface, r"^(\d+)", 1)
        ends = F.sort_array(F.transform(F.regexp_extract_all(surface, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("decimal(38,0)")))
        is_range = surface.rlike(f"(?U)^{_RANGE}$")
        value = F.lit(None).cast("string")
        for f, pattern in _ORDINAL.items():
            own = F.when(surface.rlike(f"^{pattern}$"), _number(numeric)).otherwise(F.try_element_at(written[f], surface))
            value = F.when(fam == f, own).otherwise(value)
        lo, hi = F.element_at(ends, 1).cast("string"), F.element_at(ends, -1).cast("string")
        kind = F.when(is_range, "range").when(value.isNotNull(), "ordinal").when(surface.rlike(r"(?U)^\d+$"), "number").otherwise("word")
        canonical = F.when(is_range, F.concat(F.lit("rng:"), lo, F.lit("-"), hi)).otherwise(F.coalesce(F.concat(F.lit("ord:"), value), surface))
        return F.struct(
            surface.alias("surface"), canonical.alias("canonical"), position.alias("position"), kind.alias("kind"),
            F.when(is_range, lo).alias("lo"), F.when(is_range, hi).alias("hi"),
        )

    return F.transform(_surfaces(normalized, language), unit)


def is_informative(surface: Column, functional: Column) -> Column:
    letter = (F.length(surface) == 1) & surface.rlike(r"(?U)^\p{L}$")
    return ~letter & (surface != OPERATOR) & ~F.coalesce(F.array_contains(functional, surface), F.lit(False))


def informative_terms(normalized: Column, language: Column) -> Column:
    """Distinct words with content in their order, at most MAX_TERMS."""
    found = F.regexp_extract_all(normalized, F.lit(r"(?U)([^\W_]+)"), F.lit(0))
    return F.slice(F.array_distinct(F.filter(found, lambda t: is_informative(t, functional_words(language)))), 1, MAX_TERMS)


def stream(toks: Column, language: Column) -> Column:
    """Canonical forms of the tokens with content, in order."""
    return F.transform(F.filter(toks, lambda t: is_informative(t["surface"], functional_words(language))), lambda t: t["canonical"])


def query_terms(toks: Column, language: Column) -> Column:
    """Distinct canonical forms with content, at most MAX_TERMS."""
    return F.slice(F.array_distinct(stream(toks, language)), 1, MAX_TERMS)


def contextual_terms(toks: Column, language: Column) -> Column:
    """Distinct surfaces with content that are neither ordinals nor ranges."""
    plain = F.filter(toks, lambda t: ~t["kind"].isin("ordinal", "range") & is_informative(t["surface"], functional_words(language)))
    return F.slice(F.array_distinct(F.transform(plain, lambda t: t["surface"])), 1, MAX_TERMS)


def advanced_syntax(normalized: Column) -> Column:
    """Quotes, the joining word (with or without marks beside it) or a negated word."""
    joined = F.array_contains(F.regexp_extract_all(normalized, F.lit(r"(?U)([^\W_]+)"), F.lit(0)), OPERATOR)
    return normalized.contains('"') | joined | F.exists(F.split(normalized, " "), lambda t: t.rlike(r"^-."))


def plan_variants(normalized: Column, language: Column) -> Column:
    """array<struct<strategy, priority, input>> by priority; empty where nothing has content."""
    toks = tokens(normalized, language)
    informative, contextual = informative_terms(normalized, language), contextual_terms(toks, language)
    raw = F.regexp_extract_all(normalized, F.lit(r"(?U)([^\W_]+)"), F.lit(0))
    marked = F.exists(toks, lambda t: t["kind"].isin("ordinal", "range"))

    def variant(name: str, text: Column, wanted: Column) -> Column:
        return F.when(wanted, F.struct(F.lit(name).alias("strategy"), F.lit(PRIORITY[name]).alias("priority"), text.alias("input")))

    only_exact = advanced_syntax(normalized) | functional_words(language).isNull()
    empty = ~only_exact & (F.size(informative) == 0)
    wide = ~only_exact & ~empty & (F.size(contextual) > 0)
    return F.array_compact(
        F.array(
            variant("exact", normalized, ~empty),
            variant("reduced_and", F.array_join(informative, " "), wide & (informative != raw)),
            variant("canonical_relaxed_and", F.array_join(contextual, " "), wide & marked & (contextual != informative)),
            variant("reduced_or", F.array_join(informative, " OR "), wide & (F.size(informative) >= 2)),
        )
    )


def candidate_limit(top_k: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(20), top_k * 5))


def quota(limit: Column, variants: Column, turn: Column) -> Column:
    """Share of the limit for the variant at ``turn`` (0 first); the remainder goes to the first ones."""
    return F.floor(limit / variants).cast("int") + (turn < limit % variants).cast("int")


def fts_configuration(language: Column) -> Column:
    """Name of the text-search configuration of a language's primary subtag."""
    return F.when(family(language) == "pt", "portuguese").when(family(language) == "en", "english").otherwise("simple")
