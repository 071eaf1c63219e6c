"""Column expressions for text: folding, tokens, clean-up and truncation. All of them stay inside the JVM."""

from __future__ import annotations

import html.entities
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv


def _decomposable_letters() -> tuple[str, str]:
    """Every Latin letter whose canonical decomposition is one base letter plus marks, and that base letter."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != letter:
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


_MARKED, _UNMARKED = _decomposable_letters()
_RETRIEVAL_FROM = "".join(fv.RETRIEVAL_ACCENTS.values())
_RETRIEVAL_TO = "".join(base * len(forms) for base, forms in fv.RETRIEVAL_ACCENTS.items())


def words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fold_grouping(text: Column) -> Column:
    """Lower case without accents; letters that do not decompose are kept."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_replace(F.translate(lowered, _MARKED, _UNMARKED), r"\p{Mn}", "")


def fold_retrieval(text: Column) -> Column:
    """Lower case ASCII: known accented letters become their base, any other non-ASCII character a space."""
    out = F.translate(F.lower(F.coalesce(text, F.lit(""))), _RETRIEVAL_FROM, _RETRIEVAL_TO)
    for ligature, letters in fv.RETRIEVAL_LIGATURES.items():
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    out = F.regexp_replace(out, "[\\u0300-\\u036f]", "")
    return F.regexp_replace(out, "[^\\x00-\\x7f]", " ")


def grouping_tokens(text: Column, stop: list[str] | None = None) -> Column:
    """Distinct words of four or more characters, in order, without stop words."""
    found = F.regexp_extract_all(fold_grouping(text), F.lit("[a-z0-9]{4,}"), F.lit(0))
    return F.array_except(found, words(fv.GROUPING_STOP_WORDS if stop is None else stop))


_RETRIEVAL_WORD = f"[a-z0-9]{{4,}}|(?<![a-z0-9])(?:{'|'.join(fv.RETRIEVAL_SHORT_TERMS)})(?![a-z0-9])"


def retrieval_tokens(text: Column) -> Column:
    """Distinct words of four or more characters plus the kept acronyms, in order, without stop words."""
    found = F.regexp_extract_all(fold_retrieval(text), F.lit(_RETRIEVAL_WORD), F.lit(0))
    return F.array_except(found, words(fv.RETRIEVAL_STOP_WORDS))


def topic_terms(text: Column) -> Column:
    return F.array_except(retrieval_tokens(text), words(fv.GENERIC_TERMS))


def squeeze(text: Column) -> Column:
    """One line, single spaces, no blanks at the ends; any Unicode white space counts."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
_AMPERSANDS = ["&amp;", "&#38;", "&#x26;", "&#X26;"]


def decode_entities(text: Column) -> Column:
    """Named (Latin-1 and the usual symbols) and numeric entities; unknown names stay as written."""
    named = F.create_map(*[F.lit(x) for name, code in html.entities.name2codepoint.items() for x in (name, chr(code))])

    def character(entity: Column) -> Column:
        body = F.substring(entity, F.lit(2), F.length(entity) - 2)
        is_hex = F.lower(F.substring(body, 1, 2)) == "#x"
        code = F.when(is_hex, F.conv(F.substring(body, 3, 8), 16, 10)).when(
            body.startswith("#"), F.substring(body, 2, 8)
        ).cast("int")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        from_code = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(valid, from_code).otherwise(F.coalesce(F.try_element_at(named, body), entity))

    found = F.array_except(F.array_distinct(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))), words(_AMPERSANDS))
    decoded = F.aggregate(found, text, lambda acc, e: F.replace(acc, e, character(e)))
    for form in _AMPERSANDS:  # last, so that an escaped entity is not decoded twice
        decoded = F.replace(decoded, F.lit(form), F.lit("&"))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def clean(text: Column) -> Column:
    """Tags out, entities decoded, control and direction characters out, white space squeezed."""
    without_tags = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    decoded = decode_entities(without_tags)
    visible = F.regexp_replace(decoded, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\u202a-\\u202e\\u2066-\\u2069]", "")
    return squeeze(visible)


def cut_at_word(text: Column, limit: int, strip: str = ",;:.- ") -> Column:
    """First ``limit`` characters up to the last blank, trailing punctuation off, with an ellipsis."""
    head = F.regexp_replace(F.substring(text, 1, limit), " [^ ]*$", "")
    tidy = F.rtrim(head, F.lit(strip))
    return F.concat(tidy, F.lit("…"))


def short(text: Column, limit: int = fv.MAX_DESC) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(cut_at_word(text, limit))


def short_description(text: Column, limit: int = 220) -> Column:
    """Drop a closing "read more at X", then cut at the last sentence end after 80 characters, else at a word."""
    trimmed = F.trim(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), fv.READ_MORE_TAIL, ""))
    head = F.substring(trimmed, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.{80,}[.!?]) ", 1)
    return (
        F.when(F.length(trimmed) <= limit, trimmed)
        .when(sentence != "", sentence)
        .otherwise(cut_at_word(trimmed, limit, ",;:"))
    )


def blank_if_repeats(desc: Column, title: Column) -> Column:
    """A description that only repeats the title helps nobody."""
    repeats = F.startswith(F.lower(desc), F.substring(F.lower(title), 1, 40))
    return F.when(repeats & (F.length(desc) < F.length(title) + 20), F.lit("")).otherwise(desc)


def title_key(source: Column, title: Column) -> Column:
    """Source plus lower-cased title; accented letters act as separators on purpose."""
    return F.concat(source, F.lit("|"), F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def bad_title_reason(title: Column) -> Column:
    """Why a title cannot stand as a headline, or an empty string."""
    t = F.trim(F.coalesce(title, F.lit("")))
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    return (
        F.when(F.length(t) < 12, "short")
        .when(t.rlike(fv.PLACEHOLDER_TITLE), "placeholder")
        .when(t.rlike(r"^https?://\S+$"), "address")
        .when(letters < F.length(t) * 0.5, "few letters")
        .otherwise("")
    )


def prefix_pattern(keywords: list[str]) -> str:
    """Alternation that matches the start of a word only."""
    return r"\b(?:" + "|".join(_quote(k).replace(" ", r"\s+") for k in keywords) + ")"


def whole_word_pattern(values: list[str]) -> str:
    longest_first = sorted(values, key=len, reverse=True)
    return "(?<![a-z0-9])(?:" + "|".join(_quote(v) for v in longest_first) + ")(?![a-z0-9])"


def plain_fold(value: str) -> str:
    """The grouping fold for configuration words, applied once while the plan is built."""
    return "".join(c for c in unicodedata.normalize("NFD", value.lower()) if unicodedata.category(c) != "Mn")


def _quote(value: str) -> str:
    return "".join("\\" + c if c in r".+*?()[]{}|^$\\-" else c for c in value)


def is_relevant(text: Column, prefixes: list[str] | None = None, acronyms: list[str] | None = None) -> Column:
    """A listed word start in the folded text, or a listed acronym with its exact capitals."""
    starts = prefix_pattern([plain_fold(w) for w in (fv.RELEVANCE_PREFIXES if prefixes is None else prefixes)])
    names = "|".join(_quote(a) for a in (fv.RELEVANCE_ACRONYMS if acronyms is None else acronyms))
    exact = f"(?<![A-Za-zÀ-ÿ])(?:{names})(?![A-Za-zÀ-ÿ])"
    return fold_grouping(text).rlike(starts) | F.coalesce(text, F.lit("")).rlike(exact)


def many_capitals(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"[^\p{Lu}\p{Ll}]", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}", ""))
    return (letters >= 20) & (capitals / letters > 0.4)


def repeats_title(summary: Column, title: Column) -> Column:
    """At least 85 % of the summary's terms are in the title, or it brings at most two new ones."""
    both = F.array(F.struct(retrieval_tokens(summary).alias("said"), retrieval_tokens(title).alias("known")))  # found once for all conditions

    def repeats(terms: Column) -> Column:
        n, common = F.size(terms["said"]), F.size(F.array_intersect(terms["said"], terms["known"]))
        return (n == 0) | (common / n >= 0.85) | (n - common <= 2)

    return F.transform(both, repeats)[0]
