"""Text functions, Column to Column, all inside whole-stage code generation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks by the letter they stand for. Fixed values.
_MARKED = {
    "a": "àáâãäåāăąǎ", "c": "çćĉċč", "d": "ďđ", "e": "èéêëēĕėęě", "g": "ĝğġģǧ", "h": "ĥ", "i": "ìíîïĩīĭįıǐ", "j": "ĵ", "k": "ķ", "l": "ĺļľł", "n": "ñńņň", "o": "òóôõöøōŏőǒ",
    "r": "ŕŗř", "s": "śŝşšș", "t": "ţťț", "u": "ùúûüũūŭůűųǔ", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
_FROM = "".join(_MARKED.values())
_TO = "".join(plain * len(marked) for plain, marked in _MARKED.items())
#: Letters of a name token, joined by one apostrophe, dot or hyphen at most.
TOKEN = r"[\p{L}]+(?:['’`.-][\p{L}]+)*"


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def collapse_blanks(col: Column) -> Column:
    """Runs of white space, no-break spaces included, as one blank; none outside."""
    return F.btrim(F.regexp_replace(col, "[\\s ]+", " "))


def word_tokens(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(TOKEN), F.lit(0))


def fold_accents(col: Column) -> Column:
    """Lower case, Latin accents gone."""
    plain = F.replace(F.replace(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), F.lit("œ"), F.lit("oe")), F.lit("æ"), F.lit("ae"))
    return F.regexp_replace(F.translate(plain, _FROM, _TO), r"\p{M}+", "")


def alnum_key(col: Column) -> Column:
    """Accent-free letters and digits, words joined by one blank."""
    return F.btrim(F.regexp_replace(fold_accents(col), "[^a-z0-9]+", " "))


def slug(col: Column, limit: int = 80) -> Column:
    return F.substring(F.regexp_replace(F.btrim(col), "[^A-Za-z0-9]+", "_"), 1, limit)


def safe_country(col: Column) -> Column:
    """Letters only, in capitals, three at most."""
    return F.substring(F.upper(F.regexp_replace(col, "[^A-Za-z]", "")), 1, 3)


def latin_repaired(col: Column) -> Column:
    """Text read as Latin-1 though written in UTF-8, decoded anew; text that isn't so is left as it is.

    Only text with a sign of such reading, made of Latin-1 characters alone, whose bytes are valid UTF-8, is changed.
    """
    latin = F.when(col.rlike("[\u00c2\u00c3\u00e2]") & col.rlike("^[\\u0000-\\u00ff]*$"), F.encode(col, "ISO-8859-1").cast("string"))
    return F.when(latin.isNotNull() & F.is_valid_utf8(latin), latin).otherwise(col)


def fix_capitals(col: Column) -> Column:
    """Name tokens of capitals only (longer than two letters) with one capital."""
    one = lambda t: F.when((F.length(t) > 2) & (t == F.upper(t)) & (t != F.lower(t)), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1000)))).otherwise(t)
    return F.array_join(F.transform(F.split(col, " "), one), " ")


def token_estimate(col: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text_or_empty(col)) / 4)).cast("int")


def content_signature(col: Column, chars: int = 2500) -> Column:
    """SHA-1 of the beginning of the normalised text. A fixed-length signature is the feature, not a shortcut."""
    return F.sha1(F.substring(F.lower(collapse_blanks(text_or_empty(col))), 1, chars).cast("binary"))


def joined_hash(*cols: Column) -> Column:
    """SHA-256 of the parts joined by two bars, missing parts as ''."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def contains_any(haystack: Column, terms: list[str]) -> Column:
    """Whether the text holds one of the terms as a substring. One alternation: a test per term would make plans large."""
    if not terms:
        return F.lit(False)
    return haystack.rlike("|".join(re.escape(t) for t in dict.fromkeys(terms)))


def count_terms(haystack: Column, terms: list[str]) -> Column:
    total = F.lit(0)
    for term in terms:
        total = total + F.contains(haystack, F.lit(term)).cast("int")
    return total
