"""Normal forms of short texts that several operators share."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: What stands for a missing value in free-typed fields, after lower case and outer blanks are gone. Fixed values.
STAND_INS = frozenset({
    "", "-", "--", "---", "–", "—", "_", ".", "..", "...", "…", "?", "??", "???", "*", "/", "x", "xx", "xxx", "n/a", "n.a.", "n.a", "na", "n/d", "n.d.", "nd", "s/n",
    "none", "null", "nil", "nan", "unknown", "unbekannt", "inconnu", "inconnue", "desconocido", "sconosciuto", "tbd", "tba", "tbc", "t.b.d.", "t.b.a.",
    "to be determined", "to be confirmed", "to be announced", "not available", "not applicable", "not given", "not specified", "unspecified", "undefined", "missing",
    "keine angabe", "k.a.", "k. a.", "non précisé", "non renseigné", "sin datos", "no disponible", "non disponibile", "empty", "blank", "(none)", "(unknown)", "(empty)", "#n/a", "vacant",
})


@lru_cache(maxsize=4096)
def _keep(ch: str) -> str:
    """'' for an ignorable character, ' ' for what separates words, else the character."""
    if ch < "\x80":
        return ch if ch.isalnum() else "" if ch in "'`" else " "
    if ch in "’‘ʼ´′＇":
        return ""
    cat = unicodedata.category(ch)
    if cat in ("Cf", "Cc", "Cn", "Co", "Cs"):
        return " " if cat == "Cc" and ch.isspace() else ""
    return " " if cat[0] in "ZP" else ch


def words(text: str | None) -> list[str]:
    """Case-folded words; white space, punctuation and invisible characters are gone, Unicode form is NFKC."""
    if not text:
        return []
    if text.isascii():
        return re.sub(r"[^a-z0-9]+", " ", text.lower().replace("'", "").replace("`", "")).split()
    norm = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return "".join(map(_keep, norm)).split()


def squeezed(text: str | None) -> str:
    """The words of a text without anything between them."""
    return "".join(words(text))


_FOLD = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i", "ħ": "h"})


def fold(text: str) -> str:
    """Case-folded text without accents."""
    if text.isascii():
        return text.casefold()
    out = unicodedata.normalize("NFKD", text.casefold().translate(_FOLD))
    return "".join(c for c in out if not unicodedata.combining(c))
