"""Text read in a wrong character encoding: detection and round-trip repair.

A garbled value is re-encoded under the legacy encoding it may have been read in and strictly decoded as the
encoding it was written in. A round trip is accepted when a garbling cost drops; accepted text is tried again, so
that nested layers come off one by one. Values holding U+FFFD, or a question mark between two letters, have lost
characters for good: they are reported as damaged, with as much repaired as can be.

Defined results: NULL and '' are never damaged; ASCII text without an inner question mark is never damaged;
repeated values get equal results; length is unlimited.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERDICT = T.StructType([T.StructField("damaged", T.BooleanType()), T.StructField("repaired", T.StringType()), T.StructField("layers", T.IntegerType())])

# Fixed values: (encoding a value was read in, encoding it was written in). UTF-8 proves itself by its structure, so
# it is tried under every reading; single-byte pairs only where the two code pages are really confused in practice.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "iso8859-2", "cp1254", "koi8-r", "cp866", "iso8859-15", "cp1253", "cp852")
SINGLE_BYTE_PAIRS = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"),
    ("cp1252", "cp437"), ("cp1251", "cp1252"), ("cp1251", "cp1250"), ("cp1252", "cp1251"), ("latin-1", "cp1251"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"),
    ("cp1252", "koi8-r"), ("latin-1", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("mac_roman", "cp1250"), ("cp437", "cp1250"),
    ("cp850", "cp1250"), ("latin-1", "mac_roman"), ("latin-1", "cp850"), ("cp1252", "cp866"), ("cp1253", "cp1252"), ("koi8-r", "cp1252"), ("cp852", "cp1252"),
)
#: Letters beside ASCII that western and central European names and titles use often.
USUAL = frozenset("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþßœšžčřěůćńłżźśąęőűăîșțğıėīūāēķļņģšÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝÞŒŠŽČŘŚŁŻĆ")
FREQUENT = frozenset("éüóíñèäöáçã")
#: Letters that are no word and no initial by themselves.
ALONE_NEVER = frozenset("Ððñûãõâêîïëÿþýß")
SUSPECT = r"[^\x00-\x7F]|\p{L}\?\p{L}"
_LOST = re.compile(r"�|(?<=[^\W\d_])\?(?=[^\W\d_])")
#: A round trip must lower the cost by so much, so text of a lower cost needs none.
_LEAST_DROP = 0.25


@lru_cache(maxsize=8192)
def _kind(ch: str) -> str:
    """L Latin, C Cyrillic, O other letter, m mark, c control, s symbol, p punctuation or space, d digit."""
    cat = unicodedata.category(ch)
    if cat[0] == "L" and cat != "Lm" and ch not in "ªº":
        if ch == "ƒ":
            return "s"
        name = unicodedata.name(ch, "")
        return "L" if name.startswith("LATIN") else "C" if name.startswith("CYRILLIC") else "O"
    if cat == "Cc":
        return "c" if "\x7f" <= ch <= "\x9f" else "p"
    if cat[0] in "SM" or cat in ("No", "Lm", "Lo"):
        return "m" if cat[0] == "M" else "s"
    if ch in "¡¿‚„†‡‰‹›•«»¶§·":
        return "s"
    return "d" if cat == "Nd" else "p"


def cost(text: str) -> float:
    """How garbled a text looks: 0 for plain words of one script, growing with every odd neighbour."""
    total, before, kind_before, run = 0.0, " ", "p", 0
    for i, ch in enumerate(text):
        if ch < "\x80":
            kind = "L" if ch.isalpha() else "d" if ch.isdigit() else "p"
            run = 0
        else:
            kind = _kind(ch)
            if kind == "c" or ch == "�":
                total += 5
            elif kind == "s":
                after = text[i + 1] if i + 1 < len(text) else " "
                total += 3 if kind_before in "LCOs" or after.isalpha() else 0.8
            elif kind == "L":
                run += 1
                total += (0.03 if ch in FREQUENT else 0.06 if ch in USUAL else 0.6) + (1.5 if run > 2 else 0)
                if kind_before == "p" and (i + 1 == len(text) or not text[i + 1].isalnum()) and ch in ALONE_NEVER:
                    total += 1.5
            elif kind == "m":
                total += 0.5
            elif kind == "O":
                total += 0.3 if kind_before in "Op" else 0
            elif ch == "—" and before.isalpha() and text[i + 1 : i + 2].isalpha():
                total += 1.6
            elif ch in "’‘“”–—…" and kind_before in "LC" and before >= "\x80" and run:
                total += 0.4
            if kind == "C" and ch in "ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐ":
                total += 1.0
            if kind != "L":
                run = 0
        if kind in "LCO" and kind_before in "LCO" and kind != kind_before:
            total += 3
        elif kind in "LC" and kind == kind_before and ch.isupper() and before.islower():
            total += 1.5 if ch >= "\x80" or before >= "\x80" else 0.2
        before, kind_before = ch, kind
    return total


def _encode(text: str, codec: str) -> bytes | None:
    """Strict, but for the positions that a code page leaves open: readers pass those through as controls."""
    try:
        return text.encode(codec)
    except UnicodeEncodeError:
        pass
    out = bytearray()
    for ch in text:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not "\x80" <= ch <= "\x9f":
                return None
            out.append(ord(ch))
    return bytes(out)


def _spaces(data: bytes) -> bytes:
    """0xA0 after a UTF-8 lead byte is often turned into a blank on the way; put it back."""
    return re.sub(rb"(?<=[\xc3\xc2])[ ](?![\x80-\xbf])", b"\xa0", data)


def _round_trips(text: str):
    for codec in READ_AS:
        data = _encode(text, codec)
        if data is None:
            continue
        for variant in {data, _spaces(data)} if len(data) else ():
            try:
                yield variant.decode("utf-8"), True
            except UnicodeDecodeError:
                pass
    for codec, written in SINGLE_BYTE_PAIRS:
        data = _encode(text, codec)
        if data is not None:
            try:
                yield data.decode(written), False
            except UnicodeDecodeError:
                pass


def _whole(text: str) -> str | None:
    """The best accepted round trip of a text, None if none lowers the cost enough."""
    was, best = cost(text), None
    foreign = sum(ch > "\x7f" for ch in text)
    if was < _LEAST_DROP:
        return None
    for other, structural in _round_trips(text):
        if other == text or "�" in other or (not structural and was < 0.2 * foreign):
            continue  # letters that cost as little as usual ones do don't ask for another code page
        now = cost(other)
        drop = was - now
        if drop >= (_LEAST_DROP if structural and len(other) < len(text) else max(1.2, 0.6 * was)) and (best is None or (now - 0.5 * structural) < best[0]):
            best = (now - 0.5 * structural, other)
    return None if best is None else best[1]


@lru_cache(maxsize=200_000)
def repair(text: str) -> tuple[bool, str | None, int]:
    """(damaged, repaired text or None where characters are lost for good, layers taken off)."""
    if not text or (text.isascii() and "?" not in text):
        return False, None, 0
    lost = bool(_LOST.search(text))
    now, layers = text, 0
    while True:  # every layer lowers the cost by more than _LEAST_DROP's share, so the layers end
        better = _whole(now) if not lost else None
        if better is None:
            # a value of which one part was touched later: repair the stretches without blanks on their own
            parts = re.split(r"(\s+)", now)
            changed = [(_whole(p) or p) if not p.isascii() and not _LOST.search(p) and len(p) > 1 else p for p in parts]
            better = "".join(changed) if changed != parts and cost("".join(changed)) < cost(now) - 0.25 else None
        if better is None:
            break
        now, layers = better, layers + 1
    return lost or layers > 0, None if lost or not layers else now, layers


def fix(text: str | None) -> str | None:
    """The repaired text where there is one, else the text as it is."""
    return text if text is None else repair(text)[1] or text


@F.pandas_udf(VERDICT)
def _repair_udf(values: pd.Series) -> pd.DataFrame:
    seen: dict = {}
    rows = [seen[v] if v in seen else seen.setdefault(v, repair(v) if isinstance(v, str) else (False, None, 0)) for v in values]
    return pd.DataFrame(rows, columns=["damaged", "repaired", "layers"])


def repair_column(col: Column) -> Column:
    """Struct column (damaged, repaired, layers) of a text column."""
    return _repair_udf(col)


def damaged_values(df: DataFrame, id_col: str, fields: list[str], src: str) -> DataFrame:
    """Rows (src, rec_id, field, original, repaired, layers) for every damaged value of ``fields``.

    Plain ASCII values never leave the JVM: the filter below stands before the Python stage.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("original")) for f in fields]))
    long = df.select(F.col(id_col).cast("bigint").alias("rec_id"), pairs.alias("v")).select("rec_id", "v.field", "v.original")
    suspect = long.filter(F.col("original").rlike(SUSPECT))
    judged = suspect.withColumn("r", repair_column(F.col("original")))
    return judged.filter("r.damaged").select(F.lit(src).alias("src"), "rec_id", "field", "original", F.col("r.repaired").alias("repaired"), F.col("r.layers").alias("layers"))


def repaired_values(values: DataFrame) -> DataFrame:
    """(value, text) of those of ``values`` (value) that can be restored. Only suspect ones reach Python."""
    judged = values.filter(F.col("value").rlike(SUSPECT)).withColumn("r", repair_column(F.col("value")))
    return judged.filter("r.repaired is not null").select("value", F.col("r.repaired").alias("text"))
