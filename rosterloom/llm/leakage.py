"""Evaluation passages in a training corpus, found by winnowing.

Both sides are cut into words (letter case, punctuation, white space, line breaks and invisible characters gone). Of
every ``window`` consecutive hashes of ``k`` words the smallest is kept as a fingerprint, so any shared run of
``window + k - 1`` words shares a fingerprint: with k = 6 and window = 7 every run of 12 words is found. Fingerprints
are equality-joined; each hit is then extended over the whole texts and kept if it reaches ``least`` words.

The items are the small side as a rule. Up to ``SMALL_ITEMS`` characters in all (counted before) their fingerprints
travel to the tasks that read the documents: hits are joined and extended where the text is, each text is read once and
nothing but hits is shuffled. Larger item sets take a join of fingerprint tables, after which the documents that were
hit, and only they, are read again.

Defined results: NULL and '' and texts of fewer than ``least`` words leak nothing; a text in a script without blanks is
one word between two marks, so no run is found in it; repeated documents are each reported; repeated items too; empty
tables give no rows; texts are processed whole, whatever their length; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.textnorm import words
from rosterloom.session import cut_lineage

K, WINDOW = 6, 7
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEEN_WORDS = 400_000
#: Characters of all items together up to which they are sent to the tasks (some 20 bytes each there).
SMALL_ITEMS = 8_000_000

HIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("words", T.IntegerType())])


def winnow(texts: list[list[str]], k: int = K, window: int = WINDOW, known: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the text, fingerprint, number of its first word) for the kept fingerprints of several word lists at once."""
    known = {} if known is None else known
    if len(known) > _SEEN_WORDS:
        known.clear()
    flat = [w for t in texts for w in t]
    none = np.empty(0, np.int64)
    if len(flat) < k + window - 1:
        return none, none, none
    for w in set(flat):
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    hashes = np.fromiter((known[w] for w in flat), np.uint64, len(flat))
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    n = len(flat) - k + 1
    grams = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            grams = grams * _BASE + hashes[j : j + n]
        grams ^= grams >> np.uint64(31)
        grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(29)
    m = n - window + 1
    best, at = grams[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, window):
        other = grams[j : j + m]
        better = other <= best
        best[better], at[better] = other[better], j
    whole = owner[:m] == owner[window + k - 2 : window + k - 2 + m]
    places = np.unique(np.arange(m)[whole] + at[whole])
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return owner[places], grams[places].astype(np.int64), places - first[owner[places]]


def extended(doc: list[str], item: list[str], hits: list[tuple[int, int]]) -> int:
    """Length of the longest shared run of words through one of the hits (place in the document, place in the item).

    Hits inside a run that is known already are passed over, so a run is walked once however many hits it has.
    """
    best, reached = 0, {}
    for p, q in sorted(hits):
        if best == len(item):
            break
        if p < reached.get(p - q, -1):
            continue
        a, b, end = p, q, 0
        while a and b and doc[a - 1] == item[b - 1]:
            a, b = a - 1, b - 1
        while p + end < len(doc) and q + end < len(item) and doc[p + end] == item[q + end]:
            end += 1
        reached[p - q] = p + end
        best = max(best, p + end - a)
    return best


class Items:
    """The words of the items and where each of their fingerprints stands."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = [words(r[1]) for r in rows]
        owner, fp, at = winnow(self.words)
        order = np.argsort(fp, kind="stable")
        self.owner, self.fp, self.at = owner[order], fp[order], at[order]

    def hits(self, fp: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(index in ``fp``, item, place in the item) of every equal fingerprint."""
        lo, hi = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
        for n in np.flatnonzero(hi > lo):
            for k in range(lo[n], hi[n]):
                yield int(n), int(self.owner[k]), int(self.at[k])


def _leaks_of(texts: list[list[str]], items: Items, least: int, known: dict) -> list[tuple[int, int, int]]:
    """(index of the text, item, words) of every leak."""
    owner, fp, at = winnow(texts, known=known)
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for n, item, place in items.hits(fp):
        found.setdefault((int(owner[n]), item), []).append((int(at[n]), place))
    runs = ((t, i, extended(texts[t], items.words[i], hits)) for (t, i), hits in found.items())
    return [r for r in runs if r[2] >= least]


def fingerprints(df: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    """(out_id, fp) of every kept fingerprint."""
    schema = T.StructType([T.StructField(out_id, T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = part["id"].to_numpy(np.int64)
                owner, fp, _ = winnow([words(t) for t in part["text"]], known=known)
                yield pd.DataFrame({out_id: ids[owner], "fp": fp}).drop_duplicates()

    return _texts(df, id_col, text_col).mapInPandas(run, schema)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text <> ''")


def _beside_the_text(documents: DataFrame, items: Items, least: int) -> DataFrame:
    """Leaks found in one pass over the documents, the items being in every task."""
    sent = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        here = sent.value
        for batch in batches:
            rows: list[tuple] = []
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                ids = part["id"].tolist()
                rows += [(ids[t], here.ids[i], n) for t, i, n in _leaks_of([words(t) for t in part["text"]], here, least, known)]
            yield pd.DataFrame(rows, columns=HIT.names)

    return _texts(documents, "doc_id", "text").mapInPandas(run, HIT)


def _by_join(documents: DataFrame, items: DataFrame, least: int) -> DataFrame:
    """Leaks by a join of fingerprints; the texts of documents that were hit are then read again and extended."""
    test = cut_lineage(fingerprints(items, "item_id", "item_text", "item_id").distinct())
    pairs = cut_lineage(fingerprints(documents, "doc_id", "text", "doc_id").join(test, "fp").select("doc_id", "item_id").distinct())
    hit = _texts(documents, "doc_id", "text").withColumnRenamed("id", "doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = pairs.join(_texts(items, "item_id", "item_text").select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), "item_id").join(hit, "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, item, text, item_text in batch[["doc_id", "item_id", "text", "item_text"]].itertuples(index=False):
                out += [(doc, item, n) for _, _, n in _leaks_of([words(text)], Items([(item, item_text)]), least, {})]
            yield pd.DataFrame(out, columns=HIT.names)

    return rows.select("doc_id", "item_id", "text", "item_text").mapInPandas(run, HIT)


def leaks(documents: DataFrame, items: DataFrame, least: int = K + WINDOW - 1, small_items: int = SMALL_ITEMS) -> DataFrame:
    """(doc_id, item_id, words): each document with at least ``least`` consecutive words of an item."""
    if least < K + WINDOW - 1:
        raise ValueError("runs shorter than k + window - 1 words are not guaranteed a shared fingerprint")
    texts = _texts(items, "item_id", "item_text")
    if (texts.agg(F.sum(F.length("text"))).first()[0] or 0) <= small_items:
        return _beside_the_text(documents, Items([(r["id"], r["text"]) for r in texts.distinct().collect()]), least)
    return _by_join(documents, items.dropDuplicates(["item_id", "item_text"]), least)
