"""Records equal but for formatting: canonical form, 128-bit hash, counts with map-side combining.

Defined results: NULL and '' are the same missing value; records with every field missing are copies of one another;
an empty table gives no groups; other columns, whatever their names, are neither read nor returned. Two records whose
128-bit hashes agree but whose second, independent 64-bit hashes differ are different records: both hashes are in the
grouping key, and ``collisions`` reports such pairs.
"""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm.textnorm import squeezed, words
from rosterloom.operators.skew import lookup_join
from rosterloom.session import cut_lineage


def canonical(ordered: list[str | None], unordered: list[str | None]) -> str:
    """Canonical form: of ``unordered`` fields the order of the parts is ignored, of ``ordered`` ones it is not."""
    return "\x1f".join(["".join(sorted(words(x))) for x in unordered] + [squeezed(x) for x in ordered])


def _key_udf(n_unordered: int):
    def keys(*fields: pd.Series) -> pd.Series:
        out = []
        for values in zip(*fields):
            values = [v if isinstance(v, str) else None for v in values]
            form = canonical(values[n_unordered:], values[:n_unordered]).encode("utf-8", "surrogatepass")
            out.append(xxhash.xxh3_128_digest(form) + xxhash.xxh64_digest(form, seed=7))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(keys, T.BinaryType())


def keyed(df: DataFrame, id_col: str, unordered: list[str], ordered: list[str]) -> DataFrame:
    """(rec_id, key) of every record; key: 16 bytes of hash, then 8 bytes of the check hash."""
    fields = [F.col(c).cast("string") for c in unordered + ordered]
    return df.select(F.col(id_col).cast("bigint").alias("rec_id"), _key_udf(len(unordered))(*fields).alias("key"))


def copy_groups(keys: DataFrame) -> DataFrame:
    """One row per distinct record: key, first_id (smallest id), copies (how many records it stands for)."""
    return keys.groupBy("key").agg(F.min("rec_id").alias("first_id"), F.count("*").alias("copies"))


def collapsed(df: DataFrame, id_col: str, unordered: list[str], ordered: list[str]) -> DataFrame:
    """One surviving record per distinct record with its number of copies: (first_id, copies)."""
    return copy_groups(keyed(df, id_col, unordered, ordered)).select("first_id", "copies")


def collisions(groups: DataFrame, least: int = 2) -> DataFrame:
    """(hash, forms, records) of 128-bit hashes that stand for ``least`` canonical forms or more (two are expected nowhere)."""
    return groups.groupBy(F.substring("key", 1, 16).alias("hash")).agg(F.count("*").alias("forms"), F.sum("copies").alias("records")).filter(F.col("forms") >= least)


def copies(df: DataFrame, id_col: str, unordered: list[str], ordered: list[str], hot_rows: int = 200_000) -> DataFrame:
    """(first_id, copy_id) for every record that is a later copy. A group of any size is spread over many tasks."""
    keys = cut_lineage(keyed(df, id_col, unordered, ordered))
    groups = cut_lineage(copy_groups(keys).filter("copies > 1"))
    return lookup_join(keys, groups, "key", "rec_id", "copies", hot_rows).filter("rec_id <> first_id").select("first_id", F.col("rec_id").alias("copy_id"))
