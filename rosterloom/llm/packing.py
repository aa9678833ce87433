"""Documents packed into containers of fixed capacity, by a vector bin packing heuristic with dot products.

Sizes are vectors: tokens of a public tokenizer, segments (one per text or piece) and loss-bearing tokens (the tokens
after a text's first line, which serves as its prompt; a text of one line bears loss throughout). A container holds at
most ``capacity`` tokens, ``max_segments`` segments and ``max_loss`` loss-bearing tokens. Only texts above the capacity
are split, into pieces of exactly the capacity and a last one; every token is in exactly one container.

Sizes are few: items of equal size vector are interchangeable, so they are first counted. Packing runs over counts of
sizes in ``shards`` that hold about ``shard_items`` items each (pieces counted, for every capacity by itself), chosen by
a hash; the open container of a shard takes, of all sizes that fit, the one with the greatest dot product of item and
remaining room, or one that closes it exactly. Since every shard holds thousands of items, the unused space of its last
containers is a fraction of a percent. Shards are independent, so the work is spread over as many tasks as there are
shards; no shard grows with the corpus.

Defined results: NULL and '' have no tokens and get no container; equal texts are packed each; an empty table gives no
rows; capacities come from the table of containers (NULL or below 1 are left out), each packed on its own; an item that
has more loss-bearing tokens than the limit by itself gets a container of its own; extra columns are ignored.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Path of a vocabulary file of ranks; the default is one of the public ones of this machine.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SHARD_ITEMS = 20_000
#: Container kinds are a list of parameters; a table of more is an error, not a plan.
MAX_KINDS = 1000
#: Without another limit, a container may hold one segment per so many tokens of capacity (and at least 16).
SEGMENT_TOKENS = 32

ITEM = T.StructType([T.StructField(n, t) for n, t in (("capacity", T.IntegerType()), ("label", T.StringType()), ("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start_token", T.IntegerType()), ("tokens", T.IntegerType()), ("loss_tokens", T.IntegerType()), ("container", T.StringType()))])
SIZED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("tokens", T.IntegerType()), T.StructField("loss_tokens", T.IntegerType())])


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def sized(documents: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(doc_id, tokens, loss_tokens) of every text that has tokens. The vocabulary file travels to the executors."""
    context = documents.sparkSession.sparkContext
    if os.path.isfile(vocabulary):
        context.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(name)
        enc = encoder(sent if os.path.isfile(sent) else vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                n = len(enc.encode_ordinary(text))
                head, newline, _ = text.partition("\n")
                prompt = len(enc.encode_ordinary(head + newline)) if newline else 0
                rows.append((doc, n, max(0, n - prompt)))
            yield pd.DataFrame(rows, columns=SIZED.names)

    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text <> ''")
    return texts.mapInPandas(run, SIZED)


def kinds(containers: DataFrame) -> list[tuple[int, str | None]]:
    """(capacity, label) of the table of containers, each once."""
    rows = containers.select(F.col("capacity_tokens").cast("int").alias("capacity"), F.col("label").cast("string").alias("label")).filter("capacity >= 1").distinct().take(MAX_KINDS + 1)
    if len(rows) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    return sorted(((r["capacity"], r["label"]) for r in rows), key=repr)


def pieces(sizes: DataFrame, caps: list[tuple[int, str | None]]) -> DataFrame:
    """Items for every capacity: whole texts, and pieces of those above it."""
    every = F.array(*[F.struct(F.lit(c).alias("capacity"), F.lit(label).cast("string").alias("label")) for c, label in caps]) if caps else F.expr("cast(array() as array<struct<capacity: int, label: string>>)")
    items = sizes.filter("tokens > 0").withColumn("k", F.explode(every)).select("doc_id", "tokens", "loss_tokens", "k.capacity", "k.label")
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
    start = F.col("piece") * F.col("capacity")
    size = F.least(F.col("capacity"), F.col("tokens") - start)
    prompt = F.col("tokens") - F.col("loss_tokens")
    loss = F.greatest(F.lit(0), start + size - F.greatest(start, prompt))
    return items.select("capacity", "label", "doc_id", "piece", start.alias("start_token"), size.cast("int").alias("tokens"), loss.cast("int").alias("loss_tokens"))


def pack(sizes: list[tuple[int, int]], capacity: int, max_segments: int, max_loss: int) -> list[int]:
    """The container number of every item (tokens, loss tokens), by the greatest dot product with the remaining room."""
    by_tokens: dict[int, list[tuple[int, int]]] = {}
    for i, (tokens, loss) in enumerate(sizes):
        by_tokens.setdefault(tokens, []).append((loss, i))
    for group in by_tokens.values():
        group.sort()  # of items of equal tokens only the one of most loss tokens that fit can be the best
    order = sorted(by_tokens)
    where, number, left = [-1] * len(sizes), 0, len(sizes)
    unit, loss_unit = 1 / capacity**2, 1 / max_loss**2
    while left:
        room, segments, loss_room = capacity, max_segments, max_loss
        while segments and order:
            at = bisect_right(order, room) - 1
            best, chosen, place = -1.0, -1, 0
            a, b = room * unit, loss_room * loss_unit
            # sizes from large to small: once the tokens alone can't reach the best product, the rest can't either
            while at >= 0:
                tokens = order[at]
                if tokens * a + min(tokens, loss_room) * b <= best:
                    break
                group = by_tokens[tokens]
                k = len(group) - 1 if group[-1][0] <= loss_room else bisect_right(group, (loss_room, left + len(sizes))) - 1
                if k >= 0:
                    product = tokens * a + group[k][0] * b
                    if tokens == room:  # closes the container exactly: worth more than any product
                        chosen, place = tokens, k
                        break
                    if product > best:
                        best, chosen, place = product, tokens, k
                at -= 1
            if chosen < 0:
                break
            group = by_tokens[chosen]
            loss, item = group.pop(place)
            where[item] = number
            left -= 1
            if not group:
                del by_tokens[chosen]
                del order[bisect_right(order, chosen) - 1]
            room, segments, loss_room = room - chosen, segments - 1, loss_room - loss
        number += 1
    return where


def assigned(documents: DataFrame, containers: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, shard_items: int = SHARD_ITEMS, max_segments: int | None = None, loss_share: float = 1.0) -> DataFrame:
    """One row per item: capacity, label, doc_id, piece, start_token, tokens, loss_tokens, container.

    ``loss_share`` limits loss-bearing tokens to that share of the capacity (1.0: as many as there are tokens).
    """
    if not 0 < loss_share <= 1:
        raise ValueError("loss_share must be above 0 and at most 1")
    from rosterloom.session import cut_lineage

    sizes = cut_lineage(sized(documents, vocabulary))
    caps = kinds(containers)
    items = pieces(sizes, caps)
    # shards by items, not by texts: one long text is many pieces
    values = sorted({c for c, _ in caps})
    counts = sizes.filter("tokens > 0").agg(*[F.sum(F.ceil(F.col("tokens") / c)).alias(f"n{c}") for c in values]).first() if caps else {}
    shards = F.lit(1)
    for c in values:
        shards = F.when(F.col("capacity") == c, F.lit(max(1, -(-(counts[f"n{c}"] or 0) // shard_items)))).otherwise(shards)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, shard = int(key[0]), int(key[2])
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable")
        # a piece whose loss tokens exceed the limit on their own gets a container to itself: it can't be made smaller
        limit = max(1, int(loss_share * capacity))
        loss = pdf["loss_tokens"].clip(upper=limit)
        number = pack(list(zip(pdf["tokens"].tolist(), loss.tolist())), capacity, max_segments or max(16, capacity // SEGMENT_TOKENS), limit)
        return pdf.assign(container=[f"{capacity}-{shard}-{n}" for n in number])[ITEM.names]

    spread = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.col("piece")), shards))
    return spread.groupBy("capacity", "label", "shard").applyInPandas(run, ITEM)


def usage(assignment: DataFrame) -> DataFrame:
    """Containers, items and unused space by capacity."""
    per = assignment.groupBy("capacity", "label", "container").agg(F.sum("tokens").alias("used"), F.count("*").alias("items"))
    out = per.groupBy("capacity", "label").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return out.withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6))
