"""Texts cut off by a field limit or in transfer.

Evidence, each a column of the result:

* ``longer_copy``: the text is a strict prefix of another text. Texts are bucketed by a hash of their first
  characters; buckets that hold texts of several lengths are sorted by text over range partitions, where a strict
  prefix stands directly before a text that it begins (the last text of a partition is compared with the first of the
  next). Ranges are cut by the beginnings of the texts, longer ones where many texts begin alike. Texts shorter than
  the hashed characters are looked up among the beginnings of all texts at their own lengths;
* ``at_limit``: the text is exactly as long as the longest texts of its source, and at least ``limit_share`` of that
  source's texts stop there;
* ``open_end``: the text stops inside a sentence. A last line of prose without a closing mark does. For list items,
  signatures and texts followed by an ellipsis, the last words (numbers and names masked) must be found as an ending
  elsewhere in the corpus, else the line is a strict prefix of something and was cut.

A cut text on corpora like the test data has no longer copy anywhere, so the prefix join alone can't find the cases;
the corpus of endings is the same idea applied to closing lines. See the README.

Texts are read three times, whole: for their own facts, for the sentence endings they hold, and those of buckets of
several lengths once more to be sorted. All else works on the table of facts.

Defined results: NULL and '' are never cut; repeated texts share one result; texts of any length are processed whole;
an empty table gives no rows; a text that closes a sentence is not cut, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.session import cut_lineage

PREFIX = 32
#: White space and invisible characters that may stand after a text.
_BLANKS = " \n\r\t\f\v\u00a0\u00ad\u200b\u200c\u200d\u2028\u2029\u202f\u3000\ufeff"
#: What may follow the last word of a line. Fixed values.
_CLOSERS = _BLANKS + "!\"#%&'()*,-./:;?@[\\]_{}“”„‟‘’‚‛«»‹›…–—―‐‑‒·•¡¿′″§¶†‡。！？、，；：（）［］｛｝「」『』《》〈〉【】"
#: First length of the beginnings that cut the sort ranges, and the texts beyond which a beginning is doubled.
START, HOT_START = 240, 100_000
#: Texts that must end in a line before it counts as a closing line of its own.
CLOSINGS = 3
#: Distinct endings asked for up to which their list goes to every task (some 50 bytes each).
ASKED = 500_000

_ELLIPSIS = r"[\s\[(]*(?:…|\.{3,}|\[…\]|\[\.{3,}\]?)[\s\])]*$"
#: An ellipsis that stands apart from the last word replaces what was cut; one in place of the full stop does not.
_SPACED = r"\s[\[(]*(?:…|\.{3,})[\s\])]*$"
_CLOSED = r"(?:[.!?。！？][\"”’»)\]*]*|[:;]?[”»\"])\s*$"
#: A closing mark that only abbreviates: an ordinal day of a date, an initial.
_ABBREVIATED = r"(?i)(?:\b(?:am|bis|vom|zum|ab|dem|den)\s+\d{1,2}\.|\b(?:dr|prof|mr|ms|mrs|st|nr|no|bzw|ca|z\.\s?b|vgl|cf|art|dott|sig)\.)\s*$"
_LIST = r"^\s*(?:[•▪◦·*–-]|\d{1,3}[.)]|[a-z][.)])\s+"
_SIGNED = r"^\s*[—–―]\s*\p{Lu}"


def last_line(text: Column) -> Column:
    return F.substring_index(F.rtrim(text, F.lit(_BLANKS)), "\n", -1)


def contact_end(line: Column) -> Column:
    """Whether a line ends in an e-mail address, a web address or a telephone number."""
    bare = F.rtrim(line, F.lit(_BLANKS))
    token = F.substring_index(F.translate(bare, _BLANKS, " " * len(_BLANKS)), " ", -1)
    mail = F.contains(token, F.lit("@")) & F.substring_index(token, "@", -1).rlike(r"^[\w-]+(?:\.[\w-]+)+$") & F.right(F.substring_index(token, "@", 1), F.lit(1)).rlike(r"[\w.+-]")
    digits = F.substring(bare, F.length(F.rtrim(bare, F.lit("0123456789 /().-+"))) + 1, F.length(bare))
    return mail | token.rlike(r"https?://\S") | digits.rlike(r"\+?\d[\d /().-]{5,}\d$")


def ending_key(piece: Column) -> Column:
    """The last three words of a piece of text: numbers as #, capitalised words as N, ^ where it has fewer words."""
    flat = F.translate(F.regexp_replace(piece, _LIST, ""), "\t\u00a0\u202f\u3000\r", "     ")
    bare = F.rtrim(F.when(F.contains(flat, F.lit("  ")), F.regexp_replace(flat, " +", " ")).otherwise(flat), F.lit(_CLOSERS))
    tail = F.substring_index(F.concat(F.lit("^ ^ "), F.ltrim(bare)), " ", -3)
    tail = F.regexp_replace(tail, r"(?<=[\s^])\S*\d\S*", "#")
    return F.regexp_replace(tail, r"(?<!\S)[\p{P}]*\p{Lu}[^\s]*", "N")


def last_two(key: Column) -> Column:
    return F.substring_index(key, " ", -2)


def known_endings(df: DataFrame, asked: DataFrame, least: int = 2) -> DataFrame:
    """Those of ``asked`` (ending) that close sentences, or lines that another line follows, in at least ``least`` distinct texts.

    A piece of text counts under its last three words and under its last two.
    """
    pieces = df.select(F.xxhash64("text").alias("h"), F.split(F.regexp_replace("text", r"(\D[.!?…]|\d{3}[.!?…])[ \t]+", "$1\n"), "\n").alias("pieces"))
    # the last piece of a text counts if it is closed
    closed = F.element_at("pieces", -1).rlike(_CLOSED)
    kept = pieces.select("h", F.explode(F.when(closed, F.col("pieces")).otherwise(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0))))).alias("piece"))
    ends = kept.filter("trim(piece) <> ''").filter(~F.substring("piece", -4, 4).rlike(r"(?<!\d)\d{1,2}\.$")).select("h", ending_key(F.col("piece")).alias("key"))
    both = ends.select("h", F.explode(F.array_distinct(F.array("key", last_two(F.col("key"))))).alias("ending"))
    few = asked.count() <= ASKED
    if few:  # a list of checked size: what nobody asks for goes no further
        both = both.join(F.broadcast(asked), "ending", "left_semi")
    # two distinct texts are enough, and the smallest and largest hash show them with map-side combining
    found = both.groupBy("ending").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b" if least > 1 else "true").select("ending")
    return found if few else found.join(asked, "ending", "left_semi")


def _neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, longer) of texts that begin the next one; of the first and last text of the partition also pid, side and text."""
    before, first, pid = None, None, TaskContext.get().partitionId()
    for batch in batches:
        found = []
        for text, h in zip(batch["text"], batch["h"]):
            if before is None:
                first = (text, h)
            elif text != before[0] and text.startswith(before[0]):
                found.append((before[1], h, pid, "in", None))
            before = (text, h)
        yield pd.DataFrame(found, columns=EDGE.names)
    if before is not None:
        yield pd.DataFrame([(first[1], None, pid, "first", first[0]), (before[1], None, pid, "last", before[0])], columns=EDGE.names)


EDGE = T.StructType([T.StructField("h", T.LongType()), T.StructField("longer", T.LongType()), T.StructField("pid", T.IntegerType()), T.StructField("side", T.StringType()), T.StructField("edge", T.StringType())])


def short_prefixes(texts: DataFrame) -> DataFrame:
    """Hashes (h) of texts of under ``PREFIX`` characters that are a strict prefix of another."""
    short = texts.filter(F.length("text") < PREFIX).select("text", "h").distinct()
    lengths = [r["n"] for r in short.select(F.length("text").alias("n")).distinct().collect()]  # at most PREFIX
    if not lengths:
        return short.select("h")
    begun = texts.select(F.explode(F.array(*map(F.lit, lengths))).alias("n"), "text").filter(F.length("text") > F.col("n"))
    return short.join(begun.select(F.expr("substring(text, 1, n)").alias("text")).distinct(), "text", "left_semi").select("h")


def bucket_of(text: Column) -> Column:
    return F.xxhash64(F.substring(text, 1, PREFIX))


def _ranged(chosen: DataFrame, hot_start: int) -> DataFrame:
    """(text, h) with ``start``, the beginning that places a text in the sort order: doubled where too many begin alike.

    Where a beginning is doubled, it is for all texts that have it; so the order of the beginnings is that of the texts.
    """
    size = START
    keyed = chosen.withColumn("start", F.substring("text", 1, size))
    while True:
        hot = cut_lineage(keyed.filter(F.length("start") == size).groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") > hot_start).select("start"))
        if hot.limit(1).count() == 0:
            return keyed
        size *= 2
        again = keyed.join(hot.withColumn("hot", F.lit(True)), "start", "left")
        keyed = cut_lineage(again.select("text", "h", F.when(F.col("hot"), F.substring("text", 1, size)).otherwise(F.col("start")).alias("start")))


def strict_prefixes(texts: DataFrame, buckets: DataFrame | None = None, hot_start: int = HOT_START) -> DataFrame:
    """Hashes (h) of texts that are a strict prefix of another; ``texts`` is (text, h), each text once or more.

    ``buckets`` has (bucket, len) of the texts where that is known.
    """
    spark = texts.sparkSession
    buckets = texts.select(bucket_of(F.col("text")).alias("bucket"), F.length("text").alias("len")) if buckets is None else buckets
    several = buckets.groupBy("bucket").agg(F.min("len").alias("lo"), F.max("len").alias("hi")).filter("lo < hi").select("bucket")
    chosen = cut_lineage(texts.withColumn("bucket", bucket_of(F.col("text"))).join(several, "bucket", "left_semi").select("text", "h").dropDuplicates(["h"]))
    # the sample that fixes the ranges holds beginnings, not whole texts
    pairs = cut_lineage(_ranged(chosen, hot_start).repartitionByRange("start").select("text", "h").sortWithinPartitions("text").mapInPandas(_neighbours, EDGE))
    pids = sorted(r["pid"] for r in pairs.filter("side = 'last'").select("pid").collect())  # one number per partition
    following = spark.createDataFrame([(a, b) for a, b in zip(pids, pids[1:])], "pid int, next int")
    last = pairs.filter("side = 'last'").select("pid", "h", "edge").join(following, "pid")
    first = pairs.filter("side = 'first'").select(F.col("pid").alias("next"), F.col("edge").alias("after"))
    across = last.join(first, "next").filter("after <> edge and startswith(after, edge)").select("h")
    return pairs.filter("side = 'in'").select("h").unionByName(across).unionByName(short_prefixes(texts)).distinct()


FACTS = ("doc_id", "source", "h", "len", "bucket", "kind", "item", "ellipsis", "ending", "line")


def facts(documents: DataFrame) -> DataFrame:
    """What each text says by itself, one row per document: the columns of ``FACTS``."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), F.length("text").alias("len"), bucket_of(F.col("text")).alias("bucket"), last_line(F.col("text")).alias("last"))
    ends = rows.withColumn("item", F.col("last").rlike(_LIST)).withColumn("ellipsis", F.col("last").rlike(_ELLIPSIS))
    ends = ends.withColumn("bare", F.when(F.col("ellipsis"), F.regexp_replace("last", _ELLIPSIS, "")).otherwise(F.col("last")))
    closed = F.col("bare").rlike(_CLOSED) & ~F.col("bare").rlike(_ABBREVIATED)
    ends = ends.withColumn(
        "kind",
        F.when(F.trim("last") == "", "empty").when(closed, "closed").when(~F.col("ellipsis") & contact_end(F.col("bare")), "contact").when(F.col("bare").rlike(_SIGNED) & ~F.col("ellipsis"), "signed")
        .when(F.col("ellipsis") & F.col("last").rlike(_SPACED), "prose")
        .when(F.col("item") | F.col("ellipsis") | (F.size(F.split(F.trim("bare"), r"\s+")) <= 4), "ask").otherwise("prose"),
    )
    key = ending_key(F.col("bare"))
    ends = ends.withColumn("ending", F.when(F.col("kind") == "ask", F.when(F.col("item"), last_two(key)).otherwise(key))).withColumn("line", F.when(F.col("kind") == "ask", F.xxhash64(F.lower(F.trim("bare")))))
    return ends.select(*FACTS)


def judged(documents: DataFrame, limit_share: float = 0.01, limit_texts: int = 3) -> DataFrame:
    """(doc_id, source, longer_copy, at_limit, open_end, cut) for every document."""
    rows = cut_lineage(facts(documents))
    texts = documents.select(F.col("text").cast("string").alias("text")).filter("text <> ''")
    lengths = rows.groupBy("source", "len", "h").agg(F.count("*").alias("n")).groupBy("source", "len").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    per = lengths.groupBy("source").agg(F.max(F.struct("len", "texts")).alias("top"), F.sum("texts").alias("all"))
    limits = per.filter((F.col("top.texts") >= limit_texts) & (F.col("top.texts") >= limit_share * F.col("all"))).select(F.col("source").alias("s"), F.col("top.len").alias("limit"))

    ask, others = rows.filter("kind = 'ask'"), rows.filter("kind <> 'ask'")
    inner = known_endings(texts, cut_lineage(ask.select("ending").distinct())).withColumn("inner", F.lit(True))
    # a short last line of prose is mostly a sentence just begun: of such only a person's name is known by its shape
    masked_counts = F.col("item") | F.col("ellipsis") | (F.col("ending") == "^ N N")
    # closing lines such as offices and list items end several texts letter for letter
    closing = ask.filter("not ellipsis").select("line", "h").distinct().groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= CLOSINGS).select("line", F.lit(True).alias("closing"))
    ask = ask.join(inner, "ending", "left").join(closing, "line", "left").withColumn("known", F.coalesce("closing", F.when(masked_counts, F.col("inner")), F.lit(False)))
    longer = strict_prefixes(texts.select("text", F.xxhash64("text").alias("h")), rows.filter("len > 0").select("bucket", "len")).withColumn("longer_copy", F.lit(True))
    out = ask.select(*FACTS, "known").unionByName(others.select(*FACTS, F.lit(True).alias("known"))).join(longer, "h", "left").join(limits, F.col("source").eqNullSafe(F.col("s")), "left")
    at_limit = F.coalesce(F.col("len") == F.col("limit"), F.lit(False)) & ~F.col("kind").isin("closed", "empty")
    open_end = (F.col("kind") == "prose") | ((F.col("kind") == "ask") & ~F.col("known"))
    out = out.select("doc_id", "source", F.coalesce("longer_copy", F.lit(False)).alias("longer_copy"), at_limit.alias("at_limit"), open_end.alias("open_end"), "kind", ((F.col("kind") == "ask") & ~F.col("item") & ~F.col("ellipsis") & ~F.startswith("ending", F.lit("^"))).alias("begun"))
    # a short last line of prose has the length of a signature; at the limit of its source it is a sentence just begun
    begun = F.col("at_limit") & F.coalesce(F.col("begun"), F.lit(False))
    return out.withColumn("cut", F.col("open_end") | begun | (F.col("longer_copy") & ~F.col("kind").isin("closed", "contact", "signed", "empty")))


def cut_documents(documents: DataFrame) -> DataFrame:
    return judged(documents).filter("cut").select("doc_id")


def rates(documents: DataFrame) -> DataFrame:
    """How often each source truncates: (source, documents, cut, rate)."""
    per = judged(documents).groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("cut").cast("bigint")).alias("cut"))
    return per.withColumn("rate", F.round(F.col("cut") / F.col("documents"), 6))
