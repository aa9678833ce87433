"""Operators on groups of records: best of group, first seen, upserts, expiry, folds, redirects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterloom.session import cut_lineage


#: As many rows as there are.
ALL = 2**31 - 1


def number_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Every row with its place in its group, from 1, however large a group is.

    Rows are cut into ranges of (keys, order), so a large group lies in many of them; each piece of a group is numbered by
    itself, and begins where the pieces before it end. Pieces of a group are at most as many as there are ranges. The
    order must tell all rows of a group apart.
    """
    ranged = cut_lineage(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__piece", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "__piece").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*[F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)], F.col("__piece").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__piece") == F.col("__p")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{n}"))
    numbered = ranged.withColumn(name, F.row_number().over(Window.partitionBy("__piece", *keys).orderBy(*order)))
    out = numbered.join(starts, same).withColumn(name, (F.col(name) + F.col("__before")).cast("int"))
    return out.drop("__piece", "__p", "__before", *[f"__k{n}" for n in range(len(keys))])


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first k rows of every group, all for k of 0 or less. Ranks below k are cut before the shuffle (WindowGroupLimit)."""
    if k <= 0 or k >= ALL:
        return number_in_groups(df, keys, order, rank) if rank else df
    name = rank or "__rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = ranked.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def best_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """The columns of the greatest row by ``order``, by one aggregation with map-side combining."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__best")).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in columns])


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every row, with ``duplicate`` telling whether an earlier one of its group exists."""
    return df.withColumn("duplicate", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) > 1)


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], resolve: dict[str, Column]) -> DataFrame:
    """Full outer merge on null-safe keys. ``resolve`` gives each column from ``c`` (current) and ``i`` (incoming)."""
    c, i = current.withColumn("__c", F.lit(True)).alias("c"), incoming.withColumn("__i", F.lit(True)).alias("i")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"c.{k}").eqNullSafe(F.col(f"i.{k}"))
    joined = c.join(i, on, "full_outer")
    picked = [F.when(F.col("c.__c"), F.col(f"c.{k}")).otherwise(F.col(f"i.{k}")).alias(k) for k in keys]
    return joined.select(*picked, *[col.alias(name) for name, col in resolve.items()])


def insert_ignore(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` (first by key) whose key is not there yet, appended."""
    on = F.lit(True)
    fresh = incoming.dropDuplicates(list(keys)).alias("i")
    for k in keys:
        on = on & F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}"))
    return current.unionByName(fresh.join(current.alias("c"), on, "left_anti"))


def unexpired(df: DataFrame, cached_at: Column, as_of: Column, ttl_days: Column | int, zero_means: str = "off") -> DataFrame:
    """Cache rows still alive. A time to live of 0 or less switches the cache off, or keeps rows for ever ("ever")."""
    ttl = ttl_days if isinstance(ttl_days, Column) else F.lit(ttl_days)
    alive = cached_at > as_of - F.make_dt_interval(ttl.cast("int"))
    return df.filter(F.when(ttl > 0, alive).otherwise(F.lit(zero_means == "ever")))


def resolve_redirects(urls: DataFrame, url: str, redirects: DataFrame, hops: int = 3) -> DataFrame:
    """``urls`` with ``final_url``: redirects followed up to ``hops`` times, stopping before an address seen already.

    ``redirects`` is (source_url, target_url), one row per source.
    """
    out = urls.withColumn("final_url", F.col(url)).withColumn("__seen", F.array(F.col(url)))
    for _ in range(hops):
        step = redirects.select(F.col("source_url").alias("__s"), F.col("target_url").alias("__t"))
        out = out.join(step, out["final_url"] == step["__s"], "left")
        go = F.col("__t").isNotNull() & ~F.array_contains("__seen", F.col("__t"))
        out = out.withColumn("final_url", F.when(go, F.col("__t")).otherwise(F.col("final_url"))).withColumn("__seen", F.when(go, F.array_append("__seen", F.col("__t"))).otherwise(F.col("__seen"))).drop("__s", "__t")
    return out.drop("__seen")


def fold_records(df: DataFrame, keys: Sequence[str], ordinal: str, score: str, fields: Sequence[str], lists: Sequence[str] = ()) -> DataFrame:
    """Merge fold in arrival order: a record of strictly higher score takes over, empty fields fall back one by one.

    The fold equals an aggregation: fields come from the non-empty value of the best (score, then earliest) record, and
    lists are united in order of first arrival. So groups are combined map-side, and no group is gathered.
    """
    rank = F.struct(F.col(score), (-F.col(ordinal)).alias("o"))
    best = [F.max_by(F.col(f), F.when(F.coalesce(F.col(f), F.lit("")) != "", rank)).alias(f) for f in fields]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(x)))).alias(x) for x in lists]
    return df.groupBy(*keys).agg(F.max(score).alias(score), F.count("*").alias("merged"), *best, *united)


def line_context(df: DataFrame, id_col: str, text: str, hit: Column, radius: int = 1) -> DataFrame:
    """Lines for which ``hit`` (a condition on column ``line``) holds, each with the lines around it."""
    lines = df.select(F.col(id_col), F.split(F.col(text), "\n").alias("__lines")).select("*", F.posexplode("__lines").alias("line_no", "line"))
    start = F.greatest(F.col("line_no") - radius, F.lit(0))
    around = F.array_join(F.slice(F.col("__lines"), start + 1, F.col("line_no") + radius - start + 1), "\n")
    return lines.filter(hit).select(id_col, "line_no", "line", around.alias("context"))


def sum_maps(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, name, total) of map columns added up by name."""
    return df.select(*keys, F.explode(column).alias("name", "value")).groupBy(*keys, "name").agg(F.sum("value").alias("total"))


def compose_quota(df: DataFrame, group: str, kind: str, order: Sequence[Column], quotas: dict[str, int], limit: int) -> DataFrame:
    """At most ``quotas[kind]`` rows of each kind and ``limit`` rows in all for every group, best first."""
    w = Window.partitionBy(group, kind).orderBy(*order)
    cap = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    kept = df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= F.coalesce(F.try_element_at(cap, F.col(kind)), F.lit(0))).drop("__n")
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("position") <= limit)


def exact_median(df: DataFrame, keys: Sequence[str], column: str, name: str) -> DataFrame:
    """The exact median of a column per group, from counts of its values: no group's rows are gathered.

    Values are counted with map-side combining; running counts over the distinct values find the two in the middle.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__to", F.sum("__n").over(w.orderBy(column))).withColumn("__all", F.sum("__n").over(w))
    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    holds = lambda place: (F.col("__to") >= place) & (F.col("__to") - F.col("__n") < place)
    middle = run.groupBy(*keys).agg(F.max(F.when(holds(low), F.col(column))).alias("__a"), F.max(F.when(holds(high), F.col(column))).alias("__b"))
    return middle.select(*keys, ((F.col("__a") + F.col("__b")) / 2).cast("double").alias(name))
