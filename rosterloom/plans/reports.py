"""Comparison reports over extraction methods.

Result rows are taken from ``lineitem``: method = return flag, organisation = supplier, kept = line number, extracted =
quantity, cost = extended price, seconds = tax; ``l_linestatus`` tells two data sets apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.operators.records import exact_median, sum_maps, top_per_group
from rosterloom.session import table

METHODS = ["A", "N", "R"]


def results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("dataset"), F.col("l_suppkey").alias("org"), F.col("l_linenumber").alias("kept"), F.col("l_quantity").alias("extracted"), F.col("l_extendedprice").alias("cost"), F.col("l_tax").alias("seconds"), F.col("l_partkey").alias("part"))


_R = "(select l_orderkey id, l_returnflag \"method\", l_linestatus dataset, l_suppkey org, l_linenumber kept, l_quantity extracted, l_extendedprice cost, l_tax secs, l_partkey part from lineitem)"


def total(col: str | Column) -> Column:
    """Sum of a float column that does not depend on the order of addition: added up as exact decimals."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast("decimal(18,4)")).cast("double")


def _sum(col: str) -> str:
    return f"sum({col}::decimal(18,4))::double"


def method_summary(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return r.groupBy("method").agg(
        F.count("*").alias("n"), F.sum("kept").alias("kept"), total("extracted").alias("extracted"), F.round(total("cost"), 2).alias("cost"), F.count_if(F.col("kept") >= 3).alias("good"),
        F.count_if(F.col("kept") < 3).alias("poor"), F.round(F.count_if(F.col("kept") >= 3) / F.count("*"), 6).alias("success_rate"), F.round(F.sum("kept") / F.count("*"), 6).alias("kept_avg"), F.round(total("extracted") / F.count("*"), 6).alias("extracted_avg"))


def method_stats(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    g = r.groupBy("method").agg(F.sum("kept").alias("kept"), F.bround(F.sum("kept") / F.count("*"), 2).alias("kept_mean"), F.count("*").alias("n"))
    return g.join(exact_median(r, ["method"], "kept", "kept_median"), "method").join(exact_median(r, ["method"], "seconds", "seconds_median"), "method")


def success_rate(spark: SparkSession, d: str) -> DataFrame:
    return results(spark, d).groupBy("method").agg(F.round(100 * F.count_if(F.col("kept") >= 3) / F.count("*"), 1).alias("success_pct"))


def cost_efficiency(spark: SparkSession, d: str) -> DataFrame:
    """Cost and time per strong result; NULL where there is none."""
    r = results(spark, d).groupBy("method", "org").agg(total("cost").alias("cost"), total("seconds").alias("seconds"), F.count_if(F.col("kept") >= 7).alias("strong"))
    return r.select("method", "org", F.round(F.try_divide("cost", "strong"), 4).alias("cost_per"), F.round(F.try_divide("seconds", "strong"), 9).alias("seconds_per"))


def precision_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Mean of row ratios and ratio of sums; rows with nothing extracted take no part in the mean."""
    r = results(spark, d).withColumn("p", F.when(F.col("extracted") > 0, (F.col("kept") / F.col("extracted")).cast("decimal(20,12)")))
    return r.groupBy("method").agg(F.round(F.sum("p").cast("double") / F.count("p"), 6).alias("mean_ratio"), F.round(F.try_divide(F.sum("kept").cast("double"), total("extracted")), 6).alias("ratio_of_sums"))


def method_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Composite of shares of kept, cost and time and the success rate; totals by a window over the three groups."""
    g = results(spark, d).groupBy("method").agg(F.sum("kept").alias("kept"), total("cost").alias("cost"), total("seconds").alias("seconds"), (F.count_if(F.col("kept") >= 3) / F.count("*")).alias("rate"))
    every = Window.partitionBy()
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(every)), F.lit(0.0))
    scored = g.withColumn("score", F.round(0.4 * share("kept") + 0.2 * F.col("rate") + 0.2 * (1 - share("cost")) + 0.2 * (1 - share("seconds")), 6))
    return scored.select("method", "score", F.rank().over(Window.orderBy(F.col("score").desc())).alias("place"))


def method_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Organisation by method, kept in total; the list of methods is given, so one aggregation does it."""
    return results(spark, d).groupBy("org").pivot("method", METHODS).agg(F.sum("kept")).select("org", *[F.col(m).alias(f"kept_{m.lower()}") for m in METHODS])


def dataset_compare(spark: SparkSession, d: str) -> DataFrame:
    g = results(spark, d).groupBy("dataset", "method").agg(F.round(F.sum("kept") / F.count("*"), 6).alias("kept_avg"), F.count_if(F.col("extracted") > 10).alias("with_candidates"), F.count("*").alias("n"))
    return g.withColumn("pct", F.round(100 * F.col("with_candidates") / F.col("n"), 3))


def all_methods_failed(spark: SparkSession, d: str) -> DataFrame:
    """Parts for which every method has a poor row."""
    poor = results(spark, d).filter("kept <= 2").groupBy("part").agg(F.countDistinct("method").alias("methods"))
    return poor.filter(F.col("methods") == len(METHODS)).select("part")


def kept_per_extracted(spark: SparkSession, d: str) -> DataFrame:
    """Ratio of sums per data set, and against that of the first data set (one scalar row)."""
    g = results(spark, d).groupBy("dataset").agg((F.sum("kept") / total("extracted")).alias("ratio"))
    base = g.agg(F.min_by("ratio", "dataset").alias("base"))
    return g.crossJoin(base).select("dataset", F.round("ratio", 6).alias("ratio"), F.round(F.col("ratio") / F.col("base"), 6).alias("against_first"))


def failure_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first ten organisations of each method that have a poor row."""
    poor = results(spark, d).filter("kept = 1").select("method", "org").distinct()
    return top_per_group(poor, ["method"], [F.col("org")], 10, "position")


def variant_delta(spark: SparkSession, d: str) -> DataFrame:
    """Each method's total against the baseline method, overall and by organisation."""
    g = results(spark, d).groupBy("org", "method").agg(F.sum("kept").alias("kept"))
    base = F.max(F.when(F.col("method") == "A", F.col("kept"))).over(Window.partitionBy("org"))
    return g.withColumn("delta", F.col("kept") - F.coalesce(base, F.lit(0))).select("org", "method", "kept", "delta")


def variant_summary(spark: SparkSession, d: str) -> DataFrame:
    per = variant_delta(spark, d)
    return per.groupBy("method").agg(F.sum("kept").alias("kept"), F.sum("delta").alias("delta"), F.count_if(F.col("delta") > 0).alias("better"), F.count_if(F.col("delta") < 0).alias("worse"), F.max("delta").alias("best_gain"))


def top_gains(spark: SparkSession, d: str) -> DataFrame:
    return variant_delta(spark, d).filter("method <> 'A'").orderBy(F.col("delta").desc(), "org", "method").limit(10)


STRATEGIES = ["mailto", "html_attribute", "embedded_json", "visible_text", "explicit_obfuscation", "js_decode", "llm_structured"]


def strategy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows per strategy and institution type of country, zero where a known strategy has none."""
    dim = spark.createDataFrame([(s,) for s in STRATEGIES], "strategy string")
    counts = table(spark, d, "contacts").groupBy(F.col("evidence_type").alias("strategy")).agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(counts, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n"))


def map_merge_sum(spark: SparkSession, d: str) -> DataFrame:
    """Map columns added up by name, per user."""
    ev = table(spark, d, "events").select("user_id", F.from_json("props", "map<string,bigint>").alias("props"))
    return sum_maps(ev, ["user_id"], "props")


def best_by_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Of every user, the event with the greatest value; the first on ties."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best_event"), F.max("value").alias("best_value"))


def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent event type of every user; on ties the one seen first."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return n.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", -F.col("first"))).alias("mode"), F.max("n").alias("n"))


def source_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per source: documents, characters, first language by address, first and last crawl."""
    t = table(spark, d, "documents")
    return t.groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.min_by("lang", F.when(F.col("lang").isNotNull(), F.struct("url", "doc_id"))).alias("first_lang"), F.min(F.unix_micros("crawled_at")).alias("first_crawl"), F.max(F.unix_micros("crawled_at")).alias("last_crawl"))


def dashboard_kpis(spark: SparkSession, d: str) -> DataFrame:
    r = results(spark, d)
    return r.agg(F.countDistinct("org").alias("orgs"), F.sum("kept").alias("kept"), F.round(F.sum("kept") / F.count("*"), 6).alias("kept_avg"), *[F.sum(F.when(F.col("method") == m, F.col("kept")).otherwise(0)).alias(f"kept_{m.lower()}") for m in METHODS])


def institution_samples(spark: SparkSession, d: str) -> DataFrame:
    """Contacts per institution and the three of smallest id."""
    c = table(spark, d, "contacts")
    n = c.groupBy("institution_id").agg(F.count("*").alias("contacts"))
    first = top_per_group(c.select("institution_id", "contact_id"), ["institution_id"], [F.col("contact_id")], 3).groupBy("institution_id").agg(F.array_join(F.array_sort(F.collect_list("contact_id")), ",").alias("sample"))
    return n.join(first, "institution_id")


def risk_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ranked_contacts").groupBy(F.coalesce(F.lower(F.trim("confidence")), F.lit("")).alias("confidence")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc())


_DELTA = f"select org, \"method\", kept, kept - coalesce(max(case when \"method\" = 'A' then kept end) over (partition by org), 0) delta from (select org, \"method\", sum(kept) kept from {_R} group by all)"

QUERIES = {
    "method_summary": (method_summary, f"select \"method\", count(*) n, sum(kept) kept, {_sum('extracted')} extracted, round({_sum('cost')}, 2) \"cost\", count(*) filter (kept >= 3) good, count(*) filter (kept < 3) poor, round((count(*) filter (kept >= 3))::double / count(*), 6) success_rate, round(sum(kept)::double / count(*), 6) kept_avg, round({_sum('extracted')} / count(*), 6) extracted_avg from {_R} group by 1"),
    "method_stats": (method_stats, f"select \"method\", sum(kept) kept, round_even(sum(kept)::double / count(*), 2) kept_mean, median(kept) kept_median, median(secs) seconds_median, count(*) n from {_R} group by 1"),
    "success_rate": (success_rate, f"select \"method\", round(100.0::double * (count(*) filter (kept >= 3)) / count(*), 1) success_pct from {_R} group by 1"),
    "cost_efficiency": (cost_efficiency, f"select \"method\", org, case when strong > 0 then round(\"cost\" / strong, 4) end cost_per, case when strong > 0 then round(secs / strong, 9) end seconds_per from (select \"method\", org, {_sum('cost')} \"cost\", {_sum('secs')} secs, count(*) filter (kept >= 7) strong from {_R} group by all)"),
    "precision_by_method": (precision_by_method, f"select \"method\", round(sum(p)::double / count(p), 6) mean_ratio, round(sum(kept)::double / {_sum('extracted')}, 6) ratio_of_sums from (select *, case when extracted > 0 then (kept / extracted)::decimal(20,12) end p from {_R}) group by 1"),
    "method_ranking": (method_ranking, f"select \"method\", score, rank() over (order by score desc) place from (select \"method\", round(0.4 * kept / sum(kept) over () + 0.2 * rate + 0.2 * (1 - \"cost\" / sum(\"cost\") over ()) + 0.2 * (1 - secs / sum(secs) over ()), 6)::double score from (select \"method\", sum(kept)::double kept, {_sum('cost')} \"cost\", {_sum('secs')} secs, (count(*) filter (kept >= 3))::double / count(*) rate from {_R} group by 1))"),
    "method_pivot": (method_pivot, f"select org, sum(kept) filter (\"method\" = 'A') kept_a, sum(kept) filter (\"method\" = 'N') kept_n, sum(kept) filter (\"method\" = 'R') kept_r from {_R} group by 1"),
    "dataset_compare": (dataset_compare, f"select dataset, \"method\", round(sum(kept)::double / count(*), 6) kept_avg, count(*) filter (extracted > 10) with_candidates, count(*) n, round(100.0::double * (count(*) filter (extracted > 10)) / count(*), 3) pct from {_R} group by all"),
    "all_methods_failed": (all_methods_failed, f"select part from {_R} where kept <= 2 group by part having count(distinct \"method\") = 3"),
    "kept_per_extracted": (kept_per_extracted, f"with g as (select dataset, sum(kept)::double / {_sum('extracted')} ratio from {_R} group by 1) select dataset, round(ratio, 6) ratio, round(ratio / (select arg_min(ratio, dataset) from g), 6) against_first from g"),
    "failure_samples": (failure_samples, f"select \"method\", org, position from (select \"method\", org, row_number() over (partition by \"method\" order by org) position from (select distinct \"method\", org from {_R} where kept = 1)) where position <= 10"),
    "variant_delta": (variant_delta, _DELTA),
    "variant_summary": (variant_summary, f"select \"method\", sum(kept) kept, sum(delta) delta, count(*) filter (delta > 0) better, count(*) filter (delta < 0) worse, max(delta) best_gain from ({_DELTA}) group by 1"),
    "top_gains": (top_gains, f"select * from ({_DELTA}) where \"method\" <> 'A' order by delta desc, org, \"method\" limit 10"),
    "strategy_counts": (strategy_counts, "select strategy, count(contact_id) n from (select unnest([" + ", ".join(f"'{s}'" for s in STRATEGIES) + "]) strategy) left join contacts on evidence_type = strategy group by 1"),
    "map_merge_sum": (map_merge_sum, "select user_id, 'k' \"name\", sum((props->>'k')::bigint) total from events group by 1"),
    "best_by_argmax": (best_by_argmax, "select user_id, arg_max(event_id, (value, -event_id)) best_event, max(value) best_value from events group by 1"),
    "mode_first_seen": (mode_first_seen, "select user_id, arg_max(event_type, (n, -f)) \"mode\", max(n) n from (select user_id, event_type, count(*) n, min(event_id) f from events group by all) group by 1"),
    "source_summary": (source_summary, "select source, count(*) documents, sum(n_chars) chars, arg_min(lang, (url, doc_id)) filter (lang is not null) first_lang, min(epoch_us(crawled_at)) first_crawl, max(epoch_us(crawled_at)) last_crawl from documents group by 1"),
    "dashboard_kpis": (dashboard_kpis, f"select count(distinct org) orgs, sum(kept) kept, round(sum(kept)::double / count(*), 6) kept_avg, sum(case when \"method\" = 'A' then kept else 0 end) kept_a, sum(case when \"method\" = 'N' then kept else 0 end) kept_n, sum(case when \"method\" = 'R' then kept else 0 end) kept_r from {_R}"),
    "institution_samples": (institution_samples, "select institution_id, count(*) contacts, array_to_string(list_slice(list_sort(list(contact_id)), 1, 3), ',') sample from contacts group by 1"),
    "risk_counts": (risk_counts, "select coalesce(lower(trim(confidence, ' ')), '') confidence, count(*) n from ranked_contacts group by 1"),
}
