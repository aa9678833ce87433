"""Reports and detail views: totals of methods, orders of lists, quality of pages, clean-up of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.functions import emails, text
from rosterloom.operators.records import best_by, exact_median, top_per_group
from rosterloom.plans import discovery
from rosterloom.plans.reports import _R, METHODS, results, total
from rosterloom.plans.views import us
from rosterloom.session import table

#: Dollars for a million tokens read and written. Fixed values.
PRICE_IN, PRICE_OUT = 0.60, 2.40


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """Result rows with a status and token counts."""
    status = F.when(F.col("kept") == 1, "timeout").when(F.col("kept") == 2, "failed").otherwise("ok")
    return results(spark, d).withColumn("status", status).withColumn("tokens_in", (F.col("extracted") * 100).cast("long")).withColumn("tokens_out", (F.col("kept") * 10).cast("long"))


def method_totals(spark: SparkSession, d: str) -> DataFrame:
    """All counts, sums, rates and averages of every method."""
    n = F.count("*")
    return _rows(spark, d).groupBy("method").agg(
        n.alias("n"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "timeout").alias("timed_out"), F.sum("part").alias("candidates"),
        F.sum("kept").alias("kept"), total("extracted").alias("extracted"), F.round(total("seconds"), 2).alias("seconds"), F.round(total("cost"), 2).alias("cost"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"),
        F.round(F.count_if(F.col("kept") >= 1) / n, 6).alias("success_rate"), F.round(F.sum("kept") / n, 6).alias("kept_avg"), F.round(total("seconds") / n, 6).alias("seconds_avg"), F.round(total("cost") / n, 4).alias("cost_avg"))


def method_means(spark: SparkSession, d: str) -> DataFrame:
    """Sum, mean and exact median of kept, mean and median time, sum and mean cost, rounded half to even."""
    r = results(spark, d)
    g = r.groupBy("method").agg(F.sum("kept").alias("kept"), F.bround(F.sum("kept") / F.count("*"), 2).alias("kept_mean"), F.bround(total("seconds") / F.count("*"), 2).alias("seconds_mean"), F.bround(total("cost"), 2).alias("cost"), F.bround(total("cost") / F.count("*"), 2).alias("cost_mean"), F.count("*").alias("n"))
    return g.join(exact_median(r, ["method"], "kept", "kept_median"), "method").join(exact_median(r, ["method"], "seconds", "seconds_median"), "method")


def first_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Organisation by method: the first value that is there."""
    first = results(spark, d).groupBy("org").pivot("method", METHODS).agg(F.min_by("kept", F.when(F.col("kept").isNotNull(), F.struct("id", "part"))))
    return first.select("org", *[F.col(m).alias(f"first_{m.lower()}") for m in METHODS])


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """One row per run and institution: contacts by priority, exported ones (five at most), pages, outcome."""
    r = table(spark, d, "ranked_contacts").groupBy("run_id", "institution_id").agg(F.count("*").alias("ranked"), F.count_if(F.col("priority") == "high").alias("high"), F.count_if(F.col("priority") == "medium").alias("medium"), F.countDistinct("source_url").alias("pages"))
    r = r.withColumn("exported", F.least("ranked", F.lit(5))).withColumn("outcome", F.when(F.col("high") >= 2, "hard_success").when(F.col("high") + F.col("medium") >= 1, "soft_success").otherwise("failed"))
    return r.join(table(spark, d, "runs").select("run_id", F.col("run_mode").alias("variant")), "run_id")


def variant_totals(spark: SparkSession, d: str) -> DataFrame:
    """Twelve measures of every variant of a run."""
    n = F.count("*")
    return _targets(spark, d).groupBy("variant").agg(
        n.alias("targets"), F.count_if(F.col("exported") > 0).alias("with_contacts"), F.round(F.count_if(F.col("exported") > 0) / n * 100, 1).alias("success_rate"), F.sum("ranked").alias("ranked"), F.sum("exported").alias("exported"),
        F.round(F.sum("exported") / n, 2).alias("exported_avg"), F.round(F.sum("pages") / n, 2).alias("pages_avg"), F.sum("high").alias("high"), F.sum("medium").alias("medium"), F.count_if(F.col("outcome") == "hard_success").alias("hard"),
        F.count_if(F.col("outcome") == "soft_success").alias("soft"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def crm_export(spark: SparkSession, d: str) -> DataFrame:
    """Rows for the CRM: three per target at most, missing values as '', with the outcome of the target."""
    r = table(spark, d, "ranked_contacts")
    order = [F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), F.col("ranked_id")]
    top = top_per_group(r, ["run_id", "institution_id"], order, 3, "position").join(_targets(spark, d).select("run_id", "institution_id", "outcome", F.col("pages").alias("pages_fetched")), ["run_id", "institution_id"])
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    i = table(spark, d, "institutions").select("institution_id", F.col("canonical_name").alias("organisation"))
    return top.join(i, "institution_id").select("ranked_id", "organisation", empty("name"), empty("title"), F.lower("email").alias("email"), F.coalesce("source_url", F.lit("")).alias("page_url"), empty("confidence"), empty("recovery_reason"), "outcome", "pages_fetched")


def probe_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Per organisation what its probes found, and the first best one if any kept something strong."""
    r = results(spark, d).withColumn("strong", F.greatest(F.col("kept") - 6, F.lit(0)))
    return r.groupBy("org").agg(F.count("*").alias("probes"), F.sum("strong").alias("kept"), total("extracted").alias("extracted"), F.max_by("id", F.when(F.col("strong") > 0, F.struct("strong", -F.col("id"), -F.col("part")))).alias("best"))


def merged_counters(spark: SparkSession, d: str) -> DataFrame:
    """Results of the pages of an institution as one: counters added, maps of modes added by key, each page once."""
    e = table(spark, d, "fetched_extractions").join(table(spark, d, "acquired_pages").select("page_id", "institution_id"), "page_id")
    g = e.groupBy("institution_id").agg(F.sum("mailto_count").cast("long").alias("mailtos"), F.sum("tokens_in_estimate").cast("long").alias("tokens_in"), F.countDistinct("page_id").alias("pages"))
    m = e.select("institution_id", F.explode("acquisition_modes").alias("mode")).groupBy("institution_id", "mode").agg(F.count("*").alias("n"))
    # modes are few: a map of each institution has as many entries as there are modes
    maps = m.groupBy("institution_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "mode", F.col("n").cast("string")))), ",").alias("modes"))
    return g.join(maps, "institution_id", "left")


def best_method(spark: SparkSession, d: str) -> DataFrame:
    """The method of the greatest average, "N/A" if none is above 0."""
    g = results(spark, d).groupBy("method").agg((F.sum("kept") / F.count("*")).alias("avg"))
    return g.agg(F.coalesce(F.max_by("method", F.when(F.col("avg") > 0, F.struct("avg", "method"))), F.lit("N/A")).alias("best"))


def run_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rows, contacts and cost of every data set, by column names."""
    return results(spark, d).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("kept").alias("contacts"), F.round(total("cost"), 2).alias("cost"))


def collector_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by collector, zero for those that found none."""
    found = discovery.candidates(spark, d).groupBy("strategy").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(s,) for s in (*discovery.STRATEGY_PRIORITY, "web_search")], "strategy string")
    return every.join(found, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n"))


def llm_costs(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens and dollars by way of acquisition."""
    e = table(spark, d, "fetched_extractions").groupBy(F.get("acquisition_modes", F.lit(0)).alias("mode")).agg(F.sum("tokens_in_estimate").cast("long").alias("tokens_in"), F.sum("tokens_out_estimate").cast("long").alias("tokens_out"))
    return e.withColumn("dollars", F.round(F.coalesce("tokens_in", F.lit(0)) * PRICE_IN / 1e6 + F.coalesce("tokens_out", F.lit(0)) * PRICE_OUT / 1e6, 6))


def filter_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    """Of the first eight rows of every institution, how many would be kept (a report on a few rows)."""
    top = top_per_group(table(spark, d, "contacts"), ["institution_id"], [F.col("contact_id")], 8, "position")
    return top.groupBy("institution_id").agg(F.count_if(F.coalesce("score", F.lit(0)) >= 5).alias("kept"), F.count_if(F.coalesce("score", F.lit(0)) < 5).alias("rejected"))


def target_list(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each run, the latest finished first, open ones last, then by name."""
    t = table(spark, d, "ranked_contacts").select("run_id", "institution_id").distinct().join(table(spark, d, "runs").select("run_id", us("finished_at").alias("finished")), "run_id").join(table(spark, d, "institutions").select("institution_id", "canonical_name"), "institution_id")
    return top_per_group(t, ["run_id"], [F.col("finished").desc_nulls_last(), F.col("canonical_name"), F.col("institution_id")], 2**31 - 1, "position").select("run_id", "position", "institution_id")


def target_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every institution by time and id: the first 400 (the view's page size)."""
    p = table(spark, d, "acquired_pages")
    return top_per_group(p, ["institution_id"], [us("fetched_at").asc_nulls_last(), F.col("page_id")], 400, "position").select("institution_id", "position", "page_id")


def target_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of every target by confidence, then time."""
    r = table(spark, d, "ranked_contacts").withColumn("c", F.lower(F.trim("confidence")))
    order = [F.when(F.col("c") == "high", 1).when(F.col("c") == "medium", 2).otherwise(3), us("observed_at").desc_nulls_last(), F.col("ranked_id")]
    return top_per_group(r, ["run_id", "institution_id"], order, 2**31 - 1, "position").select("run_id", "institution_id", "position", "ranked_id")


def target_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of every target in the order it was made: the first 300, each joined to its contact."""
    r = table(spark, d, "ranked_contacts").select("ranked_id", "run_id", "institution_id", "evidence_type", us("observed_at").alias("at"), emails.normalized(F.col("email")).alias("mail"))
    c = table(spark, d, "contacts").select("institution_id", emails.normalized(F.col("email")).alias("mail"), "contact_id").filter("mail <> ''").groupBy("institution_id", "mail").agg(F.max("contact_id").alias("contact_id"))
    j = r.join(c, ["institution_id", "mail"])
    return top_per_group(j, ["run_id", "institution_id"], [F.col("at").asc_nulls_last(), F.col("ranked_id")], 300, "position").select("run_id", "institution_id", "position", "ranked_id", "contact_id", "evidence_type")


def viewer_orders(spark: SparkSession, d: str) -> DataFrame:
    """Organisations under the four orders of the viewer: name, kept, time, cost."""
    g = results(spark, d).groupBy("method", "org").agg(F.sum("kept").alias("kept"), total("seconds").alias("seconds"), total("cost").alias("cost"))
    by = lambda *o: F.row_number().over(Window.partitionBy("method").orderBy(*o, "org"))
    return g.select("method", "org", by(F.col("org").cast("string")).alias("by_name"), by(F.col("kept").desc()).alias("by_kept"), by("seconds").alias("by_time"), by("cost").alias("by_cost"))


def contact_sheet(spark: SparkSession, d: str) -> DataFrame:
    """The sheet of contacts sorted by institution and score, numbered; ties keep the order of arrival."""
    c = table(spark, d, "contacts").select("institution_id", "contact_id", F.coalesce("score", F.lit(0)).alias("score"))
    return top_per_group(c, ["institution_id"], [F.col("score").desc(), F.col("contact_id")], 2**31 - 1, "line").select("institution_id", "line", "contact_id", "score")


def useful_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of an institution with an address on them; where there is none, its first 40."""
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id", F.col("visible_text").rlike(emails.EMAIL).alias("useful"))
    n = p.groupBy("institution_id").agg(F.count_if("useful").alias("n"))
    j = top_per_group(p.join(n, "institution_id"), ["institution_id", "useful"], [F.col("page_id")], 2**31 - 1, "k")
    return j.filter((F.col("useful") & (F.col("n") > 0)) | ((F.col("n") == 0) & (F.col("k") <= 40))).select("institution_id", "page_id")


def viewer_filter(spark: SparkSession, d: str, needle: str = "mobility", country: str = "FR") -> DataFrame:
    """Institutions of a country whose name, or any of whose contacts' names, addresses or roles, holds a text."""
    has = lambda *cols: emails._any([F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle)) for c in cols])
    inst = table(spark, d, "institutions").filter(F.col("country_code") == country)
    by_contact = table(spark, d, "contacts").filter(has("name", "email", "role")).select("institution_id").distinct().withColumn("hit", F.lit(True))
    return inst.join(by_contact, "institution_id", "left").filter(has("canonical_name") | F.col("hit")).select("institution_id")


def shell_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Shells: without any evidence, with weak evidence of a model only, and such as need no extractor at all."""
    from rosterloom.functions.names import person_name

    e = table(spark, d, "fetched_extractions").select("extraction_id", "page_id", "shell_like", F.length(F.trim("text")).alias("n"))
    p = table(spark, d, "acquired_pages").select("page_id", "visible_text", F.coalesce("embedded_text", F.lit("")).alias("embedded"), F.col("embedded_document_count").alias("documents"))
    c = table(spark, d, "contacts").filter("page_id is not null").groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if((F.col("evidence_type") == "llm_structured") & (F.coalesce(F.trim("email"), F.lit("")) == "") & ~F.coalesce(person_name(F.col("name")), F.lit(False))).alias("weak"))
    j = e.join(p, "page_id").join(c, "page_id", "left")
    rows, weak = F.coalesce("rows", F.lit(0)), F.coalesce("weak", F.lit(0))
    big = F.col("shell_like") & (F.col("n") >= 1000)
    signal = F.contains(F.lower("visible_text"), F.lit("mailto:")) | F.col("visible_text").rlike(emails.EMAIL)
    return j.select("extraction_id", (big & (rows == 0)).alias("no_evidence"), (F.col("shell_like") & (rows > 0) & (rows == weak)).alias("weak"), (F.col("shell_like") & (F.col("documents") == 0) & (F.trim("embedded") == "") & ~signal & (F.length(F.trim("visible_text")) >= 1000)).alias("short_circuit"), signal.alias("signal"))


def shell_like_pages(spark: SparkSession, d: str) -> DataFrame:
    """Shells by size, scripts and density: mostly script, or embedded documents that outweigh the visible text.

    Sizes are those of the rendering times 100, scripts 4 for every embedded document and 8 more.
    """
    e = table(spark, d, "fetched_extractions").select("extraction_id", (F.col("page_length") * 100).alias("html"), "visible_text_length", "embedded_text_length", "embedded_document_count", (F.col("embedded_document_count") * 4 + 8).alias("scripts"))
    density = F.col("visible_text_length") / F.greatest("html", F.lit(1))
    shell = ((F.col("html") >= 180_000) & (F.col("scripts") >= 12) & (density <= 0.06)) | ((F.col("html") >= 90_000) & (F.col("embedded_document_count") >= 1) & (F.col("visible_text_length") <= 1200))
    return e.select("extraction_id", (shell | ((F.col("html") >= 90_000) & (F.col("embedded_text_length") > 0) & (F.col("embedded_text_length") >= F.greatest(F.lit(800), F.col("visible_text_length") * 2)))).alias("shell"))


def effective_texts(spark: SparkSession, d: str) -> DataFrame:
    """Visible and embedded text of a page as one, and the way it was acquired."""
    flat = lambda c: text.collapse_blanks(F.coalesce(c, F.lit("")))
    p = table(spark, d, "acquired_pages").select("page_id", flat("visible_text").alias("v"), flat("embedded_text").alias("e"), "shell_like")
    both = F.when((F.col("e") == "") | F.contains("v", F.col("e")), F.col("v")).when(F.col("v") == "", F.col("e")).otherwise(F.concat("v", F.lit("\n\n"), "e"))
    mode = F.when(F.col("e") == "", "static_html").when(F.col("shell_like"), "embedded_app_state_overlay").otherwise("static_html_plus_embedded_hints")
    return p.select("page_id", F.sha1(both.cast("binary")).alias("text"), mode.alias("mode"))


def cleanup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of one page for one mailbox (else one name and role): the best stays, takes flags and missing roles of the others.

    Rows that are not the best are marked as duplicates.
    """
    from rosterloom.functions.names import clean_role

    c = table(spark, d, "contacts").filter("page_id is not null").select("contact_id", "page_id", F.lower(F.coalesce(F.trim("name"), F.lit(""))).alias("name"), emails.normalized(F.col("email")).alias("mail"), clean_role(F.col("role")).alias("role"), "cleanup_flags")
    key = F.when(F.col("mail") != "", F.concat(F.lit("m"), "mail")).when(F.col("name") != "", F.concat_ws("\t", F.lit("p"), "name", "role")).otherwise(F.concat(F.lit("f"), "role"))
    score = F.when(F.col("mail") != "", 12).otherwise(0) + F.when(F.col("name") != "", 10).otherwise(0) + F.when(F.col("role") != "", 5).otherwise(0) + 1 + F.when(emails.generic_mailbox(F.col("mail")), 0).otherwise(1)
    c = c.withColumn("key", key).withColumn("score", score)
    order = F.struct("score", -F.col("contact_id"))
    g = c.groupBy("page_id", "key").agg(F.max_by("contact_id", order).alias("best"), F.max("score").alias("score"), F.count("*").alias("members"), F.max_by("role", F.when(F.col("role") != "", order)).alias("filled"))
    flags = c.select("page_id", "key", F.explode("cleanup_flags").alias("flag")).distinct().groupBy("page_id", "key").agg(F.array_join(F.array_sort(F.collect_list("flag")), ",").alias("flags"))
    j = c.select("contact_id", "page_id", "key").join(g, ["page_id", "key"]).join(flags, ["page_id", "key"], "left")
    lead = F.col("contact_id") == F.col("best")
    return j.select("contact_id", lead.alias("kept"), F.when(lead, F.coalesce("flags", F.lit(""))).otherwise("duplicate_candidate").alias("flags"), F.when(lead, F.coalesce("filled", F.lit(""))).otherwise("").alias("role"), F.when(lead, F.col("members")).otherwise(1).alias("members"), F.when(lead, F.col("score")).otherwise(0).alias("score"))


def page_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of a page by three finders (plain, spelled out, as links), united and sorted."""
    t = F.col("visible_text")
    spelled = emails.obfuscated_emails(F.regexp_replace(t, r"(?i)( \[at\] [a-z0-9-]+)\.([a-z]+)", "$1 [dot] $2"))
    found = F.array_sort(F.array_distinct(F.concat(F.transform(emails.all_emails(t), F.lower), spelled, emails.link_emails(F.concat(F.lit("mailto:office@"), F.regexp_extract("url", "//([^/]+)", 1))))))
    return table(spark, d, "acquired_pages").select("page_id", F.array_join(found, ",").alias("emails"))


def page_results(spark: SparkSession, d: str) -> DataFrame:
    """What reading a page gave: rows, named ones, mailboxes, persons without address; first pages of a content first."""
    c = table(spark, d, "contacts").filter("page_id is not null").withColumn("mail", emails.normalized(F.col("email")))
    named = F.coalesce(F.trim("name"), F.lit("")) != ""
    g = c.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if(named & (F.col("mail") != "")).alias("named"), F.count_if(~named & (F.col("mail") != "")).alias("office"), F.count_if(named & (F.col("mail") == "")).alias("missing"), F.count_if(~named & (F.col("mail") == "")).alias("junk"))
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id", us("fetched_at").alias("at"), text.content_signature(F.col("visible_text")).alias("sig"))
    first = best_by(p, ["institution_id", "sig"], [-F.col("at"), -F.col("page_id")], ["page_id"]).select(F.col("page_id").alias("page_id"), F.lit(True).alias("first"))
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("rows", "named", "office", "missing", "junk")]
    return p.select("page_id").join(g, "page_id", "left").join(first, "page_id", "left").select("page_id", *zero, F.coalesce("first", F.lit(False)).alias("first"))


def direct_crawl(spark: SparkSession, d: str) -> DataFrame:
    """Discovery, reading of the first pages and evaluation as one: each mailbox where it was seen first, kept from five points."""
    pages = discovery.planner_order(spark, d)
    c = table(spark, d, "contacts").select("contact_id", "page_id", emails.normalized(F.col("email")).alias("mail"), F.coalesce("score", F.lit(0)).alias("score")).filter("mail <> ''")
    seen = top_per_group(c.join(pages, "page_id"), ["institution_id", "mail"], [F.col("position"), F.col("contact_id")], 1)
    n = seen.groupBy("institution_id").agg(F.count("*").alias("unique_rows"), F.count_if(F.col("score") >= 5).alias("kept"), F.max_by("page_id", F.when(F.col("score") >= 5, F.struct("score", -F.col("position"), -F.col("contact_id")))).alias("best_page"))
    read = pages.groupBy("institution_id").agg(F.count("*").alias("pages"))
    return read.join(n, "institution_id", "left").select("institution_id", "pages", F.coalesce("unique_rows", F.lit(0)).alias("unique_rows"), F.coalesce("kept", F.lit(0)).alias("kept"), "best_page")


def candidate_builders(spark: SparkSession, d: str) -> DataFrame:
    """Rows that lack an address as candidates for recovery: role holders without a name, persons without an address."""
    from rosterloom.functions.names import holder_signal, person_name

    c = table(spark, d, "contacts").filter("coalesce(trim(email), '') = ''")
    person = person_name(F.col("name"))
    kind = F.when(person, "person_name").when(holder_signal(F.col("role"), F.lit(""), F.lit("")), "role_holder")
    return c.select("contact_id", kind.alias("kind"), person.alias("directory_ready"), F.when(person, "resolve_email").otherwise("resolve_person_from_role").alias("goal")).filter("kind is not null")


def json_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows as JSON scalars: decimals as floats, times as text."""
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").cast("double").alias("price"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("day"))


def epoch_times(spark: SparkSession, d: str) -> DataFrame:
    """Epoch seconds as times in UTC."""
    return table(spark, d, "events").select("event_id", F.unix_micros(F.timestamp_seconds(F.col("event_id") * 1000 + 1_700_000_000)).alias("at"))


def json_keys(spark: SparkSession, d: str) -> DataFrame:
    """The first value of a JSON object whose key, without punctuation and case, holds a term."""
    m = F.from_json("props", "map<string,string>")
    key = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]+", "")
    hit = F.filter(F.map_entries(m), lambda e: F.contains(key(e["key"]), F.lit("k")) & (F.coalesce(F.trim(e["value"]), F.lit("")) != ""))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get(hit, F.lit(0))["value"], F.lit("")).alias("value"))


def _queries() -> dict:
    from rosterloom.plans.people import _P, _clean_role_sql, _has, _in, _ROLE_TEXT, flat, person_sql
    from rosterloom.plans.scalars import _E, _EMAIL
    from rosterloom.plans.views import table as _  # noqa: F401

    rows = f"(select *, case kept when 1 then 'timeout' when 2 then 'failed' else 'ok' end status, (extracted * 100)::bigint ti, kept * 10 tout from {_R})"
    sm = lambda c: f"sum({c}::decimal(18,4))::double"
    tg = "(select t.*, least(ranked, 5) exported, case when high >= 2 then 'hard_success' when high + medium >= 1 then 'soft_success' else 'failed' end outcome, run_mode variant from (select run_id, institution_id, count(*) ranked, count(*) filter (priority = 'high') high, count(*) filter (priority = 'medium') medium, count(distinct source_url) pages from ranked_contacts group by 1, 2) t join runs using (run_id))"
    cand = discovery.QUERIES["planner_order"][1]
    gen = "(?i)^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)"
    nm = "coalesce(trim(\"name\", ' '), '')"
    from rosterloom.plans import people as pp

    keywords, pp.KEYWORDS = pp.KEYWORDS, ()
    clean_role = _clean_role_sql("u").replace("false or ", "")
    pp.KEYWORDS = keywords
    clean_role = f"(select contact_id, {clean_role} rl from (select contact_id, {_ROLE_TEXT} u from contacts))"
    cg = f"(select contact_id, page_id, lower({nm}) nm, {_E} em, rl, cleanup_flags from contacts join {clean_role} using (contact_id) where page_id is not null)"
    ck = f"(select *, case when em <> '' then 'm' || em when nm <> '' then 'p' || chr(9) || nm || chr(9) || rl else 'f' || rl end k, (case when em <> '' then 12 else 0 end + case when nm <> '' then 10 else 0 end + case when rl <> '' then 5 else 0 end + 1 + case when regexp_matches(split_part(em, '@', 1), '{gen}') then 0 else 1 end) sc from {cg})"
    holder_hay = f"lower({flat('coalesce(role, chr(32))')})"
    holder = f"({_has(holder_hay, _P.senior_role_terms)} or ({_has(holder_hay, _P.international_leadership_terms)} and {_has(holder_hay, _P.relevant_office_role_terms + _P.role_signal_terms + _P.international_markers + _P.relevant_mailbox_terms)}))"
    needle = lambda *cols: " or ".join(f"contains(lower(coalesce({c}, '')), 'mobility')" for c in cols)
    spelled = "list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(v, '(?i)\\s*(?:\\[\\s*at\\s*\\]|\\(\\s*at\\s*\\))\\s*|\\s+at\\s+', chr(57344), 'g'), '(?i)\\s*(?:\\[\\s*dot\\s*\\]|\\(\\s*dot\\s*\\))\\s*|\\s+dot\\s+', chr(57345), 'g'), '[A-Za-z0-9._%+-]+' || chr(57344) || '[A-Za-z0-9.-]+(?:' || chr(57345) || '[A-Za-z0-9.-]+)+'), lambda e: lower(replace(replace(e, chr(57344), '@'), chr(57345), '.'))), lambda e: regexp_matches(e, '^" + _EMAIL + "$'))"
    return {
        "method_totals": (method_totals, f"select \"method\", count(*) n, count(*) filter (status = 'ok') ok, count(*) filter (status = 'failed') failed, count(*) filter (status = 'timeout') timed_out, sum(part)::bigint candidates, sum(kept)::bigint kept, {sm('extracted')} extracted, round({sm('secs')}, 2) \"seconds\", round({sm('cost')}, 2) cost, sum(ti)::bigint tokens_in, sum(tout)::bigint tokens_out, round(count(*) filter (kept >= 1) / count(*), 6) success_rate, round(sum(kept) / count(*), 6) kept_avg, round({sm('secs')} / count(*), 6) seconds_avg, round({sm('cost')} / count(*), 4) cost_avg from {rows} group by 1"),
        "method_means": (method_means, f"select \"method\", sum(kept)::bigint kept, round_even(sum(kept) / count(*), 2) kept_mean, round_even({sm('secs')} / count(*), 2) seconds_mean, round_even({sm('cost')}, 2) cost, round_even({sm('cost')} / count(*), 2) cost_mean, count(*) n, median(kept)::double kept_median, median(secs) seconds_median from {_R} group by 1"),
        "first_pivot": (first_pivot, f"select org, arg_min(kept, (id, part)) filter (\"method\" = 'A') first_a, arg_min(kept, (id, part)) filter (\"method\" = 'N') first_n, arg_min(kept, (id, part)) filter (\"method\" = 'R') first_r from {_R} group by 1"),
        "variant_totals": (variant_totals, f"select variant, count(*) targets, count(*) filter (exported > 0) with_contacts, round(count(*) filter (exported > 0) / count(*) * 100, 1) success_rate, sum(ranked)::bigint ranked, sum(exported)::bigint exported, round(sum(exported) / count(*), 2) exported_avg, round(sum(pages) / count(*), 2) pages_avg, sum(high)::bigint high, sum(medium)::bigint medium, count(*) filter (outcome = 'hard_success') hard, count(*) filter (outcome = 'soft_success') soft, count(*) filter (outcome = 'failed') failed from {tg} group by 1"),
        "crm_export": (crm_export, f"select ranked_id, canonical_name organisation, coalesce(r.name, '') \"name\", coalesce(title, '') title, lower(email) email, coalesce(source_url, '') page_url, coalesce(confidence, '') confidence, coalesce(recovery_reason, '') recovery_reason, outcome, pages pages_fetched from (select * from ranked_contacts qualify row_number() over (partition by run_id, institution_id order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, ranked_id) <= 3) r join {tg} t on t.run_id = r.run_id and t.institution_id = r.institution_id join institutions i on i.institution_id = r.institution_id"),
        "probe_summaries": (probe_summaries, f"select org, count(*) probes, sum(greatest(kept - 6, 0))::bigint kept, {sm('extracted')} extracted, arg_max(id, (kept, -id, -part)) filter (kept > 6) best from {_R} group by 1"),
        "merged_counters": (merged_counters, "with e as (select f.*, institution_id from fetched_extractions f join acquired_pages p on p.page_id = f.page_id), m as (select institution_id, \"mode\", count(*) n from (select institution_id, unnest(acquisition_modes) \"mode\" from e) group by 1, 2), s as (select institution_id, array_to_string(list_sort(list(\"mode\" || '=' || n::varchar)), ',') modes from m group by 1) select institution_id, sum(mailto_count)::bigint mailtos, sum(tokens_in_estimate)::bigint tokens_in, count(distinct page_id) pages, any_value(modes) modes from e left join s using (institution_id) group by 1"),
        "best_method": (best_method, f"select coalesce(arg_max(\"method\", (a, \"method\")) filter (a > 0), 'N/A') best from (select \"method\", sum(kept) / count(*) a from {_R} group by 1)"),
        "run_totals": (run_totals, f"select dataset, count(*) n, sum(kept)::bigint contacts, round({sm('cost')}, 2) cost from {_R} group by 1"),
        "collector_counts": (collector_counts, f"select strategy, coalesce(n, 0) n from (select unnest({_in((*discovery.STRATEGY_PRIORITY, 'web_search'))}) strategy) left join (select {_in(discovery.STRATEGY_PRIORITY)}[page_id % 8 + 1] strategy, count(*) n from acquired_pages group by 1) using (strategy)"),
        "llm_costs": (llm_costs, f"select acquisition_modes[1] \"mode\", sum(tokens_in_estimate)::bigint tokens_in, sum(tokens_out_estimate)::bigint tokens_out, round(coalesce(sum(tokens_in_estimate), 0) * {PRICE_IN}::double / 1e6 + coalesce(sum(tokens_out_estimate), 0) * {PRICE_OUT}::double / 1e6, 6) dollars from fetched_extractions group by 1"),
        "filter_diagnosis": (filter_diagnosis, "select institution_id, count(*) filter (coalesce(score, 0) >= 5) kept, count(*) filter (coalesce(score, 0) < 5) rejected from (select * from contacts qualify row_number() over (partition by institution_id order by contact_id) <= 8) group by 1"),
        "target_list": (target_list, "select run_id, row_number() over (partition by run_id order by epoch_us(finished_at) desc nulls last, canonical_name, institution_id)::int position, institution_id from (select distinct run_id, institution_id from ranked_contacts) join runs using (run_id) join institutions using (institution_id)"),
        "target_pages": (target_pages, "select institution_id, row_number() over (partition by institution_id order by epoch_us(fetched_at) nulls last, page_id)::int position, page_id from acquired_pages qualify position <= 400"),
        "target_contacts": (target_contacts, "select run_id, institution_id, row_number() over (partition by run_id, institution_id order by case lower(trim(confidence, ' ')) when 'high' then 1 when 'medium' then 2 else 3 end, epoch_us(observed_at) desc nulls last, ranked_id)::int position, ranked_id from ranked_contacts"),
        "target_evidence": (target_evidence, f"with c as (select institution_id, em, max(contact_id) contact_id from (select institution_id, contact_id, {_E} em from contacts) where em <> '' group by 1, 2), r as (select ranked_id, run_id, institution_id, evidence_type, epoch_us(observed_at) t, {_E} em from ranked_contacts) select run_id, institution_id, row_number() over (partition by run_id, institution_id order by t nulls last, ranked_id)::int position, ranked_id, contact_id, evidence_type from r join c using (institution_id, em) qualify position <= 300"),
        "viewer_orders": (viewer_orders, f"select \"method\", org, row_number() over (partition by \"method\" order by org::varchar, org)::int by_name, row_number() over (partition by \"method\" order by k desc, org)::int by_kept, row_number() over (partition by \"method\" order by s, org)::int by_time, row_number() over (partition by \"method\" order by c, org)::int by_cost from (select \"method\", org, sum(kept) k, {sm('secs')} s, {sm('cost')} c from {_R} group by 1, 2)"),
        "contact_sheet": (contact_sheet, "select institution_id, row_number() over (partition by institution_id order by coalesce(score, 0) desc, contact_id)::int line, contact_id, coalesce(score, 0) score from contacts"),
        "useful_pages": (useful_pages, f"select institution_id, page_id from (select institution_id, page_id, regexp_matches(visible_text, '{_EMAIL}') u, count(*) filter (regexp_matches(visible_text, '{_EMAIL}')) over (partition by institution_id) n, row_number() over (partition by institution_id, regexp_matches(visible_text, '{_EMAIL}') order by page_id) k from acquired_pages) where u or (n = 0 and k <= 40)"),
        "viewer_filter": (viewer_filter, f"select institution_id from institutions i where country_code = 'FR' and ({needle('canonical_name')} or exists (select 1 from contacts c where c.institution_id = i.institution_id and ({needle('c.name', 'c.email', 'c.role')})))"),
        "shell_verdicts": (shell_verdicts, f"with c as (select page_id, count(*) r, count(*) filter (evidence_type = 'llm_structured' and coalesce(trim(email, ' '), '') = '' and not coalesce({person_sql('coalesce(' + chr(34) + 'name' + chr(34) + ', ' + chr(39) * 2 + ')')}, false)) w from contacts where page_id is not null group by 1), j as (select e.extraction_id, e.shell_like, length(trim(e.text, ' ')) n, visible_text v, coalesce(embedded_text, '') em, p.embedded_document_count dc, coalesce(r, 0) r, coalesce(w, 0) w from fetched_extractions e join acquired_pages p on p.page_id = e.page_id left join c on c.page_id = e.page_id), s as (select *, contains(lower(v), 'mailto:') or regexp_matches(v, '{_EMAIL}') g from j) select extraction_id, shell_like and n >= 1000 and r = 0 no_evidence, shell_like and r > 0 and r = w weak, shell_like and dc = 0 and trim(em, ' ') = '' and not g and length(trim(v, ' ')) >= 1000 short_circuit, g signal from s"),
        "shell_like_pages": (shell_like_pages, "select extraction_id, (h >= 180000 and sc >= 12 and v / greatest(h, 1) <= 0.06) or (h >= 90000 and d >= 1 and v <= 1200) or (h >= 90000 and e > 0 and e >= greatest(800, v * 2)) shell from (select extraction_id, page_length * 100 h, visible_text_length v, embedded_text_length e, embedded_document_count d, embedded_document_count * 4 + 8 sc from fetched_extractions)"),
        "effective_texts": (effective_texts, f"select page_id, sha1(case when e = '' or contains(v, e) then v when v = '' then e else v || chr(10) || chr(10) || e end) \"text\", case when e = '' then 'static_html' when shell_like then 'embedded_app_state_overlay' else 'static_html_plus_embedded_hints' end \"mode\" from (select page_id, {flat('coalesce(visible_text, chr(32))')} v, {flat('coalesce(embedded_text, chr(32))')} e, shell_like from acquired_pages)"),
        "cleanup_groups": (cleanup_groups, f"with c as {ck}, w as (select *, row_number() over (partition by page_id, k order by sc desc, contact_id) rn, count(*) over (partition by page_id, k) n from c), r as (select page_id, k, coalesce(arg_max(rl, (sc, -contact_id)) filter (rl <> ''), '') fill from c group by 1, 2), f as (select page_id, k, array_to_string(list_sort(list(distinct x)), ',') fl from (select page_id, k, unnest(cleanup_flags) x from c) group by 1, 2) select contact_id, rn = 1 kept, case when rn = 1 then coalesce(fl, '') else 'duplicate_candidate' end flags, case when rn = 1 then fill else '' end \"role\", case when rn = 1 then n else 1 end members, case when rn = 1 then sc else 0 end score from w join r using (page_id, k) left join f using (page_id, k)"),
        "page_emails": (page_emails, f"select page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '{_EMAIL}'), lambda e: lower(e)) || {spelled} || ['office@' || lower(regexp_extract(url, '//([^/]+)', 1))])), ',') emails from (select page_id, url, visible_text t, regexp_replace(visible_text, '(?i)( \\[at\\] [a-z0-9-]+)\\.([a-z]+)', '\\1 [dot] \\2', 'g') v from acquired_pages)"),
        "page_results": (page_results, f"with c as (select page_id, {nm} <> '' n, {_E} <> '' m from contacts where page_id is not null), g as (select page_id, count(*) \"rows\", count(*) filter (n and m) named, count(*) filter (not n and m) office, count(*) filter (n and not m) missing, count(*) filter (not n and not m) junk from c group by 1), p as (select page_id, row_number() over (partition by institution_id, sha1(substring(lower(trim(regexp_replace(coalesce(visible_text, ''), '[\\s\\x{{00a0}}]+', ' ', 'g'), ' ')), 1, 2500)) order by epoch_us(fetched_at), page_id) = 1 \"first\" from acquired_pages) select page_id, coalesce(\"rows\", 0) \"rows\", coalesce(named, 0) named, coalesce(office, 0) office, coalesce(missing, 0) missing, coalesce(junk, 0) junk, \"first\" from p left join g using (page_id)"),
        "direct_crawl": (direct_crawl, f"with pg as ({cand}), c as (select contact_id, page_id, {_E} em, coalesce(score, 0) sc from contacts), s as (select pg.institution_id, em, sc, pg.page_id, position, contact_id from c join pg using (page_id) where em <> '' qualify row_number() over (partition by pg.institution_id, em order by position, contact_id) = 1), n as (select institution_id, count(*) u, count(*) filter (sc >= 5) k, arg_max(page_id, (sc, -position, -contact_id)) filter (sc >= 5) b from s group by 1) select institution_id, count(*) pages, coalesce(any_value(u), 0) unique_rows, coalesce(any_value(k), 0) kept, any_value(b) best_page from pg left join n using (institution_id) group by 1"),
        "candidate_builders": (candidate_builders, f"select contact_id, kind, kind = 'person_name' directory_ready, case when kind = 'person_name' then 'resolve_email' else 'resolve_person_from_role' end goal from (select contact_id, case when {person_sql('coalesce(' + chr(34) + 'name' + chr(34) + ', ' + chr(39) * 2 + ')')} then 'person_name' when {holder} then 'role_holder' end kind from contacts where coalesce(trim(email, ' '), '') = '') where kind is not null"),
        "json_rows": (json_rows, "select o_orderkey, o_totalprice::decimal(12,2)::double price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') \"day\" from orders"),
        "epoch_times": (epoch_times, "select event_id, epoch_us(to_timestamp(event_id * 1000 + 1700000000)) \"at\" from events"),
        "json_keys": (json_keys, "select event_id, coalesce(json_extract_string(props, '$.k'), '') \"value\" from events"),
    }


QUERIES = _queries()
