"""Lookups on the store: contacts with their primary point, filtered searches, planned pages, verified rankings, queues, caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails, text, urls
from rosterloom.operators.records import best_by, top_per_group, upsert
from rosterloom.plans import discovery, views
from rosterloom.plans.views import us
from rosterloom.session import table


def contact_points(spark: SparkSession, d: str) -> DataFrame:
    """Contacts with their primary active point: primary first, then the latest; points of archived rows are not active."""
    p = table(spark, d, "ranked_contacts").filter("trim(email) <> '' and candidate_status <> 'archived'").select("institution_id", F.lower(F.trim("email")).alias("mail"), "ranked_id", (F.col("priority") == "high").cast("int").alias("primary"), us("observed_at").alias("at"))
    best = best_by(p, ["institution_id", "mail"], [F.col("primary"), F.col("at"), F.col("ranked_id")], ["ranked_id", "primary"])
    c = views.current_contacts(spark, d).withColumn("mail", F.lower(F.trim(F.coalesce("email", F.lit("")))))
    return c.join(best, ["institution_id", "mail"], "left").select("identity", "latest_id", "best_id", "observations", "is_stale", F.col("ranked_id").alias("point"), F.col("primary").alias("is_primary"))


def contact_search(spark: SparkSession, d: str, needle: str = "%an%", country: str | None = "FR", score: int | None = 3) -> DataFrame:
    """Contacts by text, country and least score, each with its latest observation; the first 250 (the page size)."""
    i = table(spark, d, "institutions").select("institution_id", "canonical_name", "country_code")
    latest = table(spark, d, "contacts").select(F.col("contact_id").alias("latest_id"), "evidence_type", "page_url")
    rows = views.current_contacts(spark, d).join(i, "institution_id")
    rows = rows.filter(F.col("name").ilike(needle) | F.col("email").ilike(needle) | F.col("canonical_name").ilike(needle))
    rows = rows if country is None else rows.filter(F.col("country_code") == country)
    rows = rows if score is None else rows.filter(F.col("best_score") >= score)
    found = rows.orderBy(F.col("best_score").desc_nulls_last(), F.col("last_seen").desc_nulls_last(), "identity").limit(250)
    return found.join(latest, "latest_id", "left").select("identity", "canonical_name", "best_score", "evidence_type", "page_url")


def institution_search(spark: SparkSession, d: str, needle: str = "%a%", country: str = "FR", coverage: str = "covered") -> DataFrame:
    """Institutions by text, country and coverage."""
    rows = views.current_institutions(spark, d).filter((F.col("canonical_name").ilike(needle) | F.col("home_domain").ilike(needle)) & (F.col("country_code") == country) & (F.col("coverage_status") == coverage))
    return rows.orderBy(F.col("contacts").desc_nulls_last(), "institution_id").limit(250).select("institution_id", "contacts", "coverage_status")


def planned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in the order a planner named them, with what discovery knows of each; unknown ones stay."""
    c = discovery.candidates(spark, d)
    named = c.filter("page_id % 4 = 0").select("institution_id", "url", F.col("page_id").alias("ord")).unionByName(c.filter("page_id % 40 = 1").select("institution_id", F.concat("url", F.lit("-new")).alias("url"), F.col("page_id").alias("ord")))
    once = named.groupBy("institution_id", "url").agg(F.min("ord").alias("ord"))
    known = best_by(c, ["url"], [-F.col("page_id")], ["strategy", "family"])
    rows = once.join(known, "url", "left")
    return top_per_group(rows, ["institution_id"], [F.col("ord"), F.col("url")], 2**31 - 1, "position").select("institution_id", "position", "url", F.coalesce("strategy", F.lit("")).alias("strategy"), F.coalesce("family", F.lit("generic")).alias("family"))


def verified_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a target once per mailbox, the best by confidence (the first on ties), ordered by priority, then arrival."""
    level = F.lower(F.trim("confidence"))
    r = table(spark, d, "ranked_contacts").select("run_id", "institution_id", "ranked_id", "priority", F.lower(F.trim("email")).alias("mail"), F.when(level == "high", 3).when(level == "medium", 2).when(level == "low", 1).otherwise(0).alias("score")).filter("mail <> ''")
    best = best_by(r, ["run_id", "institution_id", "mail"], [F.col("score"), -F.col("ranked_id")], ["ranked_id", "priority"])
    order = [F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2), F.col("ranked_id")]
    return top_per_group(best, ["run_id", "institution_id"], order, 2**31 - 1, "position").select("run_id", "institution_id", "position", "ranked_id")


def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first rows of every target under two caps: two, and 0, which stands for all."""
    r = table(spark, d, "ranked_contacts").select("run_id", "institution_id", "ranked_id")
    one = lambda k: top_per_group(r, ["run_id", "institution_id"], [F.col("ranked_id")], k).groupBy("run_id").agg(F.count("*").alias("n")).withColumn("cap", F.lit(k))
    return one(2).unionByName(one(0))


def recrawl_queue(spark: SparkSession, d: str) -> DataFrame:
    """What is due: contacts whose time is over, and renderings queued for another try, the earliest of each institution."""
    stale = views.current_contacts(spark, d).filter("is_stale").select("institution_id", F.col("stale_after").alias("due"), F.lit("ttl_refresh").alias("reason"))
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id")
    queued = table(spark, d, "fetched_extractions").filter("short_circuited_shell").join(p, "page_id").select("institution_id", us("extracted_at").alias("due"), F.lit("failure_retry").alias("reason"))
    return stale.unionByName(queued).groupBy("institution_id", "reason").agg(F.min("due").alias("due"), F.count("*").alias("n"))


def mojibake_repair(spark: SparkSession, d: str) -> DataFrame:
    """Names read as Latin-1 though written in UTF-8, put right where every character is Latin-1 and the bytes are UTF-8.

    Every fifth institution's name is garbled that way first.
    """
    k = F.ascii(F.right("institution_id", F.lit(1))) % 5
    i = table(spark, d, "institutions").select("institution_id", F.when(k == 0, F.decode(F.encode("canonical_name", "UTF-8"), "ISO-8859-1")).otherwise(F.col("canonical_name")).alias("name"))
    return i.select("institution_id", text.latin_repaired(F.col("name")).alias("name"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    """Names for files: slugs of 80 characters at most, countries of three letters at most."""
    return table(spark, d, "institutions").select("institution_id", text.slug(text.fold_accents(F.concat_ws(" / ", "canonical_name", "home_domain"))).alias("slug"), text.safe_country(F.concat("country_code", F.lit("-x9y"))).alias("country"))


def probe_cache(spark: SparkSession, d: str) -> DataFrame:
    """The cache of checked addresses: a new result replaces the old one, and results live by status.

    A valid or invalid address is good for 30 days, others for one.
    """
    r = table(spark, d, "ranked_contacts").select("ranked_id", emails.normalized(F.col("email")).alias("mail"), us("observed_at").alias("at"), (F.col("ranked_id") % 3).alias("k")).filter("mail <> ''")
    r = r.withColumn("status", F.when(F.col("k") == 0, "valid").when(F.col("k") == 1, "invalid").otherwise("tempfail"))
    last = lambda df: best_by(df, ["mail"], [F.col("at"), F.col("ranked_id")], ["status", "at"])
    day = F.unix_micros(F.lit("2025-01-01 00:00:00").cast("timestamp"))
    merged = upsert(last(r.filter(F.col("at") < day)), last(r.filter(F.col("at") >= day)), ["mail"], {c: F.when(F.col("i.__i"), F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")) for c in ("status", "at")})
    now = F.unix_micros(F.lit("2025-02-01 00:00:00").cast("timestamp"))
    return merged.withColumn("alive", F.col("at") > now - F.when(F.col("status").isin("valid", "invalid"), 30).otherwise(1) * 86_400_000_000)


def _queries() -> dict:
    from rosterloom.plans.discovery import QUERIES as D
    from rosterloom.plans.scalars import _E, _FOLD
    from rosterloom.plans.views import _CURRENT_SQL, _INSTITUTION_SQL

    fam = D["page_families"][1]
    best = "arg_max({x}, (p, t, ranked_id))"
    return {
        "contact_points": (contact_points, f"with pt as (select institution_id, mail, {best.format(x='ranked_id')} point, {best.format(x='p')} is_primary from (select institution_id, lower(trim(email, ' ')) mail, ranked_id, (priority = 'high')::int p, epoch_us(observed_at) t from ranked_contacts where trim(email, ' ') <> '' and candidate_status <> 'archived') group by 1, 2) select identity, latest_id, best_id, observations, is_stale, point, is_primary from ({_CURRENT_SQL}) c left join pt on pt.institution_id = c.institution_id and pt.mail = lower(trim(coalesce(c.email, ''), ' '))"),
        "contact_search": (contact_search, f"with f as (select c.*, canonical_name from ({_CURRENT_SQL}) c join institutions i on i.institution_id = c.institution_id where (c.name ilike '%an%' or c.email ilike '%an%' or canonical_name ilike '%an%') and i.country_code = 'FR' and best_score >= 3 order by best_score desc nulls last, last_seen desc nulls last, identity limit 250) select identity, canonical_name, best_score, o.evidence_type, o.page_url from f left join contacts o on o.contact_id = f.latest_id"),
        "institution_search": (institution_search, f"select institution_id, contacts, coverage_status from ({_INSTITUTION_SQL}) where (canonical_name ilike '%a%' or home_domain ilike '%a%') and country_code = 'FR' and coverage_status = 'covered' order by contacts desc nulls last, institution_id limit 250"),
        "planned_pages": (planned_pages, f"with f as ({fam}), a as (select p.page_id, p.institution_id, p.url, ['real_link_multihop', 'cms', 'sitemap', 'structured_endpoints', 'family_templates', 'subdomains', 'profile_slugs', 'heuristic_slugs'][p.page_id % 8 + 1] strategy, family from acquired_pages p join f using (page_id)), n as (select institution_id, url, page_id o from a where page_id % 4 = 0 union all select institution_id, url || '-new', page_id from a where page_id % 40 = 1), u as (select institution_id, url, min(o) o from n group by 1, 2), k as (select url, arg_min(strategy, page_id) strategy, arg_min(family, page_id) family from a group by 1) select institution_id, row_number() over (partition by institution_id order by o, url)::int position, url, coalesce(strategy, '') strategy, coalesce(family, 'generic') family from u left join k using (url)"),
        "verified_ranking": (verified_ranking, "select run_id, institution_id, row_number() over (partition by run_id, institution_id order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, ranked_id)::int position, ranked_id from (select * from ranked_contacts where trim(email, ' ') <> '' qualify row_number() over (partition by run_id, institution_id, lower(trim(email, ' ')) order by case lower(trim(confidence, ' ')) when 'high' then 3 when 'medium' then 2 when 'low' then 1 else 0 end desc, ranked_id) = 1)"),
        "capped_rows": (capped_rows, "select run_id, sum(least(n, 2))::bigint n, 2 cap from (select run_id, count(*) n from ranked_contacts group by run_id, institution_id) group by 1 union all select run_id, count(*), 0 from ranked_contacts group by 1"),
        "recrawl_queue": (recrawl_queue, f"select institution_id, reason, min(due) due, count(*) n from (select institution_id, stale_after due, 'ttl_refresh' reason from ({_CURRENT_SQL}) where is_stale union all select institution_id, epoch_us(extracted_at), 'failure_retry' from fetched_extractions e join acquired_pages p on p.page_id = e.page_id where short_circuited_shell) group by 1, 2"),
        "mojibake_repair": (mojibake_repair, "select institution_id, canonical_name \"name\" from institutions"),
        "safe_names": (safe_names, f"select institution_id, substring(regexp_replace(trim({_FOLD.format(c=chr(40) + 'canonical_name || ' + chr(39) + ' / ' + chr(39) + ' || home_domain' + chr(41))}, ' '), '[^A-Za-z0-9]+', '_', 'g'), 1, 80) slug, upper(country_code) || 'X' country from institutions"),
        "probe_cache": (probe_cache, f"with r as (select ranked_id, {_E} mail, epoch_us(observed_at) t, ['valid', 'invalid', 'tempfail'][ranked_id % 3 + 1] status from ranked_contacts), l as (select mail, arg_max(status, (t, ranked_id)) status, max(t) \"at\" from r where mail <> '' group by 1) select *, \"at\" > epoch_us(timestamp '2025-02-01') - case when status = 'tempfail' then 1 else 30 end * 86400000000 alive from l"),
    }


QUERIES = _queries()
