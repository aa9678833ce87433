"""Current-state views over observations, and the dashboard queries on top of them.

A contact is an identity (institution, e-mail, name, type); every row of ``contacts`` is an observation of one, and rows
of ``ranked_contacts`` are its points. Institutions carry runs by country and pages as seeds. Views take ``as_of``
instead of the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions.text import joined_hash
from rosterloom.operators.records import best_by, top_per_group
from rosterloom.session import table

AS_OF = "2025-06-30 00:00:00"
STALE_DAYS = 90


def us(col: str | Column) -> Column:
    """Microseconds since 1970: a timestamp that compares equal everywhere."""
    return F.unix_micros(F.col(col).cast("timestamp") if isinstance(col, str) else col.cast("timestamp"))


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def identity() -> Column:
    return joined_hash(F.col("institution_id"), F.lower(F.trim(F.coalesce("email", F.lit("")))), F.coalesce("name", F.lit("")), F.col("candidate_type"))


_ID_SQL = "sha256(coalesce(institution_id, '') || '||' || lower(trim(coalesce(email, ''), ' ')) || '||' || coalesce(name, '') || '||' || coalesce(candidate_type, ''))"
_OBS_SQL = f"select {_ID_SQL} identity, contact_id, institution_id, name, email, candidate_type, role, score, page_id, country, epoch_us(observed_at) observed from contacts"
_AS_OF_SQL = f"epoch_us(timestamp '{AS_OF}')"
_STALE_US = STALE_DAYS * 86_400_000_000


def observations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contacts").select(identity().alias("identity"), "contact_id", "institution_id", "name", "email", "candidate_type", "role", "score", "page_id", "country", us("observed_at").alias("observed"))


def contact_identity(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).select("contact_id", "identity")


def contact_latest(spark: SparkSession, d: str) -> DataFrame:
    return best_by(observations(spark, d), ["identity"], [F.col("observed"), F.col("contact_id")], ["contact_id", "role", "score", "observed"])


def contact_best(spark: SparkSession, d: str) -> DataFrame:
    order = [F.coalesce("score", F.lit(-(2**31))), F.col("observed"), F.col("contact_id")]
    return best_by(observations(spark, d), ["identity"], order, ["contact_id", "score"])


def primary_point(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ranked_contacts").filter("trim(email) <> ''").select("institution_id", F.lower(F.trim("email")).alias("point"), "ranked_id", (F.col("priority") == "high").alias("primary"), us("observed_at").alias("seen"), "source_url")
    return best_by(rows, ["institution_id", "point"], [F.col("primary").cast("int"), F.col("seen"), F.col("ranked_id")], ["ranked_id", "primary", "source_url"])


def observation_rollup(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d).groupBy("identity").agg(F.count("*").alias("observations"), F.max("observed").alias("last_seen"), F.min("observed").alias("first_seen"), F.countDistinct("page_id").alias("pages"))


def current_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Latest, best and rollup in one aggregation of the observations; one shuffle where three joins would take four."""
    obs = observations(spark, d)
    best = F.struct(F.coalesce("score", F.lit(-(2**31))).alias("k"), "observed", "contact_id")
    g = obs.groupBy("identity").agg(
        F.max_by(F.struct("contact_id", "institution_id", "name", "email", "candidate_type", "role", "country"), F.struct("observed", "contact_id")).alias("l"),
        F.max_by(F.struct("contact_id", "score"), best).alias("b"), F.count("*").alias("observations"), F.max("observed").alias("last_seen"),
    )
    return g.select(
        "identity", F.col("l.institution_id").alias("institution_id"), F.col("l.name").alias("name"), F.col("l.email").alias("email"), F.col("l.candidate_type").alias("candidate_type"), F.col("l.role").alias("role"),
        F.col("l.country").alias("country"), F.col("l.contact_id").alias("latest_id"), F.col("b.contact_id").alias("best_id"), F.col("b.score").alias("best_score"), "observations", "last_seen",
        (F.col("last_seen") + _STALE_US).alias("stale_after"), (F.col("last_seen") + _STALE_US < us(as_of())).alias("is_stale"),
    )


_CURRENT_SQL = f"""select identity, arg_max(institution_id, (observed, contact_id)) institution_id, arg_max_null(name, (observed, contact_id)) "name", arg_max_null(email, (observed, contact_id)) email,
  arg_max_null(candidate_type, (observed, contact_id)) candidate_type, arg_max_null(role, (observed, contact_id)) "role", arg_max_null(country, (observed, contact_id)) country,
  arg_max(contact_id, (observed, contact_id)) latest_id, arg_max(contact_id, (coalesce(score, -2147483648), observed, contact_id)) best_id, arg_max_null(score, (coalesce(score, -2147483648), observed, contact_id)) best_score,
  count(*) observations, max(observed) last_seen, max(observed) + {_STALE_US} stale_after, max(observed) + {_STALE_US} < {_AS_OF_SQL} is_stale from ({_OBS_SQL}) group by identity"""


def current_institutions(spark: SparkSession, d: str) -> DataFrame:
    inst = table(spark, d, "institutions").select("institution_id", "canonical_name", "country_code", "current_status", "home_domain")
    runs = table(spark, d, "runs").filter("country_code is not null").select("country_code", "run_id", "status", F.coalesce(us("finished_at"), F.lit(-1)).alias("done"))
    last = best_by(runs, ["country_code"], [F.col("done"), F.col("run_id")], ["run_id", "status"]).select("country_code", F.col("run_id").alias("last_run"), F.col("status").alias("last_status"))
    good = best_by(runs.filter("status = 'completed'"), ["country_code"], [F.col("done"), F.col("run_id")], ["run_id"]).select("country_code", F.col("run_id").alias("last_success"))
    pages = table(spark, d, "acquired_pages").select("institution_id", "page_id", "url", "http_status", us("fetched_at").alias("fetched"))
    seed = best_by(pages, ["institution_id"], [(F.coalesce("http_status", F.lit(0)) == 200).cast("int"), F.col("fetched"), F.col("page_id")], ["url"]).select("institution_id", F.col("url").alias("seed_url"))
    people = current_contacts(spark, d).groupBy("institution_id").agg(
        F.count("*").alias("contacts"), F.count_if(F.col("best_score") >= 5).alias("strong"), F.count_if("is_stale").alias("stale"), F.max("last_seen").alias("last_contact"), F.min(F.when(~F.col("is_stale"), F.col("stale_after"))).alias("next_refresh"))
    out = inst.join(people, "institution_id", "left").join(seed, "institution_id", "left").join(F.broadcast(last), "country_code", "left").join(F.broadcast(good), "country_code", "left")
    n = F.coalesce("contacts", F.lit(0))
    coverage = F.when(n == 0, F.when(F.col("last_run").isNull(), "never_run").when(F.col("last_success").isNull(), "failed").otherwise("no_contacts")).when(F.coalesce("strong", F.lit(0)) > 0, "covered").otherwise("weak")
    return out.select("institution_id", "canonical_name", "country_code", "home_domain", n.alias("contacts"), F.coalesce("strong", F.lit(0)).alias("strong"), F.coalesce("stale", F.lit(0)).alias("stale"), "last_contact", "next_refresh", "seed_url", "last_run", "last_status", "last_success", coverage.alias("coverage_status"))


_INSTITUTION_SQL = f"""with cur as ({_CURRENT_SQL}),
 runs_ as (select country_code, run_id, status, coalesce(epoch_us(finished_at), -1) done from runs where country_code is not null),
 last_ as (select country_code, arg_max(run_id, (done, run_id)) last_run, arg_max(status, (done, run_id)) last_status from runs_ group by 1),
 good_ as (select country_code, arg_max(run_id, (done, run_id)) last_success from runs_ where status = 'completed' group by 1),
 seed_ as (select institution_id, arg_max(url, ((coalesce(http_status, 0) = 200)::int, epoch_us(fetched_at), page_id)) seed_url from acquired_pages group by 1),
 people_ as (select institution_id, count(*) contacts, count(*) filter (best_score >= 5) strong, count(*) filter (is_stale) stale, max(last_seen) last_contact, min(stale_after) filter (not is_stale) next_refresh from cur group by 1)
 select institution_id, canonical_name, country_code, home_domain, coalesce(contacts, 0) contacts, coalesce(strong, 0) strong, coalesce(stale, 0) stale, last_contact, next_refresh, seed_url, last_run, last_status, last_success,
 case when coalesce(contacts, 0) = 0 then case when last_run is null then 'never_run' when last_success is null then 'failed' else 'no_contacts' end when coalesce(strong, 0) > 0 then 'covered' else 'weak' end coverage_status
 from institutions left join people_ using (institution_id) left join seed_ using (institution_id) left join last_ using (country_code) left join good_ using (country_code)"""


def coverage_histogram(spark: SparkSession, d: str) -> DataFrame:
    return current_institutions(spark, d).groupBy("coverage_status").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "coverage_status")


def search_contacts(spark: SparkSession, d: str, text: str = "%an%", confidence: str = "high") -> DataFrame:
    """Three columns searched without regard to case; best 250 (the page size of the report)."""
    rows = table(spark, d, "ranked_contacts").join(table(spark, d, "institutions").select("institution_id", "canonical_name"), "institution_id")
    hit = F.col("name").ilike(text) | F.col("email").ilike(text) | F.col("canonical_name").ilike(text)
    level = F.lower(F.trim("confidence"))
    found = rows.filter(hit & (level == confidence))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return found.orderBy(rank, us("observed_at").desc_nulls_last(), "ranked_id").limit(250).select("ranked_id", "name", "email", "canonical_name")


def search_institutions(spark: SparkSession, d: str, text: str = "%uni%") -> DataFrame:
    found = current_institutions(spark, d).filter(F.col("canonical_name").ilike(text) | F.col("home_domain").ilike(text))
    return found.orderBy("country_code", F.col("contacts").desc_nulls_last(), "institution_id").limit(250).select("institution_id", "canonical_name", "contacts", "coverage_status")


def run_overview(spark: SparkSession, d: str) -> DataFrame:
    """Latest 40 runs with three counts each; the counts are aggregated once and joined."""
    per = table(spark, d, "ranked_contacts").groupBy("run_id").agg(F.count("*").alias("candidates"), F.countDistinct("institution_id").alias("institutions"), F.count_if(F.col("priority") == "high").alias("high"))
    runs = table(spark, d, "runs").join(per, "run_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("candidates", "institutions", "high")]
    return runs.orderBy(us("started_at").desc(), F.col("run_id").desc()).limit(40).select("run_id", "status", *zero)


def totals(spark: SparkSession, d: str) -> DataFrame:
    """Six scalar counts in one row, each a partial aggregation over its own table."""
    names = ("institutions", "runs", "contacts", "ranked_contacts", "acquired_pages", "fetched_extractions")
    out = None
    for name in names:
        one = table(spark, d, name).agg(F.count("*").alias(f"n_{name}"))
        out = one if out is None else out.crossJoin(one)  # single rows on both sides
    return out


def target_detail(spark: SparkSession, d: str) -> DataFrame:
    """Pages of every institution with what was extracted from them, joined on the page."""
    pages = table(spark, d, "acquired_pages").select("page_id", "institution_id", "http_status", us("fetched_at").alias("fetched"))
    ext = table(spark, d, "fetched_extractions").select("page_id", "extraction_id", "mailto_count", us("extracted_at").alias("extracted"))
    inst = table(spark, d, "institutions").select("institution_id", "canonical_name")
    return pages.join(ext, "page_id", "left").join(inst, "institution_id").select("canonical_name", "page_id", "http_status", "fetched", "extraction_id", "mailto_count", "extracted")


def run_lookup(spark: SparkSession, d: str, run_id: int = 7) -> DataFrame:
    return table(spark, d, "runs").filter(F.col("run_id") == run_id).select("run_id", "run_mode", "source_type", "status")


def live_run(spark: SparkSession, d: str) -> DataFrame:
    """For every run, the latest run of its country that started no earlier (the run a job shows as live)."""
    runs = table(spark, d, "runs").filter("country_code is not null").select("country_code", "run_id", us("started_at").alias("started"))
    latest = best_by(runs, ["country_code"], [F.col("started"), F.col("run_id")], ["run_id"]).select("country_code", F.col("run_id").alias("live_run"))
    return runs.join(latest, "country_code").select("run_id", "live_run")


def evidence_order(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows of each run by confidence, then recency: the first twelve of each."""
    level = F.lower(F.trim("confidence"))
    order = [F.when(level == "high", 0).when(level == "medium", 1).when(level == "low", 2).otherwise(3), us("observed_at").desc_nulls_last(), F.col("ranked_id")]
    return top_per_group(table(spark, d, "ranked_contacts"), ["run_id"], order, 12, "position").select("run_id", "position", "ranked_id")


def recrawl_due(spark: SparkSession, d: str) -> DataFrame:
    """Institutions whose freshest contact is stale, or that have none, with the day they fell due."""
    inst = current_institutions(spark, d)
    return inst.filter("last_contact is null or stale = contacts").select("institution_id", "coverage_status", (F.col("last_contact") + _STALE_US).alias("due"))


QUERIES = {
    "contact_identity": (contact_identity, f"select contact_id, {_ID_SQL} as identity from contacts"),
    "contact_latest": (contact_latest, f"select identity, arg_max(contact_id, (observed, contact_id)) contact_id, arg_max_null(role, (observed, contact_id)) \"role\", arg_max_null(score, (observed, contact_id)) score, max(observed) observed from ({_OBS_SQL}) group by 1"),
    "contact_best": (contact_best, f"select identity, arg_max(contact_id, (coalesce(score, -2147483648), observed, contact_id)) contact_id, arg_max_null(score, (coalesce(score, -2147483648), observed, contact_id)) score from ({_OBS_SQL}) group by 1"),
    "primary_point": (primary_point, "select institution_id, lower(trim(email, ' ')) point, arg_max(ranked_id, ((priority = 'high')::int, epoch_us(observed_at), ranked_id)) ranked_id, arg_max(priority = 'high', ((priority = 'high')::int, epoch_us(observed_at), ranked_id)) \"primary\", arg_max(source_url, ((priority = 'high')::int, epoch_us(observed_at), ranked_id)) source_url from ranked_contacts where trim(email, ' ') <> '' group by 1, 2"),
    "observation_rollup": (observation_rollup, f"select identity, count(*) observations, max(observed) last_seen, min(observed) first_seen, count(distinct page_id) pages from ({_OBS_SQL}) group by 1"),
    "contact_current_state": (current_contacts, _CURRENT_SQL),
    "institution_current_state": (current_institutions, _INSTITUTION_SQL),
    "coverage_histogram": (coverage_histogram, f"select coverage_status, count(*) n from ({_INSTITUTION_SQL}) group by 1"),
    "search_contacts": (search_contacts, "select ranked_id, name, email, canonical_name from ranked_contacts join institutions using (institution_id) where (name ilike '%an%' or email ilike '%an%' or canonical_name ilike '%an%') and lower(trim(confidence, ' ')) = 'high' order by case priority when 'high' then 0 when 'medium' then 1 else 2 end, epoch_us(observed_at) desc nulls last, ranked_id limit 250"),
    "search_institutions": (search_institutions, f"select institution_id, canonical_name, contacts, coverage_status from ({_INSTITUTION_SQL}) where canonical_name ilike '%uni%' or home_domain ilike '%uni%' order by country_code, contacts desc nulls last, institution_id limit 250"),
    "run_overview": (run_overview, "select r.run_id, r.status, (select count(*) from ranked_contacts c where c.run_id = r.run_id) candidates, (select count(distinct institution_id) from ranked_contacts c where c.run_id = r.run_id) institutions, (select count(*) from ranked_contacts c where c.run_id = r.run_id and priority = 'high') high from runs r order by epoch_us(started_at) desc, run_id desc limit 40"),
    "totals": (totals, "select (select count(*) from institutions) n_institutions, (select count(*) from runs) n_runs, (select count(*) from contacts) n_contacts, (select count(*) from ranked_contacts) n_ranked_contacts, (select count(*) from acquired_pages) n_acquired_pages, (select count(*) from fetched_extractions) n_fetched_extractions"),
    "target_detail": (target_detail, "select canonical_name, p.page_id, http_status, epoch_us(fetched_at) fetched, extraction_id, mailto_count, epoch_us(extracted_at) extracted from acquired_pages p left join fetched_extractions e on e.page_id = p.page_id join institutions i on i.institution_id = p.institution_id"),
    "run_lookup": (run_lookup, "select run_id, run_mode, source_type, status from runs where run_id = 7"),
    "live_run": (live_run, "select r.run_id, (select x.run_id from runs x where x.country_code = r.country_code order by epoch_us(started_at) desc, run_id desc limit 1) live_run from runs r where country_code is not null"),
    "evidence_order": (evidence_order, "select run_id, position, ranked_id from (select run_id, ranked_id, row_number() over (partition by run_id order by case lower(trim(confidence, ' ')) when 'high' then 0 when 'medium' then 1 when 'low' then 2 else 3 end, epoch_us(observed_at) desc nulls last, ranked_id) position from ranked_contacts) where position <= 12"),
    "recrawl_due": (recrawl_due, f"select institution_id, coverage_status, last_contact + {_STALE_US} due from ({_INSTITUTION_SQL}) where last_contact is null or stale = contacts"),
}
