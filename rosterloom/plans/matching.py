"""Joins, caches and upserts of the observation store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails, text
from rosterloom.operators.records import best_by, first_seen, fold_records, insert_ignore, resolve_redirects, top_per_group, unexpired, upsert
from rosterloom.plans.views import us
from rosterloom.session import table

SPLIT = "2025-01-01 00:00:00"
#: The day that caches are looked at.
DAY = "2025-06-30 00:00:00"


def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Contacts before and from the split day: the store as it is, and a batch that comes in."""
    c = table(spark, d, "contacts")
    day = F.lit(SPLIT).cast("timestamp")
    return c.filter(F.col("observed_at") < day), c.filter(F.col("observed_at") >= day)


_OLD, _NEW = f"observed_at < timestamptz '{SPLIT}+00'", f"observed_at >= timestamptz '{SPLIT}+00'"


def _domains(df: DataFrame) -> DataFrame:
    return df.groupBy("home_domain").agg(F.max(us("observed_at")).alias("last_seen"), F.min(us("observed_at")).alias("first_seen"), F.count("*").alias("hits"), F.max(F.coalesce("score", F.lit(0))).alias("trust"), F.max(F.col("candidate_type") == "person").alias("has_person"))


_DOM = "select home_domain, max(epoch_us(observed_at)) last_seen, min(epoch_us(observed_at)) first_seen, count(*) hits, max(coalesce(score, 0)) trust, bool_or(candidate_type = 'person') has_person from contacts where {w} group by 1"


def merge_domains(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by domain: first and last sight, hits added up, trust the greater, flag either."""
    old, new = _split(spark, d)
    return upsert(_domains(old), _domains(new), ["home_domain"], {
        "first_seen": F.least("c.first_seen", "i.first_seen"), "last_seen": F.greatest("c.last_seen", "i.last_seen"), "hits": F.coalesce("c.hits", F.lit(0)) + F.coalesce("i.hits", F.lit(0)),
        "trust": F.greatest("c.trust", "i.trust"), "has_person": F.coalesce("c.has_person", F.lit(False)) | F.coalesce("i.has_person", F.lit(False))})


def merge_last_writer(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by (institution, e-mail): the last writer wins in every column."""
    old, new = _split(spark, d)
    key = ["institution_id", "mail"]
    pick = lambda df: best_by(df.withColumn("mail", emails.normalized(F.col("email"))).filter("mail <> ''").withColumn("at", us("observed_at")), key, [F.col("at"), F.col("contact_id")], ["contact_id", "role", "score"])
    has = F.col("i.contact_id").isNotNull()
    return upsert(pick(old), pick(new), key, {c: F.when(has, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")) for c in ("contact_id", "role", "score")})


def merge_first_value(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by (institution, e-mail): a value that is there already stays, an empty one is filled."""
    old, new = _split(spark, d)
    key = ["institution_id", "mail"]

    def pick(df: DataFrame) -> DataFrame:
        rows = df.withColumn("mail", emails.normalized(F.col("email"))).filter("mail <> ''")
        return rows.groupBy(*key).agg(F.min_by("name", F.when(F.coalesce("name", F.lit("")) != "", F.col("contact_id"))).alias("name"), F.min_by("role", F.when(F.coalesce("role", F.lit("")) != "", F.col("contact_id"))).alias("role"))

    return upsert(pick(old), pick(new), key, {c: F.coalesce(F.nullif(F.col(f"c.{c}"), F.lit("")), F.col(f"i.{c}")) for c in ("name", "role")})


def merge_insert_ignore(spark: SparkSession, d: str) -> DataFrame:
    """Flags of institutions: those not known yet are added, the rest is left alone."""
    old, new = _split(spark, d)
    flags = lambda df, batch: df.select("institution_id", F.explode("cleanup_flags").alias("flag")).distinct().withColumn("batch", F.lit(batch))
    return insert_ignore(flags(old, "old"), flags(new, "new"), ["institution_id", "flag"])


def merge_append(spark: SparkSession, d: str) -> DataFrame:
    """Plain insert: both batches, counted per page and batch."""
    old, new = _split(spark, d)
    both = old.withColumn("batch", F.lit("old")).unionByName(new.withColumn("batch", F.lit("new")))
    return both.groupBy("page_id", "batch").agg(F.count("*").alias("n"))


def first_seen_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First sighting per institution and e-mail, marked before anything is filtered."""
    c = table(spark, d, "contacts").filter("trim(email) <> ''").withColumn("mail", F.lower(F.trim("email")))
    return first_seen(c, ["institution_id", "mail"], [us("observed_at"), F.col("contact_id")]).filter("not duplicate").select("institution_id", "mail", "contact_id", (F.coalesce("score", F.lit(0)) >= 5).alias("keep"))


def rank_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Best score per e-mail, then numbered within the institution."""
    c = table(spark, d, "contacts").filter("trim(email) <> ''").withColumn("mail", F.lower(F.trim("email")))
    best = best_by(c, ["institution_id", "mail"], [F.coalesce("score", F.lit(-99)), -F.col("contact_id")], ["contact_id", "score"])
    order = [F.coalesce("score", F.lit(-99)).desc(), F.col("contact_id")]
    return top_per_group(best, ["institution_id"], order, 2**31 - 1, "position").select("institution_id", "mail", "contact_id", "position")


def topk_per_institution(spark: SparkSession, d: str) -> DataFrame:
    order = [F.coalesce("score", F.lit(-99)).desc(), F.col("contact_id")]
    return top_per_group(table(spark, d, "contacts"), ["institution_id"], order, 5, "position").select("institution_id", "position", "contact_id")


def name_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Institutions asked for by name, without regard to case, accents and punctuation."""
    asked = table(spark, d, "institutions").filter(F.col("country_code").isin("DE", "FR")).select(text.alnum_key(F.col("normalized_name")).alias("k"))
    return table(spark, d, "institutions").withColumn("k", text.alnum_key(F.col("canonical_name"))).join(asked, "k", "left_semi").select("institution_id")


def name_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for that no institution of a country bears: here every name, once as it is and once with a word more."""
    i = table(spark, d, "institutions")
    asked = i.select(F.col("canonical_name").alias("asked")).unionByName(i.filter("country_code in ('DE', 'FR')").select(F.concat("canonical_name", F.lit(" Annexe")).alias("asked")))
    seen = i.filter("country_code in ('DE', 'FR', 'IT')").select(text.alnum_key(F.col("canonical_name")).alias("k"))
    return asked.withColumn("k", text.alnum_key(F.col("asked"))).join(seen, "k", "left_anti").select("asked")


def candidate_join_last(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows with the last contact of the same page and e-mail."""
    c = table(spark, d, "contacts").select(F.lower("page_url").alias("u"), F.lower(F.trim("email")).alias("m"), "contact_id", "role").filter("m <> ''")
    last = best_by(c, ["u", "m"], [F.col("contact_id")], ["contact_id", "role"])
    r = table(spark, d, "ranked_contacts").select("ranked_id", F.lower("source_url").alias("u"), F.lower(F.trim("email")).alias("m"))
    return r.join(last, ["u", "m"], "left").select("ranked_id", "contact_id", "role")


def page_by_either_url(spark: SparkSession, d: str) -> DataFrame:
    """The page of a ranked row: by its source address, else by its evidence address."""
    p = table(spark, d, "acquired_pages").groupBy("url").agg(F.max("page_id").alias("page"))
    r = table(spark, d, "ranked_contacts").select("ranked_id", "source_url", "evidence_url")
    a, b = p.select(F.col("url").alias("source_url"), F.col("page").alias("a")), p.select(F.col("url").alias("evidence_url"), F.col("page").alias("b"))
    return r.join(a, "source_url", "left").join(b, "evidence_url", "left").select("ranked_id", F.coalesce("a", "b").alias("page_id"))


def redirect_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Redirects (part n leads to part n div 3) followed up to three hops, without going in circles."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("url"))
    edges = table(spark, d, "part").filter("p_size > 5").select(F.col("p_partkey").cast("string").alias("source_url"), F.floor(F.col("p_partkey") / 3).cast("string").alias("target_url"))
    return resolve_redirects(p, "url", edges)


def ttl_filter(spark: SparkSession, d: str) -> DataFrame:
    """Cache rows alive on a day: 30 days for clicks and views, one day for the rest."""
    ev = table(spark, d, "events")
    ttl = F.when(F.col("event_type").isin("click", "view"), 30).otherwise(1)
    return unexpired(ev, F.col("ts").cast("timestamp"), F.lit("2024-02-15 00:00:00").cast("timestamp"), ttl).filter(F.col("ts") <= F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")).select("event_id", "event_type")


def negative_cache_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pages without those whose address answered 404, 410 or 451 within 30 days before the reference day."""
    dead = table(spark, d, "acquired_pages").filter(F.col("http_status").isin(404, 410, 451))
    dead = unexpired(dead, F.col("fetched_at"), F.lit(DAY).cast("timestamp"), 30).select("url")
    return table(spark, d, "acquired_pages").join(dead, "url", "left_anti").select("page_id")


def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of a host with a content that an earlier page of it has: the earliest page of that content."""
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id", us("fetched_at").alias("at"), text.content_signature(F.col("visible_text")).alias("sig"))
    first = best_by(p, ["institution_id", "sig"], [-F.col("at"), -F.col("page_id")], ["page_id"]).select("institution_id", "sig", F.col("page_id").alias("first_page"))
    return p.join(first, ["institution_id", "sig"]).filter("page_id <> first_page").select("page_id", "first_page")


def dead_shells(spark: SparkSession, d: str) -> DataFrame:
    """Renderings that come after two addresses of their origin turned out to be empty shells with one signature.

    The origin is the way of acquisition; the first character of the signature stands in for it, since no two pages of
    the test tables share the whole one.
    """
    e = table(spark, d, "fetched_extractions").select("extraction_id", "url", F.left("primary_content_signature", F.lit(1)).alias("signature"), "zero_evidence_shell", F.array_join("acquisition_modes", "+").alias("origin"), us("extracted_at").alias("at"))
    key = ["origin", "signature"]
    shell = e.filter("zero_evidence_shell and signature <> ''").groupBy(*key, "url").agg(F.min("at").alias("at"))
    # the second of the earliest two times, by two minima: no list of all times is gathered
    first = shell.groupBy(*key).agg(F.min(F.struct("at", "url")).alias("first"))
    second = shell.join(first, key).filter("url <> first.url").groupBy(*key).agg(F.min("at").alias("at"))
    death = second.groupBy("origin").agg(F.min("at").alias("death"))
    return e.join(death, "origin").filter("at > death").select("extraction_id", "death")


def record_fold(spark: SparkSession, d: str) -> DataFrame:
    """Evidence rows of one page and e-mail merged: best fields first, empty ones filled, flags united."""
    c = table(spark, d, "contacts").filter("page_id is not null").withColumn("mail", emails.normalized(F.col("email"))).filter("mail <> ''").withColumn("score", F.coalesce("score", F.lit(0)))
    out = fold_records(c, ["page_id", "mail"], "contact_id", "score", ["name", "role"], ["cleanup_flags"])
    return out.select("page_id", "mail", "score", "merged", "name", "role", F.array_join("cleanup_flags", ",").alias("flags"))


def email_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Offline reasons for every row of an e-mail list; probe results are joined on the address, not by position."""
    e = table(spark, d, "ranked_contacts").select("ranked_id", F.trim("email").alias("raw"), emails.normalized(F.col("email")).alias("mail"))
    probe = table(spark, d, "contacts").filter("trim(email) <> ''").groupBy(emails.normalized(F.col("email")).alias("mail")).agg(F.count("*").alias("seen"))
    reasons = F.array_compact(F.array(F.when(F.coalesce("raw", F.lit("")) == "", "missing"), F.when((F.col("raw") != "") & (F.col("mail") == ""), "invalid_syntax"), F.when((F.col("mail") != "") & emails.generic_mailbox(F.col("mail")), "role_address")))
    return e.join(probe, "mail", "left").select("ranked_id", F.array_join(reasons, ",").alias("reasons"), F.coalesce("seen", F.lit(0)).alias("seen"))


def term_containment(spark: SparkSession, d: str) -> DataFrame:
    """Term lists by language against roles: how many terms of the language's list a role holds."""
    packs = {"en": ["international", "mobility", "exchange", "admission"], "fr": ["relations", "mobilit", "échange", "admission"], "de": ["international", "mobilit", "austausch", "zulassung"]}
    c = table(spark, d, "contacts").select("contact_id", F.lower(F.coalesce("role", F.lit(""))).alias("role"))
    return c.select("contact_id", *[text.count_terms(F.col("role"), terms).alias(f"n_{lang}") for lang, terms in packs.items()])


def locale_join(spark: SparkSession, d: str) -> DataFrame:
    """Default and own pack of the country of each institution, by one broadcast of the fixed pack table."""
    packs = spark.createDataFrame([("*", "office"), ("*", "centre"), ("FR", "bureau"), ("FR", "service"), ("IT", "ufficio"), ("DE", "amt")], "country string, term string")
    i = table(spark, d, "institutions").select("institution_id", F.col("country_code").alias("own"))
    return i.join(F.broadcast(packs), (F.col("country") == F.col("own")) | (F.col("country") == "*")).groupBy("institution_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms"))


def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    """Bag union of evidence from contacts and ranked rows, numbered by source, counted by type."""
    a = table(spark, d, "contacts").select("evidence_type", F.lit(1).alias("ord"))
    b = table(spark, d, "ranked_contacts").select("evidence_type", F.lit(2).alias("ord"))
    return a.unionByName(b).groupBy("evidence_type", "ord").agg(F.count("*").alias("n"))


def flags_overlap(spark: SparkSession, d: str) -> DataFrame:
    block = F.array(F.lit("office_label_name"), F.lit("mailto_only"))
    return table(spark, d, "contacts").filter(F.arrays_overlap("cleanup_flags", block)).select("contact_id")


def typing_split(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name and e-mail disagree become two: a nameless mailbox and a person without e-mail."""
    c = table(spark, d, "contacts").select("contact_id", F.coalesce("name", F.lit("")).alias("name"), emails.normalized(F.col("email")).alias("mail"))
    odd = (F.col("name") != "") & (F.col("mail") != "") & emails.generic_mailbox(F.col("mail"))
    one = lambda kind, n, m: F.struct(F.lit(kind).alias("kind"), n.alias("name"), m.alias("mail"))
    empty = F.lit("")
    rows = F.when(odd, F.array(one("office", empty, F.col("mail")), one("person", F.col("name"), empty))).otherwise(F.array(one("row", F.col("name"), F.col("mail"))))
    return c.select("contact_id", F.explode(rows).alias("r")).select("contact_id", "r.kind", "r.name", "r.mail")


_MAILED = "(select *, lower(trim(email, ' ')) mail from contacts where trim(email, ' ') <> '')"
_NE = "from_norm"


def _queries() -> dict:
    from rosterloom.plans.scalars import _E

    norm = f"(select *, {_E} mail from contacts)"
    pick = lambda w: f"select institution_id, mail, arg_max(contact_id, (epoch_us(observed_at), contact_id)) contact_id, arg_max_null(role, (epoch_us(observed_at), contact_id)) \"role\", arg_max_null(score, (epoch_us(observed_at), contact_id)) score from {norm} where mail <> '' and {w} group by 1, 2"
    fill = lambda w: f"select institution_id, mail, arg_min(name, contact_id) filter (coalesce(name, '') <> '') \"name\", arg_min(role, contact_id) filter (coalesce(role, '') <> '') \"role\" from {norm} where mail <> '' and {w} group by 1, 2"
    return {
        "merge_domains": (merge_domains, f"select coalesce(c.home_domain, i.home_domain) home_domain, least(c.first_seen, i.first_seen) first_seen, greatest(c.last_seen, i.last_seen) last_seen, coalesce(c.hits, 0) + coalesce(i.hits, 0) hits, greatest(c.trust, i.trust) trust, coalesce(c.has_person, false) or coalesce(i.has_person, false) has_person from ({_DOM.format(w=_OLD)}) c full join ({_DOM.format(w=_NEW)}) i on c.home_domain = i.home_domain"),
        "merge_last_writer": (merge_last_writer, f"select coalesce(c.institution_id, i.institution_id) institution_id, coalesce(c.mail, i.mail) mail, coalesce(i.contact_id, c.contact_id) contact_id, case when i.contact_id is null then c.role else i.role end \"role\", case when i.contact_id is null then c.score else i.score end score from ({pick(_OLD)}) c full join ({pick(_NEW)}) i on c.institution_id = i.institution_id and c.mail = i.mail"),
        "merge_first_value": (merge_first_value, f"select coalesce(c.institution_id, i.institution_id) institution_id, coalesce(c.mail, i.mail) mail, coalesce(nullif(c.name, ''), i.name) \"name\", coalesce(nullif(c.role, ''), i.role) \"role\" from ({fill(_OLD)}) c full join ({fill(_NEW)}) i on c.institution_id = i.institution_id and c.mail = i.mail"),
        "merge_insert_ignore": (merge_insert_ignore, f"with o as (select distinct institution_id, unnest(cleanup_flags) flag from contacts where {_OLD}), n as (select distinct institution_id, unnest(cleanup_flags) flag from contacts where {_NEW}) select *, 'old' batch from o union all select *, 'new' from n where not exists (select 1 from o where o.institution_id = n.institution_id and o.flag = n.flag)"),
        "merge_append": (merge_append, f"select page_id, case when {_OLD} then 'old' else 'new' end batch, count(*) n from contacts group by 1, 2"),
        "first_seen_dedup": (first_seen_dedup, f"select institution_id, mail, contact_id, coalesce(score, 0) >= 5 keep from {_MAILED} qualify row_number() over (partition by institution_id, mail order by epoch_us(observed_at), contact_id) = 1"),
        "rank_dedup": (rank_dedup, f"select institution_id, mail, contact_id, row_number() over (partition by institution_id order by coalesce(score, -99) desc, contact_id)::int position from (select institution_id, mail, contact_id, score from {_MAILED} qualify row_number() over (partition by institution_id, mail order by coalesce(score, -99) desc, contact_id) = 1)"),
        "topk_per_institution": (topk_per_institution, "select institution_id, row_number() over (partition by institution_id order by coalesce(score, -99) desc, contact_id)::int position, contact_id from contacts qualify position <= 5"),
        "name_semi_join": (name_semi_join, "select institution_id from institutions i where regexp_replace(lower(strip_accents(replace(lower(canonical_name), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g') in (select regexp_replace(lower(strip_accents(replace(lower(normalized_name), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g') from institutions where country_code in ('DE', 'FR'))"),
        "name_anti_join": (name_anti_join, "with k as (select canonical_name, country_code, regexp_replace(lower(strip_accents(replace(lower(canonical_name), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g') k from institutions), a as (select canonical_name asked, k from k union all select canonical_name || ' Annexe', k || ' annexe' from k where country_code in ('DE', 'FR')) select asked from a where k not in (select k from k where country_code in ('DE', 'FR', 'IT'))"),
        "candidate_join_last": (candidate_join_last, "with l as (select lower(page_url) u, lower(trim(email, ' ')) m, max(contact_id) contact_id, arg_max_null(role, contact_id) \"role\" from contacts where trim(email, ' ') <> '' group by 1, 2) select ranked_id, l.contact_id, l.role \"role\" from ranked_contacts left join l on lower(source_url) = u and lower(trim(email, ' ')) = m"),
        "page_by_either_url": (page_by_either_url, "with p as (select url, max(page_id) page from acquired_pages group by 1) select ranked_id, coalesce(a.page, b.page) page_id from ranked_contacts left join p a on a.url = source_url left join p b on b.url = evidence_url"),
        "redirect_resolve": (redirect_resolve, "with e as (select p_partkey s, p_partkey // 3 t from part where p_size > 5), a as (select p_partkey u, coalesce(case when e.t <> p_partkey then e.t end, p_partkey) x from part left join e on e.s = p_partkey), b as (select u, x, coalesce(case when e.t not in (u, x) then e.t end, x) y from a left join e on e.s = x), c as (select u, coalesce(case when e.t not in (u, x, y) then e.t end, y) z from b left join e on e.s = y) select u::varchar url, z::varchar final_url from c"),
        "ttl_filter": (ttl_filter, "select event_id, event_type from events where ts > timestamp '2024-02-15 00:00:00' - case when event_type in ('click', 'view') then interval 30 day else interval 1 day end and ts <= timestamp '2024-02-15 00:00:00'"),
        "negative_cache_anti": (negative_cache_anti, f"select page_id from acquired_pages where url not in (select url from acquired_pages where http_status in (404, 410, 451) and epoch_us(fetched_at) > epoch_us(timestamp '{DAY}' - interval 30 day))"),
        "duplicate_pages": (duplicate_pages, "with p as (select page_id, institution_id, epoch_us(fetched_at) t, sha1(substring(lower(trim(regexp_replace(coalesce(visible_text, ''), '[\\s\\x{00a0}]+', ' ', 'g'), ' ')), 1, 2500)) sig from acquired_pages), f as (select institution_id, sig, arg_min(page_id, (t, page_id)) first_page from p group by 1, 2) select page_id, first_page from p join f using (institution_id, sig) where page_id <> first_page"),
        "dead_shells": (dead_shells, "with r as (select extraction_id, url, primary_content_signature[1] g, zero_evidence_shell, array_to_string(acquisition_modes, '+') o, epoch_us(extracted_at) t from fetched_extractions), s as (select o, g, url, min(t) t from r where zero_evidence_shell and g <> '' group by all), n as (select o, g, t, row_number() over (partition by o, g order by t, url) k from s), x as (select o, min(t) death from n where k = 2 group by 1) select extraction_id, death from r join x using (o) where t > death"),
        "record_fold": (record_fold, f"select page_id, mail, max(coalesce(score, 0)) score, count(*) merged, arg_max(name, (coalesce(score, 0), -contact_id)) filter (coalesce(name, '') <> '') \"name\", arg_max(role, (coalesce(score, 0), -contact_id)) filter (coalesce(role, '') <> '') \"role\", array_to_string(list_sort(list_distinct(flatten(list(cleanup_flags)))), ',') flags from {norm} where mail <> '' and page_id is not null group by 1, 2"),
        "email_verdicts": (email_verdicts, f"with p as (select {_E} mail, count(*) seen from contacts where trim(email, ' ') <> '' group by 1) select ranked_id, case when coalesce(raw, '') = '' then 'missing' when r.mail = '' then 'invalid_syntax' when regexp_matches(string_split(r.mail, '@')[1], '^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)') then 'role_address' else '' end reasons, coalesce(seen, 0) seen from (select ranked_id, trim(email, ' ') raw, {_E} mail from ranked_contacts) r left join p on p.mail = r.mail"),
        "term_containment": (term_containment, "select contact_id, contains(r, 'international')::int + contains(r, 'mobility')::int + contains(r, 'exchange')::int + contains(r, 'admission')::int n_en, contains(r, 'relations')::int + contains(r, 'mobilit')::int + contains(r, 'échange')::int + contains(r, 'admission')::int n_fr, contains(r, 'international')::int + contains(r, 'mobilit')::int + contains(r, 'austausch')::int + contains(r, 'zulassung')::int n_de from (select contact_id, lower(coalesce(role, '')) r from contacts)"),
        "locale_join": (locale_join, "with p(country, term) as (values ('*', 'office'), ('*', 'centre'), ('FR', 'bureau'), ('FR', 'service'), ('IT', 'ufficio'), ('DE', 'amt')) select institution_id, array_to_string(list_sort(list(distinct term)), ',') terms from institutions join p on country = country_code or country = '*' group by 1"),
        "evidence_union": (evidence_union, "select evidence_type, 1 ord, count(*) n from contacts group by 1 union all select evidence_type, 2, count(*) from ranked_contacts group by 1"),
        "flags_overlap": (flags_overlap, "select contact_id from contacts where list_has_any(cleanup_flags, ['office_label_name', 'mailto_only'])"),
        "typing_split": (typing_split, f"with c as (select contact_id, coalesce(name, '') n, {_E} m from contacts), o as (select *, n <> '' and m <> '' and regexp_matches(string_split(m, '@')[1], '^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)') odd from c) select contact_id, 'row' kind, n \"name\", m mail from o where not odd union all select contact_id, 'office', '', m from o where odd union all select contact_id, 'person', n, '' from o where odd"),
    }


QUERIES = _queries()
