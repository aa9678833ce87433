"""Ingest of result batches into the observation store, table by table and as a whole, and the institution view on it.

Rows of ``ranked_contacts`` stand for the contacts of traces, each run and institution being one trace. They are split by
day into the store as it is and a batch that comes in. Occurrences are counted before a merge, so that "one more per
sighting" adds the count of a batch. Merges read the current rows once, resolve column by column on a full outer join,
and write a new table; a replay of the same batch changes nothing but counters and plain inserts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails, text, urls
from rosterloom.operators.records import best_by, insert_ignore, upsert
from rosterloom.plans.views import us
from rosterloom.session import cut_lineage, table

SPLIT = "2025-01-01 00:00:00"
#: Names of contact kinds and levels that the store knows. Fixed values.
KINDS, CONFIDENCE, PRIORITY = ("person", "office", "generic_mailbox"), ("high", "medium", "low"), ("high", "medium", "ignore")
PERSON_STATUS, OFFICE_STATUS = ("named_contact", "direct_contact", "recovered_contact"), ("office_contact", "mailbox")


def one_of(col: Column, known: tuple[str, ...]) -> Column:
    """A level in lower case without blanks, NULL if it is not known."""
    v = F.lower(text.collapse_blanks(F.coalesce(col, F.lit(""))))
    return F.when(v.isin(list(known)), v)


def contact_kind(status: Column, name: Column, email: Column) -> Column:
    """The kind of a contact by its status, else by what it has: a name, a mailbox of nobody's, an office."""
    v = F.lower(text.collapse_blanks(F.coalesce(status, F.lit(""))))
    given = F.when(v.isin(list(KINDS)), v).when(v.isin(list(PERSON_STATUS)), "person").when(v.isin(list(OFFICE_STATUS)), "office")
    bare = F.when(F.coalesce(name, F.lit("")) != "", "person").when(emails.generic_mailbox(F.coalesce(email, F.lit(""))), "generic_mailbox").otherwise("office")
    return F.coalesce(given, bare)


def seed_type(source: Column, family: Column) -> Column:
    """Kind of a seed: source and family, or what there is of them."""
    s, f = F.coalesce(source, F.lit("")), F.coalesce(family, F.lit(""))
    return F.when(s != "", F.concat_ws(":", s, F.when(f == "", "generic").otherwise(f))).otherwise(F.when(f == "", "discovered").otherwise(f))


def target_status(failed: Column, contacts: Column) -> Column:
    return F.when(failed, "failed").when(contacts > 0, "completed").otherwise("completed_no_contacts")


def incoming(spark: SparkSession, d: str) -> DataFrame:
    """Contacts of all traces in the form of the store, with ``new`` telling the batch."""
    r = table(spark, d, "ranked_contacts")
    name = text.collapse_blanks(F.coalesce("name", F.lit("")))
    mail = F.lower(text.collapse_blanks(F.coalesce("email", F.lit(""))))
    r = r.select(
        "ranked_id", "run_id", "institution_id", name.alias("name"), text.alnum_key(name).alias("name_key"), F.when(F.contains(mail, F.lit("@")), mail).otherwise("").alias("mail"), F.coalesce("title", F.lit("")).alias("title"),
        urls.normalized(F.col("source_url")).alias("source_url"), F.col("source_url").alias("raw_url"), F.coalesce("evidence_url", F.lit("")).alias("evidence_url"), one_of(F.col("confidence"), CONFIDENCE).alias("confidence"), one_of(F.col("priority"), PRIORITY).alias("priority"),
        F.coalesce("email_source", F.lit("")).alias("email_source"), F.col("candidate_status").alias("status"), us("observed_at").alias("at"), (F.col("observed_at") >= F.lit(SPLIT).cast("timestamp")).alias("new"))
    r = r.withColumn("kind", contact_kind(F.lit(""), F.col("name"), F.col("mail")))
    r = r.withColumn("identity", text.joined_hash(F.col("institution_id"), F.col("mail"), F.col("name_key"), F.col("kind")))
    return r.withColumn("observation", text.joined_hash(F.col("institution_id"), F.col("mail"), F.col("name_key"), F.col("title"), F.when(F.col("evidence_url") != "", F.col("evidence_url")).otherwise(F.col("source_url")), F.col("status"), F.col("run_id")))


def _either(name: str) -> Column:
    return F.coalesce(f"c.{name}", F.lit(False)) | F.coalesce(f"i.{name}", F.lit(False))


def _sum(name: str) -> Column:
    return F.coalesce(f"c.{name}", F.lit(0)) + F.coalesce(f"i.{name}", F.lit(0))


def _newer(name: str) -> Column:
    return F.when(F.col("i.__i"), F.col(f"i.{name}")).otherwise(F.col(f"c.{name}"))


#: Tables of the store: key, how a batch is reduced to one row per key, and how the columns are resolved.
def _institutions(b: DataFrame) -> DataFrame:
    return b.groupBy("institution_id").agg(F.max("at").alias("last_seen"), F.min("at").alias("first_seen"))


def _domains(b: DataFrame) -> DataFrame:
    return b.filter("mail <> ''").groupBy(emails.domain(F.col("mail")).alias("domain")).agg(F.max("at").alias("last_seen")).select("domain", "last_seen", urls.registrable(F.col("domain")).alias("registrable"), (F.col("domain") != urls.registrable(F.col("domain"))).alias("is_subdomain"))


def _pages(b: DataFrame) -> DataFrame:
    g = best_by(b, ["source_url"], [F.col("at"), F.col("ranked_id")], ["raw_url", "at"])
    return g.select(F.col("source_url").alias("url"), "raw_url", urls.host(F.col("source_url")).alias("host"), urls.path(F.col("source_url")).alias("path"), F.col("at").alias("last_seen"))


def _points(b: DataFrame) -> DataFrame:
    return b.filter("mail <> ''").groupBy("identity", F.col("mail").alias("point")).agg(F.max(F.col("priority").eqNullSafe("high")).alias("is_primary"), F.lit(True).alias("is_active"))


def _contacts(b: DataFrame) -> DataFrame:
    return b.groupBy("identity").agg(F.min_by("name", F.when(F.col("name") != "", F.struct("at", "ranked_id"))).alias("name"), F.first("kind").alias("kind"))


def _observations(b: DataFrame) -> DataFrame:
    return b.groupBy("identity", "observation").agg(F.min_by("source_url", F.struct("at", "ranked_id")).alias("page"), F.max(F.col("confidence").isNotNull()).alias("was_exported"))


def _seeds(b: DataFrame) -> DataFrame:
    return b.withColumn("kind", seed_type(F.col("email_source"), F.lit(""))).groupBy("institution_id", F.col("source_url").alias("url"), "kind").agg(F.count("*").alias("times_used"), F.max("run_id").alias("run_id"), F.max(F.when(F.col("confidence") == "high", 10).otherwise(1)).alias("usefulness"))


def _targets(b: DataFrame) -> DataFrame:
    g = b.groupBy("run_id", "institution_id").agg(F.count("*").alias("contacts"), F.count_if(F.col("priority").eqNullSafe("high")).alias("qualified"), F.max("at").alias("at"))
    return g.withColumn("status", target_status(F.col("qualified") == 0, F.col("contacts")))


def _families(b: DataFrame) -> DataFrame:
    return b.filter("confidence is null").groupBy(urls.family_signature(F.col("source_url")).alias("signature")).agg(F.count("*").alias("hits"), F.max("at").alias("last_seen"))


TABLES = {
    "institutions": (["institution_id"], _institutions, lambda: {"first_seen": F.least("c.first_seen", "i.first_seen"), "last_seen": F.greatest("c.last_seen", "i.last_seen")}),
    "domains": (["domain"], _domains, lambda: {"last_seen": F.greatest("c.last_seen", "i.last_seen"), "registrable": _newer("registrable"), "is_subdomain": _newer("is_subdomain")}),
    "pages": (["url"], _pages, lambda: {c: _newer(c) for c in ("raw_url", "host", "path")} | {"last_seen": F.greatest("c.last_seen", "i.last_seen")}),
    "points": (["identity", "point"], _points, lambda: {"is_primary": _either("is_primary"), "is_active": F.coalesce(F.when(F.col("i.__i"), F.lit(True)), F.col("c.is_active"))}),
    "contacts": (["identity"], _contacts, lambda: {"name": F.coalesce("c.name", "i.name"), "kind": F.coalesce("c.kind", "i.kind")}),
    "observations": (["identity", "observation"], _observations, lambda: {"page": F.coalesce("c.page", "i.page"), "was_exported": _either("was_exported")}),
    "seeds": (["institution_id", "url", "kind"], _seeds, lambda: {"times_used": _sum("times_used"), "run_id": _newer("run_id"), "usefulness": F.greatest("c.usefulness", "i.usefulness")}),
    "targets": (["run_id", "institution_id"], _targets, lambda: {c: _newer(c) for c in ("contacts", "qualified", "at", "status")}),
    "families": (["signature"], _families, lambda: {"hits": _sum("hits"), "last_seen": F.greatest("c.last_seen", "i.last_seen")}),
}


def ingest(store: dict[str, DataFrame], batch: DataFrame) -> dict[str, DataFrame]:
    """The store after a batch; tables that the store lacks are begun."""
    out = {}
    for name, (keys, reduce, resolve) in TABLES.items():
        rows = reduce(batch)
        out[name] = upsert(store[name], rows, keys, resolve()) if name in store else rows
    return out


def _merged(spark: SparkSession, d: str, name: str, again: bool = False) -> DataFrame:
    """One table of the store after the old rows and the batch (``again``: and the batch once more)."""
    keys, reduce, resolve = TABLES[name]
    rows = incoming(spark, d)
    batch = reduce(rows.filter("new"))
    out = upsert(reduce(rows.filter("not new")), batch, keys, resolve())
    return upsert(out, batch, keys, resolve()) if again else out


def merge_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages by normalised address: the address as last given wins."""
    return _merged(spark, d, "pages")


def merge_store_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains: registrable part worked out anew, last sight."""
    return _merged(spark, d, "domains")


def merge_points(spark: SparkSession, d: str) -> DataFrame:
    """Contact points: primary once primary, active again when seen."""
    return _merged(spark, d, "points")


def merge_store_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts by identity: the first name stays."""
    return _merged(spark, d, "contacts").select("identity", F.coalesce("name", F.lit("")).alias("name"), "kind")


def merge_observations(spark: SparkSession, d: str) -> DataFrame:
    """Observations by (contact, hash): the first page stays, exported once exported."""
    return _merged(spark, d, "observations")


def merge_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Seed addresses: the greater usefulness, uses added up, the last run."""
    return _merged(spark, d, "seeds")


def merge_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets by (run, institution): the last writer wins in every column."""
    return _merged(spark, d, "targets")


def merge_dead_families(spark: SparkSession, d: str) -> DataFrame:
    """Families that failed: hits added up, last sight. The batch comes twice, and counts twice."""
    return _merged(spark, d, "families", again=True)


def merge_institution_domains(spark: SparkSession, d: str) -> DataFrame:
    """Domains of institutions: relation to the home domain, the greater trust, primary once primary, last sight."""
    home = table(spark, d, "institutions").select("institution_id", F.lower("home_domain").alias("home"))
    rows = incoming(spark, d).filter("mail <> ''").join(home, "institution_id").withColumn("domain", emails.domain(F.col("mail")))
    rows = rows.withColumn("relation", urls.domain_relationship(F.regexp_replace("home", r"^www\.", ""), F.col("domain")))
    reduce = lambda b: b.groupBy("institution_id", "domain", "relation").agg(F.max(urls.domain_trust(F.col("relation"))).cast("int").alias("trust"), F.max(F.col("relation") == "primary").alias("is_primary"), F.max("at").alias("last_seen"))
    return upsert(reduce(rows.filter("not new")), reduce(rows.filter("new")), ["institution_id", "domain", "relation"], {"trust": F.greatest("c.trust", "i.trust"), "is_primary": _either("is_primary"), "last_seen": F.greatest("c.last_seen", "i.last_seen")})


def merge_page_observations(spark: SparkSession, d: str) -> DataFrame:
    """Page observations: inserted if no row has the same six fields, missing ones being equal to missing ones."""
    e = table(spark, d, "fetched_extractions").join(table(spark, d, "acquired_pages").select("page_id", "institution_id", "http_status"), "page_id")
    six = ["page_id", "institution_id", "http_status", "mode", "stage", "parent"]
    e = e.select("page_id", "institution_id", "http_status", F.get("acquisition_modes", F.lit(0)).alias("mode"), F.when(F.col("shell_like"), "shell").alias("stage"), F.lit(None).cast("string").alias("parent"), us("extracted_at").alias("at"))
    day = F.unix_micros(F.lit(SPLIT).cast("timestamp"))
    old, new = e.filter(F.col("at") < day).groupBy(*six).agg(F.lit("old").alias("batch")), e.filter(F.col("at") >= day).groupBy(*six).agg(F.lit("new").alias("batch"))
    return insert_ignore(old, new, six).drop("parent")


def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs found by (mode, source, notes), else inserted: the first id of each stays."""
    r = table(spark, d, "runs").select("run_id", "run_mode", "source_type", F.coalesce("country_code", F.lit("")).alias("notes"))
    first = lambda df: df.groupBy("run_mode", "source_type", "notes").agg(F.min("run_id").alias("run_id"))
    return insert_ignore(first(r.filter("run_id % 2 = 0")), first(r.filter("run_id % 2 = 1")), ["run_mode", "source_type", "notes"]).select("run_id", "run_mode", "source_type", "notes")


def finish_runs(spark: SparkSession, d: str) -> DataFrame:
    """Open runs that got rows are finished with their last row's time; changed rows are stamped, others keep their stamp."""
    r = table(spark, d, "runs").select("run_id", "status", us("started_at").alias("started"), us("finished_at").alias("finished"))
    done = incoming(spark, d).groupBy("run_id").agg(F.max("at").alias("at"))
    change = F.col("finished").isNull() & F.col("at").isNotNull()
    j = r.join(done, "run_id", "left")
    return j.select("run_id", F.when(change, "completed").otherwise(F.col("status")).alias("status"), F.when(change, F.greatest("at", "started")).otherwise(F.col("finished")).alias("finished"), F.when(change, F.unix_micros(F.lit(SPLIT).cast("timestamp"))).otherwise(F.col("started")).alias("updated"))


def trace_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The whole ingest: old rows, then the batch, then the batch again; rows of every table after each step.

    The last two counts of a table are equal: a replay adds no row.
    """
    rows = cut_lineage(incoming(spark, d))
    steps, store = [], {}
    for step, part in enumerate((rows.filter("not new"), rows.filter("new"), rows.filter("new"))):
        store = {k: cut_lineage(v) for k, v in ingest(store, part).items()}
        steps += [v.agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(k).alias("tbl"), "n") for k, v in store.items()]
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out


def store_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels, kinds and seeds of rows in the words of the store."""
    r = table(spark, d, "ranked_contacts")
    return r.select("ranked_id", one_of(F.col("confidence"), CONFIDENCE).alias("confidence"), one_of(F.col("priority"), PRIORITY).alias("priority"), contact_kind(F.col("candidate_status"), F.col("name"), F.col("email")).alias("kind"), seed_type(F.col("email_source"), F.lit("")).alias("seed"))


def institution_state(spark: SparkSession, d: str) -> DataFrame:
    """Every institution with its best seed, primary domain, last and last good target, contact counts, next retry, coverage.

    Targets are runs of institutions; the retry queue holds the renderings that were cut short.
    """
    inst = table(spark, d, "institutions").select("institution_id")
    runs = table(spark, d, "runs").select("run_id", us("finished_at").alias("finished"), F.col("status").alias("run_status"))
    t = table(spark, d, "ranked_contacts").select("institution_id", "run_id").distinct().join(runs, "run_id")
    order = [F.coalesce("finished", F.lit(-1)), F.col("run_id")]
    last = best_by(t, ["institution_id"], order, ["run_id"]).select("institution_id", F.col("run_id").alias("last_target"))
    good = best_by(t.filter("run_status = 'completed'"), ["institution_id"], order, ["run_id", "finished"]).select("institution_id", F.col("run_id").alias("last_good_target"), F.col("finished").alias("last_success"))
    dom = merge_institution_domains(spark, d).filter("is_primary").join(_merged(spark, d, "domains").select("domain", "registrable"), "domain")
    dom = best_by(dom, ["institution_id"], [F.col("last_seen"), F.col("domain")], ["domain"]).select("institution_id", F.col("domain").alias("primary_domain"))
    c = _merged(spark, d, "contacts").join(incoming(spark, d).groupBy("identity", "institution_id").agg(F.max(F.col("confidence").eqNullSafe("high")).alias("high"), F.max("at").alias("at")), "identity")
    people = c.groupBy("institution_id").agg(F.count("*").alias("contacts"), F.count_if(F.coalesce("name", F.lit("")) != "").alias("named"), F.count_if("high").alias("high"), F.max("at").alias("last_contact"))
    retry = table(spark, d, "fetched_extractions").filter("short_circuited_shell").join(table(spark, d, "acquired_pages").select("page_id", "institution_id"), "page_id").groupBy("institution_id").agg(F.min(us("extracted_at")).alias("next_retry"))
    seed = best_by(_merged(spark, d, "seeds"), ["institution_id"], [F.col("usefulness"), F.col("times_used"), F.col("url"), F.col("kind")], ["url"]).select("institution_id", F.col("url").alias("seed_url"))
    out = inst
    for part in (seed, dom, last, good, people, retry):
        out = out.join(part, "institution_id", "left")
    n = F.coalesce("contacts", F.lit(0))
    coverage = F.when(n > 0, "covered").when(F.col("last_good_target").isNotNull(), "explored_no_contacts").when(F.col("last_target").isNotNull(), "attempted").otherwise("unseen")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("contacts", "named", "high")]
    return out.select("institution_id", "seed_url", "primary_domain", "last_target", "last_good_target", "last_success", *zero, "last_contact", "next_retry", coverage.alias("coverage"))


def redirect_cache(spark: SparkSession, d: str) -> DataFrame:
    """Redirects as they are cached: entries of the last 30 days only, one step per address; parts lead to parts."""
    from rosterloom.operators.records import resolve_redirects, unexpired

    p = table(spark, d, "part")
    cached = p.select(F.col("p_partkey").cast("string").alias("source_url"), F.floor(F.col("p_partkey") / 2).cast("string").alias("target_url"), F.timestamp_add("DAY", (F.col("p_partkey") % 60).cast("int"), F.lit("2025-05-01 00:00:00").cast("timestamp")).alias("cached_at"))
    alive = unexpired(cached, F.col("cached_at"), F.lit("2025-06-25 00:00:00").cast("timestamp"), 30)
    return resolve_redirects(p.select(F.col("p_partkey").cast("string").alias("url")), "url", alive.select("source_url", "target_url"))


def dead_family_anti(spark: SparkSession, d: str) -> DataFrame:
    """Pages without those whose family failed within 30 days; a page's own time says when."""
    from rosterloom.operators.records import unexpired

    p = table(spark, d, "acquired_pages").select("page_id", "fetched_at", urls.family_signature(F.col("url")).alias("signature"), "shell_like")
    dead = unexpired(p.filter("shell_like"), F.col("fetched_at").cast("timestamp"), F.lit("2025-03-31 00:00:00").cast("timestamp"), 30).select("signature")
    return p.join(dead, "signature", "left_anti").select("page_id")


def _queries() -> dict:
    from rosterloom.plans.scalars import _FOLD, _HOST, _NET, _PATH, _REG, _SCHEME

    flat = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '[\\s\\x{{00a0}}]+', ' ', 'g'), ' ')"
    u = {"u": "source_url"}
    address = f"case when {_NET.format(**u)} = '' then source_url else case when {_SCHEME.format(**u)} = '' then 'https' else {_SCHEME.format(**u)} end || '://' || case when {_SCHEME.format(**u)} = 'http' then regexp_replace({_NET.format(**u)}, ':80$', '') when {_SCHEME.format(**u)} = 'https' then regexp_replace({_NET.format(**u)}, ':443$', '') else {_NET.format(**u)} end || case when {_PATH.format(**u)} = '' then '/' else {_PATH.format(**u)} end || case when regexp_extract(source_url, '\\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(source_url, '\\?([^#]*)', 1) end end"
    gen = "(?i)^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)"
    bare = lambda nm, ml: f"case when coalesce({nm}, '') <> '' then 'person' when regexp_matches(split_part(lower(coalesce({ml}, '')), '@', 1), '{gen}') then 'generic_mailbox' else 'office' end"
    lvl = lambda c, k: f"case when lower({flat(c)}) in ({', '.join(chr(39) + x + chr(39) for x in k)}) then lower({flat(c)}) end"
    inc = f"""(select *, sha256(coalesce(institution_id, '') || '||' || mail || '||' || name_key || '||' || kind) identity, sha256(coalesce(institution_id, '') || '||' || mail || '||' || name_key || '||' || title || '||' || case when evidence_url <> '' then evidence_url else source_url end || '||' || coalesce(status, '') || '||' || run_id::varchar) observation, string_split(mail, '@')[-1] dom from (
      select ranked_id, run_id, institution_id, nm "name", trim(regexp_replace({_FOLD.format(c='nm')}, '[^a-z0-9]+', ' ', 'g'), ' ') name_key, mail, coalesce(title, '') title, {address} source_url, source_url raw_url, coalesce(evidence_url, '') evidence_url, {lvl('confidence', CONFIDENCE)} confidence, {lvl('priority', PRIORITY)} priority, coalesce(email_source, '') email_source, candidate_status status, epoch_us(observed_at) t, observed_at >= timestamptz '{SPLIT}+00' new_, {bare('nm', 'mail')} kind
      from (select *, {flat('"name"')} nm, case when contains(lower({flat('email')}), '@') then lower({flat('email')}) else '' end mail from ranked_contacts)))"""
    home = "regexp_replace(lower(home_domain), '^www\\.', '')"
    rel = f"case when dom = '' then 'secondary' when dom = {home} then 'primary' when {_REG.format(h='dom')} = {_REG.format(h=home)} then 'subsite' else 'partner' end"
    idom = f"(select institution_id, dom \"domain\", rel relation, max(case rel when 'primary' then 100 when 'subsite' then 80 when 'partner' then 30 else 50 end) trust, bool_or(rel = 'primary') is_primary, max(t) last_seen from (select x.*, {rel} rel from {inc} x join institutions using (institution_id) where mail <> '') group by 1, 2, 3)"
    seeds = f"(select institution_id, source_url url, case when email_source <> '' then email_source || ':generic' else 'discovered' end kind, count(*) times_used, coalesce(max(run_id) filter (new_), max(run_id)) run_id, max(case when confidence = 'high' then 10 else 1 end) usefulness from {inc} group by 1, 2, 3)"
    contacts = f"(select identity, coalesce(arg_min(\"name\", (new_, t, ranked_id)) filter (\"name\" <> ''), '') \"name\", any_value(kind) kind from {inc} group by 1)"
    targets = f"select run_id, institution_id, count(*) contacts, count(*) filter (priority = 'high') qualified, max(t) \"at\", new_ from {inc} group by run_id, institution_id, new_"
    counts = {"institutions": "institution_id", "domains": "dom", "pages": "source_url", "points": "(identity, mail)", "contacts": "identity", "observations": "(identity, observation)", "seeds": "(institution_id, source_url, email_source)", "targets": "(run_id, institution_id)", "families": "fs"}
    where = {"domains": " and mail <> ''", "points": " and mail <> ''", "families": " and confidence is null"}
    su = "source_url"
    segs = f"list_filter(list_transform(list_filter(string_split({_PATH.format(u=su)}, '/'), lambda x: x <> ''), lambda x: array_to_string(regexp_extract_all(regexp_replace(lower(trim(x)), '\\.(?:html?|php|aspx?)$', ''), '[a-z0-9]+'), '-')), lambda x: x <> '' and x not in ('en', 'it', 'fr', 'de', 'es', 'pt', 'nl', 'index', 'home'))"
    sig = f"{_NET.format(u=su)} || ':' || case when len({segs}) = 0 then 'root' when {segs}[-1] in ('about', 'leadership', 'office', 'services', 'service', 'contacts', 'contact') and len({segs}) >= 2 then {segs}[-2] || '::' || {segs}[-1] else {segs}[-1] end"
    pu = sig.replace("source_url", "url")
    trace = " union all ".join(f"select {step} step, '{k}' tbl, count(distinct {v}) n from z where {'not new_' if step == 0 else 'true'}{where.get(k, '')}" for step in range(3) for k, v in counts.items())
    st = "(select institution_id, r.run_id, coalesce(epoch_us(finished_at), -1) f, epoch_us(finished_at) fin, status from (select distinct institution_id, run_id from ranked_contacts) r join runs using (run_id))"
    return {
        "merge_pages": (merge_pages, f"select source_url url, arg_max(raw_url, (new_, t, ranked_id)) raw_url, {_HOST.format(u=su)} \"host\", {_PATH.format(u=su)} \"path\", max(t) last_seen from {inc} group by source_url"),
        "merge_store_domains": (merge_store_domains, f"select dom \"domain\", max(t) last_seen, {_REG.format(h='dom')} registrable, dom <> {_REG.format(h='dom')} is_subdomain from {inc} where mail <> '' group by dom"),
        "merge_points": (merge_points, f"select identity, mail point, bool_or(coalesce(priority = 'high', false)) is_primary, true is_active from {inc} where mail <> '' group by 1, 2"),
        "merge_store_contacts": (merge_store_contacts, f"select * from {contacts}"),
        "merge_observations": (merge_observations, f"select identity, observation, arg_min(source_url, (new_, t, ranked_id)) page, bool_or(confidence is not null) was_exported from {inc} group by 1, 2"),
        "merge_seeds": (merge_seeds, f"select * from {seeds}"),
        "merge_targets": (merge_targets, f"select run_id, institution_id, contacts, qualified, \"at\", case when qualified = 0 then 'failed' when contacts > 0 then 'completed' else 'completed_no_contacts' end status from ({targets}) qualify row_number() over (partition by run_id, institution_id order by new_ desc) = 1"),
        "merge_dead_families": (merge_dead_families, f"select {sig} signature, count(*) + count(*) filter (new_) hits, max(t) last_seen from {inc} where confidence is null group by 1"),
        "merge_institution_domains": (merge_institution_domains, f"select * from {idom}"),
        "merge_page_observations": (merge_page_observations, f"select distinct page_id, institution_id, http_status, acquisition_modes[1] \"mode\", case when shell_like_ then 'shell' end stage, case when min(epoch_us(extracted_at)) over w < epoch_us(timestamp '{SPLIT}') then 'old' else 'new' end batch from (select e.*, e.shell_like shell_like_, institution_id, http_status from fetched_extractions e join acquired_pages p on p.page_id = e.page_id) window w as (partition by page_id, institution_id, http_status, acquisition_modes[1], shell_like_)"),
        "merge_runs": (merge_runs, "select coalesce(min(run_id) filter (run_id % 2 = 0), min(run_id)) run_id, run_mode, source_type, coalesce(country_code, '') notes from runs group by 2, 3, 4"),
        "finish_runs": (finish_runs, f"select run_id, case when c then 'completed' else status end status, case when c then greatest(a, epoch_us(started_at)) else epoch_us(finished_at) end finished, case when c then epoch_us(timestamp '{SPLIT}') else epoch_us(started_at) end updated from (select runs.*, a, finished_at is null and a is not null c from runs left join (select run_id, max(epoch_us(observed_at)) a from ranked_contacts group by 1) using (run_id))"),
        "trace_ingest": (trace_ingest, f"with z as (select *, {sig} fs from {inc}) {trace}"),
        "store_levels": (store_levels, f"select ranked_id, {lvl('confidence', CONFIDENCE)} confidence, {lvl('priority', PRIORITY)} priority, case when lower({flat('candidate_status')}) in ('person', 'office', 'generic_mailbox') then lower({flat('candidate_status')}) when lower({flat('candidate_status')}) in ('named_contact', 'direct_contact', 'recovered_contact') then 'person' when lower({flat('candidate_status')}) in ('office_contact', 'mailbox') then 'office' else {bare(chr(34) + 'name' + chr(34), 'email')} end kind, case when coalesce(email_source, '') <> '' then email_source || ':generic' else 'discovered' end seed from ranked_contacts"),
        "institution_state": (institution_state, f"""with inc as {inc}, l as (select institution_id, arg_max(run_id, (f, run_id)) last_target from {st} group by 1), g as (select institution_id, arg_max(run_id, (f, run_id)) last_good_target, arg_max_null(fin, (f, run_id)) last_success from {st} where status = 'completed' group by 1),
          pd as (select institution_id, arg_max("domain", (last_seen, "domain")) primary_domain from {idom} where is_primary group by 1), c as (select identity, institution_id, max("name") nm, bool_or(coalesce(confidence = 'high', false)) hi, max(t) t from inc group by 1, 2), pe as (select institution_id, count(*) contacts, count(*) filter (nm <> '') named, count(*) filter (hi) high, max(t) last_contact from c group by 1),
          rt as (select institution_id, min(epoch_us(extracted_at)) next_retry from fetched_extractions e join acquired_pages p on p.page_id = e.page_id where short_circuited_shell group by 1), sd as (select institution_id, arg_max(url, (usefulness, times_used, url, kind)) seed_url from {seeds} group by 1)
          select institution_id, seed_url, primary_domain, last_target, last_good_target, last_success, coalesce(contacts, 0) contacts, coalesce(named, 0) named, coalesce(high, 0) high, last_contact, next_retry, case when coalesce(contacts, 0) > 0 then 'covered' when last_good_target is not null then 'explored_no_contacts' when last_target is not null then 'attempted' else 'unseen' end coverage
          from institutions left join sd using (institution_id) left join pd using (institution_id) left join l using (institution_id) left join g using (institution_id) left join pe using (institution_id) left join rt using (institution_id)"""),
        "redirect_cache": (redirect_cache, "with e as (select p_partkey s, p_partkey // 2 t from part where timestamp '2025-05-01' + to_days((p_partkey % 60)::int) > timestamp '2025-06-25' - interval 30 day), a as (select p_partkey u, coalesce(case when e.t <> p_partkey then e.t end, p_partkey) x from part left join e on e.s = p_partkey), b as (select u, x, coalesce(case when e.t not in (u, x) then e.t end, x) y from a left join e on e.s = x), c as (select u, coalesce(case when e.t not in (u, x, y) then e.t end, y) z from b left join e on e.s = y) select u::varchar url, z::varchar final_url from c"),
        "dead_family_anti": (dead_family_anti, f"with p as (select page_id, {pu} s, shell_like, epoch_us(fetched_at) t from acquired_pages) select page_id from p where s not in (select s from p where shell_like and t > epoch_us(timestamp '2025-03-31' - interval 30 day))"),
    }


QUERIES = _queries()
