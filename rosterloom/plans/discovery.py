"""Discovery of pages worth reading: URL features, families and scores of candidates, orders, plans, pruning.

Candidates are the acquired pages of an institution; the collector that would have proposed a page (strategy, source
type) is taken from its number, the anchor text from the last segment of its address, the parent page from its home.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import urls
from rosterloom.functions.text import contains_any, fold_accents
from rosterloom.operators.records import top_per_group
from rosterloom.plans.views import us
from rosterloom.session import table

# Page families by their terms, priorities of families, strategies and source types.
FAMILIES = {
    "contact": ("contact", "contacts", "contact-us"),
    "directory": ("directory", "people", "staff", "faculty", "person"),
    "staff": ("staff", "people", "team", "faculty"),
    "office": ("office", "offices", "service", "services"),
    "governance": ("governance", "leadership", "management", "administration", "board", "trustees", "rector", "president", "provost"),
    "international": ("international", "global", "partnership", "partnerships", "mobility", "exchange", "study-abroad", "studyabroad", "erasmus"),
    "admissions": ("admissions", "apply", "recruitment", "applicant"),
}
FAMILY_PRIORITY = {"contact": 8, "directory": 7, "staff": 6, "office": 6, "international": 6, "governance": 5, "admissions": 2, "generic": 1}
STRATEGY_PRIORITY = {"real_link_multihop": 70, "cms": 60, "sitemap": 56, "structured_endpoints": 54, "family_templates": 34, "subdomains": 14, "profile_slugs": 40, "heuristic_slugs": 24}
SOURCE_BONUS = {"nav": 8, "header": 7, "footer": 6, "body": 4, "form": 6, "search": 5, "sitemap": 5, "wp": 6, "drupal": 6, "subdomain": 1, "profile_slug": 4, "family_template": 3, "heuristic": 2, "heuristic_us": 2}
ANCHOR_TERMS = ("contacts", "directory", "people", "staff", "office", "international", "global", "partnerships", "mobility", "exchange", "governance", "leadership")
USEFUL = ("contact", "directory", "staff", "office", "international", "governance")
REAL_LINKS, GUESSED = ("real_link_multihop", "sitemap", "cms", "structured_endpoints"), ("heuristic_slugs", "profile_slugs", "family_templates")
#: Terms of pages that are no contact pages, of directories, and of services without people; terms of seeds.
JUNK, DIRECTORY_TERMS, SERVICE_TERMS = ("login", "signin", "sign-in", "account"), ("directory", "people", "staff"), ("helpdesk", "hotline")
SEEDS = ("international-office", "international", "global", "partnership", "exchange", "mobility", "study-abroad", "team", "staff", "people", "directory", "contact")
STOP_TOKENS = ("university", "universite", "universita", "universidad", "universitat", "college", "institute", "school", "the", "and")
#: Pages that one run may read, and pages that a first plan holds.
BUDGET, PLAN = 8, 5


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    out = F.lit(float(default))
    for name, value in values.items():
        out = F.when(key == name, float(value)).otherwise(out)
    return out


def family(url: Column, anchor: Column, text: Column) -> Column:
    """(score, rank, family) of the best family: 2.6 for a term in the address, 2.0 in the anchor, 0.8 at the beginning of the text.

    Junk terms in address or anchor give "generic" one point and all useful families 0.65 of theirs. Scores count in
    hundredths, so that sums are exact.
    """
    u, a, t = F.lower(url), F.lower(anchor), F.lower(F.substring(text, 1, 1200))
    junk = contains_any(u, list(JUNK)) | contains_any(a, list(JUNK))
    every = []
    for name, terms in FAMILIES.items():
        score = sum((F.contains(u, F.lit(x)).cast("int") * 260 + F.contains(a, F.lit(x)).cast("int") * 200 + F.contains(t, F.lit(x)).cast("int") * 80 for x in terms), F.lit(0))
        every.append(F.struct((F.when(junk, score * 65).otherwise(score * 100) if name in USEFUL else score * 100).alias("score"), F.lit(FAMILY_PRIORITY[name]).alias("rank"), F.lit(name).alias("family")))
    generic = F.struct(F.when(junk, 10000).otherwise(0).alias("score"), F.lit(1).alias("rank"), F.lit("generic").alias("family"))
    # a family without any hit is none
    return F.array_max(F.filter(F.array(*every, generic), lambda x: (x["score"] > 0) | (x["family"] == "generic")))


def candidate_score(url: Column, anchor: Column, fam: Column) -> Column:
    """Points of a candidate by its address, anchor and family."""
    u, a = F.lower(url), F.lower(anchor)
    points = lambda test, n: F.when(test, n).otherwise(0.0)
    terms = sum((points(F.contains(u, F.lit("/" + t)) | F.endswith(u, F.lit(t)) | F.contains(a, F.lit(t)), 2.2) for t in ANCHOR_TERMS), F.lit(0.0))
    hay = F.concat_ws(" ", u, a, fam)
    directory = fam.isin("directory", "staff") | contains_any(hay, list(DIRECTORY_TERMS))
    service = contains_any(hay, list(SERVICE_TERMS))
    slashes = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit("")))
    score = terms + _lookup(FAMILY_PRIORITY, fam, 1) * 0.55 + points(urls.language_prefix(url) != "", 0.8) - F.greatest(F.lit(0), slashes - 6) * 0.45
    score = score + points(contains_any(u, ["/international", "/mobility", "/erasmus", "/global", "/directory", "/people", "/contact"]), 1.6) + points(contains_any(u, ["/about", "/leadership", "/governance"]), 1.2) + points(directory, 2.2)
    score = score - points(service & ~directory, 1.8) - points(urls.is_asset(url), 5.0) - points(contains_any(u, ["/events", "/news", "/calendar", "/blog"]), 1.5)
    return F.round(score - points(F.contains(u, F.lit("/student")) & ~F.contains(u, F.lit("/international")) & ~fam.isin("international", "contact"), 0.6), 3)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("page_id") % n + 1).cast("int"))
    home = table(spark, d, "institutions").select("institution_id", F.concat(F.lit("https://"), "home_domain", F.lit("/")).alias("home"))
    p = table(spark, d, "acquired_pages").select(
        "page_id", "institution_id", "url", us("fetched_at").alias("at"), F.lower("visible_text").alias("text"), pick(STRATEGY_PRIORITY, 8).alias("strategy"), pick(SOURCE_BONUS, 14).alias("source_type"),
        F.when(F.col("page_id") % 3 == 0, "").otherwise(F.regexp_replace(F.element_at(urls.segments(F.concat("url", F.lit("/-"))), -2), "-[0-9]+$", "")).alias("anchor"),
        F.when(F.col("page_id") % 8 == 5, "generated_subdomain").when(F.col("page_id") % 4 == 0, "first_hop_links").otherwise("homepage").alias("stage"))
    p = p.join(home, "institution_id").withColumn("parent", F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("home")))
    p = p.withColumn("anchor", F.coalesce("anchor", F.lit(""))).withColumn("f", family(F.col("url"), F.col("anchor"), F.col("text")))
    p = p.withColumn("family", F.col("f.family")).withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("f.score") / 50000.0), 3))
    p = p.withColumn("score", candidate_score(F.col("url"), F.col("anchor"), F.col("family")))
    base = _lookup(STRATEGY_PRIORITY, F.col("strategy"), 20) + _lookup(SOURCE_BONUS, F.col("source_type"), 0) + F.when(F.startswith("stage", F.lit("first_hop")), 4.0).otherwise(0.0) + F.when(F.col("family").isin(list(USEFUL)), 4.0).otherwise(0.0)
    return p.withColumn("priority", base).drop("text", "f")


def adjustment(strategies: Column) -> Column:
    """What evidence adds to a candidate's priority: several strategies, an anchor, a parent; what guesses take off."""
    points = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    c = F.col
    hay = F.lower(F.concat_ws(" ", "url", "anchor", "family"))
    directory = c("family").isin("directory", "staff") | contains_any(hay, list(DIRECTORY_TERMS))
    guessed = (c("strategy") == "subdomains") & (c("stage") == "generated_subdomain")
    out = points(strategies > 1, 9) + points(c("anchor") != "", 3) + points(c("parent") != "", 3) + points(c("strategy") == "real_link_multihop", 4) + points(c("strategy").isin("sitemap", "cms"), 2.5)
    out = out + points(c("source_type").isin("nav", "header", "footer", "body"), 1.5) + points(directory, 5) + points(c("family") == "directory", 2) - points(contains_any(hay, list(SERVICE_TERMS)) & ~directory, 4)
    out = out - points(guessed, 18) - points(guessed & (c("anchor") == "") & (c("parent") == "") & (strategies <= 1), 8)
    return out + points((c("strategy") == "family_templates") & (c("parent") != ""), 2) + points((c("strategy") == "family_templates") & c("family").isin(list(USEFUL)), 1.5)


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Each address once: its best candidate, strategies united, the greatest priority; ``total`` orders them."""
    c = candidates(spark, d).withColumn("address", urls.normalized(F.col("url")))
    own = c.withColumn("own", F.col("priority") + adjustment(F.lit(1)))
    best = F.max_by(F.struct("page_id", "institution_id", "url", "strategy", "source_type", "stage", "anchor", "parent", "family", "confidence", "score", "home"), F.struct("own", _lookup(FAMILY_PRIORITY, F.col("family"), 1).alias("f"), "score", -F.col("page_id")))
    g = own.groupBy("address").agg(best.alias("b"), F.array_sort(F.collect_set("strategy")).alias("strategies"), F.max("priority").alias("priority"))
    flat = g.select("address", "strategies", "priority", "b.*")
    return flat.withColumn("total", F.col("priority") + adjustment(F.size("strategies")))


def _order() -> list[Column]:
    return [F.col("total").desc(), _lookup(FAMILY_PRIORITY, F.col("family"), 1).desc(), F.col("score").desc(), F.col("url"), F.col("page_id")]


def url_features(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    p = table(spark, d, "acquired_pages").select("page_id", "url")
    return p.select(
        "page_id", urls.depth(u).cast("int").alias("depth"), F.array_join(urls.tokens(u), " ").alias("words"), urls.subdomain(u).alias("subdomain"), urls.extension(u).alias("extension"), urls.netloc(u).alias("home"),
        urls.registrable(urls.host(u)).alias("registrable"), F.array_join(urls.path_tokens(u), "/").alias("path_tokens"), urls.language_prefix(u).alias("language"))


def family_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Signature of the family of a page, its branch, and what it shares with pages of one origin."""
    c = candidates(spark, d)
    u, home = F.col("url"), F.col("home")
    return c.select("page_id", urls.family_signature(u).alias("signature"), urls.branch(u, F.col("parent"), home).alias("branch"), urls.shell_context(F.col("strategy"), F.col("stage"), F.col("parent"), home).alias("context"))


def domain_matches(spark: SparkSession, d: str) -> DataFrame:
    """Whether the e-mail domain of a row is that of its home."""
    from rosterloom.functions import emails

    c = table(spark, d, "contacts").select("contact_id", emails.domain(emails.normalized(F.col("email"))).alias("dom"), F.lower("home_domain").alias("home")).filter("dom <> ''")
    return c.select("contact_id", urls.domain_match(F.col("dom"), F.col("home")).alias("match"), urls.domain_match(F.concat(F.lit("x."), "dom"), F.col("home")).alias("below"))


def home_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many telling words of an institution's name its home address has: half a point more for a long one, and for a short path."""
    i = table(spark, d, "institutions").select("institution_id", "canonical_name", "home_domain")
    words = F.filter(F.array_distinct(F.split(F.btrim(F.regexp_replace(fold_accents(F.col("canonical_name")), "[^a-z0-9]+", " ")), " ")), lambda w: (F.length(w) >= 4) & ~w.isin(list(STOP_TOKENS)))
    seen = F.split(F.btrim(F.regexp_replace(F.lower("home_domain"), "[^a-z0-9]+", " ")), " ")
    hits = F.array_intersect(words, seen)
    longest = F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0))
    return i.select("institution_id", F.when(F.size(hits) == 0, 0.0).otherwise(F.size(hits) + F.when(longest >= 7, 0.5).otherwise(0.0) + 0.5).alias("overlap"))


def page_families(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).select("page_id", "family", "confidence", "score", "priority")


def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every institution in the order of candidates, each once."""
    return top_per_group(ranked(spark, d), ["institution_id"], _order(), 2**31 - 1, "position").select("institution_id", "position", "page_id", "total", F.array_join("strategies", ",").alias("strategies"))


def planner_order(spark: SparkSession, d: str) -> DataFrame:
    """The planner's order: priority, score, confidence, address; the first five of each institution."""
    order = [F.col("priority").desc(), F.col("score").desc(), F.col("confidence").desc(), F.col("url"), F.col("page_id")]
    return top_per_group(candidates(spark, d), ["institution_id"], order, 5, "position").select("institution_id", "position", "page_id")


def mode_quota(spark: SparkSession, d: str, limit: int = 60) -> DataFrame:
    """Candidates of an institution under quotas: in the hybrid mode real links and guesses, 60 to 40; at most ``limit``.

    Without real links the first ``limit`` of all are taken.
    """
    heuristic = max(8, int(limit * 0.4))
    r = ranked(spark, d).withColumn("kind", F.when(F.col("strategy").isin(list(REAL_LINKS)), "real").when(F.col("strategy").isin(list(GUESSED)), "guess").otherwise("other"))
    real = r.groupBy("institution_id").agg(F.count_if(F.col("kind") == "real").alias("reals"))
    r = top_per_group(r.join(real, "institution_id"), ["institution_id", "kind"], _order(), limit, "k")
    fits = (F.col("reals") == 0) | ((F.col("kind") == "real") & (F.col("k") <= limit - heuristic)) | ((F.col("kind") == "guess") & (F.col("k") <= heuristic))
    return top_per_group(r.filter(fits), ["institution_id"], _order(), limit, "position").select("institution_id", "position", "page_id", "kind")


def corroborated_quota(spark: SparkSession, d: str, limit: int = 60) -> DataFrame:
    """The other modes: a few that several strategies found, real links, guesses, generated subdomains, each under its cap, each once."""
    caps = (("corroborated", max(2, min(8, limit // 5))), ("real", limit - 10), ("guess", min(8, limit // 4)), ("subdomain", min(3, max(1, limit // 20))))
    r = ranked(spark, d)
    classes = F.array_compact(F.array(
        F.when(F.size("strategies") > 1, "corroborated"), F.when(F.col("strategy").isin(list(REAL_LINKS)), "real"), F.when(F.col("strategy").isin(list(GUESSED)), "guess"),
        F.when((F.col("strategy") == "subdomains") & (F.col("stage") == "generated_subdomain"), "subdomain")))
    r = top_per_group(r.withColumn("class", F.explode(classes)), ["institution_id", "class"], _order(), limit, "k")
    fits = F.lit(False)
    for name, cap in caps:
        fits = fits | ((F.col("class") == name) & (F.col("k") <= cap))
    once = r.filter(fits).dropDuplicates(["page_id"])
    return top_per_group(once, ["institution_id"], _order(), limit, "position").select("institution_id", "position", "page_id")


def scout_plan(spark: SparkSession, d: str) -> DataFrame:
    """A first plan: two pages with a seed term, then the best up to four, then the planner's order up to the budget."""
    seed = contains_any(F.lower("url"), list(SEEDS))
    c = candidates(spark, d).withColumn("seed", seed)
    order = [F.col("priority").desc(), F.col("score").desc(), F.col("confidence").desc(), F.col("url"), F.col("page_id")]
    s = top_per_group(c, ["institution_id", "seed"], order, 12, "k")
    band = F.when(F.col("seed") & (F.col("k") <= 2), 1).otherwise(2)
    return top_per_group(s.withColumn("band", band), ["institution_id"], [F.col("band"), *order], PLAN, "position").select("institution_id", "position", "page_id", F.when(F.col("band") == 1, "seed").when(F.col("position") <= 4, "heuristic").otherwise("ranked").alias("reason"))


def gap_plan(spark: SparkSession, d: str) -> DataFrame:
    """The next pages after a first plan: not visited yet, at most three."""
    visited = scout_plan(spark, d).select("page_id")
    order = [F.col("priority").desc(), F.col("score").desc(), F.col("url"), F.col("page_id")]
    return top_per_group(candidates(spark, d).join(visited, "page_id", "left_anti"), ["institution_id"], order, 3, "position").select("institution_id", "position", "page_id")


def budgeted_pages(spark: SparkSession, d: str) -> DataFrame:
    """What a run within its page budget reads: plan and gap plan one after the other, numbered, cut at the budget."""
    a = scout_plan(spark, d).select("institution_id", "page_id", F.lit(1).alias("round"), "position")
    b = gap_plan(spark, d).select("institution_id", "page_id", F.lit(2).alias("round"), "position")
    return top_per_group(a.unionByName(b), ["institution_id"], [F.col("round"), F.col("position")], BUDGET, "step").select("institution_id", "step", "page_id")


def productive_order(spark: SparkSession, d: str) -> DataFrame:
    """Order of pages after a round of reading: parents and branches that gave contacts raise the pages below them."""
    found = table(spark, d, "contacts").filter("page_id is not null").select("page_id").distinct()
    c = candidates(spark, d).withColumn("branch", urls.branch(F.col("url"), F.col("parent"), F.col("home")))
    good = c.filter("strategy = 'real_link_multihop'").join(found, "page_id", "left_semi").select("institution_id", "branch").filter("branch <> ''").distinct()
    any_good = good.select("institution_id").distinct().withColumn("any", F.lit(True))
    j = c.join(good.withColumn("hit", F.lit(True)), ["institution_id", "branch"], "left").join(any_good, "institution_id", "left")
    real = F.col("strategy") == "real_link_multihop"
    raised = F.col("priority") + F.when(real & F.col("hit").isNotNull(), 4.0).when(real & F.col("any").isNotNull(), 1.0).otherwise(0.0)
    raised = raised + F.when(F.col("any").isNull(), 0.0).when(F.col("strategy").isin("profile_slugs", "heuristic_slugs"), -3.5).when(real, 1.5).otherwise(0.0)
    return top_per_group(j.withColumn("total", raised), ["institution_id"], [F.col("total").desc(), F.col("score").desc(), F.col("url"), F.col("page_id")], 10, "position").select("institution_id", "position", "page_id", "total")


def enrichment_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows without an address in the order of effort: role holders and ready names first, fewer attempts, names by alphabet."""
    from rosterloom.functions import names

    c = table(spark, d, "contacts").filter("coalesce(trim(email), '') = ''")
    ready = names.person_name(F.col("name"))
    worth = F.coalesce("score", F.lit(0)) + F.when(ready, 1.4).otherwise(2.5)
    order = [worth.desc(), F.col("contact_id") % 3, F.coalesce(F.nullif("name", F.lit("")), "role", F.lit("")), F.col("contact_id")]
    return top_per_group(c, ["institution_id"], order, 20, "position").select("institution_id", "position", "contact_id")


def pruned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the reason why they would be left out: dead address, dead origin, dead family, or none; visited ones are gone.

    Dead are addresses that answered 404, 410 or 451, origins all of whose pages are shells, families with two dead addresses.
    """
    c = candidates(spark, d).withColumn("context", urls.shell_context(F.col("strategy"), F.col("stage"), F.col("parent"), F.col("home"))).withColumn("signature", urls.family_signature(F.col("url")))
    p = table(spark, d, "acquired_pages").select("page_id", "shell_like", F.coalesce(F.col("http_status").isin(404, 410, 451), F.lit(False)).alias("gone"))
    c = c.join(p, "page_id")
    first = c.groupBy("url").agg(F.min_by("page_id", F.struct("at", "page_id")).alias("page_id"), F.max("gone").alias("dead_url"))
    origin = c.groupBy("context").agg(F.min("shell_like").alias("dead_origin"))
    fam = c.filter("gone").groupBy("signature").agg(F.min("url").alias("a"), F.max("url").alias("z")).filter("a <> z").select("signature", F.lit(True).alias("dead_family"))
    j = c.select("page_id", "context", "signature").join(first, "page_id").join(origin, "context").join(fam, "signature", "left")
    return j.select("page_id", F.when(F.col("dead_url"), "dead_url").when(F.col("dead_origin"), "dead_shell_context").when(F.col("dead_family"), "dead_candidate_family").otherwise("").alias("reason"))


def search_interfaces(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that are forms or search pages; every ninth stage is such a form."""
    c = candidates(spark, d).withColumn("stage", F.when(F.col("page_id") % 9 == 0, F.concat("stage", F.lit("_search_link"))).otherwise(F.col("stage")))
    return c.select("page_id", F.lower("stage").rlike("(?:_form|_search_link)$").alias("interface"))


def slug_templates(spark: SparkSession, d: str) -> DataFrame:
    """Addresses made of a home page and listed slugs, with and without a language, and of listed subdomains."""
    i = table(spark, d, "institutions").select("institution_id", F.lower("home_domain").alias("dom"), "country_code")
    slugs = ("international", "contact", "about/leadership")
    made = [F.struct(F.concat(F.lit("https://"), "dom", F.lit("/" + s)).alias("url"), F.lit("slug").alias("kind")) for s in slugs]
    lang = F.lower("country_code")
    made += [F.when(lang.isin(list(urls.LANGUAGES)), F.struct(F.concat(F.lit("https://"), F.col("dom"), F.lit("/"), lang, F.lit("/" + s)).alias("url"), F.lit("language_slug").alias("kind"))) for s in slugs]
    root = urls.site_root(F.regexp_replace("dom", r"^www\.", ""))
    made += [F.struct(F.concat(F.lit(f"https://{s}."), root, F.lit("/")).alias("url"), F.lit("subdomain").alias("kind")) for s in ("admissions", "global", "international")]
    return i.select("institution_id", F.explode(F.array_compact(F.array(*made))).alias("m")).select("institution_id", "m.url", "m.kind")


def evidence_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages to search for a person by the action taken: preferred families and terms first, the first twelve."""
    c = candidates(spark, d)
    prefer = F.col("family").isin("governance", "directory", "international", "office").cast("int") + contains_any(F.lower("url"), ["people", "staff"]).cast("int")
    actions = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(f).alias("fam"), F.lit(n).alias("n")) for a, f, n in (("search_people_pages", "staff", 3), ("search_governance_pages", "governance", 4))]))
    j = c.withColumn("a", actions).withColumn("prefer", prefer + F.when(F.col("family") == F.col("a.fam"), F.col("a.n")).otherwise(0))
    return top_per_group(j.withColumn("action", F.col("a.action")), ["institution_id", "action"], [F.col("prefer").desc(), F.col("score").desc(), F.col("url"), F.col("page_id")], 12, "position").select("institution_id", "action", "position", "page_id")


# ---- SQL ----


def _has(hay: str, terms) -> str:
    return "(" + " or ".join(f"contains({hay}, '{t}')" for t in terms) + ")"


def _case(col: str, values: dict, default: float) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {float(v)}" for k, v in values.items()) + f" else {float(default)} end"


def _arr(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _queries() -> dict:
    from rosterloom.plans.people import person_sql
    from rosterloom.plans.scalars import _E, _HOST, _NET, _PATH, _REG, _ROOT, _SCHEME

    fam = []
    junk = f"({_has('u', JUNK)} or {_has('a', JUNK)})"
    for name, terms in FAMILIES.items():
        score = "(" + " + ".join(f"260 * contains(u, '{t}')::int + 200 * contains(a, '{t}')::int + 80 * contains(t, '{t}')::int" for t in terms) + ")"
        weight = f"case when {junk} then 65 else 100 end" if name in USEFUL else "100"
        fam.append(f"{{'score': {score} * {weight}, 'rank': {FAMILY_PRIORITY[name]}, 'family': '{name}'}}")
    fam.append(f"{{'score': case when {junk} then 10000 else 0 end, 'rank': 1, 'family': 'generic'}}")
    best = f"list_sort(list_filter([{', '.join(fam)}], lambda x: x.score > 0 or x.family = 'generic'), 'desc')[1]"
    lang = "case when list_contains(['en', 'it', 'fr', 'de', 'es', 'pt', 'nl'], trim(regexp_replace(lower(trim(list_filter(string_split(" + _PATH.format(u="url") + ", '/'), lambda x: x <> '')[1])), '[^a-z0-9-]+', '-', 'g'), '-')) then trim(regexp_replace(lower(trim(list_filter(string_split(" + _PATH.format(u="url") + ", '/'), lambda x: x <> '')[1])), '[^a-z0-9-]+', '-', 'g'), '-') else '' end"
    hay = "(u || ' ' || a || ' ' || family)"
    dirl = f"(family in ('directory', 'staff') or {_has(hay, DIRECTORY_TERMS)})"
    pts = lambda test, n: f"case when {test} then {n} else 0.0 end"
    terms = " + ".join(pts(f"contains(u, '/{t}') or ends_with(u, '{t}') or contains(a, '{t}')", 2.2) for t in ANCHOR_TERMS)
    asset = "regexp_matches(url, '(?i)\\.(?:pdf|jpe?g|png|gif|svg|webp|ico|css|js|zip|gz|docx?|xlsx?|pptx?|mp[34]|avi|mov|woff2?)(?:$|[?#])')"
    score = f"round(({terms} + ({_case('family', FAMILY_PRIORITY, 1)}) * 0.55 + {pts(f'({lang}) <> chr(0) and ({lang}) <> ' + chr(39) * 2, 0.8)} - greatest(0, length(u) - length(replace(u, '/', '')) - 6) * 0.45 + {pts(_has('u', ['/international', '/mobility', '/erasmus', '/global', '/directory', '/people', '/contact']), 1.6)} + {pts(_has('u', ['/about', '/leadership', '/governance']), 1.2)} + {pts(dirl, 2.2)} - {pts(_has(hay, SERVICE_TERMS) + ' and not ' + dirl, 1.8)} - {pts(asset, 5.0)} - {pts(_has('u', ['/events', '/news', '/calendar', '/blog']), 1.5)} - {pts(chr(40) + 'contains(u, ' + chr(39) + '/student' + chr(39) + ') and not contains(u, ' + chr(39) + '/international' + chr(39) + ') and family not in (' + chr(39) + 'international' + chr(39) + ', ' + chr(39) + 'contact' + chr(39) + '))', 0.6)})::double, 3)"
    segs = lambda u: f"list_filter(string_split({_PATH.format(u=u)}, '/'), lambda x: x <> '')"
    cand = f"""(select *, ({_case('strategy', STRATEGY_PRIORITY, 20)} + {_case('source_type', SOURCE_BONUS, 0)} + case when starts_with(stage, 'first_hop') then 4.0 else 0.0 end + case when family in ('contact', 'directory', 'staff', 'office', 'international', 'governance') then 4.0 else 0.0 end)::double priority
      from (select *, {score} score from (select *, s.family family, round(least(1.0::double, s.score::double / 50000.0::double), 3) confidence from (select *, {best} s from (
        select page_id, p.institution_id, url, epoch_us(fetched_at) "at", {_arr(STRATEGY_PRIORITY)}[page_id % 8 + 1] strategy, {_arr(SOURCE_BONUS)}[page_id % 14 + 1] source_type, lower(substring(lower(visible_text), 1, 1200)) t,
          case when page_id % 8 = 5 then 'generated_subdomain' when page_id % 4 = 0 then 'first_hop_links' else 'homepage' end stage, 'https://' || home_domain || '/' home, case when page_id % 5 = 0 then '' else 'https://' || home_domain || '/' end parent,
          case when page_id % 3 = 0 then '' else coalesce(regexp_replace({segs('url')}[-1], '-[0-9]+$', ''), '') end anchor, lower(url) u, lower(case when page_id % 3 = 0 then '' else coalesce(regexp_replace({segs('url')}[-1], '-[0-9]+$', ''), '') end) a
        from acquired_pages p join institutions i on i.institution_id = p.institution_id)))))"""
    low = "lower(url || ' ' || anchor || ' ' || family)"
    ddir = f"(family in ('directory', 'staff') or {_has(low, DIRECTORY_TERMS)})"
    gen = "(strategy = 'subdomains' and stage = 'generated_subdomain')"
    adj = lambda n: " + ".join([pts(f"{n} > 1", 9.0), pts("anchor <> ''", 3.0), pts("parent <> ''", 3.0), pts("strategy = 'real_link_multihop'", 4.0), pts("strategy in ('sitemap', 'cms')", 2.5), pts("source_type in ('nav', 'header', 'footer', 'body')", 1.5), pts(ddir, 5.0), pts("family = 'directory'", 2.0), pts(f"{_has(low, SERVICE_TERMS)} and not {ddir}", -4.0), pts(gen, -18.0), pts(f"{gen} and anchor = '' and parent = '' and {n} <= 1", -8.0), pts("strategy = 'family_templates' and parent <> ''", 2.0), pts("strategy = 'family_templates' and family in ('contact', 'directory', 'staff', 'office', 'international', 'governance')", 1.5)])
    u = {"u": "url"}
    address = f"({_SCHEME.format(**u)} || '://' || {_NET.format(**u)} || case when {_PATH.format(**u)} = '' then '/' else {_PATH.format(**u)} end || case when regexp_extract(url, '\\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(url, '\\?([^#]*)', 1) end)"
    fp = _case("family", FAMILY_PRIORITY, 1)
    rank = f"""(select *, priority2 + {adj('len(strategies)')} total from (select *, list_sort(list_distinct(list(strategy) over w)) strategies, max(priority) over w priority2,
        row_number() over (partition by {address} order by priority + {adj('1')} desc, {fp} desc, score desc, page_id) keep from {cand} window w as (partition by {address})) where keep = 1)"""
    order = f"total desc, {fp} desc, score desc, url, page_id"
    plan = "priority desc, score desc, confidence desc, url, page_id"
    scout = f"(select institution_id, row_number() over (partition by institution_id order by band, {plan})::int position, page_id, band from (select *, case when sd and k <= 2 then 1 else 2 end band from (select *, row_number() over (partition by institution_id, sd order by {plan}) k from (select *, {_has('lower(url)', SEEDS)} sd from {cand})) where k <= 12) qualify position <= {PLAN})"
    gap = f"(select institution_id, row_number() over (partition by institution_id order by priority desc, score desc, url, page_id)::int position, page_id from {cand} where page_id not in (select page_id from {scout}) qualify position <= 3)"
    plain = lambda col: f"list_filter(list_transform({segs(col)}, lambda x: array_to_string(regexp_extract_all(regexp_replace(lower(trim(x)), '\\.(?:html?|php|aspx?)$', ''), '[a-z0-9]+'), '-')), lambda x: x <> '')"
    langs = _arr(urls.LANGUAGES)
    kept = f"list_filter({plain('url')}, lambda x: not list_contains({langs}, x) and x not in ('index', 'home'))"
    sig = f"{_NET.format(**u)} || ':' || case when len({kept}) = 0 then 'root' when list_contains(['about', 'leadership', 'office', 'services', 'service', 'contacts', 'contact'], {kept}[-1]) and len({kept}) >= 2 then {kept}[-2] || '::' || {kept}[-1] else {kept}[-1] end"
    bk = lambda col: f"(select case when len(z) = 0 then null when z[1] in ('offices', 'services') and len(z) >= 2 then z[1] || '/' || z[2] else z[1] end from (select list_filter({plain(col)}, lambda x: not list_contains({langs}, x) and x not in ('page', 'node', 'details', 'index', 'home', 'default', 'view', 'content')) z))"
    branch = f"coalesce({bk('url')}, {bk('parent')}, {bk('home')}, '')"
    context = "strategy || '|' || stage || '|' || case when parent = '' then home else parent end"
    match = lambda e: f"({e} = h or ends_with({e}, '.' || h) or ends_with(h, '.' || {e}) or (string_split({e}, '.')[-1] = string_split(h, '.')[-1] and case when ends_with(h, '.ac.uk') then len(string_split({e}, '.')) > 2 and array_to_string(string_split({e}, '.')[:-3], '.') = array_to_string(string_split(h, '.')[:-3], '.') else len(string_split({e}, '.')) > 1 and array_to_string(string_split({e}, '.')[:-2], '.') = array_to_string(string_split(h, '.')[:-2], '.') end))"
    fold = "strip_accents(replace(replace(replace(lower(canonical_name), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'))"
    hits = f"list_intersect(list_filter(list_distinct(string_split(trim(regexp_replace({fold}, '[^a-z0-9]+', ' ', 'g'), ' '), ' ')), lambda w: length(w) >= 4 and not list_contains({_arr(STOP_TOKENS)}, w)), string_split(trim(regexp_replace(lower(home_domain), '[^a-z0-9]+', ' ', 'g'), ' '), ' '))"
    ready = person_sql("coalesce(\"name\", '')")
    dm = "lower(home_domain)"
    rootd = _ROOT.format(h=f"regexp_replace({dm}, '^www\\.', '')")
    return {
        "url_features": (url_features, f"select page_id, len({segs('url')})::int \"depth\", array_to_string(list_filter(string_split_regex(lower({_PATH.format(**u)}), '[^a-z0-9]+'), lambda x: x <> ''), ' ') words, regexp_replace({_HOST.format(**u)}[:greatest(length({_HOST.format(**u)}) - length({_ROOT.format(h=_HOST.format(**u))}), 0)], '\\.$', '') subdomain, lower(regexp_extract({_PATH.format(**u)}, '\\.([A-Za-z0-9]{{1,5}})$', 1)) extension, {_NET.format(**u)} home, {_REG.format(h=_HOST.format(**u))} registrable, array_to_string(list_filter(list_transform({segs('url')}, lambda x: trim(regexp_replace(lower(trim(x)), '[^a-z0-9-]+', '-', 'g'), '-')), lambda x: x <> ''), '/') path_tokens, coalesce({lang}, '') \"language\" from acquired_pages"),
        "family_signatures": (family_signatures, f"select page_id, {sig} signature, {branch} branch, {context} context from {cand}"),
        "domain_matches": (domain_matches, f"select contact_id, {match('e')} \"match\", {match('x')} below from (select contact_id, e, 'x.' || e x, h from (select contact_id, split_part({_E}, '@', -1) e, lower(home_domain) h, {_E} em from contacts) where em <> '')"),
        "home_overlap": (home_overlap, f"select institution_id, case when len(h) = 0 then 0.0 else len(h) + case when list_max(list_transform(h, lambda w: length(w))) >= 7 then 0.5 else 0.0 end + 0.5 end::double overlap from (select institution_id, {hits} h from institutions)"),
        "page_families": (page_families, f"select page_id, family, confidence, score, priority from {cand}"),
        "candidate_ranking": (candidate_ranking, f"select institution_id, row_number() over (partition by institution_id order by {order})::int position, page_id, total::double total, array_to_string(strategies, ',') strategies from {rank}"),
        "planner_order": (planner_order, f"select institution_id, row_number() over (partition by institution_id order by {plan})::int position, page_id from {cand} qualify position <= 5"),
        "mode_quota": (mode_quota, f"with r as (select *, case when strategy in ('real_link_multihop', 'sitemap', 'cms', 'structured_endpoints') then 'real' when strategy in ('heuristic_slugs', 'profile_slugs', 'family_templates') then 'guess' else 'other' end kind from {rank}), k as (select *, row_number() over (partition by institution_id, kind order by {order}) k, count(*) filter (kind = 'real') over (partition by institution_id) reals from r) select institution_id, row_number() over (partition by institution_id order by {order})::int position, page_id, kind from k where reals = 0 or (kind = 'real' and k <= 36) or (kind = 'guess' and k <= 24) qualify position <= 60"),
        "corroborated_quota": (corroborated_quota, f"with r as (select *, unnest(list_filter([case when len(strategies) > 1 then 'corroborated' end, case when strategy in ('real_link_multihop', 'sitemap', 'cms', 'structured_endpoints') then 'real' end, case when strategy in ('heuristic_slugs', 'profile_slugs', 'family_templates') then 'guess' end, case when strategy = 'subdomains' and stage = 'generated_subdomain' then 'subdomain' end], lambda x: x is not null)) cls from {rank}), k as (select *, row_number() over (partition by institution_id, cls order by {order}) k from r), o as (select * from k where (cls = 'corroborated' and k <= 8) or (cls = 'real' and k <= 50) or (cls = 'guess' and k <= 8) or (cls = 'subdomain' and k <= 3) qualify row_number() over (partition by page_id order by cls) = 1) select institution_id, row_number() over (partition by institution_id order by {order})::int position, page_id from o qualify position <= 60"),
        "scout_plan": (scout_plan, f"select institution_id, position, page_id, case when band = 1 then 'seed' when position <= 4 then 'heuristic' else 'ranked' end reason from {scout}"),
        "gap_plan": (gap_plan, f"select * from {gap}"),
        "budgeted_pages": (budgeted_pages, f"select institution_id, row_number() over (partition by institution_id order by r, position)::int step, page_id from (select institution_id, page_id, 1 r, position from {scout} union all select institution_id, page_id, 2, position from {gap}) qualify step <= {BUDGET}"),
        "productive_order": (productive_order, f"with c as (select *, {branch} br from {cand}), g as (select distinct institution_id, br from c where strategy = 'real_link_multihop' and br <> '' and page_id in (select page_id from contacts)), j as (select c.*, g.br is not null hit, exists (select 1 from g x where x.institution_id = c.institution_id) anyg from c left join g on g.institution_id = c.institution_id and g.br = c.br), t as (select *, priority + case when strategy = 'real_link_multihop' and hit then 4.0 when strategy = 'real_link_multihop' and anyg then 1.0 else 0.0 end + case when not anyg then 0.0 when strategy in ('profile_slugs', 'heuristic_slugs') then -3.5 when strategy = 'real_link_multihop' then 1.5 else 0.0 end total from j) select institution_id, row_number() over (partition by institution_id order by total desc, score desc, url, page_id)::int position, page_id, total::double total from t qualify position <= 10"),
        "enrichment_order": (enrichment_order, f"select institution_id, row_number() over (partition by institution_id order by coalesce(score, 0) + case when {ready} then 1.4 else 2.5 end desc, contact_id % 3, coalesce(nullif(\"name\", ''), role, ''), contact_id)::int position, contact_id from contacts where coalesce(trim(email, ' '), '') = '' qualify position <= 20"),
        "pruned_pages": (pruned_pages, f"with c as (select *, {context} ctx, {sig} sg from {cand}), p as (select page_id, shell_like, coalesce(http_status in (404, 410, 451), false) gone from acquired_pages), j as (select c.*, shell_like, gone from c join p using (page_id)), f as (select url, arg_min(page_id, (\"at\", page_id)) page_id, bool_or(gone) du from j group by 1), o as (select ctx, bool_and(shell_like) dox from j group by 1), m as (select sg from j where gone group by 1 having count(distinct url) > 1) select j.page_id, case when du then 'dead_url' when dox then 'dead_shell_context' when m.sg is not null then 'dead_candidate_family' else '' end reason from j join f on f.page_id = j.page_id join o using (ctx) left join m using (sg)"),
        "search_interfaces": (search_interfaces, "select page_id, page_id % 9 = 0 interface from acquired_pages join institutions using (institution_id)"),
        "slug_templates": (slug_templates, f"with i as (select institution_id, {dm} d, lower(country_code) l, {rootd} r from institutions) select institution_id, 'https://' || d || '/' || s url, 'slug' kind from i, (values ('international'), ('contact'), ('about/leadership')) v(s) union all select institution_id, 'https://' || d || '/' || l || '/' || s, 'language_slug' from i, (values ('international'), ('contact'), ('about/leadership')) v(s) where list_contains({langs}, l) union all select institution_id, 'https://' || s || '.' || r || '/', 'subdomain' from i, (values ('admissions'), ('global'), ('international')) v(s)"),
        "evidence_pages": (evidence_pages, f"select institution_id, \"action\", row_number() over (partition by institution_id, \"action\" order by (family in ('governance', 'directory', 'international', 'office'))::int + {_has('lower(url)', ['people', 'staff'])}::int + case when family = fam then n else 0 end desc, score desc, url, page_id)::int position, page_id from {cand}, (values ('search_people_pages', 'staff', 3), ('search_governance_pages', 'governance', 4)) v(\"action\", fam, n) qualify position <= 12"),
    }


QUERIES = _queries()
