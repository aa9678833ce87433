"""Contacts out of pages: evidence of six extractors, assembly, clean-up, typing; links, forms, feeds and site maps.

The stages are tables, one row per piece of evidence or candidate: evidence -> assembled -> cleaned -> typed. HTML pages
of the queries below are set from the tables (a contact or an institution each), in markup of several kinds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterloom.functions import emails, names, urls
from rosterloom.functions.packs import DEFAULT, Pack
from rosterloom.functions.text import collapse_blanks, contains_any
from rosterloom.operators.records import top_per_group
from rosterloom.session import cut_lineage, table
from rosterloom.sources import html

# Strategies in the order in which their evidence counts, with their points.
STRATEGIES = {"mailto_explicit": 6, "visible_regex": 3, "html_attribute": 5, "embedded_json": 4, "js_decode": 1, "explicit_obfuscation": 2, "llm_structured": 1}


def _points(strategy: Column) -> Column:
    out = F.lit(0)
    for name, n in STRATEGIES.items():
        out = F.when(strategy == name, n).otherwise(out)
    return out


def _around(lines: Column, at: Column, radius: int) -> Column:
    start = F.greatest(at - radius, F.lit(0))
    return F.slice(lines, start + 1, at + radius - start + 1)


def from_text(parsed: DataFrame, keywords: tuple[str, ...] = (), pack: Pack = DEFAULT) -> DataFrame:
    """Evidence of addresses in the text, plain and spelled out, with names two lines and roles five lines around."""
    lines = parsed.select("page_id", names.lines_of(F.col("text")).alias("lines")).select("page_id", "lines", F.posexplode("lines").alias("at", "line"))
    # spelled-out addresses are looked for in the line where they stand
    kinds = F.array(F.struct(F.lit("visible_regex").alias("strategy"), F.transform(emails.all_emails(F.col("line")), F.lower).alias("found")), F.struct(F.lit("explicit_obfuscation").alias("strategy"), emails.obfuscated_emails(F.col("line")).alias("found")))
    hits = lines.filter(F.contains("line", F.lit("@")) | F.lower("line").rlike(r"\bat\b")).withColumn("k", F.explode(kinds)).withColumn("email", F.explode("k.found"))
    near, wide = _around(F.col("lines"), F.col("at"), 2), _around(F.col("lines"), F.col("at"), 5)
    hits = hits.select("page_id", "at", F.col("k.strategy").alias("strategy"), "email", near.alias("near"), names.useful_lines(wide, keywords, pack).alias("wide"))
    return hits.select("page_id", F.col("at").alias("pos"), "strategy", "email", names.best_name(F.col("near"), F.col("email"), pack).alias("name"), names.best_role(F.col("wide"), keywords, pack).alias("role"), F.array_join(F.slice("wide", 1, 6), "\n").alias("context"))


def from_markup(parsed: DataFrame, keywords: tuple[str, ...] = (), pack: Pack = DEFAULT) -> DataFrame:
    """Evidence of links, attributes, embedded data and scripts; missing names and roles come from the block around."""
    f = html.evidence(parsed).withColumn("context", names.clean_context(F.col("context"), keywords, pack, max_lines=8)).withColumn("lines", names.lines_of(F.col("context")))
    own = F.when(F.col("strategy") == "mailto_explicit", names.clean_name(F.col("name"), pack)).otherwise(collapse_blanks(F.col("name")))
    spare = F.when(F.col("strategy").isin("mailto_explicit", "html_attribute"), names.best_name(F.slice("lines", 1, 8), F.col("email"), pack)).otherwise("")
    role = F.when(F.col("role") != "", F.col("role")).otherwise(names.best_role(F.col("lines"), keywords, pack))
    return f.withColumn("own", own).select("page_id", "pos", "strategy", "email", F.when(F.col("own") != "", F.col("own")).otherwise(spare).alias("name"), role.alias("role"), "context")


def evidence(parsed: DataFrame, llm: DataFrame | None = None, keywords: tuple[str, ...] = (), pack: Pack = DEFAULT) -> DataFrame:
    """All evidence as a bag, in a fixed order of strategies: (page_id, ord, strategy, email, name, role, context).

    ``llm`` has rows of a model's extraction with the same columns but ord (outputs of such a call come as a table).
    """
    out = from_markup(parsed, keywords, pack).unionByName(from_text(parsed, keywords, pack))
    if llm is not None:
        out = out.unionByName(llm.select("page_id", F.lit(0).alias("pos"), F.lit("llm_structured").alias("strategy"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("email", "name", "role", "context")]))
    place = F.array_position(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy"))
    return out.select("page_id", (place * 1_000_000 + F.col("pos")).alias("ord"), "strategy", "email", "name", "role", "context")


def assembled(rows: DataFrame) -> DataFrame:
    """Evidence of one address (else one name and role, one role, one context) of a page as one candidate.

    The record of the greatest score leads, the earliest on ties; fields that it lacks come from the next ones.
    """
    flat = lambda c: collapse_blanks(F.coalesce(c, F.lit("")))
    r = rows.withColumns({c: flat(c) for c in ("name", "role")}).withColumn("mail", emails.normalized(F.col("email")))
    one = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"))
    nothing = F.lit("")
    key = (
        F.when(F.col("mail") != "", one("email", F.col("mail"), nothing)).when(F.col("name") != "", one("person", F.lower("name"), F.lower("role")))
        .when(F.col("role") != "", one("role", F.lower("role"), nothing)).otherwise(one("context", F.lower(F.substring(flat("context"), 1, 160)), nothing))
    )
    score = F.when(F.col("email") != "", 12).otherwise(0) + F.when(F.col("name") != "", 8).otherwise(0) + F.when(F.col("role") != "", 5).otherwise(0) + _points(F.col("strategy")) + F.floor(F.least(F.length("context"), F.lit(240)) / 60)
    order = F.struct(score.alias("score"), (-F.col("ord")).alias("o"))
    best = [F.coalesce(F.max_by(c, F.when(F.col(c) != "", order)), F.lit("")).alias(c) for c in ("email", "name", "role", "context")]
    # strategies are seven at most
    g = r.withColumn("key", key).groupBy("page_id", "key").agg(F.min("ord").alias("ord"), *best, F.array_sort(F.collect_set(F.struct(-_points(F.col("strategy")), "strategy"))).alias("s"))
    return g.select("page_id", "ord", "email", "name", "role", "context", F.transform("s", lambda x: x["strategy"]).alias("strategies"))


def cleaned(rows: DataFrame, keywords: tuple[str, ...] = (), pack: Pack = DEFAULT) -> DataFrame:
    """Candidates with clean names, roles and contexts and flags; of one mailbox (else name and role) the best stays.

    It takes flags and strategies of the others, and their role where it has none.
    """
    r = rows.select("page_id", "ord", "strategies", F.col("name").alias("raw_name"), F.col("role").alias("raw_role"), "email", emails.normalized(F.col("email")).alias("mail"), F.col("context").alias("raw_context"))
    r = r.withColumn("own", names.clean_name(F.col("raw_name"), pack)).withColumn("inferred", F.when(F.col("own") == "", names.infer_name(F.col("mail"), pack)).otherwise(""))
    r = r.withColumn("name", F.when(F.col("own") != "", F.col("own")).otherwise(F.col("inferred"))).withColumn("role", names.clean_role(F.col("raw_role"), keywords, pack)).withColumn("context", names.clean_context(F.col("raw_context"), keywords, pack))
    bare = (F.col("raw_name") != "") & (F.col("name") == "")
    had, flat = F.btrim("raw_context") != "", collapse_blanks(F.col("raw_context"))
    flags = F.array_compact(F.array(
        F.when(bare & names.address_like(F.col("raw_name"), pack), "address_like_name"), F.when(bare & names.office_label(F.col("raw_name"), pack), "office_label_name"),
        F.when((F.col("raw_name") == "") & (F.col("name") != ""), "name_inferred_from_email_localpart"), F.when(had & (F.col("context") != flat), "context_sanitized"), F.when(had & (F.col("context") == ""), "context_sanitized_empty"),
        F.when((F.col("email") != "") & (F.col("mail") == ""), "invalid_email_shape"), F.when((F.col("mail") != "") & emails.generic_mailbox(F.col("mail")), "generic_inbox"),
        F.when(F.array_contains("strategies", "explicit_obfuscation"), "obfuscation_recovered"), F.when((F.size("strategies") == 1) & F.array_contains("strategies", "mailto_explicit"), "mailto_only"),
        F.when(F.array_contains("strategies", "llm_structured") & (F.col("mail") == "") & names.person_name(F.col("name"), pack), "llm_named_without_email")))
    r = r.withColumn("flags", flags)
    key = F.when(F.col("mail") != "", F.concat(F.lit("m"), "mail")).when(F.col("name") != "", F.concat_ws("\t", F.lit("p"), F.lower("name"), F.lower("role"))).otherwise(F.concat_ws("\t", F.lit("f"), F.lower("raw_name"), F.lower("role")))
    score = F.when(F.col("mail") != "", 12).otherwise(0) + F.when(F.col("name") != "", 10).otherwise(0) + F.when(F.col("role") != "", 5).otherwise(0) + F.size("strategies") + F.when(F.array_contains("flags", "generic_inbox"), 0).otherwise(1)
    order = F.struct(score.alias("score"), (-F.col("ord")).alias("o"))
    g = r.withColumn("key", key).groupBy("page_id", "key").agg(
        F.max_by(F.struct("ord", "mail", "name", "raw_name", "raw_role"), order).alias("b"), F.coalesce(F.max_by("role", F.when(F.col("role") != "", order)), F.lit("")).alias("role"), F.coalesce(F.max_by("context", F.when(F.col("context") != "", order)), F.lit("")).alias("context"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("strategies")))).alias("strategies"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("flags"))
    return g.select("page_id", "b.ord", "b.mail", "b.name", "b.raw_name", "b.raw_role", "role", "context", "strategies", "flags")


def typed(rows: DataFrame, pack: Pack = DEFAULT) -> DataFrame:
    """Candidates by type. A name that doesn't fit its mailbox is split from it: an office and a person without address."""
    person, generic = names.person_name(F.col("name"), pack), F.array_contains("flags", "generic_inbox")
    fits = emails.matches_name(F.col("mail"), F.col("name"), pack)
    office = contains_any(F.lower(F.concat_ws(" ", "role", "raw_role", "context")), list(pack.office_role_terms)) | emails.generic_mailbox(F.col("mail"))
    r = rows.withColumns({"person": person, "generic": generic, "fits": fits, "office": office})
    split = (F.col("mail") != "") & F.col("person") & (F.col("generic") | ~F.col("fits"))
    one = lambda n, m, t: F.struct(n.alias("name"), m.alias("mail"), t.alias("candidate_type"))
    empty, lone = F.lit(""), F.when(F.col("office") | F.col("generic"), "office_contact").otherwise("junk_candidate")
    whole = F.when(F.col("mail") != "", F.when(F.col("person"), "named_contact").otherwise(lone)).otherwise(F.when(F.col("person"), "person_without_email").otherwise("junk_candidate"))
    out = F.when(split, F.array(one(empty, F.col("mail"), lone), one(F.col("name"), empty, F.lit("person_without_email")))).otherwise(F.array(one(F.when(whole == "office_contact", "").otherwise(F.col("name")), F.col("mail"), whole)))
    return r.withColumn("t", F.explode(out)).select("page_id", "ord", "t.name", "t.mail", "t.candidate_type", "role", "context", "strategies", "flags")


def pipeline(pages: DataFrame, llm: DataFrame | None = None, keywords: tuple[str, ...] = (), pack: Pack = DEFAULT, enrich: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Typed candidates of pages (page_id, html).

    ``enrich`` is the one place for functions of one's own, such as calls of a model: assembled candidates in, the same
    columns out. By default it changes nothing, so results are deterministic.
    """
    parsed = cut_lineage(html.parsed_pages(pages, "page_id", "html"))
    rows = cut_lineage(evidence(parsed, llm, keywords, pack))
    return typed(cleaned(enrich(assembled(rows)), keywords, pack), pack)


def for_filtering(rows: DataFrame) -> DataFrame:
    """Named contacts, then offices, numbered per page."""
    band = F.when(F.col("candidate_type") == "named_contact", 0).otherwise(1)
    kept = rows.filter(F.col("candidate_type").isin("named_contact", "office_contact"))
    return kept.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy(band, "ord", "mail")))


# ---- pages set from the tables ----


def _escaped(c: str) -> Column:
    return F.replace(F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))


def _mailed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "contacts").select("contact_id", "name", "role", emails.normalized(F.col("email")).alias("m"))
    return c.filter(F.col("m").rlike(r"^[a-z0-9._-]+@[a-z0-9-]+\.[a-z]+\z"))


def extraction_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in five kinds of markup, found again by strategy; a mail link's text is found twice."""
    c = _mailed(spark, d)
    local, dom = F.substring_index("m", "@", 1), F.substring_index("m", "@", -1)
    head, zone = F.substring_index(dom, ".", 1), F.substring_index(dom, ".", -1)
    k = F.col("contact_id") % 5
    body = (
        F.when(k == 0, F.concat(F.lit("<p>Write to <a href='mailto:"), "m", F.lit("?subject=a'>"), "m", F.lit("</a></p>"))).when(k == 1, F.concat(F.lit("<div data-user='"), local, F.lit("' data-domain='"), dom, F.lit("'>hidden</div>")))
        .when(k == 2, F.concat(F.lit('<script type="application/ld+json">{"a": [{"contactEmail": "'), "m", F.lit('"}]}</script>'))).when(k == 3, F.concat(F.lit("<script>var e = '"), local, F.lit("' + '@' + '"), head, F.lit("' + '."), zone, F.lit("';</script>")))
        .otherwise(F.concat(F.lit("<ul><li>"), local, F.lit(" [at] "), head, F.lit(" [dot] "), zone, F.lit("</li></ul>")))
    )
    parsed = html.parsed_pages(c.select("contact_id", F.concat(F.lit("<html><body><nav><a href='/'>Home</a></nav>"), body, F.lit("</body>")).alias("html")), "contact_id", "html")
    return evidence(cut_lineage(parsed)).select(F.col("page_id").alias("contact_id"), "strategy", "email")


def extraction_typed(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline on pages that give address, name and role in attributes."""
    c = _mailed(spark, d)
    page = F.concat(F.lit('<div data-email="'), "m", F.lit('" data-name="'), _escaped("name"), F.lit('" data-role="'), _escaped("role"), F.lit('">.</div>'))
    out = pipeline(c.select(F.col("contact_id").alias("page_id"), page.alias("html")))
    return out.select(F.col("page_id").alias("contact_id"), "name", "mail", "candidate_type", "role")


def html_hints(spark: SparkSession, d: str) -> DataFrame:
    """Signs of contacts without an address, of six kinds."""
    p = table(spark, d, "acquired_pages").select("page_id")
    kinds = (
        "<a href='javascript:openMail(7)'>x</a>", "<b onclick='contact(3)'>x</b>", "<a href='/form?recipient=desk7&a=1'>x</a>", "<i data-mail-key='k7'>x</i>", "<form action='/send?contact_id=7'></form>", "<div class='vcard big'>x</div>",
    )
    page = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("page_id") % 6 + 1).cast("int"))
    return html.hints(html.parsed_pages(p.select("page_id", page.alias("html")), "page_id", "html")).select("page_id", "pattern", "detail")


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of home pages by section, each address once: of the same site, no files; sections before the body."""
    i = table(spark, d, "institutions").select(F.ascii(F.right("institution_id", F.lit(1))).alias("k"), "institution_id", F.concat(F.lit("https://"), F.lower("home_domain"), F.lit("/")).alias("home"), F.xxhash64("institution_id").alias("page_id"))
    page = F.concat(F.lit("<a href='staff'>Staff</a><a href='/people'>again</a><footer><a href='/contact#x'>Contact</a></footer><nav><a href='"), "home", F.lit("people'>People</a><a href='https://elsewhere.example/'>Out</a></nav><a href='map.pdf'>Map</a>"))
    parsed = html.anchors(html.parsed_pages(i.select("page_id", page.alias("html")), "page_id", "html")).join(i.select("page_id", "institution_id", "home"), "page_id")
    rows = parsed.withColumn("url", urls.normalized(html.absolute(F.col("home"), F.col("url")))).filter(urls.same_site(F.col("url"), F.col("home")) & ~urls.is_asset(F.col("url")))
    place = F.when(F.col("section") == "nav", 0).when(F.col("section") == "header", 1).when(F.col("section") == "footer", 2).otherwise(3)
    return top_per_group(rows, ["institution_id", "url"], [place, F.col("pos")], 1).select("institution_id", "url", "section", "text")


def hreflang_pick(spark: SparkSession, d: str) -> DataFrame:
    """The alternate page of the language that a country prefers: the exact language, then a form of it, else the home page."""
    i = table(spark, d, "institutions").select("institution_id", F.lower("country_code").alias("cc"), F.concat(F.lit("https://"), F.lower("home_domain"), F.lit("/")).alias("home"), F.xxhash64("institution_id").alias("page_id"))
    page = F.lit("<head><link rel='alternate' hreflang='fr-CA' href='/ca/'><link rel='alternate' hreflang='it' href='/it/'><link rel='alternate' hreflang='en-GB' href='/gb/'><link rel='alternate' hreflang='en' href='/en/'></head>")
    alt = html.alternates(html.parsed_pages(i.select("page_id", page.alias("html")), "page_id", "html"))
    prefer = F.when(F.col("cc") == "fr", F.array(F.lit("fr"), F.lit("en"))).when(F.col("cc") == "it", F.array(F.lit("it"), F.lit("en"))).otherwise(F.array(F.lit("en")))
    pref = i.select("page_id", "institution_id", "home", F.posexplode(prefer).alias("rank", "want"))
    hit = pref.join(alt, "page_id").filter((F.col("lang") == F.col("want")) | F.startswith("lang", F.concat("want", F.lit("-"))))
    best = hit.groupBy("page_id").agg(F.min_by("href", F.struct("rank", (F.col("lang") != F.col("want")).alias("x"), "pos")).alias("href"))
    return i.join(best, "page_id", "left").select("institution_id", F.coalesce(html.absolute(F.col("home"), F.col("href")), "home").alias("url"))


def pagination_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to further pages, by relation, class or number, in the order of the document; the first three of a page."""
    p = table(spark, d, "acquired_pages").select("page_id", "url")
    page = F.lit("<a rel='next' href='/list?page=2'>next</a><a class='pager__item' href='/p3'>3</a><a href='/about'>About</a><a href='/news/page/4/'>4</a><a href='/list?a=1&page=9'>9</a><a href='/list?page=2'>2</a>")
    rows = html.anchors(html.parsed_pages(p.select("page_id", page.alias("html")), "page_id", "html")).join(p.withColumnRenamed("url", "base"), "page_id")
    more = F.contains("rel", F.lit("next")) | F.lower("css").rlike("pager|pagination|nav|next") | F.col("url").rlike(r"[?&]page=\d+|/page/\d+/?")
    rows = rows.filter(more).withColumn("url", urls.normalized(html.absolute(F.col("base"), F.col("url")))).groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    return top_per_group(rows, ["page_id"], [F.col("pos")], 3, "position").select("page_id", "position", F.regexp_replace("url", "^https?://[^/]*", "").alias("url"))


def directory_forms(spark: SparkSession, d: str) -> DataFrame:
    """Forms that search a directory: sent by GET, and with a term of directories or a field of searches."""
    p = table(spark, d, "acquired_pages").select("page_id")
    kinds = ("<form><input name='q'></form>", "<form method='post'><input name='q'></form>", "<form method='GET' action='/find'><label>Staff directory</label><input name='zz'></form>", "<form><input name='news'></form>")
    page = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("page_id") % 4 + 1).cast("int"))
    f = html.forms(html.parsed_pages(p.select("page_id", page.alias("html")), "page_id", "html"))
    fields = F.transform(F.split("fields", " "), urls.path_token)
    return f.select("page_id", ((F.col("method") == "get") & (contains_any(F.col("text"), ["directory", "annuaire", "people"]) | F.arrays_overlap(fields, F.array(*[F.lit(x) for x in ("q", "search", "query", "name", "annuaire")])))).alias("directory"))


def cms_pages(spark: SparkSession, d: str) -> DataFrame:
    """What site software a page shows."""
    t = F.concat(F.element_at(F.array(F.lit("<link href='/wp-content/x.css'>"), F.lit("<script data-drupal-selector='drupal-settings-json'>"), F.lit("<p>")), (F.col("page_id") % 3 + 1).cast("int")), F.lit("x"))
    low = F.lower("h")
    return table(spark, d, "acquired_pages").select("page_id", t.alias("h")).select("page_id", F.when(contains_any(low, ["wp-content", "wordpress", "wp-json"]), "wordpress").when(contains_any(low, ["drupal-settings-json", "drupal"]), "drupal").otherwise("").alias("cms"))


def site_maps(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of institutions through robots files, a site map of site maps, and the maps below it."""
    p = table(spark, d, "acquired_pages").select("page_id", "institution_id", "url")
    home = table(spark, d, "institutions").select("institution_id", F.concat(F.lit("https://"), "home_domain").alias("home"))
    robots = home.select("institution_id", F.concat(F.lit("User-agent: *\nSitemap: "), "home", F.lit("/index.xml\nsitemap: "), "home", F.lit("/index.xml")).alias("txt"))
    starts = html.robots_sitemaps(robots, "institution_id", "txt").select(F.col("institution_id").alias("site"), "url")
    loc = lambda c: F.concat(F.lit("<url><loc> "), c, F.lit(" </loc></url>"))
    index = home.select(F.concat("home", F.lit("/index.xml")).alias("url"), F.concat(loc(F.concat("home", F.lit("/a.xml"))), loc(F.concat("home", F.lit("/b.XML"))), loc(F.concat("home", F.lit("/index.xml")))).alias("xml"))
    part = p.join(home, "institution_id").withColumn("map", F.when(F.col("page_id") % 2 == 0, "/a.xml").otherwise("/b.XML"))
    below = part.groupBy(F.concat("home", "map").alias("url")).agg(F.concat_ws("", F.collect_list(loc(F.col("url")))).alias("xml"))
    return html.sitemap_walk(starts, cut_lineage(index.unionByName(below))).withColumnRenamed("site", "institution_id")


def cms_search(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in answers of two kinds of site search: url or link of items; alias or node number of nodes."""
    p = table(spark, d, "acquired_pages").select("page_id", "url")
    first = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('[{"url": "'), "url", F.lit('"}, {"id": 3}]'))).when(F.col("page_id") % 4 == 1, F.concat(F.lit('[{"link": "'), "url", F.lit('"}]')))
    second = F.when(F.col("page_id") % 4 == 2, F.concat(F.lit('{"data": [{"attributes": {"path": {"alias": "/a/'), F.col("page_id").cast("string"), F.lit('"}}}]}'))).when(F.col("page_id") % 4 == 3, F.concat(F.lit('{"data": [{"attributes": {"drupal_internal__nid": '), F.col("page_id").cast("string"), F.lit("}}]}")))
    items = F.transform(F.from_json("a", "array<struct<url: string, link: string>>"), lambda x: F.coalesce(x["url"], x["link"]))
    nodes = F.transform(F.from_json("b", "struct<data: array<struct<attributes: struct<path: struct<alias: string>, drupal_internal__nid: bigint>>>>")["data"], lambda x: F.coalesce(x["attributes"]["path"]["alias"], F.concat(F.lit("/node/"), x["attributes"]["drupal_internal__nid"].cast("string"))))
    rows = p.select("page_id", "url", first.alias("a"), second.alias("b")).select("page_id", "url", F.explode(F.concat(F.coalesce(items, F.array().cast("array<string>")), F.coalesce(nodes, F.array().cast("array<string>")))).alias("hit")).filter("hit is not null")
    return rows.select("page_id", F.when(F.startswith("hit", F.lit("/")), F.concat(F.regexp_extract("url", "^(https?://[^/]*)", 1), "hit")).otherwise(F.col("hit")).alias("found"))


def search_results(spark: SparkSession, d: str) -> DataFrame:
    """Links of a results page: web addresses, no files, each once, the first two."""
    i = table(spark, d, "institutions").select("institution_id", F.lower("home_domain").alias("dom"), F.xxhash64("institution_id").alias("page_id"))
    page = F.concat(F.lit("<a href='ftp://x/'>a</a><a href='https://"), "dom", F.lit("/r.pdf'>b</a><a href='https://"), "dom", F.lit("/'>c</a><a href='https://"), "dom", F.lit("/#top'>d</a><a href='https://b.example/p'>e</a><a href='https://c.example/'>f</a>"))
    rows = html.anchors(html.parsed_pages(i.select("page_id", page.alias("html")), "page_id", "html")).withColumn("url", urls.normalized(F.col("url"))).filter(urls.scheme(F.col("url")).isin("http", "https") & ~urls.is_asset(F.col("url")))
    rows = rows.groupBy("page_id", "url").agg(F.min("pos").alias("pos"))
    return top_per_group(rows, ["page_id"], [F.col("pos")], 2, "position").join(i.select("page_id", "institution_id"), "page_id").select("institution_id", "position", "url")


def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of data that scripts embed, by type or by assignment; deep values, no addresses of the web, each line once."""
    p = table(spark, d, "institutions").select("institution_id", "canonical_name", F.xxhash64("institution_id").alias("page_id"))
    page = F.concat(F.lit('<script>window.__STATE__ = {"a": {"b": [{"n": "'), F.replace("canonical_name", F.lit('"'), F.lit("")), F.lit('", "u": "https://x.example/"}]}};</script><script type="application/json">["", {"t": "Office {of} Words"}, {"t": "Office {of} Words"}]</script>'))
    parsed = html.parsed_pages(p.select("page_id", page.alias("html")), "page_id", "html").join(p, "page_id")
    return parsed.select("institution_id", F.replace("embedded", F.lit("\n"), F.lit("|")).alias("lines"), "documents")


def role_holder_names(spark: SparkSession, d: str) -> DataFrame:
    """The best name two lines around the first line of a page that speaks of a director or a head."""
    lines = table(spark, d, "acquired_pages").select("page_id", names.lines_of(F.col("visible_text")).alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: F.lower(x).rlike("director|head of")), True)
    hit = lines.withColumn("at", at).filter("at > 0").select("page_id", F.posexplode(_around(F.col("lines"), F.col("at").cast("int") - 1, 2)).alias("i", "line"))
    # one line a row: the name in each is worked out once
    kept = hit.filter(~names.boilerplate(F.col("line")) & (F.size(names.word_tokens(F.col("line"))) <= 8)).withColumn("k", F.row_number().over(Window.partitionBy("page_id").orderBy("i")))
    named = cut_lineage(kept.select("page_id", "k", names.clean_name(F.col("line")).alias("name"))).filter("name <> ''")
    words = F.size(F.split("name", " "))
    score = 11 - F.col("k") + F.when(words == 2, 2).when(words >= 4, -1).otherwise(0)
    return named.groupBy("page_id").agg(F.max_by("name", F.struct(score, -F.col("k"))).alias("name"))


def _queries() -> dict:
    from rosterloom.plans import people as pp
    from rosterloom.plans.people import _P, _clean_role_sql, _has, _ROLE_TEXT, clean_name_sql, flat, matchable_sql, person_sql, tok
    from rosterloom.plans.scalars import _E

    kw, pp.KEYWORDS = pp.KEYWORDS, ()
    clean_role, boiler = _clean_role_sql("u"), pp.boiler_sql("y")
    pp.KEYWORDS = kw
    mailed = f"(select contact_id, \"name\", \"role\", em from (select *, {_E} em from contacts) where regexp_matches(em, '^[a-z0-9._-]+@[a-z0-9-]+\\.[a-z]+$'))"
    gen = "(?i)^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)"
    infer = f"(with q as (select contact_id, em, split_part(em, '@', 1) lo, list_filter(string_split_regex(regexp_replace(split_part(em, '@', 1), '[+].*$', ''), '[._-]+'), lambda p: p <> '') ps from m0), s as (select contact_id, lo, array_to_string(list_transform(ps, lambda p: upper(p[1]) || p[2:]), ' ') cand from q where not regexp_matches(lo, '{gen}') and not regexp_matches(lo, '[0-9]') and len(ps) between 2 and 4 and len(list_filter(ps, lambda p: length(p) < 2)) = 0), x as (select contact_id, lo, z.name nm from s join {clean_name_sql('s', 'contact_id', 'cand')} z using (contact_id)), m as (select *, coalesce(w[1], '') f, coalesce(w[-1], '') l, len(w) k from (select *, {matchable_sql('nm')} w from x)) select contact_id, nm from m where nm <> '' and {person_sql('nm')} and {pp._MATCH_HITS} and k >= 2)"
    typed_sql = f"""with m0 as {mailed}, cn as {clean_name_sql('m0', 'contact_id', "coalesce(" + chr(34) + "name" + chr(34) + ", '')")}, inf as {infer}, rl as (select contact_id, {clean_role} r from (select contact_id, {_ROLE_TEXT} u from m0)),
      b as (select m0.contact_id, em, split_part(em, '@', 1) lo, case when cn.name <> '' then cn.name else coalesce(inf.nm, '') end nm, r, {flat('coalesce(m0.role, chr(32))')} rr from m0 join cn using (contact_id) left join inf using (contact_id) join rl using (contact_id)),
      t as (select *, {person_sql('nm')} person, regexp_matches(lo, '{gen}') g, coalesce(w[1], '') f, coalesce(w[-1], '') l, len(w) k from (select *, {matchable_sql('nm')} w from b)),
      z as (select *, not g and k >= 2 and {pp._MATCH_HITS} fits, case when {_has("lower(r || ' ' || rr)", _P.office_role_terms)} or g then 'office_contact' else 'junk_candidate' end lone from t)
      select contact_id, '' "name", em mail, lone candidate_type, r "role" from z where person and (g or not fits) union all select contact_id, nm, '', 'person_without_email', r from z where person and (g or not fits)
      union all select contact_id, case when not person and lone = 'office_contact' then '' else nm end, em, case when person then 'named_contact' else lone end, r from z where not (person and (g or not fits))"""
    page_lines = f"list_filter(list_transform(string_split(visible_text, chr(10)), lambda x: {flat('x')}), lambda x: x <> '')"
    return {
        "extraction_evidence": (extraction_evidence, f"with m as {mailed} select contact_id, case contact_id % 5 when 0 then 'mailto_explicit' when 1 then 'html_attribute' when 2 then 'embedded_json' when 3 then 'js_decode' else 'explicit_obfuscation' end strategy, em email from m union all select contact_id, 'visible_regex', em from m where contact_id % 5 = 0"),
        "extraction_typed": (extraction_typed, typed_sql),
        "html_hints": (html_hints, "select page_id, ['javascript_contact_anchor', 'onclick_contact_handler', 'contact_param_link', 'data_attribute_contact_hint', 'contact_form_param', 'structured_contact_markup'][page_id % 6 + 1] pattern, ['javascript:openMail(7)', 'contact(3)', 'recipient=desk7', 'data-mail-key=k7', 'contact_id=7', 'structured contact markup'][page_id % 6 + 1] detail from acquired_pages"),
        "page_links": (page_links, "with h as (select institution_id, 'https://' || lower(home_domain) || '/' h from institutions) select institution_id, h || 'people' url, 'nav' section, 'People' \"text\" from h union all select institution_id, h || 'contact', 'footer', 'Contact' from h union all select institution_id, h || 'staff', 'body', 'Staff' from h"),
        "hreflang_pick": (hreflang_pick, "select institution_id, 'https://' || lower(home_domain) || case lower(country_code) when 'fr' then '/ca/' when 'it' then '/it/' else '/en/' end url from institutions"),
        "pagination_links": (pagination_links, "select page_id, unnest([1, 2, 3]) position, unnest(['/list?page=2', '/p3', '/news/page/4/']) url from acquired_pages"),
        "directory_forms": (directory_forms, "select page_id, page_id % 4 in (0, 2) directory from acquired_pages"),
        "cms_pages": (cms_pages, "select page_id, ['wordpress', 'drupal', ''][page_id % 3 + 1] cms from acquired_pages"),
        "site_maps": (site_maps, "select distinct institution_id, url from acquired_pages"),
        "cms_search": (cms_search, "select page_id, case page_id % 4 when 0 then url when 1 then url when 2 then regexp_extract(url, '^(https?://[^/]*)', 1) || '/a/' || page_id else regexp_extract(url, '^(https?://[^/]*)', 1) || '/node/' || page_id end found from acquired_pages"),
        "search_results": (search_results, "select institution_id, unnest([1, 2]) position, unnest(['https://' || lower(home_domain) || '/', 'https://b.example/p']) url from institutions"),
        "embedded_texts": (embedded_texts, f"select institution_id, {flat('replace(canonical_name, chr(34), chr(32))').replace('chr(32)', chr(39) * 2)} || '|Office {{of}} Words' lines, 2 documents from institutions"),
        "role_holder_names": (role_holder_names, f"with p as (select page_id, ls, list_position(list_transform(ls, lambda x: regexp_matches(lower(x), 'director|head of')), true) k from (select page_id, {page_lines} ls from acquired_pages)), n as (select page_id, i, y from (select page_id, unnest(range(1, len(z) + 1)) i, unnest(z) y from (select page_id, ls[greatest(k - 2, 1):k + 2] z from p where k > 0))), u as (select page_id * 100 + i id, page_id, y, row_number() over (partition by page_id order by i) j from n where not {boiler} and len({tok('y')}) <= 8), c as {clean_name_sql('u', 'id', 'y')}, s as (select page_id, j, c.name nm, 11 - j + case when len(string_split(c.name, ' ')) = 2 then 2 when len(string_split(c.name, ' ')) >= 4 then -1 else 0 end sc from u join c using (id) where c.name <> '') select page_id, arg_max(nm, (sc, -j)) \"name\" from s group by 1"),
    }


QUERIES = _queries()
