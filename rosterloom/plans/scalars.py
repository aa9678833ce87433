"""Scalar functions on whole columns: addresses, e-mails, names, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails, text, urls
from rosterloom.operators.records import line_context
from rosterloom.session import table


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired_pages").select("page_id", "institution_id", "url")


def url_normalized(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("page_url")
    return table(spark, d, "contacts").select("contact_id", urls.without_fragment(u).alias("v1"), urls.normalized(u).alias("v2"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("page_url")
    return table(spark, d, "contacts").select("contact_id", urls.scheme(u).alias("scheme"), urls.host(u).alias("host"), urls.path(u).alias("path"), urls.depth(u).cast("int").alias("depth"), urls.site_root(urls.host(u)).alias("site_root"), F.element_at(urls.segments(F.concat(u, F.lit("/-"))), 1).alias("first_segment"))


def url_branches(spark: SparkSession, d: str) -> DataFrame:
    """Pages per branch of a site: host and the first segment of the path."""
    return _pages(spark, d).groupBy(urls.branch_key(F.col("url"), 1).alias("branch")).agg(F.count("*").alias("pages"))


def home_variants(spark: SparkSession, d: str) -> DataFrame:
    """Addresses to try for home pages given as http://<language>.<domain>/start for every other institution, else https://<domain>."""
    odd = F.ascii(F.right("institution_id", F.lit(1))) % 2 == 1
    home = F.when(odd, F.concat(F.lit("http://fr."), F.col("home_domain"), F.lit("/start"))).otherwise(F.concat(F.lit("https://"), F.col("home_domain")))
    return table(spark, d, "institutions").select("institution_id", F.posexplode(urls.home_variants(home)).alias("pos", "v")).select("institution_id", "pos", "v.url", "v.reason")


def same_site_links(spark: SparkSession, d: str) -> DataFrame:
    """Contacts whose page lies on another site than the institution's home."""
    inst = table(spark, d, "institutions").select("institution_id", F.concat(F.lit("https://"), "home_domain").alias("home"))
    c = table(spark, d, "contacts").select("contact_id", "institution_id", "page_url").join(inst, "institution_id")
    return c.select("contact_id", urls.same_site(F.col("page_url"), F.col("home")).alias("same_site"), urls.is_asset(F.col("page_url")).alias("asset"))


def domain_relationship(spark: SparkSession, d: str) -> DataFrame:
    """How the domain of an e-mail relates to the home domain, with its trust."""
    inst = table(spark, d, "institutions").select("institution_id", urls.host(F.concat(F.lit("//"), "home_domain")).alias("home"))
    c = table(spark, d, "ranked_contacts").select("ranked_id", "institution_id", emails.domain(emails.normalized(F.col("email"))).alias("dom")).join(inst, "institution_id")
    kind = urls.domain_relationship(F.col("home"), F.col("dom"))
    return c.select("ranked_id", kind.alias("relationship"), urls.domain_trust(kind).cast("int").alias("trust"))


def email_extract(spark: SparkSession, d: str) -> DataFrame:
    """Every address in the page texts, with its position."""
    p = table(spark, d, "acquired_pages")
    return p.select("page_id", F.posexplode(emails.all_emails("visible_text")).alias("pos", "email"))


def email_normalized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contacts").select("contact_id", emails.normalized(F.col("email")).alias("email"))


def email_features(spark: SparkSession, d: str) -> DataFrame:
    e = emails.normalized(F.col("email"))
    return table(spark, d, "contacts").select("contact_id", emails.local_part(e).alias("local"), emails.local_alnum(e).alias("local_alnum"), emails.domain(e).alias("dom"), emails.generic_mailbox(e).alias("generic"), emails.well_formed(F.coalesce(F.col("email"), F.lit(""))).alias("well_formed"))


def email_obfuscated(spark: SparkSession, d: str) -> DataFrame:
    """Addresses spelled out in page texts, made whole; the pages spell "@" only, so their dots are spelled out first."""
    text = F.regexp_replace("visible_text", r"(?i)( \[at\] [a-z0-9-]+)\.([a-z]+)", "$1 [dot] $2")
    return table(spark, d, "acquired_pages").select("page_id", F.posexplode(emails.obfuscated_emails(text)).alias("pos", "email"))


def name_features(spark: SparkSession, d: str) -> DataFrame:
    n = F.coalesce("name", F.lit(""))
    return table(spark, d, "contacts").select("contact_id", text.collapse_blanks(n).alias("collapsed"), text.alnum_key(n).alias("folded"), F.size(text.word_tokens(n)).alias("tokens"), text.slug(text.fold_accents(n)).alias("slug"))


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


def content_signatures(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "acquired_pages").select("page_id", text.content_signature(F.col("visible_text")).alias("signature"))


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of page texts by how often they stand in the corpus: the fifty most frequent."""
    lines = table(spark, d, "acquired_pages").select(F.explode(F.split("visible_text", "\n")).alias("line")).select(F.btrim("line", F.lit(" ")).alias("line")).filter("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "line").limit(50)


def email_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines with an address, and one line on either side."""
    return line_context(table(spark, d, "acquired_pages"), "page_id", "visible_text", F.col("line").rlike(emails.EMAIL)).select("page_id", "line_no", F.sha1(F.col("context").cast("binary")).alias("context"))


def role_line(spark: SparkSession, d: str) -> DataFrame:
    """Of every page, the line that looks most like a role: greatest score, then the earliest."""
    words = r"(?i)\b(director|head|coordinator|officer|manager|advisor|assistant)\b"
    lines = table(spark, d, "acquired_pages").select("page_id", F.posexplode(F.split("visible_text", "\n")).alias("pos", "line"))
    score = F.when(F.col("line").rlike(words), 4).otherwise(0) + F.when(F.col("line").rlike(r"(?i)\b(international|mobility|admissions|exchange)\b"), 4).otherwise(0) - F.when(F.contains("line", F.lit("@")), 1).otherwise(0) - F.when(F.length("line") > 180, 1).otherwise(0)
    return lines.withColumn("score", score).filter("score >= 2").groupBy("page_id").agg(F.max_by("pos", F.struct("score", -F.col("pos"))).alias("pos"), F.max("score").alias("score"))


_NET = "lower(regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"
_HOST = "regexp_replace(regexp_replace(" + _NET + ", ':[0-9]+$', ''), '^www\\.', '')"
_PATH = "regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"
_SCHEME = "lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
_ROOT = "case when len(string_split({h}, '.')) <= 2 then {h} when len(string_split({h}, '.')[-1]) = 2 and string_split({h}, '.')[-2] in ('ac', 'co', 'gov', 'org', 'edu') then array_to_string(string_split({h}, '.')[-3:], '.') else array_to_string(string_split({h}, '.')[-2:], '.') end"
_LABELS = "list_filter(string_split({h}, '.'), lambda x: x <> '')"
_REG = "case when len(" + _LABELS + ") > 2 and length(" + _LABELS + "[-1]) = 2 and length(" + _LABELS + "[-2]) <= 3 then array_to_string(" + _LABELS + "[-3:], '.') else array_to_string(" + _LABELS + "[-2:], '.') end"
_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_PLAIN = "case when contains(coalesce({e}, ''), '%') then url_decode({e}) else coalesce({e}, '') end"
_STRIPPED = f"trim(regexp_replace(regexp_replace({_PLAIN}, '^\\s*(?i:mailto:)', ''), '(?s)\\?.*$', ''), E' \\t\\n<>()[].,;:''\"')"
_NORM = f"case when regexp_matches({_STRIPPED}, '^" + _EMAIL.replace("{", "{{").replace("}", "}}") + f"$') then lower({_STRIPPED}) else '' end"
_E = _NORM.format(e="email")
_FOLD = "lower(strip_accents(replace(replace(replace(replace(replace(replace(replace(replace(lower({c}), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), 'ø', 'o'), 'ł', 'l'), 'đ', 'd'), 'ı', 'i'), 'ð', 'ð')))"


def _u(sql: str, **k: str) -> str:
    return sql.format(**k)


_P = {"u": "page_url"}
QUERIES = {
    "url_normalized": (url_normalized, f"select contact_id, regexp_replace(page_url, '#.*$', '') v1, case when {_u(_NET, **_P)} = '' then page_url else case when {_u(_SCHEME, **_P)} = '' then 'https' else {_u(_SCHEME, **_P)} end || '://' || case when {_u(_SCHEME, **_P)} = 'http' then regexp_replace({_u(_NET, **_P)}, ':80$', '') when {_u(_SCHEME, **_P)} = 'https' then regexp_replace({_u(_NET, **_P)}, ':443$', '') else {_u(_NET, **_P)} end || case when {_u(_PATH, **_P)} = '' then '/' else {_u(_PATH, **_P)} end || case when regexp_extract(page_url, '\\?([^#]*)', 1) = '' then '' else '?' || regexp_extract(page_url, '\\?([^#]*)', 1) end end v2 from contacts"),
    "url_parts": (url_parts, f"select contact_id, {_u(_SCHEME, **_P)} as \"scheme\", {_u(_HOST, **_P)} as \"host\", {_u(_PATH, **_P)} as \"path\", len(list_filter(string_split({_u(_PATH, **_P)}, '/'), lambda x: x <> ''))::int \"depth\", {_ROOT.format(h=_u(_HOST, **_P))} site_root, list_filter(string_split(regexp_extract(page_url || '/-', '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')[1] first_segment from contacts"),
    "url_branches": (url_branches, f"select {_u(_HOST, u='url')} || ':' || array_to_string(list_transform(list_filter(string_split({_u(_PATH, u='url')}, '/'), lambda x: x <> '')[1:1], lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '-')), '/') branch, count(*) pages from acquired_pages group by 1"),
    "home_variants": (home_variants, "with h as (select institution_id, home_domain dm, ascii(institution_id[-1]) % 2 = 1 odd from institutions), v as (select institution_id, unnest(case when odd then ['http://fr.' || dm || '/start', 'https://fr.' || dm || '/start', 'http://fr.' || dm || '/', 'https://fr.' || dm || '/', 'http://www.fr.' || dm || '/', 'https://www.fr.' || dm || '/', 'http://' || dm || '/', 'https://' || dm || '/'] when starts_with(dm, 'www.') then ['https://' || dm, 'https://' || dm[5:] || '/'] else ['https://' || dm, 'https://www.' || dm || '/'] end) url, unnest(case when odd then ['original', 'upgrade_https', 'strip_path_to_root', 'upgrade_https_strip_path', 'add_www_root', 'add_www_https_root', 'drop_language_root', 'drop_language_https_root'] when starts_with(dm, 'www.') then ['original', 'drop_www_root'] else ['original', 'add_www_root'] end) reason, unnest(case when odd then range(8) else range(2) end)::int pos from h) select * from v"),
    "same_site_links": (same_site_links, f"select contact_id, {_u(_SCHEME, **_P)} in ('http', 'https') and {_ROOT.format(h=_u(_HOST, **_P))} = {_ROOT.format(h=_u(_HOST, u=chr(39) + 'https://' + chr(39) + ' || i.home_domain'))} same_site, regexp_matches(page_url, '(?i)\\.(?:pdf|jpe?g|png|gif|svg|webp|ico|css|js|zip|gz|docx?|xlsx?|pptx?|mp[34]|avi|mov|woff2?)(?:$|[?#])') asset from contacts join institutions i using (institution_id)"),
    "domain_relationship": (domain_relationship, f"select ranked_id, rel relationship, case rel when 'primary' then 100 when 'subsite' then 80 when 'partner' then 30 else 50 end trust from (select ranked_id, case when dom = '' then 'secondary' when dom = home then 'primary' when {_REG.format(h='dom')} = {_REG.format(h='home')} then 'subsite' else 'partner' end rel from (select ranked_id, case when contains(em, '@') then string_split(em, '@')[-1] else '' end dom, regexp_replace(home_domain, '^www\\.', '') home from (select ranked_id, institution_id, {_E} em from ranked_contacts) join institutions using (institution_id)))"),
    "email_extract": (email_extract, f"select page_id, (unnest(range(1, len(m) + 1)) - 1)::int pos, unnest(m) email from (select page_id, regexp_extract_all(visible_text, '{_EMAIL}') m from acquired_pages)"),
    "email_normalized": (email_normalized, f"select contact_id, {_E} email from contacts"),
    "email_features": (email_features, f"select contact_id, string_split(em, '@')[1] \"local\", regexp_replace(string_split(em, '@')[1], '[^a-z0-9]', '', 'g') local_alnum, case when contains(em, '@') then string_split(em, '@')[-1] else '' end dom, regexp_matches(string_split(em, '@')[1], '^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)') generic, len(string_split(raw, '@')) = 2 and string_split(raw, '@')[1] <> '' and contains(string_split(raw, '@')[-1], '.') and not regexp_matches(raw, '\\s') and not regexp_matches(string_split(raw, '@')[-1], '^\\.|\\.$') well_formed from (select contact_id, {_E} em, coalesce(email, '') raw from contacts)"),
    "email_obfuscated": (email_obfuscated, f"select page_id, (unnest(range(1, len(m) + 1)) - 1)::int pos, unnest(m) email from (select page_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(visible_text, '(?i)\\s*(?:\\[\\s*at\\s*\\]|\\(\\s*at\\s*\\))\\s*|\\s+at\\s+', chr(57344), 'g'), '(?i)\\s*(?:\\[\\s*dot\\s*\\]|\\(\\s*dot\\s*\\))\\s*|\\s+dot\\s+', chr(57345), 'g'), '[A-Za-z0-9._%+-]+' || chr(57344) || '[A-Za-z0-9.-]+(?:' || chr(57345) || '[A-Za-z0-9.-]+)+'), lambda e: lower(replace(replace(e, chr(57344), '@'), chr(57345), '.'))), lambda e: regexp_matches(e, '^{_EMAIL}$')))) m from (select page_id, regexp_replace(visible_text, '(?i)( \\[at\\] [a-z0-9-]+)\\.([a-z]+)', '\\1 [dot] \\2', 'g') visible_text from acquired_pages))"),
    "name_features": (name_features, f"select contact_id, trim(regexp_replace(n, '[\\s\\x{{00a0}}]+', ' ', 'g'), ' ') collapsed, trim(regexp_replace({_FOLD.format(c='n')}, '[^a-z0-9]+', ' ', 'g'), ' ') folded, len(regexp_extract_all(n, '\\p{{L}}+(?:[''’`.-]\\p{{L}}+)*'))::int tokens, substring(regexp_replace(trim({_FOLD.format(c='n')}, ' '), '[^A-Za-z0-9]+', '_', 'g'), 1, 80) slug from (select contact_id, coalesce(name, '') n from contacts)"),
    "token_counts": (token_counts, "select doc_id, greatest(1, floor(length(coalesce(text, '')) / 4))::int tokens from documents"),
    "content_signatures": (content_signatures, "select page_id, sha1(substring(lower(trim(regexp_replace(coalesce(visible_text, ''), '[\\s\\x{00a0}]+', ' ', 'g'), ' ')), 1, 2500)) signature from acquired_pages"),
    "line_counts": (line_counts, "select line, count(*) n from (select trim(unnest(string_split(visible_text, chr(10))), ' ') line from acquired_pages) where line <> '' group by 1 order by n desc, line limit 50"),
    "email_context": (email_context, f"select page_id, (i - 1)::int line_no, sha1(array_to_string(l[greatest(i - 1, 1):i + 1], chr(10))) context from (select page_id, string_split(visible_text, chr(10)) l, unnest(range(1, len(string_split(visible_text, chr(10))) + 1)) i from acquired_pages) where regexp_matches(l[i], '{_EMAIL}')"),
    "role_line": (role_line, "select page_id, arg_max(pos, (score, -pos))::int pos, max(score)::int score from (select page_id, pos, (case when regexp_matches(line, '(?i)\\b(director|head|coordinator|officer|manager|advisor|assistant)\\b') then 4 else 0 end) + (case when regexp_matches(line, '(?i)\\b(international|mobility|admissions|exchange)\\b') then 4 else 0 end) - (case when contains(line, '@') then 1 else 0 end) - (case when length(line) > 180 then 1 else 0 end) score from (select page_id, unnest(range(1, len(l) + 1)) - 1 pos, unnest(l) line from (select page_id, string_split(visible_text, chr(10)) l from acquired_pages))) where score >= 2 group by 1"),
}
