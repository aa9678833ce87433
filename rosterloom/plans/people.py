"""Names, roles and mailboxes of contacts: cleaning, matching, recovery of addresses, checking of addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import emails, names
from rosterloom.functions.packs import BOILERPLATE, DEFAULT, INTERNATIONAL_HINTS, ROLE_WORDS, SENIORITY
from rosterloom.functions.text import collapse_blanks, word_tokens
from rosterloom.operators.records import best_by
from rosterloom.session import table

KEYWORDS = ("mobility", "admissions")
#: Domains that everybody has mailboxes at; local parts that are a role. Fixed values.
COMMON_DOMAINS = ("gmail.com", "googlemail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "proton.me", "protonmail.com", "gmx.com", "aol.com", "live.com")
ROLE_MAILBOXES = (
    "admin", "administrator", "billing", "contact", "csr", "customercare", "customerservice", "enquiries", "enquiry", "finance", "help", "helpdesk", "hr", "info", "it", "marketing", "news", "noreply", "no-reply", "office", "orders",
    "postmaster", "root", "sales", "security", "support", "team", "webmaster",
)
#: Domains known as disposable, for the query below.
DISPOSABLE = ("mailinator.com", "trolprirpril.test")


def _contacts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "contacts")


def name_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of a name and how many are title-like, with and without those of capitals only; particles left out."""
    c = _contacts(spark, d).select("contact_id", word_tokens(F.coalesce("name", F.lit(""))).alias("w"))
    count = lambda caps: F.size(F.filter("w", lambda t: names.title_like(F.btrim(t, F.lit(".,")), caps)))
    return c.select("contact_id", F.size("w").alias("tokens"), count(True).alias("with_capitals"), count(False).alias("without"), F.size(names.visible(F.col("w"))).alias("visible"))


def clean_names(spark: SparkSession, d: str) -> DataFrame:
    """The best name in "E-mail: <address> | name, role": noise around and in it."""
    c = _contacts(spark, d)
    noisy = F.concat_ws(" ", F.lit("E-mail:"), F.coalesce("email", F.lit("")), F.lit("|"), F.coalesce("name", F.lit("")))
    return c.select("contact_id", names.clean_name(F.col("name")).alias("name"), names.clean_name(noisy).alias("from_noise"), names.address_like(collapse_blanks(F.coalesce("name", F.lit("")))).alias("address_like"), names.office_label(collapse_blanks(F.coalesce("name", F.lit("")))).alias("office_label"))


def person_names(spark: SparkSession, d: str) -> DataFrame:
    return _contacts(spark, d).select("contact_id", names.person_name(F.col("name")).alias("person"), names.suspicious_name(F.col("name")).alias("suspicious"), names.enrichable(F.col("name")).alias("enrichable"))


def page_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Whether the page of a contact mentions its name and its role."""
    p = table(spark, d, "acquired_pages").select("page_id", F.col("visible_text").alias("text"))
    c = _contacts(spark, d).select("contact_id", "page_id", "name", "role").join(p, "page_id")
    return c.select("contact_id", names.mentions_name(F.col("text"), F.col("name")).alias("names"), names.mentions_role(F.col("text"), F.col("role")).alias("roles"))


def candidate_match(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page is about a contact: it mentions the name, and the institution or the role."""
    p = table(spark, d, "acquired_pages").select("page_id", F.col("visible_text").alias("text"))
    i = table(spark, d, "institutions").select("institution_id", "canonical_name")
    c = _contacts(spark, d).filter("trim(name) <> ''").select("contact_id", "page_id", "institution_id", "name", "role").join(p, "page_id").join(i, "institution_id")
    low, words = F.lower("text"), F.slice(names.lower_tokens(F.col("canonical_name")), 1, 2)
    target = F.contains(low, F.lower("canonical_name")) | F.exists(words, lambda t: F.contains(low, t))
    return c.select("contact_id", (names.mentions_name(F.col("text"), F.col("name")) & (target | names.mentions_role(F.col("text"), F.col("role")))).alias("matches"))


def role_lines(spark: SparkSession, d: str) -> DataFrame:
    """Score, signal and clean form of every typed role."""
    r = collapse_blanks(F.coalesce("role", F.lit("")))
    return _contacts(spark, d).select("contact_id", names.role_score(r, KEYWORDS).alias("score"), names.strong_role(r, KEYWORDS).alias("strong"), names.boilerplate(r, KEYWORDS).alias("boilerplate"), names.clean_role(F.col("role"), KEYWORDS).alias("role"))


def clean_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Context of a page: useful lines, six at most, cut to 320 characters at a blank."""
    return table(spark, d, "acquired_pages").select("page_id", names.clean_context(F.col("visible_text"), KEYWORDS).alias("context"))


def mailbox_signals(spark: SparkSession, d: str) -> DataFrame:
    e = emails.normalized(F.col("email"))
    c = _contacts(spark, d).select("contact_id", "role", e.alias("e"))
    relevant, irrelevant, unscoped = names.localpart_has(F.col("e"), DEFAULT.relevant_mailbox_terms), names.localpart_has(F.col("e"), DEFAULT.irrelevant_mailbox_terms), names.unscoped_mailbox(F.col("e"))
    return c.select("contact_id", relevant.alias("relevant"), irrelevant.alias("irrelevant"), unscoped.alias("unscoped"))


def inferred_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that local parts spell."""
    return _contacts(spark, d).select("contact_id", names.infer_name(emails.normalized(F.col("email"))).alias("name")).filter("name <> ''")


def email_alignment(spark: SparkSession, d: str) -> DataFrame:
    e = emails.normalized(F.col("email"))
    return _contacts(spark, d).select("contact_id", emails.aligned(F.col("name"), e).alias("aligned"))


def email_scores(spark: SparkSession, d: str) -> DataFrame:
    """Points of every address as that of the named person; accepted from 5, of high confidence from 7."""
    score = emails.match_score(emails.normalized(F.col("email")), F.col("name"), F.col("role"), F.col("home_domain"))
    return _contacts(spark, d).select("contact_id", score.alias("score")).select("contact_id", "score", F.when(F.col("score") >= 7, "high").when(F.col("score") >= 5, "accepted").otherwise("").alias("verdict"))


def pattern_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Local parts that the templates give for every person."""
    c = _contacts(spark, d).filter("candidate_type = 'person'")
    return c.select("contact_id", F.explode(emails.pattern_values(F.col("name"))).alias("pattern", "local"))


def _known_patterns(spark: SparkSession, d: str) -> DataFrame:
    """(institution_id, pattern, support): the commonest pattern of local parts of named rows, the first seen on ties."""
    c = _contacts(spark, d).select("institution_id", "contact_id", "name", emails.normalized(F.col("email")).alias("mail")).filter("mail <> ''").filter(names.person_name(F.col("name")))
    hit = c.select("institution_id", "contact_id", emails.local_part(F.col("mail")).alias("local"), F.explode(emails.pattern_values(F.col("name"))).alias("pattern", "value")).filter("local = value")
    n = hit.groupBy("institution_id", "pattern").agg(F.count("*").alias("support"), F.min("contact_id").alias("first"))
    return best_by(n, ["institution_id"], [F.col("support"), -F.col("first"), F.col("pattern")], ["pattern", "support"])


def pattern_inference(spark: SparkSession, d: str) -> DataFrame:
    return _known_patterns(spark, d).withColumn("confidence", F.when(F.col("support") >= 3, "medium").otherwise("low"))


def pattern_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Addresses for persons without one: their institution's commonest pattern and domain, the first seen on ties."""
    c = _contacts(spark, d)
    person = names.person_name(F.col("name"))
    mailed = c.select("institution_id", "contact_id", "name", emails.normalized(F.col("email")).alias("mail")).filter("mail <> ''").filter(person)
    dom = mailed.groupBy("institution_id", emails.domain(F.col("mail")).alias("dom")).agg(F.count("*").alias("n"), F.min("contact_id").alias("first"))
    dom = best_by(dom, ["institution_id"], [F.col("n"), -F.col("first")], ["dom"])
    bare = c.filter("coalesce(trim(email), '') = ''").filter(person).select("contact_id", "institution_id", emails.pattern_values(F.col("name")).alias("m"))
    found = bare.join(pattern_inference(spark, d), "institution_id").join(dom, "institution_id")
    return found.select("contact_id", "pattern", "confidence", F.concat(F.try_element_at("m", F.col("pattern")), F.lit("@"), "dom").alias("email")).filter("email is not null")


def first_emails(spark: SparkSession, d: str) -> DataFrame:
    return _contacts(spark, d).select("contact_id", emails.first_email(F.concat(F.lit("write mailto:"), F.coalesce("email", F.lit("")), F.lit(" or call"))).alias("email"))


def link_emails(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in links of three kinds: mailto:, a query parameter, a handler; written with %40."""
    c = _contacts(spark, d).select("contact_id", emails.normalized(F.col("email")).alias("m")).filter("m <> ''")
    coded = F.replace("m", F.lit("@"), F.lit("%40"))
    link = F.when(F.col("contact_id") % 3 == 0, F.concat(F.lit("mailto:"), coded, F.lit("?subject=x"))).when(F.col("contact_id") % 3 == 1, F.concat(F.lit("/form?lang=en&recipient="), coded)).otherwise(F.concat(F.lit("javascript:write('"), "m", F.lit("')")))
    return c.select("contact_id", F.array_join(emails.link_emails(link), ",").alias("emails"))


def mail_checks(spark: SparkSession, d: str) -> DataFrame:
    """SMTP answers to statuses, mail hosts to providers (answers and hosts derived from event rows)."""
    ev = table(spark, d, "events")
    code = F.when(F.col("event_id") % 7 == 6, None).otherwise(F.element_at(F.array(*[F.lit(x) for x in (250, 550, 421, 552, 300, 450)]), (F.col("event_id") % 6 + 1).cast("int")))
    message = F.when(F.col("event_id") % 11 == 0, "5.7.1 Sender in BLACKLIST").otherwise("ok")
    host = F.concat(F.lit("mx."), F.element_at(F.array(*[F.lit(x) for x in ("aspmx.L.google.com", "x.protection.outlook.com", "mta5.yahoodns.net", "eu.mimecast.com", "own.example", "mx1.pphosted.com", "smtp.secureserver.net")]), (F.col("event_id") % 7 + 1).cast("int")))
    return ev.select("event_id", emails.smtp_status(code, message).alias("status"), emails.mail_provider(host).alias("provider"))


def offline_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against each address without asking its server, and the nearest common domain for one a typo away.

    Mail hosts come as a table (here: domains that any page of the institution's own site serves); probe results are
    joined on the address.
    """
    r = table(spark, d, "ranked_contacts").select("ranked_id", emails.normalized(F.col("email")).alias("mail"))
    r = r.withColumn("dom", emails.domain(F.col("mail")))
    mx = table(spark, d, "institutions").select(F.lower("home_domain").alias("dom"), F.lit(True).alias("mx")).distinct()
    doms = r.select("dom").filter("dom <> ''").distinct()
    near = [F.when(F.levenshtein("dom", F.lit(c)) == 1, F.lit(c)) for c in COMMON_DOMAINS]
    typo = doms.select("dom", F.coalesce(*near).alias("typo")).filter("typo is not null").filter(~F.col("dom").isin(list(COMMON_DOMAINS)))
    j = r.join(mx, "dom", "left").join(typo, "dom", "left")
    ok = F.col("mail") != ""
    reasons = F.array_compact(F.array(
        F.when(~ok, "invalid_syntax"), F.when(ok & emails.local_part(F.col("mail")).isin(list(ROLE_MAILBOXES)), "role_address"), F.when(ok & F.col("dom").isin(list(DISPOSABLE)), "disposable_domain"),
        F.when(ok & F.col("mx").isNull(), "no_mx"), F.when(ok & F.col("typo").isNotNull(), "likely_typo_domain")))
    return j.select("ranked_id", reasons.alias("reasons"), F.when(ok & F.col("typo").isNotNull(), F.concat(emails.local_part(F.col("mail")), F.lit("@"), "typo")).alias("suggestion"))


def email_reasons(spark: SparkSession, d: str) -> DataFrame:
    return offline_verdicts(spark, d).select("ranked_id", F.array_join("reasons", ",").alias("reasons"), "suggestion")


def bounce_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risk under the strict and the other policies; probe results are joined on the address."""
    v = offline_verdicts(spark, d).withColumn("status", F.element_at(F.array(*[F.lit(x) for x in ("valid", "invalid", "tempfail", "not_tested")]), (F.col("ranked_id") % 4 + 1).cast("int")))
    catch, full = F.when(F.col("ranked_id") % 5 == 0, "yes").otherwise("no"), F.col("ranked_id") % 13 == 0
    risk = lambda policy: emails.bounce_risk(policy, F.col("reasons"), F.col("status"), catch, full)
    return v.select("ranked_id", risk("strict").alias("strict"), risk("balanced").alias("balanced"))


def typo_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Domains one edit from a common one, with the nearest; the domains are common ones, every third with a letter dropped."""
    pick = F.ascii(F.right("institution_id", F.lit(1)))
    i = table(spark, d, "institutions").select("institution_id", pick.alias("k"), F.element_at(F.array(*[F.lit(c) for c in COMMON_DOMAINS]), pick % len(COMMON_DOMAINS) + 1).alias("dom"))
    i = i.withColumn("dom", F.when(F.col("k") % 3 == 0, F.concat(F.left("dom", F.lit(1)), F.substring("dom", 3, 100))).otherwise(F.col("dom")))
    best = F.array_min(F.array(*[F.struct(F.levenshtein("dom", F.lit(c)).alias("d"), F.lit(n).alias("n"), F.lit(c).alias("c")) for n, c in enumerate(COMMON_DOMAINS)]))
    return i.withColumn("b", best).filter("b.d = 1").select("institution_id", "dom", F.col("b.c").alias("suggestion"))


def role_holders(spark: SparkSession, d: str) -> DataFrame:
    """Terms to look role holders up by, and whether a row speaks of one."""
    c = _contacts(spark, d).select("contact_id", "role", F.lit("").alias("context"), emails.normalized(F.col("email")).alias("mail"))
    a = (F.col("role"), F.col("context"), F.col("mail"))
    return c.select("contact_id", F.array_join(names.holder_terms(*a), "|").alias("terms"), names.holder_signal(*a).alias("signal"))


def best_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of the ranked rows of a mailbox the best evidence, and what it says of the candidate: score, then high confidence."""
    r = table(spark, d, "ranked_contacts").select("ranked_id", "institution_id", "name", F.lower(F.trim("confidence")).alias("c"), emails.normalized(F.col("email")).alias("mail")).filter("mail <> ''")
    score = F.when(F.col("c") == "high", 8).when(F.col("c") == "medium", 5).otherwise(2)
    b = best_by(r.withColumn("score", score), ["institution_id", "mail"], [F.col("score"), (F.coalesce("c", F.lit("")) == "high").cast("int"), -F.col("ranked_id")], ["ranked_id", "name", "score", "c"])
    named = names.person_name(F.col("name"))
    return b.select("institution_id", "mail", "ranked_id", F.when(named, 0.85).otherwise(0.0).alias("name_confidence"), (F.col("score") / 8.0).alias("strength"), F.when(F.col("c") == "high", 0.9).otherwise(0.7).alias("email_confidence"))


def next_actions(spark: SparkSession, d: str) -> DataFrame:
    """The next step to complete a row: an ordered choice on what is known and what was tried."""
    c = _contacts(spark, d).filter("coalesce(trim(email), '') = ''").select("contact_id", "role", names.person_name(F.col("name")).alias("ready"), (F.col("contact_id") % 3).alias("tried"))
    terms = names.holder_terms(F.col("role"), F.lit(""), F.lit(""))
    holder = ~F.col("ready")
    action = (
        F.when(holder & (F.col("tried") == 0), "search_governance_pages").when(holder & (F.size(terms) > 0) & (F.col("tried") == 1), "search_international_pages").when(holder, "search_web_for_person")
        .when(F.col("tried") == 0, "search_people_pages").when(F.col("tried") == 1, "query_directory_by_name").otherwise("infer_email_pattern")
    )
    return c.select("contact_id", action.alias("action"), F.when(holder, "resolve_person_from_role").otherwise("resolve_email").alias("goal"))


# ---- SQL ----


def _in(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _has(hay: str, terms) -> str:
    return "(" + " or ".join(f"contains({hay}, '{t}')" for t in terms) + ")" if terms else "false"


_P = DEFAULT
TOK = "regexp_extract_all({x}, '\\p{{L}}+(?:[''’`.-]\\p{{L}}+)*')"
BARE = "lower(trim({t}, '.,'))"


def tok(x: str) -> str:
    return TOK.format(x=x)


def ltok(x: str) -> str:
    return f"list_transform({tok(x)}, lambda q: lower(q))"


def title_sql(t: str, caps: bool) -> str:
    letters = f"regexp_replace({t}, '[^\\p{{L}}]', '', 'g')"
    extra = f" or regexp_matches({letters}[2:], '^\\p{{Lu}}+$')" if caps else ""
    return f"({letters} <> '' and (not regexp_matches({letters}, '[\\p{{Lu}}\\p{{Ll}}]') or (regexp_matches({letters}, '^\\p{{Lu}}') and ({letters}[2:] = '' or regexp_matches({letters}[2:], '\\p{{Ll}}'){extra}))))"


def visible_sql(w: str) -> str:
    return f"list_filter({w}, lambda v: not list_contains({_in(_P.name_particles)}, {BARE.format(t='v')}))"


def role_sql(x: str) -> str:
    return f"(regexp_matches({x}, '(?i)(?:{ROLE_WORDS})') or regexp_matches({x}, '(?i)(?:{SENIORITY})'))"


def address_sql(x: str) -> str:
    return f"({_has(f'lower({x})', _P.boilerplate_name_fragments)} or list_has_any({ltok(x)}, {_in(_P.address_terms)}) or regexp_matches(lower({x}), '\\b\\d{{1,5}}\\b') or (contains({x}, ',') and {_has(f'lower({x})', _P.address_terms)}))"


def office_sql(x: str) -> str:
    return f"({_has(f'lower({x})', _P.boilerplate_name_fragments)} or len({tok(x)}) = 0 or list_has_any({ltok(x)}, {_in(_P.office_name_terms)}) or {role_sql(x)})"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}]+', ' ', 'g'), ' ')"


def suspicious_sql(x: str) -> str:
    return f"({_has(f'lower(trim({x}))', _P.suspicious_name_phrases)} or list_has_any({ltok(f'lower(trim({x}))')}, {_in(_P.suspicious_name_terms)}))"


def person_sql(x: str) -> str:
    shown = visible_sql(tok(f"trim({x})"))
    like = f"len(list_filter({shown}, lambda z: {title_sql(BARE.format(t='z').replace('lower', ''), False)}))"
    return f"({x} <> '' and not {suspicious_sql(x)} and not regexp_matches({x}, '\\p{{Nd}}') and length({x}) <= 80 and len({shown}) >= 2 and {like} >= 2 and not {role_sql(x)})"


def matchable_sql(x: str, titles: bool = False) -> str:
    left = _P.name_particles + (_P.person_name_titles if titles else ())
    kept = f"list_filter({ltok(x)}, lambda m: not list_contains({_in(left)}, m))"
    return f"case when len({kept}) >= 2 then {kept} else {ltok(x)} end"


def _unlabelled(x: str, words: str) -> str:
    """Text without whole label words, in any script. A match takes the character before it along, so neighbours need a second pass."""
    for _ in range(2):
        x = f"regexp_replace(regexp_replace({x}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{words})[:-]', '\\1 ', 'g'), '(?i)(^|[^\\p{{L}}\\p{{N}}_])(?:{words})($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    return x


def clean_name_sql(source: str, key: str, x: str) -> str:
    """(key, name): the best run of two to four tokens, from a table of all runs."""
    words = "e-?mail|mail|tel|telephone|phone|fax|contact|contacts|responsabile|role|title|name"
    mail = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
    return f"""(
      with src as (select {key}, {flat(x)} t from {source}),
      words as (select {key}, {tok(_unlabelled(f"regexp_replace(regexp_replace(t, '{mail}', ' ', 'g'), '[_|/]+', ' ', 'g')", words))} w from src where t <> '' and not {address_sql('t')} and not {office_sql('t')}),
      runs as (select {key}, i, n, w[i:i + n - 1] r from (select {key}, w, n, unnest(range(1, greatest(len(w) - n + 2, 1))) i from words, (values (2), (3), (4)) z(n))),
      good as (select *, {visible_sql('r')} s from runs),
      fine as (select * from good where len(s) >= 2 and not {role_sql("array_to_string(r, ' ')")} and len(list_filter(s, lambda g: list_contains({_in(_P.name_stopwords)}, {BARE.format(t='g')}) or not {title_sql("trim(g, '.,')", True)})) = 0),
      best as (select {key}, array_to_string(list_transform(arg_max(r, (len(s) * 10 + case n when 2 then 4 when 3 then 2 else 0 end, -i, array_to_string(r, ' '))), lambda b: case when length(b) > 1 and b = upper(b) and b <> lower(b) then upper(b[1]) || lower(b[2:]) else b end), ' ') c from fine group by {key})
      select {key}, case when c is null or {address_sql('c')} or {office_sql('c')} then '' else c end "name" from (select {key} from {source}) left join best using ({key}))"""


def strong_sql(x: str) -> str:
    low = f"lower({x})"
    intl = _has(low, _P.international_markers)
    return f"({x} <> '' and ({_has(low, KEYWORDS)} or {role_sql(x)} or regexp_matches({x}, '(?i)(?:{INTERNATIONAL_HINTS})') or {_has(low, _P.role_signal_terms + _P.office_role_terms + _P.relevant_office_role_terms)} or ({intl} and {_has(low, _P.office_markers)}) or ({intl} and {_has(low, _P.admissions_markers)})))"


def boiler_sql(x: str) -> str:
    low = f"lower({x})"
    hits = "(" + " + ".join(f"contains({low}, '{m}')::int" for m in BOILERPLATE) + ")"
    starts = "(" + " or ".join(f"{low} = '{m}' or starts_with({low}, '{m} ')" for m in BOILERPLATE) + ")"
    words = f"len({tok(x)})"
    mails = f"len(regexp_extract_all({x}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}'))"
    cuts = f"(length({low}) - length(replace({low}, '|', '')) >= 2 or length({low}) - length(replace({low}, ' > ', '')) >= 6)"
    return f"({x} = '' or (not {strong_sql(x)} and ({starts} or ({hits} >= 1 and {words} <= 4 and length({x}) <= 40) or {hits} >= 2 or {words} >= 28 or length({x}) >= 220 or ({words} >= 18 and length({x}) >= 120) or {mails} > 1 or {cuts})))"


def score_sql(x: str) -> str:
    low = f"lower({x})"
    plus = f"5 * {_has(low, KEYWORDS)}::int + 4 * regexp_matches({x}, '(?i)(?:{ROLE_WORDS})')::int + 2 * regexp_matches({x}, '(?i)(?:{SENIORITY})')::int + 4 * regexp_matches({x}, '(?i)(?:{INTERNATIONAL_HINTS})')::int + 4 * {_has(low, _P.role_signal_terms)}::int + {_has(low, _P.office_role_terms)}::int - contains({x}, '@')::int - (length({x}) > 180)::int"
    return f"case when length({x}) < 3 then -10 when {boiler_sql(x)} then -6 else {plus} end"


_MAILRE = "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"
_ROLE_FLAT = f"regexp_replace(trim(regexp_replace(coalesce(\"role\", ''), '[\\s\\x{{00a0}}]+', ' ', 'g'), ' '), '{_MAILRE}', ' ', 'g')"
_ROLE_TEXT = f"trim(regexp_replace(regexp_replace({_unlabelled(_ROLE_FLAT, 'e-?mail|mail|tel|telephone|phone|fax')}, '\\s*[:|]\\s*', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'), ' ')"


def _clean_role_sql(t: str) -> str:
    low = f"lower({t}[1:200])"
    intl = _has(low, _P.international_markers)
    aliases = " ".join(f"when {_has(low, terms)} then '{role}'" for role, terms in _P.role_aliases)
    keys = " ".join(f"when contains({low}, '{k}') then '{k}'" for k in KEYWORDS)
    return f"case when {t} = '' or {boiler_sql(t)} then '' {aliases} when {intl} and {_has(low, _P.office_markers)} then 'international office' when {intl} and {_has(low, _P.admissions_markers)} then 'international admissions' {keys} else {t}[1:180] end"


def _fill_sql(template: str) -> str:
    return " || ".join({"{first}": "f", "{last}": "l", "{f}": "f[1]"}.get(p, f"'{p}'") for p in __import__("re").findall(r"\{\w+\}|[^{}]", template))


_GEN = "(?i)^(?:info|enquiries|enquiry|contact|office|support|hello|admissions|international|ug|pg|postgrad|undergrad|apply|students|noreply)"
_MATCH_HITS = "(" + " or ".join(f"contains(lo, {_fill_sql(t)})" for t in emails.MATCHES) + ")"


def _queries() -> dict:
    from rosterloom.plans.scalars import _E

    n = "coalesce(\"name\", '')"
    ends = lambda titles: f"select *, coalesce(w[1], '') f, coalesce(w[-1], '') l, len(w) k from (select *, {matchable_sql(n, titles)} w from (select *, {_E} em, split_part(lower({_E}), '@', 1) lo, lower(split_part({_E}, '@', -1)) dm from contacts))"
    mail_match = f"(contains(em, '@') and not regexp_matches(lo, '{_GEN}') and k >= 2 and {_MATCH_HITS})"
    patterns = " union all ".join(f"select institution_id, contact_id, '{p}' pattern, {_fill_sql(t)} \"local\", lo, candidate_type, \"name\", em, email from ends where k >= 2" for p, t in emails.PATTERNS.items())
    known = f"with ends as ({ends(True)}), pat as ({patterns}), hit as (select institution_id, pattern, count(*) support, min(contact_id) fst from pat where em <> '' and {person_sql(n)} and \"local\" = lo group by 1, 2), kp as (select institution_id, arg_max(pattern, (support, -fst, pattern)) pattern, max(support) support from hit group by 1)"
    conf = "case when support >= 3 then 'medium' else 'low' end confidence"
    sc = "(2 * contains(lo, f)::int + 2 * contains(lo, l)::int + contains(lo, f[1] || l[1])::int + 2 * (contains(lo, f || '.' || l) or contains(lo, f || '_' || l) or contains(lo, f || '-' || l))::int + 2 * (contains(lo, f[1] || '.' || l) or contains(lo, f[1] || l))::int)"
    near = "(dm = home_domain or ends_with(dm, '.' || home_domain) or ends_with(home_domain, '.' || dm))"
    total = f"case when lo = '' or em = '' or k < 2 or {sc} = 0 then 0 else {sc} + 2 * {near}::int + {_has('lower(coalesce(role, chr(32)))', emails.SCOPE)}::int end"
    offline = f"""select ranked_id, em, dm, list_filter([case when em = '' then 'invalid_syntax' end, case when em <> '' and list_contains({_in(ROLE_MAILBOXES)}, lo) then 'role_address' end, case when em <> '' and list_contains({_in(DISPOSABLE)}, dm) then 'disposable_domain' end,
      case when em <> '' and not exists (select 1 from institutions i where lower(i.home_domain) = dm) then 'no_mx' end, case when em <> '' and typo is not null then 'likely_typo_domain' end], lambda x: x is not null) reasons, case when em <> '' and typo is not null then lo || '@' || typo end suggestion
      from (select *, case when not list_contains({_in(COMMON_DOMAINS)}, dm) then list_filter({_in(COMMON_DOMAINS)}, lambda c: levenshtein(dm, c) = 1)[1] end typo from (select ranked_id, em, split_part(em, '@', 1) lo, case when em = '' then '' else split_part(em, '@', -1) end dm from (select ranked_id, {_E} em from ranked_contacts)))"""
    risk = lambda hard, extra: f"ranked_id % 13 = 0 or list_has_any(reasons, {_in(hard)}) or st = 'invalid'{extra}"
    hay = f"lower(array_to_string(list_filter([{flat('coalesce(role, chr(32))')}, trim(regexp_replace(lo, '[^a-z0-9]+', ' ', 'g'), ' ')] || list_filter({_in(_P.relevant_mailbox_terms)}, lambda t: contains(lo, t)), lambda p: p <> ''), ' '))"
    listed = _in(_P.senior_role_terms + _P.international_leadership_terms + _P.relevant_office_role_terms + _P.role_signal_terms)
    ordered = "list_filter(list_transform(list_zip(a, range(1, len(a) + 1)), lambda z: case when list_position(a, z[1]) = z[2] then z[1] end), lambda z: z is not null and length(z) >= 3)"
    holders = f"(select contact_id, hy, list_filter({listed}, lambda t: contains(hy, t)) || list_filter(string_split_regex(lo, '[^a-z0-9]+'), lambda t: length(t) >= 4) || list_filter([lower(rl)], lambda t: t <> '') a from (select contact_id, lo, {flat('coalesce(role, chr(32))')} rl, {hay} hy from (select contact_id, role, split_part({_E}, '@', 1) lo from contacts)))"
    lines = f"list_filter(list_transform(string_split(visible_text, chr(10)), lambda x: {flat('x')}), lambda x: x <> '')"
    once = "list_filter(list_transform(list_zip(ls, range(1, len(ls) + 1)), lambda z: case when list_position(ls, z[1]) = z[2] then z[1] end), lambda z: z is not null)"
    link = "case contact_id % 3 when 0 then em when 1 then em else em end"
    typo = f"(select institution_id, case when k % 3 = 0 then c[1] || c[3:] else c end dom from (select institution_id, ascii(institution_id[-1]) k, {_in(COMMON_DOMAINS)}[ascii(institution_id[-1]) % {len(COMMON_DOMAINS)} + 1] c from institutions))"
    return {
        "name_tokens": (name_tokens, f"select contact_id, len(w)::int tokens, len(list_filter(w, lambda t: {title_sql(chr(40) + 'trim(t, ' + chr(39) + '.,' + chr(39) + '))', True)}))::int with_capitals, len(list_filter(w, lambda t: {title_sql(chr(40) + 'trim(t, ' + chr(39) + '.,' + chr(39) + '))', False)}))::int \"without\", len({visible_sql('w')})::int visible from (select contact_id, {tok(n)} w from contacts)"),
        "clean_names": (clean_names, f"select contact_id, a.name \"name\", b.name from_noise, {address_sql('t')} address_like, {office_sql('t')} office_label from (select contact_id, {flat(n)} t from contacts) join {clean_name_sql('contacts', 'contact_id', n)} a using (contact_id) join {clean_name_sql('contacts', 'contact_id', chr(39) + 'E-mail: ' + chr(39) + ' || coalesce(email, ' + chr(39) * 2 + ') || ' + chr(39) + ' | ' + chr(39) + ' || ' + n)} b using (contact_id)"),
        "person_names": (person_names, f"select contact_id, {person_sql(n)} person, {suspicious_sql(n)} suspicious, nm <> '' and not {_has('nm', _P.enrichment_block_phrases)} and len(w) between 2 and 5 and not list_has_any(w, {_in(_P.enrichment_block_terms)}) enrichable from (select contact_id, \"name\", lower({flat(n)}) nm, {matchable_sql(n, True)} w from contacts)"),
        "page_mentions": (page_mentions, f"select contact_id, len(w) > 0 and (contains(t, array_to_string(w, ' ')) or len(list_filter(w, lambda x: contains(t, x))) >= greatest(2, len(w) - 1)) \"names\", len(list_filter(rw, lambda x: contains(t, x))) > 0 roles from (select contact_id, {matchable_sql(n, True)} w, list_filter({ltok('coalesce(role, chr(32))')}, lambda x: length(x) > 3)[1:4] rw, lower(visible_text) t from contacts join acquired_pages using (page_id))"),
        "candidate_match": (candidate_match, f"select contact_id, (len(w) > 0 and (contains(t, array_to_string(w, ' ')) or len(list_filter(w, lambda x: contains(t, x))) >= greatest(2, len(w) - 1))) and (contains(t, lower(cn)) or len(list_filter(cw, lambda x: contains(t, x))) > 0 or len(list_filter(rw, lambda x: contains(t, x))) > 0) matches from (select contact_id, {matchable_sql(n, True)} w, list_filter({ltok('coalesce(role, chr(32))')}, lambda x: length(x) > 3)[1:4] rw, lower(visible_text) t, canonical_name cn, {ltok('canonical_name')}[1:2] cw from contacts c join acquired_pages p on p.page_id = c.page_id join institutions i on i.institution_id = c.institution_id where trim(c.name, ' ') <> '')"),
        "role_lines": (role_lines, f"select contact_id, {score_sql('r')} score, {strong_sql('r')} strong, {boiler_sql('r')} boilerplate, {_clean_role_sql('u')} \"role\" from (select contact_id, {flat('coalesce(role, chr(32))')} r, {_ROLE_TEXT} u from contacts)"),
        "clean_contexts": (clean_contexts, f"with a as (select page_id, {lines} ls from acquired_pages), b as (select page_id, ls, {once} us from a), c as (select page_id, ls, list_filter(us, lambda y: not {boiler_sql('y')}) good from b), e as (select page_id, array_to_string((case when len(good) > 0 then good else list_filter(ls, lambda y: regexp_matches(y, '{_MAILRE}') or {strong_sql('y')}) end)[1:6], chr(10)) t from c) select page_id, case when length(t) > 320 then rtrim(case when contains(t[1:320], ' ') then regexp_extract(t[1:320], '(?s)^(.*) [^ ]*$', 1) else t[1:320] end, ' ,;:/|-') else t end context from e"),
        "mailbox_signals": (mailbox_signals, f"select contact_id, {_has('la', _P.relevant_mailbox_terms)} relevant, {_has('la', _P.irrelevant_mailbox_terms)} irrelevant, list_contains({_in(_P.generic_unscoped_localparts)}, lo) unscoped from (select contact_id, lo, regexp_replace(lo, '[^a-z0-9]', '', 'g') la from (select contact_id, split_part({_E}, '@', 1) lo from contacts))"),
        "inferred_names": (inferred_names, f"with c as (select contact_id, {_E} em from contacts), q as (select contact_id, em, split_part(em, '@', 1) lo0, list_filter(string_split_regex(regexp_replace(split_part(em, '@', 1), '[+].*$', ''), '[._-]+'), lambda p: p <> '') ps from c where em <> ''), s as (select contact_id, em, lo0 lo, array_to_string(list_transform(ps, lambda p: upper(p[1]) || p[2:]), ' ') cand from q where not regexp_matches(lo0, '{_GEN}') and not regexp_matches(lo0, '[0-9]') and len(ps) between 2 and 4 and len(list_filter(ps, lambda p: length(p) < 2)) = 0), x as (select contact_id, em, lo, z.name nm from s join {clean_name_sql('s', 'contact_id', 'cand')} z using (contact_id)), m as (select *, coalesce(w[1], '') f, coalesce(w[-1], '') l, len(w) k from (select *, {matchable_sql('nm')} w from x)) select contact_id, nm \"name\" from m where nm <> '' and {person_sql('nm')} and {_MATCH_HITS} and k >= 2"),
        "email_alignment": (email_alignment, f"select contact_id, length(la) >= 4 and (s >= 2 or (s >= 1 and i >= 1)) aligned from (select contact_id, la, len(list_filter(w, lambda x: length(x) >= 3 and contains(la, x))) s, len(list_filter(w, lambda x: x <> '' and not (length(x) >= 3 and contains(la, x)) and contains(la, x[1]))) i from (select contact_id, list_transform({matchable_sql(n)}, lambda x: regexp_replace(x, '[^a-z0-9]+', '', 'g')) w, regexp_replace(split_part({_E}, '@', 1), '[^a-z0-9]', '', 'g') la from contacts))"),
        "email_scores": (email_scores, f"select contact_id, sc::int score, case when sc >= 7 then 'high' when sc >= 5 then 'accepted' else '' end verdict from (select contact_id, {total} sc from ({ends(True)}))"),
        "email_name_match": (email_name_match, f"select contact_id, {mail_match} matches from ({ends(False)})"),
        "pattern_candidates": (pattern_candidates, f"with ends as ({ends(True)}), pat as ({patterns}) select contact_id, pattern, \"local\" from pat where candidate_type = 'person'"),
        "pattern_inference": (pattern_inference, f"{known} select institution_id, pattern, support, {conf} from kp"),
        "pattern_recovery": (pattern_recovery, f"{known}, ms as (select institution_id, dm, count(*) n, min(contact_id) fst from ends where em <> '' and {person_sql(n)} group by 1, 2), md as (select institution_id, arg_max(dm, (n, -fst)) dom from ms group by 1) select contact_id, pattern, {conf}, \"local\" || '@' || dom email from pat join kp using (institution_id, pattern) join md using (institution_id) where coalesce(trim(email, ' '), '') = '' and {person_sql(n)}"),
        "first_emails": (first_emails, f"select contact_id, nullif(regexp_extract(replace('write mailto:' || coalesce(email, '') || ' or call', 'mailto:', ' '), '({_MAILRE})', 1), '') email from contacts"),
        "link_emails": (link_emails, f"select contact_id, {link} emails from (select contact_id, {_E} em from contacts) where em <> ''"),
        "mail_checks": (mail_checks, "select event_id, case when code is null then 'error' when event_id % 11 = 0 then 'blocked' when code = 250 then 'valid' when code between 500 and 599 then 'invalid' when code between 400 and 499 then 'tempfail' else 'unknown' end status, ['gmail', 'outlook', 'yahoodns', 'mimecast', 'mx.own.example', 'proofpoint', 'secureserver'][event_id % 7 + 1] provider from (select event_id, case when event_id % 7 = 6 then null else [250, 550, 421, 552, 300, 450][event_id % 6 + 1] end code from events)"),
        "email_reasons": (email_reasons, f"select ranked_id, array_to_string(reasons, ',') reasons, suggestion from ({offline})"),
        "bounce_risks": (bounce_risks, f"select ranked_id, {risk(('invalid_syntax', 'no_mx', 'disposable_domain', 'likely_typo_domain'), ' or st <> ' + chr(39) + 'valid' + chr(39) + ' or ranked_id % 5 = 0')} strict, {risk(('invalid_syntax', 'no_mx'), '')} balanced from (select *, ['valid', 'invalid', 'tempfail', 'not_tested'][ranked_id % 4 + 1] st from ({offline}))"),
        "typo_suggestions": (typo_suggestions, f"select institution_id, dom, arg_min(c, (levenshtein(dom, c), list_position({_in(COMMON_DOMAINS)}, c))) suggestion from {typo}, (select unnest({_in(COMMON_DOMAINS)}) c) group by all having min(levenshtein(dom, c)) = 1"),
        "role_holders": (role_holders, f"select contact_id, array_to_string({ordered}, '|') terms, {_has('hy', _P.senior_role_terms)} or ({_has('hy', _P.international_leadership_terms)} and {_has('hy', _P.relevant_office_role_terms + _P.role_signal_terms + _P.international_markers + _P.relevant_mailbox_terms)}) signal from {holders}"),
        "best_evidence": (best_evidence, f"select institution_id, mail, id ranked_id, case when {person_sql('nm')} then 0.85 else 0.0 end::double name_confidence, (sc / 8.0)::double strength, case when c = 'high' then 0.9 else 0.7 end::double email_confidence from (select institution_id, mail, arg_max(ranked_id, (sc, (coalesce(c, '') = 'high')::int, -ranked_id)) id, coalesce(arg_max_null(\"name\", (sc, (coalesce(c, '') = 'high')::int, -ranked_id)), '') nm, max(sc) sc, arg_max_null(c, (sc, (coalesce(c, '') = 'high')::int, -ranked_id)) c from (select *, case c when 'high' then 8 when 'medium' then 5 else 2 end sc from (select ranked_id, institution_id, \"name\", lower(trim(confidence, ' ')) c, {_E} mail from ranked_contacts) where mail <> '') group by 1, 2)"),
        "next_actions": (next_actions, f"select contact_id, case when not ready and tried = 0 then 'search_governance_pages' when not ready and tried = 1 and nt > 0 then 'search_international_pages' when not ready then 'search_web_for_person' when tried = 0 then 'search_people_pages' when tried = 1 then 'query_directory_by_name' else 'infer_email_pattern' end \"action\", case when ready then 'resolve_email' else 'resolve_person_from_role' end goal from (select contact_id, {person_sql(n)} ready, contact_id % 3 tried, len(list_filter({listed}, lambda t: contains(lower({flat('coalesce(role, chr(32))')}), t))) + (length({flat('coalesce(role, chr(32))')}) >= 3)::int nt from contacts where coalesce(trim(email, ' '), '') = '')"),
    }


def email_name_match(spark: SparkSession, d: str) -> DataFrame:
    e = emails.normalized(F.col("email"))
    return _contacts(spark, d).select("contact_id", emails.matches_name(e, F.col("name")).alias("matches"))


QUERIES = _queries()
