"""URL functions by regular expression: unlike parse_url they neither fail nor give NULL for odd addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zones under which names are given out on the third level; extensions of files that are no pages.
_SECOND_LEVEL = ["ac", "co", "gov", "org", "edu"]
ASSETS = r"(?i)\.(?:pdf|jpe?g|png|gif|svg|webp|ico|css|js|zip|gz|docx?|xlsx?|pptx?|mp[34]|avi|mov|woff2?)(?:$|[?#])"


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def host(url: Column) -> Column:
    """Host without port and without www."""
    return F.regexp_replace(F.regexp_replace(netloc(url), ":[0-9]+$", ""), r"^www\.", "")


def normalized(url: Column) -> Column:
    """Scheme and host in lower case, default port and fragment gone, empty path as /; unreadable ones as they are."""
    loc = F.regexp_replace(F.regexp_replace(netloc(url), "^(.*):80$", F.when(scheme(url) == "http", F.lit("$1")).otherwise(F.lit("$0"))), "^(.*):443$", F.when(scheme(url) == "https", F.lit("$1")).otherwise(F.lit("$0")))
    rest = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    tail = F.when(query(url) == "", F.lit("")).otherwise(F.concat(F.lit("?"), query(url)))
    return F.when(netloc(url) == "", url).otherwise(F.concat(F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url)), F.lit("://"), loc, rest, tail))


def site_root(host_col: Column) -> Column:
    """Registrable part of a host: three labels under second-level zones such as ac.uk, else two."""
    parts = F.split(host_col, r"\.")
    deep = (F.size(parts) > 2) & (F.length(F.get(parts, F.size(parts) - 1)) == 2) & F.get(parts, F.size(parts) - 2).isin(_SECOND_LEVEL)
    keep = F.when(deep, 3).otherwise(2)
    return F.when(F.size(parts) <= 2, host_col).otherwise(F.array_join(F.slice(parts, -keep, keep), "."))


def same_site(url: Column, base: Column) -> Column:
    return scheme(url).isin("http", "https") & (site_root(host(url)) == site_root(host(base)))


def is_asset(url: Column) -> Column:
    return url.rlike(ASSETS)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def registrable(host_col: Column) -> Column:
    """Registrable part by length: three labels if the last has two letters and the one before at most three, else two."""
    parts = F.filter(F.split(F.lower(host_col), r"\."), lambda x: x != "")
    last, before = F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")), F.coalesce(F.get(parts, F.size(parts) - 2), F.lit(""))
    deep = (F.size(parts) > 2) & (F.length(last) == 2) & (F.length(before) <= 3)
    return F.array_join(F.when(F.size(parts) <= 2, parts).when(deep, F.slice(parts, -3, 3)).otherwise(F.slice(parts, -2, 2)), ".")


def domain_relationship(home: Column, other: Column) -> Column:
    """How a domain relates to the home domain: primary, subsite (same registrable part), partner, or secondary if there is none."""
    return F.when(other == "", "secondary").when(other == home, "primary").when((home != "") & (registrable(home) == registrable(other)), "subsite").otherwise("partner")


def domain_trust(relationship: Column) -> Column:
    return F.when(relationship == "primary", 100).when(relationship == "subsite", 80).when(relationship == "partner", 30).otherwise(50)


def domain_match(mail_domain: Column, home: Column) -> Column:
    """Whether an e-mail domain is that of a home: equal, below it or above it; or equal but for the zone under ac.uk."""
    ed, hd = F.lower(mail_domain), F.lower(home)
    e, h = F.split(ed, r"\."), F.split(hd, r"\.")
    cut = F.when(F.endswith(hd, F.lit(".ac.uk")), 2).otherwise(1)
    root = lambda x: F.when(F.size(x) > cut, F.array_join(F.slice(x, F.lit(1), F.greatest(F.size(x) - cut, F.lit(0))), ".")).otherwise("")
    near = (ed == hd) | F.endswith(ed, F.concat(F.lit("."), hd)) | F.endswith(hd, F.concat(F.lit("."), ed))
    return near | ((F.get(e, F.size(e) - 1) == F.get(h, F.size(h) - 1)) & (root(e) != "") & (root(e) == root(h)))


def tokens(url: Column) -> Column:
    """Words of a path."""
    return F.filter(F.split(F.lower(path(url)), "[^a-z0-9]+"), lambda x: x != "")


def subdomain(url: Column) -> Column:
    """Labels of the host in front of its registrable part."""
    return F.regexp_replace(F.left(host(url), F.greatest(F.length(host(url)) - F.length(site_root(host(url))), F.lit(0))), r"\.$", "")


def extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1))


def path_token(segment: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.btrim(segment)), "[^a-z0-9-]+", "-"), F.lit("-"))


def path_tokens(url: Column) -> Column:
    return F.filter(F.transform(segments(url), path_token), lambda x: x != "")


# First path segments that stand for a language, that say nothing of a branch, or head several branches.
LANGUAGES = ("en", "it", "fr", "de", "es", "pt", "nl")
_GENERIC_BRANCH = ("page", "node", "details", "index", "home", "default", "view", "content")
_BRANCH_ROOTS = ("offices", "services")
_TWO_PART = ("about", "leadership", "office", "services", "service", "contacts", "contact")


def language_prefix(url: Column) -> Column:
    head = F.coalesce(F.get(path_tokens(url), F.lit(0)), F.lit(""))
    return F.when(head.isin(list(LANGUAGES)), head).otherwise("")


def plain_segments(url: Column) -> Column:
    """Segments as words joined by hyphens, without file extensions."""
    one = lambda x: F.array_join(F.regexp_extract_all(F.regexp_replace(F.lower(F.btrim(x)), r"\.(?:html?|php|aspx?)$", ""), F.lit("[a-z0-9]+"), F.lit(0)), "-")
    return F.filter(F.transform(segments(url), one), lambda x: x != "")


def family_signature(url: Column) -> Column:
    """Host and the last telling segment, with the one before it if the last is a common word."""
    kept = F.filter(plain_segments(url), lambda x: ~x.isin(list(LANGUAGES)) & ~x.isin("index", "home"))
    last, before = F.get(kept, F.size(kept) - 1), F.get(kept, F.size(kept) - 2)
    key = F.when(F.size(kept) == 0, "root").when(last.isin(list(_TWO_PART)) & (F.size(kept) >= 2), F.concat(before, F.lit("::"), last)).otherwise(last)
    return F.concat(netloc(url), F.lit(":"), key)


def branch(*addresses: Column) -> Column:
    """The first telling segment of the first address that has one; two for branches under a common root."""
    out = None
    for url in addresses:
        kept = F.filter(plain_segments(url), lambda x: ~x.isin(list(LANGUAGES)) & ~x.isin(list(_GENERIC_BRANCH)))
        head = F.get(kept, F.lit(0))
        key = F.when(head.isin(list(_BRANCH_ROOTS)) & (F.size(kept) >= 2), F.concat(head, F.lit("/"), F.get(kept, F.lit(1)))).otherwise(head)
        out = key if out is None else F.coalesce(out, key)
    return F.coalesce(out, F.lit(""))


def shell_context(strategy: Column, stage: Column, parent: Column, home: Column) -> Column:
    """What candidates of one origin share: strategy, stage and parent page (the home page without one)."""
    clean = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    above = F.coalesce(F.nullif(F.btrim(F.coalesce(parent, F.lit(""))), F.lit("")), F.btrim(F.coalesce(home, F.lit(""))))
    return F.when((clean(strategy) == "") & (clean(stage) == "") & (above == ""), "").otherwise(F.concat_ws("|", clean(strategy), clean(stage), above))


def branch_key(url: Column, words: int = 2) -> Column:
    """Host and the first path segments, e.g. to judge a branch of a site at once."""
    return F.concat_ws(":", host(url), F.array_join(F.slice(F.transform(segments(url), lambda s: F.btrim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), F.lit("-"))), 1, words), "/"))


def home_variants(url: Column) -> Column:
    """Addresses a home page may answer under, each once with its reason, in the order they are tried.

    The address itself; https; the root of the site; without or with www.; without a language label.
    """
    u, loc = without_fragment(url), netloc(url)
    labels = F.split(loc, r"\.")
    rest = F.array_join(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), ".")
    sch = F.when(scheme(u) == "", "https").otherwise(scheme(u))
    has_path, head = ~path(u).isin("", "/"), F.get(labels, F.lit(0))
    tail = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    one = lambda test, address, reason: F.when(test, F.struct(address.alias("url"), F.lit(reason).alias("reason")))
    at = lambda scheme_col, host_col: F.concat(scheme_col, F.lit("://"), host_col, F.lit("/"))
    https = F.lit("https")
    made = F.array_compact(F.array(
        one(F.lit(True), u, "original"), one(sch != "https", F.concat(F.lit("https://"), tail), "upgrade_https"),
        one(has_path, at(sch, loc), "strip_path_to_root"), one(has_path, at(https, loc), "upgrade_https_strip_path"),
        one(head == "www", at(sch, rest), "drop_www_root"), one(head == "www", at(https, rest), "drop_www_https_root"),
        one(head != "www", at(sch, F.concat(F.lit("www."), loc)), "add_www_root"), one(head != "www", at(https, F.concat(F.lit("www."), loc)), "add_www_https_root"),
        one(head.isin(list(LANGUAGES)) & (rest != ""), at(sch, rest), "drop_language_root"), one(head.isin(list(LANGUAGES)) & (rest != ""), at(https, rest), "drop_language_https_root")))
    return F.filter(made, lambda x, i: F.array_position(F.transform(made, lambda y: y["url"]), x["url"]) == i + 1)
