"""Rows from HTML pages: visible text, anchors by section, addresses with their context, embedded JSON, forms, hints.

HTML has no built-in parser in Spark, so pages pass through Arrow batches into the standard library's parser, each once
for everything that is asked of it. Filter pages before this stage: the optimizer can't move a filter below it. What the
parser finds are plain rows; names, roles and types are worked out of them by column functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.functions.emails import PARAMETERS

_HIDDEN = frozenset(("script", "style", "noscript", "template"))
_BLOCKS = frozenset("p div li td th section article dd address".split())
_BREAKS = _BLOCKS | frozenset("br tr h1 h2 h3 h4 h5 h6 header footer nav ul ol table dt main aside form".split())
_SECTIONS = frozenset(("nav", "header", "footer"))
_VOID = frozenset("br img hr input meta link area base col embed source track wbr".split())
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
#: Addresses put together in scripts: "a" + "@" + "b.org", or "a" + "@" + "b" + ".org".
_QUOTED = r"""["']([A-Za-z0-9._%+-]+)["']"""
_PLUS = r"\s*\+\s*"
_JOINED = re.compile(_QUOTED + _PLUS + r"""["']@["']""" + _PLUS + r"""["']([A-Za-z0-9.-]+)["'](?:""" + _PLUS + r"""["'](\.[A-Za-z]{2,})["'])?""")
_ASSIGNED = re.compile(r"(?:window\.)?[\w.$]+\s*=\s*(?=[{\[])")

# Attributes that hold addresses, names and roles; keys of records in embedded data; hints at contacts.
MAIL_ATTRIBUTES = ("data-email", "data-mail", "data-email-address")
NAME_ATTRIBUTES = ("data-name", "data-contact-name", "data-person-name")
ROLE_ATTRIBUTES = ("data-role", "data-title", "data-unit", "data-office")
MAIL_KEYS = ("email", "mail", "contactemail", "emailaddress", "mailaddress")
NAME_KEYS = ("name", "fullname", "displayname", "personname", "contactname")
ROLE_KEYS = ("role", "title", "position", "jobtitle", "office", "unit", "department", "team")
HINT_PARAMETERS = ("recipient", "contact", "contactid", "contact_id", "dest", "destinataire", "mail", "mailto", "email")
CARD_CLASSES = frozenset(("h-card", "vcard", "contact-card"))
#: Limits of a page's report on hints, of its embedded documents and of the text made of them (limits of the reports).
MAX_HINTS, MAX_DOCUMENTS, MAX_LINES, MAX_CHARS = 12, 16, 320, 18_000

_TEXT = T.StringType()


def _struct(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _TEXT) for n in names])


ANCHOR, FOUND, FORM, HINT, ALTERNATE = _struct("url", "text", "section", "rel", "css"), _struct("email", "strategy", "name", "role", "context"), _struct("method", "action", "fields", "text"), _struct("pattern", "detail"), _struct("lang", "href")
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("text", _TEXT), T.StructField("title", _TEXT), T.StructField("headings", T.ArrayType(_TEXT)), T.StructField("embedded", _TEXT), T.StructField("documents", T.IntegerType())] + [
    T.StructField(n, T.ArrayType(t)) for n, t in (("anchors", ANCHOR), ("found", FOUND), ("forms", FORM), ("hints", HINT), ("alternates", ALTERNATE))
])


def _flat(text: str) -> str:
    return " ".join(text.split())


def address(value: str) -> str:
    """A decoded address without mailto:, query and surrounding punctuation, '' if it is none."""
    bare = re.sub(r"(?i)^mailto:", "", unquote(value or "").strip()).partition("?")[0].strip(" .,;:()[]<>\"'")
    return bare.lower() if _MAIL.fullmatch(bare) else ""


def link_addresses(target: str) -> list[str]:
    """Addresses of a link target or handler: itself, after mailto:, in named parameters, anywhere."""
    raw = unquote(target or "").strip()
    found = [address(raw), *(address(m) for m in re.findall(r"(?i)mailto:([^\"'\s>]+)", raw))]
    for key, value in _parameters(raw):
        if any(p in key for p in PARAMETERS):
            found.append(address(value) or next(iter(_MAIL.findall(value)), "").lower())
    return [x for x in dict.fromkeys(found + [m.lower() for m in _MAIL.findall(raw)]) if x]


def _parameters(target: str) -> list[tuple[str, str]]:
    try:
        return [(k.strip().lower(), v) for k, v in parse_qsl(urlsplit(target).query, keep_blank_values=True)]
    except ValueError:
        return []


class _Reader(HTMLParser):
    """Collects text pieces; blocks are ranges of pieces, and whatever is found remembers the blocks it stands in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.blocks: list[list] = []  # tag, first piece, one past the last piece
        self.open: list[int] = []
        self.sections: list[str] = []
        self.hidden: list[str] = []
        self.anchors: list[dict] = []
        self.inside: dict | None = None
        self.tagged: list[tuple[dict, list[int], int]] = []  # attributes of elements that may hold an address
        self.scripts: list[list[str]] = []
        self.forms: list[dict] = []
        self.form: dict | None = None
        self.alternates: list[tuple[str, str]] = []
        self.headings: list[str] = []
        self.heading: list[str] | None = None
        self.title: list[str] = []
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = {k.lower(): (v or "") for k, v in attrs}
        if tag in _HIDDEN:
            self.hidden.append(tag)
            if tag == "script":
                self.scripts.append([given.get("type", "").lower(), ""])
            return
        if tag in _SECTIONS:
            self.sections.append(tag)
        if tag in _BREAKS:
            self.pieces.append("\n")
        if tag in _BLOCKS:
            self.blocks.append([tag, len(self.pieces), None])
            self.open.append(len(self.blocks) - 1)
        if tag == "a" and "href" in given:
            self.inside = {"url": given["href"], "text": "", "section": self.sections[-1] if self.sections else "body", "rel": given.get("rel", ""), "css": given.get("class", "")}
            self.anchors.append(self.inside)
        if tag == "link" and "alternate" in given.get("rel", "") and given.get("hreflang"):
            self.alternates.append((given["hreflang"].strip().lower(), given.get("href", "").strip()))
        if tag == "form":
            self.form = {"method": (given.get("method") or "get").lower(), "action": given.get("action", ""), "fields": [], "text": [given.get(k, "") for k in ("id", "name", "role", "aria-label")]}
            self.forms.append(self.form)
        if self.form is not None and tag in ("input", "select", "textarea"):
            self.form["fields"].append(given.get("name") or given.get("id", ""))
            self.form["text"] += [given.get(k, "") for k in ("name", "placeholder", "aria-label")]
        if tag in ("h1", "h2"):
            self.heading = []
        self.in_title = self.in_title or tag == "title"
        if given and (tag == "a" or "onclick" in given or "action" in given or "itemtype" in given or "class" in given or any(k.startswith("data-") for k in given)):
            self.tagged.append((given, list(self.open), len(self.anchors) if tag == "a" else 0))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        if tag in _SECTIONS and tag in self.sections:
            self.sections.remove(tag)
        if tag in _BLOCKS:
            at = next((k for k in range(len(self.open) - 1, -1, -1) if self.blocks[self.open[k]][0] == tag), None)
            if at is not None:
                for k in self.open[at:]:
                    self.blocks[k][2] = len(self.pieces)
                del self.open[at:]
        if tag == "a":
            self.inside = None
        if tag == "form":
            self.form = None
        if tag in ("h1", "h2") and self.heading is not None:
            self.headings.append(_flat("".join(self.heading)))
            self.heading = None
        if tag == "title":
            self.in_title = False
        if tag in _BREAKS:
            self.pieces.append("\n")

    def handle_data(self, data: str) -> None:
        if self.hidden:
            if self.hidden[-1] == "script" and self.scripts:
                self.scripts[-1][1] += data
            return
        if self.in_title:
            self.title.append(data)
        self.pieces.append(data)
        for target in (self.inside, self.form):
            if target is not None:
                if target is self.form:
                    target["text"].append(data)
                else:
                    target["text"] += data
        if self.heading is not None:
            self.heading.append(data)

    def text_of(self, first: int = 0, last: int | None = None) -> str:
        lines = (_flat(x) for x in "".join(self.pieces[first:last]).split("\n"))
        return "\n".join(x for x in lines if x)

    def context(self, inside: list[int]) -> str:
        """The text of the innermost block of 40 to 1,200 characters, else of the innermost that has any."""
        spare = ""
        for k in reversed(inside):
            text = self.text_of(self.blocks[k][1], self.blocks[k][2])
            spare = spare or text
            if 40 <= len(text) <= 1200:
                return text
        return spare


def _balanced(text: str, start: int) -> str:
    """The JSON value that begins at ``start``, up to its closing bracket; '' if it doesn't close."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[start : i + 1]
        i += 1
    return ""


def documents(scripts: list[list[str]]) -> list[object]:
    """Values of scripts that are JSON by type, or that assign JSON to a variable."""
    out: list[object] = []
    for kind, body in scripts:
        sources = [body] if "json" in kind else [_balanced(body, m.end()) for m in _ASSIGNED.finditer(body)]
        for source in sources:
            try:
                out.append(json.loads(source))
            except ValueError:
                continue
            if len(out) == MAX_DOCUMENTS:
                return out
    return out


def walk(roots: list[object]) -> Iterator[dict]:
    """Every object in JSON values, however deep, in document order. A stack of its own sets no limit to the depth."""
    stack = list(reversed(roots))
    while stack:
        node = stack.pop()
        if isinstance(node, dict):
            yield node
            stack += reversed([v for v in node.values() if isinstance(v, (dict, list))])
        elif isinstance(node, list):
            stack += reversed(node)


def _scalar(record: dict, terms: tuple[str, ...]) -> str:
    """The first value that is text or a number under a key that, without punctuation, holds a term."""
    for key, value in record.items():
        if isinstance(value, (str, int, float)) and not isinstance(value, bool) and any(t in re.sub("[^a-z0-9]+", "", str(key).lower()) for t in terms):
            text = _flat(str(value))
            if text:
                return text
    return ""


def _embedded(roots: list[object]) -> tuple[list[tuple], str]:
    """(addresses with name and role, lines of text) of embedded documents."""
    found, lines = [], []
    for record in walk(roots):
        mail = _scalar(record, MAIL_KEYS)
        mails = [address(mail)] if address(mail) else [m.lower() for m in _MAIL.findall(mail)]
        role = _scalar(record, ROLE_KEYS)
        found += [(m, "embedded_json", _scalar(record, NAME_KEYS), role, "") for m in mails]
        lines += [_flat(v) for v in record.values() if isinstance(v, str) and _flat(v) and not v.startswith(("http:", "https:", "/"))]
    return found, "\n".join(dict.fromkeys(lines[:MAX_LINES]))[:MAX_CHARS]


def _hints(reader: _Reader) -> list[tuple[str, str]]:
    """Signs of contacts that give no address: handlers, parameters, attributes, forms, cards; each once, 12 at most."""
    found = []
    for given, _, _ in reader.tagged:
        href, onclick = given.get("href", ""), given.get("onclick", "")
        known = link_addresses(href) + link_addresses(onclick)
        telling = lambda x: any(w in x.lower() for w in ("mail", "contact", "recipient"))
        if href.lower().startswith("javascript:") and not known and telling(href):
            found.append(("javascript_contact_anchor", href))
        if onclick and not known and telling(onclick):
            found.append(("onclick_contact_handler", onclick))
        for source, pattern in ((href, "contact_param_link"), (onclick, "contact_param_link"), (given.get("action", ""), "contact_form_param")):
            found += [(pattern, f"{k}={unquote(v).strip()}") for k, v in _parameters(source) if k in HINT_PARAMETERS and not address(v)]
        found += [("data_attribute_contact_hint", f"{k}={v}") for k, v in given.items() if k.startswith("data-") and k not in MAIL_ATTRIBUTES and any(w in k for w in ("mail", "recipient", "contact")) and not address(v)]
        kind = given.get("itemtype", "")
        if CARD_CLASSES & set(given.get("class", "").split()) or "schema.org/Person" in kind or "schema.org/Organization" in kind:
            found.append(("structured_contact_markup", kind or "structured contact markup"))
    return list(dict.fromkeys((p, _flat(x)[:220]) for p, x in found))[:MAX_HINTS]


def read(html: str | None) -> dict:
    """Everything of a page, by the names of ``PAGE``. Broken markup gives what could be read; NULL gives nothing."""
    reader = _Reader()
    if html:
        reader.feed(html)
        reader.close()
    text = reader.text_of()
    roots = documents(reader.scripts)
    embedded_rows, embedded = _embedded(roots)
    found: list[tuple] = []
    for given, inside, number in reader.tagged:
        name = _flat(reader.anchors[number - 1]["text"]) if number else ""
        mails = dict.fromkeys(link_addresses(given.get("href", "") if number else "") + link_addresses(given.get("onclick", "")))
        found += [(m, "mailto_explicit", name, "", reader.context(inside)) for m in mails]
    for given, inside, _ in reader.tagged:
        mails = [address(given[k]) for k in MAIL_ATTRIBUTES if k in given]
        if "data-user" in given and "data-domain" in given:
            mails.append(address(f"{given['data-user']}@{given['data-domain']}"))
        first = lambda names, given=given: next((_flat(given[k]) for k in names if _flat(given.get(k, ""))), "")
        found += [(m, "html_attribute", first(NAME_ATTRIBUTES), first(ROLE_ATTRIBUTES), reader.context(inside)) for m in mails if m]
    found += embedded_rows
    for kind, body in reader.scripts:
        if "json" not in kind:
            joined = (f"{a}@{b}{c}".lower() for a, b, c in _JOINED.findall(body))
            found += [(m, "js_decode", "", "", "") for m in sorted(set(joined)) if _MAIL.fullmatch(m)]
    forms = [(f["method"], f["action"], " ".join(x for x in f["fields"] if x), _flat(" ".join(f["text"])).lower()) for f in reader.forms]
    anchors = [(a["url"], _flat(a["text"]), a["section"], a["rel"], a["css"]) for a in reader.anchors]
    return {"text": text, "title": _flat("".join(reader.title)), "headings": reader.headings[:3], "embedded": embedded, "documents": len(roots), "anchors": anchors, "found": list(dict.fromkeys(found)), "forms": forms, "hints": _hints(reader), "alternates": reader.alternates}


def parsed_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """The columns of ``PAGE`` for every page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"page_id": p, **read(h)} for p, h in zip(batch["page_id"], batch["html"])], columns=PAGE.names)

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(html_col).cast("string").alias("html")).filter("page_id is not null").mapInPandas(run, PAGE)


def _rows(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("page_id", F.posexplode(column).alias("pos", "x")).select("page_id", "pos", "x.*")


def anchors(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "anchors")


def evidence(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "found")


def hints(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "hints")


def forms(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "forms")


def alternates(parsed: DataFrame) -> DataFrame:
    return _rows(parsed, "alternates")


def absolute(base: Column, href: Column) -> Column:
    """A link target against the address of its page: absolute, of the scheme, of the site, or beside the page."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*.*/)[^/]*$", "$1")
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, "^([^:]+:)", 1), href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).otherwise(F.concat(folder, href))


def sitemap_urls(df: DataFrame, id_col: str, xml: str) -> DataFrame:
    """Addresses of a sitemap, in order."""
    return df.select(id_col, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("pos", "url"))


def robots_sitemaps(df: DataFrame, id_col: str, txt: str) -> DataFrame:
    """Sitemap lines of robots files, each address once, in order of first appearance."""
    lines = df.select(id_col, F.posexplode(F.split(txt, r"\r?\n")).alias("pos", "line"))
    found = lines.select(id_col, "pos", F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1).alias("url")).filter("url <> ''")
    return found.groupBy(id_col, "url").agg(F.min("pos").alias("pos")).select(id_col, "pos", "url")


def sitemap_walk(starts: DataFrame, maps: DataFrame, most: int = 16, levels: int = 4) -> DataFrame:
    """(site, url): addresses below the first maps of every site, maps within maps included.

    ``starts`` has (site, url), ``maps`` the landed files (url, xml). A site's maps are read level by level, each once, at
    most ``most`` of them (the walk's own limit), in the order they are named.
    """
    from pyspark.sql import Window

    from rosterloom.session import cut_lineage

    order = Window.partitionBy("site").orderBy("level", "pos", "map")
    frontier = starts.select("site", F.col("url").alias("map"), F.lit(0).alias("level"), F.lit(0).alias("pos"))
    read_maps, found = None, None
    for level in range(levels):
        fresh = frontier.groupBy("site", "map", "level").agg(F.min("pos").alias("pos"))
        if read_maps is not None:
            fresh = fresh.join(read_maps.select("site", "map"), ["site", "map"], "left_anti")
        every = fresh if read_maps is None else read_maps.unionByName(fresh)
        every = cut_lineage(every.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most).drop("k"))
        new = every.filter(F.col("level") == level)
        read_maps = every
        if new.limit(1).count() == 0:
            break
        rows = new.join(maps.select(F.col("url").alias("map"), "xml"), "map")
        urls = rows.select("site", "pos", F.posexplode(F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("at", "url"))
        urls = cut_lineage(urls)
        pages = urls.filter(~F.lower("url").rlike(r"\.xml$")).select("site", "url")
        found = pages if found is None else found.unionByName(pages)
        frontier = urls.filter(F.lower("url").rlike(r"\.xml$")).select("site", F.col("url").alias("map"), F.lit(level + 1).alias("level"), (F.col("pos") * 100_000 + F.col("at")).cast("int").alias("pos"))
    return (found if found is not None else starts.filter("false").select("site", "url")).distinct()
