"""Names and roles on text lines, Column to Column: token tests, the best name in a noisy line, roles, context.

Everything is built of higher-order functions, so it runs in the JVM; term lists come from a ``Pack``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterloom.functions import emails
from rosterloom.functions.packs import BOILERPLATE, DEFAULT, INTERNATIONAL_HINTS, ROLE_WORDS, SENIORITY, Pack
from rosterloom.functions.text import collapse_blanks, contains_any, word_tokens

_ROLE = f"(?i)(?:{ROLE_WORDS})"
_RANK = f"(?i)(?:{SENIORITY})"
_HINTS = f"(?i)(?:{INTERNATIONAL_HINTS})"
# whole words in any script: the borders of \b are those of ASCII words in some versions of Java
_LABELS = r"(?i)(?<![\p{L}\p{N}_])(?:e-?mail|mail|tel|telephone|phone|fax|contact|contacts|responsabile|role|title|name)(?![\p{L}\p{N}_])[:\-]?"
_CHANNELS = r"(?i)(?<![\p{L}\p{N}_])(?:e-?mail|mail|tel|telephone|phone|fax)(?![\p{L}\p{N}_])[:\-]?"
#: Tokens of a name at most, and of the windows that are tried.
_WINDOW = (2, 3, 4)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _list(terms: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")


def lower_tokens(col: Column) -> Column:
    return F.transform(word_tokens(col), F.lower)


def bare_token(token: Column) -> Column:
    return F.lower(F.btrim(token, F.lit(".,")))


def title_like(token: Column, capitals: bool) -> Column:
    """A token with a first capital. Of longer ones the rest has a small letter, or, with ``capitals``, is all capitals.

    Letters of scripts without case count as title-like; a token without letters does not.
    """
    letters = F.regexp_replace(token, r"[^\p{L}]", "")
    rest = F.substring(letters, 2, 1_000_000)
    tail = (rest == "") | rest.rlike(r"\p{Ll}")
    tail = tail | rest.rlike(r"^\p{Lu}+$") if capitals else tail
    return (letters != "") & (~letters.rlike(r"[\p{Lu}\p{Ll}]") | (letters.rlike(r"^\p{Lu}") & tail))


def visible(tokens: Column, pack: Pack = DEFAULT) -> Column:
    """Tokens that are no particles."""
    return F.filter(tokens, lambda t: ~F.array_contains(_list(pack.name_particles), bare_token(t)))


def names_role(text: Column) -> Column:
    return text.rlike(_ROLE) | text.rlike(_RANK)


def valid_window(tokens: Column, pack: Pack = DEFAULT) -> Column:
    """Whether a run of tokens can be a name: two title-like ones at least, no stop word, no word of a role or rank."""
    shown = visible(tokens, pack)
    fine = F.forall(shown, lambda t: ~F.array_contains(_list(pack.name_stopwords), bare_token(t)) & title_like(F.btrim(t, F.lit(".,")), True))
    return (F.size(shown) >= 2) & fine & ~names_role(F.array_join(tokens, " "))


def address_like(text: Column, pack: Pack = DEFAULT) -> Column:
    low = F.lower(text)
    return contains_any(low, list(pack.boilerplate_name_fragments)) | F.arrays_overlap(lower_tokens(text), _list(pack.address_terms)) | low.rlike(r"\b\d{1,5}\b") | (F.contains(text, F.lit(",")) & contains_any(low, list(pack.address_terms)))


def office_label(text: Column, pack: Pack = DEFAULT) -> Column:
    tokens = lower_tokens(text)
    return contains_any(F.lower(text), list(pack.boilerplate_name_fragments)) | (F.size(tokens) == 0) | F.arrays_overlap(tokens, _list(pack.office_name_terms)) | names_role(text)


def no_name(text: Column, pack: Pack = DEFAULT) -> Column:
    return address_like(text, pack) | office_label(text, pack)


def fixed_case(name: Column) -> Column:
    """Tokens of capitals only with one capital."""
    one = lambda t: F.when((F.length(t) > 1) & (t == F.upper(t)) & (t != F.lower(t)), F.initcap(t)).otherwise(t)
    return F.array_join(F.transform(F.split(name, " "), one), " ")


def clean_name(col: Column, pack: Pack = DEFAULT) -> Column:
    """The best name in a noisy line, '' if it has none or is a label, an address or an office.

    All runs of two to four tokens are tried: ten points for every token that is no particle, 4 more for a run of two and
    2 more for one of three; then the earliest.
    """
    def of_tokens(tokens: Column) -> Column:
        def run(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.struct(F.slice(tokens, i, n).alias("w"), F.lit({2: 4, 3: 2}.get(n, 0)).alias("extra"), (-i).alias("at")))

        empty = F.expr("cast(array() as array<struct<w: array<string>, extra: int, at: int>>)")
        every = F.concat(*[F.when(F.size(tokens) >= n, run(n)).otherwise(empty) for n in _WINDOW])
        good = F.filter(every, lambda r: valid_window(r["w"], pack))
        best = F.array_max(F.transform(good, lambda r: F.struct((F.size(visible(r["w"], pack)) * 10 + r["extra"]).alias("score"), r["at"].alias("at"), F.array_join(r["w"], " ").alias("name"))))
        return _let(fixed_case(F.coalesce(best["name"], F.lit(""))), lambda name: F.when((name == "") | no_name(name, pack), "").otherwise(name))

    def of_text(text: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, emails.EMAIL, " "), r"[_|/]+", " "), _LABELS, " ")
        return F.when((text == "") | no_name(text, pack), "").otherwise(_let(word_tokens(plain), of_tokens))

    return _let(collapse_blanks(F.coalesce(col, F.lit(""))), of_text)


def suspicious_name(name: Column, pack: Pack = DEFAULT) -> Column:
    low = F.lower(F.btrim(F.coalesce(name, F.lit(""))))
    return contains_any(low, list(pack.suspicious_name_phrases)) | F.arrays_overlap(lower_tokens(low), _list(pack.suspicious_name_terms))


def person_name(name: Column, pack: Pack = DEFAULT) -> Column:
    """Whether a text looks like a person's name."""
    text = F.coalesce(name, F.lit(""))
    shown = visible(word_tokens(F.btrim(text)), pack)
    alike = F.size(F.filter(shown, lambda t: title_like(F.btrim(t, F.lit(".,")), False)))
    return (text != "") & ~suspicious_name(text, pack) & ~text.rlike(r"\p{Nd}") & (F.length(text) <= 80) & (F.size(shown) >= 2) & (alike >= 2) & ~names_role(text)


def matchable(name: Column, pack: Pack = DEFAULT, titles: bool = False) -> Column:
    """Lower-case tokens without particles (and titles), if two are left; else all."""
    tokens = lower_tokens(F.coalesce(name, F.lit("")))
    left = pack.name_particles + (pack.person_name_titles if titles else ())
    kept = F.filter(tokens, lambda t: ~F.array_contains(_list(left), t))
    return F.when(F.size(kept) >= 2, kept).otherwise(tokens)


def enrichable(name: Column, pack: Pack = DEFAULT) -> Column:
    """Whether a name is worth looking an address up for."""
    low = F.lower(collapse_blanks(F.coalesce(name, F.lit(""))))
    tokens = matchable(name, pack, titles=True)
    return (low != "") & ~contains_any(low, list(pack.enrichment_block_phrases)) & F.size(tokens).between(2, 5) & ~F.arrays_overlap(tokens, _list(pack.enrichment_block_terms))


def mentions_name(text: Column, name: Column, pack: Pack = DEFAULT) -> Column:
    """Whether a page text holds the name, or all of its tokens but one (two at least)."""
    low, tokens = F.lower(text), matchable(name, pack, titles=True)
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return (F.size(tokens) > 0) & (F.contains(low, F.array_join(tokens, " ")) | (hits >= F.greatest(F.lit(2), F.size(tokens) - 1)))


def mentions_role(text: Column, role: Column) -> Column:
    """Whether a page text holds one of the first four longer words of a role."""
    low = F.lower(text)
    tokens = F.slice(F.filter(lower_tokens(F.coalesce(role, F.lit(""))), lambda t: F.length(t) > 3), 1, 4)
    return F.exists(tokens, lambda t: F.contains(low, t))


def strong_role(text: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """Whether a line speaks of a role."""
    low = F.lower(text)
    intl = contains_any(low, list(pack.international_markers))
    found = contains_any(low, [k.lower() for k in keywords]) | names_role(text) | text.rlike(_HINTS)
    found = found | contains_any(low, list(pack.role_signal_terms + pack.office_role_terms + pack.relevant_office_role_terms))
    return (text != "") & (found | (intl & contains_any(low, list(pack.office_markers))) | (intl & contains_any(low, list(pack.admissions_markers))))


def boilerplate(line: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """Whether a line is a menu, a notice or too long to say who someone is."""
    low, words = F.lower(line), F.size(word_tokens(line))
    hits = F.size(F.filter(_list(BOILERPLATE), lambda m: F.contains(low, m)))
    starts = low.rlike("^(?:" + "|".join(BOILERPLATE) + ")(?: |$)")
    many = F.size(F.regexp_extract_all(line, F.lit(emails.EMAIL), F.lit(0))) > 1
    cuts = ((F.length(low) - F.length(F.replace(low, F.lit("|"), F.lit("")))) >= 2) | ((F.length(low) - F.length(F.replace(low, F.lit(" > "), F.lit("")))) >= 6)
    odd = starts | ((hits >= 1) & (words <= 4) & (F.length(line) <= 40)) | (hits >= 2) | (words >= 28) | (F.length(line) >= 220) | ((words >= 18) & (F.length(line) >= 120)) | many | cuts
    return (line == "") | (~strong_role(line, keywords, pack) & odd)


def role_score(line: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """How much a line looks like a role."""
    low = F.lower(line)
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(contains_any(low, [k.lower() for k in keywords]), 5) + points(line.rlike(_ROLE), 4) + points(line.rlike(_RANK), 2) + points(line.rlike(_HINTS), 4)
    score = score + points(contains_any(low, list(pack.role_signal_terms)), 4) + points(contains_any(low, list(pack.office_role_terms)), 1) - points(F.contains(line, F.lit("@")), 1) - points(F.length(line) > 180, 1)
    return F.when(F.length(line) < 3, -10).when(boilerplate(line, keywords, pack), -6).otherwise(score)


def clean_role(col: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """A role without addresses and labels; a listed one by its canonical name, others up to 180 characters."""
    def of_text(text: Column) -> Column:
        low = F.lower(F.substring(text, 1, 200))
        intl = contains_any(low, list(pack.international_markers))
        out = F.when((text == "") | boilerplate(text, keywords, pack), "")
        for role, terms in pack.role_aliases:
            out = out.when(contains_any(low, list(terms)), role)
        out = out.when(intl & contains_any(low, list(pack.office_markers)), "international office").when(intl & contains_any(low, list(pack.admissions_markers)), "international admissions")
        for k in keywords:
            out = out.when(F.contains(low, F.lit(k.lower())), k)
        return out.otherwise(F.substring(text, 1, 180))

    text = F.regexp_replace(F.regexp_replace(collapse_blanks(F.coalesce(col, F.lit(""))), emails.EMAIL, " "), _CHANNELS, " ")
    return _let(collapse_blanks(F.regexp_replace(text, r"\s*[:|]\s*", " ")), of_text)


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), collapse_blanks), lambda x: x != "")


def useful_lines(lines: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """Each line once, without boilerplate."""
    return F.filter(F.array_distinct(lines), lambda x: ~boilerplate(x, keywords, pack))


def clean_context(col: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT, max_lines: int = 6, max_chars: int = 320) -> Column:
    """Useful lines of a context, else those with an address or a role; at most so many lines and characters, cut at a blank."""
    lines = lines_of(col)
    good = useful_lines(lines, keywords, pack)
    spare = F.filter(lines, lambda x: x.rlike(emails.EMAIL) | strong_role(x, keywords, pack))
    text = F.array_join(F.slice(F.when(F.size(good) > 0, good).otherwise(spare), 1, max_lines), "\n")
    head = F.substring(text, 1, max_chars)
    cut = F.when(F.contains(head, F.lit(" ")), F.regexp_extract(head, "(?s)^(.*) [^ ]*$", 1)).otherwise(head)
    return F.when(F.length(text) > max_chars, F.rtrim(cut, F.lit(" ,;:/|-"))).otherwise(text)


def best_role(lines: Column, keywords: Sequence[str] = (), pack: Pack = DEFAULT) -> Column:
    """The clean role of the line with the greatest score, the earliest on ties; '' below 2."""
    scored = F.transform(useful_lines(lines, keywords, pack), lambda x, i: F.struct(role_score(x, keywords, pack).alias("score"), (-i).alias("at"), x.alias("line")))
    best = F.array_max(scored)
    return F.when(F.coalesce(best["score"], F.lit(0)) >= 2, clean_role(best["line"], keywords, pack)).otherwise("")


def best_name(lines: Column, email: Column | None = None, pack: Pack = DEFAULT) -> Column:
    """The best name in lines around an address: ten less its place, 2 more for two words, 1 less for four."""
    kept = F.filter(F.transform(lines, collapse_blanks), lambda x: ~boilerplate(x, (), pack))
    if email is not None:
        kept = F.transform(kept, lambda x: collapse_blanks(F.replace(x, email, F.lit(" "))))
    kept = F.filter(kept, lambda x: (x != "") & (F.size(word_tokens(x)) <= 8))
    named = F.transform(kept, lambda x, i: F.struct(i.alias("i"), clean_name(x, pack).alias("name")))
    words = lambda n: F.size(F.split(n, " "))
    scored = F.transform(F.filter(named, lambda r: r["name"] != ""), lambda r: F.struct((10 - r["i"] + F.when(words(r["name"]) == 2, 2).when(words(r["name"]) >= 4, -1).otherwise(0)).alias("score"), (-r["i"]).alias("at"), r["name"].alias("name")))
    best = F.array_max(F.filter(scored, lambda r: r["score"] >= 0))
    return F.coalesce(best["name"], F.lit(""))


def infer_name(email: Column, pack: Pack = DEFAULT) -> Column:
    """The name that a local part of two to four words spells, '' if it spells none."""
    local = F.regexp_replace(emails.local_part(F.lower(F.btrim(F.coalesce(email, F.lit(""))))), r"[+].*$", "")
    parts = F.filter(F.split(local, "[._-]+"), lambda p: p != "")
    usable = F.contains(email, F.lit("@")) & ~emails.generic_mailbox(email) & ~emails.local_part(email).rlike(r"\p{Nd}") & F.size(parts).between(2, 4) & F.forall(parts, lambda p: F.length(p) >= 2)
    fits = lambda name: F.when((name != "") & person_name(name, pack) & emails.matches_name(email, name, pack), name).otherwise("")
    return F.when(usable, _let(clean_name(F.array_join(F.transform(parts, F.initcap), " "), pack), fits)).otherwise("")


def localpart_has(email: Column, terms: Sequence[str]) -> Column:
    return contains_any(emails.local_alnum(F.coalesce(email, F.lit(""))), list(terms))


def unscoped_mailbox(email: Column, pack: Pack = DEFAULT) -> Column:
    return F.coalesce(emails.local_part(email).isin(list(pack.generic_unscoped_localparts)), F.lit(False))


def holder_haystack(role: Column, context: Column, email: Column, pack: Pack = DEFAULT) -> Column:
    """What a role holder is known by: role, context, words of the mailbox, and the mailbox terms it contains."""
    local = emails.local_part(F.lower(F.coalesce(email, F.lit(""))))
    parts = F.filter(F.array(collapse_blanks(F.coalesce(role, F.lit(""))), collapse_blanks(F.coalesce(context, F.lit(""))), F.btrim(F.regexp_replace(local, "[^a-z0-9]+", " "))), lambda p: p != "")
    boxes = F.filter(_list(pack.relevant_mailbox_terms), lambda t: F.contains(local, t))
    return F.lower(F.array_join(F.concat(parts, boxes), " "))


def holder_terms(role: Column, context: Column, email: Column, pack: Pack = DEFAULT) -> Column:
    """Terms to look a role holder up by, each once: listed terms found, words of the mailbox, the role itself."""
    hay = holder_haystack(role, context, email, pack)
    listed = F.filter(_list(pack.senior_role_terms + pack.international_leadership_terms + pack.relevant_office_role_terms + pack.role_signal_terms), lambda t: F.contains(hay, t))
    box = F.filter(F.split(emails.local_part(F.lower(F.coalesce(email, F.lit("")))), "[^a-z0-9]+"), lambda t: F.length(t) >= 4)
    own = F.filter(F.array(F.lower(collapse_blanks(F.coalesce(role, F.lit(""))))), lambda t: t != "")
    return F.filter(F.array_distinct(F.concat(listed, box, own)), lambda t: F.length(t) >= 3)


def holder_signal(role: Column, context: Column, email: Column, pack: Pack = DEFAULT) -> Column:
    """Whether a row speaks of someone who leads: a senior term, or a leading one with an international scope."""
    hay = holder_haystack(role, context, email, pack)
    senior = contains_any(hay, list(pack.senior_role_terms))
    scope = contains_any(hay, list(pack.relevant_office_role_terms + pack.role_signal_terms + pack.international_markers + pack.relevant_mailbox_terms))
    return senior | (contains_any(hay, list(pack.international_leadership_terms)) & scope)
