"""Variant spellings of one person or office of an institution, by merge-and-rematch resolution.

Rows are reduced to forms (institution, surname spelling, given name or initial; for offices the words of the office
and its campus). Forms that share a mailbox are merged first. Then, round by round:

1. every merged record carries the union of its members' surname spellings, given names and initials;
2. it enters blocking under each spelling of its surname and each spelling with one letter left out (which brings
   together spellings one insertion, omission, change or swap apart);
3. two records of a block merge if their given names agree, or if one has only an initial and the other is the only
   record of the block that it fits; records whose mailboxes confirm different surnames don't merge;
4. only records that grew re-enter, until a round merges nothing.

Given names are those that many institutions use first in a name; two such names are different names, however close
their spelling (so "Erik" and "Erika" stay apart), unless shared mailboxes show them as forms of one name in several
institutions, or they are a listed short form. A block holds one record per given name at most, since equal forms are
one form: its size does not grow with the number of rows.

Defined results: rows without a name, without an institution, or with a garbled name have no pair; names equal in all
but case, blanks, punctuation, invisible characters and Unicode form have no pair, though their rows belong together;
repeated rows each get their pairs; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterloom.llm import charset
from rosterloom.llm.textnorm import fold, squeezed, words
from rosterloom.operators.components import components
from rosterloom.session import cut_lineage

# Titles; short forms of given names; words of offices with their abbreviations.
TITLES = frozenset("dr dra drs prof profin profssa ssa professor professorin dott dottssa dottore ing arch avv mr mrs ms miss mx mme mlle m herr frau hr fr sig sigra sra sr don dona pr pd mag dipl phd msc rer nat hc univ".split())
SHORT_FORMS = {
    "patricia": "pat patty trish tricia", "samuel": "sam sammy", "jose": "pepe", "concepcion": "concha conchita", "margaret": "peggy maggie meg marge", "francisco": "paco pancho", "dolores": "lola", "giuseppe": "beppe peppe pino",
    "william": "bill will billy", "robert": "bob rob bobby", "richard": "rick dick rich", "michael": "mike mick", "elizabeth": "liz beth betty lizzy", "elisabeth": "lisa else", "katherine": "kate kathy katie kat", "christopher": "chris kit",
    "andrew": "andy drew", "edward": "ed ted eddie", "nicholas": "nick", "thomas": "tom tommy", "gregory": "greg", "jennifer": "jen jenny", "deborah": "deb debbie", "susannah": "sue susan", "daniel": "dan danny", "alexandra": "alex sandra",
    "friedrich": "fritz", "johannes": "hans hannes", "benedikt": "ben", "theodora": "thea dora", "josefine": "josie fine", "francesca": "franca cesca", "beatriz": "bea", "guillaume": "guy", "ramon": "moncho", "joao": "joaozinho", "jurgen": "jorg",
}
OFFICE_WORDS = {
    "office": "ofc off offc ofice offce offices", "service": "svc svcs serv services srv", "unit": "units", "centre": "center ctr cntr", "desk": "", "board": "bord brd", "secretariat": "sec secr sekretariat secretary", "school": "schol sch",
    "international": "intl int internat internatl", "relation": "rel rels relns relations", "student": "stud students std", "mobility": "mobilty mob mobil", "admission": "adm admissions admisions admision", "career": "careers car",
    "housing": "hous accommodation", "language": "lang languages lng", "doctoral": "doct doc", "scholarship": "scholarships schol", "department": "dept dep", "bureau": "", "team": "", "exchange": "exch", "alumni": "alum", "study": "studies", "research": "res",
}
_OFFICE_NOUNS = frozenset(("office", "service", "unit", "centre", "desk", "board", "secretariat", "school", "department", "bureau", "team"))
_OFFICE_STOP = frozenset("of for the and in at de des la le".split())
_OFFICE_FORM = {form: base for base, forms in OFFICE_WORDS.items() for form in [base, *forms.split()]}
_SHORT = {form: base for base, forms in SHORT_FORMS.items() for form in forms.split()}

MENTION = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("inst", T.LongType()), ("seen", T.LongType()), ("form", T.StringType()), ("box", T.LongType()), ("local", T.StringType()))])
PARSED = T.StructType([T.StructField(n, T.StringType()) for n in ("form", "kind", "s", "g", "i")])


@lru_cache(maxsize=100_000)
def near(a: str, b: str) -> bool:
    """One insertion, omission, change or swap of neighbours apart, or equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (i + 1 < la and a[i] == b[i + 1] and a[i + 1] == b[i] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


def left_out(word: str) -> list[str]:
    """The word, and the word with each letter left out: words one edit or swap apart share one of these."""
    return [word, *(word[:k] + word[k + 1 :] for k in range(len(word)))]


class Near:
    """Finds the words of a list that are equal to a word or one edit or swap apart."""

    def __init__(self, known, least: int = 4):
        self.exact, self.index, self.memo = set(known), {}, {}
        for w in known:
            if len(w) >= least:
                for v in left_out(w):
                    self.index.setdefault(v, set()).add(w)

    def find(self, word: str) -> list[str]:
        if word in self.exact:
            return [word]
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            close = set().union(*(self.index.get(v, ()) for v in left_out(word))) if len(word) > 3 else ()
            self.memo[word] = sorted(w for w in close if near(word, w))
        return self.memo[word]


_OFFICE_NEAR = Near(_OFFICE_FORM, least=5)
_MAIL_JUNK = re.compile("[\\s<>,;\"'()\\[\\]\u200b-\u200f\u00ad\ufeff]+")
_MAIL = re.compile(r"[^@]+@[^@]+\.[^@]+")


def mail_key(email: str | None) -> str:
    bare = _MAIL_JUNK.sub("", (email or "").casefold()).removeprefix("mailto:").strip(".:")
    return bare if _MAIL.fullmatch(bare) else ""


def office_word(token: str) -> str | None:
    """The office word that a folded token is a form or a misspelling of."""
    if token in _OFFICE_FORM:
        return _OFFICE_FORM[token]
    close = _OFFICE_NEAR.find(token) if len(token) > 4 else ()
    return _OFFICE_FORM[close[0]] if close else None


def office(tokens: list[str]) -> tuple[str, str] | None:
    """(office words, campus) if the folded words name an office."""
    known = [office_word(t) for t in tokens]
    if not any(k in _OFFICE_NOUNS for k in known if k):
        return None
    rest = [(t, k) for t, k in zip(tokens, known) if t not in _OFFICE_STOP]
    campus, at = "", next((n for n, (t, _) in enumerate(rest) if t == "campus"), None)
    if at is not None:
        unknown = [t for t, k in rest if k is None and t != "campus"]
        campus = rest[at - 1][0] if at and rest[at - 1][1] is None else unknown[-1] if unknown else ""
        rest = [(t, k) for t, k in rest if t not in ("campus", campus)]
    names = [k or t for t, k in rest]
    if len(names) < 2 or sum(k is not None for _, k in rest) < len(rest) - 1:
        return None
    return " ".join(sorted(set(names))), campus


def person(form: str, given_names: Near) -> tuple[str, str, str]:
    """(surname, given name, initial) of folded words, a comma between surname and given name; '' where there is none."""
    head, comma, tail = form.partition(",")
    left, right = head.split(), tail.split()
    if comma and all(t in TITLES for t in right):  # "Given Surname, Prof."
        right = []
    if left and right and left[0] in given_names.exact and right[0] not in given_names.exact:  # "Given, Surname"
        left, right = right, left
    if left and right:
        full = [t for t in right if len(t) > 1 and t not in TITLES]
        family = [t for t in left if t not in TITLES]
        if full and all(len(t) == 1 for t in family):  # "P., Surname"
            return full[0], "", family[0] if family else ""
        family = [t for t in family if len(t) > 1]
        initial = next((t for t in right if len(t) == 1), "")
        return family[0] if family else "", full[0] if full else "", full[0][0] if full else initial
    tokens = left + right
    plain = [t for t in tokens if t not in TITLES or (len(tokens) < 3 and len(t) > 3)]
    full, initials = [t for t in plain if len(t) > 1], [t for t in tokens if len(t) == 1]
    if not full:
        return "", "", ""
    at = next((k for k, t in enumerate(full) if t in given_names.exact), None)
    if at is None:
        at = next((k for k, t in enumerate(full) if t in _SHORT), None)
    if at is None and len(full) > 1:
        at = next((k for k, t in enumerate(full) if given_names.find(t)), None)
    if at is None:
        if initials and (len(full) == 1 or len(tokens[0]) == 1 or len(tokens[-1]) == 1):
            return full[0], "", initials[0]
        at = 0 if len(full) > 1 else None
    rest = [] if at is None else full[:at] + full[at + 1 :]
    if not rest:
        return full[0], "", initials[0] if initials else ""
    return rest[0], full[at], full[at][0]


def canonical_given(given: str, given_names: Near) -> str:
    """The established name that a given name is a spelling or a short form of; itself if there is none or more than one."""
    if given in _SHORT and (_SHORT[given] in given_names.exact or given not in given_names.exact):
        return _SHORT[given]
    close = given_names.find(given) if given else []
    return close[0] if len(close) == 1 else given


def _letters(text: str) -> str:
    return re.sub(r"[^a-z]", "", fold(text))


_OTHER = re.compile("[^a-z0-9]+")


def folded_form(name: str) -> str:
    """Folded words of a name with its first comma kept, where there is something on both sides."""
    if "," not in name:
        if name.isascii():
            return " ".join(_OTHER.sub(" ", name.lower().replace("'", "").replace("`", "")).split())
        return " ".join(fold(w) if len(w) > 1 else fold(w)[:1] for w in words(name.replace(".", " ")))  # an initial stays one letter
    head, _, tail = name.partition(",")
    left, right = folded_form(head), folded_form(tail.replace(",", " "))
    return f"{left},{right}" if left and right else left or right


def spelling(name: str) -> str:
    """A name without case, white space, punctuation, invisible characters and Unicode form; order counts."""
    return _OTHER.sub("", name.lower()) if name.isascii() else squeezed(name)


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\n".join(parts)) - (1 << 63)


def _mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, tuple | None] = {}
    boxes: dict[str | None, tuple[str, str]] = {}
    for batch in batches:
        for known in (memo, boxes):
            if len(known) > 200_000:
                known.clear()
        rows = []
        insts = {inst: _hash(inst) for inst in batch["inst"].unique()}
        for rec, inst, name, email in zip(batch["id"], batch["inst"], batch["name"], batch["email"]):
            if name not in memo:
                seen = "" if charset.repair(name)[0] else spelling(name)
                memo[name] = (_hash(seen), folded_form(name)) if seen else None
            form = memo[name]
            if form is None:
                continue
            box = boxes.get(email)
            if box is None:
                mail = mail_key(email)
                box = boxes[email] = (mail, _letters(mail.partition("@")[0]) if mail else "")
            rows.append((rec, insts[inst], *form, _hash(inst, box[0]) if box[0] else None, box[1]))
        cols = list(zip(*rows)) or [()] * len(MENTION.names)
        yield pd.DataFrame({n: pd.array(v, dtype="Int64") if n == "box" else v for n, v in zip(MENTION.names, cols)}, columns=MENTION.names)


def _parser(established: frozenset[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given_names = Near(established)
        for batch in batches:
            rows = []
            for form in batch["form"]:
                found = office(form.replace(",", " ").split())
                if found:
                    rows.append((form, "o", found[0], found[1], ""))
                    continue
                surname, given, initial = person(form, given_names)
                if surname:
                    g = canonical_given(given, given_names)
                    rows.append((form, "p", surname, g, "" if g else initial))
            yield pd.DataFrame(rows, columns=PARSED.names)

    return run


def established_names(forms: DataFrame, share: float = 0.01, least: int = 3) -> frozenset[str]:
    """Words that stand first in two-word names of at least ``share`` of all institutions.

    At most (words per institution) / ``share`` words can do so, whatever the number of rows: a small set.
    """
    total = forms.agg(F.approx_count_distinct("inst", 0.01)).first()[0]
    two = forms.filter(F.col("form").rlike("^[^ ,]{2,} [^ ,]{2,}$")).select("inst", F.substring_index("form", " ", 1).alias("token"))
    found = two.groupBy("token").agg(F.approx_count_distinct("inst", 0.02).alias("n")).filter(F.col("n") >= max(least, share * total))
    return frozenset(r["token"] for r in found.collect() if r["token"] not in TITLES and office_word(r["token"]) is None)


def learned_forms(forms: DataFrame, given_names: frozenset[str], least: int = 3) -> DataFrame:
    """(g, full): given names that stand for one established name on shared mailboxes of at least ``least`` institutions."""
    one = forms.filter("kind = 'p' and box is not null and length(g) > 1").select("inst", "box", "s", "g").distinct()
    known = F.col("g").isin(sorted(given_names)) if given_names else F.lit(False)
    pairs = one.filter(~known).join(one.filter(known).select("box", "s", F.col("g").alias("other")), ["box", "s"])
    counted = pairs.groupBy("g", "other").agg(F.countDistinct("inst").alias("n")).filter(F.col("n") >= least)
    return counted.groupBy("g").agg(F.min("other").alias("full"), F.max("other").alias("z")).filter("full = z").select("g", "full")


def _variants(col: str) -> str:
    return f"case when length({col}) < 5 then array({col}) else array_distinct(concat(array({col}), transform(sequence(1, length({col})), k -> concat(substring({col}, 1, k - 1), substring({col}, k + 1))))) end"


_CLOSE = """exists(a.ss, x -> exists(b.ss, y -> x = y or (length(x) > 4 and length(y) > 4 and not (size(a.sures) > 0 and size(b.sures) > 0 and not arrays_overlap(a.sures, b.sures))
  and (levenshtein(x, y) <= 1 or (length(x) = length(y) and levenshtein(x, y) = 2 and array_sort(split(x, '')) = array_sort(split(y, '')))))))"""


def _keys(records: DataFrame) -> DataFrame:
    """(label, block) of records. A block: institution, spelling with at most one letter left out, first letter of the given name."""
    one = records.select("label", "inst", "heads", "bare", F.explode("ss").alias("s")).select("label", "inst", "s", F.explode(F.array_union("heads", "bare")).alias("head"))
    return one.select("label", "inst", "head", F.explode(F.expr(_variants("s"))).alias("v")).select("label", F.xxhash64("inst", "head", "v").alias("block"))


_LISTS = ("ss", "gs", "bare", "heads", "sures")


def resolve(forms: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(node, label) of every form in a merged record; ``forms`` has node, inst, kind, s, g, i, box, sure.

    Every round but the last ones merges records, so the rounds end. The result is exact or an error: a limit of rounds
    never cuts it short.
    """
    spark = forms.sparkSession
    box = forms.filter("box is not null").select("node", F.xxhash64("kind", F.when(F.col("kind") == "o", F.col("g")).otherwise(F.lit("")), "box").alias("box")).distinct()
    shared = box.groupBy("box").agg(F.min("node").alias("b"), F.max("node").alias("z")).filter("b <> z").select("box", "b")
    labels = components(box.join(shared, "box").select(F.col("node").alias("a"), "b").filter("a <> b"))
    people = forms.filter("kind = 'p'").groupBy("node", "inst", "s", "g", "i").agg(F.max("sure").alias("sure"))
    named = people.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    record = cut_lineage(named.groupBy("label", "inst").agg(
        F.collect_set("s").alias("ss"), F.collect_set(F.nullif("g", F.lit(""))).alias("gs"), F.collect_set(F.nullif("i", F.lit(""))).alias("bare"),
        F.collect_set(F.left(F.nullif(F.col("g"), F.lit("")), F.lit(1))).alias("heads"), F.collect_set(F.when(F.col("sure"), F.col("s"))).alias("sures")))
    views = f"rl{uuid.uuid4().hex[:12]}"  # of this run alone
    keys = cut_lineage(_keys(record))
    tops = None  # where first labels have gone: (node, label)
    ask = "all"  # which records ask in a round: all, those that grew, or those with an initial only
    for done in count():
        if max_rounds is not None and done >= max_rounds:
            raise RuntimeError("resolve did not settle")
        record.createOrReplaceTempView(f"{views}_records")
        if ask == "all":
            # most blocks that hold more than one record hold two: those need no join
            sizes = keys.groupBy("block").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("n")).filter("a <> b")
            sizes = cut_lineage(sizes)
            members = keys.join(sizes.filter("n > 2").select("block"), "block", "left_semi").distinct()
            members = cut_lineage(members)
            more = members.select("block", F.col("label").alias("a")).join(members.select("block", F.col("label").alias("b")), "block").filter("a < b")
            near = sizes.filter("n = 2").select("a", "b").unionByName(more.select("a", "b")).distinct()
        else:
            asking = record.filter("size(gs) = 0") if ask == "bare" else record.join(grown, "label", "left_semi")
            # Every record that has grown, in this round or before, stands under all its spellings and initials combined
            # anew, as asked and as asking record; the keys of the others are as they were.
            asked = _keys(cut_lineage(asking))
            near = asked.join(keys.select(F.col("label").alias("other"), "block"), "block").select("label", "other")
            if tops is not None:
                rich = tops.select("label").distinct()
                stale = tops.select(F.col("node").alias("other")).unionByName(rich.select(F.col("label").alias("other"))).distinct()
                again = _keys(record.join(rich, "label", "left_semi")).select(F.col("label").alias("other"), "block")
                near = near.join(stale, "other", "left_anti").select("label", "other").unionByName(asked.join(again, "block").select("label", "other"))
            near = near.filter("label <> other").select(F.least("label", "other").alias("a"), F.greatest("label", "other").alias("b")).distinct()
        cut_lineage(near).createOrReplaceTempView(f"{views}_near")
        pairs = cut_lineage(spark.sql(f"""
          select a.label a, b.label b, arrays_overlap(a.gs, b.gs) or (size(a.gs) = 0 and size(b.gs) = 0) same, size(a.gs) = 0 a_bare from {views}_near n join {views}_records a on n.a = a.label join {views}_records b on n.b = b.label
          where (arrays_overlap(a.gs, b.gs) or (size(a.gs) = 0 and arrays_overlap(a.bare, array_union(b.heads, b.bare))) or (size(b.gs) = 0 and arrays_overlap(b.bare, array_union(a.heads, a.bare)))) and {_CLOSE}"""))
        fresh = pairs.filter("same").select("a", "b")
        if ask == "bare":
            # an initial fits a record only if it fits no other record; asked when the full names have settled
            lone = pairs.filter("not same").select(F.when(F.col("a_bare"), F.col("a")).otherwise(F.col("b")).alias("x"), F.when(F.col("a_bare"), F.col("b")).otherwise(F.col("a")).alias("y"))
            fits = lone.groupBy("x").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select(F.col("x").alias("a"), F.col("y").alias("b"))
            fresh = fresh.unionByName(fits)
        if fresh.limit(1).count() == 0:
            if ask == "bare":
                break
            ask = "bare"
            continue
        merged = components(fresh)
        grown, ask = merged.select("label").distinct(), "grown"
        moved = merged.filter("node <> label")
        united = record.join(merged.select(F.col("node").alias("label"), F.col("label").alias("top")), "label").groupBy(F.col("top").alias("label"), "inst").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in _LISTS])
        record = cut_lineage(record.join(merged.select(F.col("node").alias("label")), "label", "left_anti").unionByName(united))
        if tops is None:
            tops = cut_lineage(moved)
        else:
            step = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
            tops = cut_lineage(tops.join(step, "label", "left").select("node", F.coalesce("top", "label").alias("label")).unionByName(moved))
    for name in ("records", "near"):
        spark.catalog.dropTempView(f"{views}_{name}")
    if tops is None:
        return labels
    step = tops.select(F.col("node").alias("label"), F.col("label").alias("top"))
    own = labels.join(step, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    return own.unionByName(tops.join(labels.select("node"), "node", "left_anti"))


def rows_of(contacts: DataFrame, ranked: DataFrame) -> DataFrame:
    part = lambda df, key: df.select(F.col(key).cast("bigint").alias("id"), F.col("institution_id").cast("string").alias("inst"), F.col("name").cast("string").alias("name"), F.col("email").cast("string").alias("email"))
    return part(contacts, "contact_id").unionByName(part(ranked, "ranked_id")).filter("id is not null and inst is not null and trim(name) <> ''")


def linked(rows: DataFrame) -> DataFrame:
    """(id, seen, entity): the entity of every row with a usable name; ``seen`` is the spelling without formatting."""
    mentions = cut_lineage(rows.mapInPandas(_mentions, MENTION))
    names = established_names(mentions)
    parsed = cut_lineage(mentions.select("form").distinct().mapInPandas(_parser(names), PARSED))
    forms = mentions.join(parsed, "form").withColumn("sure", F.col("kind").eqNullSafe("p") & (F.length("s") > 3) & F.contains("local", F.col("s"))).drop("form", "local")
    short = cut_lineage(learned_forms(forms, names)).select(F.col("g").alias("given"), "full")
    forms = forms.withColumn("given", F.when(F.col("kind") == "p", F.col("g"))).join(short, "given", "left").withColumn("g", F.coalesce("full", "g")).drop("given", "full")
    forms = cut_lineage(forms.withColumn("node", F.xxhash64("inst", "kind", "s", "g", "i")))
    labels = resolve(forms)
    return forms.select("id", "seen", "node").join(labels, "node", "left").select("id", "seen", F.coalesce("label", "node").alias("entity"))


def entities(contacts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id, entity, spellings): the entity of every row with a usable name, the exact compact form of all pairs.

    ``entity`` is the smallest id among its rows, ``spellings`` counts the spellings that the entity has.
    """
    rows = cut_lineage(linked(rows_of(contacts, ranked)))
    firsts = rows.groupBy("entity", "seen").agg(F.min("id").alias("first")).groupBy("entity").agg(F.min("first").alias("first"), F.count("*").alias("spellings"))
    return rows.join(firsts, "entity").select("id", F.col("first").alias("entity"), "spellings")


def variant_pairs(contacts: DataFrame, ranked: DataFrame) -> DataFrame:
    """(id_a, id_b): each pair of rows of one entity whose spellings differ."""
    rows = cut_lineage(linked(rows_of(contacts, ranked)))
    # spellings are paired first, then rows: an entity of many equally spelt rows makes no pairs to throw away
    spellings = rows.select("entity", "seen").distinct()
    several = spellings.groupBy("entity").agg(F.count("*").alias("n")).filter("n > 1").select("entity")
    spellings = cut_lineage(spellings.join(several, "entity", "left_semi"))
    pairs = spellings.withColumnRenamed("seen", "seen_a").join(spellings.withColumnRenamed("seen", "seen_b"), "entity").filter("seen_a < seen_b")
    rows = rows.join(several, "entity", "left_semi")
    left = rows.select("entity", F.col("seen").alias("seen_a"), F.col("id").alias("a"))
    right = rows.select("entity", F.col("seen").alias("seen_b"), F.col("id").alias("b"))
    found = pairs.join(left, ["entity", "seen_a"]).join(right, ["entity", "seen_b"])
    return found.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
