"""Free-typed values mapped to the closest entry of a reference list, in SQL only.

The reference list names each entry as a rank and an area, in a catalogue and in aliases of several languages. What
identifies a part (say the area "Student Mobility" in French) are the words that all of its aliases share, whatever
the other part; so the aliases need not be complete. Every part's words form the list of reference words.

Partition-based pigeonhole join: a reference word of k allowed edits is cut into k + 1 segments; a typed word within k
edits keeps one segment intact, at most k positions away from its place. So segments are equality-joined with the
substrings of typed words at those positions, candidates are verified with ``levenshtein`` (a swap of neighbours counts
as one edit), and values without a rank or an area are reported through an anti-join as role_id 0.

Values that stand for another text (such as one in a wrong encoding) are given by a query before, as a table of value
and text; the mapping itself is SQL on the distinct values.

Defined results: NULL, '' and values that are a catalogue entry letter for letter give no row; stand-ins for missing
values give 0; several fits: the part with most matched words, then fewest edits, then the smallest role_id; text
length is unlimited; extra columns are ignored; an empty catalogue maps everything to 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.operators.skew import lookup_join
from rosterloom.session import cut_lineage

# Words that carry no meaning of their own, and short or inflected forms that are more than two edits
# away from the word of the catalogue or alias they stand for.
STOP_WORDS = "of for the and de des du la le les et en el al di del della all agli gli con ex fur au aux dei per"
FORMS = {
    "director": "dir dirctr dctr", "deputy": "dpty dep dty depy", "officer": "off offr ofcr offcr", "coordinator": "coord coordr cord", "manager": "mgr mngr mgmt man", "advisor": "adv advsr adviser",
    "assistant": "asst assist ass asstt assistente", "head": "hd", "relations": "rel relns rels reltns", "international": "intl int internat internl", "student": "stud students stdnt", "services": "svcs serv svc servs service",
    "mobility": "mob", "exchange": "exch xchange", "programmes": "prog progs programs program pgms", "centre": "center ctr cntr", "language": "lang", "research": "res rsch", "partnerships": "partn partnership partner ptnrs",
    "scholarships": "schol scholarship schols", "doctoral": "doct phd doc", "admissions": "adm admission admiss", "studies": "stds", "housing": "hous hsg", "career": "careers car", "summer": "sum summ", "school": "sch",
    "alumni": "alum", "abroad": "abr", "study": "stdy",
    "directeur": "directrice dir", "adjoint": "adjointe adj", "chef": "cheffe", "coordinateur": "coordinatrice coord", "charge": "chargee", "conseiller": "conseillere", "direttore": "direttrice dir", "vicedirettore": "vicedirettrice",
    "capo": "capa", "coordinatore": "coordinatrice", "addetto": "addetta", "adjunto": "adjunta adj", "jefe": "jefa", "coordinador": "coordinadora", "tecnico": "tecnica", "asesor": "asesora", "gestor": "gestora",
    "stellvertretender": "stellvertretende stellv stv", "direktor": "direktorin", "leiter": "leiterin ltr", "koordinator": "koordinatorin", "referent": "referentin", "berater": "beraterin", "assistenz": "assistent assistentin",
    "geschaftsfuhrer": "geschaftsfuhrerin", "consulente": "consulente", "gestionnaire": "gest",
}

_FROM = "àáâãäåāăąçćčďèéêëēėęěğìíîïīįłñńňòóôõöøőŕřśšşșťțùúûüūůűýÿźżžđð"
_TO = "aaaaaaaaacccdeeeeeeeegiiiiiilnnnoooooooorrssssttuuuuuuuyyzzzdd"


def norm_sql(col: str) -> str:
    """Lower case, accents gone, 'co-' joined, apostrophes and elisions split off; words between single blanks."""
    folded = f"translate(replace(replace(replace(lower(replace(regexp_replace({col}, '(?i)\\\\b([ld])\ufffd(?=\ufffd)', '$1 '), '\ufffd', '0')), 'ß', 'ss'), 'œ', 'oe'), 'æ', 'ae'), '{_FROM}', '{_TO}')"
    bare = f"regexp_replace(regexp_replace({folded}, '[\\\\u0300-\\\\u036f\\\\u200b-\\\\u200f\\\\u00ad\\\\ufeff]', ''), '\\\\bco[- ]+(?=ord)', 'co')"
    clipped = f"regexp_replace({bare}, '(?<=[a-z])[’\\'´`](?=[tls]\\\\b)', '')"
    return f"trim(regexp_replace({clipped}, '[^a-z0-9]+', ' '))"


class _Views:
    """Temporary views of one run: the names rl_... of the SQL below get a prefix of their own, so runs don't meet."""

    def __init__(self, spark: SparkSession):
        self.spark, self.prefix, self.made = spark, f"rl{uuid.uuid4().hex[:12]}_", set()

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text.replace("rl_", self.prefix))

    def put(self, name: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(name.replace("rl_", self.prefix))
        self.made.add(name)

    def view(self, name: str, text: str, kept: bool = False) -> None:
        """``kept`` writes the rows, for views that several later ones read."""
        df = self.sql(text)
        self.put(name, cut_lineage(df) if kept else df)

    def drop(self) -> None:
        for name in self.made:
            self.spark.catalog.dropTempView(name.replace("rl_", self.prefix))


def _forms_values() -> str:
    return ", ".join(f"('{base}', '{form}')" for base, forms in FORMS.items() for form in forms.split())


def map_values(spark: SparkSession, values: DataFrame, catalog: DataFrame, aliases: DataFrame, repaired: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(value, role_id, n) for each distinct non-empty value; ``values`` has one column, value. 0: no entry fits.

    ``repaired`` gives (value, text) for those of the distinct values that stand for another text; it is a query of its
    own, whose rows are joined by value.
    """
    views = _Views(spark)
    try:
        return _mapped(views, values, catalog, aliases, repaired)
    finally:
        views.drop()


def _mapped(views: _Views, values: DataFrame, catalog: DataFrame, aliases: DataFrame, repaired: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    views.put("rl_catalog", catalog)
    views.put("rl_aliases", aliases)
    views.put("rl_values", values)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS.split())
    tasks = max(int(views.spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # segments a typed word is looked up by: one more than the edits that may spoil them, a swap across a border counting two
    edits = "case when length({w}) < 4 then 0 when length({w}) < 6 then 1 when length({w}) < 7 then 2 else 3 end"
    views.view("rl_named", f"""
      select role_id, 'en' lang, {norm_sql("canonical_role")} name from rl_catalog
      union all select role_id, lang, {norm_sql("alias")} from rl_aliases where alias is not null
    """)
    views.view("rl_parts", """
      select role_id, lang, name, role_area area, trim(regexp_replace(replace(canonical_role, role_area, ' '), '\\\\s+', ' ')) rank
      from rl_named join rl_catalog using (role_id)
    """)
    views.view("rl_part_words", f"""
      with long as (
        select role_id, lang, name, 'area' kind, area part, w from rl_parts lateral view explode(array_distinct(split(name, ' '))) t as w
        union all
        select role_id, lang, name, 'rank' kind, rank part, w from rl_parts lateral view explode(array_distinct(split(name, ' '))) t as w),
      named as (
        select lang, kind, part, count(distinct name) names from (select lang, name, 'area' kind, area part from rl_parts union all select lang, name, 'rank', rank from rl_parts) group by all)
      select lang, kind, part, w, count(*) over (partition by lang, kind, part) needed
      from (select lang, kind, part, w, count(distinct name) n from long where w not in ({stop}) and length(w) > 1 group by all) join named using (lang, kind, part)
      where n = names
    """, kept=True)
    views.view("rl_ref_words", f"""
      select ref, w, 0 k, 0 base_edits from (select base w, form ref from values {_forms_values()} t(base, form)) where w in (select w from rl_part_words)
      union select w ref, w, {edits.format(w="w")} k, 0 from rl_part_words
      union select form ref, base w, case when length(form) < 6 then 0 when length(form) < 9 then 1 else 2 end, 0 from values {_forms_values()} t(base, form) where base in (select w from rl_part_words)
    """, kept=True)
    views.view("rl_segments", """
      select distinct ref, k, length(ref) len, i, 1 + floor(i * length(ref) / (k + 1)) as at,
        substring(ref, cast(1 + floor(i * length(ref) / (k + 1)) as int), cast(floor((i + 1) * length(ref) / (k + 1)) - floor(i * length(ref) / (k + 1)) as int)) seg
      from (select ref, max(k) k from rl_ref_words group by ref) lateral view explode(sequence(0, k)) t as i
    """, kept=True)
    counted = cut_lineage(views.sql("select value, count(*) n from rl_values where value is not null and value <> '' group by value"))
    views.put("rl_counted", counted)
    if repaired is None:
        views.view("rl_distinct", f"select value, n, {norm_sql('value')} norm from rl_counted", kept=True)
    else:
        views.put("rl_repaired", cut_lineage(repaired(counted.select("value"))))
        views.view("rl_distinct", f"select value, n, {norm_sql('text')} norm from (select c.value, n, coalesce(r.text, c.value) text from rl_counted c left join rl_repaired r on c.value = r.value)", kept=True)
    # the words are spread before they are cut into many probes each
    views.view("rl_typed", f"""
      select /*+ REPARTITION({tasks}, tok) */ distinct tok from rl_distinct lateral view explode(split(norm, ' ')) t as tok where length(tok) > 1 and tok not in ({stop})
    """, kept=True)
    # Typed words cut at every place a segment may have moved to, for each length of a reference word within the edits;
    # equality join with the segments; verification.
    views.view("rl_probes", f"""
      select tok, len, k, i, seg from (
        select tok, s.len, s.k, s.i, substring(tok, cast(s.at + d as int), s.seg_len) seg, s.seg_len
        from (select tok, explode(sequence(greatest(1, length(tok) - 3), length(tok) + 3)) len from (select /*+ REPARTITION({tasks}, tok) */ tok from rl_typed)) t
        join (select distinct len, k, i, at, length(seg) seg_len from rl_segments) s on t.len = s.len and abs(length(tok) - s.len) <= s.k
        lateral view explode(sequence(-s.k, s.k)) t as d
        where s.at + d >= 1)
      where length(seg) = seg_len
      union
      select tok, length(tok), 0, 0, tok from rl_typed
    """)
    # letters that only one of two words has, repeats counted: a swap leaves none, a changed letter two
    odd = "aggregate(array_union(split(tok, ''), split(ref, '')), 0, (n, c) -> n + abs((length(tok) - length(replace(tok, c, ''))) - (length(ref) - length(replace(ref, c, '')))))"
    views.view("rl_matched", f"""
      select tok, w, min(case when tok = ref then 0 when d = 2 and odd = 0 then 1 else d end) d from (
        select *, {odd} odd from (
          select distinct p.tok, r.w, s.ref, s.k, levenshtein(p.tok, s.ref) d
          from rl_probes p join rl_segments s on p.len = s.len and p.k = s.k and p.i = s.i and p.seg = s.seg
          join rl_ref_words r on r.ref = s.ref)
        where d <= 4)
      where d <= least(k, 2) and (d < 2 or length(ref) >= 6 or odd = 0) or (k >= 2 and d = 3 and odd <= 2) or (k >= 2 and d <= 4 and odd = 0)
      group by tok, w
    """, kept=True)
    # Swaps alone move every segment of a short word; the sorted letters are what stays intact.
    views.view("rl_swapped", """
      select t.tok, r.w, 1 d from (select tok, array_join(array_sort(split(tok, '')), '') bag from rl_typed where length(tok) > 3) t
      join (select distinct ref, w, array_join(array_sort(split(ref, '')), '') bag from rl_ref_words where length(ref) > 3) r using (bag)
      where levenshtein(t.tok, r.ref) <= if(length(r.ref) < 6, 2, 4)
    """)
    views.view("rl_fits", """
      select value, lang, kind, part, needed, sum(d) edits from (
        select value, lang, kind, part, needed, w, min(d) d from (
          select value, tok from rl_distinct lateral view explode(array_distinct(split(norm, ' '))) t as tok)
        join (select * from rl_matched union all select * from rl_swapped) using (tok) join rl_part_words using (w)
        group by value, lang, kind, part, needed, w)
      group by value, lang, kind, part, needed having count(*) = needed
    """)
    views.view("rl_best", "select value, kind, min_by(part, struct(-needed, edits, part)) part from rl_fits group by value, kind", kept=True)
    views.view("rl_mapped", """
      select a.value, min(c.role_id) role_id from (select value, part area from rl_best where kind = 'area') a join (select value, part rank from rl_best where kind = 'rank') r using (value)
      join (select role_id, role_area area, trim(regexp_replace(replace(canonical_role, role_area, ' '), '\\\\s+', ' ')) rank from rl_catalog) c on c.area = a.area and c.rank = r.rank
      group by a.value
    """)
    return cut_lineage(views.sql("""
      select value, cast(role_id as bigint) role_id, n from rl_mapped join rl_distinct using (value)
      union all
      select value, cast(0 as bigint), n from rl_distinct d left anti join rl_mapped m on d.value = m.value
    """))


def mapped_rows(spark: SparkSession, rows: DataFrame, catalog: DataFrame, aliases: DataFrame, repaired: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` (src, rec_id, value) to (src, rec_id, role_id); ``repaired`` as in ``map_values``."""
    rows = rows.filter("value is not null and value <> ''").join(catalog.select(F.col("canonical_role").alias("value")).distinct(), "value", "left_anti")
    mapped = map_values(spark, rows.select("value"), catalog, aliases, repaired)
    return lookup_join(rows, mapped, "value", "rec_id", "n").select("src", "rec_id", "role_id")
