from itertools import combinations

import pytest

from rosterloom.llm import name_link as N
from rosterloom.llm.textnorm import squeezed

GIVEN = ["Erik", "Erika", "Anna", "Anne", "Patricia", "Paola", "Paolo", "Marta", "Zoë", "Hugo"]
FAMILY = ["Wolverdask", "Bintermol", "Caskrupel", "Dondrifal", "Estervun", "Fulgrandi"]


def rows():
    """(id, institution, name, email, person): names of many institutions, and the variants of one."""
    out = []
    for h in range(12):
        for k, g in enumerate(GIVEN):
            out.append((len(out), f"h{h}", f"{g} {FAMILY[(h + k) % 6]}{h}kel", None, f"{h}-{k}"))
    x = [
        ("Erik Mundalvur", "erik.mundalvur@x.example", "erik"), ("Erika Mundalvur", "erika.mundalvur@x.example", "erika"), ("MUNDALVUR, Erika", None, "erika"), ("Erik  Mundalvur", None, "erik"), ("Dr. Erik Mundalvur", None, "erik"),
        ("Zoë Karpenlu", "zkarpenlu@x.example", "zoe"), ("Z. Karpenlu", None, "zoe"), ("Karpenlu Z.", None, "zoe"), ("Zoë Karpnelu", None, "zoe"), ("Z. Karpnelu", None, "zoe"), ("karpenlu zoë", None, "zoe"),
        ("Patricia Tolbren", "p.tolbren@x.example", "pat"), ("Pat Tolbren", None, "pat"), ("Patrciia Tolbren Vondel", None, "pat"), ("P. Grunwalsk", None, "?"), ("Paola Grunwalsk", None, "paola"), ("Paolo Grunwalsk", None, "paolo"),
        ("Student Mobility Unit", "mobility@x.example", "off"), ("Stud. Mobility Unit", None, "off"), ("Mobility Unit for Students", None, "off"), ("Student Mobility Unit Kelnor Campus", None, "off-k"), ("Mobility Unit, Student Kelnor Campus", None, "off-k"),
        ("Hugo Vanderplot", "hugo.vanderplot@x.example", "h1"), ("Hugo Vanderblot", "hugo.vanderblot@x.example", "h2"), ("JosÃ© Wanfroll", None, "garbled"), ("José Wanfroll", None, "jose"), (None, "a@x.example", "none"), ("", None, "none"), (" ", None, "none"),
        ("Marta Lindorfa Pasqual", None, "ml"), ("M. Lindorfa Pasqual", None, "ml"), ("Prof.ssa Marta Lindorfa", None, "ml"), ("Marta Lindorfa, Prof.", None, "ml"), ("Marta, Lindorfa", None, "ml"),
        ("Zoë Karpenlu", "zkarpenlu@x.example", "zoe"), ("X" * 20000, None, "long"),
    ]
    return out + [(1000 + n, "hx", name, mail, who) for n, (name, mail, who) in enumerate(x)]


def test_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, h, n, m, "clash", 1) for i, h, n, m, _ in data], "contact_id long, institution_id string, name string, email string, node string, label int")
    ranked = df.limit(0).withColumnRenamed("contact_id", "ranked_id")
    got = sorted((r["id_a"], r["id_b"]) for r in N.variant_pairs(df, ranked).collect())
    live = [r for r in data if r[2] and r[2].strip() and r[4] not in ("garbled", "none", "?")]
    want = sorted((a[0], b[0]) for a, b in combinations(live, 2) if a[1] == b[1] and a[4] == b[4] and squeezed(a[2]) != squeezed(b[2]))
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "contact_id long, institution_id string, name string, email string")
    assert N.variant_pairs(df, df.withColumnRenamed("contact_id", "ranked_id")).count() == 0


def test_near():
    assert N.near("abcd", "abdc") and N.near("abcd", "abcde") and N.near("abcd", "bcd") and N.near("abcd", "abxd") and not N.near("abcd", "badc") and not N.near("ab", "abcd")
    words = ["daniel", "daniela", "hugo"]
    assert N.Near(words).find("danila") == ["daniela"] and N.Near(words).find("daniel") == ["daniel"]


def test_rounds_end_in_a_result_or_an_error(spark):
    forms = [(1, 1, "p", "mundalvur", "erik", "", None, False), (2, 1, "p", "mundalvurk", "erik", "", None, False)]
    df = spark.createDataFrame(forms, "node long, inst long, kind string, s string, g string, i string, box long, sure boolean")
    assert len({r["label"] for r in N.resolve(df).collect()}) == 1
    with pytest.raises(RuntimeError):
        N.resolve(df, max_rounds=1)


def test_grown_records_meet_under_what_both_gained(spark):
    """Two records that grew in one round share a block only by a spelling and an initial that each has from another form."""
    rows = [(1, "hartmann", "anna", None), (2, "hartmanne", "anna", 11), (3, "hartmanne", "kira", 11), (4, "hartman", "maria", None), (5, "hatman", "maria", 12), (6, "hatman", "kira", 12)]
    df = spark.createDataFrame([(n, 1, "p", s, g, "", b, False) for n, s, g, b in rows], "node long, inst long, kind string, s string, g string, i string, box long, sure boolean")
    got = {r["node"]: r["label"] for r in N.resolve(df).collect()}
    assert len({got.get(n, n) for n in range(1, 7)}) == 1  # a record that others went to stands for itself


def test_entities_hold_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(i, h, n, m) for i, h, n, m, _ in data], "contact_id long, institution_id string, name string, email string")
    ranked = df.limit(0).withColumnRenamed("contact_id", "ranked_id")
    names = {r[0]: r[2] for r in data}
    groups: dict = {}
    for r in N.entities(df, ranked).collect():
        groups.setdefault(r["entity"], []).append(r["id"])
    assert all(entity == min(ids) for entity, ids in groups.items())
    pairs = sorted((min(p), max(p)) for ids in groups.values() for p in combinations(ids, 2) if squeezed(names[p[0]]) != squeezed(names[p[1]]))
    assert pairs == sorted((r["id_a"], r["id_b"]) for r in N.variant_pairs(df, ranked).collect())
