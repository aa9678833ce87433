import random

from rosterloom.llm import canonical_map as M

AREAS = ["Student Mobility", "Admissions", "Career Services", "Student Services"]
RANKS = {"Director": "Director of {}", "Deputy Director": "Deputy Director of {}", "Officer": "{} Officer"}


def tables(spark):
    entries = [(1 + n, pattern.format(area), area) for n, (area, pattern) in enumerate((a, p) for a in AREAS for p in RANKS.values())]
    french = {"Student Mobility": "Mobilité étudiante", "Admissions": "Admissions", "Career Services": "Insertion professionnelle"}
    ranks = {"Director of": "Directeur", "Deputy": "Directeur adjoint", "Officer": "Chargé"}
    aliases = [(i, "fr", f"{next(v for k, v in ranks.items() if k in name and (k != 'Director of' or 'Deputy' not in name))} / {french[area]}") for i, name, area in entries if area in french and i != 2]
    return spark.createDataFrame(entries, "role_id long, canonical_role string, role_area string"), spark.createDataFrame(aliases, "role_id long, lang string, alias string"), {n: i for i, n, _ in entries}


def mapped(spark, values, catalog, aliases):
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "src string, rec_id long, value string")
    return {values[r["rec_id"]]: r["role_id"] for r in M.mapped_rows(spark, rows, catalog, aliases).collect()}


def test_values(spark):
    catalog, aliases, ids = tables(spark)
    want = {
        "director of student mobility": ids["Director of Student Mobility"], "Dir. of Stud. Mobility": ids["Director of Student Mobility"], "Student Mobility, Deputy Director": ids["Deputy Director of Student Mobility"],
        "Dpty Director of Admission – X Campus": ids["Deputy Director of Admissions"], "Acting Career Svcs Officer (part-time)": ids["Career Services Officer"], "Directrice adjointe : Mobilite etudiante": ids["Deputy Director of Student Mobility"],
        "CHARGÉE – INSERTION PROFESSIONNELLE, room 4": ids["Career Services Officer"], "Diretcor of Studnet Services": ids["Director of Student Services"], "Organist": 0, "n/a": 0, "Director of Parking": 0, "Student Mobility": 0, " ": 0}
    assert mapped(spark, list(want), catalog, aliases) == want
    assert mapped(spark, ["Director of Admissions", ""], catalog, aliases) == {}  # an entry letter for letter, and nothing
    assert mapped(spark, ["Director of Admissions!", "x" * 50000], catalog.limit(0), aliases) == {"Director of Admissions!": 0, "x" * 50000: 0}


def test_pigeonhole_loses_no_close_word(spark):
    """Every single edit of a long word is found, as by comparing all words with all."""
    catalog, aliases, ids = tables(spark)
    rng = random.Random(4)
    values = []
    for _ in range(120):
        w = list("mobility")
        k = rng.randrange(len(w))
        kind = rng.randrange(4)
        if kind == 0:
            w[k] = rng.choice("xyz")
        elif kind == 1:
            w.insert(k, rng.choice("xyz"))
        elif kind == 2:
            del w[k]
        else:
            k = min(k, len(w) - 2)
            w[k], w[k + 1] = w[k + 1], w[k]
        values.append(f"Director of Student {''.join(w)}")
    values = sorted(set(values) - {"Director of Student Mobility"})
    got = mapped(spark, values, catalog, aliases)
    assert all(got[v] == ids["Director of Student Mobility"] for v in values)


def test_repaired_values_and_views(spark):
    """Values restored by a query before; no temporary view is left."""
    from rosterloom.llm import charset

    catalog, aliases, ids = tables(spark)
    good = "Chargé / Insertion professionnelle"
    bad = good.encode().decode("cp1252")
    rows = spark.createDataFrame([("s", 1, bad), ("s", 2, bad), ("s", 3, None)], "src string, rec_id long, value string")
    got = M.mapped_rows(spark, rows, catalog, aliases, charset.repaired_values).collect()
    assert sorted((r["rec_id"], r["role_id"]) for r in got) == [(1, ids["Career Services Officer"]), (2, ids["Career Services Officer"])]
    assert not [v.name for v in spark.catalog.listTables() if v.name.startswith("rl")]
