import random
import unicodedata

from conftest import tuples

from rosterloom.llm import exact_copies as E
from rosterloom.llm.textnorm import words


def brute(rows):
    groups = {}
    for i, name, mail, url in rows:
        bare = lambda t: "".join(words(t))
        groups.setdefault(("".join(sorted(words(name))), bare(mail), bare(url)), []).append(i)
    return sorted((min(g), x) for g in groups.values() for x in g if x != min(g))


def test_copies_against_brute_force(spark):
    rng = random.Random(2)
    names = ["Ann Lee", "LEE, Ann", "ann  lee", "“Ann Lee”", "Ann​ Lee", "Zoë K", unicodedata.normalize("NFD", "Zoë K"), "Zoe K", None, "", "Ann Lée", "D'Angelo", "D’Angelo"]
    rows = [(i, rng.choice(names), rng.choice(["a@b.c", "<A@B.C>", "", None, "a@b.c;"]), rng.choice(["https://x/y", "HTTPS://X//y/", "https://x/z", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "contact_id long, name string, email string, page_url string").withColumnRenamed("x", "key")
    for hot in (200_000, 3):  # with few rows to a hot group, all groups take the spread way
        assert sorted(tuples(E.copies(df, "contact_id", ["name"], ["email", "page_url"], hot), "first_id", "copy_id")) == brute(rows)
    groups = E.copy_groups(E.keyed(df, "contact_id", ["name"], ["email", "page_url"]))
    assert sum(r["copies"] for r in groups.collect()) == 300
    assert E.collisions(groups).count() == 0
    assert E.copies(df.limit(0), "contact_id", ["name"], ["email"]).count() == 0


def test_extra_columns_and_long_texts(spark):
    rows = [(1, "x" * 300000, "k", 1), (2, "X" * 300000, "q", 2)]
    df = spark.createDataFrame(rows, "contact_id long, name string, key string, copies int")
    assert tuples(E.copies(df, "contact_id", ["name"], []), "first_id", "copy_id") == [(1, 2)]


def test_collisions_are_told(spark):
    """Two forms of one 128-bit hash stay apart by the second hash, and are reported."""
    keys = [(1, b"h" * 16 + b"a" * 8), (2, b"h" * 16 + b"b" * 8), (3, b"h" * 16 + b"a" * 8), (4, b"x" * 24)]
    groups = E.copy_groups(spark.createDataFrame([(i, bytearray(k)) for i, k in keys], "rec_id long, key binary"))
    assert tuples(groups, "first_id", "copies") == [(1, 2), (2, 1), (4, 1)]
    assert tuples(E.collisions(groups), "forms", "records") == [(2, 3)]
