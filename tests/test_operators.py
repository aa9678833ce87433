import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rosterloom.functions import emails, names, text, urls
from rosterloom.functions.packs import DEFAULT, Pack
from rosterloom.operators.components import components
from rosterloom.session import cut_lineage, intermediates
from rosterloom.operators.records import exact_median, number_in_groups, best_by, compose_quota, first_seen, fold_records, insert_ignore, line_context, resolve_redirects, top_per_group, unexpired, upsert
from rosterloom.operators.skew import lookup_join


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def test_lookup_join_hot_and_cold(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"))
    lookup = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    joined = lookup_join(rows, lookup, "k", "id", "n", hot_rows=100, salts=8)
    assert tuples(joined, "id", "first") == tuples(rows.join(lookup, "k"), "id", "first")
    assert joined.count() == 1000


def test_components_against_brute_force(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    got = {}
    for r in components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["label"], set()).add(r["node"])
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
    assert all(label in nodes for label, nodes in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_top_best_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("b", 4, None)], "k string, id int, score int")
    order = [F.col("score").desc_nulls_last(), F.col("id")]
    assert tuples(top_per_group(df, ["k"], order), "k", "id") == [("a", 1), ("b", 4)]
    assert tuples(best_by(df, ["k"], [F.coalesce("score", F.lit(-1)), -F.col("id")], ["id"]), "k", "id") == [("a", 1), ("b", 4)]
    assert tuples(first_seen(df, ["k"], [F.col("id")]), "id", "duplicate") == [(1, False), (2, True), (3, True), (4, False)]


def test_upsert_is_idempotent_and_null_safe(spark):
    old = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    new = spark.createDataFrame([("a", 9), (None, 3), ("b", 4)], "k string, v int")
    rule = {"v": F.greatest("c.v", "i.v")}
    once = upsert(old, new, ["k"], rule)
    assert tuples(once) == sorted([("a", 9), (None, 3), ("b", 4)], key=repr)
    assert tuples(upsert(once, new, ["k"], rule)) == tuples(once)
    assert tuples(insert_ignore(old, new, ["k"])) == sorted([("a", 1), (None, 2), ("b", 4)], key=repr)


def test_ttl(spark):
    df = spark.sql("select id, timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id as int)) at from range(40)")
    now = F.lit("2024-02-01").cast("timestamp")
    assert unexpired(df, F.col("at"), now, 10).count() == 18
    assert unexpired(df, F.col("at"), now, 0).count() == 0
    assert unexpired(df, F.col("at"), now, 0, "ever").count() == 40


def test_redirects_stop_at_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("e", "f")], "source_url string, target_url string")
    df = spark.createDataFrame([("a",), ("d",), ("e",), ("x",), (None,)], "u string")
    assert tuples(resolve_redirects(df, "u", edges)) == sorted([("a", "c"), ("d", "d"), ("e", "f"), ("x", "x"), (None, None)], key=repr)


def test_fold_matches_sequential_merge(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, rng.randrange(3), rng.choice(["", None, "x", "y", "z"]), [rng.choice("pq")]) for i in range(60)]
    got = {r["k"]: (r["score"], r["name"], r["tags"]) for r in fold_records(spark.createDataFrame(rows, "k string, ord int, score int, name string, tags array<string>"), ["k"], "ord", "score", ["name"], ["tags"]).collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        named = [r for r in mine if r[3]]
        best = max(named, key=lambda r: (r[2], -r[1]))
        assert got[k] == (max(r[2] for r in mine), best[3], sorted({t for r in mine for t in r[4]}))


def test_quota_and_context(spark):
    df = spark.createDataFrame([("h", "a", i) for i in range(5)] + [("h", "b", 9), ("h", "c", 1)], "h string, kind string, s int")
    out = compose_quota(df, "h", "kind", [F.col("s").desc()], {"a": 2, "b": 5}, 3)
    assert [(r["kind"], r["s"]) for r in out.orderBy("position").collect()] == [("b", 9), ("a", 4), ("a", 3)]
    lines = spark.createDataFrame([(1, "x\nhit\ny"), (2, "hit"), (3, None), (4, "")], "id int, t string")
    assert tuples(line_context(lines, "id", "t", F.col("line") == "hit"), "id", "context") == [(1, "x\nhit\ny"), (2, "hit")]


@pytest.mark.parametrize("url, want", [
    ("HTTP://Ex.Org:80/a?b=1#c", "http://ex.org/a?b=1"), ("https://x.y", "https://x.y/"), ("//x.y/p", "https://x.y/p"), ("not a url", "not a url"), ("https://x.y:443/", "https://x.y/")])
def test_url_normalized(spark, url, want):
    assert one(spark, urls.normalized(F.lit(url))) == want


def test_url_functions(spark):
    assert one(spark, urls.site_root(F.lit("a.b.ac.uk"))) == "b.ac.uk"
    assert one(spark, urls.site_root(F.lit("a.b.example"))) == "b.example"
    assert one(spark, urls.same_site(F.lit("https://www.x.test/a"), F.lit("https://sub.x.test"))) is True
    assert one(spark, urls.is_asset(F.lit("https://x/a.PDF?z"))) is True
    assert one(spark, urls.normalized(F.lit(None).cast("string"))) is None


def test_email_functions(spark):
    assert one(spark, emails.normalized(F.lit(" mailto:Ann@Ex.org?x=1 "))) == "ann@ex.org"
    assert one(spark, emails.normalized(F.lit(None).cast("string"))) == ""
    assert one(spark, emails.generic_mailbox(F.lit("information@x.y"))) is True  # a prefix test
    assert one(spark, emails.normalized(F.lit("mailto:ann%40ex.org"))) == "ann@ex.org" and one(spark, emails.normalized(F.lit("a+b@ex.org"))) == "a+b@ex.org"
    # a dot must be spelled out; "dot" may be a word between blanks
    assert one(spark, emails.obfuscated_emails(F.lit("ann [at] x.org, bo (at) y (dot) net, cy at host dot org; meet at noon"))) == ["bo@y.net", "cy@host.org"]
    assert one(spark, emails.matches_name(F.lit("a.rossi@x.y"), F.lit("Anna Rossi"))) is True
    assert one(spark, emails.matches_name(F.lit("info.rossi@x.y"), F.lit("Anna Rossi"))) is False  # nobody's mailbox
    assert one(spark, emails.matches_name(F.lit("arossi@x.y"), F.lit("Rossi"))) is False and one(spark, emails.matches_name(F.lit(None).cast("string"), F.lit("Anna Rossi"))) is False
    assert set(one(spark, emails.pattern_values(F.lit("Dr Anna de Rossi"))).values()) == {"anna.rossi", "a.rossi", "annarossi", "anna_rossi", "anna-rossi", "arossi", "rossi.anna"}
    assert one(spark, emails.link_emails(F.lit("/f?x=1&recipient=ann%40ex.org"))) == ["ann@ex.org"]
    assert one(spark, emails.smtp_status(F.lit(550), F.lit("on a Blocklist"))) == "blocked" and one(spark, emails.smtp_status(F.lit(None).cast("int"), F.lit(""))) == "error"
    assert one(spark, emails.mail_provider(F.lit("a.mail.protection.OUTLOOK.com"))) == "outlook"
    assert one(spark, emails.well_formed(F.lit("a@b@c.d"))) is False
    assert one(spark, emails.pattern_values(F.lit("Élodie Noël")))["flast"] == "énoël"


def test_text_functions(spark):
    assert one(spark, text.collapse_blanks(F.lit(" a   b\n"))) == "a b"
    assert one(spark, text.alnum_key(F.lit("Straße – ÉCOLE!"))) == "strasse ecole"
    assert one(spark, text.fix_capitals(F.lit("ANNA de ROSSI"))) == "Anna de Rossi"
    assert one(spark, text.token_estimate(F.lit(""))) == 1
    assert one(spark, text.contains_any(F.lit("through"), ["hr"])) is True


def test_names(spark):
    clean = lambda t: one(spark, names.clean_name(F.lit(t).cast("string")))
    assert clean("E-mail: anna.rossi@x.org | ANNA de ROSSI") == "Anna de Rossi" and clean("Tel. 12, High Street") == "" and clean("International Office") == "" and clean(None) == "" and clean("") == ""
    assert clean("Klasulštel Francesca") == "Klasulštel Francesca"  # no label inside a word
    person = lambda t: one(spark, names.person_name(F.lit(t).cast("string")))
    assert person("Anna Rossi") and person("محمد علي") and not person("Anna") and not person("Anna Rossi 2") and not person("Head Director") and not person("x" * 200) and not person(None)
    assert one(spark, names.infer_name(F.lit("anna.rossi@x.org"))) == "Anna Rossi" and one(spark, names.infer_name(F.lit("arossi@x.org"))) == ""
    assert one(spark, names.clean_role(F.lit("Tel: Ufficio Relazioni internazionali"), ["relazioni"])) in ("relazioni", "international relations")
    assert one(spark, names.best_role(F.array(F.lit("Home"), F.lit("Head of mobility"), F.lit("Director of mobility")))) == "international mobility"
    context = one(spark, names.clean_context(F.lit("Main menu\nHead of mobility office\nAccept cookie\n" + "w " * 400)))
    assert context == "Head of mobility office"
    pack = DEFAULT.merged(Pack(name_particles=("van", "ter"), role_aliases=(("international relations", ("affaires",)),)))
    assert pack.name_particles[-1] == "ter" and dict(pack.role_aliases)["international relations"] == ("international relations", "affaires")


def test_exact_median(spark):
    rows = [("a", float(v)) for v in (3, 1, 2, 2, 9)] + [("b", 1.0), ("b", 4.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    assert tuples(exact_median(df, ["k"], "v", "m")) == [("a", 2.0), ("b", 2.5)]


def test_url_kinds(spark):
    assert one(spark, urls.registrable(F.lit("a.b.com.au"))) == "b.com.au" and one(spark, urls.registrable(F.lit("a.b.example"))) == "b.example"
    assert one(spark, urls.domain_match(F.lit("ox.co.uk"), F.lit("ox.ac.uk"))) is True and one(spark, urls.domain_match(F.lit("uw.edu"), F.lit("washington.edu"))) is False
    assert one(spark, urls.family_signature(F.lit("https://x.org/en/offices/contact.html"))) == "x.org:offices::contact"
    assert one(spark, urls.branch(F.lit("https://x.org/en/"), F.lit("https://x.org/offices/intl/a"))) == "offices/intl"
    assert [v["reason"] for v in one(spark, urls.home_variants(F.lit("http://www.x.org/a")))][:3] == ["original", "upgrade_https", "strip_path_to_root"]


def test_released_tables_are_gone(spark):
    import os

    with intermediates():
        df = cut_lineage(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://")
        assert df.count() == 3 and os.path.exists(path)
    assert not os.path.exists(path)


def test_numbering_of_a_large_group(spark):
    rows = [("hot" if n % 3 else f"g{n % 7}", (n * 37) % 1009, n) for n in range(3000)] + [(None, n, 5000 + n) for n in range(5)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = {(r["g"], r["id"]): r["place"] for r in number_in_groups(df, ["g"], [F.col("v").desc(), F.col("id")], "place").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2])), 1):
            want[(g, r[2])] = place
    assert got == want
    assert number_in_groups(df.limit(0), ["g"], [F.col("id")], "place").count() == 0
