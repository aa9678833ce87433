from conftest import tuples
from pyspark.sql import functions as F

from rosterloom.llm import main_content as M

MENU, FOOT = "Home | Study | Alumni | Give", "Widget Hall, Main Road 5, 12345 Town"


def pages():
    rows = []
    for i in range(8):
        body = [f"Heading {i}", f"The office of part {i} answers {i * 7} letters. It does so in May.", "Ann Lee", "Head of Widgets", "ann.lee@site.example"]
        lines = ["Skip to main content", MENU, "Nightly specials banner", "", *body, "Related pages", "Home", "Give", "Alumni", f"Closing words {i} by the board of the house.", FOOT, "© 2020 Site – All rights reserved"]
        rows.append((i, f"https://www.site.example/p/{i}", "\n".join(lines)))
    rows.append((8, "https://site.example/p/0/", rows[0][2]))
    rows.append((20, "https://site.example/e/1", f"{MENU}\n404 – The page you asked for could not be found.\n{FOOT}"))
    rows.append((21, "https://site.example/e/2", f"{MENU}\n404 – The page you asked for could not be found.\n{FOOT}"))
    rows.append((22, "https://other.example/x", "Contact\nName: {{ contact.name }}\nE-mail: ##EMAIL##"))
    rows.append((23, "https://other.example/y", "Lorem ipsum dolor sit amet consectetur"))
    rows.append((24, "https://other.example/z", "Please turn on scripts in your browser to view this directory."))
    rows.append((25, "https://other.example/w", "Room 404 of the house is now the desk.\nIf you saw an error 404 last week: the list works again.\nOur team is under maintenance contract with a firm, says the report."))
    rows.append((26, None, None))
    rows.append((27, "", ""))
    rows.append((28, "https://long.example", "word " * 50000))
    return rows


def recs(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, visible_text string, src string, hits int")
    return M.records(df, "acquired_pages", "page_id", "url", "visible_text")


def test_body_and_residue(spark):
    out = {r["rec_id"]: r for r in M.judged(recs(spark, pages())).collect()}
    for i in range(9):
        assert out[i]["residue"] is None and out[i]["body"] == [5, 6, 7, 8, 9, 14], i
    assert {i: out[i]["residue"] for i in out if out[i]["residue"]} == {20: "message", 21: "message", 22: "placeholder", 23: "filler", 24: "message"}
    assert out[25]["body"] == [1, 2, 3] and out[26]["body"] == [] == out[27]["body"] and out[28]["body"] == [1]


def test_lines_and_empty(spark):
    r = recs(spark, pages())
    lines = M.body_lines(r)
    assert lines.filter("rec_id = 3").count() == 6 and lines.filter("rec_id = 20").count() == 0
    assert tuples(M.residues(r), "rec_id") == [(20,), (21,), (22,), (23,), (24,)]
    assert M.judged(r.limit(0)).count() == 0
    text = r.filter("rec_id = 25").select(M.body_text(F.col("text"), F.array(F.lit(1), F.lit(3))).alias("t")).first()["t"]
    assert text.startswith("Room 404") and text.endswith("report.")


def test_address_keys():
    assert M.address_key("HTTPS://www.X.org//a/b/?q#f") == ("x.org", "x.org/a/b")
    assert M.address_key(None) == ("", "/")


def test_repeats_outside_the_nested_template_are_body(spark):
    top, foot = ["Kelnor Institute of Widgets", "Campus map of Kelnor"], ["Write to the web team of Kelnor", "Kelnor is a member of the Ring"]
    floating = "The hall of Kelnor opens for guests in May"
    rows = [(i, f"https://kelnor.example/{i}", "\n".join([*top, f"Own words {i} of page {i}.", "Kelnor banner of the year" if i < 3 else f"Line {i}", *foot, f"Last words of {i}."])) for i in range(6)]
    # one repeated line stands in two slots of the template, another on a host whose pages share nothing else
    rows[4] = (4, rows[4][1], rows[4][2].replace("Line 4", floating))
    rows[5] = (5, rows[5][1], rows[5][2] + "\n" + floating)
    rows += [(10 + i, f"https://lone.example/{i}", f"Own line {i}.\nVisits to the archive are free\nOther line {i}.") for i in range(2)]
    out = {r["rec_id"]: r["body"] for r in M.judged(recs(spark, rows)).collect()}
    assert [out[i] for i in range(3)] == [[3, 7]] * 3
    assert out[3] == out[4] == [3, 4, 7] and out[5] == [3, 4, 7, 8]
    assert out[10] == out[11] == [1, 2, 3]


def test_classes_without_order_enclose_nothing():
    import pandas as pd

    batch = pd.DataFrame({"place": [[256, 512, 768], [512, 256, 768]], "hk": [[1, 2, 3]] * 2, "class_id": [[9, 9, 5]] * 2, "size": [[2, 2, 1]] * 2, "support": [[3, 3, 2]] * 2})
    seen = {(r.hk, r.owner, r.own): (r.lo, r.hi) for r in M._nested_of(batch).itertuples()}
    assert seen == {(1, 9, True): (0, 1), (2, 9, True): (0, 1), (3, 9, False): (2, 2)}


def test_support_is_relative_to_the_host(spark):
    rows = [(i, f"https://wide.example/{i}", f"Wide House of Words\nOpen to all readers\nOwn words {i} of page {i}.\n{'Lesser Seas Officer' if i in (7, 90) else f'Role {i}'}\nLast words {i}.\nWide web team\nRing of houses") for i in range(100)]
    out = {r["rec_id"]: r["body"] for r in M.judged(recs(spark, rows)).collect()}
    assert all(body == [3, 4, 5] for body in out.values()) and len(out) == 100


def test_slot_of_a_box_is_learned(spark):
    """Boxes whose lines are known tokens show how long the slot of every box is."""
    menu = "Home | Study | Alumni | Give | Fees"
    rows = [(i, f"https://box.example/{i}", f"{menu}\nTop {i} of page.\nQuick links\nHome\nGive\nOwn words {i} of the page.\nBox House of Words") for i in range(5)]
    rows.append((9, "https://box.example/9", f"{menu}\nTop 9 of page.\nQuick links\nA teaser nobody repeats\nAnother teaser of its own\nOwn words 9 of the page.\nBox House of Words"))
    out = {r["rec_id"]: r["body"] for r in M.judged(recs(spark, rows)).collect()}
    assert out == {i: [2, 6] for i in (0, 1, 2, 3, 4, 9)}


def test_filler_without_its_first_words(spark):
    words = "arbor lumen porta granis celer vel omnia quis nunc trivio ferat"
    rows = [(i, f"https://h{i}.example/x", f"Lorem ipsum {words}") for i in range(4)] + [(10, "https://z.example/", "Porta omnia quis nunc lumen arbor vel celer granis. Arbor porta"), (11, "https://z.example/y", "The porta of the arbor house opens at nine in the lumen hall of Celer")]
    assert tuples(M.residues(recs(spark, rows)), "rec_id", "residue") == sorted([(i, "filler") for i in (0, 1, 2, 3, 10)], key=repr)


def test_long_lines_are_judged_whole(spark):
    long = "We use cookies " + "and more cookies " * 60
    rows = [(1, "https://a.example/", f"{long}\nSorry, the requested page could not be found. " + "x" * 300 + "\nOwn words here and there, for once in a while, but many more of them than any message has, so that this page is one that speaks of itself at length. And it goes on and on, as pages do that have been written by people.")]
    out = M.judged(recs(spark, rows)).collect()
    assert out[0]["body"] == [2, 3]


def test_vocabulary_by_join(spark):
    """A vocabulary too large to send gives the same rows."""
    from pyspark.sql import types as T  # noqa: F401

    rows = spark.createDataFrame([("s", 1, 5, [1, 2], [0, 0], [3, 4], [1, 1], [11, 12], [11]), ("s", 2, 5, [1], [0], [3], [1], [12], [11])], "src string, rec_id long, host long, no array<int>, kind array<int>, prose array<int>, ntok array<int>, key array<bigint>, template array<bigint>")
    common = spark.createDataFrame([(12,)], "key long")
    for most in (10, 0):
        assert tuples(M._with_vocabulary(rows, common, 3, most), "rec_id", "body") == [(1, []), (2, [])]
        assert tuples(M._with_vocabulary(rows, common.limit(0), 3, most), "rec_id", "body") == [(1, [2]), (2, [1])]
