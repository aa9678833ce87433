import pytest
from conftest import tuples

from rosterloom.plans import extraction as X
from rosterloom.session import intermediates

PAGES = {
    1: "<div><h2>Admissions office</h2><p>Admissions office<br><a href='mailto:international@uni.example'>Write to us</a></p></div>",
    2: "<li>ROSSI Anna<br>Head of the service of words<br><a href='/mail?lang=en&destinataire=anna.rossi%40uni.example'>write</a></li>",
    3: "<li>Bruno Weber<br>Word keeper of the house<br><a href='#' onclick=\"send('bruno.weber@uni.example')\">write</a></li>",
    4: "<p>Carla Neri</p><p>carla.neri [at] uni [dot] example</p>",
    5: "<p>x</p><script>var m = 'dario' + '@' + 'uni' + '.example';</script>",
    6: "<div data-email='elsa.berg@uni.example' data-name='Elsa Berg' data-role='Head of mobility'>.</div>",
    7: "<p>Find us</p><p>fabio.conti@uni.example</p>",
    8: "<p>Main menu</p><p>Gina Sala</p><p>Accept cookie</p><p>gina.sala@uni.example</p>",
    9: "<div data-email='12high@uni.example' data-name='12 High Street' data-role='x'>.</div><div data-email='hall@uni.example' data-name='Conference Centre' data-role='x'>.</div>",
    10: "<p>Hans Muster and office@uni.example</p>",
    11: "<script type='application/json'>{\"items\": [{\"name\": \"Ida Holm\", \"jobTitle\": \"Mobility officer\", \"mail\": \"ida.holm@uni.example\"}]}</script>",
    12: "<p>nothing here at noon</p>",
    13: "<?xml version='1.0'?><doc><p>Jana Kral</p><p>jana.kral@uni.example</p></doc>",
    14: None,
}


@pytest.fixture(scope="module")
def typed(spark):
    df = spark.createDataFrame(list(PAGES.items()), "page_id long, html string")
    llm = spark.createDataFrame([(12, "", "Lars Lind", "Mobility lead", "Lars Lind, mobility lead")], "page_id long, email string, name string, role string, context string")
    with intermediates():
        rows = [r.asDict() for r in X.pipeline(df, llm).collect()]
    out = {}
    for r in rows:
        out.setdefault(r["page_id"], []).append(r)
    return out


def test_types(typed):
    kinds = {p: sorted((r["candidate_type"], r["name"], r["mail"]) for r in rows) for p, rows in typed.items()}
    assert kinds[1] == [("office_contact", "", "international@uni.example")]
    assert kinds[2] == [("named_contact", "Rossi Anna", "anna.rossi@uni.example")]  # capitals put right
    assert kinds[3] == [("named_contact", "Bruno Weber", "bruno.weber@uni.example")]
    assert kinds[4] == [("named_contact", "Carla Neri", "carla.neri@uni.example")]
    assert kinds[6] == [("named_contact", "Elsa Berg", "elsa.berg@uni.example")]
    assert kinds[7] == [("named_contact", "Fabio Conti", "fabio.conti@uni.example")]  # the name from the local part
    assert kinds[8] == [("named_contact", "Gina Sala", "gina.sala@uni.example")]
    assert kinds[10] == [("office_contact", "", "office@uni.example"), ("person_without_email", "Hans Muster", "")]  # split
    assert kinds[11] == [("named_contact", "Ida Holm", "ida.holm@uni.example")]
    assert kinds[12] == [("person_without_email", "Lars Lind", "")]
    assert kinds[13] == [("named_contact", "Jana Kral", "jana.kral@uni.example")]
    assert 14 not in kinds and [k for k, _, _ in kinds[5]] == ["junk_candidate"]


def test_flags(typed):
    flags = {p: {f for r in rows for f in r["flags"]} for p, rows in typed.items()}
    assert "mailto_only" in flags[1] and "generic_inbox" in flags[1] and "obfuscation_recovered" in flags[4]
    assert "name_inferred_from_email_localpart" in flags[7] and {"address_like_name", "office_label_name"} <= flags[9] and "llm_named_without_email" in flags[12]
    assert typed[5][0]["strategies"] == ["js_decode"] and typed[6][0]["strategies"] == ["html_attribute"] and typed[6][0]["role"] == "international mobility"


def test_order_for_filtering(spark):
    rows = [(1, 5, "A B", "a@x", "named_contact"), (1, 2, "", "o@x", "office_contact"), (1, 1, "", "j@x", "junk_candidate")]
    df = spark.createDataFrame(rows, "page_id long, ord int, name string, mail string, candidate_type string")
    assert tuples(X.for_filtering(df), "mail", "position") == [("a@x", 1), ("o@x", 2)]


def test_no_pages(spark):
    with intermediates():
        assert X.pipeline(spark.createDataFrame([], "page_id long, html string")).count() == 0
