import pytest
from conftest import tuples

from rosterloom.llm import charset as C

CLEAN = ["Zoë Muñoz", "Þóra Ångström", "Łukasz Dvořák", "Юлия Иванова", "Юлия Бiскнилвиск", "“Ann”", "d’échange", "Â Zugawun", "Å. Berg", "Estêvão", "Íñigo", "Who?", "A? B", "Müller–Lüdenscheidt", "ČŘŠŽ", "Élodie"]


@pytest.mark.parametrize("text", ["Zoë Muñoz", "Chargée – Études à l’étranger", "Direktorin für Zulassung", "Dušan Dvořák", "Юлия Иванова", "Hélène"])
@pytest.mark.parametrize("read", ["latin-1", "cp1252", "cp1251", "cp437", "cp850", "mac_roman"])
def test_utf8_read_as_legacy_comes_back(text, read):
    try:
        garbled = text.encode("utf-8").decode(read)
    except UnicodeDecodeError:
        garbled = "".join(bytes([b]).decode(read, "ignore") or chr(b) for b in text.encode("utf-8"))
    damaged, fixed, layers = C.repair(garbled)
    assert damaged and fixed == text and layers == 1


def test_two_layers():
    text = "Mobilité étudiante"
    twice = text.encode().decode("cp1252").encode().decode("cp1252")
    assert C.repair(twice) == (True, text, 2)


@pytest.mark.parametrize("written, read", [("cp1252", "cp1251"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252")])
def test_single_byte_pairs(written, read):
    for text in ("Direktor für Zulassung", "José Peña"):
        damaged, fixed, _ = C.repair(text.encode(written).decode(read))
        assert damaged and fixed == text


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_is_left_alone(text):
    assert C.repair(text)[0] is False
    assert C.fix(text) == text


def test_lost_characters():
    assert C.repair("Fr�d�ric") == (True, None, 0)
    assert C.repair("Fran?ois")[:2] == (True, None)


def test_column(spark):
    rows = [(1, "JosÃ©", None, "x"), (2, None, "", "y"), (3, "plain", "fÃ¼r", "z"), (3, "plain", "fÃ¼r", "z"), (4, "Zoë " * 20000, "Ã© " * 3000, "")]
    df = spark.createDataFrame(rows, "contact_id long, name string, role string, rec_id string")
    got = C.damaged_values(df, "contact_id", ["name", "role"], "contacts")
    assert tuples(got, "rec_id", "field") == [(1, "name"), (3, "role"), (3, "role"), (4, "role")]
    assert got.filter("rec_id = 1").first()["repaired"] == "José"
    assert C.damaged_values(df.limit(0), "contact_id", ["name"], "c").count() == 0
