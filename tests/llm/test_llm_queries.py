import pytest
from oracle import connect, same

from rosterloom.llm import queries as Q
from rosterloom.session import intermediates

SQL = Q.oracle_sql()
SOURCES = [("rec_id", "contacts", "contacts", "contact_id"), ("rec_id", "ranked_contacts", "ranked_contacts", "ranked_id")]
PAGES = [("rec_id", "acquired_pages", "acquired_pages", "page_id"), ("rec_id", "fetched_extractions", "fetched_extractions", "extraction_id")]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, con, name):
    with intermediates():
        df = Q.queries()[name](spark, data)
        if name in SQL:
            same(df, con, SQL[name])
        else:
            sound(name, df, con)


#: Where the ids of a query come from: column of the result, table, key.
IDS = {
    "p3_found": SOURCES, "p3_repaired": SOURCES, "p2_found": PAGES, "p6_found": PAGES, "p7_found": SOURCES, "p8_packed": [("doc_id", None, "documents", "doc_id")], "p10_found": [("doc_id", None, "documents", "doc_id")],
    "p4_found": [(c, None, "(select contact_id id from contacts union all select ranked_id from ranked_contacts)", "id") for c in ("id_a", "id_b")],
    "p4_entities": [(c, None, "(select contact_id id from contacts union all select ranked_id from ranked_contacts)", "id") for c in ("id", "entity")],
}


def sound(name, df, con):
    """Rows are there, each once, and every id is one of the tables."""
    rows = [r.asDict() for r in df.collect()]
    assert rows and len({tuple(sorted(r.items())) for r in map(hashable, rows)}) == len(rows)
    for column, src, table, key in IDS.get(name, ()):
        known = {x for (x,) in con.execute(f"select {key} from {table}").fetchall()}
        assert {r[column] for r in rows if src is None or r["src"] == src} <= known
    if name == "p4_found":
        assert all(r["id_a"] < r["id_b"] for r in rows)
    if name == "p8_packed":
        fill = {}
        for r in rows:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert all(used <= int(c.split("-")[0]) for c, used in fill.items())
        assert len({(r["capacity"], r["doc_id"], r["piece"]) for r in rows}) == len(rows)


def hashable(row):
    return {k: tuple(v) if isinstance(v, list) else v for k, v in row.items()}
