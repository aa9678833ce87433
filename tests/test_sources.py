import json

from conftest import tuples
from pyspark.sql import functions as F

from rosterloom.sources import files, html, sinks
from rosterloom.streaming.current_state import StateStore, windowed_counts

PAGE = """<html><head><script>var x = 'joe' + '@' + 'js.example.org';</script><script type="application/ld+json">{"a": [{"Email": "ld@x.org", "name": "L D", "jobTitle": "Head"}]}</script></head>
<body><nav><a href="/home">Home</a></nav><p>Ann &amp; Bo</p><div data-email="attr@x.org">office</div><a href="mailto:ann@x.org?subject=1">Ann</a><p>plain bo@x.org<script type='application/json'>{broken</script></body>"""


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE, "clash"), (2, None, ""), (3, "", ""), (4, "<p>a<b>" * 2000, ""), (None, "x", "")], "page_id long, html string, text string")
    parsed = html.parsed_pages(df, "page_id", "html")
    found = {(r["email"], r["strategy"]) for r in html.evidence(parsed).filter("page_id = 1").collect()}
    assert found == {("ann@x.org", "mailto_explicit"), ("attr@x.org", "html_attribute"), ("ld@x.org", "embedded_json"), ("joe@js.example.org", "js_decode")}
    assert tuples(html.anchors(parsed), "url", "text", "section") == [("/home", "Home", "nav"), ("mailto:ann@x.org?subject=1", "Ann", "body")]
    texts = {r["page_id"]: r["text"] for r in parsed.collect()}
    assert texts[1].split("\n") == ["Home", "Ann & Bo", "office", "Ann", "plain bo@x.org"] and texts[2] == "" == texts[3] and len(texts[4]) > 1000


def test_html_details():
    deep = '{"a":' * 300 + '{"mail": "deep@x.org"}' + "}" * 300
    page = f"""<title>T</title><h1>One</h1><link rel="alternate" hreflang="FR" href="/fr"><form id="Staff search"><input name="q"></form><div class="vcard" itemtype="x">a</div>
      <li>Anna Rossi<br>Head of mobility, room with a view<br><a href="#" onclick="write('anna%40x.org')">write</a></li><script>window.S = {deep};</script><p title='a "quoted" value'>é &eacute;</p>"""
    got = html.read(page)
    assert got["title"] == "T" and got["headings"] == ["One"] and got["alternates"] == [("fr", "/fr")] and got["forms"][0][2] == "q"
    rows = {r[0]: r for r in got["found"]}
    assert rows["deep@x.org"][1] == "embedded_json" and rows["anna@x.org"][1] == "mailto_explicit" and rows["anna@x.org"][4].startswith("Anna Rossi\nHead of mobility")
    assert ("structured_contact_markup", "x") in got["hints"] and got["text"].endswith("é é")
    assert html.read(None)["found"] == [] and html.read("<p><b>" * 5000)["text"] == ""


def test_sitemaps(spark):
    df = spark.createDataFrame([("h", "<loc> https://a/1 </loc><LOC>https://a/2</LOC>", "Sitemap: https://a/s.xml\nx\nsitemap: https://a/s.xml")], "h string, xml string, txt string")
    assert [r["url"] for r in html.sitemap_urls(df, "h", "xml").collect()] == ["https://a/1", "https://a/2"]
    assert tuples(html.robots_sitemaps(df, "h", "txt")) == [("h", 0, "https://a/s.xml")]


def test_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.json").write_text(json.dumps({"target": {"name": "A", "url": "u", "country": "FR"}, "ranked_contacts": [{"name": "x", "email": "e"}, {"name": "y"}]}, indent=1))
    (tmp_path / "t/b.json").write_text(json.dumps({"university": "B", "home_url": "v"}))
    (tmp_path / "t/c.json").write_text("{broken")
    rows = files.traces(spark, str(tmp_path / "t/*.json"))
    assert tuples(rows, "name", "url") == [("A", "u"), ("B", "v")]
    assert tuples(files.trace_contacts(rows, 1), "institution", "name") == [("A", "x")]
    assert tuples(files.trace_directories(rows), "traces", "contacts", "country") == [(2, 2, "FR")]
    (tmp_path / "c.csv").write_text('name,url,country,size\nAcme,https://a,de,5\n,https://b,de,1\n"B, Co",https://c,fr,\n')
    assert tuples(files.companies(spark, str(tmp_path / "c.csv")), "name", "country", "metadata") == [("Acme", "DE", {"size": "5"}), ("B, Co", "FR", {})]
    assert files.companies(spark, str(tmp_path / "c.csv"), "fr").count() == 1
    (tmp_path / "l.txt").write_text("# no\n A.com \n\na.com\nb.com\n")
    assert tuples(files.lines(spark, str(tmp_path / "l.txt"))) == [("a.com",), ("b.com",)]
    (tmp_path / "n.txt").write_text("École X\necole  x\nZ\n")
    assert sorted(r["key"] for r in files.target_names(spark, str(tmp_path / "n.txt"), ["z"]).collect()) == ["ecole x", "z"]
    (tmp_path / "e.csv").write_text("id;Mail\n1;a@b.c\n")
    assert files.email_list(spark, str(tmp_path / "e.csv"), ";").first()["email"] == "a@b.c"
    assert files.email_list(spark, str(tmp_path / "e.csv"), ";", head=0).count() == 0
    listed = files.listing(spark, str(tmp_path), "*.json")
    assert [r["name"] for r in listed.collect()] == ["a.json", "b.json", "c.json"] and files.directories(listed).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("x", None, 1)], "Zeta string, Name string, Email int")
    assert sinks.crm_rows(df).columns == ["Name", "Email", "Zeta"]
    assert sinks.write_crm(df, str(tmp_path / "o")) and not sinks.write_crm(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first()["Zeta"] == "x"
    sinks.write_documents(spark.createDataFrame([("m", "u", 1), ("m", "u", 2), ("n", "v", 3), ("n", "empty", None)], "method string, org string, c int"), ["method", "org"], str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).count() == 2
    sinks.write_run_info(spark, str(tmp_path / "r/x"), timestamp="2025", num_universities=3)
    assert files.run_folders(spark, str(tmp_path / "r")).first()["targets"] == 3
    assert sinks.markdown([{"a": 1, "b": None}], ["a", "b"]) == "| a | b |\n|-|-|\n| 1 |  |"
    assert sinks.read_store(spark, str(tmp_path / "s"), ["t"]) == {}
    for n in (1, 2):
        sinks.write_store({"t": spark.range(n)}, str(tmp_path / "s"))
        assert sinks.read_store(spark, str(tmp_path / "s"), ["t"])["t"].count() == n
    assert sinks.flat_text(spark.createDataFrame([("a,b\nc",)], "t string"), ["t"]).first()[0] == "a b c"


def test_state_store_takes_late_and_repeated_batches(spark, tmp_path):
    store = StateStore(spark, str(tmp_path / "s"))
    batch = lambda rows: spark.createDataFrame(rows, "identity string, contact_id long, observed long")
    store.apply(batch([("a", 1, 10), ("b", 2, 5)]), 0)
    store.apply(batch([("a", 3, 4), ("c", 4, 1)]), 1)
    store.apply(batch([("a", 3, 4)]), 1)  # delivered again
    assert tuples(store.read()) == [("a", 1, 2, 10), ("b", 2, 1, 5), ("c", 4, 1, 1)]


def test_windowed_stream(spark, tmp_path):
    rows = spark.sql("select timestamp '2024-01-01 01:00:00' + make_interval(0, 0, 0, cast(id as int)) observed_at, 'm' evidence_type from range(10)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_counts(stream).writeStream.format("memory").queryName("windowed").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.table("windowed")
    assert closed.count() >= 5 and closed.agg(F.max("n")).first()[0] == 1
