from rosterloom.llm import truncation as T


def corpus():
    rows = []
    for i in range(30):
        rows.append((i, "a", f"Report {i}\nThe office in Town{i} opens in May. The bus to Place{i} leaves at noon.\n- fee waivers\n- visa letters"))
        rows.append((100 + i, "b", f"The board of House{i} meets twice.\nAnna Person{i}\nVisa helpdesk"))
    return rows


def judged(spark, rows):
    df = spark.createDataFrame([(d, s, t, True, 1) for d, s, t in rows], "doc_id long, source string, text string, cut boolean, h int")
    return {r["doc_id"]: r for r in T.judged(df).collect()}


def test_endings(spark):
    rows = corpus() + [
        (200, "a", "A new hall was opened by the depar"), (201, "a", "A new hall was opened by the"), (202, "a", "The hall is open. It opens in May…"), (203, "a", "The hall is closed because of ..."),
        (204, "a", "Notes\nWrite to office@x.example"), (205, "a", "It was said.\n— Miller"), (206, "a", "List\n- fee waivers\n- visa let"), (207, "a", "Done.\nAnna Miller\nVisa helpdesk"),
        (208, "a", None), (209, "a", ""), (210, "a", "   \n "), (211, "a", "He said “yes.”"), (212, "a", "Wir treffen uns am 4."), (213, None, "The source is missing and the text is cut in the mid"), (214, "a", "x " * 60000 + "and th"), (215, "a", "Report 1\nThe office in Town1 opens in May. The bus to Pl"),
    ]
    got = judged(spark, rows)
    assert len(got) == len(rows)
    assert {d for d in got if d >= 200 and got[d]["cut"]} == {200, 201, 203, 206, 212, 213, 214, 215}
    assert not any(got[d]["cut"] for d in got if d < 200)
    assert got[215]["longer_copy"]


def test_limit_of_a_source(spark):
    rows = corpus() + [(300 + i, "lim", (f"{i} The office answers every letter it has been sent in the Town of Anna Lee" + "x" * 80)[:90]) for i in range(5)] + [(310, "lim", "Short text.")]
    got = judged(spark, rows)
    assert all(got[300 + i]["at_limit"] and got[300 + i]["cut"] for i in range(5)) and not got[310]["cut"]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    rates = {r["source"]: (r["documents"], r["cut"]) for r in T.rates(df).collect()}
    assert rates["lim"] == (6, 5) and rates["a"] == (30, 0)
    assert T.rates(df.limit(0)).count() == 0


def test_prefixes_against_brute_force(spark):
    import random

    rng = random.Random(3)
    base = ["".join(rng.choices("ab", k=3)) * 12 + "".join(rng.choices("abc ", k=rng.randrange(60))) for _ in range(60)]
    texts = base + [b[: rng.randrange(T.PREFIX, len(b) + 1)] for b in base] + base[:5]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) h")
    ids = {r["text"]: r["h"] for r in df.collect()}
    want = {ids[a] for a in texts if any(b != a and b.startswith(a) for b in texts)}
    assert {r["h"] for r in T.strict_prefixes(df).collect()} == want


def test_short_prefixes(spark):
    texts = ["fee", "fee waivers", "fee waivers", "Fee", "visa", "é", "éa" * 40, "x" * (T.PREFIX - 1), "x" * T.PREFIX, "y" * T.PREFIX, "y" * 99]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) h")
    ids = {r["text"]: r["h"] for r in df.collect()}
    want = {ids[a] for a in texts if any(b != a and b.startswith(a) for b in texts)}
    assert len(want) == 4 and {r["h"] for r in T.strict_prefixes(df).collect()} == want


def test_many_texts_of_one_beginning(spark):
    """More texts than a range may hold begin alike far beyond the first cut of the ranges."""
    import random

    rng = random.Random(4)
    head = "h" * 3 * T.START
    texts = [head + "".join(rng.choices("ab", k=rng.randrange(1, 14))) for _ in range(400)] + [head, head[: T.START], head[:600], "h" * 40]
    df = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("text", "xxhash64(text) h")
    ids = {r["text"]: r["h"] for r in df.collect()}
    want = {ids[a] for a in texts if any(b != a and b.startswith(a) for b in texts)}
    assert {r["h"] for r in T.strict_prefixes(df, hot_start=20).collect()} == want


def test_long_last_lines(spark):
    """What is asked of a last line is asked of the whole line, whatever its length."""
    url = "https://x.example/" + "a" * 400
    rows = corpus() + [(300, "a", "Done.\n— Anna " + "van " * 100 + "Miller"), (301, "a", "It stopped at " + " ".join("w" * 90 for _ in range(4))), (302, "a", "See\n" + url), (303, "a", "Call us: " + "x" * 50_000 + " +49 30 123456")]
    got = judged(spark, rows)
    assert {d for d in got if d >= 300 and got[d]["cut"]} == {301}
