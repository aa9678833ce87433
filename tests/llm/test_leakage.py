import random

import pytest
from conftest import tuples

from rosterloom.llm import leakage as L
from rosterloom.llm.textnorm import words


def brute(docs, items, least=12):
    found = []
    for d, text in docs:
        w = words(text)
        grams = {tuple(w[i : i + least]) for i in range(len(w) - least + 1)}
        for i, item in items:
            v = words(item)
            if any(tuple(v[k : k + least]) in grams for k in range(len(v) - least + 1)):
                found.append((d, i))
    return sorted(found)


def test_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{n}" for n in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 30])))) for i in range(12)] + [(90, None), (91, "")]
    docs = [(-1, None), (-2, ""), (-3, "short")]
    for d in range(150):
        text = rng.choices(vocab, k=rng.randrange(1, 80))
        if d % 3:
            source = (items[rng.randrange(12)][1]).split()
            n = rng.choice([11, 12, 13, 20])
            at = rng.randrange(max(1, len(source) - n))
            cut = source[at : at + n]
            k = rng.randrange(len(text) + 1)
            text[k:k] = [w.upper() + rng.choice(["", ",", "\n", "​"]) for w in cut]
        docs.append((d, " ".join(text)))
    docs.append(docs[10])
    docs[-1] = (1000, docs[-1][1])
    docs.append((2000, " ".join(rng.choices(vocab, k=60000)) + " " + items[2][1]))
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in docs], "doc_id long, text string, fp string, item_id int")
    it = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, item_text string, words int")
    for small in (L.SMALL_ITEMS, 0):  # items in every task, and the join of fingerprint tables
        assert sorted(tuples(L.leaks(df, it, small_items=small), "doc_id", "item_id")) == brute(docs, items)
    assert L.leaks(df.limit(0), it).count() == 0 and L.leaks(df, it.limit(0)).count() == 0


def test_shorter_runs_are_refused(spark):
    with pytest.raises(ValueError):
        L.leaks(None, None, 8)


def test_short_words_and_repeated_words(spark):
    line = "a b c d e f g h i j k l"
    docs = [(1, line), (2, line + " m"), (3, "a " * 3000), (4, line.replace(" ", "\n- ").upper()), (5, "a b c d e f g h i j k")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(7, line), (8, "a " * 40)], "item_id long, item_text string")
    want = [(1, 7, 12), (2, 7, 12), (3, 8, 40), (4, 7, 12)]
    for small in (L.SMALL_ITEMS, 0):
        assert tuples(L.leaks(df, it, small_items=small)) == want
