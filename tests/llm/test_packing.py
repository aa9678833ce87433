import random

import pytest

from rosterloom.llm import packing as P

VOCABULARY = P.DEFAULT_VOCABULARY


def test_pack_keeps_all_limits():
    rng = random.Random(9)
    for _ in range(20):
        cap = rng.choice([50, 100])
        sizes = [(n := rng.randrange(1, cap + 1), rng.randrange(n + 1)) for _ in range(rng.randrange(1, 200))]
        where = P.pack(sizes, cap, 6, cap // 2 if max(s[1] for s in sizes) <= cap // 2 else cap)
        assert min(where) >= 0
        for c in set(where):
            inside = [s for s, w in zip(sizes, where) if w == c]
            assert sum(s[0] for s in inside) <= cap and len(inside) <= 6 and sum(s[1] for s in inside) <= cap


def test_little_space_is_left():
    rng = random.Random(1)
    sizes = [(rng.randrange(1, 300), 0) for _ in range(3000)]
    used = len(set(P.pack(sizes, 512, 100, 512)))
    assert used <= -(-sum(s[0] for s in sizes) // 512) * 1.01 + 1


def test_assignment_is_complete(spark):
    texts = [(1, "Head\n" + "word " * 900), (2, "one two"), (3, None), (4, ""), (5, "x"), (5, "x"), (6, "é" * 5000), (None, "lost")]
    docs = spark.createDataFrame([(d, t, "clash", 3) for d, t in texts], "doc_id long, text string, capacity string, piece int")
    caps = spark.createDataFrame([(64, "s"), (256, "m"), (None, "none"), (0, "zero")], "capacity_tokens int, label string")
    rows = P.assigned(docs, caps, shard_items=3).collect()
    sizes = {}
    for d, n, _ in P.sized(docs).collect():
        sizes.setdefault(d, []).append(n)
    assert set(sizes) == {1, 2, 5, 6}
    for cap in (64, 256):
        mine = [r for r in rows if r["capacity"] == cap]
        for d, lengths in sizes.items():
            parts = sorted((r["start_token"], r["tokens"]) for r in mine if r["doc_id"] == d)
            assert sum(t for _, t in parts) == sum(lengths)
            if lengths[0] <= cap:
                assert all(s == 0 for s, _ in parts)  # not split
            else:
                assert all(t == cap for s, t in parts if s + t < lengths[0])
        fill = {}
        for r in mine:
            fill[r["container"]] = fill.get(r["container"], 0) + r["tokens"]
        assert max(fill.values()) <= cap
    assert {r["capacity"] for r in rows} == {64, 256}
    assert P.assigned(docs.limit(0), caps).count() == 0


def test_loss_limit(spark):
    docs = spark.createDataFrame([(i, "a b c d e f g h") for i in range(20)], "doc_id long, text string")
    caps = spark.createDataFrame([(32, "s")], "capacity_tokens int, label string")
    loose, tight = P.usage(P.assigned(docs, caps)).first(), P.usage(P.assigned(docs, caps, loss_share=0.5)).first()
    assert loose["containers"] == 5 and tight["containers"] == 10
    with pytest.raises(ValueError):
        P.assigned(docs, caps, loss_share=0)


def test_each_of_three_limits_is_active(spark):
    """The same texts need more containers under each limit alone than under the capacity alone."""
    docs = spark.createDataFrame([(i, "a b c d e f g h" if i % 2 else "a b c d e f\ng") for i in range(40)], "doc_id long, text string")
    caps = spark.createDataFrame([(64, "s")], "capacity_tokens int, label string")
    n = lambda **k: P.usage(P.assigned(docs, caps, **k)).first()["containers"]
    assert n(max_segments=100) < n(max_segments=4) and n(max_segments=100) < n(max_segments=100, loss_share=0.3)


def test_shards_count_pieces(spark):
    docs = spark.createDataFrame([(1, "word " * 4000)], "doc_id long, text string")
    caps = spark.createDataFrame([(16, "s")], "capacity_tokens int, label string")
    rows = P.assigned(docs, caps, shard_items=50).collect()
    assert len({r["container"].split("-")[1] for r in rows}) >= 4
