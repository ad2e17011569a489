"""Proximity matches of the positional index against brute force, however documents and items are dealt."""

import collections
import random

import pytest

from strom.llm import decontaminate


def brute_force(texts, items, rare, slop):
    """(document, item) where the item's rarest terms stand together, by looking at every position."""
    count = collections.Counter(w for text in texts for w in text.split())
    found = set()
    for i, item in enumerate(items):
        words = [w for w in dict.fromkeys(item.split()) if count[w]]
        chosen = sorted(words, key=lambda w: count[w])[:rare]  # stable: of equal ones the first in the item
        if len(chosen) < rare:
            continue
        for d, text in enumerate(texts):
            w = text.split()
            for p in (p for p, word in enumerate(w) if word == chosen[0]):
                around = set(w[max(0, p - slop) : p + slop + 1])
                if all(c in around for c in chosen[1:]):
                    found.add((d, i))
    return found


@pytest.mark.parametrize("rare, slop", [(1, 0), (2, 3), (3, 5), (4, 9)])
def test_proximity_against_brute_force(spark, monkeypatch, rare, slop):
    draw = random.Random(rare)
    vocabulary = [f"w{i}" for i in range(30)]
    weights = [1 / (1 + i) for i in range(30)]
    texts = [" ".join(draw.choices(vocabulary, weights, k=draw.choice((0, 1, 4, 30, 200)))) for _ in range(120)]
    items = [" ".join(draw.choices([*vocabulary, "nowhere"], k=draw.randint(1, 12))) for _ in range(25)]
    want = brute_force(texts, items, rare, slop)
    assert want
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    monkeypatch.setattr(decontaminate, "_NEAR_POSTINGS", 7)
    for parts, block in ((1, 500_000), (7, 40)):
        index = decontaminate.build_index(rows.repartition(parts))
        found = decontaminate.search_index(index, bench, rare=rare, slop=slop, block_words=block).where("kind = 'near'").collect()
        assert {(r.doc_id, int(r.item_id)) for r in found} == want
        assert all(0 <= r.start < r.stop <= len(texts[r.doc_id].split()) for r in found)


def test_terms_of_other_shards_do_not_count(spark):
    """A shard need not hold all terms of an item, and the nearest posting may lie in the document next door."""
    texts = ["alpha x beta", "gamma gamma gamma", "beta", "alpha", "beta y y alpha"]
    bench = spark.createDataFrame([("q", "alpha beta gamma"), (None, "alpha beta"), ("n", None)], "item_id string, text string")
    for parts in (1, 5):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1) if parts == 1 else spark.createDataFrame(
            list(enumerate(texts)), "doc_id bigint, text string").repartition(parts, "doc_id")
        found = decontaminate.search_index(decontaminate.build_index(rows), bench, rare=2, slop=5).where("kind = 'near'").collect()
        assert sorted((r.doc_id, r.item_id, r.start, r.stop) for r in found) == [(0, "q", 0, 3), (4, "q", 0, 4)]


def test_many_blocks_are_dealt_without_a_broadcast(spark, monkeypatch):
    texts = [f"u{i} v{i} common w{i}" for i in range(40)]
    bench = spark.createDataFrame([(i, f"v{i} common") for i in range(40)], "item_id bigint, text string")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    monkeypatch.setattr(decontaminate, "_BROADCAST_WORDS", 0)
    found = decontaminate.search_index(decontaminate.build_index(rows), bench, rare=2, slop=2, block_words=10).collect()
    assert sorted((r.doc_id, int(r.item_id), r.kind, r.start, r.stop) for r in found) == sorted(
        (i, i, kind, 1, 3) for i in range(40) for kind in ("near", "phrase"))


def test_columns_of_the_query(spark):
    bench = spark.createDataFrame([("i", " ".join(f"b{k}" for k in range(30)))], "item_id string, text string")
    rows = spark.createDataFrame([(1, "b3 one b9 two b20"), (2, None), (3, "b3 b9")], "doc_id bigint, text string")
    found = decontaminate.contamination(rows, bench, rare=3, slop=6).collect()
    assert {r.doc_id: (r.n_hit, r.n_items, r.n_near, r.contaminated) for r in found} == {1: (0, 0, 1, False), 2: (0, 0, 0, False), 3: (0, 0, 0, False)}
    assert "n_near" not in decontaminate.contamination(rows, bench).columns
