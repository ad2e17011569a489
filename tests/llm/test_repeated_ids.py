"""Ids that repeat or are missing, and terms that only tell in pairs."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from strom.llm import language_id, near_dedup, toxicity
from tests.harness import SF_DIR


def test_a_document_of_two_texts_keeps_the_links_of_both(spark):
    draw = random.Random(8)
    base = [[f"{t}{i}" for i in range(80)] for t in ("a", "b", "c")]
    near = lambda w: " ".join([*w[:-2], "other", "end"])
    rows = [(1, " ".join(base[0])), (1, " ".join(base[1])), (2, near(base[0])), (3, near(base[1])), (4, " ".join(base[2])), (4, " ".join(base[2])), (5, near(base[2])),
            (6, None), (6, ""), (7, "alone here now"), (None, " ".join(base[0])), (None, None), (8, ""), (8, near(base[2]) + " x")]
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 4}
    for _ in range(3):
        draw.shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as component", "'x' as _part", "2 as n").repartition(3)
        found = near_dedup.near_dedup_by_id(docs).collect()
        assert len(found) == len(rows)
        assert {(r.doc_id, r.component_id) for r in found} == {*want.items(), (None, None)}
        assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    assert near_dedup.near_dedup_by_id(docs.limit(0)).count() == 0


def test_components_by_id_equal_brute_force(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    texts = [draw.choices(words, k=40) for _ in range(12)]
    rows = []
    for _ in range(80):
        w = list(draw.choice(texts))
        if draw.random() < 0.6:
            w[draw.randrange(40)] = "new"
        rows.append((draw.randrange(30), " ".join(w)))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    of = {i: i for i, _ in rows}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for (a, x), (b, y) in itertools.combinations(zip((i for i, _ in rows), sets), 2):
        if 100 * len(x & y) >= 85 * len(x | y):
            low, high = sorted((root(a), root(b)))
            of[high] = low
    found = near_dedup.near_dedup_by_id(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(i, root(i)) for i in of}


def test_language_is_learned_without_ids(spark):
    docs = spark.read.parquet(SF_DIR.replace("sf0.001", "sf0.01") + "/documents.parquet").where("lang is not null and text is not null")
    for ids in (F.lit(None).cast("bigint"), F.lit(1).cast("bigint")):
        model = language_id.train(docs.withColumn("doc_id", ids), per_language=60)
        found = language_id.predict(docs, model, ["doc_id", "lang"]).toPandas()
        told = found[found.lang_pred != language_id.UNDETERMINED]
        assert len(told) > 900 and (told.lang == told.lang_pred).mean() > 0.97


def test_copies_of_a_text_are_fitted_on_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit", lambda x, named, languages: seen.append(len(x)))
    rows = [(i, "the same text of many rows", "en") for i in range(3000)] + [(i, f"text number {i} of its own", "en") for i in range(50)]
    language_id.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert 45 <= seen[0] <= 51


def made_texts(label_of, n, seed):
    draw = random.Random(seed)
    rows, labels = [], []
    for _ in range(n):
        a, b = draw.random() < 0.5, draw.random() < 0.5
        words = [f"plain{draw.randrange(3000)}" for _ in range(30)] + ["group"] * a + ["common"] * b
        rows.append(np.unique(toxicity._terms(*_bytes(" ".join(words)))[0]))
        labels.append(label_of(a, b))
    return rows, np.array(labels)


def _bytes(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_a_pair_of_terms_that_tell_nothing_alone_is_learned():
    for label_of in (lambda a, b: int(a != b), lambda a, b: int(a == b)):
        rows, labels = made_texts(label_of, 4000, 1)
        model = toxicity.fit(rows, labels, np.ones(len(rows)))
        test, truth = made_texts(label_of, 1000, 2)
        text = np.repeat(np.arange(len(test)), [len(r) for r in test])
        scores = model.scores(len(test), *model.present(np.concatenate(test), text))
        assert ((scores >= 0.5) == truth).mean() > 0.97


def test_pairs_by_chance_do_not_take_part():
    rows, _ = made_texts(lambda a, b: 0, 3000, 3)
    labels = np.array([random.Random(i).randrange(2) for i in range(len(rows))])
    chosen = toxicity._telling_terms(rows, labels)
    assert len(chosen) < 20


def test_scores_are_those_of_the_plain_formula(spark):
    rows, labels = made_texts(lambda a, b: int(a and b), 1500, 4)
    model = toxicity.fit(rows, labels, np.ones(len(rows)))
    texts = ["group common plain1", "GROUP, plain2", "common common", "", None, "plain5 " * 40 + "group common"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    at = {int(t): i for i, t in enumerate(model.terms)}
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        words = set(re.findall(r"[a-z0-9]+", (texts[r.doc_id] or "").lower()))
        on = sorted(at[h] for h in (int(toxicity._terms(*_bytes(w))[0][0]) for w in words) if h in at)
        z = model.bias + sum(model.weights[i] for i in on) + sum(float(model.factors[i] @ model.factors[j]) for i, j in itertools.combinations(on, 2))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9
