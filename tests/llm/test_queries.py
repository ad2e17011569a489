"""Registered queries against their oracles, and learned ones on the rows they never saw."""

import pytest

from strom.llm.registry import all_oracles, all_queries
from tests.harness import SF_DIR, compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_matches_oracle(spark, duck, name):
    verdict, detail = compare(spark, duck, name, all_queries()[name], all_oracles()[name])
    assert verdict == "ok", detail


def test_one_query_for_each_operator():
    assert [q.split("_")[0] for q in all_queries()] == [f"op{i}" for i in range(1, 14)]


def test_language_of_held_out_documents(spark):
    folder = SF_DIR.replace("sf0.001", "sf0.01")
    found = all_queries()["op3_language"](spark, folder).toPandas()
    truth = connect(folder).execute("select doc_id, lang from documents").df()
    both = found.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert len(found) == len(truth) and len(held) > 100
    assert (held.lang_pred == held.lang).mean() > 0.98 and found.score.between(0, 1).all()


def test_toxicity_of_held_out_documents(spark):
    folder = SF_DIR.replace("sf0.001", "sf0.1")
    found = all_queries()["op1_toxicity"](spark, folder).toPandas()
    truth = connect(folder).execute("select doc_id, toxic from labels").df()
    held = found.merge(truth, on="doc_id").query("held_out")
    assert found.score.between(0, 1).all() and ((found.score >= 0.7) == (found.predicted == 1)).all()
    clean, toxic = held[held.toxic == 0], held[held.toxic == 1]
    assert clean.predicted.mean() <= 0.02 and toxic.predicted.mean() > 0.75
    above = (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean()
    assert above > 0.8
