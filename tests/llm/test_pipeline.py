"""The pipeline's stages one after another, each against a plain version of its decision."""

import itertools
import re

import corpus_pipeline
from strom.session import cut_lineage
from tests.harness import SF_DIR


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    noise = spark.createDataFrame([(10_001, "12345 --- 678", "en", "s", 13), (10_002, None, None, None, None), (10_003, "", None, "s", 0)], docs.schema)
    docs = docs.unionByName(noise)
    bench = [words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+") for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, SF_DIR).collect(), docs.schema if name != "mixed" else None)
        kept[name] = {r.doc_id for r in docs.collect()}
        if name != "mixed":
            assert docs.columns == spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
        if name == "language":
            assert {r.doc_id for r in before} - kept[name] >= {10_001, 10_002, 10_003} and len(kept[name]) >= 0.97 * len(before) - 3
        if name == "exact":
            best = {}
            for r in before:
                key = re.sub(r"[\x20\x09-\x0D]", "", r.text)
                best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text), r.doc_id))
            assert kept[name] == {i for _, i in best.values()}
        if name == "near":
            sets, over = {r.doc_id: shingles(r.text) for r in before}, {}
            for a, b in itertools.combinations(sorted(sets), 2):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    over[b] = min(a, over.get(b, a))
            assert kept[name] == set(sets) - set(over)
        if name == "decontaminated":
            for r in before:
                w, hit = words(r.text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), set()
                for b in bench:
                    n = min(13, len(b))
                    windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
                    hit |= {q for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for q in range(p, p + n)}
                assert (r.doc_id in kept[name]) == (not hit or 20 * len(hit) < len(w))
        if name == "mixed":
            assert kept[name] <= kept["decontaminated"] and all(1 <= r.mix_copies <= 2 for r in docs.collect())


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
        assert docs.count() == 0


def test_rows_that_repeat_an_id_are_judged_by_themselves(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    text = " ".join(f"own{i}" for i in range(60))
    other = " ".join(f"other{i}" for i in range(60))
    rows = [(20_001, text, "en", "s", 1)] * 3 + [(20_002, other, "en", "s", 1), (20_003, other, "en", "s", 1), (20_003, "a third text that nothing else is equal to", "en", "s", 1)]
    rows += [(20_004, f"first of two texts {text} with more", "en", "s", 1), (20_004, f"second text of one id, {' '.join(f'new{i}' for i in range(40))}", "en", "s", 1)]
    made = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for docs in (cut_lineage(made), made):  # numbered by file, and by a copy
        for name, stage in corpus_pipeline.STAGES[1:]:
            docs = cut_lineage(stage(spark, docs, SF_DIR))
            found = [r for r in docs.collect() if (r.doc_id or 0) > 20_000]
            texts = sorted((r.doc_id, r.text.split()[0]) for r in found)
            if name == "exact":
                assert texts == [(20_001, "own0"), (20_002, "other0"), (20_003, "a"), (20_004, "first"), (20_004, "second")]
            if name == "near":
                assert texts == [(20_001, "own0"), (20_002, "other0"), (20_003, "a"), (20_004, "second")]
        assert len(set(texts)) == len(texts) and all(r.mix_copies <= 2 for r in found)


def test_rows_without_id_are_judged_like_others(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(40)
    item = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").where("length(text) > 100").first().text
    text, other, alone = (" ".join(f"{w}{i}" for i in range(60)) for w in ("own", "other", "alone"))
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (None, item, "en", "s", 1), (None, f"{other} more", "en", "s", 1), (20_001, other, "en", "s", 1), (None, alone, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[1:]:
        docs = cut_lineage(stage(spark, docs, SF_DIR))
        kept[name] = sorted((r.doc_id or 0, r.text.split()[0]) for r in docs.collect() if r.doc_id is None or r.doc_id > 20_000)
    assert kept["exact"] == sorted([(0, "own0"), (0, item.split()[0]), (0, "other0"), (20_001, "other0"), (0, "alone0")])
    assert kept["near"] == sorted([(0, "own0"), (0, item.split()[0]), (20_001, "other0"), (0, "alone0")])
    assert kept["decontaminated"] == [(0, "alone0"), (0, "own0"), (20_001, "other0")]
