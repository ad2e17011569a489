"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import ALNUM_WORDS, Words, map_arrow, small_batches, utf8

# labelled rows of each class that are fitted on; terms that may take part as they tell alone, and terms tried in pairs
PER_CLASS, MOST_TERMS, PAIRED_TERMS = 3000, 2048, 2048
_SLOTS = MOST_TERMS + PAIRED_TERMS
_HASH_BITS, _FACTORS = 40, 8


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts in order, and which text each is of."""
    words = Words(data, offsets, ALNUM_WORDS)
    return words.hashes >> np.uint64(64 - _HASH_BITS), words.text_of()


@dataclass
class Model:
    """score = logistic(bias + sum of weights of the terms present + sum over pairs of the inner products of their factors)."""

    terms: np.ndarray  # sorted hashes
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.likely = np.zeros(1 << 16, bool)  # most terms end here
        self.likely[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True

    def present(self, terms: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the term), each pair once."""
        maybe = np.flatnonzero(self.likely[(terms & np.uint64(0xFFFF)).astype(np.int64)])
        terms, text = terms[maybe], text[maybe]
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        hit = np.flatnonzero(self.terms[at] == terms) if len(self.terms) else np.zeros(0, np.int64)
        pairs = np.unique(text[hit] * _SLOTS + at[hit])
        return pairs // _SLOTS, pairs % _SLOTS

    def scores(self, n: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        linear = np.bincount(text, self.weights[term], n)
        sums = np.stack([np.bincount(text, self.factors[term, f], n) for f in range(_FACTORS)], axis=1)
        own = np.bincount(text, (self.factors[term] ** 2).sum(axis=1), n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((sums**2).sum(axis=1) - own) / 2, -40, 40)))


def _likelihood_ratio(seen: np.ndarray, total: np.ndarray) -> np.ndarray:
    """How far the labels of the texts with something are from those of all: ``seen`` and ``total`` by label in the last axis."""
    expected = seen.sum(axis=-1, keepdims=True) * total / max(total.sum(), 1)
    unseen, unexpected = total - seen, total - expected
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(seen > 0, seen * np.log(seen / expected), 0) + np.where(unseen > 0, unseen * np.log(unseen / unexpected), 0)).sum(axis=-1)


def _telling_terms(rows: list[np.ndarray], labels: np.ndarray, least_rows: int = 3, least_g: float = 12.0, pair_rows: int = 20, pair_g: float = 45.0) -> np.ndarray:
    """Terms that depend on the label alone, the strongest ``MOST_TERMS``, and terms that only do so beside another one.

    The latter are looked for among the ``PAIRED_TERMS`` most frequent of all others, all of their pairs at once: a pair counts if the
    texts that hold both are far from the labels of all. The threshold is beyond what chance gives among that many pairs.
    """
    terms, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *rows]), return_inverse=True)
    of = np.repeat(labels, [len(r) for r in rows])
    seen = np.stack([np.bincount(inverse[of == c], minlength=len(terms)) for c in (0, 1)], axis=1).astype(float)
    total = np.array([(labels == 0).sum(), (labels == 1).sum()], float)
    g, often = _likelihood_ratio(seen, total), seen.sum(axis=1)
    good = np.flatnonzero((often >= least_rows) & (g >= least_g))
    alone = good[np.argsort(-g[good], kind="stable")][:MOST_TERMS]
    rest = np.flatnonzero(often >= pair_rows)
    rest = np.setdiff1d(rest, good)
    rest = np.sort(rest[np.argsort(-often[rest], kind="stable")][:PAIRED_TERMS])
    if len(rest) < 2:
        return np.sort(terms[alone])
    place = np.full(len(terms), -1)
    place[rest] = np.arange(len(rest))
    text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    x = np.zeros((len(rows), len(rest)), np.float32)
    x[text[place[inverse] >= 0], place[inverse][place[inverse] >= 0]] = 1
    both = [x[labels == c].T @ x[labels == c] for c in (0, 1)]
    telling = np.zeros(len(rest), bool)
    for low in range(0, len(rest), 256):
        together = np.stack([b[low : low + 256] for b in both], axis=-1).astype(float)
        far = (_likelihood_ratio(together, total) >= pair_g) & (together.sum(axis=-1) >= pair_rows)
        far[np.arange(far.shape[0]), low + np.arange(far.shape[0])] = False
        telling[low : low + 256] |= far.any(axis=1)
    return np.sort(terms[np.concatenate([alone, rest[telling]])])


def fit(rows: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, steps: int = 400, ridge: float = 1e-5, seed: int = 3) -> Model:
    """Adam on the weighted logistic loss; ``rows`` hold each text's distinct terms."""
    terms = _telling_terms(rows, labels)
    rng, m = np.random.default_rng(seed), len(terms)
    share = float(np.clip((weight * labels).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3)) if len(labels) else 0.5
    model = Model(terms, float(np.log(share / (1 - share))), np.zeros(m), rng.normal(0, 0.02, (m, _FACTORS)))
    if not m or labels.min() == labels.max():
        return model
    x = np.zeros((len(rows), m), np.float32)
    for i, row in enumerate(rows):
        at = np.minimum(np.searchsorted(terms, row), m - 1)
        x[i, at[terms[at] == row]] = 1
    wish, pull = labels.astype(float), weight / weight.sum()
    values = [np.array([model.bias]), model.weights, model.factors]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, steps + 1):
        bias, w, v = values
        sums, v32 = x @ v.astype(np.float32), v.astype(np.float32)
        z = bias[0] + x @ w.astype(np.float32) + ((sums**2).sum(axis=1) - x @ (v32**2).sum(axis=1)) / 2
        error = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - wish) * pull).astype(np.float32)
        pulled = x.T @ error
        slopes = [np.array([error.sum()]), pulled + ridge * w, x.T @ (error[:, None] * sums) - pulled[:, None] * v + ridge * v]
        for value, slope, (first, second) in zip(values, slopes, moments):
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            value -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.bias = float(values[0][0])
    return model


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fits on about ``per_class`` labelled texts of each class, picked by a hash of the id; texts are read whole.

    The picked ids, bounded by that number, are broadcast to the documents, whose texts therefore never move. Of several labels
    of one id the highest counts; null labels and ids are left out. Each class keeps its share among all labels by weight.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("_label"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}  # two rows at most
    scale = 1 << 30
    rate = F.create_map(*[F.lit(x) for c in (0, 1) for x in (c, int(min(1.0, per_class / max(1, counts.get(c, 0))) * scale))])
    picked = known.where(F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit(5)), F.lit(scale)) < rate[F.col("_label")])
    rows = docs.where(F.col(text_column).isNotNull()).join(F.broadcast(picked), F.col(id_column) == F.col("_id")).select("_id", "_label", text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            terms, text = _terms(data, offsets)
            cuts = np.searchsorted(text, np.arange(len(offsets)))
            own = [np.unique(terms[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary())], names=["id", "label", "terms"])

    kind = dict(known.dtypes)["_id"]
    # of the texts of a repeated id one is fitted on, so the rows are bounded like the ids
    one = map_arrow(rows, run, f"id {kind}, label int, terms binary").groupBy("id", "label").agg(F.min("terms").alias("terms"))
    got = sorted((str(r[0]), r[1], bytes(r[2])) for r in one.collect())
    label = np.array([g[1] for g in got], np.int64)
    picked_of = np.bincount(label, minlength=2) if len(label) else np.ones(2)
    weight = np.array([counts.get(c, 0) / max(1, picked_of[c]) for c in (0, 1)])[label] if len(label) else np.zeros(0)
    return fit([np.frombuffer(g[2], np.uint64) for g in got], label, weight)


def score(docs: DataFrame, model: Model, keep: list[Column | str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` with score, 0 to 1. Null and empty texts get the score of a text without any known term."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.num_rows, *model.present(*_terms(*utf8(batch.column(len(names))))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*names, "score"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{fields}score double")
