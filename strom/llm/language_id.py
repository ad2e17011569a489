"""Language by error-correcting output codes over character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strom.llm.shared import blocks, give_back, map_arrow, small_batches, utf8

_BUCKETS, _CODES = 4096, 96
FEATURES = _BUCKETS + _CODES
UNDETERMINED = "und"
# labelled rows that are fitted on, per language and in all
PER_LANGUAGE, MOST_ROWS, MOST_LANGUAGES = 400, 4000, 4000


def _letter_codes() -> np.ndarray:
    """a-z and A-Z as 1 to 26, bytes beyond ASCII as 27 to 90 by their low bits, all else 0."""
    table = np.zeros(256, np.uint32)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[128:] = 27 + (np.arange(128) & 63)
    return table


_TABLE = _letter_codes()


def profiles(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per text the shares of its letters and hashed trigrams, square-rooted, with length 1."""
    n = len(offsets) - 1
    codes = _TABLE[data]
    text = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, FEATURES), np.float32)
    counts = np.bincount(text * _CODES + codes, minlength=n * _CODES).reshape(n, _CODES)
    out[:, _BUCKETS:] = counts
    out[:, _BUCKETS] = 0
    if len(data) > 2:
        grams = (codes[:-2] * np.uint32(8281) + codes[1:-1] * np.uint32(91) + codes[2:]) * np.uint32(2654435761) >> np.uint32(20)
        good = (text[:-2] == text[2:]) & (codes[1:-1] > 0)
        out[:, :_BUCKETS] = np.bincount(text[:-2][good] * _BUCKETS + grams[good], minlength=n * _BUCKETS).reshape(n, _BUCKETS)
    for part in (out[:, :_BUCKETS], out[:, _BUCKETS:]):
        np.sqrt(part / np.maximum(part.sum(axis=1, keepdims=True), 1), out=part)
    return out * np.float32(np.sqrt(0.5))


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    codes = _TABLE[data]
    upto = np.concatenate(([0], np.cumsum((codes > 0) & (codes < 27))))
    ascii_letter = upto[offsets[1:]] > upto[offsets[:-1]]
    out = ascii_letter.copy()
    for i in np.flatnonzero(~ascii_letter):  # few: no ASCII letter at all
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """A word of +1 and -1 for each class: every split of the classes if they are five at most, else the best of some random codes."""
    if n < 2:
        return np.ones((n, 0), np.float32)
    if n <= 5:
        splits = np.arange(1, 1 << (n - 1))
        return np.array([[-1 if i and splits_bit >> (i - 1) & 1 else 1 for splits_bit in splits] for i in range(n)], np.float32)
    rng = np.random.default_rng(n)
    best, distance = None, -1
    for _ in range(20):
        code = rng.choice(np.array([-1, 1], np.float32), (n, int(np.ceil(10 * np.log2(n)))))
        closest = ((code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]).min()
        if closest > distance:
            best, distance = code, closest
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # feature x bit
    bias: np.ndarray
    trust: np.ndarray  # of each bit: how well it does on the rows it was fitted on

    def decode(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword by weighted logistic loss, its share among all, and whether the runner-up is about as near."""
        if not self.languages:
            return np.full(len(features), -1), np.zeros(len(features)), np.ones(len(features), bool)
        if not self.code.shape[1]:
            return np.zeros(len(features), np.int64), np.ones(len(features)), np.zeros(len(features), bool)
        margins = features @ self.weights + self.bias
        right, wrong = np.logaddexp(0, -3 * margins) * self.trust, np.logaddexp(0, 3 * margins) * self.trust
        loss = right @ (self.code.T > 0).astype(np.float32) + wrong @ (self.code.T < 0).astype(np.float32)
        order = np.sort(loss, axis=1)
        share = 1 / np.exp(order[:, :1] - loss).sum(axis=1)
        return loss.argmin(axis=1), np.clip(share, 0, 1), order[:, 1] - order[:, 0] < 0.2 * self.trust.mean()


def fit(features: np.ndarray, labels: np.ndarray, languages: list[str], ridge: float = 0.3) -> Model:
    """One ridge classifier per bit, all solved at once over the rows' inner products."""
    code = codewords(len(languages))
    if not len(features) or not code.shape[1]:
        bits = code.shape[1]
        return Model(languages, code, np.zeros((FEATURES, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits, np.float32))
    share = np.bincount(labels, minlength=len(languages)).astype(np.float64)
    weight = (1 / share[labels]) / (1 / share[labels]).mean()  # languages count alike
    wanted, root = code[labels], np.sqrt(weight).astype(np.float32)[:, None]
    scaled = features * root  # the bias is one more feature, always 1
    inner = (scaled @ scaled.T + root @ root.T).astype(np.float64)
    inner[np.diag_indices(len(inner))] += ridge
    solved = np.linalg.solve(inner, (wanted * root).astype(np.float64)).astype(np.float32)
    weights, bias = scaled.T @ solved, (root.T @ solved)[0]
    right = ((features @ weights + bias) * wanted > 0).mean(axis=0)
    return Model(languages, code, weights, bias, np.maximum(2 * right - 1, 0.05).astype(np.float32))


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang",
          per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Fits on about ``per_language`` different texts of each language, ``most_rows`` in all, picked by a hash of the text; they are read whole.

    Ids play no part, so rows without one or with a repeated one are drawn like others, and copies of a text are fitted on once.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    rows = rows.select(F.col(label_column).alias("_lang"), F.col(text_column).alias("_text"), F.xxhash64(F.col(text_column), F.lit(11)).alias("_hash"))
    counts = rows.groupBy("_lang").agg(F.approx_count_distinct("_hash")).orderBy("_lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r[0] for r in counts]
    wanted = min(per_language, most_rows // max(1, len(languages)))
    spark, scale = labelled.sparkSession, 1 << 30
    rates = spark.createDataFrame([(r[0], int(min(1.0, wanted / max(1, r[1])) * scale)) for r in counts], "_of string, _rate long")
    chosen = rows.join(F.broadcast(rates), F.col("_lang") == F.col("_of")).where(F.pmod("_hash", F.lit(scale)) < F.col("_rate"))
    chosen = chosen.groupBy("_lang", "_hash").agg(F.min("_text").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets, 1 << 20, 256):
                x = profiles(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sorted((r[0], bytes(r[1])) for r in map_arrow(chosen.select("_lang", "_text"), run, "lang string, x binary").collect())
    number = {name: i for i, name in enumerate(languages)}
    x = np.frombuffer(b"".join(v for _, v in got), np.float16).reshape(-1, FEATURES).astype(np.float32)
    named = np.array([number[name] for name, _ in got], np.int64)
    del got
    model = fit(x, named, languages)
    del x
    give_back()
    return model


def _predicted(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, class or -1, score, ambiguous) block by block."""
    data, offsets = utf8(texts)
    for low, high in blocks(offsets, 1 << 20, 256):
        part, at = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        best, score, close = model.decode(profiles(part, at))
        known = has_letter(part, at) & (best >= 0)
        yield low, high, np.where(known, best, -1), np.where(known, score, 0.0), close | ~known


def predict(docs: DataFrame, model: Model, keep: list[Column | str], text_column: str = "text") -> DataFrame:
    """The columns ``keep`` with lang_pred, score and ambiguous. Null texts and texts without a letter are ``und`` with score 0."""
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, F.col(text_column).alias("_text"))
    names = [f.name for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, best, score, close in _predicted(model, batch.column(len(names))):
                said = [model.languages[b] if b >= 0 else UNDETERMINED for b in best]
                arrays = [batch.column(i).slice(low, high - low) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(said, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_arrow(rows, run, f"{fields}lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is told without ambiguity."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [best >= 0 and not c for _, _, found, _, close in _predicted(model, batch.column(place)) for best, c in zip(found, close)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_arrow(docs, run, docs.schema)
