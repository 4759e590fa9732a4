"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become hashed counts of the 1- to 3-character n-grams of their lower-cased code points, weighted by (1 + log tf) * idf
and scaled to length 1. Document frequencies are counted by Spark over all training documents. The weights are fitted on a bounded,
hash-drawn sample of them (SAMPLE_PER_CLASS documents of each language) by follow-the-regularised-leader with an
elastic-net penalty; then one temperature is fitted on sample documents held back from the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorewright.llm.common import small_batches, text_key, worker_tables

FEATURES = 1 << 15
#: The bound of the fitting sample.
SAMPLE_PER_CLASS = 1500
#: Slices in which each language's rows are ranked before they meet, so that no task takes all of a language.
SLICES = 64
EPOCHS = 4
#: Follow-the-regularised-leader: step size, its offset, L1 and L2 penalty.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.02
#: One sample document in so many is kept for the temperature.
CALIBRATION_SHARE = 5
UNDETERMINED = "und"
#: Texts that a task holds as Python strings.
ROWS_AT_ONCE = 500


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L is in the text; number signs and marks are none."""
    return any(map(str.isalpha, text))


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and counts of the text's hashed n-grams; a space stands before and after it."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] + np.uint32(1)
    grams = np.concatenate([c, pairs, pairs[:-1] * np.uint32(0x85EBCA77) + c[2:] + np.uint32(2)])
    slot = ((grams ^ (grams >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    n = np.bincount(slot, minlength=FEATURES)
    at = np.flatnonzero(n)
    return at, n[at]


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, n = counts(text)
    v = (1 + np.log(n)) * idf[at]
    return at, v / max(np.linalg.norm(v), 1e-12)


@dataclass
class Model:
    """Sparse weights (features x languages), idf and temperature; a few MB, whatever the corpus."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def logits(self, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and its probability; ``und`` with 0 for texts without letters and when no language was learned."""
        if not text or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.logits(*features(text, self.idf)) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and per feature the documents that have it. Each task adds up its own before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("language")
        df, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                for text in batch.column(0).slice(i, ROWS_AT_ONCE).to_pylist():
                    df[counts(text)[0]] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df[at].tolist(), n], pa.int64())], ["at", "n"])

    with small_batches(docs.sparkSession):
        rows = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    at, n = rows.column("at").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(FEATURES)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def _cuts(rows: DataFrame, n: int) -> DataFrame:
    """(lang, cut): the n-th smallest ``order`` of each language, or its largest; found in slices, and without texts."""
    for by in (["lang", F.pmod("order", F.lit(SLICES))], ["lang"]):
        rows = rows.select("lang", "order").withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("order"))).where(F.col("nth") <= n)
    return rows.groupBy("lang").agg(F.max("order").alias("cut"))


def fit(docs: DataFrame, training: Column, lang: str = "lang", sample_per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learns from rows of ``docs`` (doc_id, text, lang) where ``training`` holds, text has letters and lang is not null.

    Only the sample's sparse features (bounded by FEATURES each) and one number per feature come to the driver.
    """
    rows = docs.where(training & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", F.col(lang).alias("lang"))
    n, df = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    # rows of one id, or without, differ by their texts
    order = F.xxhash64(F.lit(6), F.col("doc_id"), text_key(F.col("text")))
    first = Window.partitionBy("lang").orderBy("order", "doc_id", text_key(F.col("text")))
    rows = rows.withColumn("order", order)
    sample = rows.join(F.broadcast(_cuts(rows, sample_per_class)), "lang").where("order <= cut").withColumn("rank", F.row_number().over(first))
    sample = sample.where(F.col("rank") <= sample_per_class).select("lang", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("language")
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                xs = [features(t, idf) for t in part.column("text").to_pylist()]
                bounds = pa.array(np.cumsum([0, *[len(x[0]) for x in xs]]), pa.int32())
                at, v = (np.concatenate([x[k] for x in xs]).astype(kind) for k, kind in ((0, np.int32), (1, np.float32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("rank"), pa.ListArray.from_arrays(bounds, pa.array(at)), pa.ListArray.from_arrays(bounds, pa.array(v))], ["lang", "rank", "at", "v"]
                )

    with small_batches(docs.sparkSession):
        table = sample.mapInArrow(run, "lang string, rank int, at array<int>, v array<float>").toArrow()
    names, ranks = table.column("lang").to_pylist(), table.column("rank").to_pylist()
    # one array of indexes and one of values; a row is a part of them
    at, v = (table.column(c).combine_chunks() for c in ("at", "v"))
    del table
    bounds = at.offsets.to_numpy()
    at, v = at.values.to_numpy(), v.values.to_numpy()
    order = sorted(range(len(names)), key=lambda i: (ranks[i], names[i]))
    xs = [(at[bounds[i] : bounds[i + 1]], v[bounds[i] : bounds[i + 1]]) for i in order]
    names, ranks = [names[i] for i in order], [ranks[i] for i in order]
    languages = sorted(set(names))
    ys = [languages.index(x) for x in names]
    kept_back = [r % CALIBRATION_SHARE == 0 for r in ranks]
    weights, bias = follow_the_leader([x for x, k in zip(xs, kept_back, strict=True) if not k], [y for y, k in zip(ys, kept_back, strict=True) if not k], len(languages))
    model = Model(languages, weights, bias, idf, 1.0)
    if any(kept_back) and len(languages) > 1:
        z = np.array([model.logits(*x) for x, k in zip(xs, kept_back, strict=True) if k])
        model.temperature = temperature(z, np.array([y for y, k in zip(ys, kept_back, strict=True) if k]))
    return model


def follow_the_leader(xs: list[tuple[np.ndarray, np.ndarray]], ys: list[int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Proximal form: per coordinate a sum of gradients and of squares, from which the weight follows in closed form."""
    z, s = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, (np.sign(z[at]) * L1 - z[at]) / ((BETA + np.sqrt(s[at])) / ALPHA + L2))

    rng = np.random.default_rng(6)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(xs)):
            at, v = np.append(xs[i][0], FEATURES), np.append(xs[i][1], 1.0)  # the last feature is the bias
            w = weights(at)
            p = softmax(v @ w)
            p[ys[i]] -= 1
            g = v[:, None] * p
            squares = s[at] + g * g
            z[at] += g - (np.sqrt(squares) - np.sqrt(s[at])) / ALPHA * w
            s[at] = squares
    w = weights(slice(None))
    return w[:FEATURES], w[FEATURES]


def temperature(logits: np.ndarray, ys: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(ys)), ys], 1e-12)).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) behind its columns; only ``text`` is looked at.

    Null, empty and letterless texts get ``und`` and 0. An empty table gives an empty one; columns of these names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept], "lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_tables("language")
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                found = [own.predict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in kept], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """Fits on ``docs`` and predicts all of them; ``training`` defaults to the rows that are not held out.

    Adds ``held_out, lang_pred, score``. With no labelled row every prediction is ``und``.
    """
    model = fit(docs, ~held_out(F.col("doc_id")) if training is None else training)
    out = predict(docs, model)
    return out.withColumn("held_out", held_out(F.col("doc_id")))
