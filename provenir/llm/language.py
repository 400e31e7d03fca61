"""Language identification: sparse multinomial logistic regression on character n-grams.

A text becomes the TF-IDF vector of its hashed character n-grams of one to three
characters, of length one. The regression is trained by follow-the-regularised-leader
with elastic-net penalties, which leave most weights at zero, and a temperature is
fitted on rows held back from training, so that scores are probabilities.

Plan: document frequencies are summed over all training rows, a dense vector of
``FEATURES`` per task. The regression learns from a bounded sample, about
``SAMPLE_PER_LANGUAGE`` rows of each language, chosen by a hash of the id. Prediction
is one pass without a shuffle; what is broadcast has a size set by ``FEATURES`` and
the number of languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import each_text, give_back, giving_back, share

FEATURES = 1 << 15
SAMPLE_PER_LANGUAGE = 1500
# Follow-the-regularised-leader: learning rate and its offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
EPOCHS = 3
PIECE = 1 << 17
UNKNOWN = "und"


def _grams(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, lower-cased, blanks as one space."""
    counts = np.zeros(FEATURES, np.int64)
    text = " " + " ".join(text.lower().split()) + " "
    for at in range(0, max(1, len(text) - 2), PIECE):
        # Pieces overlap by two characters; every n-gram is counted in the piece it starts in.
        codes = np.frombuffer(text[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        first = codes[:PIECE] if at + PIECE < len(text) - 2 else codes
        one = first * np.uint32(0x9E3779B1)
        counts += np.bincount(one >> np.uint32(17), minlength=FEATURES)
        if len(codes) > 1:
            two = (codes[:-1] * np.uint32(0x85EBCA6B) ^ codes[1:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
            counts += np.bincount(two[: len(first)] >> np.uint32(17), minlength=FEATURES)
        if len(codes) > 2:
            three = codes[:-2] * np.uint32(0x165667B1) ^ codes[1:-1] * np.uint32(0xD3A2646D) ^ codes[2:] * np.uint32(0xFD7046C5)
            three = (three ^ three >> np.uint32(15)) * np.uint32(0xB55A4F09)
            counts += np.bincount(three >> np.uint32(17), minlength=FEATURES)
    return counts


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # one row a feature, the last one the bias
    temperature: float

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        value = np.log1p(counts[at]) * self.idf[at]
        length = np.sqrt((value * value).sum())
        return at, value / length if length else value

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _has_letter(text):
            return UNKNOWN, 0.0
        at, value = self.vector(_grams(text))
        z = (value @ self.weights[at] + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        best = int(z.argmax())
        return self.languages[best], float(p[best] / p.sum())


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts."""

    @giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in each_text(batch.column("text")):
                total += _grams(text) > 0
                n += 1
        at = np.flatnonzero(total)
        yield pa.record_batch({"feature": pa.array(np.r_[at, -1], pa.int64()), "n": pa.array(np.r_[total[at], n], pa.int64())})

    found = rows.select("text").mapInArrow(count, "feature long, n long")
    found = found.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(FEATURES, np.int64)
    real = found[found.feature >= 0]
    df[real.feature.to_numpy()] = real.n.to_numpy()
    return df, int(found[found.feature < 0].n.sum())


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int) -> np.ndarray:
    """Weights after ``EPOCHS`` passes; each coordinate has a rate of its own."""
    z = np.zeros((FEATURES + 1, n_languages))
    seen = np.zeros((FEATURES + 1, n_languages))

    def weights(at) -> np.ndarray:
        shrunk = np.sign(z[at]) * L1 - z[at]
        return np.where(np.abs(z[at]) <= L1, 0.0, shrunk / ((BETA + np.sqrt(seen[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, value, label in rows:
            at, value = np.r_[at, FEATURES], np.r_[value, 0.1]
            w = weights(at)
            error = _softmax(value @ w)
            error[label] -= 1
            gradient = value[:, None] * error
            squared = gradient * gradient
            sigma = (np.sqrt(seen[at] + squared) - np.sqrt(seen[at])) / ALPHA
            z[at] += gradient - sigma * w
            seen[at] += squared
    out = weights(slice(None))
    out[-1] *= 0.1
    return out


def _fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(
    docs: DataFrame,
    trainable: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """A model from the rows of ``docs`` with text and language for which ``trainable`` holds.

    Document frequencies cover all those rows; weights and temperature come from about
    ``SAMPLE_PER_LANGUAGE`` rows of each language. A row in five of the sample is held
    back for the temperature. Without rows the model knows no language.
    """
    rows = docs.where(trainable) if trainable is not None else docs
    text, lang = rows[text_col].cast("string"), rows[lang_col].cast("string")
    rows = rows.select(rows[id_col].cast("string").alias("id"), text.alias("text"), lang.alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0)), 1.0)
    df, n = _frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1

    wanted = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, SAMPLE_PER_LANGUAGE / v))))
    chance = share(F.coalesce("id", F.lit("")))
    sample = rows.where(chance < wanted[F.col("lang")]).select("id", "lang", "text")

    @giving_back
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in each_text(batch.column("text")):
                counts = _grams(text)
                at = np.flatnonzero(counts)
                out.append((at.astype(np.uint16).tobytes(), counts[at].astype(np.uint32).tobytes()))
            yield pa.record_batch(
                {
                    "id": batch.column("id"),
                    "lang": batch.column("lang"),
                    "at": pa.array([a for a, _ in out], pa.binary()),
                    "counts": pa.array([c for _, c in out], pa.binary()),
                }
            )

    found = sample.mapInArrow(vectors, "id string, lang string, at binary, counts binary").withColumn("order", F.xxhash64("id"))
    # One pass over the sample in an order that its rows alone decide.
    found = sorted(found.collect(), key=lambda r: (r["order"], r["id"] or "", r["at"]))
    model = LanguageModel(languages, idf, np.zeros((FEATURES + 1, len(languages))), 1.0)
    data = []
    for row in found:
        counts = np.zeros(FEATURES, np.int64)
        counts[np.frombuffer(row["at"], np.uint16)] = np.frombuffer(row["counts"], np.uint32)
        data.append((*model.vector(counts), languages.index(row["lang"])))
    learn, held = [d for i, d in enumerate(data) if i % 5 or len(data) < 50], data[::5]
    weights = _follow_leader(learn, len(languages))
    logits = np.array([value @ weights[at] + weights[-1] for at, value, _ in held])
    temperature = _fit_temperature(logits, np.array([label for _, _, label in held], np.int64))
    return LanguageModel(languages, idf, weights, temperature)


def predict(docs: DataFrame, model: LanguageModel, out: str = "language", text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``out`` with the predicted language and its probability.

    ``und`` and 0 for a text that is null or has no letter, and for a model without
    languages. Only the text is looked at, the whole of it; rows are independent, so
    repeated rows are alike. An empty table gives no rows. A column of the name
    ``out`` raises.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        found = [shared.value.predict(text) for text in each_text(texts)]
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
            names=["lang", "score"],
        )

    return docs.withColumn(out, F.arrow_udf(judge, "struct<lang: string, score: double>")(docs[text_col].cast("string")))
