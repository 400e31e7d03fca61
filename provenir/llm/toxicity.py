"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lower-cases, writes letters that look alike as one, drops marks, and reads
digits and signs inside a word as the letters they stand for. The lexicon holds words
and beginnings of words with weights, learned from labelled documents: the log of how
much more often a toxic document has the term. A term inside an exception phrase does
not count. The weights found are normalised by length, and a logistic regression on
them gives the score.

Plan: terms and regression are learned from a bounded sample of labelled rows, about
``SAMPLE`` of them. Scoring is one pass without a shuffle; the lexicon that is broadcast
has at most ``MAX_TERMS`` terms.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.llm.common import bounded, settle, share

SAMPLE = 20_000
MAX_TERMS = 5_000
MIN_SHARE, MIN_DOCS, MIN_WEIGHT = 0.005, 4, 3.0
PREFIXES = range(4, 9)
EXCEPTIONS = ("clown fish", "idiot proof", "white trash", "trash can", "trash bin", "sore loser rule")

# Letters of other scripts that look like Latin ones, and signs read as letters.
HOMOGLYPHS = "аaбbвbгrеeзeіiіiјjкkмmнhоoрpсcтtуyхxѕsԁdɡgΑaαaΒbβbΕeεeΗhΙiιiΚkκkΜmΝnνvΟoοoΡpρpΤtτtΥyυuΧxχxıiłløo"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_ALIKE = str.maketrans(dict(zip(HOMOGLYPHS[::2], HOMOGLYPHS[1::2], strict=True)))
_AS_LETTERS = str.maketrans(SUBSTITUTES)
# From the start of a word only, so that a long word is looked at once.
_MIXED = re.compile(r"(?<![^\W_])[^\W_]*[013457@$!8]+[^\W_](?:[^\W_]|[@$!])*")
_BETWEEN = re.compile(r"[\W_]+")


def _as_word(match: re.Match) -> str:
    found = match.group()
    return found.translate(_AS_LETTERS) if any(map(str.isalpha, found)) else found


def fold(text: str) -> str:
    """The folded words of a text, one space around each."""
    text = text.lower()
    if not text.isascii():
        text = text.translate(_ALIKE)
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    if any(c in text for c in SUBSTITUTES):
        text = _MIXED.sub(_as_word, text)
    return f" {_BETWEEN.sub(' ', text).strip()} "


def _terms(folded: str) -> set[str]:
    """Words as ``' word '`` and their beginnings as ``' begin'``."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in PREFIXES:
        out.update(f" {w[:n]}" for w in words if len(w) >= n)
    return out


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    exceptions: tuple[str, ...]
    coefficients: np.ndarray = field(default_factory=lambda: np.array([-3.0, 0.0, 0.0]))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    def _automaton(self):
        if "automaton" not in self.__dict__:
            automaton = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                automaton.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                folded = fold(phrase)
                if folded.strip():
                    automaton.add_word(folded, (len(folded), None))
            automaton.make_automaton()
            self.automaton = automaton
        return self.automaton

    def features(self, text: str | None) -> tuple[float, float]:
        """Weight found, as a logarithm, and weight per 100 words, as a logarithm."""
        folded = fold(text or "")
        automaton = self._automaton()
        hits, excepted = [], []
        if len(automaton):
            for end, (length, weight) in automaton.iter(folded):
                (excepted if weight is None else hits).append((end + 1 - length, end, weight))
        # How far the phrases that begin up to a place reach, so that no hit looks at every phrase.
        excepted.sort(key=lambda e: e[0])
        begins, reach = [a for a, *_ in excepted], [*accumulate((b for _, b, _ in excepted), max)]
        best: dict[int, float] = {}  # one term counts for each beginning of a word
        for begin, end, weight in hits:
            before = bisect_right(begins, begin)
            if not before or reach[before - 1] < end:
                best[begin] = max(best.get(begin, 0.0), weight)
        total = sum(best.values())
        return float(np.log1p(total)), float(np.log1p(100 * total / max(1, folded.count(" ") - 1)))

    def score(self, text: str | None) -> float:
        z = float(self.coefficients @ np.array([1.0, *self.features(text)]))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _counted(rows: DataFrame, candidates) -> DataFrame:
    """``term, n``: in how many texts each term occurs, of ``candidates`` only if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found = _terms(fold(text))
                counts.update(found & candidates.value if candidates else found)
        yield pa.record_batch({"term": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method with a small penalty."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return w


def train(
    docs: DataFrame,
    labels: DataFrame,
    trainable: Column | None = None,
    exceptions: tuple[str, ...] = EXCEPTIONS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """A model from rows of ``labels`` for which ``trainable`` holds and their texts.

    Null labels, ids and texts are left out; of several labels of an id the largest
    counts. Without toxic or without other rows the lexicon is empty and every text
    has the same low score.
    """
    rows = labels.where(trainable) if trainable is not None else labels
    rows = rows.select(rows[id_col].cast("long").alias("node"), rows[label_col].cast("int").alias("label"))
    rows = rows.where("node is not null and label is not null").groupBy("node").agg(F.max("label").alias("label"))
    n = rows.count()
    rows = settle(rows.where(share(F.col("node")) < min(1.0, SAMPLE / max(1, n))), "toxic-sample")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sample = texts.join(bounded(rows), texts["doc_id"] == rows["node"]).where("text is not null")
    sample = settle(sample.select("doc_id", "text", "label"), "toxic-texts")

    sc = docs.sparkSession.sparkContext
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sum(v for k, v in sizes.items() if k != 1)
    if not n_toxic or not n_clean:
        return ToxicityModel({}, exceptions)
    often = max(MIN_DOCS, MIN_SHARE * n_toxic)
    toxic = {r["term"]: r["n"] for r in _counted(sample.where("label = 1"), None).where(F.col("n") >= often).collect()}
    clean = {r["term"]: r["n"] for r in _counted(sample.where("label <> 1"), sc.broadcast(set(toxic))).collect()}
    odds = {t: np.log((k + 0.5) / (n_toxic + 1) / ((clean.get(t, 0) + 0.5) / (n_clean + 1))) for t, k in toxic.items()}
    weights: dict[str, float] = {}
    for term in sorted((t for t, w in odds.items() if w >= MIN_WEIGHT), key=lambda t: (len(t), t)):
        # The beginning of a word stands for its longer forms unless they tell more.
        if not any(weights.get(term[:n], 0.0) >= odds[term] - 1 for n in range(2, len(term))):
            weights[term] = float(odds[term])
    weights = dict(sorted(weights.items(), key=lambda x: (-toxic[x[0]], x[0]))[:MAX_TERMS])

    model = ToxicityModel(weights, exceptions)
    shared = sc.broadcast(model)

    def measure(texts: pa.Array) -> pa.Array:
        found = [shared.value.features(t) for t in texts.to_pylist()]
        return pa.array([list(f) for f in found], pa.list_(pa.float64()))

    found = sample.select("label", F.arrow_udf(measure, "array<double>")("text").alias("x")).collect()
    model.coefficients = _logistic(np.array([r["x"] for r in found]), np.array([float(r["label"] == 1) for r in found]))
    return model


def score(docs: DataFrame, model: ToxicityModel, out: str = "toxicity", text_col: str = "text") -> DataFrame:
    """``docs`` and a column ``out`` with a score from 0 to 1 for each whole text.

    Null and empty texts have the score of a text without terms. Rows are independent,
    so repeated rows are alike; an empty table gives no rows. A column ``out`` raises.
    """
    if out in docs.columns:
        raise ValueError(f"there is a column {out} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t) for t in texts.to_pylist()], pa.float64())

    return docs.withColumn(out, F.arrow_udf(judge, "double")(docs[text_col].cast("string")))
