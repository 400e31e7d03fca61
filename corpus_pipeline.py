"""From raw documents to token ids: the stages of a training corpus.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm import bpe, decontaminate, language, near_dedup, suffix_dedup
from provenir.llm.common import free_name, settle

# A document whose likeliest language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
# Bytes of a passage that is taken out where it repeats. Any passage of over 50 words has as
# many, however short they are; shorter notices and set phrases stay.
PASSAGE_BYTES = 100


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter and unsure ones go.

    Learned from the documents that have a language; where none has, nothing is judged and
    all stay. A null text has no letter. Each row is judged by itself, so repeated ones are
    alike; of equally likely languages the first by name counts.
    """
    model = language.train(docs)
    if not model.languages:
        return docs
    name = free_name(docs, "language_found")
    found = language.predict(docs, model, out=name)
    sure = (F.col(name)["lang"] != language.UNKNOWN) & (F.col(name)["score"] >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of rows with the same id, null or not, and the same text one is left. Other rows of one
    id stay together. Null and empty texts are near to nothing, and so are null ids.
    """
    docs = near_dedup.drop_repeated_rows(docs)
    return near_dedup.keep_one(docs, near_dedup.near_duplicates(docs, words=5, percent=80))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in a document with a smaller id.

    Every document stays, if with less text; ``n_chars`` follows the text. A null text
    comes out empty. Rows of one id take nothing from each other; a null id comes last.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.remove_repeats(docs, threshold=PASSAGE_BYTES, keep=others, as_text=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return cut.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item.

    Nor all words of a shorter item. A null text has no words and stays; each row is judged
    by itself.
    """
    name = free_name(docs, "benchmark_hits")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_benchmark(docs, benchmark, width=10, out=name)
    return found.where(F.size(F.col(name)["spans"]) == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and a digest of what they decode to.

    A row for every row; a null or empty text has no ids.
    """
    vocabulary = bpe.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = bpe.encode(docs, vocabulary, decoded="decoded")
    return tokens.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", remove_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

# No SQL expresses models, tokenizers and signatures; tests/llm holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from where it was written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = settle(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
