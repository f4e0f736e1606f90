"""Training-data pipeline over ``documents``: five stages, each one of the operators in ``skyloom.llm``.

Every stage but the last returns the columns of its input.  Stages decide about rows, not about
ids: a doc_id may be NULL or stand on several texts.
"""

from __future__ import annotations

import os
import sys

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyloom.llm import decontaminate, language_id, packing, secret_scan  # noqa: E402
from skyloom.llm.ngram_join import jaccard_components  # noqa: E402
from skyloom.llm.scratch import Scratch  # noqa: E402
from skyloom.session import tune  # noqa: E402

MIXED = 0.5  # a text with no language for at least half of its letters is rejected
MARK = "[SECRET]"


def _beside_text(docs: DataFrame):
    """All columns but the text as one: whatever they are called, they meet no name of an operator's."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")


def _numbered(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, written once so that every later reading sees the same numbers, and that column's name."""
    name = "row_number"
    while name in docs.columns:
        name += "_"
    return Scratch(spark).put(docs.withColumn(name, F.monotonically_increasing_id())), name


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter or without a main language go; the others stay, with the language found.

    NULL and empty texts have no letter; a NULL doc_id, repeated rows and long texts are judged like any other.
    """
    tune(spark)
    model = language_id.train(docs.select("text", "lang"))
    found = language_id.identify(docs.select("text", _beside_text(docs)), model, ["row"], with_text=True)
    kept = found.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIXED))
    now = {"text": F.col("text"), "lang": F.col("lang_pred")}
    return kept.select(*[now.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows that Jaccard links reach, the one with the smallest doc_id stays (NULL comes last, then any one of equals).

    A repeated row stays once; texts without a word link with nothing and stay all; different
    texts under one doc_id are different documents.
    """
    tune(spark)
    rows, number = _numbered(spark, docs)
    found = jaccard_components(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias(number), "component_id")
    placed = found.join(rows.select(number, F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col(number).alias("c")).alias("_place")), number)
    first = placed.groupBy("component_id").agg(F.min("_place.c").alias("_lowest"), F.min("_place").alias("_first"), F.max("_place.c").alias("_highest"))
    # Rows that nothing links with need no second look.
    first = first.filter("_lowest <> _highest").select("component_id", F.col("_first.c").alias("_stays"))
    others = placed.join(first, "component_id").filter(F.col(number) != F.col("_stays")).select(number)
    return rows.join(others, number, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go; NULL and empty texts hold none, repeated rows go together."""
    tune(spark)
    rows, number = _numbered(spark, docs)
    found = decontaminate.contaminated(rows.select(F.col(number).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(found.select(F.col("doc_id").alias(number)).distinct(), number, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all rows stay, NULL texts as NULL."""
    tune(spark)
    found = secret_scan.scan(docs.select("text", _beside_text(docs)), secret_scan.train(docs), ["row"], redact=MARK)
    now = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.size("spans") > 0, F.length("redacted").cast("long")).otherwise(F.col("row.n_chars"))
    return found.select(*[(now[c] if c in now else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and where they lie in sequences of 2048; a NULL text is its end mark alone."""
    tune(spark)
    return packing.pack(docs, str(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

# Language models, hashed digests and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
    return docs
