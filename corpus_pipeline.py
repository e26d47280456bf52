"""The corpus pipeline: documents (doc_id, text, lang, source, n_chars) to packed sequences.

Each stage takes what the one before kept, and its decisions take effect. All take null
ids, texts and sources, empty texts, repeated rows and empty tables, as their operators
state; a stage reads the columns of documents only, and all but the last return them.

1. language ID learns from the documents that are not held out and rejects texts
   without a letter, or with no language that makes up a third of them;
2. the n-gram Jaccard join keeps one document of each near-duplicate component, that
   with the smallest doc_id (of texts that share it, the one with the smallest hash);
3. the secret scan replaces secrets by a mark;
4. mixing repeats or leaves out documents so that sources meet their target weights;
5. packing tokenises them and cuts them into windows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texspark.llm import language_id, mixing, near_duplicates, packing, secret_scan
from texspark.llm.common import saved, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language that makes up a third of the text; lang is filled in where it is null.

    If no row names a language, nothing is learned and all documents stay.
    """
    docs = docs.select(*COLUMNS)
    languages, model = language_id.trained(language_id.held_out(docs).where("not held_out"))
    if not languages:
        return docs
    judged = language_id.identify(docs, languages, model).where("lang_pred <> 'und' and score >= 1 / 3")
    return judged.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that leads its component; of repeated rows (the same id and text), one. Documents without words lead."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicates.similar(docs).where("leads").select("doc_id", "key").distinct()
    keyed = docs.withColumn("_key", F.xxhash64("text"))
    return keyed.join(kept, keyed.doc_id.eqNullSafe(kept.doc_id) & (keyed["_key"] == kept.key), "left_semi").dropDuplicates(["doc_id", "_key"]).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts, and count their characters again."""
    return secret_scan.redacted(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix takes it."""
    mixed = mixing.mix(docs.select(*COLUMNS)).where("times > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), packing.PATTERN, added=packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicate),
    ("secrets", secrets),
    ("mixing", mixture),
    ("packing", packed),
]

#: Language models, links and token windows can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run()'s pieces, with a digest of each piece's ids."""
    return packing.digest(run(spark, sf_dir))
