"""A training corpus from documents: each stage works on all that the one before has kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents. What holds
for all of them: columns other than doc_id, text and lang may have any name and any nulls, and are kept as they are (the
last stage drops them). Texts of any length are whole. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxeval.llm import bpe, exact_dedup, langid, packing, pii, simhash
from taxeval.llm.common import materialize, table
from taxeval.operators.durable import remove_written, written_so_far


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay. Null and empty texts and texts without letters go; null ids and null
    languages are no reason to go; repeated rows stay or go together."""
    return langid.drop_unknown(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the document with the largest id stays; null ids lose, and of repeated rows one
    stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a Jaccard similarity of 0.8 or more of their five-word shingles, the one with
    the smallest id stays; null ids give way, texts without words (null: empty) are alike, and repeated rows of the one
    that stays all stay."""
    return simhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to surrogates under the key that spark.taxeval.pii.key holds (a random one for the
    session, where it is unset). All rows stay; null and empty texts stay as they are; repeated rows get equal texts."""
    return pii.pseudonymize(docs, pii.session_key(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenized documents, in sequences of at most 1024 tokens. Null texts count as empty, one piece of
    the end token; null ids and repeated rows are documents like others."""
    return packing.pack_documents(docs, bpe.default_vocabulary())


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: The stages learn models and link fingerprints, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. Its rows may have nulls anywhere, empty and very long texts, and come several
    times; the stages say what becomes of them. No documents: no pieces."""
    docs = table(spark, sf_dir, "documents")
    before = written_so_far()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        remove_written(spark, before, keep=1)  # what the stage wrote on its way, and its input
    return docs
