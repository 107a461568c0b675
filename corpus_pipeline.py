"""A training corpus from documents, stage by stage.

Stages, each over all that the one before kept: quality rules reject documents,
near-duplicates leave one of each group, benchmark passages are cut out, secrets are
replaced, and what remains is packed into windows of token ids.

Cases: a null or empty text fails the quality rules, so an empty table or one of such
texts gives no rows in the end. Rows that repeat in id and text leave one; of documents
that tie for a group the smallest id stays, a null id only where no other is. Texts of any
length pass whole. Other columns travel along whatever their names, up to the last
stage, which gives its own. Each stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontam, near, packing, quality, secrets
from codeloom.llm.common import new_folder, remove, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the posterior of the rules' votes rejects."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles are alike to 0.8, that with the smallest id."""
    return near.drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are mostly such passages go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return secrets.redact_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of token ids; one row for each piece."""
    return packing.report(docs, packing.default_path())


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("secret scans", secret_spans),
    ("packing", packed),
]

#: The posterior of the rules and the tokenizer have no SQL; tests hold the rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's documents are written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        folder = new_folder(spark, f"corpus-{i}")
        docs = stored(out, folder)
        if before:
            remove(spark, before)
        before = folder
    return docs
