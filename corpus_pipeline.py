"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes the documents that its predecessor kept and returns documents, the
last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from helioframe.llm import latent, near, packing, quality, substring
from helioframe.llm.common import DOCUMENT_COLUMNS, settle, table


def quality_stage(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality.judge(docs).where("kept").select(*DOCUMENT_COLUMNS)


def near_stage(spark, docs, sf_dir):
    """Of each class of near duplicates the document with the least id stays."""
    return near.first_of_class(docs).select(*DOCUMENT_COLUMNS)


def substring_stage(spark, docs, sf_dir):
    """Passages that repeat are cut out; every document stays, with its text shortened."""
    cut = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumns({"text": text, "n_chars": n_chars}).select(*DOCUMENT_COLUMNS)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    found = latent.find_items(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("matches") == 0).select(*DOCUMENT_COLUMNS)


def packing_stage(spark, docs, sf_dir):
    """The remaining documents as pieces of full sequences."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The votes' estimates, signatures, latent space and tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs)
    return docs
