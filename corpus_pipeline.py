"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame
that is written as Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``. Operators delete their own scratch tables, so stages of other runs are not touched.

Edge cases: null and empty texts fail the quality rules, as do texts of fewer than ten words, so later stages
meet none of them from here; each operator still defines them. Repeated rows are judged alike by the first two
stages; line dedup cuts the same lines from each, near dedup keeps or drops them together (they share their
id), and each is packed. Very long texts are processed whole. An empty table gives empty stages and an empty
result. Extra columns are not carried on, so their names cannot clash. Rows of a null id pass line dedup and
near dedup unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import line_dedup, near_dedup, packing, quality_crf, quality_rules
from skyloom.llm.common import join_small, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with a new text and its length."""
    return docs.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: rejected documents go; lines that fail are cut out of the others."""
    cleaned = quality_rules.clean_documents(docs, keep=tuple(c for c in COLUMNS if c not in ("text", "n_chars")), figures=("kept", "clean_text"))
    return _with_text(cleaned.where("kept"), "clean_text")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the field takes for bad go. It learns from labels that are not held out."""
    model = quality_crf.train(docs, table(spark, sf_dir, "labels"), ~quality_crf.held_out())
    return quality_crf.classify(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on lines of any length: lines that an earlier line matches go, and documents of which no word is left."""
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _with_text(cut.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), "text")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near-duplicates, the document of the smallest id stays."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return join_small(docs.select(*COLUMNS), staged(gone, "pipeline-gone"), ["doc_id"], "left_anti", 16)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: pieces of all documents in full windows of mixed sources."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: The classifier is fitted and the packing tokenises, which SQL cannot express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents, each staged in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
