"""The corpus pipeline: documents through five stages, from language ID to packed sequences.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the
columns of documents. Null and empty texts have no language and go in the first stage; repeated rows
go in the second; columns beyond those of documents pass, whatever their names, as far as the last; an
empty table passes through every stage. What a stage writes for itself is deleted once its result stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geostrata.llm import decontamination, language_id, packing, secrets, simhash
from geostrata.llm.common import WRITTEN, drop_written, read_table, written_and_reread


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts, those without a letter and those whose best language has a posterior under one half; repeated rows fare alike."""
    return language_id.accepted(docs, language_id.fit(language_id.learning_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group, that of the smallest doc_id, null coming last; of repeated rows one."""
    return simhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth of the words or more; null and wordless texts stay."""
    return decontamination.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mask in the place of each secret; all documents stay, null texts as they are, n_chars follows their new text."""
    return secrets.redacted(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths, each a sequence; a null or empty text is one piece, the closing id."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL has neither the vocabulary nor the models; tests hold what each stage promises.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        begun = len(WRITTEN)
        fresh = written_and_reread(stage(spark, docs, sf_dir))
        drop_written(spark, begun, keep=1)
        docs = fresh
    return docs
