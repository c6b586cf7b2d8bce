"""A training corpus from ``documents``: quality, near-duplicates, contamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return
``docs``'s columns, whatever else they are called. ``run`` writes each stage's result as Parquet to the
shared folder and reads it again for the next one; then what the stage read or made on its way is deleted.

Defined cases, for all stages: null text is empty; rows with null doc_id, repeated rows and ties are treated as
the operators' modules state; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlake.llm import common, decontaminate, importance, packing, secrets, simhash_anchor


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling doesn't draw go: as many stay as the labels call good."""
    return importance.keep(docs, common.table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of the smallest doc_id (null ids last, of rows with one id the first by text)."""
    return simhash_anchor.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are contaminated by the benchmark go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; all documents stay."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, in sequences."""
    return packing.pack(docs.select("doc_id", "text"), "word_bpe_49k.json", end_id=2)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("secrets", without_secrets), ("packing", packed)]

#: Resampling, SimHash and tokenisation have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of ``documents``: the pieces that ``packed`` gives."""
    docs, since = common.table(spark, sf_dir, "documents"), common.made()
    for name, stage in STAGES:
        docs = common.materialise(spark, stage(spark, docs, sf_dir), f"stage-{name}")
        common.tidy(spark, since, docs)  # also the stage table before
    return docs
