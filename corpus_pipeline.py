"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from genespark.llm import decontaminate, near_dedup, packing, quality_rules, secrets
from genespark.llm.common import documents, release, stash


#: Rows of an Arrow batch: whole texts travel between Spark and Python, so batches of Spark's 10,000 rows are dozens of MB for each task.
BATCH_ROWS = 500


def quality_rules_stage(spark, docs, sf_dir):
    """Documents that fail the fixed rules or a learnt one go. Labels of documents that are not there are not used."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.fit(docs, labels))


def near_dedup_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark, docs, sf_dir):
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs, secrets.fit(secrets.count_documents(docs)))


def packing_stage(spark, docs, sf_dir):
    """The places of all pieces of all documents in sequences of 4096 tokens."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: Learnt rules and tokens have no SQL form; tests/llm holds the result against a plain Python version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs, before = documents(spark, sf_dir), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stash(docs)
            release(*before)
            before = [docs]
    return docs
