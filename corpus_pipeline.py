"""The corpus pipeline: documents through operators of the package tracemill.llm, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives documents with the columns they came with, but
for the last, which gives packed pieces. The quality rules take lines out of texts. What a stage gives is written and read again, so a lost
executor costs no earlier stage. Null ids, null and empty texts, repeated rows and further columns
are treated as each operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import classifier, decontaminate, jaccard, line_rules, queries
from tracemill.session import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels of the folder, accepts."""
    return classifier.accepted(docs, queries.table(spark, sf_dir, "labels"))


def sound_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, without their host's boilerplate, unless that depletes them."""
    return line_rules.passing(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of five-word shingles."""
    return jaccard.one_of_each(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the folder's benchmark."""
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left in windows of 2048 tokens."""
    return queries.packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("quality rules", sound_lines),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]

#: No SQL form: Cholesky factors, SimHash and tokens are not SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}-{name.replace(' ', '-')}")
    return docs
