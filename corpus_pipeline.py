"""A training corpus in five stages, each on what its predecessor kept.

Quality classifier, near-duplicates, benchmark decontamination, mixing to
target weights, token files. Every stage is written as Parquet in the shared
folder and read again, so a lost executor costs one stage at most.

Every stage takes any table with the columns of documents. Nulls: a null text is
empty, a null source is a source of its own, a row without a doc_id is a document
of its own. Repeated rows are documents each; the first by id of equal ones stays.
Ties at a threshold count as reaching it. Texts of any length are taken whole.
Columns of other names, also those that operators use, are carried along and never
read. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontaminate, mixing, near_dedup, quality_crf, token_files
from driftline.llm.common import materialize, table
from driftline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject: a score of 0.7 or more. An
    empty or null text is scored as one empty line; equal texts get equal scores."""
    return quality_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one
    with the smallest id. Texts without words are linked with nothing and stay;
    of rows that share the smallest id, or have none, one stays."""
    return near_dedup.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: four fifths of its five-word runs
    or more. Texts without words hold nothing; null items are left out."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents once or twice, in the order of the queue. Documents
    without words take no room and stay where their place in the queue is within
    the budget; ties in the queue go by source, id and size."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, and what they hold: one row a record, in the order of ids,
    null first; a document without text is one end id."""
    files = token_files.write_token_files(docs, tokenizer_path("byte_bpe_50k.json"))
    return token_files.read_digests(spark, files)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("token-ID output", tokens),
]

#: No stage but the third can be put in SQL; the tests compare the whole with a
#: plain reimplementation instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
