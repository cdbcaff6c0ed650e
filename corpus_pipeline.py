"""documents -> quality -> line dedup -> near-dedup -> decontamination -> mix; each stage reads what the one before wrote.

Null and blank texts are scored like any other; of those that pass only one is left after near-dedup. A null id is an id: it counts as the
largest when copies are told apart, and rows equal in id and text are one document from near-dedup on. Ties go to the smaller id, then to the smaller digest of the text. Texts are
taken whole, whatever their length. Further columns of the table do not reach the stages. Without labels of both classes every score is the share
of ones (0.5 without any), so nothing or everything passes the threshold; without benchmark items nothing is removed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, near_copies, quality_knn, source_mix
from loomgraph.llm.common import crc_mod, materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: SQL can express neither the classifier nor the near copies; the tests hold run() against brute force.
ORACLE_SQL = None


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from the labels of the documents given."""
    model = quality_knn.fit(docs, table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2))
    return quality_knn.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality_knn.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; a document of which nothing but blanks is left goes."""
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return _documents(cleaned.where((F.size("removed") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, similarity 0.8 or more."""
    return near_copies.keep_representatives(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target, taken."""
    return source_mix.mix(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("mixing sources", mixing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
