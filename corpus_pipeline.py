"""A corpus pipeline of five stages, from raw documents to piece ids.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept, from Parquet.
All but the last return the columns of documents, with ``n_chars`` as it now is.

Nulls, empty and repeated rows, clashing columns: as the operator of each stage states.
An empty table passes all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialize, passing
from quern.llm.line_dedup import drop_common_lines
from quern.llm.mixing import mixed_documents
from quern.llm.near_dedup import deduplicated
from quern.llm.quality import score_quality
from quern.llm.queries import PIECE_MODEL, piece_digests

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _as_documents(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below one half go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_quality(docs.select(*COLUMNS), labels).filter("predicted = 1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share go from all of them."""
    return _as_documents(drop_common_lines(docs.select(*COLUMNS), min_docs=10, min_chars=1).withColumn("text", F.col("kept_text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest id.
    Documents without words are copies of nothing and stay."""
    return deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their targets: a document is left out, taken, cut at the end of its
    source's share, or taken twice. Rows are in the order of the schedule's slots."""
    mixed = mixed_documents(docs.select(*COLUMNS), share=(3, 2), epochs=2)
    return _as_documents(mixed.repartitionByRange("mix_slot", "doc_id").sortWithinPartitions("mix_slot", "doc_id"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become piece ids; the row tells how many, their digest, and what they decode to."""
    return piece_digests(docs, PIECE_MODEL)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: The classifier is fitted, and the pieces follow an automaton: SQL states neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``. What a stage writes on its way goes when its
    result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with passing(spark) as kept:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            kept.append(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
