"""The corpus pipeline: quality classifier, line dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns the
columns of documents, the last one the places of pieces in packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import line_dedup, mixing, near_dups, packing, quality
from loomgraph.llm.common import stored
from loomgraph.scratch import discard

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its score is lower.
KEEP_SCORE = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones, doesn't reject.

    Null texts count as empty ones and are scored too; null ids and repeated rows stay as they are. Like all
    stages it hands on ``COLUMNS`` alone, whatever other columns there are; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, name="quality_score").where(F.col("quality_score") >= KEEP_SCORE).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat others; those left without any line go.

    A null text loses nothing. Of repeated rows only the first keeps its lines, so the others go. Lines
    of any length count in whole; which of two alike lines goes is told by doc_id (nulls last), then text.
    """
    kept = line_dedup.deduplicated(docs.select(*COLUMNS))
    emptied = (F.col("n_kept") < F.col("n_lines")) & ~F.coalesce("text", F.lit("")).rlike(r"\S")
    return kept.where(~emptied).withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest doc_id.

    Null and empty texts and all texts without words are one group; of rows with the same id one stays.
    Most near copies are gone before, as line dedup has taken the lines that they share.
    """
    return near_dups.deduplicated(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them, in its order.

    A null source is a source, and null ids draw as one id; repeated rows share a draw.
    """
    return mixing.mix(docs.select(*COLUMNS)).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences.

    Null and empty texts are one piece without words; equal texts, so also repeated rows, are in different bins.
    """
    return packing.pack(docs.select(*COLUMNS))


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the classifier and the packing are not relational; tests compare small inputs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each one's result written and read by the next."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
