"""The corpus pipeline: language ID, quality rules, near-duplicate join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the docs of the next one.
All stages but the last return the columns of ``documents``. :data:`ORACLE_SQL` is None, as SQL can't express the
learnt stages, the join of near copies by links, or retrieval; tests hold every stage against a plain version.

Defined results: a null or empty text has no language and goes in the first stage; a null doc_id, lang or source passes like any other; of repeated rows, as of
any group of near copies, one stays; ties are broken by doc_id; empty tables give no rows in any stage, and without labels the second stage applies its
base rules alone; further columns pass all stages but the last, also those named like a column that a stage adds.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from meshframes.llm import jaccard, lang_id, mixing, packing, quality
from meshframes.llm.common import stored, table

#: A text is rejected by language ID if no language is found, or the best one knows less than this share of its n-grams.
LEAST_COVERAGE = 0.25
#: No source weighs more than this share of the mixture; what it has beyond its weight follows after the others have run out.
MAX_SHARE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or in none of the learnt languages go."""
    judged = lang_id.detect(docs, lang_id.fit(docs))
    return judged.where((F.col("lang_pred") != lang_id.UND) & (F.col("coverage") >= LEAST_COVERAGE)).select(docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the isolation forest finds anomalous go."""
    judged = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where("kept").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of their slots: the mixture at the target weights, then the surplus blocks; those without a slot are last."""
    sizes = stored(mixing.source_sizes(docs), "source-sizes")
    mixed = mixing.mix(docs, mixing.capped_weights(sizes, MAX_SHARE), sizes)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("slot").asc_nulls_last(), F.col("doc_id")]
    return mixed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(docs.columns)


def placed(docs: DataFrame) -> DataFrame:
    """(doc_id, place): each document's first place in the order in which the rows of ``docs`` stand.

    Files that a stage has written are numbered in its order, but read in any; other rows stand as their partitions do."""
    try:
        at = docs.select("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        at = docs.select("doc_id", F.monotonically_increasing_id().alias("place"))
    else:
        part = F.regexp_extract("file", r"part-(\d+)", 1)
        at = at.select("doc_id", (F.coalesce(F.try_to_number(part, F.lit("99999999")), F.lit(0)).cast("long") * (1 << 40) + F.col("row")).alias("place"))
    return at.groupBy("doc_id").agg(F.min("place").alias("place"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents by sequence; ``mix_place``: the first place in the mixture that a document of the sequence has.

    Packing puts similar documents together, wherever they stand: sequences read by ``mix_place`` follow the mixture's order."""
    pieces = stored(packing.digest(packing.pack_documents(docs)), "pipeline-pieces")
    at = placed(docs).withColumnRenamed("doc_id", "__llm_id")
    first = pieces.select("sequence_id", "doc_id").join(at, F.col("doc_id").eqNullSafe(F.col("__llm_id"))).groupBy("sequence_id").agg(F.min("place").alias("mix_place"))
    return pieces.join(first, "sequence_id").select(*pieces.columns, "mix_place")


STAGES = [("language ID", language), ("quality rules", rules), ("near-duplicate join", distinct), ("source mixing", mixture), ("retrieval packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
