"""Corpus to packed training sequences in five stages, each one operator over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import lines, mixing, packing, quality, simhash
from tidewell.llm.common import Written, sent_if_small
from tidewell.llm.queries import table, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counted rules and the score keep."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.quality_rules(docs, model).where("quality.kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document or line has; n_chars is that of the new text."""
    return lines.line_dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more), that with the smallest id.

    A row without an id comes after all with one. Of rows that share an id one stays at most, the least by its columns.
    An empty table gives no rows.
    """
    spare = 1 << 62
    ids = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(*COLUMNS).bitwiseAND(F.lit(spare - 1)) + F.lit(spare))
    rows = docs.select(*COLUMNS, ids.alias("row_id"))
    found = simhash.simhash_near_dedup(rows, words_each=5, similarity=0.8, id_col="row_id")
    first = Written(found.groupBy("row_id").agg(F.count("*").alias("n"), F.min("component_id").alias("least")).where("row_id = least").select("row_id", "n"), "first").df
    kept = rows.join(sent_if_small(first, 1_000_000), "row_id")
    many = kept.where("n > 1").groupBy("row_id").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return kept.where("n = 1").select(*COLUMNS).unionByName(many)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: a row for each time that a document is taken."""
    return mixing.shuffled(mixing.mix_sources(docs)).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in sequences."""
    return packing.best_fit_packing(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: No SQL form: fuzzy groups, the mix's draw and the packing have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = Written(docs, f"stage{i}").df
    return docs
