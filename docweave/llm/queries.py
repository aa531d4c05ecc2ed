"""Queries of the problems of language-model data (1, 2, 6, 7 and 8), over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import endings, mixing, packing, splitting
from docweave.llm.neardup import NearDuplicates
from docweave.session import table


def _items(spark: SparkSession, root: str) -> DataFrame:
    return splitting.items_of(table(spark, root, "chunks"), table(spark, root, "nodes"))


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """The items that the splitter cuts, each through its targets, snapping and added pieces."""
    cuts = splitting.planned(_items(spark, root), table(spark, root, "chunking_config"), texts=False)
    return cuts.where(F.size("_p") > 0).select("item_kind", "item_id")


def p1_pieces(spark: SparkSession, root: str) -> DataFrame:
    return splitting.split_oversized(_items(spark, root), table(spark, root, "chunking_config"))


def _near(spark: SparkSession, root: str) -> NearDuplicates:
    return NearDuplicates(table(spark, root, "chunks").select(F.col("chunk_id").alias("id"), "text"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).pairs().select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    return _near(spark, root).groups().withColumnRenamed("id", "chunk_id")


def _sizes(spark: SparkSession, root: str) -> DataFrame:
    return packing.token_sizes(table(spark, root, "documents"))


def p6_contexts(spark: SparkSession, root: str) -> DataFrame:
    return packing.contexts(_sizes(spark, root), table(spark, root, "pack_sizes"))


def p6_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill(p6_contexts(spark, root), table(spark, root, "pack_sizes"))


def p7_uses(spark: SparkSession, root: str) -> DataFrame:
    return mixing.uses(_sizes(spark, root), table(spark, root, "mix_targets"))


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(_sizes(spark, root), table(spark, root, "mix_targets"))


def p7_uses_exact(spark: SparkSession, root: str) -> DataFrame:
    return mixing.uses(_sizes(spark, root), table(spark, root, "mix_targets"), "exact")


def p7_shares_exact(spark: SparkSession, root: str) -> DataFrame:
    return mixing.shares(_sizes(spark, root), table(spark, root, "mix_targets"), "exact")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return endings.judged(table(spark, root, "documents")).where("lost").select("doc_id")


def p8_rates(spark: SparkSession, root: str) -> DataFrame:
    return endings.lost_rates(table(spark, root, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p6_contexts": p6_contexts,
    "p6_fill": p6_fill,
    "p7_uses": p7_uses,
    "p7_shares": p7_shares,
    "p7_uses_exact": p7_uses_exact,
    "p7_shares_exact": p7_shares_exact,
    "p8_found": p8_found,
    "p8_rates": p8_rates,
}

SQL = {
    "p1_found": r"""
WITH i AS (SELECT 'chunk' AS item_kind, chunk_id AS item_id, source_node_type AS typ, pipeline_version, text FROM chunks
      UNION ALL SELECT 'node', node_id, type, pipeline_version, text FROM nodes)
SELECT DISTINCT item_kind, item_id FROM i JOIN chunking_config c USING (pipeline_version)
WHERE CASE WHEN size_unit = 'char' THEN length(text) ELSE length(regexp_replace(regexp_replace(text, '[^ \t\n\r]+', 'w', 'g'), '[ \t\n\r]+', '', 'g')) END
      > CASE WHEN typ = 'table' THEN table_chunk_size ELSE chunk_size END
""",
}
