"""Enrichment: metadata and relationships joined to documents, payload columns, facets and last-wins loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import clean_optional, epoch_seconds, keyword_slug, name_uuid, parse_date, strip
from docweave.operators.filters import SLUG_FIELDS

#: Metadata columns that chunks carry, date columns with the names of their years, related ids kept.
METADATA_COLUMNS = (
    "id",
    "title",
    "so_ky_hieu",
    "ngay_ban_hanh",
    "loai_van_ban",
    "ngay_co_hieu_luc",
    "ngay_het_hieu_luc",
    "nganh",
    "linh_vuc",
    "co_quan_ban_hanh",
    "pham_vi",
    "tinh_trang_hieu_luc",
)
DATE_YEARS = {"ngay_ban_hanh": "issue_year", "ngay_co_hieu_luc": "effective_year", "ngay_het_hieu_luc": "expiry_year"}
MAX_RELATED = 16
PIPELINE_VERSION = "hybrid_v1"


def cleaned(df: DataFrame, *keep: str) -> DataFrame:
    """Every string column stripped, blank and `nan` as null; the columns `keep` and other types stay."""
    kinds = dict(df.dtypes)
    return df.select(*[F.col(c) if c in keep or kinds[c] != "string" else clean_optional(F.col(c)).alias(c) for c in df.columns])


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in the order of delivery; rows with a null key are dropped.

    One aggregation with a map-side combine instead of a window, so a key repeated a million times moves once a task.
    """
    rest = [c for c in df.columns if c != key]
    top = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r"))
    return top.select(key, "_r.*")


def with_metadata(content: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Content with the metadata of its key; rows without keep nulls."""
    return content.join(metadata, key, "left")


def nested_relationships(relationships: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """`key`, relationships: all rows of a document in their order as one array, duplicates kept."""
    rows = F.sort_array(F.collect_list(F.struct(order, *columns)))
    return relationships.where(F.col(key).isNotNull()).groupBy(key).agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("relationships"))


def with_targets(relationships: DataFrame, metadata: DataFrame, target: str, key: str, *columns: str) -> DataFrame:
    """Relationships with a struct `target` of the other document's columns, null where it is unknown."""
    t = metadata.select(F.col(key).alias(target), F.struct(*columns).alias("target"))
    return relationships.join(t, target, "left")


def relationship_summary(relationships: DataFrame, key: str, label: str, other: str, order: str, most: int = MAX_RELATED) -> DataFrame:
    """`key`, relationship_labels (sorted, distinct), relationship_count (all rows), related_doc_ids (first seen, `most` at most).

    Related ids are first brought to one row each, so that a hot document does not collect its repeats.
    """
    r = relationships.where(F.col(key).isNotNull()).select(key, strip(F.col(label)).alias("_l"), strip(F.col(other)).alias("_o"), F.col(order).alias("_n"))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    counts = r.groupBy(key).agg(F.array_sort(F.collect_set(filled("_l"))).alias("relationship_labels"), F.count("*").alias("relationship_count"))
    first = r.where(filled("_o").isNotNull()).groupBy(key, "_o").agg(F.min("_n").alias("_n"))
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_n", "_o"))).where(F.col("_r") <= most)
    ids = ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_o"))), lambda x: x["_o"]).alias("related_doc_ids"))
    return counts.join(ids, key, "left").withColumn("related_doc_ids", F.coalesce("related_doc_ids", F.array().cast("array<string>")))


def point_id(chunk_id: Column, version: Column | str = PIPELINE_VERSION) -> Column:
    """The name-based id of a chunk in one version of the pipeline."""
    v = F.lit(version) if isinstance(version, str) else version
    return name_uuid(F.concat_ws(":", v, chunk_id))


def payload_columns(metadata: list[str]) -> list[Column]:
    """Cleaned metadata, epoch seconds, years and slugs of those columns that are there; null where a value is missing."""
    out = [clean_optional(F.col(c)).alias(c) for c in METADATA_COLUMNS[1:] if c in metadata]
    if "title" in metadata:
        out.append(clean_optional(F.col("title")).alias("doc_title"))
    for c, year in DATE_YEARS.items():
        if c in metadata:
            out += [epoch_seconds(parse_date(F.col(c))).alias(f"{c}_ts"), F.year(parse_date(F.col(c))).alias(year)]
    return out + [keyword_slug(clean_optional(F.col(c))).alias(f"{c}_slug") for c in SLUG_FIELDS if c in metadata]


def compact(df: DataFrame) -> DataFrame:
    """Empty arrays as null; zeros, blank strings and false stay. JSON then leaves them out."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(F.size(c) > 0, F.col(c)).alias(c) if kinds[c].startswith("array") else F.col(c) for c in df.columns])


def facets(df: DataFrame, columns: list[str], top: int = 30) -> DataFrame:
    """field, value, n: the commonest values of each column, all in one pass; ties go to the smaller value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("f")
    counts = df.select(pairs).where("f.value IS NOT NULL").groupBy("f.field", "f.value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_r", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("_r") <= top).drop("_r")
