"""References to records that do not exist (problem 5): tagged parent and child keys in one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import reference_key
from docweave.session import staged

#: A key counts as heavy from this share of all child keys on, so at most HEAVY_SHARE keys are heavy.
HEAVY_SHARE = 1000
#: Suspect keys are first told by one of so many hash buckets, a table of bounded size that is broadcast.
BUCKETS = 1 << 17


def _children(df: DataFrame, column: str, ref_field: str, parent_table: str, at: str) -> DataFrame:
    return df.select(
        F.lit(parent_table).alias("parent_table"),
        reference_key(F.col(column)).alias("key"),
        F.lit(ref_field).alias("ref_field"),
        F.col("row_id"),
        F.col(at).cast("timestamp").alias("at"),
    ).where(F.col("key").isNotNull())


def _parents(df: DataFrame, column: str, parent_table: str, deleted: bool) -> DataFrame:
    gone = F.col("deleted_at").cast("timestamp") if deleted else F.lit(None).cast("timestamp")
    return df.select(
        F.lit(parent_table).alias("parent_table"),
        reference_key(F.col(column)).alias("key"),
        F.col("loaded_at").cast("timestamp").alias("loaded_at"),
        gone.alias("deleted_at"),
    ).where(F.col("key").isNotNull())


def reference_children(relationships: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every reference of the three reference fields, one row each, tagged with the table it points into."""
    return reduce(
        DataFrame.unionByName,
        [
            _children(relationships, "doc_id", "relationships.doc_id", "metadata", "recorded_at"),
            _children(relationships, "other_doc_id", "relationships.other_doc_id", "metadata", "recorded_at"),
            _children(metadata, "doc_id", "metadata.doc_id", "content_rows", "loaded_at"),
        ],
    )


def key_groups(children: DataFrame, metadata: DataFrame, content_rows: DataFrame) -> DataFrame:
    """Groups by parent table and key with children; `suspect` if they lack the parent flag or the parent came late or was deleted.

    Parents and children stand in one long table with a flag, and one partial aggregation (combined on the
    map side, so a hot key sends one row per task) gives each key's flag, earliest load, deletion, number
    of children and the earliest and latest child.
    """
    parents = _parents(metadata, "doc_id", "metadata", True).unionByName(_parents(content_rows, "id", "content_rows", False))
    none = F.lit(None).cast("timestamp")
    tagged = parents.select("parent_table", "key", F.lit(True).alias("is_parent"), "loaded_at", "deleted_at", none.alias("at")).unionByName(
        children.select("parent_table", "key", F.lit(False).alias("is_parent"), none.alias("loaded_at"), none.alias("deleted_at"), "at")
    )
    groups = tagged.groupBy("parent_table", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.min("loaded_at").alias("first_loaded"),
        F.min("deleted_at").alias("deleted"),
        F.count_if(~F.col("is_parent")).alias("n_children"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )
    late = F.col("first_loaded") > F.col("first_at")
    gone = F.col("deleted") <= F.col("last_at")
    suspect = ~F.col("has_parent") | F.coalesce(late, F.lit(False)) | F.coalesce(gone, F.lit(False))
    return groups.where("n_children > 0").withColumn("suspect", suspect).drop("first_at", "last_at")


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64("parent_table", key), F.lit(BUCKETS)).cast("int")


def orphan_references(relationships: DataFrame, metadata: DataFrame, content_rows: DataFrame) -> DataFrame:
    """ref_field, row_id, period (yyyy-MM), reason (missing, late, deleted), key: one row per broken reference.

    Keys are compared without spaces and tabs around them and without leading zeros; null, blank and null
    words refer to nothing. A null time gives a null period and can only be `missing`. A parent delivered
    again counts from its earliest load and earliest deletion. Repeated rows stay repeated; empty tables
    give no rows (an empty parent table makes every reference missing); other columns are not read.

    Skew: the few keys with over a thousandth of all references (a thousand at most, whatever the data)
    are broadcast, so that their references never meet in one task. Of all others only those in the hash bucket of
    a suspect key move, and join by key.
    """
    children = reference_children(relationships, metadata)
    groups = staged(key_groups(children, metadata, content_rows), "orphan-keys")
    total = groups.agg(F.sum("n_children")).first()[0] or 0
    heavy = F.col("n_children") > F.lit(max(1, total // HEAVY_SHARE))
    facts = ["parent_table", "key", "has_parent", "first_loaded", "deleted"]
    suspects = groups.where("suspect")
    light = suspects.where(~heavy)
    hot = children.join(F.broadcast(suspects.where(heavy).select(*facts)), ["parent_table", "key"])
    near = light.select(_bucket(F.col("key")).alias("bucket")).distinct()  # BUCKETS rows at most
    rest = children.join(F.broadcast(groups.where(heavy).select("parent_table", "key")), ["parent_table", "key"], "left_anti")
    rest = rest.withColumn("bucket", _bucket(F.col("key"))).join(F.broadcast(near), "bucket", "left_semi").drop("bucket")
    found = hot.unionByName(rest.join(light.select(*facts), ["parent_table", "key"]))
    reason = (
        F.when(~F.col("has_parent"), "missing")
        .when(F.col("first_loaded") > F.col("at"), "late")
        .when((F.col("parent_table") == "metadata") & (F.col("deleted") <= F.col("at")), "deleted")
    )
    return found.select("ref_field", "row_id", F.date_format("at", "yyyy-MM").alias("period"), reason.alias("reason"), "key").where("reason IS NOT NULL")


def orphan_counts(found: DataFrame) -> DataFrame:
    """References and distinct keys per reference field, period and reason, summed from the groups of one key."""
    keys = found.groupBy("ref_field", "period", "reason", "key").agg(F.count("*").alias("n"))
    return keys.groupBy("ref_field", "period", "reason").agg(F.sum("n").alias("n_refs"), F.count("*").alias("n_keys"))
