"""Artifacts: points as compressed JSON shards with a manifest, written, checked, imported and rebuilt.

The shards are written and read by executors; only the manifest, a few numbers a shard, is made on the driver.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.lexical import B, K1

SCHEMA_VERSION = 1
SHARD_SIZE = 10_000
MANIFEST = "manifest.json"
POINT = "id string, dense array<float>, payload string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def checked_points(points: DataFrame, size: int | None = None) -> DataFrame:
    """Points with a vector of the stated size and a payload with context_text; any other fails the job."""
    text = F.get_json_object("payload", "$.context_text")
    bad = F.when(F.col("dense").isNull(), "a point lacks its vector").when(F.lit(size).isNotNull() & (F.size("dense") != F.lit(size)), "a vector has another size").when(text.isNull(), "a payload lacks context_text")
    return points.withColumn("id", F.when(bad.isNotNull(), F.raise_error(bad).cast("string")).otherwise(F.col("id")))


def write_points(points: DataFrame, folder: str, model: str = "hashed-words", append: bool = False, shard_size: int = SHARD_SIZE, version: str = "hybrid_v1") -> dict:
    """Write id, dense, payload (JSON text) as gzip shards of at most `shard_size` points, then the manifest.

    Refused where points or a manifest exist, unless appended to. The manifest is written after the job committed.
    """
    spark = points.sparkSession
    writer = checked_points(points).write.mode("append" if append else "errorifexists")
    writer.option("compression", "gzip").option("maxRecordsPerFile", max(1, shard_size)).option("ignoreNullFields", "false").json(f"{folder}/points")
    return rebuild_manifest(spark, folder, model, version)


def shard_counts(spark: SparkSession, folder: str) -> DataFrame:
    """name, point_count: lines of each shard that are not blank."""
    lines = spark.read.text(f"{folder}/points").select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), "value")
    return lines.where(F.trim("value") != "").groupBy("name").agg(F.count("*").alias("point_count"))


def rebuild_manifest(spark: SparkSession, folder: str, model: str, version: str, vector_size: int | None = None) -> dict:
    """The manifest from what the shards hold."""
    shards = [r.asDict() for r in shard_counts(spark, folder).orderBy("name").collect()]
    points = spark.read.schema(POINT).json(f"{folder}/points")
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("dense")).alias("size"), F.countDistinct(F.get_json_object("payload", "$.doc_id")).alias("docs")).first()
    manifest = {
        "schema_version": SCHEMA_VERSION,
        "pipeline_version": version,
        "dense_model_name": model,
        "sparse_model_name": "bm25",
        "bm25_options": {"k": K1, "b": B, "language": "none"},
        "vector_size": vector_size or facts["size"],
        "point_count": facts["n"],
        "doc_count": facts["docs"],
        "shards": shards,
    }
    _put(spark, f"{folder}/{MANIFEST}", json.dumps(manifest, ensure_ascii=False))
    return manifest


def load_manifest(spark: SparkSession, folder: str) -> dict:
    """The manifest; another schema version is an error."""
    m = json.loads(_get(spark, f"{folder}/{MANIFEST}"))
    if m.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"unsupported manifest version: {m.get('schema_version')}")
    return m


def read_points(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the shards that the manifest names, and no others."""
    m = load_manifest(spark, folder)
    paths = [f"{folder}/points/{s['name']}" for s in m["shards"]]
    return checked_points(spark.read.schema(POINT).json(paths)) if paths else spark.createDataFrame([], POINT)


def upsert(existing: DataFrame | None, new: DataFrame, key: str = "id") -> DataFrame:
    """Existing points with those of `new` in place of their namesakes; of repeated new ones any is kept."""
    fresh = new.dropDuplicates([key])
    return fresh if existing is None else existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def import_points(spark: SparkSession, folder: str, target: str) -> dict:
    """Write the artifact's points as a table; counts that differ from the manifest are reported, not raised."""
    upsert(None, read_points(spark, folder)).write.mode("overwrite").parquet(target)
    return {"imported": spark.read.parquet(target).count(), "expected": load_manifest(spark, folder)["point_count"]}


def server_version(text: str) -> tuple[int, int, int]:
    """Three numbers of a version; other signs are dropped, missing parts are 0."""
    parts = [int(re.sub(r"\D", "", p) or 0) for p in text.split(".")[:3]]
    return tuple((parts + [0, 0, 0])[:3])
