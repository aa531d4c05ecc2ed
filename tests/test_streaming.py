"""Streams over small folders."""

from docweave.streaming.ingest import file_stream, newest_turns, stream_chunks


def test_chunks_of_new_files_are_added_once(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    for k in (1, 2):
        spark.createDataFrame([(k, "Điều 1. X\n\none two")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(src)
        stream_chunks(file_stream(spark, src, "doc_id long, text string"), "doc_id", "text", out, ck).awaitTermination()
        assert sorted(r.doc_id for r in spark.read.parquet(out).collect()) == list(range(1, k + 1))


def test_newest_turns_are_kept(spark, tmp_path):
    src = f"file://{tmp_path}/turns"
    spark.range(12).selectExpr("id % 2 AS s", "id AS n", "cast(id AS string) AS t").coalesce(1).write.parquet(src)
    turns = newest_turns(file_stream(spark, src, "s long, n long, t string"), "s", "n", "t", 3)
    turns.writeStream.format("memory").queryName("turns").outputMode("update").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.s, r.n) for r in spark.sql("SELECT * FROM turns").collect()) == [(0, 6), (0, 8), (0, 10), (1, 7), (1, 9), (1, 11)]
