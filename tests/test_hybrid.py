"""The hybrid search of slices of titles, against the steps taken one after another."""

import random

import pytest
from pyspark.sql import functions as F

from docweave.interfaces import encoded
from docweave.operators import hybrid, lexical, vectors


@pytest.mark.parametrize(("size", "pooled"), [(512, 50_000), (7, 40)])  # one slice, and several that look often what they still need
def test_slices_give_the_two_stage_search(spark, monkeypatch, size, pooled):
    monkeypatch.setattr(hybrid, "SLICE", size)
    monkeypatch.setattr(hybrid, "POOLED", pooled)
    monkeypatch.setattr(hybrid, "BLOCK", 256)
    monkeypatch.setattr(hybrid, "ASKED", 5)
    monkeypatch.setattr(vectors, "LEAST_CANDIDATES", 60)
    rng = random.Random(8)
    word = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choices(word, k=rng.randint(1, 15))) for _ in range(900)]
    rows = [(f"c{i:03d}", f"d{i % 37 if i % 5 else 99:02d}" if i % 11 else None, t) for i, t in enumerate(texts)] + [("twin", "d01", texts[1]), ("blank", "d02", " "), ("marks", "d03", "...")]
    asked = [(i, " ".join(rng.choices(word, k=rng.randint(1, 6)))) for i in range(30)] + [(30, None), (31, ""), (32, "???"), (33, "W1 w2"), (34, "w2, w1"), (35, "W1 w2"), (36, "nothing")]
    chunks = spark.createDataFrame(rows, "k string, d string, t string").repartition(3)
    queries = spark.createDataFrame(asked, "q long, a string")
    got = {(r.q, r.k, r.d, r["rank"], r.score) for r in hybrid.hybrid_topk(chunks, "k", "d", "t", queries, "q", "a").collect()}
    points, known = chunks.withColumn("v", encoded(F.col("t"))), queries.where("a IS NOT NULL")
    words = lexical.bm25_topk(chunks, "k", "t", known, "q", "a", 60)
    want = vectors.two_stage_search(points, "k", "d", "v", known.select("q", encoded(F.col("a")).alias("v")), "q", "v", words)
    assert got == {(r.q, r.k, r.d, r["rank"], r.score) for r in want.collect()}
    assert {q for q, *_ in got} == {q for q, a in asked if a is not None}


def test_every_title_is_searched_and_no_candidate_moves(spark):
    from docweave.plans import search_queries
    from docweave.session import table
    from tests.conftest import ROOT

    titles = {r.row_id for r in table(spark, ROOT, "metadata").where("title IS NOT NULL").collect()}
    found = search_queries.hybrid_search(spark, ROOT)
    assert any(i % search_queries.EVERY for i in titles)
    assert {r.row_id for r in found.select("row_id").collect()} == titles
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_search(spark):
    chunks = spark.createDataFrame([("a", "d", "x y")], "k string, d string, t string")
    queries = spark.createDataFrame([(1, "x")], "q long, a string")
    for c, q in ((chunks.limit(0), queries), (chunks, queries.limit(0)), (chunks.select(F.lit(None).cast("string").alias("k"), "d", "t"), queries)):
        assert hybrid.hybrid_topk(c, "k", "d", "t", q, "q", "a").count() == 0
