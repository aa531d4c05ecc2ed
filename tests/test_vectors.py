"""Documents of candidates, against the centroids taken one group at a time."""

import random

from pyspark.sql import functions as F

from docweave.operators import vectors
from docweave.operators.lexical import best


def test_documents_are_selected_a_query_at_a_time(spark):
    rng = random.Random(5)
    v = [(f"c{i:03d}", f"d{i % 7 if i < 60 else 7}" if i % 11 else None, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    v += [("null", "d1", None), ("zero", "d8", [0.0] * 4), ("twin", "d9", v[1][2]), ("twin2", "d91", v[1][2])]
    q = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(5)] + [(5, None)]
    cand = [(i, k, r) for i in range(7) for r, (k, _, _) in enumerate(rng.sample(v, 90) if i else v, 1)]
    v, q, cand = spark.createDataFrame(v, "k string, d string, v array<float>"), spark.createDataFrame(q, "q int, w array<float>"), spark.createDataFrame(cand, "q int, k string, rank int")
    df = vectors.select_documents(cand, v, "k", "d", "v", q, "q", "w", top=6, most=200)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()  # no call for each query and document
    own = cand.withColumnRenamed("rank", "_r").join(v, "k").where("d IS NOT NULL")
    scores = vectors.best_similarity(vectors.dynamic_centroids(own, ["q", "d"], "v", 200), q, "q", "w", ["q", "d"]).join(own.groupBy("q", "d").agg(F.min("_r").alias("f")), ["q", "d"])
    want = best(scores, ["q"], 6, F.desc("score"), "f", "d")
    assert {(r.q, r.d, r["rank"], round(r.score, 8)) for r in df.collect()} == {(r.q, r.d, r["rank"], round(r.score, 8)) for r in want.collect()}
    several = vectors.select_documents(cand, v, "k", "d", "v", q, "q", "w", most=4).collect()  # documents of several centroids
    assert {(r.q, r.d) for r in several} == {(r.q, r.d) for r in scores.collect()}


def test_similarity_over_many_blocks(spark):
    rng = random.Random(6)
    v = spark.createDataFrame([(i, [float(rng.randint(0, 2)), 1.0]) for i in range(400)], "id int, v array<double>").coalesce(1)
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)], "q int, w array<double>")
    want = v.crossJoin(q).select("q", "id", F.round(vectors.dot(vectors.unit(F.col("v")), vectors.unit(F.col("w"))), 9).alias("score"))
    want = {(r.q, r.id, r["rank"]) for r in best(want, ["q"], 70, F.desc("score"), "id").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    got = {(r.q, r.id, r["rank"]) for r in vectors.similarity_topk(v, "id", "v", q, "q", "w", 70).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
