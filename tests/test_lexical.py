"""BM25 against a plain count, and the words of a text outside Spark."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.functions.text import lexical_tokens, lexical_words
from docweave.operators import lexical


def plain_bm25(docs, queries, k):
    words = {d: w for d, t in docs if (w := lexical_words(t))}
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in {x for w in words.values() for x in w}}
    out = set()
    for q, t in queries:
        asked, scores = set(lexical_words(t)), {}
        for d, w in words.items():
            if asked & set(w):
                parts = [(math.log1p((len(words) - df[x] + 0.5) / (df[x] + 0.5)), w.count(x)) for x in asked & set(w)]
                scores[d] = math.fsum(i * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for i, c in parts)
        ranked = sorted(scores, key=lambda d: (-round(scores[d], 6), d))[:k]
        out |= {(q, d, r, round(scores[d], 6), round(len(asked & set(words[d])) / len(asked), 6)) for r, d in enumerate(ranked, 1)}
    return out


def test_words_outside_spark(spark):
    texts = ["Điều 5, số 12/2003/NĐ-CP", "Nghị định", "ﬁ ² x_y a-_b ΟΔΟΣ İ", "", None, " \n", "năm/2 - 3.5.", "𝔸bc 日本 ١٢"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: list(r.w or []) for r in df.select("i", lexical_tokens(F.col("t")).alias("w")).collect()} == {i: lexical_words(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("held", [5_000_000, 30])  # one pass, and several
def test_bm25_moves_no_pairs_and_keeps_ties(spark, monkeypatch, held):
    monkeypatch.setattr(lexical, "MAX_HELD", held)
    rng = random.Random(3)
    docs = [(f"d{i:03d}", " ".join(["chung", *rng.choices("abcdefgh", k=rng.randint(1, 12))])) for i in range(200)] + [("null", None), ("blank", " "), ("twin", "chung a"), ("twin2", "chung a")]
    queries = [(i, " ".join(rng.choices("abcdefghxy", k=rng.randint(1, 5))) + " Chung") for i in range(20)] + [(20, None), (21, "..."), (22, "x"), (23, "a chung"), (24, "a chung")]
    got = lexical.bm25_topk(spark.createDataFrame(docs, "d string, t string").repartition(3), "d", "t", spark.createDataFrame(queries, "q int, t string"), "q", "t", 5, overlap=True)
    assert {(r.q, r.d, r["rank"], r.score, round(r.overlap, 6)) for r in got.collect()} == plain_bm25(docs, queries, 5)
    assert "keys=[_q" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each query and document


def test_best_over_small_blocks():
    rng = np.random.default_rng(1)
    sets, weights, k = sorted({tuple(sorted(rng.choice(30, rng.integers(1, 6), replace=False).tolist())) for _ in range(40)}), rng.random(30), 4
    held, scores = lexical._Held(sets, weights, 10.0, k, False), {}
    for b in range(12):
        rows = []
        for i in range(9):
            terms = np.flatnonzero(rng.random(30) < (np.arange(30) + 1) / 40)
            rows.append((int(rng.permutation(1_000)[0]) * 1_000 + b * 10 + i, 10, terms.tolist(), rng.integers(1, 3, len(terms)).tolist()))
            for s in sets:
                if set(s) & set(rows[-1][2]):
                    scores[s, rows[-1][0]] = sum(weights[t] * tf * 2.2 / (tf + 1.2) for t, tf in zip(*rows[-1][2:]) if t in s)
        held.add(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["_d", "len", "terms", "tfs"]))
    got = {(r["_s"], r["_d"]) for batch in held.batches() for r in batch.to_pylist()}
    assert got == {(i, d) for i, s in enumerate(sets) for d in sorted((d for x, d in scores if x == s), key=lambda d: (-round(scores[s, d], 6), d))[:k]}


def test_filtered_search_moves_no_pairs(spark):
    from docweave.plans import search_queries
    from tests.conftest import ROOT

    assert "keys=[_q" not in search_queries.bm25_filtered(spark, ROOT)._jdf.queryExecution().executedPlan().toString()


def test_nothing_to_search(spark):
    docs = spark.createDataFrame([(1, "a b")], "d long, t string")
    asked = spark.createDataFrame([(1, "a")], "q long, t string")
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs, asked.where("t = 'b'"))):
        assert lexical.bm25_topk(d, "d", "t", q, "q", "t").count() == 0


def test_rerank_moves_no_texts(spark):
    from docweave.plans import search_queries
    from tests.conftest import ROOT

    plan = search_queries.rerank_overlap(spark, ROOT)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan and "keys=[_q" not in plan


def test_every_title_is_reranked(spark):
    from docweave.plans import search_queries
    from docweave.session import table
    from tests.conftest import ROOT

    held = {w for r in table(spark, ROOT, "documents").collect() for w in lexical_words(r.text)}
    titles = {r.row_id for r in table(spark, ROOT, "metadata").collect() if held & set(lexical_words(r.title))}
    assert any(i % search_queries.EVERY for i in titles)
    assert {r.row_id for r in search_queries.rerank_overlap(spark, ROOT).select("row_id").collect()} == titles
    assert "WHERE row_id" not in search_queries.SQL["rerank_overlap"] and "WHERE row_id" in search_queries.SQL["bm25_topk"]
