"""Dense search, rank fusion, centroids and the two-stage search, for tables of vectors and of queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.operators.lexical import best
from docweave.session import bounded_rows, staged

#: Floors of the candidate limits, documents selected, chunks of a cluster.
LEAST_CANDIDATES, DOCUMENT_TOP_K, MAX_PER_CLUSTER, LEAST_CHUNKS = 200, 20, 20, 80
#: The constant of reciprocal rank fusion.
RRF_K = 60
#: Queries are sent to all workers, at most so many at once.
MAX_QUERIES = 50_000
#: Scores held at once.
BLOCK = 4_000_000


def limits(top_k: int, candidates: int | None = None) -> dict[str, int]:
    """top_k at least 1; candidates at least the floor and top_k; chunks at least their floor and top_k."""
    k = max(1, top_k)
    return {"top_k": k, "candidates": max(candidates or 0, k, LEAST_CANDIDATES), "chunks": max(k, LEAST_CHUNKS)}


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; vectors of unequal length give null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def similarity_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 10) -> DataFrame:
    """`query_key`, `key`, score, rank: the k vectors of highest cosine for each query, against all rows.

    A stated query set is sent to the workers (refused beyond MAX_QUERIES), each task multiplies its rows with
    all queries in blocks and keeps k a query, and only those move. Null vectors and those of another length
    take no part; a zero vector has cosine 0; ties go to the smaller key.
    """
    asked = bounded_rows(queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()).distinct(), MAX_QUERIES, "queries")
    ids = [r[0] for r in asked]
    q = np.array([r[1] for r in asked], np.float64).reshape(len(asked), -1)
    n = np.linalg.norm(q, axis=1, keepdims=True)
    q = np.divide(q, n, out=np.zeros_like(q), where=n > 0)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, q))
    kinds = dict(queries.dtypes)[query_key], dict(vectors.dtypes)[key]

    def run(parts):
        ids, q = shared.value
        if not ids:
            return
        held: list[pd.DataFrame] = []
        low = np.full((len(q), 1), -np.inf)  # only a score from here on can still be among the best

        def cut() -> None:
            rows = pd.concat(held).sort_values(["_q", "score", "_k"], ascending=[True, False, True])
            rows = rows[(rows.groupby("_q").cumcount() < k).to_numpy()]
            full = rows[(rows.groupby("_q").cumcount() == k - 1).to_numpy()]
            low[full["_q"].to_numpy(), 0] = full["score"].to_numpy()
            held[:] = [rows]

        size = max(64, BLOCK // len(q))
        for part in parts:
            part = part[part["_v"].map(lambda v: v is not None and len(v) == q.shape[1])]
            for i in range(0, len(part), size):
                own = part.iloc[i : i + size]
                m = np.stack(own["_v"].to_numpy()).astype(np.float64)
                length = np.linalg.norm(m, axis=1, keepdims=True)
                scores = np.round(q @ np.divide(m, length, out=np.zeros_like(m), where=length > 0).T, 9)
                edge = low
                if len(own) > k and np.isinf(low).any():
                    # all rows not below the k-th score of the block, so that ties stay whole
                    edge = np.maximum(low, -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k])
                at, col = np.nonzero(scores >= edge)
                held.append(pd.DataFrame({"_q": at, "_k": own["_k"].to_numpy()[col], "score": scores[at, col]}))
                if sum(map(len, held)) > 2 * k * len(q) or np.isinf(low).any():
                    cut()
        if held:
            cut()
            rows = held[0]
            yield pd.DataFrame({query_key: [ids[i] for i in rows["_q"]], key: rows["_k"], "score": rows["score"]})

    near = vectors.select(F.col(key).alias("_k"), F.col(vector).alias("_v")).mapInPandas(run, f"`{query_key}` {kinds[0]}, `{key}` {kinds[1]}, score double")
    return best(near, [query_key], k, F.desc("score"), key)


def fused(ranked: list[DataFrame], by: list[str], key: str, k: int, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of several rankings (`by`, `key`, rank): score, rank, the first k of each group."""
    every = ranked[0].select(*by, key, "rank")
    for r in ranked[1:]:
        every = every.unionByName(r.select(*by, key, "rank"))
    score = F.round(F.sum(1.0 / (F.lit(float(rrf_k)) + F.col("rank"))), 9)
    return best(every.groupBy(*by, key).agg(score.alias("score")), by, k, F.desc("score"), key)


def mean_centroids(vectors: DataFrame, by: list[str], vector: str) -> DataFrame:
    """`by`, centroid (normalised mean of the normalised vectors), n_vectors: coordinates are summed on the map side."""
    flat = vectors.select(*by, F.posexplode(unit(F.col(vector))).alias("i", "x"))
    sums = flat.groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    whole = sums.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c"), F.max("n").alias("n_vectors"))
    return whole.select(*by, unit(F.transform("c", lambda c: c["x"])).alias("centroid"), "n_vectors")


def cluster_vectors(m: np.ndarray, clusters: int, seed: int = 42, steps: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of Lloyd's iteration, begun from seeded far-apart rows."""
    rng = np.random.default_rng(seed)
    centres = m[[int(rng.integers(len(m)))]]
    while len(centres) < clusters:
        far = ((m[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, m[int(far.argmax())]])
    labels = np.zeros(len(m), int)
    for _ in range(steps):
        new = ((m[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([m[new == c].mean(0) if (new == c).any() else centres[c] for c in range(clusters)])
        if (new == labels).all():
            break
        labels = new
    return centres, labels


def centres_of(m: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 of the normalised rows, one for every `most` of them, and the rows' labels."""
    clusters = math.ceil(len(m) / most)
    centres, labels = (m.mean(0, keepdims=True), np.zeros(len(m), int)) if clusters <= 1 else cluster_vectors(m, clusters)
    return normalised(centres), labels


def normalised(m: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a zero row stays."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def dynamic_centroids(vectors: DataFrame, by: list[str], vector: str, most: int = MAX_PER_CLUSTER) -> DataFrame:
    """`by`, cluster, centroid, n_vectors: one centroid for every `most` vectors of a group.

    Meant for groups of bounded size, such as the candidates of one document in one search.
    """
    kinds = dict(vectors.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        centres, labels = centres_of(normalised(np.stack(pdf["_v"].to_numpy()).astype(np.float64)), most)
        out = {c: [pdf[c].iloc[0]] * len(centres) for c in by}
        return pd.DataFrame(out | {"cluster": range(len(centres)), "centroid": list(centres), "n_vectors": np.bincount(labels, minlength=len(centres))})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", cluster int, centroid array<double>, n_vectors long"
    return vectors.where(F.col(vector).isNotNull()).select(*by, F.col(vector).alias("_v")).groupBy(*by).applyInPandas(run, schema)


def best_similarity(centroids: DataFrame, queries: DataFrame, query_key: str, query_vector: str, by: list[str]) -> DataFrame:
    """Highest cosine of a query with the centroids of a group, at least 0."""
    j = centroids.join(queries.select(query_key, unit(F.col(query_vector)).alias("_qv")), query_key)
    return j.groupBy(*by).agg(F.greatest(F.lit(0.0), F.round(F.max(dot(F.col("_qv"), unit(F.col("centroid")))), 9)).alias("score"))


def nearest(m: np.ndarray, starts: np.ndarray, n: np.ndarray, q: np.ndarray, most: int = MAX_PER_CLUSTER) -> np.ndarray:
    """Highest cosine of q with the centroids of each stretch of n normalised rows; one centroid stands for `most` rows."""
    near = normalised(np.add.reduceat(m, starts) / n[:, None]) @ q
    for i in np.flatnonzero(n > most):
        near[i] = (centres_of(m[starts[i] : starts[i] + n[i]], most)[0] @ q).max()
    return np.round(near, 9)


def select_documents(cand: DataFrame, vectors: DataFrame, key: str, doc: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, top: int = DOCUMENT_TOP_K, most: int = MAX_PER_CLUSTER) -> DataFrame:
    """`query_key`, `doc`, score, rank: the documents whose candidates' centroids lie nearest to the query.

    The score is the highest cosine with a document's centroids, at least 0; one centroid stands for `most` candidates.
    Ties keep the document whose first candidate ranks higher. The candidates of a query are looked at together, all
    documents in one step: most of them have one or two, too few for a call each.
    """
    asked: dict = {}
    for q, v in bounded_rows(queries.select(query_key, query_vector).distinct(), MAX_QUERIES, "queries"):
        asked.setdefault(q, []).extend([] if v is None else [np.array(v, np.float64)])
    shared = vectors.sparkSession.sparkContext.broadcast(asked)
    own = cand.select(query_key, F.col(key).alias("_k"), F.col("rank").alias("_r")).join(vectors.select(F.col(key).alias("_k"), F.col(doc).alias("_d"), F.col(vector).alias("_v")), "_k")
    own = own.where(F.col("_d").isNotNull() & F.col("_v").isNotNull())

    def run(rows: pa.Table) -> pa.Table:
        q = rows.column(query_key)[0].as_py()
        rows = rows.sort_by([("_d", "ascending"), ("_r", "ascending"), ("_k", "ascending")])
        doc_of, lists = rows.column("_d").combine_chunks(), rows.column("_v").combine_chunks()
        code = doc_of.dictionary_encode().indices.to_numpy()  # in order: the rows are sorted
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        score = np.zeros(len(starts))
        for v in shared.value.get(q, []):
            fit = np.flatnonzero(pc.list_value_length(lists).to_numpy() == len(v))  # vectors of another length say nothing
            if len(fit):
                m = normalised(lists.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fit), -1))
                found, at, n = np.unique(code[fit], return_index=True, return_counts=True)
                score[found] = np.maximum(score[found], nearest(m, at, n, normalised(v[None])[0], most))
        kept = starts if q in shared.value else starts[:0]
        return pa.table({query_key: rows.column(query_key).take(pa.array(kept)), "_d": doc_of.take(pa.array(kept)), "score": score[: len(kept)], "first_rank": rows.column("_r").take(pa.array(kept)).cast(pa.int32())})

    scores = own.groupBy(query_key).applyInArrow(run, f"`{query_key}` {dict(cand.dtypes)[query_key]}, _d {dict(vectors.dtypes)[doc]}, score double, first_rank int")
    return best(scores.withColumnRenamed("_d", doc), [query_key], max(1, top), F.desc("score"), "first_rank", doc).drop("first_rank")


def two_stage_search(vectors: DataFrame, key: str, doc: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, other: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """`query_key`, `key`, `doc`, score, rank: fuse candidates, select documents, fuse again within them, take top_k.

    `other` is a second ranking (`query_key`, `key`, rank), such as the lexical one; without it the dense ranking
    stands alone. A query none of whose candidates has a document keeps its first fused order.
    """
    lim = limits(top_k)
    dense = similarity_topk(vectors, key, vector, queries, query_key, query_vector, lim["candidates"])
    rankings = [dense] + ([other.where(F.col("rank") <= lim["candidates"])] if other is not None else [])
    cand = staged(fused(rankings, [query_key], key, lim["candidates"]), "fused-candidates")
    docs = select_documents(cand, vectors, key, doc, vector, queries, query_key, query_vector)
    inside = cand.join(vectors.select(key, doc), key).join(docs.select(query_key, doc), [query_key, doc], "left_semi")
    inside = inside.select(query_key, key, doc, "score").withColumn("has_doc", F.lit(1))
    plain = cand.join(vectors.select(key, doc), key).join(docs.select(query_key).distinct(), query_key, "left_anti").select(query_key, key, doc, "score").withColumn("has_doc", F.lit(0))
    both = best(inside.unionByName(plain), [query_key], lim["chunks"], F.desc("score"), key)
    return both.where(F.col("rank") <= top_k).drop("has_doc")


def rerank(hits: DataFrame, by: list[str], key: str, score: Column, k: int) -> DataFrame:
    """Hits with a new score; groups of more than k hits are reordered by it, smaller ones keep their order and score.

    Ties keep the earlier rank.
    """
    n = F.count("*").over(Window.partitionBy(*by))
    scored = hits.withColumn("_n", n).withColumn("retrieval_score", F.col("score")).withColumn("retrieval_rank", F.col("rank"))
    scored = scored.withColumn("score", F.when(F.col("_n") > k, score).otherwise(F.col("score"))).drop("rank")
    order = F.when(F.col("_n") > k, -F.col("score")).otherwise(F.lit(0.0))
    return best(scored, by, k, order, "retrieval_rank").drop("_n")


def token_overlap(query: Column, text: Column) -> Column:
    """Share of the query's distinct words that the text holds: the offline stand-in for a pair scorer."""
    q = F.array_distinct(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, text)) / F.size(q)).otherwise(F.lit(0.0))
