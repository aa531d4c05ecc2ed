"""Hybrid search of a table of titles against chunks: BM25 and dense candidates, fused, documents selected, chunks of them ranked."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import lexical_words
from docweave.interfaces import Encoder, HashedWords
from docweave.operators import lexical, vectors
from docweave.session import staged

#: Texts asked by one task, of which so many are multiplied at once, and rows that it keeps before it looks which of them are still candidates.
SLICE, ASKED, POOLED = 2_048, 128, 50_000
#: Chunks scored at once.
BLOCK = 10_000


def hybrid_topk(chunks: DataFrame, key: str, doc: str, text: str, queries: DataFrame, query_key: str, query_text: str, top_k: int = 10, encoder: Encoder | None = None) -> DataFrame:
    """`query_key`, `key`, `doc`, score, rank: `vectors.two_stage_search` over the dense and the BM25 ranking of the texts.

    `key` and `query_key` are unique; null keys and null query texts take no part, corpus counts cover all chunks.
    Each different query text is searched once and its hits are handed to its keys. The chunks are counted and
    encoded once, beside each other. A task then takes a slice of the query texts, neighbours by their terms,
    through all chunks: both rankings, their fusion and the selection of documents need no other task, so that
    neither candidates nor vectors move; only the hits do. The driver holds the different query texts.
    """
    spark, model, lim = chunks.sparkSession, encoder or HashedWords(), vectors.limits(top_k)
    asked = {r[0]: set(lexical_words(r[0])) for r in queries.select(query_text).where(F.col(query_text).isNotNull()).distinct().collect()}
    terms = lexical.by_use(asked.values())
    number = {t: i for i, t in enumerate(terms)}
    points = _points(chunks, key, doc, text, number, model)
    weights, mean = lexical.weights_of(points, len(terms))
    ordered = sorted((tuple(sorted(number[w] for w in words)), t) for t, words in asked.items())
    kinds = dict(chunks.dtypes)
    schema = f"`{query_text}` string, `{key}` {kinds[key]}, `{doc}` {kinds[doc]}, score double, rank int"
    facts = spark.sparkContext.broadcast((weights, mean, model))

    def searched(part: list[tuple[tuple[int, ...], str]]) -> DataFrame:
        own = spark.sparkContext.broadcast(part)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, (weights, mean, model) = own.value, facts.value
            slice_ = _Slice([t for _, t in part], [s for s, _ in part], weights, mean, model, lim)
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK):
                    slice_.add(batch.slice(i, BLOCK))
            columns = list(zip(*slice_.hits()))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], names=[f.name for f in fields])

        return points.select("_d", "len", "_t", "_f", "_c", "dense").coalesce(1).mapInArrow(search, schema)  # one task over all files: no shuffle

    arrow = {f.name: f.type for f in _arrow_fields(chunks.select(key, doc))}
    fields = [pa.field(query_text, pa.string()), pa.field(key, arrow[key]), pa.field(doc, arrow[doc]), pa.field("score", pa.float64()), pa.field("rank", pa.int32())]
    # without a frame of several tasks the union of frames of one task would be taken for one task, too; this one reads no row
    none = points.where("len < 0").select(*(F.lit(None).cast(t).alias(c) for c, t in ((key, kinds[key]), (doc, kinds[doc]), ("score", "double"), ("rank", "int")))).withColumn(query_text, F.lit(""))  # not null: the join would drop the frame
    found = functools.reduce(DataFrame.unionByName, [searched(ordered[i : i + SLICE]) for i in range(0, len(ordered), SLICE)], none)
    return queries.select(query_key, query_text).join(found, query_text).select(query_key, key, doc, "score", "rank")


def _arrow_fields(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def _points(chunks: DataFrame, key: str, doc: str, text: str, number: dict[str, int], model: Encoder) -> DataFrame:
    """_d, len, terms as for BM25, _c (the document) and the bytes of terms (_t), tfs (_f) and of the vector (dense) of each chunk. Written once.

    Bytes pass through the scan as they are, where lists would be taken apart for each slice.
    """
    known = chunks.sparkSession.sparkContext.broadcast((number, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, model = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, lexical.BLOCK):
                part = batch.slice(i, lexical.BLOCK)
                texts = part.column(2).to_pylist()
                dense = model.encode([t or "" for t in texts]).astype(np.float32)
                packed = pa.array([v.tobytes() for v in dense], pa.binary())
                lens, terms, tfs = lexical.counted(texts, number)
                yield pa.RecordBatch.from_arrays([part.column(0), lens, terms, _bytes(terms), _bytes(tfs), part.column(1), packed], ["_d", "len", "terms", "_t", "_f", "_c", "dense"])

    kinds = dict(chunks.dtypes)
    schema = f"_d {kinds[key]}, len int, terms array<int>, _t binary, _f binary, _c {kinds[doc]}, dense binary"
    return staged(chunks.select(F.col(key).alias("_d"), F.col(doc).alias("_c"), text).mapInArrow(run, schema), "points")


def _bytes(lists: pa.ListArray) -> pa.Array:
    """Lists of 32-bit numbers as bytes."""
    ends = (lists.offsets.to_numpy() - lists.offsets[0].as_py()) * 4
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(lists.flatten().to_numpy().tobytes())])


def _lists(packed: pa.Array) -> pa.ListArray:
    """The lists of `_bytes`."""
    _, ends, values = packed.buffers()
    ends = np.frombuffer(ends, np.int32)[packed.offset : packed.offset + len(packed) + 1] // 4
    values = np.frombuffer(values, np.int32, ends[-1]) if ends[-1] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(values[ends[0] :]))


class _Slice:
    """The search of some texts: candidates among the rows added so far, and what the last steps need of those rows."""

    def __init__(self, texts: list[str], sets: list[tuple[int, ...]], weights: np.ndarray, mean: float, model: Encoder, lim: dict[str, int]):
        self.texts, self.lim = texts, lim
        distinct = sorted({s for s in sets if s})
        at = {s: i for i, s in enumerate(distinct)}
        self.set_of = [at.get(s) for s in sets]
        self.words = lexical._Held(distinct, weights, mean, lim["candidates"], False)
        self.q = vectors.normalised(np.asarray(model.encode(texts), np.float64).reshape(len(texts), -1))
        self.near = _Near(self.q, lim["candidates"])
        self.pool: list[tuple[np.ndarray, ...]] = []  # place in the stream, document, vector
        self.seen, self.pooled, self.most = 0, 0, POOLED

    def add(self, batch: pa.RecordBatch) -> None:
        if batch.column(0).null_count:
            batch = batch.filter(batch.column(0).is_valid())
        n = batch.num_rows
        if not n or not self.texts:
            return
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        vector = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float32).reshape(n, -1)
        self.words.add(pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(batch.column(2)), _lists(batch.column(3))], ["_d", "len", "terms", "tfs"]))
        at = np.flatnonzero(self.words.hit | self.near.add(keys, vectors.normalised(vector.astype(np.float64)), self.seen))
        self.pool.append((at + self.seen, batch.column(4).take(pa.array(at)).to_numpy(zero_copy_only=False), vector[at]))
        self.seen, self.pooled = self.seen + n, self.pooled + len(at)
        if self.pooled > self.most:
            self._prune()

    def _prune(self) -> None:
        """Drops the rows that no text holds as a candidate any more."""
        live = np.zeros(self.seen, bool)
        for held in (*self.words.kept, *self.near.kept):
            for _, _, places in held:
                live[places] = True
        for i, rows in enumerate(self.pool):
            if not (still := live[rows[0]]).all():
                self.pool[i] = tuple(x[still] for x in rows)
        self.pooled = sum(len(rows[0]) for rows in self.pool)
        self.most = max(POOLED, 3 * self.pooled // 2)

    def hits(self) -> Iterator[tuple]:
        """text, key, document, score, rank."""
        if not self.pool:
            return
        self._prune()
        place, doc = (np.concatenate(x) for x in list(zip(*self.pool))[:2])
        vector, end = np.empty((self.pooled, self.pool[0][2].shape[1]), np.float32), self.pooled
        while self.pool:  # a block at a time, so that vectors are not held twice
            rows = self.pool.pop()[2]
            vector[end - len(rows) : end] = rows
            end -= len(rows)
        lexical_of = functools.lru_cache(maxsize=None)(lambda i: _ranked(*self.words.best_of(i)) if i is not None else [])
        for i, text in enumerate(self.texts):
            score: dict[int, float] = {}
            key_of: dict[int, object] = {}
            for ranked in (_ranked(*self.near.best_of(i)), lexical_of(self.set_of[i])):
                for r, (_, key, p) in enumerate(ranked, 1):
                    score[p], key_of[p] = score.get(p, 0.0) + 1.0 / (vectors.RRF_K + r), key
            fused = -np.round(np.fromiter(score.values(), np.float64, len(score)), 9)
            cand = sorted(zip(fused.tolist(), key_of.values(), score))[: self.lim["candidates"]]
            rows = np.searchsorted(place, [p for _, _, p in cand])
            docs = doc[rows].tolist()
            chosen = self._documents(i, docs, vector[rows])
            kept = [(key, d, -s) for (s, key, _), d in zip(cand, docs) if not chosen or d in chosen]
            for r, (key, d, s) in enumerate(kept[: self.lim["top_k"]], 1):
                yield text, key, d, s, r

    def _documents(self, i: int, docs: list, vector: np.ndarray) -> set:
        """The documents whose candidates, given in the order of their ranks, lie nearest to text i."""
        order = sorted((d, r) for r, d in enumerate(docs) if d is not None)
        if not order:
            return set()
        starts = [j for j, (d, _) in enumerate(order) if not j or d != order[j - 1][0]]
        m = vectors.normalised(vector[[r for _, r in order]].astype(np.float64))
        score = vectors.nearest(m, np.array(starts), np.diff([*starts, len(order)]), self.q[i])
        best = sorted((-max(0.0, s), order[j][1], order[j][0]) for s, j in zip(score.tolist(), starts))
        return {d for _, _, d in best[: vectors.DOCUMENT_TOP_K]}


def _ranked(values: np.ndarray, keys: np.ndarray, places: np.ndarray) -> list[tuple]:
    return sorted(zip((-values).tolist(), keys.tolist(), places.astype(np.int64).tolist()))


class _Near:
    """The k rows of highest cosine with each query among those added so far; cosines count in 1e-9, ties go to the smaller key."""

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k = q, k
        self.low = np.full((len(q), 1), -np.inf)  # only a cosine from here on can still be among the best
        self.kept: list[list[tuple]] = [[] for _ in q]
        self.size = [0] * len(q)

    def add(self, keys: np.ndarray, m: np.ndarray, first: int) -> np.ndarray:
        """Tells which of the rows were among the best of a query."""
        hit = np.zeros(len(keys), bool)
        for i in range(0, len(self.q), ASKED):
            self._some(keys, m, first, i, hit)
        return hit

    def _some(self, keys: np.ndarray, m: np.ndarray, first: int, start: int, hit: np.ndarray) -> None:
        scores = self.q[start : start + ASKED] @ m.T
        edge = self.low[start : start + ASKED]
        if len(keys) > self.k and np.isinf(edge).any():
            # all rows not below the k-th cosine of the block, so that ties stay whole
            edge = np.maximum(edge, np.partition(scores, len(keys) - self.k, axis=1)[:, len(keys) - self.k, None] - 2e-9)
        at, col = np.divmod(np.flatnonzero(scores >= edge), len(keys))
        values = np.round(scores[at, col] * 1e9)
        hit[col] = True
        ends = np.searchsorted(at, np.arange(len(scores) + 1)).tolist()
        for i, (a, b) in enumerate(zip(ends, ends[1:]), start):
            if a == b:
                continue
            self.kept[i].append((values[a:b], keys[col[a:b]], col[a:b] + first))
            self.size[i] += b - a
            if self.size[i] >= 2 * self.k or self.size[i] >= self.k and np.isinf(self.low[i, 0]):
                self.best_of(i)

    def best_of(self, i: int) -> tuple[np.ndarray, ...]:
        if not self.kept[i]:
            return np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64)
        values, keys, places = (np.concatenate(x) for x in zip(*self.kept[i]))
        at, values = lexical._first(np.arange(len(values)), values, keys, self.k)
        self.kept[i], self.size[i] = [(values, keys[at], places[at])], len(at)
        if len(at) == self.k:
            self.low[i, 0] = values.min() / 1e9 - 2e-9
        return self.kept[i][0]
