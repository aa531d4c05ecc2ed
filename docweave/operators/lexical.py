"""Lexical search: terms, document frequencies, and BM25 top k for a table of queries."""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import lexical_tokens, lexical_words
from docweave.session import staged

#: The saturation and length parameters of BM25.
K1, B = 1.2, 0.75
#: Sets of query terms of one pass at most, and hits that a worker holds for them.
MAX_QUERIES, MAX_HELD = 50_000, 5_000_000
#: Documents scored at once, and sets of terms whose hits are handed on at once.
BLOCK, EMITTED = 4_096, 1_000
#: A term of at least one in so many documents of a block is held as a whole row.
DENSE = 16


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, term, tf. A text is counted where it lies: no shuffle. Null and empty texts give no rows."""
    return _counted(df.select(key, lexical_tokens(F.col(text)).alias("_w")), key).select(key, "term", "tf")


def _counted(worded: DataFrame, *keep: str) -> DataFrame:
    """`keep`, term, tf of the lists `_w`: the words are sorted, and a word's count is the distance between the ends of runs.

    Each step is a column of its own, so that no list is made again for each of its words.
    """
    run = worded.select(*keep, F.array_sort("_w").alias("_s"))
    last = F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: ~F.get("_s", i).eqNullSafe(F.get("_s", i + 1)))
    run = run.where(F.size("_s") > 0).select(*keep, "_s", last.alias("_e"))
    pairs = F.transform("_e", lambda e, i: F.struct(F.get("_s", e).alias("term"), (e - F.coalesce(F.get("_e", i - 1), F.lit(-1))).cast("long").alias("tf")))
    return run.select(*keep, F.explode(pairs).alias("w")).select(*keep, "w.term", "w.tf")


def document_frequencies(tf: DataFrame) -> DataFrame:
    """term, df: documents of each term, combined on the map side."""
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, never negative."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def bm25_topk(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10, overlap: bool = False) -> DataFrame:
    """`query_key`, `key`, rank, score: the k best documents of each query; ties go to the smaller key.

    Each query term counts once. Documents without a common term, null texts, null keys and null queries take no
    part; `key` is unique. Corpus counts cover all documents. With `overlap` also the share of the query's terms
    that the document holds.
    """
    owners, hits = bm25_by_terms(docs, key, text, queries, query_key, query_text, k, overlap)
    return hits.join(owners, "_s").select(query_key, key, "score", "rank", *["overlap"][: int(overlap)])


def bm25_by_terms(docs: DataFrame, key: str, text: str, queries: DataFrame, query_key: str, query_text: str, k: int = 10, overlap: bool = False) -> tuple[DataFrame, DataFrame]:
    """`bm25_topk` before its hits are handed to the queries: `query_key`, _s (the number of its set of terms), and the hits of each _s.

    Every document shares a word with nearly every query, so pairs of both are never rows: the words of a text are
    counted where it lies, one row a document, and each task scores its documents against all queries in memory
    and keeps k a query; only those move. Queries of the same terms are scored once, and only their sets of terms
    come to the driver. More sets than a worker holds are scored in several passes over the counted words.
    """
    spark = docs.sparkSession
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list(lexical_tokens(F.col(query_text))))))
    asked = queries.groupBy(query_key).agg(words.alias("_t")).where(F.size("_t") > 0)
    own = [r[0] for r in asked.select("_t").distinct().collect()]
    terms = by_use(own)
    number = {t: i for i, t in enumerate(terms)}
    sets = sorted(tuple(sorted(number[t] for t in words)) for words in own)
    postings = _counted_terms(docs, key, text, number)
    weights, mean = weights_of(postings, len(terms))
    most = max(1, min(MAX_QUERIES, MAX_HELD // k))
    parts = [_best_of(postings, docs.schema[key].dataType.simpleString(), sets[i : i + most], i, weights, mean, k, overlap) for i in range(0, max(1, len(sets)), most)]
    numbered = spark.createDataFrame([(i, sorted(terms[t] for t in s)) for i, s in enumerate(sets)], "_s int, _u array<string>").select("_s", F.array_sort("_u").alias("_t"))
    return asked.join(numbered, "_t").select(query_key, "_s"), functools.reduce(DataFrame.unionByName, parts).withColumnRenamed("_d", key)


def by_use(asked: Iterable[Iterable[str]]) -> list[str]:
    """Terms of most queries first. With the queries in the order of their terms, neighbours share the sums of what they begin with."""
    used = Counter(t for words in asked for t in words)
    return sorted(used, key=lambda t: (-used[t], t))


def weights_of(postings: DataFrame, terms: int) -> tuple[np.ndarray, float]:
    """The inverse document frequencies by the terms' numbers, and the mean length of the documents with words."""
    n, mean = postings.where("len > 0").agg(F.count("*"), F.avg("len")).first()
    weights = np.zeros(terms)
    for t, w in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).select("t", idf(F.lit(n), F.col("df"))).collect():
        weights[t] = w
    return weights, mean


def _best_of(postings: DataFrame, kind: str, sets: list[tuple[int, ...]], first: int, weights: np.ndarray, mean: float, k: int, overlap: bool) -> DataFrame:
    """_s, _d, score, rank of the sets of one pass, which are numbered from `first` on."""
    shared = postings.sparkSession.sparkContext.broadcast((sets, weights, mean))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(*shared.value, k, overlap)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                held.add(batch.slice(i, BLOCK))
        yield from held.batches()

    scored = postings.where(F.col("_d").isNotNull()).mapInArrow(score, f"_s int, _d {kind}, score double, overlap double")
    top = best(scored, ["_s"], k, F.desc("score"), "_d")
    return top.select((F.col("_s") + first).alias("_s"), "_d", "score", "rank", *["overlap"][: int(overlap)])


def _counted_terms(docs: DataFrame, key: str, text: str, number: dict[str, int]) -> DataFrame:
    """_d, len, terms, tfs of each document with words: the numbers of those terms it holds, ascending, and their counts. Written once."""
    known = docs.sparkSession.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lens, *lists = counted(batch.column(1).to_pylist(), known.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), lens, *lists], ["_d", "len", "terms", "tfs"]).filter(pc.greater(lens, 0))

    kind = docs.schema[key].dataType.simpleString()
    return staged(docs.select(F.col(key).alias("_d"), text).mapInArrow(count, f"_d {kind}, len int, terms array<int>, tfs array<int>"), "postings")


def counted(texts: list[str | None], number: dict[str, int]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """len, terms, tfs of each text."""
    lens, held = [], []
    for t in texts:
        words = lexical_words(t)
        lens.append(len(words))
        held.append([i for w in words if (i := number.get(w)) is not None])
    own = np.repeat(np.arange(len(held), dtype=np.int64), [len(x) for x in held])
    pairs, tfs = np.unique(own * len(number) + np.fromiter(itertools.chain.from_iterable(held), np.int64, len(own)), return_counts=True)
    own, at = np.divmod(pairs, max(1, len(number)))
    ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(held)))]).astype(np.int32))
    return pa.array(lens, pa.int32()), *(pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (at, tfs))


class _Held:
    """The k best documents of each set of terms among those added so far, with the share of the terms or, without overlap, their place among all rows."""

    def __init__(self, sets: list[tuple[int, ...]], weights: np.ndarray, mean: float, k: int, overlap: bool):
        self.sets, self.weights, self.mean, self.k, self.overlap = sets, weights, mean, k, overlap
        same = [next((j for j, (a, b) in enumerate(zip(s, p)) if a != b), min(len(s), len(p))) for s, p in zip(sets, [(), *sets])]
        self.work = list(zip(range(len(sets)), sets, same))
        self.low = [0.0] * len(sets)  # only a score above this can still be among the best
        self.kept: list[list[tuple]] = [[] for _ in sets]
        self.size = [0] * len(sets)
        self.seen = 0
        self.hit = np.zeros(0, bool)  # rows of the last batch that were among the best of a set when it was added

    def add(self, batch: pa.RecordBatch) -> None:
        n = batch.num_rows
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        length = batch.column(1).to_numpy(zero_copy_only=False)
        own = np.repeat(np.arange(n), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
        terms, tf = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3))
        gain = self.weights[terms] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[own] / self.mean)))
        order = np.argsort(terms.astype(np.int16) if len(self.weights) <= 2**15 else terms, kind="stable")  # short numbers are sorted by their digits
        own, gain, terms = own[order], gain[order], terms[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        present = terms[starts]
        holds = np.zeros((len(present), n) if self.overlap else (0, 0), bool)
        if self.overlap:
            holds[np.repeat(np.arange(len(starts)), np.diff([*starts, len(own)])), own] = True
        rows: dict[int, tuple] = {}
        for i, (t, a, b) in enumerate(zip(present.tolist(), starts.tolist(), [*starts.tolist()[1:], len(own)])):
            at, g, dense = own[a:b], gain[a:b], None
            if (b - a) * DENSE >= n:
                dense = np.zeros(n)
                dense[at] = g
            rows[t] = (i, dense, at, g)
        depth = max((len(s) for s in self.sets), default=0) + 1
        self.hit = np.zeros(n, bool)
        own_sum = [np.zeros(n) for _ in range(depth)]
        sums = list(own_sum)
        for i, s, same in self.work:
            for j in range(same, len(s)):
                row = rows.get(s[j])
                if row is None:
                    sums[j + 1] = sums[j]
                elif row[1] is not None:
                    sums[j + 1] = np.add(sums[j], row[1], out=own_sum[j + 1])
                else:
                    np.copyto(own_sum[j + 1], sums[j])
                    own_sum[j + 1][row[2]] += row[3]
                    sums[j + 1] = own_sum[j + 1]
            score = sums[len(s)]
            hits = np.flatnonzero(score > self.low[i])
            if len(hits):
                self._take(i, s, keys, score, hits, rows, holds)
        self.seen += n

    def _take(self, i: int, s: tuple[int, ...], keys: np.ndarray, score: np.ndarray, hits: np.ndarray, rows: dict[int, tuple], holds: np.ndarray) -> None:
        millionths = np.floor(score[hits] * 1e6 + 0.5)
        if len(hits) > self.k:
            hits, millionths = _first(hits, millionths, keys[hits], self.k)
        share = hits + self.seen
        if self.overlap:
            share = holds[np.array([[rows[t][0]] for t in s if t in rows]), hits].sum(0) / len(s)
        self.hit[hits] = True
        self.kept[i].append((millionths, keys[hits], share))
        self.size[i] += len(hits)
        if self.size[i] >= 2 * self.k or self.low[i] == 0 and self.size[i] >= self.k:
            self._cut(i)

    def _cut(self, i: int) -> None:
        m, keys, share = (np.concatenate(x) for x in zip(*self.kept[i]))
        at, m = _first(np.arange(len(m)), m, keys, self.k)
        self.kept[i], self.size[i] = [(m, keys[at], share[at])], len(at)
        if len(at) == self.k:
            self.low[i] = max(0.0, (m.min() - 0.5) / 1e6 - 1e-9)

    def best_of(self, i: int) -> tuple[np.ndarray, ...]:
        if not self.kept[i]:
            return np.zeros(0), np.zeros(0, object), np.zeros(0, np.int64)
        self._cut(i)
        return self.kept[i][0]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.sets), EMITTED):
            some = [i for i in range(a, min(a + EMITTED, len(self.sets))) if self.kept[i]]
            for i in some:
                self._cut(i)
            if some:
                m, keys, share = (np.concatenate(x) for x in zip(*(self.kept[i][0] for i in some)))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(some, np.int32), [self.size[i] for i in some])), pa.array(keys), pa.array(m / 1e6), pa.array(share.astype(np.float64))], ["_s", "_d", "score", "overlap"])


def _first(at: np.ndarray, millionths: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of `at` those of the k highest scores, and the scores; ties go to the smaller key."""
    if len(at) > k:
        edge = np.partition(millionths, len(at) - k)[len(at) - k]
        above, equal = np.flatnonzero(millionths > edge), np.flatnonzero(millionths == edge)
        if len(above) + len(equal) > k:
            equal = equal[np.argsort(keys[equal], kind="stable")][: k - len(above)]
        chosen = np.concatenate([above, equal])
        return at[chosen], millionths[chosen]
    return at, millionths


def best(scored: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    """`scored` with rank, the first k of each group; groups are cut to k before they move."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
