"""Packing texts into training contexts (problem 6): length patterns fitted by non-negative least squares.

Texts of one size are interchangeable, so contexts are planned over the number of texts of each size (at
most `capacity` sizes, whatever the number of texts):

1. Patterns: for each size a few ways to fill a context with it and few other sizes, each with a multiplicity.
2. Fit: repeat counts x >= 0 that bring patterns @ x closest to the histogram, by projected gradients.
3. Round: the largest counts first, each rounded and held to the texts still there.
4. Residuals: the texts left are packed best fit, largest first, again over their histogram.

Each text takes its place by its rank within its size. Texts larger than a context fill whole contexts and
leave one rest.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.session import bounded_rows, broadcast_if_bounded, staged

#: Fixed value: the public tokenizer whose tokens count (byte-level BPE for many languages).
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: A pack of more tokens than this is refused: its histogram is held on the driver.
MAX_CAPACITY = 1_000_000
#: Sizes in a pattern at most, and ways tried for each size.
PATTERN_SIZES = 4
WAYS = 10
FIT_STEPS = 250
#: Texts of one size are ranked in so many parts, so that no size meets in one task.
RANK_PARTS = 64


@cache
def _encoding(name: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, tokenizer: str = TOKENIZER) -> int:
    """Tokens of one whole text."""
    return len(_encoding(tokenizer).encode_ordinary(text))


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source and n_tokens of every document whose text is neither null nor blank, repeated ids once."""

    @F.arrow_udf(T.LongType())
    def tokens(text: pa.Array) -> pa.Array:
        return pa.array([token_count(x, tokenizer) for x in text.to_pylist()], pa.int64())

    d = documents.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "source", tokens("text").alias("n_tokens"))
    return staged(d.dropDuplicates(["doc_id"]), "token-sizes")


Pattern = list[tuple[int, int]]  # (size, texts of it in one context)


def patterns(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Ways to fill a context, for each size taken as the largest: few sizes, little room left.

    The second size is tried at WAYS places between the smallest and the largest that fits; the rest of the
    room goes to the sizes that fill it best.
    """
    sizes = sorted(s for s, n in histogram.items() if n > 0 and s <= capacity)
    out: dict[tuple, None] = {}

    def close(room: int, p: Pattern) -> None:
        """The largest sizes that still fit, until the room or the sizes of a pattern are used up."""
        p = list(p)
        while room >= sizes[0] and len(p) < PATTERN_SIZES:
            s = sizes[bisect.bisect_right(sizes, room) - 1]
            n = max(1, min(room // s, histogram[s]))
            p.append((s, n))
            room -= n * s
        merged: dict[int, int] = {}
        for s, n in p:
            merged[s] = merged.get(s, 0) + n
        if all(n <= histogram[s] for s, n in merged.items()):
            out[tuple(sorted(merged.items()))] = None

    for s in sizes:
        most = min(capacity // s, histogram[s])
        for n in sorted({1, (most + 1) // 2, most}):
            room = capacity - n * s
            close(room, [(s, n)])
            fit = bisect.bisect_right(sizes, room)
            for k in range(1, WAYS if n == 1 and fit else 0):
                second = sizes[(fit - 1) * k // WAYS]
                m = max(1, min(room // second, histogram[second]) // 2)
                close(room - m * second, [(s, 1), (second, m)])
    return [list(p) for p in out]


def nnls(ways: list[Pattern], histogram: dict[int, int], steps: int = FIT_STEPS) -> np.ndarray:
    """x >= 0 with the least sum of squares of patterns @ x - histogram, by accelerated projected gradients.

    Patterns are columns of few entries; steps are scaled by a bound on the largest eigenvalue of A'A.
    """
    sizes = {s: i for i, s in enumerate(sorted(histogram))}
    target = np.array([histogram[s] for s in sorted(histogram)], np.float64)
    owner = np.repeat(np.arange(len(ways)), [len(p) for p in ways])
    row = np.array([sizes[s] for p in ways for s, _ in p], np.int64)
    value = np.array([n for p in ways for _, n in p], np.float64)
    forth = lambda x: np.bincount(row, value * x[owner], minlength=len(target))
    back = lambda r: np.bincount(owner, value * r[row], minlength=len(ways))
    scale = np.maximum(back(forth(np.ones(len(ways)))), 1e-9)  # row sums of A'A bound it from above
    x = np.zeros(len(ways))
    ahead, t = x, 1.0
    for _ in range(steps):
        new = np.maximum(0.0, ahead - back(forth(ahead) - target) / scale)
        grown = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / grown * (new - x)
        x, t = new, grown
    return x


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(multiplicity, pattern): the largest size left, then again and again the largest that still fits.

    The same pattern is repeated for as long as the numbers of its sizes last.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes = sorted(left)
    out: list[tuple[int, Pattern]] = []
    while sizes:
        room, pattern = capacity, []
        at = len(sizes) - 1
        while at >= 0 and room >= sizes[0]:
            at = min(at, bisect.bisect_right(sizes, room) - 1)
            if at < 0:
                break
            s = sizes[at]
            n = min(left[s], room // s)
            pattern.append((s, n))
            room -= s * n
            at -= 1
        times = min(left[s] // n for s, n in pattern)
        out.append((times, pattern))
        for s, n in pattern:
            left[s] -= times * n
            if not left[s]:
                del left[s]
                sizes.pop(bisect.bisect_left(sizes, s))
    return out


def plan_contexts(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, Pattern]], int]:
    """(multiplicity, pattern) so that every text is placed once, and how many of the rows come from the fit.

    A pattern takes part in the fit only if at most a 200th of its room stays empty; all else is residual.
    """
    left = {s: n for s, n in histogram.items() if n > 0}
    if not left:
        return [], 0
    ways = [p for p in patterns(left, capacity) if 200 * sum(s * n for s, n in p) >= 199 * capacity]
    out: list[tuple[int, Pattern]] = []
    if ways:
        x = nnls(ways, left)
        for i in np.argsort(-x, kind="stable").tolist():
            times = min([round(x[i]), *(left[s] // n for s, n in ways[i])])
            if times > 0:
                out.append((times, ways[i]))
                for s, n in ways[i]:
                    left[s] -= times * n
    fitted = len(out)
    return out + best_fit(left, capacity), fitted


def _segments(plan: list[tuple[int, Pattern]]) -> np.ndarray:
    """Rows size, first rank, context of that rank, texts in one context, sorted: the ranks a size has in each pattern."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for times, pattern in plan:
        for s, n in pattern:
            first = taken.get(s, 0)
            taken[s] = first + times * n
            rows.append((s, first, base, n))
        base += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _ranked(parts: DataFrame) -> DataFrame:
    """`parts` with the rank (from 0) of each within its size; a size is ranked in RANK_PARTS parts and never meets in one task."""
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part_no"), F.lit(RANK_PARTS)).cast("int"))
    counts = salted.groupBy("n_tokens", "salt").count()
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "part_no")
    return salted.withColumn("own", F.row_number().over(own)).join(offsets, ["n_tokens", "salt"]).withColumn("rank", F.col("own") - 1 + F.col("offset"))


def _context_of(plan):
    """The context of a text by its size and its rank within the size."""

    @F.arrow_udf(T.LongType())
    def context_of(size: pa.Array, rank: pa.Array) -> pa.Array:
        seg = plan.value
        s, r = size.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False).astype(np.int64)
        if not len(s):
            return pa.array([], pa.int64())
        # the last segment of the size whose first rank is not above the rank
        lo, hi = np.searchsorted(seg[:, 0], s, "left"), np.searchsorted(seg[:, 0], s, "right")
        while (hi - lo > 1).any():
            mid = (lo + hi) // 2
            wide = hi - lo > 1
            up = wide & (seg[np.minimum(mid, len(seg) - 1), 1] <= r)
            lo, hi = np.where(up, mid, lo), np.where(wide & ~up, mid, hi)
        at = seg[lo]
        return pa.array(at[:, 2] + (r - at[:, 1]) // at[:, 3] + 1)

    return context_of


def contexts(sizes: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, context_no (from 1), doc_id, part_no (from 1), token_start, n_tokens: each token of each text once per pack.

    Texts without tokens take no part; a text of exactly the capacity fills a context; equal sizes are placed by
    id; an empty table gives no rows; other columns are not read. Only the histogram and the plan, bounded by
    the capacity, are on the driver; a null capacity or one out of bounds is an error.
    """
    spark = sizes.sparkSession
    sizes = sizes.where("n_tokens > 0")
    out = None
    for pack in bounded_rows(packs.select("pack_name", "capacity_tokens").distinct(), 1_000, "pack_sizes"):
        name, cap = pack["pack_name"], pack["capacity_tokens"]
        if cap is None or not 0 < cap <= MAX_CAPACITY:
            raise ValueError(f"capacity of {name} is not from 1 to {MAX_CAPACITY}: {cap}")
        starts = F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(cap).cast("long"))
        parts = sizes.select("doc_id", F.col("n_tokens").alias("whole"), F.posexplode(starts).alias("part", "token_start"))
        parts = parts.select(
            "doc_id", (F.col("part") + 1).alias("part_no"), "token_start", F.least(F.lit(cap).cast("long"), F.col("whole") - F.col("token_start")).alias("n_tokens")
        )
        histogram = {r["n_tokens"]: r["count"] for r in bounded_rows(parts.groupBy("n_tokens").count(), cap, f"sizes of {name}")}
        plan = spark.sparkContext.broadcast(_segments(plan_contexts(histogram, cap)[0]))

        context_of = _context_of(plan)
        placed = _ranked(parts).select(
            F.lit(name).alias("pack_name"), context_of("n_tokens", "rank").alias("context_no"), "doc_id", F.col("part_no").cast("int").alias("part_no"), "token_start", "n_tokens"
        )
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        return spark.createDataFrame([], "pack_name string, context_no long, doc_id long, part_no int, token_start long, n_tokens long")
    return out


def fill(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_name, n_contexts, n_tokens and the share of all room that is used."""
    g = placed.groupBy("pack_name").agg(F.max("context_no").alias("n_contexts"), F.sum("n_tokens").alias("n_tokens"))
    cap = packs.select("pack_name", "capacity_tokens").distinct()
    return g.join(broadcast_if_bounded(cap, 1_000, "pack_sizes"), "pack_name").select("pack_name", "n_contexts", "n_tokens", (F.col("n_tokens") / (F.col("n_contexts") * F.col("capacity_tokens"))).alias("used_share"))
