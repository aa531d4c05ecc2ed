"""Texts that lost their end (problem 8): artificial cuts, hashed logistic regression, every record scored.

1. Limits: for each source the lengths (code points and bytes) at which at least HAZARD of the texts that long
   stop, from the lengths of all texts.
2. Labels: from a bounded sample, texts as they stand count as intact, the same texts cut at seeded places as
   positives: anywhere, behind a mark, inside markup, at the source's own limit, some with a mark that text is missing.
   Texts that stop at a limit are no intact ones at first.
3. Fit: weighted logistic regression on hashed features of the closing characters, words, lines and
   punctuation and of the distance to the source's limits. The sample is fitted in two folds (by a hash of the
   ending, so that copies stand in one) and each judges the other: intact texts that look cut are left out, and
   texts at a limit that look whole by their closing alone come in. The last fit is over what is left.
4. Score: every record, by its own ending and lengths.

An ending is read from the last WINDOW code points; nothing else of a text says how it closes.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import broadcast_if_bounded, staged

#: Code points read from the end of a text.
WINDOW = 200
#: Documents the classifier is fitted on at most, about (a share of all, by a hash of the id); the bound of the sample.
TRAIN_DOCS = 6_000
#: Hashed features.
BUCKETS = 1 << 17
#: A length is a limit where at least so many texts, and this share of the texts at least that long, stop.
LEAST_AT_LIMIT = 8
HAZARD = 0.08
#: A limit table of more rows than this is joined by shuffle instead of broadcast.
MAX_LIMIT_ROWS = 10_000
#: Places at which an intact text is cut to give positives.
ANYWHERE = 3
#: Steps of a fit.
STEPS = 100
#: A feature of fewer examples counts for nothing.
COMMON = 6

#: Marks with which systems show that text is missing.
MARKS = ("…", "...", " …", " ...", "[...]", "�", "[…]")
#: Markup inside which a transfer may break.
MARKUP = ("&nbsp;", "&amp;", "&lt;", "</p>", "<br>", "<p>", "</td>")

_HEAD = re.compile(r"\W*(?:điều|chương|mục|phần|phụ\s+lục|article|chapter|section|part|annex)\s+[\dIVXLC]+\b", re.I)
_DIGITS = re.compile(r"\d+")
_RUNS = re.compile(r"(.)\1+")
_OPEN_MARKUP = re.compile(r"<[^<>\n]{0,30}\Z|&#?\w{0,8}\Z")
_LINES = re.compile(r"[\r\n\x0b\x0c\x85  ]+")


def _shape(s: str) -> str:
    out = []
    for c in s:
        out.append("a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else "a" if c.isalpha() else " " if c.isspace() else c)
    return _RUNS.sub(lambda m: m[1] if m[1] in "aA9 " else m[1] * min(3, len(m[0])), "".join(out))


def features(tail: str, at_limit: str = "") -> list[int]:
    """Hashed features of an ending. `at_limit` says where the length stands against the source's limits."""
    text = unicodedata.normalize("NFC", tail)
    s = text.rstrip("﻿​ \t\r\n\x0b\x0c\xa0")
    gone = text[len(s) :]
    rows = [x for x in (r.strip() for r in _LINES.split(s)) if x]
    last = rows[-1] if rows else ""
    before = rows[-2] if len(rows) > 1 else ""
    end = _shape(s[-1:])
    n = len(last)
    room = "0" if n <= 4 else "1" if n <= 12 else "2" if n <= 40 else "3" if n <= 80 else "4"
    start = last[0] if last[:1] in "|-+•*(" else "h" if _HEAD.match(last) else "9" if last[:1].isdigit() else "A" if last[:1].isupper() else "a"
    shape = _shape(s[-40:])
    words = [_DIGITS.sub("9", w) for w in last[-90:].split()[-4:]]
    w = lambda k: " ".join(words[-k:])
    whole = _DIGITS.sub("9", last) if n <= 40 else "long"
    cells = last.count("|")
    names = [
        "bias",
        "e1" + s[-1:],
        "e2" + s[-2:],
        "e3" + s[-3:],
        "e4" + s[-4:],
        "s2" + shape[-2:],
        "s3" + shape[-3:],
        "s5" + shape[-5:],
        "s8" + shape[-8:],
        "w1" + w(1),
        "w2" + w(2),
        "w3" + w(3),
        "w4" + w(4),
        "v1" + (_shape(words[-1]) if words else ""),
        "v2" + " ".join(map(_shape, words[-2:])),
        "line" + whole,
        "lshape" + (_shape(last) if n <= 40 else "long"),
        "start" + start + end,
        "room" + room + end,
        "rs" + room + start + shape[-2:],
        "cells" + str(min(cells, 9)) + ("=" if before.count("|") == cells else "<") + end if cells else "cells",
        "before" + _shape(before[-2:]) + "/" + room + end,
        "bline" + (_DIGITS.sub("9", before) if 0 < len(before) <= 40 else "long") + "/" + room,
        "markup" + str(bool(_OPEN_MARKUP.search(s[-40:]))),
        "open" + str(bool(_OPEN_MARKUP.search(s[-40:]))) + str(last.count("(") > last.count(")")),
        "gone" + ("n" if "\n" in gone else "s" if gone else "") + end,
        "dots" + ("many" if s.endswith(".....") else "few" if s.endswith("..") or s.endswith("…") else "no"),
    ]
    out = [zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) + 1 for x in names]
    if at_limit:
        out += [zlib.crc32(x.encode()) % (BUCKETS - 1) + 1 for x in ("lim" + at_limit, "lime" + at_limit + end)]
    return out


FEATURES = 29


def _padded(rows: list[list[int]]) -> np.ndarray:
    out = np.zeros((len(rows), FEATURES), np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def gap(chars: int, size: int, char_limits: list[int] | None, byte_limits: list[int] | None) -> str:
    """`c` at a limit of code points, `b` at a limit of bytes (a broken last character may count up to 3), else nothing."""
    if any(c - 1 <= chars <= c for c in char_limits or ()):
        return "c"
    if any(b - 3 <= size <= b + 3 for b in byte_limits or ()):
        return "b"
    return ""


def length_limits(documents: DataFrame) -> tuple[DataFrame, int]:
    """source, char_limits, byte_limits of the sources that have limits, and the number of texts.

    Lengths are counted over all texts and combined on the map side; a source sends one row a distinct length.
    """
    unit = F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("text").alias("len")), F.struct(F.lit("b").alias("unit"), F.octet_length("text").alias("len")))).alias("u")
    hist = staged(documents.select("source", unit).groupBy("source", "u.unit", "u.len").agg(F.count("*").alias("n")), "length-histogram")
    total = hist.where("unit = 'c'").agg(F.sum("n")).first()[0] or 0
    longer = Window.partitionBy("source", "unit").orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stops = hist.withColumn("rest", F.sum("n").over(longer)).where(f"n >= {LEAST_AT_LIMIT} AND n >= {HAZARD} * rest AND source IS NOT NULL")
    pick = lambda u: F.sort_array(F.collect_set(F.when(F.col("unit") == u, F.col("len"))))
    return stops.groupBy("source").agg(pick("c").alias("char_limits"), pick("b").alias("byte_limits")), total


def _texts(documents: DataFrame) -> DataFrame:
    """Documents whose text is neither null nor blank: doc_id, source, text."""
    return documents.select("doc_id", "source", "text").where(F.col("text").rlike(r"(?U)\S"))


_ROWS = "role int, fold int, weight float, at string, features array<int>, plain array<int>"
_ROWS_ARROW = pa.schema([("role", pa.int32()), ("fold", pa.int32()), ("weight", pa.float32()), ("at", pa.string()), ("features", pa.list_(pa.int32())), ("plain", pa.list_(pa.int32()))])


def _examples(doc_id: object, text: str, chars: list[int] | None, sizes: list[int] | None) -> Iterator[tuple[int, int, float, str, list[int], list[int]]]:
    """(1 for a cut, else 0; fold; weight; place against the limits; features; features without the place)."""
    n = len(text)
    at = gap(n, len(text.encode("utf-8", "replace")), chars, sizes)
    plain = features(text[-WINDOW:])
    fold = zlib.crc32(text[-WINDOW:].encode("utf-8", "replace")) % 2
    yield 0, fold, float(ANYWHERE), at, features(text[-WINDOW:], at) if at else plain, plain
    rng = random.Random(zlib.crc32(str(doc_id).encode()))
    places: list[tuple[int, float, str]] = []
    low = min(20, n // 2)
    if n - low > 1:
        places += [(rng.randrange(low + 1, n), 1.0, "") for _ in range(ANYWHERE)]
    stops = [i + 1 for i in range(low, n - 1) if text[i] in ".,:;)|"]
    if stops:
        places += [(rng.choice(stops), ANYWHERE * len(stops) / n, "") for _ in range(4)]
    for c in chars or ():
        if low < c < n:
            places.append((c, 1.0, "c"))
    if sizes:
        raw = text.encode("utf-8", "replace")
        for b in sizes:
            if low < b < len(raw):
                places.append((len(raw[:b].decode("utf-8", "ignore")), 1.0, "b"))
    for i, weight, where in places:
        if text[i - 1] in "._…" and text[i : i + 1] in ("_", ".", "…"):
            continue  # inside a blank to fill in
        cut = text[max(0, i - WINDOW) : i]
        if not cut.strip():
            continue
        kind = rng.random()
        if kind < 0.25:
            cut += rng.choice(MARKS)
            weight = max(weight, 0.5)
        elif kind < 0.3:  # a transfer that broke inside markup
            markup = rng.choice(MARKUP)
            cut += markup[: rng.randrange(1, len(markup))]
            weight = max(weight, 0.5)
        f = features(cut)
        yield 1, fold, weight, where, features(cut, where) if where else f, f


def labelled(documents: DataFrame, limits: DataFrame, total: int, train_docs: int = TRAIN_DOCS) -> tuple[np.ndarray, ...]:
    """role, fold, weight, at, features and plain features of the sample, on the driver: about `train_docs` documents at most."""
    share = min(1.0, train_docs / max(1, total))
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20)))).join(limits, "source", "left").select("doc_id", "text", "char_limits", "byte_limits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                out += _examples(row["doc_id"], row["text"], row["char_limits"], row["byte_limits"])
            columns = list(zip(*out)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROWS_ARROW)], schema=_ROWS_ARROW)

    t = sample.mapInArrow(run, _ROWS).toArrow()
    column = lambda name: t.column(name).to_pylist()
    return np.array(column("role"), np.int8), np.array(column("fold"), np.int8), np.array(column("weight"), np.float64), np.array([bool(x) for x in column("at")]), _padded(column("features")), _padded(column("plain"))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def _descend(x: np.ndarray, y: np.ndarray, weight: np.ndarray, size: int, steps: int, ridge: float = 1e-5) -> np.ndarray:
    """Adam on the weighted logistic loss over padded rows of feature numbers (0 is padding)."""
    theta, flat, m, v = np.zeros(size), x.ravel(), np.zeros(size), np.zeros(size)
    share = weight / weight.sum()
    for k in range(1, steps + 1):
        miss = (_sigmoid(theta[x].sum(axis=1)) - y) * share
        grad = np.bincount(flat, np.repeat(miss, FEATURES), minlength=size) + ridge * theta
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        theta -= 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        theta[0] = 0.0
    return theta


def fit(role: np.ndarray, fold: np.ndarray, weight: np.ndarray, at: np.ndarray, x: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Weights of the hashed features. Without any text to learn from all are 0, and nothing counts as cut.

    Features of fewer than COMMON examples count for nothing, so that no single text is learned by heart.
    """
    theta = np.zeros(BUCKETS)
    if not len(role) or not role.any():
        return theta
    common = np.flatnonzero(np.bincount(x.ravel(), minlength=BUCKETS) >= min(COMMON, max(1, len(role) // 100)))
    dense = np.zeros(BUCKETS, np.int32)
    dense[common] = np.arange(1, len(common) + 1)
    dense[0] = 0
    x, plain, y, size = dense[x], dense[plain], role.astype(np.float64), len(common) + 1
    seed = (role == 1) | ~at
    closing = np.zeros(len(role))
    for f in (0, 1):
        own, other = seed & (fold == f), fold != f
        if y[own].any():
            closing[other] = _sigmoid(_descend(x[own], y[own], weight[own], size, STEPS)[plain[other]].sum(axis=1))
    keep = (role == 1) | (closing < np.where(at, 0.2, 0.95))
    theta[common] = _descend(x[keep], y[keep], weight[keep], size, 2 * STEPS)[1:]
    theta[0] = 0.0
    return theta


def _scores(theta: np.ndarray):
    @F.arrow_udf("float")
    def score(tail: pa.Array, at: pa.Array) -> pa.Array:
        if not len(tail):
            return pa.array([], pa.float32())
        x = _padded([features(t, a) for t, a in zip(tail.to_pylist(), at.to_pylist())])
        return pa.array(_sigmoid(theta[x].sum(axis=1)), pa.float32())

    return score


def _place(text: Column) -> Column:
    """The same as `gap`, as a column."""
    chars = F.exists(F.coalesce("char_limits", F.array().cast("array<int>")), lambda c: F.length(text).between(c - 1, c))
    sizes = F.exists(F.coalesce("byte_limits", F.array().cast("array<int>")), lambda b: F.octet_length(text).between(b - 3, b + 3))
    return F.when(chars, "c").when(sizes, "b").otherwise("")


def judged(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, source, score and lost (score above a half) of every document whose text is neither null nor blank.

    Null and blank texts are no cases. Rows repeated under one id count once, with the highest score and the
    smallest source. A null source has no limits. Texts of any length are measured whole; ties in the fit do
    not occur, as it starts at 0 and is seeded by ids. An empty table gives no rows; other columns are not
    read. Every text is scored where it lies; only the limits (a few a source) are joined to it.
    """
    docs = _texts(documents)
    limits, total = length_limits(docs)
    limits = broadcast_if_bounded(staged(limits, "length-limits"), MAX_LIMIT_ROWS, "length limits")
    theta = fit(*labelled(docs, limits, total, train_docs)).astype(np.float32)
    score = _scores(theta)
    tails = docs.join(limits, "source", "left").select("doc_id", "source", F.right("text", F.lit(WINDOW)).alias("tail"), _place(F.col("text")).alias("at"))
    scored = tails.select("doc_id", "source", score("tail", "at").alias("score"))
    return scored.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("score").alias("score")).withColumn("lost", F.col("score") > 0.5)


def lost_rates(documents: DataFrame) -> DataFrame:
    """source (null as it stands), n_texts, n_lost and rate."""
    g = judged(documents).groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("lost").cast("long")).alias("n_lost"))
    return g.withColumn("rate", F.col("n_lost") / F.col("n_texts"))
