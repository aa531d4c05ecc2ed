"""Splitting oversized items at natural boundaries (problem 1), by balanced targets.

For an item of N units, a limit L and an overlap o: a first piece takes up to L new units, each later one
up to L - o (it repeats the o units before it).

1. The fewest pieces that can hold the item; as many equal lengths give the targets.
2. Each target is snapped to the strongest boundary near it, within what the limit lets the pieces reach.
3. Where a piece would be too long or a cut would fall where nothing breaks, one piece is added and all
   targets are placed anew, up to twice the fewest pieces.
4. Items with a stretch longer than a piece where nothing breaks have no such plan. For them alone an exact search
   takes the cuts with the fewest unnatural ones, then the fewest pieces, then the best sum of equal lengths
   and strong boundaries, so that such a stretch is cut alone.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import broadcast_if_bounded

#: Strength of a boundary, strongest first; a cut stands directly before what the pattern finds.
#: 8 part or appendix, 7 chapter, 6 section, 5 article, 4 clause, 3 point or list entry, 2 paragraph,
#: 1 line, then sentence, clause mark, comma, word.
_LINE_STARTS = (
    (8.0, re.compile(r"(?:phần\s+(?:thứ|[IVXLC]+\b|\d)|phụ\s+lục\b)", re.I)),
    (7.0, re.compile(r"chương\s+[IVXLC\d]", re.I)),
    (6.0, re.compile(r"mục\s+[IVXLC\d]", re.I)),
    (5.0, re.compile(r"(?:\*\*)?(?:điều|article)\s*\d", re.I)),
    (4.0, re.compile(r"\d{1,3}\s*[.)]\s")),
    (3.0, re.compile(r"(?:[a-zđ]\s*\)|[-+•*])\s", re.I)),
)
_LINE = re.compile(r"(?:\r\n|\r|\n)+[ \t]*")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]]*[^\S\r\n]+(?=\S)")
#: A full stop behind these ends no sentence: a numbered heading, a list number, a short abbreviation.
_NO_SENTENCE = re.compile(r"(?:(?:điều|article)\s*\d+|(?:^|[\r\n])\s*\d{1,3}|\b(?:TP|TT|GS|TS|No|Art))\Z", re.I)
_CLAUSE = re.compile(r"[;:][^\S\r\n]+(?=\S)")
_COMMA = re.compile(r",[^\S\r\n]+(?=\S)")
_WORD_GAP = re.compile(r"\s+(?=\S)")
_WORD = re.compile(r"[^ \t\n\r]+")
#: A character with the marks that follow it: Latin marks and those that compose with what stands before.
_CLUSTER = re.compile(r"[\s\S][\u0300-\u036f]*")

#: A boundary this strong counts as one where the text breaks; weaker cuts are made only where no other is in reach.
NATURAL = 0.4
#: What a boundary's strength weighs against equal lengths, which count as squares of shares of a full piece.
STRENGTH_WEIGHT = 0.1
#: A table of pipeline versions larger than this is joined by shuffle instead of broadcast.
MAX_CONFIG_ROWS = 10_000


@dataclass(frozen=True)
class Piece:
    start: int  # in units, with the overlap
    end: int
    overlap: int
    strength: float  # of the boundary at the end; 9 at the end of the item


def boundaries(text: str, table: bool = False) -> dict[int, float]:
    """Strength by character offset of every place where the text breaks. A table breaks at its rows.

    Headings are looked for in a composed copy; its offsets are carried back to the text as stored.
    """
    if unicodedata.is_normalized("NFC", text):
        return _boundaries(text, table)
    clusters = [m.span() for m in _CLUSTER.finditer(text)]
    parts = [unicodedata.normalize("NFC", text[a:b]) for a, b in clusters]
    ends = np.cumsum([len(p) for p in parts])
    at = {0: 0} | {int(e): b for e, (_, b) in zip(ends, clusters)}
    return {at[i]: s for i, s in _boundaries("".join(parts), table).items() if i in at}


def _boundaries(text: str, table: bool) -> dict[int, float]:
    out: dict[int, float] = {}

    def put(i: int, s: float) -> None:
        if 0 < i < len(text) and s > out.get(i, 0.0):
            out[i] = s

    for m in _WORD_GAP.finditer(text):
        put(m.end(), 0.1)
    for pattern, s in ((_COMMA, 0.4), (_CLAUSE, 0.6)):
        for m in pattern.finditer(text):
            put(m.end(), s)
    for m in _SENTENCE.finditer(text):
        if not _NO_SENTENCE.search(text, max(0, m.start() - 16), m.start()):
            put(m.end(), 0.8)
    for m in _LINE.finditer(text):
        i = m.end()
        s = 2.0 if len(re.findall(r"\r\n|\r|\n", m[0])) > 1 else 1.0
        if table:
            s = 5.0
        else:
            for strong, start in _LINE_STARTS:
                if start.match(text, i):
                    s = strong
                    break
        put(i, s)
    return out


def plan(n: int, limit: int, overlap: int, marks: dict[int, float]) -> list[Piece]:
    """Pieces of an item of `n` units. `marks` has the strength of each place, in units, where it breaks.

    Every piece has at most `limit` units, each but the first repeats exactly `overlap` units (at most
    limit - 1, so that every piece brings something new), and the new parts cover the item once.
    """
    limit = max(1, limit)
    o = max(0, min(overlap, limit - 1))
    if n <= limit:
        return [Piece(0, n, 0, 9.0)]
    cuts = [*(_balanced(n, limit, o, marks) or _cuts(n, limit, o, marks)), n]
    return [Piece(max(0, (cuts[i - 1] if i else 0) - (o if i else 0)), c, o if i else 0, marks.get(c, 0.0) if c < n else 9.0) for i, c in enumerate(cuts)]


def _balanced(n: int, limit: int, o: int, marks: dict[int, float]) -> list[int] | None:
    """Cuts at boundaries near equal targets, with the fewest pieces for which every limit holds; None if there are none.

    Of the boundaries in the window of half a length around a target the strongest is taken, of equally strong
    ones the nearest. The window is held to the places from which the limit lets the remaining pieces reach the end.
    """
    natural = sorted(c for c in marks if 0 < c < n and marks[c] >= NATURAL)
    step = limit - o
    least = 1 + -(-(n - limit) // step)
    for k in range(least, 2 * least + 1):
        length, last, cuts = n / k, 0, []
        for i in range(1, k):
            target = i * length
            low = max(last + 1 if last else o + 1, n - (k - i) * step, int(target - length / 2))
            high = min(last + (step if last else limit), n - 1, int(target + length / 2))
            near = natural[bisect.bisect_left(natural, low) : bisect.bisect_right(natural, high)]
            if not near:
                break
            last = max(near, key=lambda c: (marks[c], -abs(c - target), -c))
            cuts.append(last)
        if len(cuts) == k - 1:
            return cuts
    return None


def _cuts(n: int, limit: int, o: int, marks: dict[int, float]) -> list[int]:
    """The cuts with the fewest inside words, then between words, then pieces, then the least cost.

    Going on from the last place in reach is never worse for what follows, so where no natural place is in
    reach the last word gap (or the limit) is the only other place needed: the search over places is exact
    in the numbers of unnatural cuts and pieces.
    """
    places = sorted(c for c in marks if 0 < c < n)
    natural = [c for c in places if marks[c] >= NATURAL]
    best: dict[int, tuple[tuple[int, int, int, float], int]] = {0: ((0, 0, 0, 0.0), -1)}
    open_ = [0]
    while open_:
        last = heapq.heappop(open_)
        if last == n:
            break
        (inside, gaps, pieces, cost), _ = best[last]
        low, high = (last + 1, last + limit - o) if last else (o + 1, limit)
        full = limit - o if last else limit
        to = natural[bisect.bisect_left(natural, low) : bisect.bisect_right(natural, min(high, n - 1))]
        if n <= high:
            to = [*to, n]
        elif not to:
            i = bisect.bisect_right(places, high)
            to = [places[i - 1]] if i and places[i - 1] >= low else [high]
        for c in to:
            strength = marks.get(c, 0.0)
            weak = c < n and strength < NATURAL
            worth = (inside + (weak and strength == 0), gaps + (weak and strength > 0), pieces + 1, cost + ((c - last) / full) ** 2 - (STRENGTH_WEIGHT * strength if c < n else 0.0))
            if c not in best:
                heapq.heappush(open_, c)
            if c not in best or worth < best[c][0]:
                best[c] = (worth, last)
    out = []
    c = best[n][1]
    while c > 0:
        out.append(c)
        c = best[c][1]
    return out[::-1]


def split_text(text: str, unit: str, limit: int, overlap: int, table: bool = False) -> list[tuple[Piece, int, int]]:
    """Pieces with their character offsets. Offsets of consecutive new parts meet, so the text can be rebuilt."""
    marks = boundaries(text, table)
    if unit == "word":
        spans = [m.start() for m in _WORD.finditer(text)]
        starts = np.array(spans, dtype=np.int64)
        in_words: dict[int, float] = {}
        for c, s in marks.items():
            w = int(np.searchsorted(starts, c))
            if w < len(spans) and spans[w] == c:
                in_words[w] = max(s, in_words.get(w, 0.0))
        pieces = plan(len(spans), limit, overlap, in_words)
        at = lambda u: 0 if u <= 0 else len(text) if u >= len(spans) else spans[u]
        return [(p, at(p.start), at(p.end)) for p in pieces]
    return [(p, p.start, p.end) for p in plan(len(text), limit, overlap, marks)]


def size_of(text: Column, unit: Column) -> Column:
    """Units of a text: code points, or stretches between spaces, tabs, line feeds and carriage returns."""
    return F.when(unit == "char", F.length(text)).when(unit == "word", F.regexp_count(text, F.lit(r"[^ \t\n\r]+")))


def oversized(items: DataFrame, config: DataFrame) -> DataFrame:
    """Items larger than the limit of their own pipeline version, each once.

    `items` has item_kind, item_id, item_type, pipeline_version, text. The size is counted in the JVM while
    the table is read, and only oversized rows go on. Repeated rows are dropped among those alone.
    """
    conf = broadcast_if_bounded(
        config.select(F.col("pipeline_version"), "size_unit", "chunk_size", "chunk_overlap", "table_chunk_size").dropDuplicates(["pipeline_version"]),
        MAX_CONFIG_ROWS,
        "chunking_config",
    )
    j = items.where(F.col("text").isNotNull()).join(conf, "pipeline_version")
    limit = F.when(F.col("item_type") == "table", F.col("table_chunk_size")).otherwise(F.col("chunk_size"))
    j = j.withColumn("size_limit", limit)
    # a text of c code points has at most (c + 1) / 2 words and c code points: most rows are settled by length
    longer = F.length("text") > F.when(F.col("size_unit") == "word", 2 * F.col("size_limit") - 1).otherwise(F.col("size_limit"))
    big = F.when(longer, size_of(F.col("text"), F.col("size_unit")) > F.col("size_limit")).otherwise(F.lit(False))
    return j.where(big).dropDuplicates(["item_kind", "item_id"])


_PIECES = "array<struct<piece_no:int,char_start:long,char_end:long,size:int,overlap:int,strength:double,text:string>>"
_PIECE_TYPE = pa.list_(
    pa.struct([("piece_no", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("size", pa.int32()), ("overlap", pa.int32()), ("strength", pa.float64()), ("text", pa.string())])
)


def split_oversized(items: DataFrame, config: DataFrame) -> DataFrame:
    """One row per piece of every oversized item: item_kind, item_id, n_pieces, piece_no (from 1), char_start,
    char_end, size, size_limit, overlap, strength, text.

    Pieces hold at most the limit; each but the first repeats `chunk_overlap` units (at most limit - 1).
    Null texts, unknown versions and null limits are never oversized; a text of exactly the limit is whole;
    a stretch without any boundary is cut at the limit; repeated ids count once; an empty table gives no
    rows; other columns are not read. Items are independent: nothing but oversized rows is shuffled, and
    only to drop repeats.
    """
    cuts = planned(items, config)
    flat = cuts.select("item_kind", "item_id", "size_limit", F.size("_p").alias("n_pieces"), F.explode("_p").alias("p"))
    return flat.select("item_kind", "item_id", "n_pieces", "p.piece_no", "p.char_start", "p.char_end", "p.size", "size_limit", "p.overlap", "p.strength", "p.text")


def planned(items: DataFrame, config: DataFrame, texts: bool = True) -> DataFrame:
    """Every oversized item once, with its pieces in `_p`: targets, snapping and added pieces as `plan` has them.

    Without `texts` the pieces have their places only.
    """

    @F.arrow_udf(_PIECES)
    def cut(text: pa.Array, unit: pa.Array, limit: pa.Array, overlap: pa.Array, kind: pa.Array) -> pa.Array:
        out = []
        for t, u, n, o, k in zip(*(c.to_pylist() for c in (text, unit, limit, overlap, kind))):
            out.append(
                [
                    {"piece_no": i, "char_start": a, "char_end": b, "size": p.end - p.start, "overlap": p.overlap, "strength": p.strength, "text": t[a:b] if texts else None}
                    for i, (p, a, b) in enumerate(split_text(t, u, n, o or 0, k == "table"), 1)
                ]
            )
        return pa.array(out, _PIECE_TYPE)

    return oversized(items, config).withColumn("_p", cut("text", "size_unit", "size_limit", "chunk_overlap", "item_type"))


def items_of(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks and nodes as items of one table."""
    pick = lambda df, kind, key, typ: df.select(
        F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), F.col(typ).alias("item_type"), "pipeline_version", "text"
    )
    return pick(chunks, "chunk", "chunk_id", "source_node_type").unionByName(pick(nodes, "node", "node_id", "type"))

