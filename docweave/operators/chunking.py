"""Chunks of structured documents: a typed tree cut into budgeted pieces that carry their place as context.

One row a document goes in and an array of chunks comes out, in one vectorised function: documents are
independent, so nothing is shuffled. The token counter is injected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import RATIO_LETTERS, clean_optional
from docweave.operators.tree import GRAMMAR, LEAF_LEVEL, TABLE_RULE

#: Labels of nodes in a chunk's place, and the node types that stand as containers.
LABELS = {"article": "Điều", "clause": "Khoản", "point": "Điểm", "table": "Bảng"}
CONTAINERS = ("part", "appendix", "chapter", "section")
#: Words by which a line is known as a heading or as the title under one.
HEADING_WORDS = ("điều", "chương", "mục", "phần", r"phụ\s+lục", r"quyết\s+định", r"nghị\s+định", r"thông\s+tư", "luật")
TITLE_WORDS = ("quy định chung", "mẫu biểu", "danh mục", "quy cách", "điều khoản thi hành", "tổ chức thực hiện")
#: Places at which a long text is divided, the first that occurs; the last divides anywhere.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")

_RULE = re.compile(TABLE_RULE)
_GRAMMAR = [(g, re.compile(g.pattern, re.I)) for g in GRAMMAR]
_HEADING = re.compile(rf"\b(?:{'|'.join(HEADING_WORDS)})\b", re.I)
_TITLE = re.compile(rf"\b(?:{'|'.join(TITLE_WORDS)})\b", re.I)
_ENUMERATED = re.compile(r"(?:điều\s+\d+|khoản\s+\d+|\d+\.|[a-zđ]\))\b", re.I)
_BARE_CONTAINER = re.compile(r"(?:chương|mục|phần)\s+[ivxlcdm\d]+", re.I)
_LETTER = re.compile(f"[{RATIO_LETTERS}]")


def count_words(text: str) -> int:
    """The default counter: stretches between white space."""
    return len(text.split())


@dataclass(frozen=True)
class ChunkRules:
    """Budgets in tokens of `count`; a heading over half the table budget is shortened."""

    chunk_size: int = 500
    overlap: int = 64
    table_size: int = 500
    header_rows: int = 3
    least_tokens: int = 24
    count: Callable[[str], int] = count_words


@dataclass
class _Node:
    type: str
    level: int
    number: str | None
    title: str | None
    text: str
    index: int = 0
    path: list[str] = field(default_factory=list)
    children: list[_Node] = field(default_factory=list)

    def all_text(self) -> str:
        return "\n".join(t for t in [self.text, *(c.all_text() for c in self.children)] if t)


def tidy(text: str) -> str:
    return re.sub(r"\n{3,}", "\n\n", text.strip())


def parse_blocks(markdown: str) -> Iterator[str]:
    """The blocks that tree.blocks_of gives."""
    held: list[str] = []
    tabular = False
    for line in [*(x.strip() for x in markdown.splitlines()), ""]:
        cell = line.startswith("|") and line.endswith("|")
        if held and (not line or cell != tabular):
            yield "\n".join(held)
            held = []
        if line:
            held.append(line)
            tabular = cell


def classify(block: str) -> _Node:
    """The node that tree.with_levels tells from a block."""
    lines = [x for x in (y.strip() for y in block.splitlines()) if x]
    if len(lines) > 1 and lines[0][0] == lines[0][-1] == "|" and any(_RULE.fullmatch(x) for x in lines[1:3]):
        return _Node("table", LEAF_LEVEL, None, None, tidy(block))
    first = unicodedata.normalize("NFC", lines[0]) if lines else ""
    for g, pattern in _GRAMMAR:
        if m := pattern.search(first):
            return _Node(g.type, g.level, m[1] or None, (m[2].strip() or None) if g.titled else None, tidy(block))
    return _Node("content", LEAF_LEVEL, None, None, tidy(block))


def _slug(value: str) -> str:
    ascii_only = unicodedata.normalize("NFKD", value).encode("ascii", "ignore").decode()
    return re.sub("[^a-zA-Z0-9]+", "-", ascii_only).strip("-").lower() or "none"


def parse_tree(doc_id: str, markdown: str) -> _Node:
    """The document's root; each node hangs under the nearest earlier node of smaller level."""
    root = _Node("document", 0, None, None, "", path=[f"document:{doc_id}"])
    line, seen = [root], {}
    for i, block in enumerate(parse_blocks(markdown), 1):
        n = classify(block)
        n.index = i
        while line[-1].level >= n.level:
            line.pop()
        segment = f"{n.type}:{_slug(n.number or n.title or str(i))}"
        k = seen[id(line[-1]), segment] = seen.get((id(line[-1]), segment), 0) + 1
        n.path = [*line[-1].path, segment if k == 1 else f"{segment}:{k}"]
        line[-1].children.append(n)
        line.append(n)
    return root


def label(n: _Node) -> str:
    """How a node is named in the place of what lies below it; empty for plain content."""
    if n.type in CONTAINERS:
        return n.text.splitlines()[0] if n.text else f"{n.type} {n.number or ''}".strip()
    if n.type == "table":
        return LABELS["table"]
    if n.type in LABELS and n.number:
        return f"{LABELS[n.type]} {n.number}" + (f". {n.title}" if n.type == "article" and n.title else "")
    return ""


def uppercase_share(text: str) -> float:
    letters = _LETTER.findall(text)
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def is_title_line(text: str) -> bool:
    """A short line in capitals, or one with the words of a title; never a numbered entry."""
    first = text.splitlines()[0].strip() if text.strip() else ""
    if not first or _ENUMERATED.match(first):
        return False
    return (len(first) <= 120 and uppercase_share(first) >= 0.55) or bool(_TITLE.search(first))


def is_decorative(text: str) -> bool:
    return not re.search(r"[^\W_]", text)


def is_low_value(text: str, kind: str, article: str | None, rules: ChunkRules) -> bool:
    """Decoration, and short content outside articles that reads like no heading."""
    if is_decorative(text):
        return True
    if kind != "content" or article or rules.count(text) >= rules.least_tokens:
        return False
    return not _HEADING.search(text.splitlines()[0])


def effective_overlap(size: int, overlap: int) -> int:
    """At most a quarter of the size; none for a size of 1 or less."""
    return 0 if size <= 1 else min(max(0, overlap), size // 4)


def split_text(text: str, size: int, overlap: int, count: Callable[[str], int] = count_words, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces within `size`, divided at the first separator that occurs, with whole parts repeated up to the overlap.

    Parts that are too long on their own are divided by the next separators.
    """
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p + (sep if i < text.count(sep) else "") for i, p in enumerate(text.split(sep))]
    out: list[str] = []
    held: list[str] = []
    sizes: list[int] = []
    room = effective_overlap(size, overlap)

    def flush() -> None:
        if piece := "".join(held).strip():
            out.append(piece)

    for p in (p for p in parts if p):
        n = count(p)
        if n > size and rest:
            flush()
            held, sizes = [], []
            out += split_text(p, size, overlap, count, rest)
            continue
        if held and sum(sizes) + n > size:
            flush()
            while held and (sum(sizes) > room or sum(sizes) + n > size):
                held.pop(0)
                sizes.pop(0)
        held.append(p)
        sizes.append(n)
    flush()
    return out


def split_table(table: str, rules: ChunkRules) -> list[str]:
    """Pieces of a table within its budget, each under the header; a row that alone is too long stands alone."""
    if rules.count(table) <= rules.table_size:
        return [table]
    lines = [x for x in table.splitlines() if x.strip()]
    k = max(1, rules.header_rows)
    if k > 1 and rules.count("\n".join(lines[:k])) > rules.table_size / 2:
        k = 2 if len(lines) > 1 and _RULE.fullmatch(lines[1].strip()) else 1
    head, out, held = lines[:k], [], []
    for row in lines[k:]:
        if held and rules.count("\n".join([*head, *held, row])) > rules.table_size:
            out.append("\n".join([*head, *held]))
            held = []
        held.append(row)
    return [*out, "\n".join([*head, *held])] if lines else []


@dataclass
class Chunk:
    """A piece with the place it comes from; numbered when all of a document are known."""

    node: _Node
    text: str
    place: list[str]
    article: tuple[str | None, str | None]
    context: str = ""


class _Cutter:
    """Decides node by node what becomes a chunk."""

    def __init__(self, rules: ChunkRules, head: str):
        self.rules, self.head, self.out = rules, head, []

    def emit(self, n: _Node, text: str, place: list[str], article: tuple[str | None, str | None]) -> None:
        text = tidy(text)
        if not text or is_low_value(text, n.type, article[0], self.rules):
            return
        lines = place[:-1] if place and text.startswith(place[-1]) else place
        self.out.append(Chunk(n, text, place, article, "\n".join([self.head, *lines, text]).strip()))

    def pieces(self, n: _Node, whole: str) -> list[str] | None:
        """What a node gives as it stands; None if its parts are to be looked at one by one."""
        if n.type == "table":
            return split_table(whole, self.rules)
        if self.rules.count(whole) <= self.rules.chunk_size:
            return [whole]
        if n.type in ("clause", "point") or not n.children:
            return split_text(whole, self.rules.chunk_size, self.rules.overlap, self.rules.count)
        return None

    def cut(self, n: _Node, above: list[str], article: tuple[str | None, str | None]) -> None:
        place = [*above, label(n)] if label(n) else above
        if n.type == "article":
            article = (n.number, n.title)
        whole = n.all_text()
        if not whole:
            return
        if (pieces := self.pieces(n, whole)) is not None:
            for text in pieces:
                self.emit(n, text, place, article)
            return
        below = n.children
        if n.type != "content":
            heading = n.text
            first = n.children[0]
            if n.type in CONTAINERS and first.type == "content" and is_title_line(first.text):
                heading = "\n".join(t for t in (n.text, first.text) if t)
                below = n.children[1:]
                if first.text not in place:
                    inner = [*place, first.text]
                else:
                    inner = place
            else:
                inner = place
            if heading and not _BARE_CONTAINER.fullmatch(heading.strip()):
                self.emit(n, heading, place, article)
            place = inner
        for c in below:
            self.cut(c, place, article)


def merge_adjacent(chunks: list[Chunk], rules: ChunkRules) -> list[Chunk]:
    """Neighbouring content outside articles under one parent becomes one chunk while its context fits."""
    out: list[Chunk] = []
    for c in chunks:
        last = out[-1] if out else None
        if last and all(x.node.type == "content" and not x.article[0] for x in (last, c)) and last.node.path[:-1] == c.node.path[:-1]:
            text = f"{last.text}\n{c.text}"
            context = last.context[: len(last.context) - len(last.text)] + text
            if rules.count(context) <= rules.chunk_size:
                out[-1] = Chunk(last.node, text, last.place, last.article, context)
                continue
        out.append(c)
    return out


def chunk_document(doc_id: str, markdown: str | None, head: str, rules: ChunkRules) -> list[dict]:
    """All chunks of a document, numbered from 0."""
    cutter = _Cutter(rules, head)
    for n in parse_tree(doc_id, markdown or "").children:
        cutter.cut(n, [], (None, None))
    return [
        {
            "chunk_id": f"{doc_id}:chunk:{i}",
            "chunk_index": i,
            "source_node_id": f"{doc_id}:" + ":".join(["document", *c.node.path[1:]]),
            "source_node_type": c.node.type,
            "text": c.text,
            "context_text": c.context,
            "tree_path": c.node.path,
            "content_path": c.place,
            "article_number": c.article[0],
            "article_title": c.article[1],
            "clause_number": c.node.number if c.node.type == "clause" else None,
            "point_number": c.node.number if c.node.type == "point" else None,
            "token_count": rules.count(c.context),
        }
        for i, c in enumerate(merge_adjacent(cutter.out, rules))
    ]


CHUNK = "chunk_id string, chunk_index int, source_node_id string, source_node_type string, text string, context_text string, tree_path array<string>, content_path array<string>, article_number string, article_title string, clause_number string, point_number string, token_count int"
_ARROW = pa.list_(
    pa.struct([(n, {"string": pa.string(), "int": pa.int32()}.get(t, pa.list_(pa.string()))) for n, t in (c.split() for c in CHUNK.split(", "))])
)


def document_head(*parts: Column) -> Column:
    """Type, number and title of a document in one line; blanks left out."""
    return F.concat_ws(" ", *[clean_optional(p) for p in parts])


def extract_chunks(df: DataFrame, key: str, markdown: str, head: str | None = None, rules: ChunkRules | None = None) -> DataFrame:
    """`key` and the columns of CHUNK for every chunk of every document.

    Null and blank texts give no rows; repeated documents give their chunks again; other columns are not read.
    """
    rules = rules or ChunkRules()
    kind = ", ".join(f"{n}:{t}" for n, t in (c.split() for c in CHUNK.split(", ")))

    @F.arrow_udf(f"array<struct<{kind}>>")
    def cut(ids: pa.Array, texts: pa.Array, heads: pa.Array) -> pa.Array:
        return pa.array([chunk_document(str(i), t, h or "", rules) for i, t, h in zip(ids.to_pylist(), texts.to_pylist(), heads.to_pylist())], _ARROW)

    h = F.col(head).cast("string") if head else F.lit("")
    return df.select(key, F.explode(cut(F.col(key).cast("string"), F.col(markdown), h)).alias("c")).select(key, "c.*")
