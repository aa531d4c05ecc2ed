"""HTML to Markdown for structured documents: layout tables are unwrapped, data tables become pipe tables.

One pass of the standard library's parser builds a light tree; rendering is one function a kind of node. Runs as a
vectorised function over Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements that stand as blocks, that are inline, that are dropped, and that never have an end tag.
BLOCKS = frozenset("address article aside blockquote div footer form h1 h2 h3 h4 h5 h6 header li main p section".split())
INLINE = frozenset("strong b em i span a u".split())
DROPPED = frozenset("script style img noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Phrases of a document's head, by which a small table is known as layout.
HEAD_PHRASES = (
    "CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "CỘNG HOÀ XÃ HỘI CHỦ NGHĨA VIỆT NAM",
    "Độc lập - Tự do - Hạnh phúc",
    "Độc lập – Tự do – Hạnh phúc",
    "ỦY BAN NHÂN DÂN",
    "UỶ BAN NHÂN DÂN",
    "QUỐC HỘI",
    "CHÍNH PHỦ",
)

_SPACES = re.compile(r"[ \t\r\f\v]+")
_AROUND_BREAK = re.compile(r" *\n *")
_BOUNDARY = re.compile(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=[^\W\d_])")
_RESIDUE = (
    (re.compile(r"<\s*/?\s*p(?:\s+[^>]*)?>", re.I), " "),
    (re.compile(r"</[^>\s]+>"), " "),
    (re.compile(r"(?<=\d%)<(?=[A-Za-zÀ-ỹ])"), " < "),
    (re.compile(r"(?<=[A-Za-zÀ-ỹ])<(?=\d)"), " < "),
    (re.compile(r"</?[a-z][^>]*>", re.I), " "),
)


class _Element:
    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str | None]):
        self.name, self.attrs, self.children = name, attrs, []


class _Builder(HTMLParser):
    """Nesting as the markup has it: an end tag closes the nearest open element of its name, an unknown one nothing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = _Element(tag, dict(attrs))
        self.open[-1].children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Element(tag, dict(attrs)))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def handle_comment(self, data):
        self.open[-1].children.append(data)

    handle_decl = handle_comment
    handle_pi = handle_comment
    unknown_decl = handle_comment


def _walk(e: _Element):
    """Every element below, in document order, without recursion."""
    stack = list(reversed(e.children))
    while stack:
        x = stack.pop()
        if isinstance(x, _Element):
            yield x
            stack.extend(reversed(x.children))


def inline(text: str) -> str:
    """Entities resolved once more, no-break blanks as blanks, runs of blanks one, none around line feeds."""
    return _AROUND_BREAK.sub("\n", _SPACES.sub(" ", unescape(text).replace("\xa0", " ")))


def _block(text: str) -> str:
    s = text.strip()
    return f"\n\n{s}\n\n" if s else ""


def _rows(table: _Element) -> list[_Element]:
    out = []
    for x in table.children:
        if isinstance(x, _Element):
            out += [x] if x.name == "tr" else [r for r in x.children if isinstance(r, _Element) and r.name == "tr"] if x.name in ("thead", "tbody", "tfoot") else []
    return out


def _cells(row: _Element) -> list[_Element]:
    return [c for c in row.children if isinstance(c, _Element) and c.name in ("td", "th")]


def _cell_text(cell: _Element) -> str:
    pieces: list[str] = []
    stack: list = list(reversed(cell.children))
    while stack:
        x = stack.pop()
        if isinstance(x, _Element):
            stack.extend(reversed(x.children))
        elif x.strip():
            pieces.append(x.strip())
    return " / ".join(s for s in (inline(line) for line in "\n".join(pieces).splitlines()) if s).replace("|", "\\|")


def _span(value: str | None) -> int:
    try:
        return max(1, int(str(value)))
    except (TypeError, ValueError):
        return 1


def grid(table: _Element) -> list[list[str]]:
    """Texts of the table's own rows, spans filled with blanks, all rows as wide as the widest; blank rows dropped."""
    rows = []
    for r in _rows(table):
        row: list[str] = []
        for c in _cells(r):
            row += [_cell_text(c)] + [""] * (_span(c.attrs.get("colspan")) - 1)
        if any(x.strip() for x in row):
            rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def plain_upper(text: str) -> str:
    """Upper case without accents, `Đ` as `D`."""
    return "".join(c for c in unicodedata.normalize("NFD", text.upper()) if not unicodedata.combining(c)).replace("Đ", "D")


_PHRASES = tuple(map(plain_upper, HEAD_PHRASES))


def is_layout(rows: list[list[str]], classes: str = "") -> bool:
    """Whether a table only places text: marked so, a single row, column or filled cell, a document's head, or decoration."""
    if "detailcontent" in classes.lower().split() or len(rows) <= 1 or len(rows[0]) <= 1:
        return True
    filled = [c for r in rows for c in r if c.strip()]
    joined = plain_upper(" ".join(filled))
    numbered = re.search(r"\bSO\s*[:：]", joined) and all(w in joined for w in ("NGAY", "THANG", "NAM"))
    head = len(rows) <= 4 and (any(p in joined for p in _PHRASES) or bool(numbered))
    return len(filled) <= 1 or head or not "".join(filled).strip("_-–— ")


def pipe_table(rows: list[list[str]]) -> str:
    """Header, rule and body; a table of a header alone gets one blank row."""
    line = lambda cells: "| " + " | ".join(c.strip() for c in cells) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:] or [[""] * len(rows[0])])]) if rows else ""


def _render(e: _Element | str, depth: int = 0) -> str:
    if isinstance(e, str):
        return inline(e)
    if e.name in DROPPED:
        return ""
    if e.name == "br":
        return "\n"
    if depth > 300:  # unclosed tags by the hundred: what is deeper is read flat
        return "".join(inline(x) for y in [e, *_walk(e)] if y.name not in DROPPED for x in y.children if isinstance(x, str))
    if e.name == "table":
        rows = grid(e)
        if not is_layout(rows, e.attrs.get("class") or ""):
            return _block(pipe_table(rows))
        cells = [[_inside(c, depth) for c in _cells(r)] for r in _rows(e)]
        parts = ["\n\n".join(c for c in row if c.strip()) for row in cells]
        return _block("\n\n".join(p for p in parts if p.strip()))
    text = _inside(e, depth)
    return inline(text) if e.name in INLINE else _block(text) if e.name in BLOCKS else text


def _inside(e: _Element, depth: int) -> str:
    return "".join(_render(c, depth + 1) for c in e.children)


def _spaced(m: re.Match) -> str:
    s, i = m.string, m.start()
    a, b = s[i - 1], s[i]
    return " " if (a.islower() and (b.isupper() or b.isdigit())) or (a.isdigit() and b.isalpha()) else ""


def tidy_markdown(text: str) -> str:
    """Line edges trimmed, glued words parted, leftover markup removed, blank lines and blanks single."""
    s = re.sub(r"\n[ \t]+", "\n", re.sub(r"[ \t]+\n", "\n", text.replace("\xa0", " ")))
    s = _BOUNDARY.sub(_spaced, s)
    for pattern, by in _RESIDUE:
        s = pattern.sub(by, s)
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"\n{3,}", "\n\n", s)).strip()


def to_markdown(html: str | None) -> str:
    """Markdown of one document; null and blank give an empty string. The element with id `content`, else the body, is read."""
    if not html or not html.strip():
        return ""
    b = _Builder()
    b.feed(html)
    b.close()
    every = list(_walk(b.root))
    root = next((e for e in every if e.attrs.get("id") == "content"), None) or next((e for e in every if e.name == "body"), b.root)
    return tidy_markdown(_inside(root, 0))


@F.arrow_udf(T.StringType())
def _markdown(html: pa.Array) -> pa.Array:
    return pa.array([to_markdown(x) for x in html.to_pylist()], pa.string())


def html_to_markdown(c: Column) -> Column:
    return _markdown(c)


def markdown_facts(c: Column) -> tuple[Column, Column, Column]:
    """Characters, table rules, and whether tags are left."""
    return F.length(c).alias("n_chars"), F.regexp_count(c, F.lit(r"\| ---")).alias("n_rules"), c.rlike(r"(?i)</?[a-z][^>]*>").alias("tags_left")
