"""Document structure: Markdown blocks, typed levels, parents, ids, closure, adjacency and statistics, as window plans.

A document's blocks are bounded by its text; all windows share one partitioning by document.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions.text import clean_optional, nfc, node_slug, strip

_NUMERAL = r"([IVXLCDM]+|\d+)"


@dataclass(frozen=True)
class Level:
    """A kind of node: its depth, how its first line begins (group 1 the number), and whether group 2 is a title."""

    type: str
    level: int
    pattern: str
    titled: bool = False


#: The grammar of legal headings, tried in this order; whatever matches none is content.
GRAMMAR = (
    Level("appendix", 1, rf"^Phụ lục\s*{_NUMERAL}?(?:[.)-])?"),
    Level("part", 1, rf"^Phần\s+{_NUMERAL}(?:[.)-])?"),
    Level("chapter", 2, rf"^Chương\s+{_NUMERAL}(?:[.)-])?"),
    Level("section", 3, rf"^Mục\s+{_NUMERAL}(?:[.)-])?"),
    Level("article", 4, r"^Điều\s+(\d+[a-zA-Z]?)\s*[.)-]?\s*(.*)", True),
    Level("clause", 5, r"^(\d+)\s*[.)-]\s+(.+)", True),
    Level("point", 6, r"^([a-zđ])\s*[.)-]\s+(.+)", True),
)
#: The depths of the root and of leaves.
ROOT_LEVEL, LEAF_LEVEL = 0, 7
#: Verbs with which a block amends or repeals another text.
EDIT_VERBS = ("sửa đổi", "bổ sung", "thay đổi", "thay thế", "bãi bỏ", "hủy bỏ", "huỷ bỏ", "chỉnh sửa", "đình chỉ")

TABLE_LINE = r"\|(?:[^\n\x01]*\|)?"
TABLE_RULE = r"\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?"
#: Between blocks while a text is divided, and the start and end of a line then.
_BREAK = "\u0001"
_START, _END = r"(?<![^\n\x01])", r"(?![^\n\x01])"


def blocks_of(text: Column) -> Column:
    """Blocks in order: runs of table lines, and runs of other lines between blank ones; lines are trimmed."""
    lines = F.concat_ws("\n", F.transform(F.split(F.translate(text, _BREAK, " "), r"\R"), strip))
    marked = F.regexp_replace(lines, r"\n{2,}", _BREAK)
    marked = F.regexp_replace(marked, rf"{_START}({TABLE_LINE})\n(?!{TABLE_LINE}{_END})", f"$1{_BREAK}")
    marked = F.regexp_replace(marked, rf"{_START}(?!{TABLE_LINE}{_END})([^\n\x01]+)\n(?={TABLE_LINE}{_END})", f"$1{_BREAK}")
    return F.filter(F.transform(F.split(marked, _BREAK), strip), lambda b: b != "")


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key`, block_index (from 1), text. Null and blank texts give no rows."""
    b = df.select(key, F.posexplode(blocks_of(F.col(text))).alias("i", "text"))
    return b.select(key, (F.col("i") + 1).alias("block_index"), "text")


def is_table(text: Column) -> Column:
    """Two lines or more, the first a table line, and a rule among the second and third."""
    lines = F.filter(F.transform(F.split(text, r"\R"), strip), lambda x: x != "")
    rule = F.exists(F.slice(lines, 2, 2), lambda x: x.rlike(rf"\A{TABLE_RULE}\z"))
    return F.coalesce((F.size(lines) >= 2) & F.get(lines, 0).rlike(rf"\A{TABLE_LINE}\z") & rule, F.lit(False))


def with_levels(b: DataFrame, grammar: tuple[Level, ...] = GRAMMAR) -> DataFrame:
    """Blocks with type, level, number, title and is_edit, told by the first line of each."""
    b = b.withColumn("_t", nfc(strip(F.col("text"))))
    line = strip(F.element_at(F.split("_t", r"\R"), 1))
    table = is_table(F.col("_t"))
    kind = F.when(table, F.struct(F.lit("table").alias("type"), F.lit(LEAF_LEVEL).alias("level"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title")))
    for g in grammar:
        pattern = "(?iuU)" + g.pattern
        number = F.nullif(F.regexp_extract("_line", pattern, 1), F.lit(""))
        title = F.nullif(strip(F.regexp_extract("_line", pattern, 2)), F.lit("")) if g.titled else F.lit(None).cast("string")
        kind = kind.when(F.col("_line").rlike(pattern), F.struct(F.lit(g.type).alias("type"), F.lit(g.level).alias("level"), number.alias("number"), title.alias("title")))
    rest = F.struct(F.lit("content").alias("type"), F.lit(LEAF_LEVEL).alias("level"), F.lit(None).cast("string").alias("number"), F.lit(None).cast("string").alias("title"))
    edit = F.col("_t").rlike(r"(?iuU)^(?:Điều\s+\d+\s*[.)-]\s*)?(?:" + "|".join(EDIT_VERBS) + ")")
    out = b.withColumn("_line", line).withColumn("_k", kind.otherwise(rest)).withColumn("is_edit", edit)
    keep = [c for c in b.columns if c != "_t"]
    return out.select(*keep, "_k.type", "_k.level", "_k.number", "_k.title", "is_edit")


def _last_before(key: str, what: Column, depth: int) -> Column:
    w = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(F.col("level") == depth, what), ignorenulls=True).over(w)


def _chain(key: str, what: Column) -> Column:
    """For each node the last earlier node of every smaller depth that no later node of a smaller depth has closed."""
    seen = [_last_before(key, F.struct(F.col("block_index").alias("at"), what.alias("what")), d) for d in range(1, LEAF_LEVEL)]
    open_ = []
    for d, s in enumerate(seen, 1):
        above = F.greatest(F.lit(0), *[F.coalesce(x["at"], F.lit(0)) for x in seen[: d - 1]]) if d > 2 else F.coalesce(seen[0]["at"], F.lit(0)) if d == 2 else F.lit(0)
        open_.append(F.when((F.col("level") > d) & (s["at"] > above), s))
    return F.filter(F.array(*open_), lambda x: x.isNotNull())


def with_parents(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with parent_index: the nearest earlier node of smaller level, 0 for the root."""
    chain = nodes.withColumn("_c", _chain(key, F.lit(0)))
    return chain.withColumn("parent_index", F.coalesce(F.element_at(F.transform("_c", lambda x: x["at"]), F.when(F.size("_c") > 0, F.size("_c"))), F.lit(0))).drop("_c")


def with_ids(nodes: DataFrame, key: str) -> DataFrame:
    """Nodes with parent_index, segment, node_id, parent_id, path and ancestors (indexes from the outermost, 0 the root).

    A segment is type:slug of number, title or index; the second and later ones of a parent get :2, :3 and so on.
    """
    n = with_parents(nodes, key) if "parent_index" not in nodes.columns else nodes
    name = F.coalesce(F.nullif(F.col("number"), F.lit("")), F.nullif(F.col("title"), F.lit("")), F.col("block_index").cast("string"))
    n = n.withColumn("_s", F.concat_ws(":", "type", node_slug(name)))
    nth = F.row_number().over(Window.partitionBy(key, "parent_index", "_s").orderBy("block_index"))
    n = n.withColumn("segment", F.when(nth > 1, F.concat_ws(":", "_s", nth.cast("string"))).otherwise(F.col("_s"))).drop("_s")
    n = n.withColumn("_c", _chain(key, F.col("segment")))
    root = F.concat(F.lit("document:"), F.col(key).cast("string"))
    inner = F.transform("_c", lambda x: x["what"])
    base = F.concat(F.col(key).cast("string"), F.lit(":document"))
    n = n.withColumn("ancestors", F.concat(F.array(F.lit(0)), F.transform("_c", lambda x: x["at"])))
    n = n.withColumn("path", F.concat(F.array(root), inner, F.array(F.col("segment"))))
    return n.withColumn("parent_id", F.concat_ws(":", base, inner)).withColumn("node_id", F.concat_ws(":", "parent_id", "segment")).drop("_c")


def tree_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """All nodes of the documents of `df`, without the root, in document order by block_index."""
    return with_ids(with_levels(blocks(df, key, text)), key)


def roots(df: DataFrame, key: str, text: str, title: Column) -> DataFrame:
    """One root node a document with its parse_status: empty_content, no_blocks or ok."""
    t = clean_optional(title)
    status = F.when(F.coalesce(strip(F.col(text)), F.lit("")) == "", "empty_content").when(F.size(blocks_of(F.col(text))) == 0, "no_blocks").otherwise("ok")
    return df.select(key, F.concat(F.col(key).cast("string"), F.lit(":document")).alias("node_id"), t.alias("title"), F.coalesce(t, F.lit("")).alias("text"), status.alias("parse_status"))


def closure(nodes: DataFrame, key: str) -> DataFrame:
    """`key`, ancestor, descendant (indexes, 0 the root), depth: every ancestor of every node and itself; the root too."""
    line = F.concat("ancestors", F.array("block_index"))
    own = nodes.select(key, F.col("block_index").alias("descendant"), F.size("ancestors").alias("_n"), F.posexplode(line).alias("_i", "ancestor"))
    own = own.select(key, "ancestor", "descendant", (F.col("_n") - F.col("_i")).alias("depth"))
    top = nodes.select(key).distinct().select(key, F.lit(0).alias("ancestor"), F.lit(0).alias("descendant"), F.lit(0).alias("depth"))
    return own.unionByName(top)


def adjacency(nodes: DataFrame, key: str) -> DataFrame:
    """`key`, parent (0 the root), children in order; leaves have an empty list."""
    kids = nodes.groupBy(key, F.col("parent_index").alias("parent")).agg(F.sort_array(F.collect_list("block_index")).alias("children"))
    every = nodes.select(key, F.col("block_index").alias("parent")).unionByName(nodes.select(key, F.lit(0).alias("parent")).distinct())
    return every.join(kids, [key, "parent"], "left").select(key, "parent", F.coalesce("children", F.array().cast("array<int>")).alias("children"))


def statistics(nodes: DataFrame, key: str) -> DataFrame:
    """`key`, type, n: nodes of each type, the root counted as `document`."""
    own = nodes.groupBy(key, "type").agg(F.count("*").alias("n"))
    return own.unionByName(nodes.select(key).distinct().select(key, F.lit("document").alias("type"), F.lit(1).cast("long").alias("n")))


def subtree_text(nodes: DataFrame, key: str) -> DataFrame:
    """`key`, block_index, text: a node's own text and that of all below it, in document order, one line each."""
    below = closure(nodes, key).where("ancestor > 0").join(nodes.select(key, F.col("block_index").alias("descendant"), strip(F.col("text")).alias("_t")), [key, "descendant"])
    parts = F.sort_array(F.collect_list(F.when(F.col("_t") != "", F.struct("descendant", "_t"))))
    return below.groupBy(key, F.col("ancestor").alias("block_index")).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "\n").alias("text"))
