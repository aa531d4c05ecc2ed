"""Goldens of blocks, levels, trees and chunks."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import chunking, tree
from docweave.operators.chunking import ChunkRules, chunk_document


def cut(md, **rules):
    return chunk_document("d", md, "D", ChunkRules(**rules))


def levels(spark, *blocks):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate(blocks)], "doc int, block_index int, text string")
    return [(r.type, r.number, r.title) for r in tree.with_levels(df).orderBy("block_index").collect()]


def test_levels(spark):
    got = levels(spark, "ĐIỀU 5. Phạm vi", "Phần chung", "1. abc", "a) abc", "Phụ lục", "| a | b |\n| --- | --- |", "Chương II", "abc")
    assert got == [
        ("article", "5", "Phạm vi"),
        ("part", "c", None),
        ("clause", "1", "abc"),
        ("point", "a", "abc"),
        ("appendix", None, None),
        ("table", None, None),
        ("chapter", "II", None),
        ("content", None, None),
    ]


def test_python_and_spark_tell_the_same_levels(spark):
    blocks = ["ĐIỀU 5. Phạm vi", "Phần chung", "đ) abc", "12 - x", "Mục 3", "|a|", "x"]
    assert levels(spark, *blocks) == [(n.type, n.number, n.title) for n in map(chunking.classify, blocks)]


def test_python_and_spark_give_the_same_blocks(spark):
    texts = ["a\nb\n\n| x |\n| y |\nc\n| z |\n\n\n d ", "", "|a|", "a\n|b|\nc", "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = [list(r[0]) for r in df.orderBy("i").select(tree.blocks_of(F.col("text"))).collect()]
    assert got == [list(chunking.parse_blocks(t)) for t in texts]


def test_parents_of_levels(spark):
    df = spark.createDataFrame([(1, i, lv) for i, lv in enumerate((4, 5, 6, 5, 7, 4), 1)], "doc int, block_index int, level int")
    got = [r.parent_index for r in tree.with_parents(df, "doc").orderBy("block_index").collect()]
    assert got == [0, 1, 2, 1, 4, 0]


def test_repeated_siblings_are_numbered(spark):
    df = spark.createDataFrame([(7, "Điều 1. A\n\n1. x\n\n1. y")], "doc int, text string")
    ids = [r.node_id for r in tree.tree_of(df, "doc", "text").orderBy("block_index").collect()]
    assert ids == ["7:document:article:1", "7:document:article:1:clause:1", "7:document:article:1:clause:1:2"]


def test_closure_has_depth_plus_one_rows(spark):
    df = spark.createDataFrame([(7, "Điều 1. A\n\n1. x\n\na) y"), (8, None), (9, " ")], "doc int, text string")
    t = tree.tree_of(df, "doc", "text")
    assert tree.closure(t, "doc").count() == 1 + 2 + 3 + 4
    assert {r.parse_status for r in tree.roots(df, "doc", "text", F.lit(None).cast("string")).collect()} == {"ok", "empty_content"}


def test_compact_article():
    (c,) = cut("Điều 1. X\n\none two", chunk_size=10)
    assert (c["text"], c["context_text"], c["article_number"]) == ("Điều 1. X\none two", "D\nĐiều 1. X\none two", "1")


def test_oversized_article():
    a, b, c = cut("Điều 1. X\n\n1. a b\n\n2. c d", chunk_size=6)
    assert a["text"] == "Điều 1. X" and b["context_text"] == "D\nĐiều 1. X\nKhoản 1\n1. a b" and (b["clause_number"], c["clause_number"]) == ("1", "2")


def test_title_child_and_bare_container():
    a, b = cut("Chương II\n\nQUY ĐỊNH CHUNG\n\nĐiều 1. X\n\none two three four five", chunk_size=8)
    assert a["text"] == "Chương II\nQUY ĐỊNH CHUNG" and b["content_path"][:2] == ["Chương II", "QUY ĐỊNH CHUNG"]
    only = cut("Chương II\n\nĐiều 1. X\n\none two three four five", chunk_size=8)
    assert [c["content_path"][0] for c in only] == ["Chương II"]


def test_low_value_and_decoration():
    assert cut("a b c") == [] and cut("-----") == [] and len(cut("Điều 1. X\n\na b c")) == 1


@pytest.mark.parametrize(("size", "n"), [(200, 1), (30, 2)])
def test_neighbours_merge_while_they_fit(size, n):
    words = " ".join(f"w{i}" for i in range(25))
    got = cut(f"{words}\n\n{words}", chunk_size=size)
    assert len(got) == n and got[0]["text"].split("\n")[0] == words


def test_table_keeps_its_header():
    rows = "\n".join(f"| r{i} x y |" for i in (1, 2, 3))
    got = chunking.split_table(f"| a | b |\n| --- | --- |\n{rows}", ChunkRules(table_size=21))
    assert [p.count("\n") for p in got] == [3, 2] and all(p.startswith("| a | b |\n| --- | --- |\n") for p in got)


def test_overlap():
    assert [chunking.effective_overlap(s, 64) for s in (500, 100, 1)] == [64, 25, 0]


def test_split_pieces_fit_and_cover():
    text = ". ".join(" ".join(f"s{i}w{j}" for j in range(7)) for i in range(30))
    got = chunking.split_text(text, 20, 5)
    assert all(len(p.split()) <= 20 for p in got) and {w.strip(".") for p in got for w in p.split()} == {w.strip(".") for w in text.split()}
