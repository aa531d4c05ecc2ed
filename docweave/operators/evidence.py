"""Evidence of an answer: hits of several tools joined, each once, numbered by source, with coverage; session history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of a packet, citations, code points of a web text, turns kept and turns shown.
MAX_ITEMS, MAX_CITATIONS, WEB_TEXT, KEPT_TURNS, SHOWN_TURNS = 10, 5, 4000, 10, 3
CONFIDENCE = {"sufficient": 0.75, "partial": 0.6, "weak": 0.4, "none": 0.2}


def filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def search_hits(points: DataFrame) -> DataFrame:
    """Hits with fallbacks: the point's id for missing ids, `Unknown document` for titles, 0 for scores."""
    c = points.columns
    col = lambda n: F.col(n) if n in c else F.lit(None).cast("string")
    return points.select(
        filled(col("chunk_id"), col("point_id")).alias("chunk_id"),
        filled(col("doc_id"), col("point_id")).alias("doc_id"),
        F.coalesce(filled(col("title"), col("doc_title")), F.lit("Unknown document")).alias("title"),
        filled(col("article_number"), col("article")).alias("article_number"),
        filled(col("clause_number"), col("clause")).alias("clause_number"),
        col("text").alias("text"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
    )


def web_items(pages: DataFrame) -> DataFrame:
    """Web hits as evidence: pages without url are dropped; text is markdown, else description, else title, cut to WEB_TEXT."""
    text = filled(F.col("markdown"), F.col("description"), F.col("title"))
    return pages.where(F.coalesce(F.col("url"), F.lit("")) != "").withColumn("title", F.coalesce(filled(F.col("title"), F.col("url")), F.lit("Untitled"))).withColumn("text", F.substring(text, 1, WEB_TEXT))


def numbered(items: DataFrame, by: str, order: str) -> DataFrame:
    """Items (`by`, `order`, source `local` or `web`, item_id) each once, the first kept, with citation_id [E1].. or [W1].."""
    first = items.groupBy(by, "source", "item_id").agg(F.min(order).alias(order))
    n = F.row_number().over(Window.partitionBy(by, "source").orderBy(order))
    mark = F.when(F.col("source") == "web", "W").otherwise("E")
    return first.withColumn("citation_id", F.concat(F.lit("["), mark, n.cast("string"), F.lit("]")))


def packets(items: DataFrame, by: str, order: str, most: int = MAX_ITEMS) -> tuple[DataFrame, DataFrame]:
    """The first `most` numbered items of each group, and its summary: counts, coverage and confidence over all of them."""
    every = numbered(items, by, order)
    local, n = F.count_if(F.col("source") == "local"), F.count("*")
    g = every.groupBy(by).agg(local.alias("n_local"), n.alias("n_items"))
    cover = F.when(F.col("n_local") >= 3, "sufficient").when((F.col("n_local") >= 1) & (F.col("n_items") >= 2), "partial").otherwise("weak")
    g = g.withColumn("coverage", cover)
    sure = F.when(F.col("coverage") == "sufficient", CONFIDENCE["sufficient"]).when(F.col("coverage") == "partial", CONFIDENCE["partial"]).otherwise(CONFIDENCE["weak"])
    cut = every.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order, "item_id"))).where(F.col("_r") <= most)
    return cut.drop("_r"), g.withColumn("confidence", sure)


def last_turns(turns: DataFrame, session: str, order: str, keep: int = KEPT_TURNS) -> DataFrame:
    """The newest `keep` turns of each session; sessions are cut before they move."""
    r = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return turns.withColumn("_r", r).where(F.col("_r") <= keep).drop("_r")


def history(turns: DataFrame, session: str, order: str, speaker: str, text: str, shown: int = SHOWN_TURNS) -> DataFrame:
    """`session`, prompt: the last turns in order, one line each."""
    t = last_turns(turns, session, order, shown)
    lines = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.concat_ws(": ", speaker, text).alias("line"))))
    return t.groupBy(session).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))
