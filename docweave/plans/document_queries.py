"""Structure, enrichment, state and evidence over the tables; each with SQL where SQL can say it."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import html, text
from docweave.interfaces import encoded
from docweave.operators import chunking, enrich, evidence, filters, state, tree
from docweave.plans.search_queries import LAST_METADATA, clean_sql, date_sql, slug_sql
from docweave.session import shared_folder, staged, table
from docweave.sources import artifacts


def _docs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents")


def _last(spark: SparkSession, root: str) -> DataFrame:
    return enrich.last_wins(table(spark, root, "metadata"), "doc_id", "row_id")


def line_blocks(spark, root):
    return tree.blocks(_docs(spark, root), "doc_id", "text")


def detect_levels(spark, root):
    return tree.with_levels(line_blocks(spark, root)).drop("text")


def _tree(spark, root):
    return staged(tree.tree_of(_docs(spark, root), "doc_id", "text"), "tree")


def tree_parent(spark, root):
    return tree.with_parents(tree.with_levels(line_blocks(spark, root)), "doc_id").select("doc_id", "block_index", "parent_index")


def tree_node_ids(spark, root):
    return tree.tree_of(_docs(spark, root), "doc_id", "text").select("doc_id", "block_index", "node_id", "parent_id")


def tree_closure(spark, root):
    return tree.closure(_tree(spark, root), "doc_id")


def tree_adjacency(spark, root):
    return tree.adjacency(_tree(spark, root), "doc_id").select("doc_id", "parent", F.array_join(F.col("children").cast("array<string>"), ",").alias("children"))


def tree_stats(spark, root):
    return tree.statistics(_tree(spark, root), "doc_id")


def tree_roots(spark, root):
    return tree.roots(_docs(spark, root), "doc_id", "text", F.col("loai_van_ban")).select("doc_id", "title", "parse_status")


def subtree_text(spark, root):
    return tree.subtree_text(_tree(spark, root), "doc_id")


def uppercase_ratio(spark, root):
    c = table(spark, root, "nodes").where("text IS NOT NULL")
    return c.select("node_id", F.round(text.uppercase_ratio(F.col("text")), 6).alias("ratio"))


def boundary_spaces(spark, root):
    return table(spark, root, "nodes").where("text IS NOT NULL").select("node_id", text.boundary_spaces(F.col("text")).alias("text"))


def _markdown(spark, root):
    c = table(spark, root, "content_rows").select("row_id", text.reference_key(F.col("id")).alias("doc_id"), html.html_to_markdown(F.col("content_html")).alias("markdown"))
    return staged(c, "markdown")


def html_markdown(spark, root):
    return _markdown(spark, root)


def html_stats(spark, root):
    return _markdown(spark, root).select("row_id", *html.markdown_facts(F.col("markdown")))


def html_chunks(spark, root):
    """Content rows to chunks under the head of their metadata."""
    m = _last(spark, root).select("doc_id", chunking.document_head(F.col("loai_van_ban"), F.col("so_ky_hieu"), F.col("title")).alias("head"))
    docs = enrich.with_metadata(_markdown(spark, root).where("doc_id IS NOT NULL"), m, "doc_id")
    return chunking.extract_chunks(docs, "doc_id", "markdown", "head")


def document_chunks(spark, root):
    return chunking.extract_chunks(_docs(spark, root), "doc_id", "text")


def chunk_totals(spark, root):
    c = document_chunks(spark, root)
    return c.agg(
        F.countDistinct("doc_id").alias("docs_with_chunks"),
        F.count("*").alias("chunks"),
        F.count_if(F.col("article_number").isNotNull()).alias("in_articles"),
        F.count_if(F.col("source_node_type") == "table").alias("tables"),
        F.max("token_count").alias("max_tokens"),
    )


def enrich_left_join(spark, root):
    c = table(spark, root, "content_rows").select("row_id", text.reference_key(F.col("id")).alias("doc_id"))
    return enrich.with_metadata(c, _last(spark, root).select("doc_id", "title", "loai_van_ban"), "doc_id")


def _relationships(spark, root):
    return table(spark, root, "relationships").select(
        "row_id", text.reference_key(F.col("doc_id")).alias("doc_id"), text.reference_key(F.col("other_doc_id")).alias("other_doc_id"), text.clean_optional(F.col("relationship")).alias("relationship")
    )


def nested_relationships(spark, root):
    n = enrich.nested_relationships(_relationships(spark, root), "doc_id", "row_id", "other_doc_id", "relationship")
    line = F.transform("relationships", lambda r: F.concat(F.coalesce(r["relationship"], F.lit("")), F.lit(">"), F.coalesce(r["other_doc_id"], F.lit(""))))
    return n.select("doc_id", F.array_join(line, "|").alias("relationships"))


def relationship_target(spark, root):
    r = enrich.with_targets(_relationships(spark, root).where("other_doc_id IS NOT NULL"), _last(spark, root), "other_doc_id", "doc_id", "title", "loai_van_ban")
    return r.select("row_id", "other_doc_id", F.col("target.title").alias("title"), F.col("target.loai_van_ban").alias("loai_van_ban"))


def scope_semi(spark, root):
    c = table(spark, root, "content_rows").select(text.reference_key(F.col("id")).alias("doc_id"))
    return _relationships(spark, root).join(c, "doc_id", "left_semi").select("row_id", "doc_id")


def relationship_summary(spark, root):
    s = enrich.relationship_summary(_relationships(spark, root), "doc_id", "relationship", "other_doc_id", "row_id")
    return s.select("doc_id", F.array_join("relationship_labels", "|").alias("labels"), "relationship_count", F.array_join("related_doc_ids", "|").alias("related"))


def payload_project(spark, root):
    m = _last(spark, root)
    return m.select("doc_id", *enrich.payload_columns(m.columns))


def slug_keyword(spark, root):
    return table(spark, root, "metadata").select("row_id", *[text.keyword_slug(F.col(c)).alias(c) for c in filters.SLUG_FIELDS])


def point_ids(spark, root):
    return table(spark, root, "chunks").select("chunk_id", enrich.point_id(F.col("chunk_id"), F.col("pipeline_version")).alias("point_id"))


def parse_dates(spark, root):
    d = text.parse_date
    return table(spark, root, "metadata").select("row_id", *[x for c, y in enrich.DATE_YEARS.items() for x in (text.epoch_seconds(d(F.col(c))).alias(f"{c}_ts"), text.year_of(d(F.col(c))).alias(y))])


def facets(spark, root):
    return enrich.facets(_last(spark, root), ["loai_van_ban", "tinh_trang_hieu_luc", "pham_vi", "co_quan_ban_hanh", "nganh"])


def dedup_last_wins(spark, root):
    return _last(spark, root).select("doc_id", "row_id", "title")


def _status(spark, root):
    """Events as steps of an ingestion: purchase is done, error failed, all others processing; the id gives the order."""
    kind = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("processing")
    e = table(spark, root, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), kind.alias("event"), F.floor(F.abs("value")).cast("long").alias("chunks"), F.col("props").alias("error"))
    return state.fold_status(e)


def status_fold(spark, root):
    return state.recover_interrupted(_status(spark, root))


def status_rollup(spark, root):
    return state.status_counts(_status(spark, root))


def done_without_chunks(spark, root):
    return state.done_without_chunks(_status(spark, root), "doc_id").select("doc_id")


def resume_anti(spark, root):
    return state.to_resume(table(spark, root, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name"), _status(spark, root), "doc_id")


def dead_letters(spark, root):
    blank = F.when(F.col("text").isNull(), "no text").when(~F.col("text").rlike(r"(?U)\S"), "blank text")
    return state.dead_letters(_docs(spark, root), "doc_id", blank)


def shard_assignment(spark, root):
    return state.shards(_docs(spark, root).select("doc_id"), "doc_id", 100).groupBy("shard").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


def last_n_turns(spark, root):
    return evidence.last_turns(table(spark, root, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def history_prompt(spark, root):
    return evidence.history(table(spark, root, "events"), "user_id", "event_id", "event_type", "props")


def _evidence(spark, root):
    local = table(spark, root, "chunks").where("doc_id IS NOT NULL").select("doc_id", F.lit("local").alias("source"), F.col("chunk_id").alias("item_id"), F.col("chunk_index").cast("long").alias("ord"))
    web = _docs(spark, root).where("legal_doc_id IS NOT NULL AND source IS NOT NULL").select(F.col("legal_doc_id").alias("doc_id"), F.lit("web").alias("source"), F.col("source").alias("item_id"), (F.col("doc_id") + 1_000_000).alias("ord"))
    return evidence.packets(local.unionByName(web), "doc_id", "ord")


def evidence_assemble(spark, root):
    return _evidence(spark, root)[0].select("doc_id", "source", "item_id", "citation_id")


def evidence_coverage(spark, root):
    return _evidence(spark, root)[1]


def artifact_roundtrip(spark, root):
    """Points of all documents written as shards, read back by the manifest."""
    docs = _docs(spark, root).where("text IS NOT NULL")
    points = docs.select(enrich.point_id(F.col("doc_id").cast("string")).alias("id"), encoded(F.col("text")).alias("dense"), F.to_json(F.struct("doc_id", F.col("text").alias("context_text"))).alias("payload"))
    folder = f"{shared_folder(spark)}/artifact-{spark.range(1).select(F.uuid()).first()[0]}"
    manifest = artifacts.write_points(points, folder)
    back = artifacts.read_points(spark, folder)
    return back.agg(F.count("*").alias("points"), F.countDistinct("id").alias("ids"), F.max(F.size("dense")).alias("vector_size"), F.lit(json.dumps(manifest["bm25_options"])).alias("bm25"))


QUERIES = {
    f.__name__: f
    for f in (
        line_blocks, detect_levels, tree_parent, tree_node_ids, tree_closure, tree_adjacency, tree_stats, tree_roots, subtree_text, uppercase_ratio,
        boundary_spaces, html_markdown, html_stats, html_chunks, document_chunks, chunk_totals, enrich_left_join, nested_relationships,
        relationship_target, scope_semi, relationship_summary, payload_project, slug_keyword, point_ids, parse_dates, facets, dedup_last_wins,
        status_fold, status_rollup, done_without_chunks, resume_anti, dead_letters, shard_assignment, last_n_turns, history_prompt,
        evidence_assemble, evidence_coverage, artifact_roundtrip,
    )
}

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, '^{_WS}+|{_WS}+$', '', 'g')"


def _blocks(last: str) -> str:
    steps = rf"""
l AS (SELECT doc_id, generate_subscripts(p, 1) AS i, {_strip('unnest(p)')} AS line FROM (SELECT doc_id, string_split_regex(text, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM documents)),
k AS (SELECT *, CASE WHEN line = '' THEN 0 WHEN starts_with(line, '|') AND ends_with(line, '|') THEN 2 ELSE 1 END AS kind FROM l),
g AS (SELECT *, sum(CASE WHEN kind = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
      FROM (SELECT *, lag(kind, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM k)),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY run)::INT AS block_index, text
      FROM (SELECT doc_id, run, string_agg(line, chr(10) ORDER BY i) AS text FROM g WHERE kind > 0 GROUP BY ALL)),
f AS (SELECT *, nfc_normalize(split_part(text, chr(10), 1)) AS line, string_split(text, chr(10)) AS ls FROM b),
t AS (SELECT *, CASE WHEN len(ls) > 1 AND starts_with(ls[1], '|') AND ends_with(ls[1], '|') AND len(list_filter(ls[2:3], lambda x: regexp_full_match(x, '\|?\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?'))) > 0 THEN 'table' {_types()} ELSE 'content' END AS type FROM f),
n AS (SELECT *, CASE type WHEN 'appendix' THEN 1 WHEN 'part' THEN 1 WHEN 'chapter' THEN 2 WHEN 'section' THEN 3 WHEN 'article' THEN 4 WHEN 'clause' THEN 5 WHEN 'point' THEN 6 ELSE 7 END AS level,
        nullif(CASE type {_groups(1)} END, '') AS number, nullif({_strip(f"CASE type {_groups(2)} END")}, '') AS title FROM t),
a AS (SELECT *, {', '.join(f"coalesce(last_value(CASE WHEN level = {d} THEN block_index END IGNORE NULLS) OVER w, 0) AS a{d}" for d in range(1, 7))} FROM n
      WINDOW w AS (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, greatest(0, {', '.join(f"CASE WHEN level > {d} THEN a{d} ELSE 0 END" for d in range(1, 7))}) AS parent_index FROM a)"""
    return "WITH RECURSIVE " + steps.strip() + " " + last


def _sql_pattern(p: str) -> str:
    return "(?i)" + p.replace(r"\s", _WS)


def _types() -> str:
    return " ".join(f"WHEN regexp_matches(line, '{_sql_pattern(g.pattern)}') THEN '{g.type}'" for g in tree.GRAMMAR)


def _groups(n: int) -> str:
    return " ".join(f"WHEN '{g.type}' THEN regexp_extract(line, '{_sql_pattern(g.pattern)}', {n})" for g in tree.GRAMMAR if n == 1 or g.titled)


_CLOSURE = """, c AS (SELECT doc_id, block_index AS descendant, block_index AS ancestor, 0 AS depth FROM p
  UNION ALL SELECT c.doc_id, c.descendant, p.parent_index, c.depth + 1 FROM c JOIN p ON p.doc_id = c.doc_id AND p.block_index = c.ancestor)"""
_NODE_SLUG = r"coalesce(nullif(lower(trim(regexp_replace(regexp_replace(strip_accents(nfc_normalize({0})), '[^\x00-\x7F]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'none')"
_EDIT = "(?i)^(?:Điều" + _WS + r"+\d+" + _WS + r"*[.)-]" + _WS + "*)?(?:" + "|".join(tree.EDIT_VERBS) + ")"


def _key(e: str) -> str:
    t = f"trim({e}, chr(9) || ' ')"
    return f"CASE WHEN lower(trim({e})) IN ('', 'nan', 'none', '...') THEN NULL ELSE nullif(ltrim({t}, '0'), '') END"


_RELATIONSHIPS = f"r AS (SELECT row_id, {_key('doc_id')} AS doc_id, {_key('other_doc_id')} AS other_doc_id, {clean_sql('relationship')} AS relationship FROM relationships)"
_EVENTS = """e AS (SELECT user_id AS doc_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'processing' END AS event,
  floor(abs(value))::BIGINT AS chunks, props AS error FROM events),
s AS (SELECT doc_id, max_by(event, seq) AS status, count(*) FILTER (event = 'processing') AS attempt_count,
  coalesce(max_by(coalesce(chunks, 0), seq) FILTER (event = 'done'), 0) AS chunk_count,
  CASE WHEN coalesce(max(seq) FILTER (event = 'failed') > coalesce(max(seq) FILTER (event = 'done'), -1), false) THEN max_by(error, seq) FILTER (event = 'failed') END AS last_error FROM e GROUP BY doc_id)"""
_PAYLOAD = ", ".join(
    [f"{clean_sql(c)} AS {c}" for c in enrich.METADATA_COLUMNS[1:]]
    + [f"{clean_sql('title')} AS doc_title"]
    + [f"epoch({date_sql(c)})::BIGINT AS {c}_ts, year({date_sql(c)})::INT AS {y}" for c, y in enrich.DATE_YEARS.items()]
    + [f"{slug_sql(clean_sql(c))} AS {c}_slug" for c in filters.SLUG_FIELDS]
)
_UUID = "sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(pipeline_version || ':' || chunk_id))"
_EVIDENCE = """i AS (SELECT doc_id, 'local' AS source, chunk_id AS item_id, chunk_index::BIGINT AS ord FROM chunks WHERE doc_id IS NOT NULL
  UNION ALL SELECT legal_doc_id, 'web', source, doc_id + 1000000 FROM documents WHERE legal_doc_id IS NOT NULL AND source IS NOT NULL),
u AS (SELECT doc_id, source, item_id, min(ord) AS ord FROM i GROUP BY ALL)"""

SQL = {
    "line_blocks": _blocks("SELECT doc_id, block_index, text FROM b"),
    "detect_levels": _blocks(f"SELECT doc_id, block_index, type, level, number, title, regexp_matches(nfc_normalize(text), '{_EDIT}') AS is_edit FROM n"),
    "tree_parent": _blocks("SELECT doc_id, block_index, parent_index FROM p"),
    "tree_node_ids": _blocks(f""", s AS (SELECT *, type || ':' || {_NODE_SLUG.format("coalesce(number, title, block_index::VARCHAR)")} AS seg FROM p),
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, parent_index, seg ORDER BY block_index) AS nth FROM s),
z AS (SELECT doc_id, block_index, doc_id || ':document' AS parent_id, doc_id || ':document:' || seg || CASE WHEN nth > 1 THEN ':' || nth ELSE '' END AS node_id FROM q WHERE parent_index = 0
  UNION ALL SELECT q.doc_id, q.block_index, z.node_id, z.node_id || ':' || seg || CASE WHEN nth > 1 THEN ':' || nth ELSE '' END FROM q JOIN z ON z.doc_id = q.doc_id AND z.block_index = q.parent_index)
SELECT doc_id, block_index, node_id, parent_id FROM z"""),
    "tree_closure": _blocks(_CLOSURE + " SELECT * FROM c UNION ALL SELECT DISTINCT doc_id, 0, 0, 0 FROM p"),
    "tree_adjacency": _blocks("""SELECT e.doc_id, e.parent, coalesce(k.children, '') AS children
FROM (SELECT doc_id, block_index AS parent FROM p UNION ALL SELECT DISTINCT doc_id, 0 FROM p) e
LEFT JOIN (SELECT doc_id, parent_index AS parent, string_agg(block_index::VARCHAR, ',' ORDER BY block_index) AS children FROM p GROUP BY ALL) k USING (doc_id, parent)"""),
    "tree_stats": _blocks("SELECT doc_id, type, count(*) AS n FROM n GROUP BY ALL UNION ALL SELECT DISTINCT doc_id, 'document', 1 FROM n"),
    "subtree_text": _blocks(_CLOSURE + """ SELECT c.doc_id, c.ancestor AS block_index, string_agg(p.text, chr(10) ORDER BY c.descendant) AS text
FROM c JOIN p ON p.doc_id = c.doc_id AND p.block_index = c.descendant WHERE c.ancestor > 0 GROUP BY ALL"""),
    "uppercase_ratio": r"""WITH x AS (SELECT node_id, regexp_extract_all(text, '[A-Za-zÀ-ỹĐđ]') AS l FROM nodes WHERE text IS NOT NULL)
SELECT node_id, CASE WHEN len(l) > 0 THEN round(len(list_filter(l, lambda c: regexp_matches(c, '\p{Lu}'))) / len(l)::DOUBLE, 6) ELSE 0e0 END AS ratio FROM x""",
    "enrich_left_join": f"WITH {LAST_METADATA}, c AS (SELECT row_id, {_key('id')} AS doc_id FROM content_rows) SELECT c.row_id, c.doc_id, m.title, m.loai_van_ban FROM c LEFT JOIN m USING (doc_id)",
    "nested_relationships": f"WITH {_RELATIONSHIPS} SELECT doc_id, string_agg(coalesce(relationship, '') || '>' || coalesce(other_doc_id, ''), '|' ORDER BY row_id) AS relationships FROM r WHERE doc_id IS NOT NULL GROUP BY doc_id",
    "relationship_target": f"WITH {_RELATIONSHIPS}, {LAST_METADATA} SELECT r.row_id, r.other_doc_id, m.title, m.loai_van_ban FROM r LEFT JOIN m ON m.doc_id = r.other_doc_id WHERE r.other_doc_id IS NOT NULL",
    "scope_semi": f"WITH {_RELATIONSHIPS} SELECT row_id, doc_id FROM r WHERE doc_id IN (SELECT {_key('id')} FROM content_rows)",
    "relationship_summary": f"""WITH {_RELATIONSHIPS}, o AS (SELECT doc_id, other_doc_id, min(row_id) AS n FROM r WHERE other_doc_id IS NOT NULL GROUP BY doc_id, other_doc_id
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(row_id)) <= 16),
i AS (SELECT doc_id, string_agg(other_doc_id, '|' ORDER BY n) AS related FROM o GROUP BY doc_id)
SELECT r.doc_id, coalesce(string_agg(DISTINCT relationship, '|' ORDER BY relationship), '') AS labels, count(*) AS relationship_count, coalesce(any_value(i.related), '') AS related
FROM r LEFT JOIN i USING (doc_id) WHERE r.doc_id IS NOT NULL GROUP BY r.doc_id""",
    "payload_project": f"WITH {LAST_METADATA} SELECT doc_id, {_PAYLOAD} FROM m",
    "slug_keyword": "SELECT row_id, " + ", ".join(f"{slug_sql(c)} AS {c}" for c in filters.SLUG_FIELDS) + " FROM metadata",
    "point_ids": f"""SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
FROM (SELECT chunk_id, {_UUID} AS h FROM chunks)""",
    "parse_dates": "SELECT row_id, " + ", ".join(f"epoch({date_sql(c)})::BIGINT AS {c}_ts, year({date_sql(c)})::INT AS {y}" for c, y in enrich.DATE_YEARS.items()) + " FROM metadata",
    "facets": f"WITH {LAST_METADATA}, f AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS value FROM m" for c in ("loai_van_ban", "tinh_trang_hieu_luc", "pham_vi", "co_quan_ban_hanh", "nganh"))
    + ") SELECT field, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY field, value QUALIFY row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) <= 30",
    "dedup_last_wins": f"WITH {LAST_METADATA} SELECT doc_id, row_id, title FROM m",
    "status_fold": f"WITH {_EVENTS} SELECT doc_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, attempt_count, chunk_count, CASE WHEN status = 'processing' THEN coalesce(last_error, '{state.INTERRUPTED}') ELSE last_error END AS last_error FROM s",
    "status_rollup": f"WITH {_EVENTS} SELECT status, count(*) AS n, sum(chunk_count)::BIGINT AS chunks FROM s GROUP BY status",
    "done_without_chunks": f"WITH {_EVENTS} SELECT doc_id FROM s WHERE status = 'done' AND chunk_count = 0 ORDER BY doc_id LIMIT 50",
    "resume_anti": f"WITH {_EVENTS} SELECT c_custkey AS doc_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM s WHERE status = 'done')",
    "dead_letters": """SELECT doc_id, error, to_json({'doc_id': doc_id, 'error': error, 'row': {'id': doc_id}})::VARCHAR AS record
FROM (SELECT doc_id, CASE WHEN text IS NULL THEN 'no text' WHEN NOT regexp_matches(text, '[^\\s\\x{85}\\x{A0}]') THEN 'blank text' END AS error FROM documents) WHERE error IS NOT NULL""".replace("\\\\", "\\"),
    "shard_assignment": "SELECT shard, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 100)::BIGINT AS shard FROM documents) GROUP BY shard",
    "last_n_turns": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
    "history_prompt": "WITH t AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3) SELECT user_id, string_agg(event_type || ': ' || props, chr(10) ORDER BY event_id) AS prompt FROM t GROUP BY user_id",
    "evidence_assemble": f"""WITH {_EVIDENCE}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY ord) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord, item_id) AS r FROM u)
SELECT doc_id, source, item_id, '[' || CASE source WHEN 'web' THEN 'W' ELSE 'E' END || n || ']' AS citation_id FROM n WHERE r <= 10""",
    "evidence_coverage": f"""WITH {_EVIDENCE}, g AS (SELECT doc_id, count(*) FILTER (source = 'local') AS n_local, count(*) AS n_items FROM u GROUP BY doc_id),
c AS (SELECT *, CASE WHEN n_local >= 3 THEN 'sufficient' WHEN n_local >= 1 AND n_items >= 2 THEN 'partial' ELSE 'weak' END AS coverage FROM g)
SELECT *, CASE coverage WHEN 'sufficient' THEN 0.75e0 WHEN 'partial' THEN 0.6e0 ELSE 0.4e0 END AS confidence FROM c""",
}
