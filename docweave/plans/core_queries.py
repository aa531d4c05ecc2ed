"""Queries of the general problems, with the same results in ANSI SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators import orphans, packed_values, rejects
from docweave.session import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return p3_values(spark, root).select("row_id", "field_name", "pos", "item")


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    return packed_values.split_packed(table(spark, root, "metadata"), "row_id", ["nganh", "linh_vuc"], table(spark, root, "sector_catalog"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return rejects.rejected(table(spark, root, "raw_rows")).select("raw_id", "reason")


def p4_loaded_content(spark: SparkSession, root: str) -> DataFrame:
    return rejects.split_load(table(spark, root, "raw_rows"))[0]["content.csv"]


def p4_loaded_metadata(spark: SparkSession, root: str) -> DataFrame:
    return rejects.split_load(table(spark, root, "raw_rows"))[0]["metadata.csv"]


def p4_reasons(spark: SparkSession, root: str) -> DataFrame:
    rest = rejects.rejected(table(spark, root, "raw_rows"))
    return rest.groupBy("file_name", "reason").agg(F.count("*").alias("n_records"))


def _orphans(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_references(table(spark, root, "relationships"), table(spark, root, "metadata"), table(spark, root, "content_rows"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return _orphans(spark, root).select("ref_field", "row_id", "period", "reason")


def p5_counts(spark: SparkSession, root: str) -> DataFrame:
    return orphans.orphan_counts(_orphans(spark, root))


QUERIES = {
    "p3_found": p3_found,
    "p3_values": p3_values,
    "p4_found": p4_found,
    "p4_loaded_content": p4_loaded_content,
    "p4_loaded_metadata": p4_loaded_metadata,
    "p4_reasons": p4_reasons,
    "p5_found": p5_found,
    "p5_counts": p5_counts,
}

_FIELD = '(?:"(?:[^"]|"")*"|[^",]*)'
_NULLISH = "('', 'nan', 'none', '...')"


def _unquoted(e: str) -> str:
    return f"CASE WHEN starts_with({e}, '\"') THEN replace(substr({e}, 2, length({e}) - 2), '\"\"', '\"') ELSE {e} END"


def _nth(n: int) -> str:
    skip = f"(?:{_FIELD},){{{n}}}" if n else ""
    return _unquoted(f"regexp_extract(line, '^{skip}({_FIELD})', 1)")


def _sql_date_bad(e: str) -> str:
    s = f"trim({e}, chr(9) || ' ')"
    real = " OR ".join(
        f"(regexp_matches({s}, '{p}') AND try_strptime({s}, '{f}') IS NOT NULL)"
        for p, f in (("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "%d/%m/%Y"), ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "%Y-%m-%d"), ("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$", "%d-%m-%Y"))
    )
    return f"NOT (lower({s}) IN {_NULLISH} OR {real})"


_P4 = rf"""
WITH r AS (SELECT raw_id, file_name, coalesce(raw_line, '') AS line FROM raw_rows),
q AS (SELECT *, regexp_matches(line, '^{_FIELD}(?:,{_FIELD})*$') AS sound,
             length(regexp_replace(line, '"([^"]|"")*"', '', 'g')) - length(replace(regexp_replace(line, '"([^"]|"")*"', '', 'g'), ',', '')) + 1 AS n_fields FROM r),
f AS (SELECT *, {_nth(0)} AS id, {_nth(1)} AS second, {_nth(3)} AS d1, {_nth(5)} AS d2, {_nth(6)} AS d3 FROM q),
g AS (SELECT raw_id, file_name, CASE
        WHEN NOT sound THEN 'quoting'
        WHEN n_fields <> CASE file_name WHEN 'content.csv' THEN 2 ELSE 12 END THEN 'column_count'
        WHEN NOT regexp_matches(trim(id, chr(9) || ' '), '^[0-9]{{1,12}}$') THEN 'bad_id'
        WHEN file_name = 'metadata.csv' AND ({_sql_date_bad('d1')} OR {_sql_date_bad('d2')} OR {_sql_date_bad('d3')}) THEN 'bad_date'
        WHEN file_name = 'content.csv' AND (NOT regexp_matches(second, '[^\s]') OR regexp_matches(second, '[\x{{FFFD}}\x00-\x08\x0B\x0C\x0E-\x1F]')) THEN 'bad_html'
      END AS reason FROM f)
"""


def _key(e: str) -> str:
    t = f"trim({e}, chr(9) || ' ')"
    return f"CASE WHEN lower(trim({e})) IN {_NULLISH} THEN NULL ELSE nullif(ltrim({t}, '0'), '') END"


_P5 = f"""
WITH m AS (SELECT {_key('doc_id')} AS k, min(loaded_at) AS la, min(deleted_at) AS da FROM metadata GROUP BY 1),
c AS (SELECT {_key('id')} AS k, min(loaded_at) AS la FROM content_rows GROUP BY 1),
r AS (SELECT 'relationships.doc_id' AS ref_field, row_id, {_key('doc_id')} AS k, recorded_at AS ts FROM relationships
      UNION ALL SELECT 'relationships.other_doc_id', row_id, {_key('other_doc_id')}, recorded_at FROM relationships),
f AS (SELECT r.ref_field, r.row_id, r.k, r.ts, CASE WHEN m.k IS NULL THEN 'missing' WHEN m.la > r.ts THEN 'late' WHEN m.da <= r.ts THEN 'deleted' END AS reason
      FROM r LEFT JOIN m ON r.k = m.k WHERE r.k IS NOT NULL
      UNION ALL
      SELECT 'metadata.doc_id', d.row_id, d.k, d.loaded_at, CASE WHEN c.k IS NULL THEN 'missing' WHEN c.la > d.loaded_at THEN 'late' END
      FROM (SELECT row_id, {_key('doc_id')} AS k, loaded_at FROM metadata) d LEFT JOIN c ON d.k = c.k WHERE d.k IS NOT NULL)
"""

_EDGES = "trim({0}, chr(9) || ' ')"
_P4_META = ", ".join(f"{_nth(i)} AS {c}" for i, c in enumerate(rejects.FILE_COLUMNS["metadata.csv"]) if i)

SQL = {
    "p4_loaded_content": _P4
    + f"SELECT g.raw_id, r.line_no, {_EDGES.format('f.id')} AS id, f.second AS content_html FROM g JOIN f USING (raw_id) JOIN raw_rows r USING (raw_id) WHERE g.reason IS NULL AND g.file_name = 'content.csv'",
    "p4_loaded_metadata": _P4
    + f"SELECT raw_id, line_no, {_EDGES.format(_nth(0))} AS id, {_P4_META} FROM (SELECT g.raw_id, r.line_no, f.line FROM g JOIN f USING (raw_id) JOIN raw_rows r USING (raw_id) WHERE g.reason IS NULL AND g.file_name = 'metadata.csv')",
    "p4_found": _P4 + "SELECT raw_id, reason FROM g WHERE reason IS NOT NULL",
    "p4_reasons": _P4 + "SELECT file_name, reason, count(*) AS n_records FROM g WHERE reason IS NOT NULL GROUP BY 1, 2",
    "p5_found": _P5 + "SELECT ref_field, row_id, strftime(ts, '%Y-%m') AS period, reason FROM f WHERE reason IS NOT NULL",
    "p5_counts": _P5 + "SELECT ref_field, strftime(ts, '%Y-%m') AS period, reason, count(*) AS n_refs, count(DISTINCT k) AS n_keys FROM f WHERE reason IS NOT NULL GROUP BY 1, 2, 3",
}
