"""Rows that fail to parse (problem 4): strict load, anti-join of offsets, and a diagnosis of the remainder.

Only offsets and reasons are joined; the text of a record never moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import NULL_WORDS

#: The columns of each delivered file.
FILE_COLUMNS = {
    "content.csv": ["id", "content_html"],
    "metadata.csv": [
        "id",
        "title",
        "so_ky_hieu",
        "ngay_ban_hanh",
        "loai_van_ban",
        "ngay_co_hieu_luc",
        "ngay_het_hieu_luc",
        "nganh",
        "linh_vuc",
        "co_quan_ban_hanh",
        "pham_vi",
        "tinh_trang_hieu_luc",
    ],
}
#: The date columns of metadata.csv.
DATE_COLUMNS = ("ngay_ban_hanh", "ngay_co_hieu_luc", "ngay_het_hieu_luc")

#: One field. Possessive throughout: a record is read once, without backtracking or deep recursion.
FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
RECORD = rf"\A{FIELD}(?:,{FIELD})*+\z"


def _edges(c: Column) -> Column:
    return F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", "")


def _fields(line: Column) -> Column:
    """The unquoted fields of a record whose quoting is sound."""
    raw = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(f"({FIELD}),"), F.lit(1))
    return F.transform(
        raw,
        lambda x: F.when(x.startswith('"'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x),
    )


def _date_ok(c: Column) -> Column:
    s = _edges(c)
    null = F.lower(s).isin(*NULL_WORDS) | ~s.rlike(r"(?U)\S")
    real = [
        s.rlike(p) & F.try_to_timestamp(s, F.lit(f)).isNotNull()
        for p, f in (
            (r"\A[0-9]{1,2}/[0-9]{1,2}/(?!0000)[0-9]{4}\z", "d/M/yyyy"),
            (r"\A(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", "yyyy-M-d"),
            (r"\A[0-9]{1,2}-[0-9]{1,2}-(?!0000)[0-9]{4}\z", "d-M-yyyy"),
        )
    ]
    return F.coalesce(null | reduce(lambda a, b: a | b, real), F.lit(False))


def _id_ok(c: Column) -> Column:
    return _edges(c).rlike(r"\A[0-9]{1,12}\z")


def _html_ok(c: Column) -> Column:
    return c.rlike(r"(?U)\S") & ~c.rlike(r"[\x{FFFD}\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}]")


def _columns_of(file_name: Column) -> Column:
    return reduce(lambda e, kv: e.when(file_name == kv[0], F.lit(len(kv[1]))), FILE_COLUMNS.items(), F.when(F.lit(False), F.lit(0)))


def with_offsets(raw: DataFrame) -> DataFrame:
    """The record, and the offset that names it: file, line, row id and a hash of the line."""
    line = F.coalesce(F.col("raw_line"), F.lit(""))
    return raw.select(
        F.col("raw_id"),
        F.col("file_name"),
        F.col("line_no"),
        F.struct("file_name", "line_no", "raw_id", F.xxhash64(line).alias("hash")).alias("_offset"),
        line.alias("_line"),
    )


def _conforms(file_name: str) -> Column:
    """Whether a record of that file conforms in every respect; cheap tests first."""
    names = FILE_COLUMNS[file_name]
    at = lambda n: F.get(_fields(F.col("_line")), names.index(n))
    ok = F.col("_line").rlike(rf"\A{FIELD}(?:,{FIELD}){{{len(names) - 1}}}+\z")
    tests = [_id_ok(at("id"))] + [_html_ok(at(n)) for n in names if n == "content_html"] + [_date_ok(at(d)) for d in DATE_COLUMNS if d in names]
    return F.when(ok, reduce(lambda a, b: a & b, tests)).otherwise(F.lit(False))


def strict_load(records: DataFrame, file_name: str) -> DataFrame:
    """Only the records of one file that conform in every respect, with their named fields."""
    names = FILE_COLUMNS[file_name]
    ok = records.where((F.col("file_name") == file_name) & _conforms(file_name)).withColumn("_f", _fields(F.col("_line")))
    at = lambda n: F.get(F.col("_f"), names.index(n))
    return ok.select("raw_id", "line_no", *[(_edges(at(n)) if n == "id" else at(n)).alias(n) for n in names])


def loaded_offsets(records: DataFrame) -> DataFrame:
    """The offsets of all records that a strict load takes, of every file in one scan."""
    ok = reduce(lambda e, n: e.when(F.col("file_name") == n, _conforms(n)), FILE_COLUMNS, F.when(F.lit(False), F.lit(False)))
    return records.where(F.coalesce(ok, F.lit(False))).select("_offset")


def diagnose(records: DataFrame) -> DataFrame:
    """_offset and the first reason that holds for each record, null if none does."""
    f = F.col("_f")
    meta = FILE_COLUMNS["metadata.csv"]
    dates_bad = reduce(lambda a, b: a | b, [~_date_ok(F.get(f, meta.index(d))) for d in DATE_COLUMNS])
    reason = (
        F.when(~F.col("_line").rlike(RECORD), "quoting")
        .when(_columns_of(F.col("file_name")).isNull(), "unknown_file")
        .when(F.size(f) != _columns_of(F.col("file_name")), "column_count")
        .when(~_id_ok(F.get(f, 0)), "bad_id")
        .when((F.col("file_name") == "metadata.csv") & dates_bad, "bad_date")
        .when((F.col("file_name") == "content.csv") & ~_html_ok(F.get(f, 1)), "bad_html")
    )
    fields = F.when(F.col("_line").rlike(RECORD), _fields(F.col("_line")))
    return records.withColumn("_f", fields).select("_offset", reason.alias("reason"))


def rejected(raw: DataFrame) -> DataFrame:
    """raw_id, file_name, line_no and reason of every record that is not loaded.

    The rejected records are the raw offsets less the loaded offsets, so that no record can be in both
    parts or in neither. Each side is one scan that gives offsets alone, the raw one with its diagnosis. The join
    key is unique per record: no key is hot. A null raw_line counts as an empty record (column_count); a null or
    unknown file_name is `unknown_file` unless its quoting is broken; repeated rows stay repeated; an empty
    table gives no rows; other columns are not read.
    """
    records = with_offsets(raw)
    kept = loaded_offsets(records).select(F.col("_offset").alias("_loaded"))
    seen = diagnose(records)
    rest = seen.join(kept, seen["_offset"].eqNullSafe(kept["_loaded"]), "left_anti")
    return rest.select("_offset.raw_id", "_offset.file_name", "_offset.line_no", F.coalesce("reason", F.lit("unknown")).alias("reason"))


def split_load(raw: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The loaded rows of each file, and every other record with its reason; see `rejected`."""
    records = with_offsets(raw)
    return {name: strict_load(records, name) for name in FILE_COLUMNS}, rejected(raw)
