"""Search filters as one Column predicate: any of a list, slugs, and inclusive date ranges."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, fields
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import NULL_WORDS

#: The payload columns that filters use; slug columns end in _slug, epoch seconds in _ts.
SLUG_FIELDS = ("so_ky_hieu", "loai_van_ban", "co_quan_ban_hanh", "pham_vi", "tinh_trang_hieu_luc", "nganh", "linh_vuc")
KEYWORD_COLUMNS = ("doc_id", "chunk_id", *(c for f in SLUG_FIELDS for c in (f, f + "_slug")), "source_node_type")
INTEGER_COLUMNS = (
    "chunk_index",
    "token_count",
    "relationship_count",
    "ngay_ban_hanh_ts",
    "ngay_co_hieu_luc_ts",
    "ngay_het_hieu_luc_ts",
    "issue_year",
    "effective_year",
    "expiry_year",
)
DATE_FORMATS = ("%d/%m/%Y", "%Y-%m-%d", "%d-%m-%Y")


@dataclass(frozen=True)
class SearchFilters:
    """What a search may be narrowed by; empty lists and blank strings narrow nothing."""

    doc_ids: tuple[str, ...] | None = None
    so_ky_hieu: tuple[str, ...] | None = None
    loai_van_ban: tuple[str, ...] | None = None
    co_quan_ban_hanh: tuple[str, ...] | None = None
    pham_vi: tuple[str, ...] | None = None
    tinh_trang_hieu_luc: tuple[str, ...] | None = None
    nganh: tuple[str, ...] | None = None
    linh_vuc: tuple[str, ...] | None = None
    issue_date_from: str | None = None
    issue_date_to: str | None = None
    effective_date_from: str | None = None
    effective_date_to: str | None = None


def indexed_columns() -> dict[str, str]:
    """Filterable columns and their kind."""
    return dict.fromkeys(KEYWORD_COLUMNS, "keyword") | dict.fromkeys(INTEGER_COLUMNS, "integer")


def sanitized(filters: SearchFilters | None) -> SearchFilters | None:
    """Trimmed values, blanks dropped; None when nothing is left."""
    if filters is None:
        return None
    clean: dict[str, object] = {}
    for f in fields(filters):
        value = getattr(filters, f.name)
        if isinstance(value, str):
            clean[f.name] = value.strip() or None
        elif value:
            clean[f.name] = tuple(v.strip() for v in map(str, value) if v.strip()) or None
    return SearchFilters(**clean) if any(clean.values()) else None


def effective_filters(filters: SearchFilters | None, sector: str | None) -> SearchFilters | None:
    """The shorthand `sector` counts only where no filters are given."""
    if filters is None and sector and sector.strip():
        return SearchFilters(nganh=(sector,))
    return filters


def slug(value: str | None) -> str | None:
    """The driver-side twin of text.keyword_slug."""
    if value is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", value.strip().lower()).replace("đ", "d") if not unicodedata.combining(c))
    return re.sub("[^0-9a-z]+", "_", plain).strip("_") or None


def epoch_of(text: str | None) -> int | None:
    """Epoch seconds of a date in one of the three spellings at midnight UTC; None for null words and all else."""
    s = (text or "").strip()
    if not s or s.lower() in NULL_WORDS:
        return None
    for form in DATE_FORMATS:
        try:
            return int(datetime.strptime(s, form).replace(tzinfo=UTC).timestamp())
        except ValueError:
            continue
    return None


def any_of(column: str, values: tuple[str, ...] | None) -> Column | None:
    """Equality with one of the trimmed values; None when all are blank."""
    clean = [v.strip() for v in map(str, values or ()) if v.strip()]
    return F.col(column).isin(*clean) if clean else None


def any_slug(column: str, values: tuple[str, ...] | None) -> Column | None:
    """The same over slugs on both sides; a value is one slug, separators in it do not split it."""
    return any_of(column, tuple(x for x in map(slug, values or ()) if x))


def date_between(column: str, start: str | None, end: str | None) -> Column | None:
    """Inclusive bounds; a bound that is no date is open, both open is no condition, and a null date never matches."""
    low, high = epoch_of(start), epoch_of(end)
    bounds = [F.col(column) >= low] * (low is not None) + [F.col(column) <= high] * (high is not None)
    return reduce(lambda a, b: a & b, bounds) if bounds else None


def predicate(filters: SearchFilters | None) -> Column | None:
    """All conditions together; None when there are none."""
    if filters is None:
        return None
    parts = [any_of("doc_id", filters.doc_ids)]
    parts += [any_slug(f"{f}_slug", getattr(filters, f)) for f in SLUG_FIELDS]
    parts += [date_between("ngay_ban_hanh_ts", filters.issue_date_from, filters.issue_date_to)]
    parts += [date_between("ngay_co_hieu_luc_ts", filters.effective_date_from, filters.effective_date_to)]
    parts = [p for p in parts if p is not None]
    return reduce(lambda a, b: a & b, parts) if parts else None


def filtered(payload: DataFrame, filters: SearchFilters | None) -> DataFrame:
    """Rows of a payload table that match; the predicate reaches the scan."""
    p = predicate(filters)
    return payload if p is None else payload.where(p)
