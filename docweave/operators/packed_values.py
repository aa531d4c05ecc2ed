"""Several values packed in one field (problem 3): a parsing expression grammar over each field.

    field   <- sep* (item (sep+ item)*)? sep* end
    item    <- list / quoted / listed_name / bare          ordered alternatives
    list    <- '[' JSON array ']'                  followed by a separator or the end
    quoted  <- mark (doubled mark / not mark)* mark followed by a separator or the end
    listed_name <- a catalogue name, longest first     followed by a separator or the end
    bare    <- everything up to the next separator

Blanks that don't separate are made one before parsing. An alternative that fails (an unclosed quote, text behind a closing mark, a list that is no JSON) gives
its input back and the next alternative is tried from the same place; what was malformed is then read as
bare text and flagged in `error`.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import NULL_WORDS
from docweave.session import bounded_rows

#: Characters that always separate, and pairs of quote marks.
SEPARATORS = ";,|/•\t\n\r"
QUOTE_PAIRS = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("«", "»"))
#: Catalogue names that could be read otherwise (with a separator, quote or bracket in them) the operator takes to the
#: executors; more are refused, not cut. All other names are read as bare values anyway and stay where they are.
MAX_CATALOG_NAMES = 1_000_000

_BLANKS = re.compile(r"\s+")
_INNER_BLANKS = re.compile(r"[^\S\t\n\r]+")


def _no_number(word: str) -> object:
    raise ValueError(f"{word} is no JSON")


_JSON = json.JSONDecoder(parse_constant=_no_number)


def tidy(text: str) -> str:
    """NFC, no blanks around, runs of blanks made one."""
    return _BLANKS.sub(" ", unicodedata.normalize("NFC", text)).strip()


#: A name with one of these could be read as something else than a bare value.
_SPECIAL = "[" + re.escape(SEPARATORS + "".join(a + b for a, b in QUOTE_PAIRS) + "[-") + "]"


class FieldGrammar:
    """The grammar for one field, with that field's catalogue names as terminals."""

    def __init__(self, names: Iterable[str] = ()):
        self._names = frozenset(tidy(n) for n in names if n and tidy(n))
        self._longest = max(map(len, self._names), default=0)

    @staticmethod
    def _separator(s: str, i: int) -> bool:
        if s[i] in SEPARATORS:
            return True
        return s[i] == "-" and (i == 0 or s[i - 1].isspace()) and (i + 1 == len(s) or s[i + 1].isspace())

    def _closed(self, s: str, i: int) -> int | None:
        """The place behind blanks after `i` if a separator or the end stands there."""
        while i < len(s) and s[i].isspace() and s[i] not in SEPARATORS:
            i += 1
        return i if i == len(s) or self._separator(s, i) else None

    def _list(self, s: str, i: int) -> tuple[list[tuple[str, bool]], int] | None:
        if s[i] != "[":
            return None
        try:
            members, end = _JSON.raw_decode(s, i)
        except (ValueError, RecursionError):
            return None
        close = self._closed(s, end)
        if close is None:
            return None
        return [(m if isinstance(m, str) else json.dumps(m, ensure_ascii=False), True) for m in _flat(members)], close

    def _quoted(self, s: str, i: int) -> tuple[list[tuple[str, bool]], int] | None:
        for left, right in QUOTE_PAIRS:
            if s[i] != left:
                continue
            out, k = [], i + 1
            while k < len(s):
                if s[k] == right:
                    if s[k + 1 : k + 2] == right:
                        out.append(right)
                        k += 2
                        continue
                    close = self._closed(s, k + 1)
                    return None if close is None else ([("".join(out), True)], close)
                if left != right and s[k] == left and s[k + 1 : k + 2] == left:
                    k += 1
                out.append(s[k])
                k += 1
            return None
        return None

    def _listed_name(self, s: str, i: int) -> tuple[list[tuple[str, bool]], int] | None:
        """Every place that could close the name is tried, the farthest first."""
        if not self._names:
            return None
        far = min(len(s), i + self._longest + 1)
        for k in range(far, i, -1):
            if (k == len(s) or self._separator(s, k)) and s[i:k].rstrip() in self._names:
                return [(s[i:k], True)], k
        return None

    def _bare(self, s: str, i: int) -> tuple[list[tuple[str, bool]], int]:
        k = i
        while k < len(s) and not self._separator(s, k):
            k += 1
        return [(s[i:k], False)], k

    def parse(self, text: str | None) -> Iterator[tuple[str, str | None]]:
        """Values in order, with what went wrong while reading each one (null if nothing did)."""
        if text is None:
            return
        s, i = _INNER_BLANKS.sub(" ", unicodedata.normalize("NFC", text)), 0
        while i < len(s):
            if s[i].isspace() or self._separator(s, i):
                i += 1
                continue
            error = None
            found = self._list(s, i) or self._quoted(s, i) or self._listed_name(s, i)
            if found is None:
                if s[i] == "[":
                    error = "bad_list"
                elif any(s[i] == left for left, _ in QUOTE_PAIRS):
                    error = "bad_quote"
                found = self._bare(s, i)
            values, i = found
            for value, protected in values:
                item = tidy(value)
                if item and (protected or item.lower() not in NULL_WORDS):
                    yield item, error


def _flat(members: object) -> Iterator[object]:
    for m in members if isinstance(members, list) else [members]:
        if isinstance(m, list):
            yield from _flat(m)
        elif m is not None:
            yield m


def split_packed(df: DataFrame, key: str, fields: list[str], catalog: DataFrame) -> DataFrame:
    """One row per value: `key`, field_name, pos (from 1 within row and field), item, error.

    Each field is read where it lies, so nothing is shuffled and a hot value costs no more than others.
    Null and empty fields, blank pieces and unquoted null words give no row and take no position;
    repeated values and repeated rows are kept; texts of any length are read in one pass (a malformed
    quote at most once more); an empty table gives no rows; other columns, whatever their names, are not
    read. `catalog` has field_name and name; null names count for nothing.
    """
    special = catalog.where(F.col("field_name").isin(*fields) & (F.col("name").rlike(_SPECIAL) | F.lower(F.trim("name")).isin(*NULL_WORDS)))
    rows = bounded_rows(special.select("field_name", "name").distinct(), MAX_CATALOG_NAMES, "the catalogue")
    names: dict[str, list[str]] = {f: [] for f in fields}
    for r in rows:
        if r["field_name"] in names and r["name"]:
            names[r["field_name"]].append(r["name"])
    grammars: list[tuple[str, FieldGrammar]] = [(f, FieldGrammar(names[f])) for f in fields]
    shared = df.sparkSession.sparkContext.broadcast(grammars)
    out_type = "array<struct<field_name:string,pos:int,item:string,error:string>>"
    struct = pa.struct([("field_name", pa.string()), ("pos", pa.int32()), ("item", pa.string()), ("error", pa.string())])

    @F.arrow_udf(out_type)
    def explode_fields(*columns: pa.Array) -> pa.Array:
        grammars = shared.value
        memo: dict[tuple[str, str | None], list[dict]] = {}
        out = []
        for cells in zip(*(c.to_pylist() for c in columns)):
            row: list[dict] = []
            for (f, g), cell in zip(grammars, cells):
                k = (f, cell)
                if k not in memo:
                    if len(memo) > 20_000:
                        memo.clear()
                    memo[k] = [{"field_name": f, "pos": p, "item": v, "error": e} for p, (v, e) in enumerate(g.parse(cell), 1)]
                row += memo[k]
            out.append(row)
        return pa.array(out, pa.list_(struct))

    wanted = df.select(F.col(key), *[F.col(f).cast("string").alias(f"_f{i}") for i, f in enumerate(fields)])
    parsed = wanted.select(key, F.explode(explode_fields(*[f"_f{i}" for i in range(len(fields))])).alias("v"))
    return parsed.select(key, "v.field_name", "v.pos", "v.item", "v.error")
