"""Text scalars as Spark columns, and the few normal forms Spark lacks as vectorised functions."""

from __future__ import annotations

import re
import unicodedata
import uuid

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, pandas_udf

#: Unquoted words that stand for null in delivered fields.
NULL_WORDS = ("nan", "none", "...")
#: Fixed value: the namespace of name-based point ids (RFC 4122 URL namespace).
URL_NAMESPACE = uuid.NAMESPACE_URL


def strip(c: Column) -> Column:
    """Without white space of any Unicode kind at both ends (Spark's trim removes U+0020 only)."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def clean_optional(c: Column) -> Column:
    """Stripped text; null when blank or `nan` in any case."""
    s = strip(c)
    return F.when((s == "") | (F.lower(s) == "nan"), None).otherwise(s)


def clean_blank(c: Column) -> Column:
    """Stripped text; null when blank. The word `nan` stays."""
    s = strip(c)
    return F.when(s == "", None).otherwise(s)


def is_null_word(c: Column) -> Column:
    """True for null, blank and the null words in any case."""
    s = F.lower(strip(c))
    return c.isNull() | (s == "") | s.isin(*NULL_WORDS)


def reference_key(c: Column) -> Column:
    """A key as references compare it: no spaces and tabs around, no leading zeros; null words give null."""
    s = F.regexp_replace(c, r"\A[ \t]+|[ \t]+\z", "")
    k = F.regexp_replace(s, r"\A0+", "")
    return F.when(is_null_word(c) | (k == ""), None).otherwise(k)


#: Latin text without marks of its own, and common punctuation: composed already, and unchanged by compatibility forms.
_COMPOSED = r"\x{00}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}\x{180}-\x{1C3}\x{1CD}-\x{1F0}\x{1F4}-\x{24F}\x{1E00}-\x{1E99}\x{1EA0}-\x{1EFF}\x{2012}-\x{2016}\x{2018}-\x{2023}"


def _normal_form(form: str):
    @arrow_udf(T.StringType())
    def normalize(s: pa.Array) -> pa.Array:
        # not pyarrow's utf8_normalize: it gives decomposed text for NFC and NFKC
        return pa.array([None if x is None else unicodedata.normalize(form, x) for x in s.to_pylist()], pa.string())

    return normalize


_FORMS = {form: _normal_form(form) for form in ("NFC", "NFKC", "NFKD")}


def _composed(c: Column, form: str) -> Column:
    """Only texts that may change go to Python; the others stay in the JVM."""
    return F.coalesce(_FORMS[form](F.when(c.rlike(f"[^{_COMPOSED}]"), c)), c)


def nfc(c: Column) -> Column:
    """Canonical composition."""
    return _composed(c, "NFC")


def nfkc(c: Column) -> Column:
    """Compatibility composition."""
    return _composed(c, "NFKC")


def nfkd(c: Column) -> Column:
    """Compatibility decomposition."""
    return _FORMS["NFKD"](c)


def collapse_blank_lines(c: Column) -> Column:
    """Stripped text in which three or more line feeds become two."""
    return F.regexp_replace(strip(c), "\n{3,}", "\n\n")


def boundary_spaces(c: Column) -> Column:
    """A space between a lower-case letter and a following capital or digit, and between a digit and a letter."""
    return F.regexp_replace(c, r"(?<=\p{Ll})(?=[\p{Lu}\p{Nd}])|(?<=\p{Nd})(?=\p{L})", " ")


#: The letters an upper-case share is taken over, Latin with the Vietnamese ones.
RATIO_LETTERS = "A-Za-zÀ-ỹĐđ"


def uppercase_ratio(c: Column) -> Column:
    """Capital letters in all letters of the class, 0 without letters."""
    letters = F.regexp_count(c, F.lit(f"[{RATIO_LETTERS}]"))
    return F.when(letters > 0, F.regexp_count(c, F.lit(rf"[{RATIO_LETTERS}&&\p{{Lu}}]")) / letters).otherwise(F.lit(0.0))


def _latin_folds() -> tuple[str, str]:
    """Composed Latin letters and their base letters, made from the Unicode tables."""
    src, dst = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if base != ch and len(base) == 1:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_FOLD_FROM, _FOLD_TO = _latin_folds()


def fold_accents(c: Column) -> Column:
    """Letters without their marks, compatibility forms as their plain ones; `đ` and `Đ` stay."""
    folded = F.translate(c, _FOLD_FROM, _FOLD_TO)
    other = r"[^\x{00}-\x{7F}\x{110}\x{111}\x{300}-\x{36F}\x{2012}-\x{2016}\x{2018}-\x{2023}]"
    return F.regexp_replace(F.coalesce(_FORMS["NFKD"](F.when(folded.rlike(other), folded)), folded), r"\p{M}+", "")


def match_form(c: Column) -> Column:
    """Upper case without accents, `Đ` as `D`: the form in which phrases are looked for."""
    return F.translate(F.upper(fold_accents(c)), "Đ", "D")


def keyword_slug(c: Column) -> Column:
    """Filter keyword: lower case, no accents, `đ` as `d`, other runs as `_`; null when nothing is left."""
    s = F.translate(fold_accents(F.lower(strip(c))), "đ", "d")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", None).otherwise(s)


def node_slug(c: Column) -> Column:
    """Path segment: ASCII only (`đ` is dropped, not replaced), other runs as `-`; `none` when nothing is left."""
    s = F.regexp_replace(fold_accents(c), r"[^\x00-\x7F]", "")
    s = F.lower(F.regexp_replace(F.regexp_replace(s, "[^a-zA-Z0-9]+", "-"), "^-+|-+$", ""))
    return F.when((s == "") | s.isNull(), "none").otherwise(s)


def parse_date(c: Column) -> Column:
    """Midnight of a date as day/month/year, year-month-day or day-month-year; null for anything else."""
    s = strip(c)
    forms = (
        (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    )
    return F.coalesce(*[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f))) for p, f in forms])


def year_of(c: Column) -> Column:
    return F.year(c)


def epoch_seconds(c: Column) -> Column:
    return F.unix_timestamp(c)


def lexical_tokens(c: Column) -> Column:
    """Lower-case words in compatibility form; `. / _ : -` may stand inside a word, so that document numbers stay whole."""
    return F.regexp_extract_all(F.lower(nfkc(c)), F.lit(r"([\p{L}\p{N}]+(?:[./_:\-][\p{L}\p{N}]+)*)"), F.lit(1))


_LEXICAL = re.compile(r"[^\W_]+(?:[./_:\-][^\W_]+)*")


def lexical_words(s: str | None) -> list[str]:
    """The same words as `lexical_tokens` of one text, for workers that look at the words in place."""
    return _LEXICAL.findall(unicodedata.normalize("NFKC", s).lower()) if s else []


def word_count(c: Column) -> Column:
    """Stretches between white space."""
    return F.regexp_count(c, F.lit(r"\S+"))


def name_uuid(name: Column, namespace: uuid.UUID = URL_NAMESPACE) -> Column:
    """RFC 4122 version 5 id of `name`, from SHA-1 and bit arithmetic on the hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def lines(c: Column) -> Column:
    """Lines in the sense of any Unicode line break, without a trailing empty one."""
    parts = F.split(c, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


@pandas_udf(T.StringType())
def json_text_object(s: pd.Series) -> pd.Series:
    """The JSON object in a model's answer: without a code fence, else from the first `{` to the last `}`; null if none parses."""
    import json

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        t = x.strip()
        m = re.match(r"```(?:json)?\s*(.*?)\s*```\Z", t, re.S | re.I)
        t = m[1] if m else t
        for cand in (t, t[t.find("{") : t.rfind("}") + 1] if "{" in t else ""):
            try:
                v = json.loads(cand)
            except ValueError:
                continue
            if isinstance(v, dict):
                return json.dumps(v, ensure_ascii=False)
        return None

    return s.map(one)
