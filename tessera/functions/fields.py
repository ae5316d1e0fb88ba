"""Column functions over field values: gates, normalisers, type inference and cell projections."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DECIMAL = r"^[+-]?(0|[1-9][0-9]*)(\.[0-9]+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def fraction_digits(c: Column) -> Column:
    return F.length(F.regexp_extract(c, r"\.([0-9]+)$", 1))


def decimal_or_null(c: Column, scale: int = 18) -> Column:
    """Canonical decimal text as DECIMAL(38, scale); anything else, or what is too wide or would be rounded, is null."""
    return F.when(F.rlike(c, F.lit(DECIMAL)) & (fraction_digits(c) <= scale), c.try_cast(f"decimal(38,{scale})"))


def scaled_text(d: Column, scale: Column, held: int = 18) -> Column:
    """A DECIMAL(38, held) as text with ``scale`` fraction digits, of which no other is set."""
    text = d.cast("string")
    return F.when(scale == 0, F.substring_index(text, ".", 1)).otherwise(F.substring(text, F.lit(1), F.length(text) - held + scale))


def date_or_null(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(DATE)), F.try_to_date(c, "yyyy-MM-dd"))


def decimal_text(c: Column) -> Column:
    """The text of a decimal with its own scale: no plus sign, any zero is 0."""
    plain = F.regexp_replace(c, r"^\+", "")
    return F.when(F.rlike(plain, F.lit(r"^-?0(\.0+)?$")), "0").otherwise(plain)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def _members(pairs: list) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a member stands twice")
    return found


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _canonical_text(x: str | None) -> str | None:
    try:
        return None if x is None else json.dumps(json.loads(x, object_pairs_hook=_members, parse_constant=_no_number), ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(_canonical_text)


@F.pandas_udf(StringType())
def _casefold(s: pd.Series) -> pd.Series:
    return s.str.casefold()


def _ascii(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[\x00-\x7F]*$"))


def trim_outer(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def iso_date_or_same(c: Column) -> Column:
    """A date that can be read in one way only as yyyy-MM-dd; others stay as they are."""
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", i).try_cast("int")
    a, b, y = part(1), part(2), part(3)
    day, month = F.greatest(a, b), F.least(a, b)
    clear = y.isNotNull() & ((day > 12) | (a == b))
    made = F.try_to_date(F.format_string("%04d-%02d-%02d", y, month, day), "yyyy-MM-dd")
    return F.when(clear & made.isNotNull(), made.cast("string")).when(date_or_null(F.regexp_replace(c, "[./]", "-")).isNotNull(), F.regexp_replace(c, "[./]", "-")).otherwise(c)


NORMALIZERS = {
    "NONE": lambda c: c,
    "IDENTIFIER_PRESERVE": lambda c: c,
    "TRIM_OUTER_WHITESPACE": trim_outer,
    "COLLAPSE_WHITESPACE": lambda c: trim_outer(F.regexp_replace(c, f"{SPACE}+", " ")),
    "UNICODE_NFKC": lambda c: F.when(_ascii(c), c).otherwise(_nfkc(c)),
    "CASEFOLD": lambda c: F.when(_ascii(c), F.lower(c)).otherwise(_casefold(c)),
    "CASEFOLD_ASCII": F.lower,
    "PRESERVE_RAW": lambda c: c,
    "IDENTIFIER_AS_TEXT": lambda c: c.cast("string"),
    "UNICODE_NFC": lambda c: F.when(_ascii(c), c).otherwise(_nfc(c)),
    "TRIM": trim_outer,
    "ISO_DATE_WHEN_UNAMBIGUOUS": lambda c: iso_date_or_same(c),
    "ISO_CURRENCY_CODE_WHEN_EXPLICIT": lambda c: F.when(F.rlike(c, F.lit(r"^\s*[A-Za-z]{3}\s*$")), F.upper(F.trim(c))).otherwise(c),
    "UPPERCASE_CODE": F.upper,
    "DECIMAL_CANONICAL_STRING": decimal_text,
}


def normalized(c: Column, names: tuple[str, ...]) -> Column:
    """Normalisers applied from left to right; each may stand once, NONE only alone."""
    if len(set(names)) != len(names) or "NONE" in names and len(names) > 1:
        raise ValueError(f"normalisers clash: {names}")
    for name in names:
        c = NORMALIZERS[name](c)
    return c


def inferred_type(name: Column, kind: Column | None = None) -> Column:
    """Semantic type of a field by the JSON type of its value (STRING, BOOLEAN, ARRAY, OBJECT, ...; null: STRING) and its name; the first rule that fits wins."""
    has = lambda *xs: F.rlike(name, F.lit("|".join(xs)))
    kind = F.coalesce(kind if kind is not None else F.lit("STRING"), F.lit("STRING"))
    text = kind.isin("STRING", "VOID", "NULL")
    return (F.when(kind == "BOOLEAN", "BOOLEAN").when(kind == "ARRAY", "LIST").when(kind == "OBJECT", "JSON_OBJECT")
            .when(has("amount", "total", "balance", "price"), "CURRENCY_AMOUNT").when(has("quantity", "qty"), "QUANTITY").when(has("_date$", "^date$"), "DATE")
            .when(has("account"), F.when(text, "BANK_ACCOUNT").otherwise("TEXT")).when(has("number", "_id", "code", "reference"), F.when(text, "IDENTIFIER").otherwise("TEXT")).otherwise("TEXT"))


def formula_like(c: Column) -> Column:
    return F.rlike(c, F.lit(r"^[=+\-@]"))


def formula_in_json(c: Column) -> Column:
    """Whether a string anywhere in a JSON text starts like a formula; names of members don't count."""
    return F.rlike(F.regexp_replace(c, r'"(?:[^"\\]|\\.)*+"\s*+:', ""), F.lit(r'"[=+\-@]'))


def formula_safe(c: Column) -> Column:
    return F.when(formula_like(c), F.concat(F.lit("'"), c)).otherwise(c)


def precise_number(c: Column) -> Column:
    """Canonical decimals of at most 15 significant digits can be numbers in a sheet."""
    digits = F.regexp_replace(F.regexp_replace(c, r"[+\-.]", ""), "^0+", "")
    return F.rlike(c, F.lit(DECIMAL)) & (F.length(digits) <= 15)


def excel_serial(d: Column) -> Column:
    return F.datediff(d, F.lit("1899-12-30").cast("date"))


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A prefix and the first digits of the SHA-256 of the parts' JSON array."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, length))


def strict_json(c: Column) -> Column:
    """A JSON text as a variant; null if it is broken, names a member twice or goes on behind its value.

    The parser stops at a value's end, so the text is read inside an object and inside an array: what follows can't close both."""
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    return F.when(F.try_parse_json(F.concat(F.lit("["), c, F.lit("]"))).isNotNull(), F.try_variant_get(inside, "$.v", "variant"))


def kind_of(v: Column) -> Column:
    """STRING, BOOLEAN, ARRAY, OBJECT, VOID or a number's type of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def text_of(v: Column) -> Column:
    """A variant's text: of a string its characters, of others their JSON."""
    return F.when(kind_of(v) == "STRING", F.try_variant_get(v, "$", "string")).when(kind_of(v) != "VOID", F.to_json(v))


def canonical_items(v: Column) -> Column:
    """The canonical JSON of each item of a variant that is an array; null for others."""
    return F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def canonical_json(c: Column) -> Column:
    """JSON text with sorted members, compact, not escaped beyond need; null for null and for what is not strict JSON (broken, NaN, a member twice)."""
    return _canonical(c)


#: Characters that the two dialects escape besides the backslash.
RAG_MARKS, CONVERSION_MARKS = r"`*_{}[]()#+.!<>|", r"`*_{}[]<>#"


def markdown_escaped(c: Column, marks: str = RAG_MARKS) -> Column:
    r"""Backslash and the dialect's marks are escaped."""
    return F.regexp_replace(c, "([" + "".join("\\" + m for m in "\\" + marks) + "])", r"\\$1")


def table_cell(c: Column, dialect: str = "rag") -> Column:
    """A cell of a Markdown table; null and line ends by dialect (rag, conversion) or, for plain, an empty text."""
    if dialect == "plain":
        return F.coalesce(c, F.lit(""))
    null, line, marks = {"rag": ("⟦CANONICAL_NULL⟧", " ↵ ", RAG_MARKS), "conversion": ("", "<br>", CONVERSION_MARKS)}[dialect]
    return F.coalesce(F.regexp_replace(markdown_escaped(c, marks), r"\r\n|\n|\r", line), F.lit(null))


def safe_relative_path(c: Column) -> Column:
    """Whether a text is a relative POSIX path without empty, dot, control or drive parts and of at most 240 characters."""
    return F.coalesce(F.rlike(c, F.lit(r"^(?!/)(?!.*//)(?!(?:.*/)?\.{1,2}(?:/|$))[^\x00-\x1F\x7F\\:*?\"<>|]{1,240}(?<!/)$")), F.lit(False))


def folded_path(c: Column) -> Column:
    """What two paths share that differ in case or composition only."""
    return normalized(c, ("UNICODE_NFC", "CASEFOLD"))


def directory_id(document_id: Column) -> Column:
    """A folder's name for a document: colons as hyphens with a hash that keeps names apart, or a hash alone."""
    digest = F.sha2(document_id.cast("binary"), 256)
    name = F.when(F.contains(document_id, F.lit(":")), F.concat(F.replace(document_id, F.lit(":"), F.lit("-")), F.lit("-"), F.substring(digest, 1, 8))).otherwise(document_id)
    return F.when(safe_relative_path(name) & ~F.contains(name, F.lit("/")), name).otherwise(F.concat(F.lit("document-"), F.substring(digest, 1, 20)))


def column_letters(n: Column) -> Column:
    """Letters of a sheet's column, the first being 1: A, ..., Z, AA, ...; null below 1."""
    letter = lambda x: F.chr(65 + F.pmod(x, F.lit(26)))
    out, rest = letter(n - 1), F.floor((n - 1) / 26)
    for _ in range(5):
        out, rest = F.when(rest > 0, F.concat(letter(rest - 1), out)).otherwise(out), F.when(rest > 0, F.floor((rest - 1) / 26)).otherwise(0)
    return F.when(n >= 1, out)


def identifier_column(name: Column) -> Column:
    """Columns whose cells stay text on a sheet."""
    return F.rlike(name, F.lit(r"(?i)(id|number|account|reference|code|sha256|checksum)$"))


def confidence_shown(score: Column, band: Column) -> Column:
    return F.coalesce(score.cast("string"), band, F.lit("UNKNOWN"))


def closed_set_violations(keys: Column, allowed: list[str]) -> Column:
    """Sorted members of an array that aren't allowed."""
    return F.array_sort(F.array_except(keys, F.array(*[F.lit(x) for x in allowed])))
