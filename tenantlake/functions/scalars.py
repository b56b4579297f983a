"""Scalar functions (Column -> Column)."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words read as true.
TRUE_WORDS = ("true", "1", "yes")

# Personal-data patterns.
EMAIL_RE = r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_RE = r"(?:\+?1[\s\-]?)?(?:\(\d{3}\)|\d{3})[\s\-]?\d{3}[\s\-]?\d{4}"
SSN_RE = r"\b\d{3}-\d{2}-\d{4}\b"

# Period name -> truncation unit (weeks start on Monday).
PERIOD_UNITS = {"daily": "day", "weekly": "week", "monthly": "month"}

_NUMERIC_TEXT = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
_NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def to_bool(col: Column, dtype: str = "string") -> Column:
    """Null stays null; text is true only for the true words (no trimming); numbers by ``!= 0``."""
    if dtype == "boolean":
        return col
    if dtype in _NUMERIC_TYPES or dtype.startswith("decimal"):
        return col != 0
    if dtype == "string":
        return F.lower(col).isin(*TRUE_WORDS)
    return F.lit(None).cast("boolean")


def to_number(col: Column, dtype: str = "string") -> Column:
    """Numeric coercion to double; unreadable values become null."""
    if dtype in _NUMERIC_TYPES or dtype == "boolean" or dtype.startswith("decimal"):
        return col.cast("double")
    if dtype != "string":
        return F.lit(None).cast("double")
    return F.when(col.rlike(_NUMERIC_TEXT), F.trim(col).try_cast("double"))


def to_integer(col: Column, dtype: str = "string") -> Column:
    """Integral coercion to bigint; fractional or unreadable values become null, one by one."""
    if dtype in {"tinyint", "smallint", "int", "bigint", "boolean"}:
        return col.cast("bigint")
    number = to_number(col, dtype)
    via_double = F.when(number == F.floor(number), number.try_cast("bigint"))
    if dtype != "string":
        return via_double
    # whole-number text keeps all its digits
    return F.coalesce(F.when(col.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(col).try_cast("bigint")), via_double)


def period_start(ts: Column, period: str) -> Column:
    """First day of the daily / weekly (Monday) / monthly period, as a date."""
    if period not in PERIOD_UNITS:
        raise ValueError(f"Period must be one of {list(PERIOD_UNITS)}, got: {period}")
    return F.date_trunc(PERIOD_UNITS[period], ts).cast("date")


def round_to(col: Column, digits: int) -> Column:
    """``digits`` decimals, halves to even on the scaled value."""
    scale = float(10**digits)
    return F.rint(col * scale) / scale


def round2(col: Column) -> Column:
    return round_to(col, 2)


def pct(part: Column, whole: Column) -> Column:
    """``100 * part / whole`` rounded to two decimals; null when the whole is zero."""
    return round2(F.try_divide(part.cast("double"), whole.cast("double")) * 100)


def is_pass(status: Column) -> Column:
    """Only PASS (any case) passes; null, PENDING and the rest do not."""
    return F.coalesce(F.upper(status.cast("string")) == "PASS", F.lit(False))


def has_email(text: Column) -> Column:
    return text.rlike(EMAIL_RE)


def has_phone(text: Column) -> Column:
    return text.rlike(PHONE_RE)


def has_ssn(text: Column) -> Column:
    return text.rlike(SSN_RE)


def as_text(col: Column, dtype: str) -> Column:
    """String form used for matching and masking; doubles avoid scientific notation."""
    if dtype in {"float", "double"}:
        whole = (col == F.floor(col)) & (F.abs(col) < 1e16)
        return F.when(whole, F.concat(col.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(
            col.cast("string"))
    return col.cast("string")


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("string"), 256)


def partial_mask(col: Column) -> Column:
    """All but the last four characters starred; four or fewer are all starred."""
    text = col.cast("string")
    size = F.length(text)
    starred = F.concat(F.repeat(F.lit("*"), size - 4), F.right(text, F.lit(4)))
    return F.when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(starred)


def deadline(made_on: Column, days: Column) -> Column:
    """Manufacturing midnight plus calendar days; unreadable dates give null."""
    return F.date_add(F.try_to_date(made_on.cast("string"), "yyyy-MM-dd"), days.cast("int"))


def epoch_ms(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def from_epoch_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms)


def ttl_seconds(ms: Column, days: int = 90) -> Column:
    """Expiry in epoch seconds, ``days`` after an epoch-millisecond instant."""
    return F.floor(ms / 1000).cast("bigint") + F.lit(days * 86400).cast("bigint")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_extension(path: Column) -> Column:
    """From the last dot of the whole key, lower case, dot included; none gives ''."""
    return F.when(path.contains("."), F.lower(F.concat(F.lit("."), F.substring_index(path, ".", -1)))).otherwise("")


def file_stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_tenant_id(col: Column) -> Column:
    return F.coalesce(col.startswith("cmo-"), F.lit(False))


def check_tenant_id(cmo_id: str) -> str:
    if not cmo_id or not cmo_id.startswith("cmo-"):
        raise ValueError(f"Invalid tenant id: {cmo_id}. Must start with 'cmo-'")
    return cmo_id


def record_contains(columns: list[str], needle: str) -> Column:
    """True when the JSON form of the given columns contains the text."""
    return F.to_json(F.struct(*columns)).contains(needle)


def has_token(text: Column, token: str) -> Column:
    """True when the text holds the token with no letter, digit, underscore or hyphen next to it; false for null.

    A tenant's id is found this way, so that ``cmo-7`` isn't found in ``cmo-70``.
    """
    quoted = re.sub(r"([^\w\s])", r"\\\1", token)
    return F.coalesce(text.rlike(rf"(^|[^A-Za-z0-9_\-]){quoted}([^A-Za-z0-9_\-]|$)"), F.lit(False))


def record_has_token(columns: list[str], token: str) -> Column:
    """True when the JSON form of the given columns holds the token."""
    return has_token(F.to_json(F.struct(*columns)), token)


def label_of(code: Column, labels: Mapping[str, str]) -> Column:
    """Display label of a code, the code itself when unknown."""
    out = code
    for key, text in labels.items():
        out = F.when(code == key, F.lit(text)).otherwise(out)
    return out


def join_labels(codes: Column, labels: Mapping[str, str], sep: str = ", ") -> Column:
    return F.array_join(F.transform(codes, lambda c: label_of(c, labels)), sep)


def first_match(items: Column, predicate) -> Column:
    """First array item satisfying the predicate, null if none."""
    return F.get(F.filter(items, predicate), F.lit(0))


def get_or(mapping: Column, key: Column, default) -> Column:
    """Map lookup with a default."""
    return F.coalesce(F.try_element_at(mapping, key), F.lit(default) if not isinstance(default, Column) else default)
