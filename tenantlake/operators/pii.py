"""Personal-data detection and masking, all in built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.session import spread

# Column-name suffixes that suggest a person's name.
NAME_SUFFIXES = ("_name", "_contact", "_person")
# Data classification -> masking strategy and its description.
STRATEGY_OF = {"public": None, "internal": "partial", "confidential": "hash", "restricted": "redact"}
STRATEGY_TEXT = {
    None: "No masking required for public data",
    "partial": "Show only last 4 characters of PII fields",
    "hash": "SHA-256 hash of PII field values",
    "redact": "Full redaction — replace PII with [REDACTED]",
}
STRATEGIES = ("hash", "redact", "partial")
REDACTED = "[REDACTED]"

_PATTERNS = {"EMAIL": S.EMAIL_RE, "PHONE": S.PHONE_RE, "SSN": S.SSN_RE}


def _text(name: str, dtype: str) -> Column:
    col = F.col(f"`{name}`")
    if dtype.startswith(("array", "map", "struct")):
        return F.to_json(col)
    return S.as_text(col, dtype)


def _hits(value: Column, kind: str) -> Column:
    """Matches of a pattern in a text; a cheap test for the character every match holds comes first."""
    maybe = value.contains("@") if kind == "EMAIL" else value.rlike("[0-9]{3}")
    return F.when(maybe, F.regexp_count(value, F.lit(_PATTERNS[kind]))).otherwise(0)


def _found(value: Column, kind: str) -> Column:
    maybe = value.contains("@") if kind == "EMAIL" else value.rlike("[0-9]{3}")
    return F.coalesce(maybe & value.rlike(_PATTERNS[kind]), F.lit(False))


def detect_pii(df: DataFrame) -> DataFrame:
    """(field, pii_types) of the columns holding personal data, sorted types, from one aggregate."""
    aggs, entries = [F.count(F.lit(1)).alias("_rows")], []
    for i, (name, dtype) in enumerate(df.dtypes):
        value = _text(name, dtype)
        for kind in _PATTERNS:
            aggs.append(F.bool_or(_found(value, kind)).alias(f"{kind}{i}"))
        named = F.lit(name.lower().endswith(NAME_SUFFIXES)) & (F.col("_rows") > 0)
        kinds = [F.when(F.col(f"{kind}{i}"), F.lit(kind)) for kind in _PATTERNS]
        found = F.array_sort(F.array_compact(F.array(*kinds, F.when(named, F.lit("NAME")))))
        entries.append(F.struct(F.lit(name).alias("field"), found.alias("pii_types")))
    return spread(df).agg(*aggs).select(F.inline(F.array(*entries))).where(F.size("pii_types") > 0)


def pii_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, pii_type, hits, rows_hit): matches of each pattern per column."""
    dtypes = dict(df.dtypes)
    counts, aggs, entries = [], [], []
    for i, name in enumerate(columns or df.columns):
        for kind in _PATTERNS:
            n = f"{kind}{i}"
            counts.append(_hits(_text(name, dtypes[name]), kind).alias(n))
            aggs += [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"h{n}"), F.count_if(F.col(n) > 0).alias(f"r{n}")]
            entries.append(F.struct(F.lit(name).alias("field"), F.lit(kind).alias("pii_type"),
                                    F.col(f"h{n}").alias("hits"), F.col(f"r{n}").alias("rows_hit")))
    return spread(df).select(*counts).agg(*aggs).select(F.inline(F.array(*entries)))


def mask_value(col: Column, strategy: str | None) -> Column:
    """Masked text form of a value; null stays null."""
    if strategy == "hash":
        return S.sha256_hex(col)
    if strategy == "redact":
        return F.when(col.isNotNull(), F.lit(REDACTED))
    if strategy == "partial":
        return S.partial_mask(col)
    return col


def mask(df: DataFrame, columns: Sequence[str], strategy: str = "hash") -> DataFrame:
    """Mask the named columns (absent names are ignored); masked columns become text."""
    if strategy not in STRATEGIES:
        raise ValueError(f"Invalid masking strategy: {strategy}. Must be one of {STRATEGIES}")
    dtypes, wanted = dict(df.dtypes), set(columns)
    return df.select(*[mask_value(_text(c, dtypes[c]), strategy).alias(c) if c in wanted else F.col(f"`{c}`")
                       for c in df.columns])


def masking_rule(classification: str) -> dict:
    """Strategy (or None) and description of a classification level."""
    if classification not in STRATEGY_OF:
        raise ValueError(
            f"Unknown data classification: {classification}. Must be one of {list(STRATEGY_OF)}")
    strategy = STRATEGY_OF[classification]
    return {"classification": classification, "strategy": strategy, "description": STRATEGY_TEXT[strategy]}


def strategy_col(classification: Column) -> Column:
    """The strategy of a classification column; null for public and unknown levels."""
    out = F.lit(None).cast("string")
    for level, strategy in STRATEGY_OF.items():
        if strategy:
            out = F.when(classification == level, F.lit(strategy)).otherwise(out)
    return out


def mask_for_contract(df: DataFrame, contract: Mapping) -> DataFrame:
    """Mask a contract's declared personal-data fields at its classification."""
    governance = contract["governance"]
    rule = masking_rule(governance["dataClassification"])
    if rule["strategy"] is None:
        return df
    return mask(df, governance.get("piiFields", []), rule["strategy"])


def mask_by_classification(df: DataFrame, classification: str, columns: Sequence[str]) -> DataFrame:
    """Mask per row, by the classification found in another column."""
    strategy = strategy_col(F.col(classification))
    dtypes = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(f"`{c}`"))
            continue
        text = _text(c, dtypes[c])
        value = text
        for name in STRATEGIES:
            value = F.when(strategy == name, mask_value(text, name)).otherwise(value)
        out.append(value.alias(c))
    return df.select(*out)


def flatten_findings(df: DataFrame, findings: str = "findings") -> DataFrame:
    """Scan findings to (field_name, pii_type, severity, count).

    ``findings``: array of struct<severity: struct<description>, classificationDetails:
    struct<result: struct<sensitiveData: array<struct<category, detections: array<struct<name, count>>>>>>>.
    """
    one = df.select(F.explode(findings).alias("f"))
    groups = one.select(F.col("f.severity.description").alias("severity"),
                        F.explode("f.classificationDetails.result.sensitiveData").alias("g"))
    hits = groups.select("severity", F.col("g.category").alias("category"), F.explode("g.detections").alias("d"))
    return hits.select(
        F.coalesce("d.name", F.lit("unknown")).alias("field_name"),
        F.coalesce("category", F.lit("UNKNOWN")).alias("pii_type"),
        F.coalesce("severity", F.lit("Medium")).alias("severity"),
        F.coalesce(F.col("d.count").cast("bigint"), F.lit(0).cast("bigint")).alias("count"))
