"""Bronze to silver: validate, convert, fill, de-duplicate, stamp.

Every step is a projection except the de-duplication, which is one shuffle on its keys. The
``row_number() = 1`` form lets Spark keep only the first row per key and map task before that
shuffle (window group limit), so a key holding a large share of the rows is cut down map-side.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators.schema import TableSchema

# What an optional null becomes.
TYPE_DEFAULTS = {"string": "", "integer": 0, "number": 0.0, "boolean": False}


class CleanseError(ValueError):
    """A cleansing step cannot be planned."""


class Cleansed(NamedTuple):
    silver: DataFrame
    quarantine: DataFrame


def _valid_flag(df: DataFrame, schema: TableSchema) -> Column:
    if any(c not in df.columns for c in schema.required):
        return F.lit(False)
    flag = F.lit(True)
    for name in schema.required:
        flag = flag & F.col(f"`{name}`").isNotNull()
    return flag


def flag_valid(df: DataFrame, schema: TableSchema, name: str = "_is_valid") -> DataFrame:
    """True where all required columns are filled; a missing required column fails every row."""
    return df.withColumn(name, _valid_flag(df, schema))


def split_valid(df: DataFrame, schema: TableSchema) -> Cleansed:
    """(valid, invalid): two filters over the same scan."""
    flag = _valid_flag(df, schema)
    return Cleansed(df.where(flag), df.where(~flag))


def schema_findings(df: DataFrame, schema: TableSchema) -> DataFrame:
    """One row per finding: missing required columns, unexpected columns, rows with required nulls."""
    missing = [c for c in schema.required if c not in df.columns]
    extra = [c for c in df.columns if c not in schema.properties]
    fixed = []
    if missing:
        fixed.append(f"Missing required columns: {missing}")
    if extra:
        fixed.append(f"Unexpected columns (will be kept): {extra}")
    spark = df.sparkSession
    found = spark.createDataFrame([(m,) for m in fixed], "finding string")
    if missing or not schema.required:
        return found
    nulls = df.agg(F.count_if(~_valid_flag(df, schema)).alias("n")).where("n > 0")
    return found.unionByName(nulls.select(
        F.concat(F.col("n").cast("string"), F.lit(" records have null values in required fields")).alias("finding")))


def convert_types(df: DataFrame, schema: TableSchema) -> DataFrame:
    """Coerce each declared column value by value; unreadable values become null, other columns pass."""
    dtypes = dict(df.dtypes)
    out = []
    for name in df.columns:
        col, target, dtype = F.col(f"`{name}`"), schema.properties.get(name), dtypes[name]
        if target == "integer":
            col = S.to_integer(col, dtype)
        elif target == "number":
            col = S.to_number(col, dtype)
        elif target == "boolean":
            col = S.to_bool(col, dtype)
        elif target == "string":
            col = S.as_text(col, dtype)
        out.append(col.alias(name))
    return df.select(*out)


def fill_nulls(df: DataFrame, schema: TableSchema, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Fill optional columns with the explicit default or the type's; required ones only if explicit."""
    defaults = defaults or {}
    dtypes = dict(df.dtypes)
    out = []
    for name in df.columns:
        col, target = F.col(f"`{name}`"), schema.properties.get(name)
        if target is not None:
            if name in defaults:
                col = F.coalesce(col, F.lit(defaults[name]).cast(dtypes[name]))
            elif name not in schema.required:
                fill = TYPE_DEFAULTS.get(target, "" if dtypes[name] == "string" else None)
                if fill is not None:
                    col = F.coalesce(col, F.lit(fill).try_cast(dtypes[name]))
        out.append(col.alias(name))
    return df.select(*out)


def orderable(value: Column, dtype: str) -> Column:
    """The value, or its JSON text: Spark orders neither maps nor variants, on their own or inside another type."""
    return F.to_json(F.struct(value)) if re.search(r"\b(map<|variant\b)", dtype) else value


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], keep: str = "last") -> DataFrame:
    """One row per key (null keys equal each other): the first or last in ``order_by``.

    A distributed table has no file order, so the order is explicit; ties break on every
    column (arrays and structs by their order, maps and variants by their JSON text), which makes the result deterministic.
    """
    if keep not in ("first", "last"):
        raise CleanseError(f"keep must be 'first' or 'last', got: {keep}")
    gone = [k for k in keys if k not in df.columns]
    if gone:
        raise CleanseError(f"Deduplication key columns not found: {gone}")
    columns = [F.col(f"`{c}`") if isinstance(c, str) else c for c in order_by]
    named = {c for c in order_by if isinstance(c, str)} | set(keys)
    ties = [orderable(F.col(f"`{n}`"), t) for n, t in df.dtypes if n not in named]
    direction = F.desc_nulls_last if keep == "last" else F.asc_nulls_first
    ordering = [direction(c) for c in [*columns, *ties]]
    rank = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*ordering))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stamp(df: DataFrame, at: dt.datetime | None = None) -> DataFrame:
    """``_validation_timestamp``: one instant for the whole run, as ISO-8601 text."""
    at = at or dt.datetime.now(dt.timezone.utc)
    return df.withColumn("_validation_timestamp", F.lit(at.isoformat()))


def bronze_to_silver(df: DataFrame, schema: TableSchema, keys: Sequence[str] = (),
                     order_by: Sequence[str | Column] = (), defaults: Mapping[str, object] | None = None,
                     at: dt.datetime | None = None) -> Cleansed:
    """Validate, convert, fill, de-duplicate (when keys are given) and stamp, as one lazy plan."""
    valid, invalid = split_valid(df, schema)
    clean = fill_nulls(convert_types(valid, schema), schema, defaults)
    if keys:
        clean = deduplicate(clean, keys, order_by, keep="last")
    return Cleansed(stamp(clean, at), invalid)


def etl_metrics(df: DataFrame, schema: TableSchema, keys: Sequence[str] = (),
                defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Counts of a run from one aggregate: total, valid (after de-duplication), invalid, duplicates, errors.

    ``errors`` counts what ``schema_findings`` lists: missing or unexpected columns, and required nulls. Keys are compared after conversion and null fill, as the run itself does.
    """
    flagged = flag_valid(df, schema)
    clean = fill_nulls(convert_types(flagged, schema), schema, defaults)
    kept = F.count_if(F.col("_is_valid"))
    if keys:
        # a null inside a key still counts: the struct itself is not null
        distinct = F.count_distinct(F.when(F.col("_is_valid"), F.struct(*[F.col(f"`{k}`") for k in keys])))
    else:
        distinct = kept
    counted = clean.agg(F.count(F.lit(1)).alias("total_records"), distinct.alias("valid_records"),
                        F.count_if(~F.col("_is_valid")).alias("invalid_records"), kept.alias("_kept"))
    missing = [c for c in schema.required if c not in df.columns]
    fixed = bool(missing) + any(c not in schema.properties for c in df.columns)
    nulls = F.lit(0) if missing or not schema.required else (F.col("invalid_records") > 0).cast("int")
    return counted.select("total_records", "valid_records", "invalid_records",
                          (F.col("_kept") - F.col("valid_records")).alias("duplicates_removed"),
                          (nulls + F.lit(int(fixed))).cast("bigint").alias("errors"))


def observed(df: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """Row count collected while the DataFrame is written, without a second scan."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
