"""Schemas: inference, merging, compatibility and a versioned registry table.

A schema is a set of (field, type, required) rows. ``TableSchema`` is its driver-side form, used to
build reads and cleansing plans; inference over data always runs as one aggregate on Spark.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.session import spread
from tenantlake.sources.tables import KeyedLog

# JSON-schema scalar -> Spark type.
SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}
# Editor types -> JSON-schema types.
EDITOR_TYPES = {"integer": "integer", "double": "number", "boolean": "boolean", "string": "string",
                "array": "array", "object": "object", "timestamp": "string", "date": "string"}
FORMATS = ("AVRO", "JSON")
FILE_FORMATS = ("csv", "json", "parquet")
MODES = ("BACKWARD", "FORWARD", "FULL")

FIELDS_DDL = "field string, type string, required boolean"
REGISTRY_DDL = "name string, version int, format string, field string, type string, required boolean"

_BLANKS = " \t\n\r\f\x0b"
_INT_TEXT = r"^[+-]?\d+(_\d+)*$"
_FLOAT_TEXT = r"^(?i:[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan))$"


class SchemaError(ValueError):
    """Unusable schema, format or mode."""


@dataclass(frozen=True)
class TableSchema:
    """Field types in order, plus the required fields."""

    properties: Mapping[str, str]
    required: Sequence[str] = field(default_factory=tuple)

    @classmethod
    def from_json_schema(cls, doc: Mapping) -> "TableSchema":
        props = {name: spec.get("type", "string") for name, spec in doc.get("properties", {}).items()}
        return cls(props, tuple(doc.get("required", ())))

    @classmethod
    def from_fields(cls, fields: Sequence[Mapping]) -> "TableSchema":
        """From (name, type, nullable) entries; types may be editor types."""
        props = {f["name"]: EDITOR_TYPES.get(f["type"], "string") for f in fields}
        return cls(props, tuple(f["name"] for f in fields if not f.get("nullable", True)))

    @classmethod
    def from_rows(cls, rows: DataFrame) -> "TableSchema":
        """From a (field, type, required) DataFrame: one row per column of one table."""
        items = rows.select("field", "type", "required").collect()
        return cls({r["field"]: r["type"] for r in items}, tuple(sorted(r["field"] for r in items if r["required"])))

    def to_json_schema(self) -> dict:
        return {"type": "object", "properties": {n: {"type": t} for n, t in self.properties.items()},
                "required": sorted(self.required)}

    def fields_view(self) -> list[dict]:
        """(name, type, nullable) entries; nullable means not required."""
        return [{"name": n, "type": t, "nullable": n not in self.required} for n, t in self.properties.items()]

    def struct_type(self) -> T.StructType:
        """Spark schema for reads; nested types are read as text."""
        return T.StructType([T.StructField(n, SPARK_TYPES.get(t, T.StringType()), True)
                             for n, t in self.properties.items()])

    def to_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(n, t, n in self.required) for n, t in self.properties.items()], FIELDS_DDL)


# What a filled text cell can be, as bits: each class names all the types it still fits.
_CELL_BITS = {"word": 1, "digit": 2, "whole": 4, "number": 8, "text": 16}


def _cell_bit(value: Column) -> Column:
    """Bit of a trimmed cell: true/false, 0/1, other integer, other number, text; null when blank."""
    low = F.lower(value)
    return (F.when(value.isNull() | (value == ""), F.lit(None).cast("int"))
            .when(value.isin("0", "1"), _CELL_BITS["digit"])
            .when(low.isin("true", "false"), _CELL_BITS["word"])
            .when(value.rlike(_INT_TEXT), _CELL_BITS["whole"])
            .when(value.rlike(_FLOAT_TEXT), _CELL_BITS["number"])
            .otherwise(_CELL_BITS["text"]))


def infer_csv_schema(df: DataFrame) -> DataFrame:
    """(field, type, required) of a table of text cells, from all of its rows in one aggregate.

    Blank cells are ignored for the type; a field is required when no row leaves it blank. A column
    of only 0 and 1 is boolean. Each cell is read once, to a bit; the bits are or-ed per column.
    """
    named = [c for c in df.columns if c.strip(_BLANKS)]
    if not named:
        raise SchemaError("CSV data has no header row")
    cells = spread(df).select(*[F.btrim(F.col(f"`{c}`").cast("string"), F.lit(_BLANKS)).alias(f"v{i}")
                                for i, c in enumerate(named)])
    bits = cells.select(*[_cell_bit(F.col(f"v{i}")).alias(f"b{i}") for i in range(len(named))])
    seen = bits.agg(F.count(F.lit(1)).alias("rows"), *[
        agg.alias(f"{tag}{i}") for i in range(len(named))
        for tag, agg in (("n", F.count(f"b{i}")), ("bits", F.bit_or(f"b{i}")))])
    word, digit, whole, number = (_CELL_BITS[k] for k in ("word", "digit", "whole", "number"))
    entries = []
    for i, name in enumerate(named):
        filled, held = F.col(f"n{i}"), F.col(f"bits{i}")

        def only(mask: int) -> Column:
            return held.bitwiseAND(F.lit(~mask & 31)) == 0

        kind = (F.when(filled == 0, "string").when(only(word | digit), "boolean").when(only(digit | whole), "integer")
                .when(only(digit | whole | number), "number").otherwise("string"))
        entries.append(F.struct(F.lit(name.strip(_BLANKS)).alias("field"), kind.alias("type"),
                                ((filled > 0) & (filled == F.col("rows"))).alias("required")))
    return seen.select(F.inline(F.array(*entries)))


# A whole number too long for bigint; a short DECIMAL(p,0) was written with a fraction, as in 7.0.
_LONG_INTEGER = r"^DECIMAL\((19|[23]\d),0\)$"


def _variant_kind(value: Column) -> Column:
    """JSON-schema type of a variant; null counts as string."""
    kind = F.schema_of_variant(value)
    return (F.when(kind == "BOOLEAN", "boolean")
            .when(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | kind.rlike(_LONG_INTEGER), "integer")
            .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number")
            .when(kind.startswith("ARRAY"), "array")
            .when(kind.startswith("OBJECT"), "object")
            .otherwise("string"))


def _widest(kinds: int | Column, has: Mapping[str, Column]) -> Column:
    """One kind: itself; integer and number: number; anything else: string."""
    only_numbers = has["integer"] & has["number"] & (kinds == 2)
    single = F.coalesce(*[F.when(flag, F.lit(kind)) for kind, flag in has.items()])
    return F.when(kinds == 1, single).when(only_numbers, "number").otherwise("string")


def infer_json_schema(df: DataFrame, json_col: str = "json") -> DataFrame:
    """(field, type, required) over JSON objects, one per row.

    Each key's kinds are folded into six flags, so the aggregate state is constant in size; a key is
    required when every record carries it.
    """
    records = df.select(F.try_parse_json(F.col(json_col)).alias("doc"))
    pairs = records.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    total = df.agg(F.count(F.lit(1))).scalar()
    kinds = ("string", "integer", "number", "boolean", "array", "object")
    seen = (pairs.where(F.col("key").isNotNull()).select("key", _variant_kind(F.col("value")).alias("kind"))
            .groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.col("kind") == k).alias(k) for k in kinds]))
    n_kinds = sum((F.col(k).cast("int") for k in kinds), F.lit(0))
    return seen.select(F.col("key").alias("field"), _widest(n_kinds, {k: F.col(k) for k in kinds}).alias("type"),
                       (F.col("n") == total).alias("required"))


def _json_type(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "number"
    return "string"


def infer_parquet_schema(df: DataFrame) -> DataFrame:
    """Typed columns to JSON types; dates, decimals, lists and the rest are string.

    Spark reads Parquet columns as nullable, so ``required`` holds only for a DataFrame whose own
    schema says otherwise.
    """
    rows = [(f.name, _json_type(f.dataType), not f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, FIELDS_DDL)


def infer_schema(df: DataFrame, file_format: str, json_col: str = "json") -> DataFrame:
    """Dispatch on the file format (any case)."""
    fmt = file_format.strip().lower()
    if fmt not in FILE_FORMATS:
        raise SchemaError(f"Unsupported file format '{file_format}'. Must be one of: {', '.join(FILE_FORMATS)}")
    if fmt == "csv":
        return infer_csv_schema(df)
    if fmt == "json":
        return infer_json_schema(df, json_col)
    return infer_parquet_schema(df)


def infer_first_row_schema(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The weaker inference: types from the first row only (in ``order_by``), every field nullable."""
    first = df.orderBy(*order_by).limit(1)
    entries = []
    for name in df.columns:
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        kind = (F.when(value.rlike(r"^\d+$"), "integer")
                .when(F.btrim(value, F.lit(_BLANKS)).rlike(_FLOAT_TEXT), "double")
                .otherwise("string"))
        entries.append(F.struct(F.lit(name.strip(_BLANKS)).alias("field"), kind.alias("type"),
                                F.lit(True).alias("nullable")))
    return first.select(F.inline(F.array(*entries)))


def infer_first_record_schema(df: DataFrame, json_col: str, order_by: Sequence[str]) -> DataFrame:
    """First-record inference for JSON: numbers with a fraction are ``double``."""
    first = df.orderBy(*order_by).limit(1).select(F.try_parse_json(F.col(json_col)).alias("doc"))
    pairs = first.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("doc").outer())).where(F.col("key").isNotNull())
    kind = _variant_kind(F.col("value"))
    return pairs.select(F.col("key").alias("field"), F.when(kind == "number", "double").otherwise(kind).alias("type"),
                        F.lit(True).alias("nullable"))


def merge_schemas(fields: DataFrame, n_schemas: int | None = None) -> DataFrame:
    """Union of the fields of many schemas: rows (schema_id, field, type) to (field, type, required).

    Required means present in every schema, whatever each schema itself required.
    """
    kinds = ("string", "integer", "number", "boolean", "array", "object")
    total = (F.lit(n_schemas) if n_schemas is not None
             else fields.agg(F.count_distinct("schema_id")).scalar())
    merged = fields.groupBy("field").agg(
        F.count_distinct("schema_id").alias("n"), *[F.bool_or(F.col("type") == k).alias(k) for k in kinds])
    n_kinds = sum((F.col(k).cast("int") for k in kinds), F.lit(0))
    return merged.select("field", _widest(n_kinds, {k: F.col(k) for k in kinds}).alias("type"),
                         (F.col("n") == total).alias("required"))


def compatibility_violations(old: DataFrame, new: DataFrame, mode: str = "BACKWARD") -> DataFrame:
    """(field, reason) rows that break the mode, from two (field, type, required) tables.

    Our rule: BACKWARD forbids a new required field, a removed required field, an optional field made
    required and any type change but integer -> number or anything -> string. FORWARD is the same check
    with the sides swapped; FULL is both.
    """
    if mode not in MODES:
        raise SchemaError(f"Unsupported compatibility mode '{mode}'. Must be one of: {', '.join(sorted(MODES))}")
    if mode == "FULL":
        return (compatibility_violations(old, new, "BACKWARD")
                .unionByName(compatibility_violations(new, old, "BACKWARD")).distinct())
    if mode == "FORWARD":
        old, new = new, old
    pair = (old.select("field", F.col("type").alias("old_type"), F.col("required").alias("old_required"))
            .join(new.select("field", F.col("type").alias("new_type"), F.col("required").alias("new_required")),
                  "field", "full"))
    widened = ((F.col("old_type") == F.col("new_type")) | (F.col("new_type") == "string")
               | ((F.col("old_type") == "integer") & (F.col("new_type") == "number")))
    reason = (F.when(F.col("old_type").isNull() & F.col("new_required"), "new required field")
              .when(F.col("new_type").isNull() & F.col("old_required"), "removed required field")
              .when(F.col("old_type").isNotNull() & F.col("new_type").isNotNull() & ~widened, "narrowed type")
              .when(~F.col("old_required") & F.col("new_required"), "optional field made required"))
    return pair.select("field", reason.alias("reason")).where(F.col("reason").isNotNull())


def check_compatibility(old: DataFrame, new: DataFrame, mode: str = "BACKWARD", name: str = "") -> DataFrame:
    """One row: compatible, compatibility_mode, message."""
    found = compatibility_violations(old, new, mode).select(F.concat_ws(": ", "field", "reason").alias("text"))
    # violations are at most a few per column of one schema
    verdict = found.agg(F.array_join(F.array_sort(F.collect_list("text")), ", ").alias("reasons"),
                        (F.count(F.lit(1)) == 0).alias("compatible"))
    return verdict.select(
        "compatible", F.lit(mode).alias("compatibility_mode"),
        F.when(F.col("compatible"), F.lit(f"Schema '{name}' is {mode} compatible with the proposed changes."))
        .otherwise(F.concat(F.lit(f"Schema '{name}' is NOT {mode} compatible: "), F.col("reasons"))).alias("message"))


def editor_schema_name(cmo_id: str, name: str) -> str:
    """Registry name of an editor schema: ``{tenant}-{name}``, lower case, spaces as hyphens."""
    return f"{cmo_id}-{name}".lower().replace(" ", "-")


def registry_at(spark: SparkSession, root: str) -> KeyedLog:
    """An append-only schema registry under a folder."""
    return KeyedLog(spark, root, REGISTRY_DDL, "name")


def register_schema(registry: KeyedLog, name: str, schema: TableSchema, data_format: str = "JSON") -> int:
    """Append the schema's next version, 1 for a new name; returns the version number.

    The version is claimed before its fields are written, so two writers never share one.
    """
    if data_format not in FORMATS:
        raise SchemaError(f"Unsupported data format '{data_format}'. Must be one of: {', '.join(FORMATS)}")
    version = (registry.rows(name).agg(F.max("version")).first()[0] or 0) + 1
    while not registry.claim(name, version):
        version += 1
    registry.append(name, [(name, version, data_format, f, t, f in schema.required) for f, t in schema.properties.items()])
    return version


def get_schema(registry: KeyedLog, name: str, version: int | str = "latest") -> TableSchema:
    """One version of a schema, or its latest; unknown names and versions are errors."""
    rows = registry.rows(name)
    if version == "latest":
        version = rows.agg(F.max("version")).first()[0]
    if version is not None:
        schema = TableSchema.from_rows(rows.where(F.col("version") == int(version)))
        if schema.properties:
            return schema
    raise SchemaError(f"Schema '{name}' not found in registry")


def latest_schemas(registry_rows: DataFrame) -> DataFrame:
    """Fields of every schema's latest version."""
    newest = registry_rows.groupBy("name").agg(F.max("version").alias("version"))
    return registry_rows.join(newest, ["name", "version"], "left_semi")
