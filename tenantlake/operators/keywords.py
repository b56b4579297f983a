"""The wider rule keywords a contract may name, each measured by Spark aggregates.

Text form: ``Keyword "arg" ["arg" ...] [op number | between a and b | <= n hours]``. Keywords that need
only the table's own rows share one aggregate; those that need a value distribution or a second table
are separate aggregates, unioned into the same (rule, actual_value, passed) shape. Without a condition
a rule must measure 1 (a yes/no or full-ratio rule).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators.quality import QualityError, parse_rule, value_ok

# Every keyword a contract's rules may start with.
KEYWORDS = (
    "ColumnExists", "ColumnValues", "Completeness", "Uniqueness", "RowCount", "CustomSql", "IsComplete",
    "IsUnique", "IsPrimaryKey", "ColumnDataType", "ColumnNamesMatchPattern", "ColumnCorrelation",
    "StandardDeviation", "Mean", "Sum", "Entropy", "DistinctValuesCount", "UniqueValueRatio", "DataFreshness",
    "ReferentialIntegrity", "DatasetMatch", "SchemaMatch", "AggregateMatch", "RowCountMatch",
)

_COND = re.compile(r"(>=|<=|!=|>|<|=)\s*(-?[\d.]+)\s*(hours|days)?\s*$", re.I)
_RANGE = re.compile(r"between\s+(-?[\d.]+)\s+and\s+(-?[\d.]+)\s*$", re.I)
_QUOTED = re.compile(r'"([^"]*)"')
_AGGREGATE = re.compile(r"^(sum|avg|min|max|count)\((?:(\w+)\.)?(\w+|\*)\)$", re.I)
_DTYPE_CAST = {"integer": "bigint", "int": "int", "long": "bigint", "bigint": "bigint", "double": "double",
               "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "string": "string"}


class _Keyword:
    def __init__(self, order: int, text: str):
        self.order, self.text = order, text.strip()
        self.word = self.text.split()[0] if self.text else ""
        if self.word not in KEYWORDS:
            raise QualityError(f"Unrecognised keyword in rule: {text}")
        self.args = _QUOTED.findall(self.text)
        self.cond = _COND.search(self.text)
        self.range = _RANGE.search(self.text)

    def passed(self, actual: Column) -> Column:
        if self.range:
            ok = actual.between(float(self.range.group(1)), float(self.range.group(2)))
        elif self.cond:
            bound = float(self.cond.group(2))
            if (self.cond.group(3) or "").lower() == "days":
                bound *= 24
            ok = {">": actual > bound, ">=": actual >= bound, "<": actual < bound, "<=": actual <= bound,
                  "=": actual == bound, "!=": actual != bound}[self.cond.group(1)]
        else:
            ok = actual == 1.0
        return F.coalesce(ok, F.lit(False))

    def result(self, actual: Column) -> list[Column]:
        value = actual.cast("double")
        return [F.lit(self.order).alias("rule_order"), F.lit(self.text).alias("rule"),
                value.alias("actual_value"), self.passed(value).alias("passed")]


def _ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _flag(cond: Column) -> Column:
    return F.when(cond, 1.0).otherwise(0.0)


def _number(column: str) -> Column:
    return F.col(f"`_num_{column}`")


def _with_numbers(df: DataFrame, rules: Sequence[_Keyword]) -> DataFrame:
    """Numeric forms of the columns that numeric keywords read, coerced once per row."""
    dtypes = dict(df.dtypes)
    numeric = ("ColumnValues", "Mean", "Sum", "StandardDeviation", "ColumnCorrelation")
    used = dict.fromkeys(a for r in rules if r.word in numeric for a in r.args if a in dtypes)
    return df.withColumns({f"_num_{a}": S.to_number(F.col(f"`{a}`"), dtypes[a]) for a in used}) if used else df


def distinct_count(df: DataFrame, columns: Sequence[str]) -> Column:
    """Distinct non-null keys as a scalar subquery that reads the key columns only."""
    return df.agg(F.count_distinct(*[F.col(f"`{c}`") for c in columns]).alias("n")).scalar()


def _fused(rule: _Keyword, df: DataFrame, now: dt.datetime | None) -> Column | None:
    """Aggregate expression of a keyword that needs only this table's rows, else None."""
    dtypes = dict(df.dtypes)
    word, args = rule.word, rule.args
    rows = F.count(F.lit(1))
    known = [a for a in args if a in dtypes]
    col = F.col(f"`{args[0]}`") if args and args[0] in dtypes else None
    if word == "ColumnExists":
        return F.lit(1.0 if args and args[0] in dtypes else 0.0) + rows * 0
    if word == "ColumnNamesMatchPattern":
        hits = sum(1 for c in df.columns if re.fullmatch(args[0], c))
        return F.lit(hits / len(df.columns)) + rows * 0
    if word == "RowCount":
        return rows
    if word in ("IsComplete", "IsUnique", "IsPrimaryKey", "Completeness", "Uniqueness") and len(known) < len(args):
        return rows * 0
    if word == "IsComplete":
        return _flag(F.count(col) == rows)
    if word == "Completeness":
        return _ratio(F.count(col), rows)
    if word == "IsUnique":
        whole = F.lit(True)
        for a in args:
            whole = whole & F.col(f"`{a}`").isNotNull()
        return _flag(distinct_count(df, args) == F.count_if(whole))
    if word == "Uniqueness":
        return _ratio(distinct_count(df, args[:1]), F.count(col))
    if word == "IsPrimaryKey":
        return _flag(distinct_count(df, args) == rows)
    if col is None:
        return None
    if word == "ColumnValues":
        condition = F.lit(True)
        parsed = parse_rule("accuracy", rule.text)
        if parsed.form != "any":
            condition = value_ok(parsed, col, dtypes[args[0]])
        elif rule.cond:
            number, bound = _number(args[0]), float(rule.cond.group(2))
            condition = {">": number > bound, ">=": number >= bound, "<": number < bound, "<=": number <= bound,
                         "=": number == bound, "!=": number != bound}[rule.cond.group(1)]
        return _ratio(F.count_if(col.isNotNull() & condition), F.count(col))
    if word == "ColumnDataType":
        target = _DTYPE_CAST.get((args[1] if len(args) > 1 else "string").lower())
        if target is None:
            raise QualityError(f"Unknown data type in rule: {rule.text}")
        castable = S.as_text(col, dtypes[args[0]]).try_cast(target)
        return _ratio(F.count(castable), F.count(col))
    if word == "Mean":
        return F.avg(_number(args[0]))
    if word == "Sum":
        return F.sum(_number(args[0]))
    if word == "StandardDeviation":
        return F.stddev_samp(_number(args[0]))
    if word == "ColumnCorrelation":
        if len(known) < 2:
            return None
        return F.corr(_number(args[0]), _number(args[1]))
    if word == "DistinctValuesCount":
        return distinct_count(df, args[:1]) + rows * 0
    if word == "DataFreshness":
        if now is None:
            raise QualityError("DataFreshness needs the current instant")
        age = F.lit(now.replace(tzinfo=None)).cast("timestamp_ntz").cast("timestamp").cast("double")
        return (age - F.max(col).cast("timestamp").cast("double")) / 3600
    return None


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the non-null values."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """Natural-log entropy of a column: ``ln(total) - sum(n ln n) / total``."""
    n = F.col("n").cast("double")
    return value_counts(df, column).agg(
        F.coalesce(F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n), F.lit(0.0)).alias("actual"))


def unique_value_ratio(df: DataFrame, column: str) -> DataFrame:
    """Values occurring once over distinct values."""
    return value_counts(df, column).agg(
        _ratio(F.count_if(F.col("n") == 1), F.count(F.lit(1))).alias("actual"))


def referential_integrity(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Share of rows whose value exists in the reference column.

    Values are counted before the join, so a hot value crosses the shuffle once per map task.
    """
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    known = reference.select(F.col(ref_column).alias("value")).distinct().withColumn("_hit", F.lit(True))
    return counts.join(known, "value", "left").agg(
        _ratio(F.sum(F.when(F.col("_hit"), F.col("n")).otherwise(0)), F.sum("n")).alias("actual"))


def dataset_match(df: DataFrame, other: DataFrame, keys: Sequence[str],
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Share of keys (over both sides) whose rows agree on the compared columns.

    Rows are folded to one digest per key on each side first: duplicates of a key become one entry
    (count and order-free hash sum) instead of multiplying in the join.
    """
    if not keys:
        raise QualityError("DatasetMatch needs at least one key column")
    compared = [c for c in (columns or df.columns) if c not in keys]

    def digest(side: DataFrame, tag: str) -> DataFrame:
        # a null is hashed as a null at its place: xxhash64 alone would skip it
        flagged = [x for c in compared for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
        row_hash = F.xxhash64(*flagged) if compared else F.lit(0)
        return side.groupBy(*[F.col(f"`{k}`").alias(f"{tag}_k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(f"{tag}_n"),
                                       F.sum(row_hash.cast("decimal(38,0)")).alias(f"{tag}_h"))

    # a null-safe full join is not an equi-join for Spark; the flag and the value together are
    def keyed(side: DataFrame, tag: str) -> DataFrame:
        return side.select("*", *[F.struct(F.col(f"{tag}_k{i}").isNull(), F.col(f"{tag}_k{i}")).alias(f"_{i}")
                                  for i in range(len(keys))])

    left, right = keyed(digest(df, "a"), "a"), keyed(digest(other, "b"), "b")
    both = left.join(right, [left[f"_{i}"] == right[f"_{i}"] for i in range(len(keys))], "full")
    same = (F.col("a_n") == F.col("b_n")) & (F.col("a_h") == F.col("b_h"))
    return both.agg(_ratio(F.count_if(same), F.count(F.lit(1))).alias("actual"))


def schema_match(df: DataFrame, other: DataFrame) -> float:
    """Share of the reference's columns present with the same type."""
    mine, theirs = dict(df.dtypes), dict(other.dtypes)
    return sum(1 for n, t in theirs.items() if mine.get(n) == t) / max(len(theirs), 1)


def row_count_match(df: DataFrame, other: DataFrame) -> DataFrame:
    """Row count over the reference's row count."""
    sides = (df.select(F.lit(1).alias("a"), F.lit(0).alias("b"))
             .unionAll(other.select(F.lit(0).alias("a"), F.lit(1).alias("b"))))
    return sides.agg(_ratio(F.sum("a"), F.sum("b")).alias("actual"))


def _parse_aggregate(text: str) -> tuple[str, str | None, str]:
    m = _AGGREGATE.match(text.replace(" ", ""))
    if not m:
        raise QualityError(f"Unreadable aggregate: {text}")
    return m.group(1).lower(), m.group(2), m.group(3)


def _one_aggregate(df: DataFrame, func: str, column: str) -> DataFrame:
    target = F.lit(1) if column == "*" else F.col(f"`{column}`")
    return df.agg(getattr(F, func)(target).cast("double").alias("v"))


def aggregate_match(df: DataFrame, first: str, second: str, references: Mapping[str, DataFrame]) -> DataFrame:
    """Ratio of two aggregates such as ``sum(a)`` and ``sum(ref.b)``; 1 when they agree."""
    sides = []
    for tag, text in (("a", first), ("b", second)):
        func, ref, column = _parse_aggregate(text)
        table = references[ref] if ref else df
        sides.append(_one_aggregate(table, func, column).select(F.lit(tag).alias("side"), "v"))
    both = sides[0].unionAll(sides[1])
    return both.agg(_ratio(F.max(F.when(F.col("side") == "a", F.col("v"))),
                           F.max(F.when(F.col("side") == "b", F.col("v")))).alias("actual"))


def evaluate_keywords(df: DataFrame, texts: Sequence[str], references: Mapping[str, DataFrame] | None = None,
                      now: dt.datetime | None = None) -> DataFrame:
    """(rule_order, rule, actual_value, passed) for a list of keyword rules."""
    references = references or {}
    rules = [_Keyword(i, t) for i, t in enumerate(texts)]
    fused, out = [], []
    for rule in rules:
        if rule.word == "ColumnValues" and rule.cond and parse_rule("accuracy", rule.text).form == "any":
            # the comparison applies to each value, so the rule itself needs a full ratio
            rule_expr = _fused(rule, df, now)
            rule.cond = None
        else:
            rule_expr = _fused(rule, df, now)
        if rule.word == "ColumnValues":
            rule.range = None
        if rule_expr is not None:
            fused.append((rule, rule_expr))
            continue
        out.append(_separate(rule, df, references).select(*rule.result(F.col("actual"))))
    if fused:
        measured = _with_numbers(df, rules).agg(*[expr.cast("double").alias(f"_m{rule.order}") for rule, expr in fused])
        entries = [F.struct(*rule.result(F.col(f"_m{rule.order}"))) for rule, _ in fused]
        out.insert(0, measured.select(F.inline(F.array(*entries))))
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result


def _separate(rule: _Keyword, df: DataFrame, references: Mapping[str, DataFrame]) -> DataFrame:
    word, args = rule.word, rule.args
    if word == "Entropy":
        return entropy(df, args[0])
    if word == "UniqueValueRatio":
        return unique_value_ratio(df, args[0])
    if word == "ReferentialIntegrity":
        ref, ref_column = args[1].split(".", 1)
        return referential_integrity(df, args[0], references[ref], ref_column)
    if word == "DatasetMatch":
        return dataset_match(df, references[args[0]], [k.strip() for k in args[1].split(",")])
    if word == "SchemaMatch":
        return df.agg((F.lit(schema_match(df, references[args[0]])) + F.count(F.lit(1)) * 0).alias("actual"))
    if word == "RowCountMatch":
        return row_count_match(df, references[args[0]])
    if word == "AggregateMatch":
        return aggregate_match(df, args[0], args[1], references)
    raise QualityError(f"Rule cannot be measured (unknown column?): {rule.text}")
