"""Prefix sums that stay balanced when one key owns a large share of the rows.

A plain ``sum() over (partition by key order by ts)`` sorts a whole key in one task. Here rows are
range-partitioned on (key, order), so a hot key spreads over many slices; each slice is summed
locally and shifted by the totals of the slices before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.session import cut

_SLICE = "_slice"


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, Column],
                   slices: int | None = None) -> DataFrame:
    """Add one running-sum column per entry of ``totals``, per key, in ``order``.

    ``order`` should identify a row within its key: rows that tie on it cannot be split across
    slices. Null keys equal each other. The slices are fixed by a reliable checkpoint, because they
    are read twice and must be identical both times. Their number follows the shuffle partitions
    (adaptive execution merges small ones) unless given.
    """
    keys, order = list(keys), list(order)
    inputs = {f"_in_{name}": expr for name, expr in totals.items()}
    sliced = cut(
        df.select("*", *[expr.cast("bigint").alias(name) for name, expr in inputs.items()])
        .repartitionByRange(*([slices] if slices else []), *keys, *order)
        .withColumn(_SLICE, F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*keys, _SLICE).agg(*[F.sum(c).alias(f"{c}_sum") for c in inputs])
    before = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col(_SLICE).alias("_at"), *[F.coalesce(F.sum(f"{c}_sum").over(before), F.lit(0)).alias(f"{c}_offset") for c in inputs])
    within = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a null key is a key like any other
    same = sliced[_SLICE] == offsets["_at"]
    for i, k in enumerate(keys):
        same = same & sliced[k].eqNullSafe(offsets[f"_key{i}"])
    joined = sliced.join(offsets, same)
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{name}_offset") + F.sum(f"_in_{name}").over(within)).alias(name) for name in totals])


def sequence_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """1, 2, 3 ... per key in ``order``, balanced for hot keys."""
    return running_totals(df, keys, order, {name: F.lit(1)})


def global_rank(df: DataFrame, value: str, tie: str, name: str, descending: bool = True) -> DataFrame:
    """``rank()`` over the whole table without one task holding it: equal values share the first place.

    Rows are numbered across range slices; each distinct value takes the lowest number of its rows. Nulls come last.
    """
    numeric = F.col(value)
    keyed = df.withColumns({"_all": F.lit(0), "_none": numeric.isNull(), "_sort": -numeric if descending else numeric})
    numbered = sequence_numbers(keyed, ["_all"], ["_none", "_sort", tie], "_n")
    places = numbered.groupBy(F.col(value).alias("_value")).agg(F.min("_n").alias(name))
    return df.join(places, df[value].eqNullSafe(places["_value"])).select(*df.columns, name)
