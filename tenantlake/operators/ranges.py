"""Joins of points with the spans that hold them, as equi-joins.

``low <= at <= high`` alone makes Spark compare every row with every row. Here a span is laid into cells whose width
follows its length, so it touches two at most, and a point into one cell of every width that occurs. A point and a span
that holds it meet in exactly one cell, so nothing is found twice and no pair is lost. Crowded cells are dealt into a
grid: each side is numbered apart and copied over the other's numbers, so that every pair still meets once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.session import stage

#: Rows of one side that a cell may have before it is dealt.
CROWDED = 65_536
#: Widths are powers of 2 ** STEP: fewer copies of a point for wider cells.
STEP = 2
_MOST = 1 << 61
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _place(df: DataFrame, name: str, scale: float) -> Column:
    """A whole number that never falls as the value rises; that is all that cells need."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, _WHOLE):
        return F.greatest(F.least(c.cast("long"), F.lit(_MOST)), F.lit(-_MOST))
    if isinstance(kind, (T.DecimalType, T.FloatType, T.DoubleType)):
        # NaN is the greatest number to Spark, in comparisons as in least and greatest
        scaled = F.greatest(F.least(c.cast("double") * F.lit(float(scale)), F.lit(float(_MOST))), F.lit(-float(_MOST)))
        return F.floor(scaled).cast("long")
    raise TypeError(f"column {name} of type {kind.simpleString()} has no order to join by")


def _level(low: Column, high: Column) -> Column:
    """The smallest level, a multiple of STEP, whose cells are wider than the span."""
    length = high - low
    bits = F.when(length == 0, 0).otherwise(F.length(F.bin(length)))
    return (F.ceil(bits / F.lit(STEP)) * STEP).cast("int")


def _copies(n: Column) -> Column:
    return F.sequence(F.lit(0), n - 1)


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, on: Sequence[str] = (),
               scale: float = 1.0, crowded: int = CROWDED) -> DataFrame:
    """Rows of ``points`` with those of ``spans`` whose [``low``, ``high``] holds ``at``, both ends included.

    ``on`` are columns of both that must be equal. Other names must differ. Nulls in any of these columns match
    nothing, nor does a span whose low end is above its high end; repeated rows count as often as they occur. Values are
    whole or other numbers, dates or times, of one kind on both sides. Fractions smaller than one should be scaled up
    by ``scale``, so that they don't all fall into one cell; results don't depend on it.
    """
    clash = (set(points.columns) & set(spans.columns)) - set(on)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    kinds = {type(points.schema[at].dataType), type(spans.schema[low].dataType), type(spans.schema[high].dataType)}
    if len(kinds & {T.DateType, T.TimestampType, T.TimestampNTZType}) and len(kinds) > 1:
        raise TypeError(f"{at}, {low} and {high} must be of one kind")
    keys = [f"_on{i}" for i in range(len(on))]

    def keyed(df: DataFrame) -> list[Column]:
        return [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)]

    def known(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & F.col(f"`{n}`").isNotNull()
        return out

    held = spans.where(known(low, high, *on) & (F.col(f"`{low}`") <= F.col(f"`{high}`"))).withColumns(
        {"_low": _place(spans, low, scale), "_high": _place(spans, high, scale)})
    held = held.withColumn("_level", _level(F.col("_low"), F.col("_high")))
    first, last = F.expr("shiftright(_low, _level)"), F.expr("shiftright(_high, _level)")
    right = held.select(F.struct(*[F.col(f"`{c}`") for c in spans.columns]).alias("_span"), *keyed(spans), "_level",
                        F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))).alias("_cell"))
    right = stage(right, "spans")
    levels = sorted(r[0] for r in right.select("_level").distinct().collect())  # 32 at most
    left = points.where(known(at, *on)).withColumn("_at", _place(points, at, scale)).select(
        F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("_point"), *keyed(points), "_at",
        F.explode(F.array(*map(F.lit, levels)).cast("array<int>")).alias("_level"))
    left = stage(left.withColumn("_cell", F.expr("shiftright(_at, _level)")).drop("_at"), "points")

    cell = [*keys, "_level", "_cell"]
    counts = left.groupBy(*cell).agg(F.count(F.lit(1)).alias("_points")).join(
        right.groupBy(*cell).agg(F.count(F.lit(1)).alias("_spans")), cell)
    # few: each stands for ``crowded`` rows or more
    full = stage(counts.where((F.col("_points") > crowded) | (F.col("_spans") > crowded)).select(
        *cell, F.ceil(F.col("_points") / crowded).cast("int").alias("_m"), F.ceil(F.col("_spans") / crowded).cast("int").alias("_n")), "crowded")
    if full.isEmpty():
        met = left.join(right, cell)
    else:
        m, n = F.coalesce("_m", F.lit(1)), F.coalesce("_n", F.lit(1))
        # a row's own number is drawn before it is copied, and written, so a task that is run again deals as before
        left = left.join(full, cell, "left").withColumn("_i", F.floor(F.rand(1) * m).cast("int")).select(
            "_point", *cell, "_i", F.explode(_copies(n)).alias("_j"))
        right = right.join(full, cell, "left").withColumn("_j", F.floor(F.rand(2) * n).cast("int")).select(
            "_span", *cell, "_j", F.explode(_copies(m)).alias("_i"))
        met = stage(left, "dealt").join(stage(right, "dealt"), [*cell, "_i", "_j"])
    value = F.col(f"_point.`{at}`")
    inside = met.where((value >= F.col(f"_span.`{low}`")) & (value <= F.col(f"_span.`{high}`")))
    return inside.select(*[F.col(f"_point.`{c}`").alias(c) for c in points.columns],
                         *[F.col(f"_span.`{c}`").alias(c) for c in spans.columns if c not in on])
