"""Interval joins by time bins of several sizes: overlap argmax and density of a look-ahead window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filament.runtime import durable


def _sized(df: DataFrame, beg: str, end: str, width: float) -> DataFrame:
    """Adds ``_level``: bins of width * 2**level are the least that an interval touches two of at most."""
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest((F.col(end) - F.col(beg)) / width, F.lit(1.0))))).cast("int")
    return df.withColumn("_level", level)


def _bins(beg: str, end: str, width: float, level: Column) -> Column:
    size = F.lit(width) * F.pow(F.lit(2.0), level)
    first, last = F.floor(F.col(beg) / size), F.floor(F.col(end) / size)
    return F.sequence(first, F.greatest(first, last))


def overlapping(a: DataFrame, b: DataFrame, part: str, width: float) -> DataFrame:
    """All pairs of an interval (part, beg, end, ..) of ``a`` and one (part, x, y, ..) of ``b`` that share time.

    Two intervals meet in the bins of the longer one's level, of which the shorter touches two at most,
    so long intervals cost no more than short ones. Only levels that occur are gone through. A pair
    counts once: in the first bin of that level that both touch.
    """
    a = durable(_sized(a, "beg", "end", width), "left")
    b = durable(_sized(b, "x", "y", width).withColumnRenamed("_level", "_level_b"), "right")
    # As many rows as there are powers of two between the shortest and the longest interval.
    levels = sorted({r[0] for r in a.select("_level").distinct().collect()} | {r[0] for r in b.select("_level_b").distinct().collect()})
    at = F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_own"))) if levels else F.lit(0)
    left = a.withColumn("_own", F.col("_level")).withColumn("_at", at)
    right = b.withColumn("_own", F.col("_level_b")).withColumn("_at", at)
    left = left.withColumn("_bin", F.explode(_bins("beg", "end", width, F.col("_at")))).drop("_own")
    right = right.withColumn("_bin", F.explode(_bins("x", "y", width, F.col("_at")))).drop("_own")
    size = F.lit(width) * F.pow(F.lit(2.0), F.col("_at"))
    both = left.join(right, [part, "_at", "_bin"]).where(F.col("_at") == F.greatest("_level", "_level_b"))
    return both.where((F.col("x") < F.col("end")) & (F.col("beg") < F.col("y")) & (F.col("_bin") == F.floor(F.greatest("beg", "x") / size))).drop("_at", "_bin", "_level", "_level_b")


def _finite(beg: str, end: str) -> Column:
    return F.col(beg).isNotNull() & F.col(end).isNotNull() & (F.abs(F.col(beg)) < 1e15) & (F.abs(F.col(end)) < 1e15)


def overlap_argmax(left: DataFrame, right: DataFrame, part: str, key: str, label: str, order: str, width: float = 30.0) -> DataFrame:
    """(part, key, label, overlap): for each left interval the right one it shares most time with.

    Both sides have ``beg`` and ``end``, of any length; of equal overlaps the first by ``order`` wins; no
    positive overlap gives nulls. Bounds that are null or not finite make an interval that overlaps nothing.
    """
    ok = _finite("beg", "end") & (F.col("end") > F.col("beg"))
    a = left.where(ok).select(part, key, "beg", "end")
    b = right.where(ok).select(part, F.col("beg").alias("x"), F.col("end").alias("y"), F.col(label).alias("_label"), F.col(order).alias("_order"))
    share = F.least("end", "y") - F.greatest("beg", "x")
    best = overlapping(a, b, part, width).groupBy(part, key).agg(F.max_by(F.struct("_label", share.alias("overlap")), F.struct(share, -F.col("_order"))).alias("m"))
    return left.select(part, key).join(best, [part, key], "left").select(part, key, F.col("m._label").alias(label), F.col("m.overlap").alias("overlap"))


def window_density(segments: DataFrame, part: str, key: str, window: float) -> DataFrame:
    """(part, key, voiced): seconds of segments inside [beg, beg + window] of each segment."""
    s = segments.where(_finite("beg", "end"))
    a = s.select(part, key, "beg", (F.col("beg") + window).alias("end"))
    b = s.select(part, F.col("beg").alias("x"), F.col("end").alias("y"))
    return overlapping(a, b, part, window).groupBy(part, key).agg(F.sum(F.greatest(F.lit(0.0), F.least("end", "y") - F.greatest("beg", "x"))).alias("voiced"))
