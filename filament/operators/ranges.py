"""Ordered scans that no group has to fit a task for.

``scan`` gives every row what windows over an ordered group would give: values of the row before, the
last value known before it, running sums. The order is cut into ranges of (group, order); windows run
inside a range of a group, and one summary row per range and group carries their ends onward. So a
group that holds a third of all rows is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from filament.runtime import durable


def scan(df: DataFrame, part: Sequence[str], order: Sequence[str], lag: Mapping[str, Column] | None = None, last: Mapping[str, Column] | None = None, total: Mapping[str, Column] | None = None, peak: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds columns over the rows before a row in its group, in the order of ``order``.

    ``lag``: the value in the row just before (null in the first row). ``last``: the last value before
    the row that is not null. ``total``: the sum over the rows before the row, nulls as 0 (0 in the
    first row). ``peak``: the greatest value before the row (null if there is none). The order must be total in a group; of rows that tie the sequence is arbitrary. Null
    groups are a group, null order values come first. An empty table stays empty.
    """
    lag, last, total, peak = dict(lag or {}), dict(last or {}), dict(total or {}), dict(peak or {})
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    helpers = [c.alias(f"_lag_{k}") for k, c in lag.items()] + [c.alias(f"_last_{k}") for k, c in last.items()] + [F.coalesce(c.cast("bigint"), F.lit(0)).alias(f"_sum_{k}") for k, c in total.items()] + [c.alias(f"_max_{k}") for k, c in peak.items()]
    rows = df.select("*", *helpers).repartitionByRange(n, *part, *order).withColumn("_rid", F.spark_partition_id())
    rows = durable(rows, "ranges")
    inside = Window.partitionBy(*part, "_rid").orderBy(*order)
    past = inside.rowsBetween(Window.unboundedPreceding, -1)
    # The end of each range: its last row's values, its last known values, its sums.
    at = F.struct(*order)
    ends = rows.groupBy(*part, "_rid").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.struct(F.col(f"_lag_{k}").alias("v")), at).alias(f"_e_{k}") for k in lag],
        *[F.max_by(f"_last_{k}", F.when(F.col(f"_last_{k}").isNotNull(), at)).alias(f"_e_{k}") for k in last],
        *[F.sum(f"_sum_{k}").alias(f"_e_{k}") for k in total],
        *[F.max(f"_max_{k}").alias(f"_e_{k}") for k in peak],
    )
    across = Window.partitionBy(*part).orderBy("_rid")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(part)],
        F.col("_rid").alias("_r"),
        *[F.lag(f"_e_{k}").over(across).alias(f"_c_{k}") for k in lag],
        *[F.last(f"_e_{k}", ignorenulls=True).over(before).alias(f"_c_{k}") for k in last],
        *[F.coalesce(F.sum(f"_e_{k}").over(before), F.lit(0)).alias(f"_c_{k}") for k in total],
        *[F.max(f"_e_{k}").over(before).alias(f"_c_{k}") for k in peak],
    )
    carry = carry.toDF(*carry.columns)
    first = F.row_number().over(inside) == 1
    local = rows.select(
        "*",
        *([first.alias("_first")] if lag else []),
        *[F.lag(f"_lag_{k}").over(inside).alias(f"_l_{k}") for k in lag],
        *[F.last(f"_last_{k}", ignorenulls=True).over(past).alias(f"_l_{k}") for k in last],
        *[F.coalesce(F.sum(f"_sum_{k}").over(past), F.lit(0)).alias(f"_l_{k}") for k in total],
        *[F.max(f"_max_{k}").over(past).alias(f"_l_{k}") for k in peak],
    )
    on = [F.col("_rid") == F.col("_r")] + [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(part)]
    both = local.join(carry, on, "left")
    return both.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[F.when(F.col("_first"), F.col(f"_c_{k}")["v"]).otherwise(F.col(f"_l_{k}")).alias(k) for k in lag],
        *[F.coalesce(f"_l_{k}", f"_c_{k}").alias(k) for k in last],
        *[(F.col(f"_l_{k}") + F.col(f"_c_{k}")).alias(k) for k in total],
        *[F.greatest(f"_l_{k}", f"_c_{k}").alias(k) for k in peak],
    )


def _runs(t: pa.Table) -> Iterator[tuple[str | None, np.ndarray]]:
    """(group, ascending values) of one range."""
    t = t.sort_by([("part", "ascending"), ("value", "ascending")])
    parts, values = t.column("part").to_pylist(), t.column("value").to_numpy()
    cuts = [0, *[i for i in range(1, len(parts)) if parts[i] != parts[i - 1]], len(parts)]
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if z > a:
            yield parts[a], values[a:z]


def _last_kept(b: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the next one kept after it, and the last one kept if it is kept."""
    follow = np.searchsorted(b, b + gap, side="left")
    last = b.copy()
    for i in range(len(b) - 1, -1, -1):
        if follow[i] < len(b):
            last[i] = last[follow[i]]
    return follow, last


def greedy_gap(df: DataFrame, part: str, value: str, gap: float) -> DataFrame:
    """(part, value): the distinct values that lie at least ``gap`` after the last one kept before them.

    Which values of a range are kept depends on what came before only by its last kept value, and that
    lies before the range: so only values within ``gap`` of a range's first can be its first kept one.
    Each range gives these with the last value kept from each, the few rows a group has are gone
    through in order, and each range then keeps its values. Null values are left out; null groups are a
    group; the first value of a group is always kept.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = df.schema[part].dataType.simpleString()
    rows = df.select(F.col(part).alias("part"), F.col(value).cast("double").alias("value")).where("value is not null").distinct()
    rows = durable(rows.repartitionByRange(n, "part", "value").withColumn("rid", F.spark_partition_id()), "gaps")

    def ends(key: tuple, t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for p, b in _runs(t):
            k = min(int(np.searchsorted(b, b[0] + gap, side="left")) + 1, len(b))
            out.append((p, key[0].as_py(), b[:k].tolist(), _last_kept(b, gap)[1][:k].tolist()))
        cols = list(zip(*out, strict=True))
        return pa.table({"part": pa.array(cols[0], t.schema.field("part").type), "rid": pa.array(cols[1], pa.int32()), "starts": pa.array(cols[2], pa.list_(pa.float64())), "lasts": pa.array(cols[3], pa.list_(pa.float64()))})

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, into = pdf.sort_values("rid"), None, []
        for starts, lasts in zip(pdf["starts"], pdf["lasts"], strict=True):
            into.append(last)
            at = 0 if last is None else int(np.searchsorted(starts, last + gap, side="left"))
            if at < len(starts):
                last = float(lasts[at])
        return pd.DataFrame({"part": pdf["part"], "rid": pdf["rid"], "last": pd.array(into, "Float64")})

    def keep(key: tuple, t: pa.Table, before: pa.Table) -> pa.Table:
        known = dict(zip(before.column("part").to_pylist(), before.column("last").to_pylist(), strict=True))
        groups: list = []
        kept: list[float] = []
        for p, b in _runs(t):
            step, _ = _last_kept(b, gap)
            last = known.get(p)
            i = 0 if last is None else int(np.searchsorted(b, last + gap, side="left"))
            while i < len(b):
                groups.append(p)
                kept.append(float(b[i]))
                i = int(step[i])
        return pa.table({"part": pa.array(groups, t.schema.field("part").type), "value": pa.array(kept, pa.float64())})

    summary = rows.groupBy("rid").applyInArrow(ends, f"part {kind}, rid int, starts array<double>, lasts array<double>")
    carried = summary.groupBy("part").applyInPandas(follow, f"part {kind}, rid int, last double")
    out = rows.groupBy("rid").cogroup(durable(carried, "carried").groupBy("rid")).applyInArrow(keep, f"part {kind}, value double")
    return out.select(F.col("part").alias(part), F.col("value").alias(value))
