"""Wall-clock spellings into UTC instants.

Three steps: ``parse_wall`` reads a spelling into civil microseconds plus what it says about its zone;
``offset_history`` estimates, where the zone is missing, the offset history of a source that minimises
violations against ingestion times; ``to_instants`` converts, and checks against a zone's rules if these
are known.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filament.runtime import durable

#: An offset history of up to so many rows is broadcast; beyond it the join shuffles.
BROADCAST_BINS = 200_000

# Month names, French and English, by their first letters without accents.
_MONTHS = {"janv": 1, "jan": 1, "fevr": 2, "fev": 2, "feb": 2, "mars": 3, "mar": 3, "avr": 4, "apr": 4, "mai": 5, "may": 5, "juin": 6, "jun": 6, "juil": 7, "jul": 7, "aou": 8, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12}
# Zone abbreviations and their offsets in minutes.
_ZONES = {"z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "cet": 60, "met": 60, "cest": 120, "mest": 120, "hnec": 60, "haec": 120, "eet": 120, "eest": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}

_ZONE = r"\s*(?P<z>" + "|".join(sorted(_ZONES, key=len, reverse=True)) + r")?\s*(?P<o>[+-][0-9]{2}(?::?[0-9]{2})?)?\s*(?:\[?(?P<r>[a-z]+(?:/[a-z0-9_+-]+){1,2}|utc|gmt)\]?)?"
_AMPM = r"(?:\s*(?P<ap>[ap])\.?m\b\.?)?"
_DAY = r"(?:(?:lun|mar|mer|jeu|ven|sam|dim|mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(?:le\s+)?"
_MONTH = r"(?P<m>" + "|".join(sorted(_MONTHS, key=len, reverse=True)) + r")[a-z]*\.?"
_SEP = r"(?:\s*t\s*|\s*,?\s+(?:(?:a|at)\s+)?|\s*,\s*)"

_REST = _SEP + r"(?P<h>[0-9]{1,2})\s*[:h]\s*(?P<mi>[0-9]{1,2})(?:\s*(?::|min|mn|m)?\s*(?P<s>[0-9]{1,2})(?:\s*s)?(?:[.,](?P<f>[0-9]{1,9}))?)?(?:\s*(?:min|mn|m|s))?" + _AMPM + _ZONE
_PATTERNS = [
    r"(?P<y>[0-9]{4})[-/.](?P<m>[0-9]{1,2})[-/.](?P<d>[0-9]{1,2})" + _REST,
    r"(?P<d>[0-9]{1,2})[-/.](?P<m>[0-9]{1,2})[-/.](?P<y>[0-9]{4}|[0-9]{2})" + _REST,
    r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})\s*[t ]\s*(?P<h>[0-9]{2}):?(?P<mi>[0-9]{2})(?::?(?P<s>[0-9]{2})(?:[.,](?P<f>[0-9]{1,9}))?)?(?P<ap>\b\B)?" + _ZONE,
    _DAY + r"(?P<d>[0-9]{1,2})(?:er|st|nd|rd|th)?[\s-]+" + _MONTH + r"[\s-]+(?P<y>[0-9]{4})" + _REST,
    _DAY + _MONTH + r"\s+(?P<d>[0-9]{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>[0-9]{4})" + _REST,
    r"(?P<y>[0-9]{4})(?P<m>[0-9]{2})(?P<d>[0-9]{2})(?P<h>[0-9]{2})(?P<mi>[0-9]{2})(?P<s>[0-9]{2})(?P<f>[0-9]{3})?(?P<ap>\b\B)?(?P<z>\b\B)?(?P<o>\b\B)?(?P<r>\b\B)?",
]
_ODD_SPACE = r"[\x00-\x20\xa0\u1680\u2000-\u200b\u202f\u205f\u3000\ufeff]+"
_ACCENTS = str.maketrans("àâäéèêëîïôöùûüç", "aaaeeeeiioouuuc")


_NUMERIC = r"[0-9]{10}(?:[.,][0-9]{1,9})?|[0-9]{13}|[0-9]{16}"
_UNREAD = (None, None, None, None)


class Walls:
    """Reads spellings one by one; ``zones`` maps lower-case region names to the names that Spark knows."""

    def __init__(self, zones: dict[str, str]):
        self.zones = zones
        self.patterns, self.numeric, self.space = [re.compile(p) for p in _PATTERNS], re.compile(_NUMERIC), re.compile(_ODD_SPACE)

    def read(self, text: str | None) -> tuple[int | None, int | None, int | None, str | None]:
        """(epoch µs, local µs, offset in minutes, region) of one spelling; see ``parse_wall``."""
        return read_wall(text, self.patterns, self.numeric, self.space, self.zones)


def read_wall(text: str | None, patterns: list[re.Pattern], numeric: re.Pattern, space: re.Pattern, zones: dict[str, str]) -> tuple[int | None, int | None, int | None, str | None]:
    if not text:
        return _UNREAD
    w = space.sub(" ", text.lower().translate(_ACCENTS)).strip(" \"'`«»")
    if numeric.fullmatch(w):
        return int(w.replace(",", ".").replace(".", "")[:16].ljust(16, "0")), None, None, None
    for p in patterns:
        if m := p.fullmatch(w):
            break
    else:
        return _UNREAD
    y, mo, d, h, mi, s, f, ap, z, o, r = m.group("y", "m", "d", "h", "mi", "s", "f", "ap", "z", "o", "r")
    year, hour = int(y) + (2000 if len(y) == 2 else 0), int(h)
    month = int(mo) if mo.isdigit() else _MONTHS[mo]
    if ap:
        if not 1 <= hour <= 12:
            return _UNREAD
        hour = hour % 12 + (12 if ap == "p" else 0)
    try:
        day = datetime.date(year, month, int(d)).toordinal() - 719163
    except ValueError:
        return _UNREAD
    minute, second = int(mi), int(s or 0)
    if hour > 23 or minute > 59 or second > 59:
        return _UNREAD
    offset = region = None
    if o:
        digits = o[1:].replace(":", "")
        hh, mm = int(digits[:2]), int(digits[2:] or 0)
        if hh > 18 or mm > 59:
            return _UNREAD
        offset = (-1 if o[0] == "-" else 1) * (hh * 60 + mm)
    elif z:
        offset = _ZONES[z]
    elif r in ("utc", "gmt"):
        offset = 0
    elif r:
        if r not in zones:
            return _UNREAD
        region = zones[r]
    return None, (day * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000 + int((f or "").ljust(6, "0")[:6]), offset, region


def region_names(spark: SparkSession) -> dict[str, str]:
    """Lower-case name -> name of every region that the session can convert from (about 600)."""
    return {str(z).lower(): str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()}


def parse_wall(df: DataFrame, wall: str) -> DataFrame:
    """Adds ``_epoch_us`` (instant known), or ``_local_us`` with ``_offset_min`` or ``_region`` (both null: no zone given).

    A bare number is epoch seconds (10 digits, fraction allowed), milliseconds (13) or microseconds
    (16), or a yyyyMMddHHmmss[SSS] stamp (14, 17). Day first unless the year leads; two-digit years
    are 20xx; missing seconds are zero. Where a wall names an offset and a region, the offset counts. A
    wall without a valid full date and time, or of an unknown region, gives nulls in all four; so do
    null and empty walls. The spellings are read by one Arrow-batched function: as expressions the
    layouts outgrow what a generated method may hold.
    """
    zones = region_names(df.sparkSession)

    @F.pandas_udf("_epoch_us bigint, _local_us bigint, _offset_min int, _region string")
    def read(col: pd.Series) -> pd.DataFrame:
        walls = Walls(zones)
        rows = [walls.read(x) for x in col]
        return pd.DataFrame(rows, columns=["_epoch_us", "_local_us", "_offset_min", "_region"]).astype({"_epoch_us": "Int64", "_local_us": "Int64", "_offset_min": "Int64", "_region": "object"})

    return df.withColumn("_read", read(F.col(wall).cast("string"))).select(*[F.col(f"`{c}`") for c in df.columns], "_read.*")


def zone_readings(local_us: Column, zone: Column) -> tuple[Column, Column]:
    """The readings (µs) of a civil time in a zone, equal where it occurs once.

    A skipped civil time is read with the offset before the change. A second reading is sought up to
    an hour after the first, the size of every change since 1945 in zones with summer time.
    """
    first = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))
    return first, F.when(shows(first + _HOUR, zone) == local_us, first + _HOUR).otherwise(first)


_HOUR = 3_600_000_000


def shows(us: Column, zone: Column) -> Column:
    """The civil time (µs) that clocks of a zone show at an instant."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def offset_history(df: DataFrame, group: Sequence[str], local_us: str, ingest_us: str, candidates_min: Sequence[int], bin_s: int = 3600, slack_s: int = 900, switch_cost: float = 3.0) -> DataFrame:
    """(group, _bin, offset_min, violations): the offset history with the fewest violations.

    For every candidate offset a row is a violation if its instant lies after its ingestion time or
    more than ``slack_s`` before it. Violations are counted per (group, bin of local time, candidate)
    with map-side combine, so what is solved per group has one entry a bin, however many rows share
    the group. Over the bins a dynamic programme chooses the offsets, a change costing
    ``switch_cost`` violations. Rows whose local or ingestion time is null have no say; a group
    without any such row gets no history. Ties go to the candidate named first.
    """
    cands = [int(c) for c in candidates_min]
    known = df.where(F.col(local_us).isNotNull() & F.col(ingest_us).isNotNull())
    cost = []
    for c in cands:
        lag = F.col(ingest_us) - (F.col(local_us) - c * 60_000_000)
        cost.append(F.count_if((lag < -1_000_000) | (lag > slack_s * 1_000_000)).cast("double").alias(f"_v{c}"))
    bins = known.groupBy(*group, F.floor(F.col(local_us) / (bin_s * 1_000_000)).alias("_bin")).agg(*cost)
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group)
    names, keys = [f"_v{c}" for c in cands], list(group)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_bin", kind="stable")
        v = pdf[names].to_numpy()
        total, back, own = v[0].copy(), np.empty(v.shape, np.int64), np.arange(len(cands))
        for i in range(1, len(v)):
            best = int(total.argmin())
            move = total[best] + switch_cost
            back[i] = np.where(total <= move, own, best)
            total = np.minimum(total, move) + v[i]
        path = np.empty(len(v), np.int64)
        path[-1] = int(total.argmin())
        for i in range(len(v) - 1, 0, -1):
            path[i - 1] = back[i, path[i]]
        out = pdf[[*keys, "_bin"]].copy()
        out["offset_min"] = np.array(cands)[path]
        out["violations"] = v[np.arange(len(v)), path].astype("int64")
        return out

    # Few rows that each cost some Python: in as many tasks as there are cores, whatever their size.
    n = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return bins.repartition(n, *keys).groupBy(*keys).applyInPandas(solve, f"{fields}, _bin bigint, offset_min int, violations bigint")


#: Offsets (minutes) tried where nothing is known of a zone: the whole hours in use.
ANY_OFFSET = tuple(60 * h for h in range(-12, 15))


def to_instants(df: DataFrame, wall: str, reference_ms: Column, group: Sequence[str], ingest: str, zone: str | None = "Europe/Paris", candidates_min: Sequence[int] = (60, 120), bin_s: int = 3600) -> DataFrame:
    """Adds ``utc_ms``, ``how`` and ``offset_min`` to every row.

    A wall without a zone takes its offset from the ``offset_history`` of its ``group``. With ``zone``
    None that is the result (null for a group without history). With a ``zone`` an exact check follows:
    the instant holds if the zone's clocks show that civil time at it and at no other instant; where
    the check fails, the zone's rules correct it: a time that occurs twice is the reading nearer to
    ``reference_ms`` (the first if that is null), a skipped one is read with the offset before the
    change. So with a ``zone`` the rules settle every row, and the history says how many needed them. A
    wall that names a region is read by that region's rules in the same way. Walls that cannot be read
    take ``reference_ms``; if that is null too, ``utc_ms`` is null. ``how`` is one of epoch, offset,
    region, estimated, corrected, reference, none.
    """
    ref = (reference_ms.cast("bigint") * 1000).alias("_ref_us")
    parsed = parse_wall(df.select("*", ref), wall)
    local = F.col("_local_us")
    naive = F.col("_epoch_us").isNull() & F.col("_offset_min").isNull() & F.col("_region").isNull()
    parsed = parsed.withColumn("_naive_us", F.when(naive, local)).withColumn("_in_us", F.unix_micros(F.col(ingest).cast("timestamp")))
    parsed = durable(parsed, "walls")  # read once, used for the history and for the conversion
    history = durable(offset_history(parsed, group, "_naive_us", "_in_us", candidates_min, bin_s), "history")
    if history.count() <= BROADCAST_BINS:
        history = F.broadcast(history)
    on = [F.col(f"p.{g}").eqNullSafe(F.col(f"h.{g}")) for g in group]
    # Only walls without a zone meet the history: the others, whose bin is null, would pile up on one key.
    known = parsed.where("_naive_us is null").withColumn("_est", F.lit(None).cast("int"))
    p = parsed.where("_naive_us is not null").withColumn("_b", F.floor(F.col("_naive_us") / (bin_s * 1_000_000))).alias("p")
    both = p.join(history.alias("h"), [*on, F.col("p._b") == F.col("h._bin")], "left").select(*[F.col(f"p.`{c}`") for c in parsed.columns], F.col("h.offset_min").alias("_est"))
    both = both.union(known.select(*[F.col(f"`{c}`") for c in parsed.columns], "_est"))
    guess, ref_us = F.col("_naive_us") - F.col("_est").cast("bigint") * 60_000_000, F.col("_ref_us")

    def by_rules(zone: Column) -> Column:
        first, second = zone_readings(local, zone)
        return F.when(F.abs(second - ref_us) < F.abs(first - ref_us), second).otherwise(first)

    estimated = guess
    if zone is not None:
        z = F.lit(zone)
        sure = (shows(guess, z) == local) & (shows(guess - _HOUR, z) != local) & (shows(guess + _HOUR, z) != local)
        estimated = F.when(sure, guess)
    both = both.withColumn("_fixed", F.when(F.col("_region").isNotNull() & F.col("_offset_min").isNull(), by_rules(F.col("_region"))).otherwise(local - F.col("_offset_min").cast("bigint") * 60_000_000)).withColumn("_guess", estimated)
    corrected = by_rules(F.lit(zone)) if zone is not None else F.lit(None).cast("bigint")
    both = both.withColumn("_chosen", F.when(F.col("_naive_us").isNotNull(), F.coalesce("_guess", corrected)))
    how = (
        F.when(F.col("_epoch_us").isNotNull(), "epoch")
        .when(F.col("_fixed").isNotNull(), F.when(F.col("_offset_min").isNotNull(), "offset").otherwise("region"))
        .when(F.col("_chosen").isNotNull(), F.when(F.col("_guess").isNotNull(), "estimated").otherwise("corrected"))
        .when(F.col("_ref_us").isNotNull(), "reference")
        .otherwise("none")
    )
    offset = F.coalesce("_offset_min", ((local - F.coalesce("_fixed", "_chosen")) / 60_000_000).cast("int"))
    us = F.coalesce("_epoch_us", "_fixed", "_chosen", "_ref_us")
    return both.select(*[F.col(f"`{c}`") for c in df.columns], F.floor(us / 1000).cast("bigint").alias("utc_ms"), how.alias("how"), offset.alias("offset_min"))


def tick_instants(ticks: DataFrame, sittings: DataFrame, zone: str | None = "Europe/Paris", candidates_min: Sequence[int] = (60, 120)) -> DataFrame:
    """One row per tick_id with its UTC instant; copies of a tick count once.

    ``t`` counts milliseconds from the sitting's ``starttime`` (epoch seconds). A tick of an unknown
    sitting, or with a null ``t``, has no reference. Rows whose tick_id is null are left out.
    """
    once = ticks.where("tick_id is not null").groupBy("tick_id", "sitting_uid", "agent", "wall", "t", "received_at").agg(F.lit(1).alias("_one")).drop("_one")
    start = sittings.where("sitting_uid is not null").groupBy("sitting_uid").agg(F.min("starttime").alias("_start"))
    joined = once.join(start, "sitting_uid", "left")
    out = to_instants(joined, "wall", F.col("_start") * 1000 + F.col("t"), ["sitting_uid", "agent"], "received_at", zone, candidates_min)
    return out.select("tick_id", "sitting_uid", "agent", "wall", "utc_ms", "how", "offset_min")
