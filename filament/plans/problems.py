"""Queries pN_ of the core problems (2, 4, 5) and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from filament.operators.changefeed import standing
from filament.operators import instants
from filament.operators.instants import ANY_OFFSET, tick_instants
from filament.operators.shredding import agenda_tables, documents, entity, link, shred
from filament.plans.agenda import _FIELDS, _LINES
from filament.plans.thread import RECORDS
from filament.runtime import durable, new_path, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Agenda lines that carry an amendment uid, with their place in phase and snapshot."""
    snaps = documents(table(spark, d, "derouleur"), "snap_id", "body")
    adj = durable(shred(snaps, "doc", "body", ["ligne_amendement_uid"]), "adjacency")
    phases = adj.where("path = 'racine.contenu.phase' and kind = 'object'").select("key", "node", "parent", "ordinal")
    lines = link(entity(adj, "racine.contenu.phase.ligne", ["ligne_amendement_uid"]), phases, "phase")
    uid = F.regexp_replace("ligne_amendement_uid", r"(?U)^[\s\x{feff}\x{200b}]+|[\s\x{feff}\x{200b}]+$", "")
    return lines.select("key.snap_id", F.col("phase_no").cast("bigint").alias("phase_no"), F.col("ordinal").cast("bigint").alias("ligne_no"), uid.alias("ligne_amendement_uid")).where("ligne_amendement_uid <> ''").distinct()


def p2_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return agenda_tables(table(spark, d, "derouleur").select("snap_id", "body"))["snapshots"]


def p2_damaged(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots none of whose bodies holds a complete document: what the other tables have no row of."""
    snaps = table(spark, d, "derouleur").where("snap_id is not null")
    whole = shred(documents(snaps, "snap_id", "body"), "doc", "body", []).where("node = 0").select("key.snap_id").distinct()
    return snaps.select("snap_id").distinct().join(whole, "snap_id", "left_anti")


def p2_phases(spark: SparkSession, d: str) -> DataFrame:
    return agenda_tables(table(spark, d, "derouleur").select("snap_id", "body"))["phases"]


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    return agenda_tables(table(spark, d, "derouleur").select("snap_id", "body"))["lignes"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Ticks that have an instant, in epoch milliseconds."""
    return tick_instants(table(spark, d, "capture_ticks"), table(spark, d, "sittings")).where("utc_ms is not null").select("tick_id", "utc_ms")


def p4_how(spark: SparkSession, d: str) -> DataFrame:
    """How the ticks of each agent got their instant."""
    return tick_instants(table(spark, d, "capture_ticks"), table(spark, d, "sittings")).groupBy("agent", "how").agg(F.count(F.lit(1)).alias("n"))


def _unknown(spark: SparkSession, d: str) -> DataFrame:
    out = tick_instants(table(spark, d, "capture_ticks"), table(spark, d, "sittings"), None, ANY_OFFSET)
    return out.where("how in ('estimated', 'reference', 'none') and offset_min is not null")


def p4_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Ticks whose wall has no zone, as if nothing were known of it: the offset history decides alone."""
    return _unknown(spark, d).select("tick_id", "utc_ms", "offset_min")


def p4_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many walls without a zone the history alone reads as the rules of their zone do."""
    rules = tick_instants(table(spark, d, "capture_ticks"), table(spark, d, "sittings")).where("how in ('estimated', 'corrected')")
    both = rules.select("tick_id", "utc_ms").join(p4_unknown(spark, d).select("tick_id", F.col("utc_ms").alias("alone")), "tick_id", "left")
    n, right = F.count(F.lit(1)), F.count_if(F.col("utc_ms").eqNullSafe(F.col("alone")))
    return both.agg(n.alias("n"), right.alias("agree"), F.round(right / n, 4).alias("recall"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Nodes that stand at the end of their sitting."""
    return standing(table(spark, d, "thread_nodes"), new_path(spark, "thread")).select("sitting_uid", "seq")


QUERIES = {f.__name__: f for f in (p2_found, p2_snapshots, p2_phases, p2_lines, p2_damaged, p4_found, p4_how, p4_unknown, p4_recall, p5_found)}


def _wall_sql() -> str:
    """SQL of p4_found: the layouts of walls are the operator's fixed patterns; dates, zones and instants are worked out by the SQL engine."""
    parts = ["y", "m", "d", "h", "mi", "s", "f", "ap", "z", "o", "r"]
    layouts = [re.sub(r"\(\?P<\w+>\\b\\B\)\?", "", x) for x in instants._PATTERNS]
    cases = []
    for p in layouts:
        names = list(re.compile(p).groupindex)
        got = f"regexp_extract(w, '^(?:{p})$', [{', '.join(repr(n) for n in names)}])"
        cases.append(f"WHEN regexp_full_match(w, '{p}') THEN {{{', '.join(f'{x!r}: nullif(({got}).{x}, {chr(39)}{chr(39)})' if x in names else f'{x!r}: NULL' for x in parts)}}}")
    table = lambda pairs: "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"
    return f"""WITH t AS (SELECT DISTINCT tick_id, k.sitting_uid, wall, starttime * 1000 + t AS ref FROM capture_ticks k LEFT JOIN sittings s ON s.sitting_uid = k.sitting_uid WHERE tick_id IS NOT NULL),
        n AS (SELECT tick_id, ref, trim(regexp_replace(lower(strip_accents(wall)), '[\\x00-\\x20\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200b}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{feff}}]+', ' ', 'g'), ' "''`«»') AS w FROM t),
        c AS (SELECT tick_id, ref, w, CASE WHEN regexp_full_match(w, '{instants._NUMERIC}') THEN NULL {" ".join(cases)} END AS x FROM n),
        v AS (SELECT *, CAST(x.y AS INTEGER) + CASE WHEN length(x.y) = 2 THEN 2000 ELSE 0 END AS y, coalesce(try_cast(x.m AS INTEGER), ({table(instants._MONTHS)})[x.m]) AS mo, CAST(x.h AS INTEGER) AS h0, CAST(x.mi AS INTEGER) AS mi, coalesce(CAST(x.s AS INTEGER), 0) AS se FROM c),
        b AS (SELECT *, CASE WHEN x.ap IS NULL THEN h0 WHEN h0 BETWEEN 1 AND 12 THEN h0 % 12 + CASE x.ap WHEN 'p' THEN 12 ELSE 0 END END AS h, try_strptime(y || '-' || mo || '-' || x.d, '%Y-%m-%d') AS day FROM v),
        l AS (SELECT tick_id, ref, w, x, CASE WHEN h <= 23 AND mi <= 59 AND se <= 59 THEN epoch_ms(day) + ((h * 60 + mi) * 60 + se) * 1000 + CAST(left(rpad(coalesce(x.f, ''), 3, '0'), 3) AS INTEGER) END AS ms,
          CASE WHEN x.o IS NOT NULL THEN (CASE WHEN left(x.o, 1) = '-' THEN -1 ELSE 1 END) * (CAST(substr(x.o, 2, 2) AS INTEGER) * 60 + coalesce(try_cast(substr(replace(x.o, ':', ''), 4, 2) AS INTEGER), 0)) WHEN x.z IS NOT NULL THEN ({table(instants._ZONES)})[x.z] WHEN x.r IN ('utc', 'gmt') THEN 0 END AS off,
          coalesce((SELECT any_value(name) FROM pg_timezone_names() WHERE lower(name) = x.r), CASE WHEN x.r IS NULL THEN 'Europe/Paris' END) AS zone FROM b),
        r AS (SELECT *, epoch_ms(timezone(zone, make_timestamp(ms * 1000))) AS one FROM l WHERE TRUE),
        q AS (SELECT *, CASE WHEN epoch_ms(timezone(zone, make_timestamptz((one - 3600000) * 1000))) = ms THEN one - 3600000 ELSE one END AS first, CASE WHEN epoch_ms(timezone(zone, make_timestamptz((one + 3600000) * 1000))) = ms THEN one + 3600000 ELSE one END AS second FROM r),
        u AS (SELECT tick_id, coalesce(CASE WHEN regexp_full_match(w, '{instants._NUMERIC}') THEN CAST(left(rpad(replace(replace(w, ',', ''), '.', ''), 13, '0'), 13) AS BIGINT) END,
          CASE WHEN abs(off) < 19 * 60 THEN ms - off * 60000 WHEN off IS NULL THEN CASE WHEN abs(second - ref) < abs(first - ref) THEN second ELSE first END END, ref) AS utc_ms FROM q)
        SELECT tick_id, utc_ms FROM u WHERE utc_ms IS NOT NULL"""


_EDGE = r"[\s\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}\x{FEFF}]+"
SQL = {
    "p4_found": _wall_sql(),
    "p2_found": f"WITH {_LINES}, t AS (SELECT snap_id, phase_no, ligne_no, regexp_replace(ligne_amendement_uid, '^{_EDGE}|{_EDGE}$', '', 'g') AS ligne_amendement_uid FROM lg) SELECT * FROM t WHERE ligne_amendement_uid <> ''",
    "p2_lines": f"WITH {_LINES} SELECT snap_id, phase_no, ligne_no, {', '.join(_FIELDS)} FROM lg",
    "p2_snapshots": f"WITH {_LINES} SELECT DISTINCT snap_id, j ->> '$.racine.jaune.id' AS jaune_id, j ->> '$.racine.jaune.jaune_date_time' AS jaune_date_time, j ->> '$.racine.jaune.extract_date_time' AS extract_date_time FROM j1 WHERE json_type(j, '$.racine.jaune') = 'OBJECT'",
    "p2_damaged": f"WITH {_LINES} SELECT snap_id FROM j1 GROUP BY snap_id HAVING NOT bool_or(coalesce(json_type(j) IN ('OBJECT', 'ARRAY'), false))",
    "p2_phases": f"WITH {_LINES} SELECT snap_id, phase_no, p ->> '$.phase_libelle' AS phase_libelle, p ->> '$.phase_type' AS phase_type FROM ph WHERE json_type(p) = 'OBJECT'",
    "p5_found": f"""WITH RECURSIVE {RECORDS}
        SELECT n.sitting_uid, n.seq FROM n JOIN m ON m.sitting_uid = n.sitting_uid AND m.node = n.seq WHERE m.top = n.seq AND NOT n.gone""",
}
