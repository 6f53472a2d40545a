"""Queries of the deduction chain: what speech says of amendments, speakers and ballots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filament.operators import deduction
from filament.plans import registry
from filament.plans.agenda import _ADT, _LINES, amendments, lines_of
from filament.plans.text import _UTT, NAMES, RESOLVED
from filament.plans.thread import _BALLOT, _EV, _NUMS, events_of
from filament.runtime import durable, table

QUERIES, SQL, query = registry()

_HEARD = f"""{_LINES}, {_EV}, {_UTT}, a AS ({_ADT}), ua AS (SELECT ev.sitting_uid, ord, text, s.starttime * 1000 + CAST(trunc(beg * 1000) AS BIGINT) AS at_ms FROM ev JOIN sittings s ON s.sitting_uid = ev.sitting_uid WHERE type = 'utterance' AND text IS NOT NULL),
    h0 AS (SELECT sitting_uid, ord, at_ms, {_NUMS} AS l, list_transform(regexp_extract_all(text, '\\b([0-9]{{1,4}})\\b', 1), lambda x: CAST(x AS INTEGER)) AS r FROM ua),
    hn AS (SELECT sitting_uid, ord, at_ms, num, list_position(r, num) AS place FROM (SELECT sitting_uid, ord, at_ms, r, unnest(l) AS num FROM h0) q),
    hit AS (SELECT hn.sitting_uid, hn.ord, hn.place, hn.num, trim(a.ligne_amendement_uid) AS uid, nullif(a.depute_tribun_id, '') AS tribun, coalesce(a.ligne_libelle_1, '') AS label, a.ligne_amendement_derouleur_division_ancre AS article FROM hn JOIN a ON a.sitting_uid = hn.sitting_uid AND a.num = hn.num AND epoch_ms(a.seen_at) <= hn.at_ms
      QUALIFY row_number() OVER (PARTITION BY hn.sitting_uid, hn.ord, hn.num ORDER BY a.seen_at DESC, a.snap_id DESC, a.phase_no DESC, a.ligne_no DESC) = 1),
    lasts AS (SELECT sitting_uid, ord, arg_max({{'uid': uid, 'tribun': tribun, 'article': article}}, place) AS c FROM hit GROUP BY ALL),
    ctx AS (SELECT u.sitting_uid, u.ord, {_BALLOT} AS event, last_value(c IGNORE NULLS) OVER (PARTITION BY u.sitting_uid ORDER BY u.ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM u LEFT JOIN lasts ON lasts.sitting_uid = u.sitting_uid AND lasts.ord = u.ord)"""
_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in deduction.BALLOTS.items())
_NODES = f"""{_HEARD}, {NAMES}, asked AS (SELECT DISTINCT name AS heard FROM nm), {RESOLVED},
    sp AS (SELECT *, last_value(CASE WHEN call <> 'none' THEN uid END IGNORE NULLS) OVER (PARTITION BY sitting_uid ORDER BY ord, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM (SELECT nm.sitting_uid, ord, pos, name, call, uid FROM nm JOIN res ON res.heard = nm.name WHERE uid IS NOT NULL) q),
    nd AS (SELECT sitting_uid, ord, 1 AS rank, place AS pos, 'amendment' AS kind, label AS text, 'PA' || tribun AS acteur, tribun, uid AS amendement_uid, article, NULL AS groupe, NULL AS call, NULL AS heard, NULL AS groupe_label FROM hit QUALIFY row_number() OVER (PARTITION BY sitting_uid, uid ORDER BY ord, place) = 1
      UNION ALL SELECT sitting_uid, ord, 2, pos, 'speaker', concat_ws(' ', p.civ, p.prenom, p.nom), sp.uid, substr(sp.uid, 3), NULL, NULL, p.groupe_uid, nullif(call, 'none'), name, o.libelle FROM sp JOIN acteurs p ON p.uid = sp.uid LEFT JOIN organes o ON o.uid = p.groupe_uid WHERE floor IS NULL OR sp.uid <> floor
      UNION ALL SELECT sitting_uid, ord, 3, 0, 'ballot', CASE event {_LABELS} END, 'PA' || c.tribun, c.tribun, c.uid, c.article, NULL, NULL, NULL, NULL FROM ctx WHERE event IS NOT NULL)"""
_SEQ = "sq AS (SELECT sitting_uid, ord, rank, pos, kind, CAST(row_number() OVER (PARTITION BY sitting_uid ORDER BY ord, rank, pos) - 1 AS BIGINT) AS seq FROM (SELECT sitting_uid, ord, 0 AS rank, 0 AS pos, 'utterance' AS kind FROM ev UNION ALL SELECT sitting_uid, ord, rank, pos, kind FROM nd) q)"


def spoken(spark: SparkSession, d: str) -> DataFrame:
    """Utterances with the instant they begin at: (sitting_uid, ord, at_ms, t, text)."""
    e = events_of(spark, d).where("type = 'utterance' and text is not null")
    t = (F.col("beg") * 1000).cast("bigint")
    return e.join(table(spark, d, "sittings").select("sitting_uid", "starttime"), "sitting_uid").select("sitting_uid", "ord", (F.col("starttime") * 1000 + t).alias("at_ms"), t.alias("t"), "text")


def agenda_seen(spark: SparkSession, d: str) -> DataFrame:
    """Amendment lines as they were seen, one row a snapshot and line."""
    a = amendments(lines_of(spark, d, "ligne_type", "ligne_amendement_uid", "depute_tribun_id", "ligne_libelle_1", "ligne_amendement_derouleur_division_ancre"))
    return a.select("sitting_uid", "num", F.unix_millis("seen_at").alias("at_ms"), F.array("snap_id", "phase_no", "ligne_no").alias("place"), F.trim("ligne_amendement_uid").alias("uid"), F.col("depute_tribun_id").alias("tribun"), F.col("ligne_libelle_1").alias("label"), F.col("ligne_amendement_derouleur_division_ancre").alias("article"))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    u = durable(spoken(spark, d), "spoken")
    return durable(deduction.deduce(u, durable(agenda_seen(spark, d), "agenda"), table(spark, d, "acteurs"), table(spark, d, "organes")), "deduced")


@query(f"WITH RECURSIVE {_NODES}, {_SEQ} SELECT sitting_uid, ord, seq, kind FROM sq")
def shared_seq(spark, d):
    """One sequence for events and the nodes deduced from them: amendments, speakers, the ballot, each in text order."""
    return deduction.numbered(events_of(spark, d), nodes_of(spark, d)).select("sitting_uid", "ord", "seq", "kind")


@query(f"""WITH RECURSIVE {_NODES}, {_SEQ} SELECT nd.sitting_uid, sq.seq, CAST(trunc(ev.beg * 1000) AS BIGINT) AS t, nd.kind, nd.text, acteur, tribun, amendement_uid, article, groupe, call, heard, groupe_label FROM nd JOIN sq ON sq.sitting_uid = nd.sitting_uid AND sq.ord = nd.ord AND sq.rank = nd.rank AND sq.pos = nd.pos JOIN ev ON ev.sitting_uid = nd.sitting_uid AND ev.ord = nd.ord AND ev.type = 'utterance'""")
def deduced_nodes(spark, d):
    """All nodes deduced from speech, with their number in the shared sequence."""
    n, e = nodes_of(spark, d), events_of(spark, d)
    seq = deduction.numbered(e, n).where("rank > 0").drop("kind")
    t = e.where("type = 'utterance'").select("sitting_uid", "ord", (F.col("beg") * 1000).cast("bigint").alias("t"))
    return n.join(seq, ["sitting_uid", "ord", "rank", "pos"]).join(t, ["sitting_uid", "ord"]).select("sitting_uid", "seq", "t", "kind", "text", "canonical.*", "call", "heard", "groupe_label")


@query(f"WITH {_HEARD} SELECT sitting_uid, ord, event, c.uid AS amendement_uid FROM ctx")
def ballot_context(spark, d):
    """The amendment on hand at every utterance, ballots among them: the last one heard that was on the agenda by then."""
    u = durable(spoken(spark, d), "spoken")
    return deduction.on_hand(u, deduction.numbers_heard(u, agenda_seen(spark, d))).select("sitting_uid", "ord", "event", F.col("canonical.amendement_uid").alias("amendement_uid"))


@query(f"WITH {_HEARD} SELECT sitting_uid, ord, num, uid FROM hit")
def agenda_known(spark, d):
    """Numbers heard with the entry of the agenda that was known when they were said."""
    u = durable(spoken(spark, d), "spoken")
    return deduction.numbers_heard(u, agenda_seen(spark, d)).select("sitting_uid", "ord", "num", F.col("canonical.amendement_uid").alias("uid"))
