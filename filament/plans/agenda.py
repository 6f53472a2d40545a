"""Queries over agenda snapshots and reference tables: lines, context carried by speech, keys, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filament.functions import text as T
from filament.operators.ranges import scan
from filament.operators.shredding import LINE_FIELDS, agenda_tables
from filament.plans import registry
from filament.plans.text import _UTT, utterances
from filament.plans.thread import _NUMS, _TICKS, ticks_of
from filament.runtime import durable, table

QUERIES, SQL, query = registry()

# Kinds of line types, signs of a slate, and how many lines make a sitting open.
KINDS = {"ARTICLE": "article", "ADT": "amendment", "SSADT": "amendment", "INSCRIT": "speaker", "INSCRITDG": "speaker", "INSCRITQAG": "speaker", "INTERVCOMMISS": "speaker", "INTERVGVT": "speaker"}
OPEN_LINES = 20

_LIST = "CASE json_type({x}) WHEN 'ARRAY' THEN list_filter(json_extract({x}, '$[*]'), lambda y: json_type(y) <> 'NULL') WHEN 'OBJECT' THEN [{x}] ELSE [] END"
_FIELDS = LINE_FIELDS
_LINES = f"""b AS (SELECT snap_id, any_value(sitting_uid) AS sitting_uid, any_value(seen_at) AS seen_at, any_value(regexp_replace(body, '^[\\s\\x{{FEFF}}]+', '')) AS body FROM derouleur WHERE snap_id IS NOT NULL GROUP BY snap_id),
    j0 AS (SELECT snap_id, sitting_uid, seen_at, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM b),
    j1 AS (SELECT snap_id, sitting_uid, seen_at, CASE WHEN json_type(j) = 'VARCHAR' AND json_valid(j ->> '$') THEN CAST(j ->> '$' AS JSON) ELSE j END AS j FROM j0),
    p0 AS (SELECT snap_id, sitting_uid, seen_at, {_LIST.format(x="json_extract(j, '$.racine.contenu.phase')")} AS ps FROM j1 WHERE j IS NOT NULL),
    ph AS (SELECT snap_id, sitting_uid, seen_at, unnest(ps) AS p, CAST(generate_subscripts(ps, 1) AS BIGINT) AS phase_no FROM p0),
    l0 AS (SELECT snap_id, sitting_uid, seen_at, phase_no, p, {_LIST.format(x="json_extract(p, '$.ligne')")} AS ls FROM ph WHERE json_type(p) = 'OBJECT'),
    l1 AS (SELECT snap_id, sitting_uid, seen_at, phase_no, unnest(ls) AS l, CAST(generate_subscripts(ls, 1) AS BIGINT) AS ligne_no FROM l0),
    lg AS (SELECT snap_id, sitting_uid, seen_at, phase_no, ligne_no, {", ".join(f"l ->> '$.{f}' AS {f}" for f in _FIELDS)} FROM l1 WHERE json_type(l) = 'OBJECT')"""


def blank(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def tables_of(spark: SparkSession, d: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(lines, phases) of all snapshots, with the snapshot's sitting and time; lines with the fields wanted."""
    snaps = table(spark, d, "derouleur").where("snap_id is not null")
    t = agenda_tables(snaps.select("snap_id", "body"), fields or LINE_FIELDS)
    head = snaps.select("snap_id", "sitting_uid", "seen_at").distinct()
    return t["lignes"].join(head, "snap_id"), t["phases"].join(head, "snap_id")


def lines_of(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    return tables_of(spark, d, *fields)[0]


_LABEL = "concat_ws(' ', nullif(ligne_libelle_1, ''), nullif(ligne_libelle_compl_1, ''))"


@query(f"WITH {_LINES} SELECT snap_id, phase_no, ligne_no, ligne_amendement_uid AS uid FROM lg WHERE ligne_amendement_uid <> ''")
def agenda_lines(spark, d):
    """Lines with an amendment, of snapshots in every shape."""
    return lines_of(spark, d, "ligne_amendement_uid").where("ligne_amendement_uid <> ''").select("snap_id", "phase_no", "ligne_no", F.col("ligne_amendement_uid").alias("uid"))


@query(f"""WITH {_LINES} SELECT snap_id, phase_no, ligne_no, CASE {" ".join(f"WHEN ligne_type = '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'phase' END AS kind, {_LABEL} AS label FROM lg""")
def line_kind(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    return lines_of(spark, d, "ligne_type", "ligne_libelle_1", "ligne_libelle_compl_1").select("snap_id", "phase_no", "ligne_no", F.coalesce(kinds[F.col("ligne_type")], F.lit("phase")).alias("kind"), F.concat_ws(" ", blank("ligne_libelle_1"), blank("ligne_libelle_compl_1")).alias("label"))


@query(f"WITH {_LINES} SELECT snap_id, phase_no, ligne_no, 'PA' || nullif(depute_tribun_id, '') AS acteur, nullif(depute_tribun_id, '') AS tribun, nullif(ligne_amendement_uid, '') AS amendement_uid FROM lg")
def canonical_struct(spark, d):
    c = F.struct(F.concat(F.lit("PA"), blank("depute_tribun_id")).alias("acteur"), blank("depute_tribun_id").alias("tribun"), blank("ligne_amendement_uid").alias("amendement_uid"))
    return lines_of(spark, d, "depute_tribun_id", "ligne_amendement_uid").select("snap_id", "phase_no", "ligne_no", c.alias("canonical")).select("snap_id", "phase_no", "ligne_no", "canonical.*")


_ADT = r"SELECT *, CAST(regexp_extract(ligne_amendement_uid, 'N([0-9]{6})\s*$', 1) AS INTEGER) AS num FROM lg WHERE ligne_type IN ('ADT', 'SSADT') AND regexp_matches(ligne_amendement_uid, 'N[0-9]{6}\s*$')"


def amendments(lines: DataFrame) -> DataFrame:
    """Amendment lines with the number their uid ends in."""
    uid = F.col("ligne_amendement_uid")
    return lines.where(F.col("ligne_type").isin("ADT", "SSADT") & uid.rlike(r"N[0-9]{6}\s*$")).withColumn("num", F.regexp_extract(uid, r"N([0-9]{6})\s*$", 1).cast("int"))


def agenda_of(spark: SparkSession, d: str) -> DataFrame:
    """The agenda as it accumulates: per sitting and number the last entry seen, never deleted."""
    a = amendments(lines_of(spark, d, "ligne_type", "ligne_amendement_uid", "ligne_libelle_1", "ligne_libelle_compl_1"))
    return a.groupBy("sitting_uid", "num").agg(F.max_by(F.struct(F.trim("ligne_amendement_uid").alias("uid"), F.concat_ws(" ", blank("ligne_libelle_1"), blank("ligne_libelle_compl_1")).alias("label")), F.struct("snap_id", "phase_no", "ligne_no")).alias("e")).select("sitting_uid", "num", "e.*")


_AGENDA = f"""{_LINES}, a AS ({_ADT}), ag AS (SELECT sitting_uid, num, trim(ligne_amendement_uid) AS uid, {_LABEL} AS label FROM a QUALIFY row_number() OVER (PARTITION BY sitting_uid, num ORDER BY snap_id DESC, phase_no DESC, ligne_no DESC) = 1)"""


@query(f"WITH {_AGENDA} SELECT sitting_uid, num, uid, label FROM ag")
def agenda_index(spark, d):
    return agenda_of(spark, d)


def heard_numbers(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("sitting_uid", "ord", F.posexplode(T.amendment_numbers(F.col("text"))).alias("pos", "num"))


# list_distinct keeps no order in SQL: the place of a number is that of its first occurrence.
_HEARD = f"""{_UTT}, h0 AS (SELECT sitting_uid, ord, {_NUMS} AS l, list_transform(regexp_extract_all(text, '\\b([0-9]{{1,4}})\\b', 1), lambda x: CAST(x AS INTEGER)) AS r FROM u),
    hn AS (SELECT sitting_uid, ord, num, list_position(r, num) AS place FROM (SELECT sitting_uid, ord, r, unnest(l) AS num FROM h0) q)"""


@query(f"WITH {_AGENDA}, {_HEARD} SELECT h.sitting_uid, ord, h.num, uid FROM hn h JOIN ag ON ag.sitting_uid = h.sitting_uid AND ag.num = h.num")
def agenda_lookup(spark, d):
    """Numbers heard that are on the agenda; others resolve to nothing."""
    return heard_numbers(spark, d).join(agenda_of(spark, d), ["sitting_uid", "num"]).select("sitting_uid", "ord", "num", "uid")


@query(f"""WITH {_LINES}, a AS ({_ADT}), k AS (SELECT DISTINCT sitting_uid, num, seen_at, snap_id, trim(ligne_amendement_uid) AS uid FROM a), t AS (SELECT n.sitting_uid, seq, CAST(regexp_extract(canonical.amendement_uid, 'N([0-9]{{6}})$', 1) AS INTEGER) AS num, starttime * 1000 + t AS at_ms FROM
      (SELECT sitting_uid, seq, any_value(t) AS t, any_value(canonical) AS canonical FROM thread_nodes WHERE kind = 'amendment' GROUP BY ALL) n JOIN sittings s ON s.sitting_uid = n.sitting_uid WHERE regexp_matches(canonical.amendement_uid, 'N[0-9]{{6}}$'))
    SELECT t.sitting_uid, t.seq, t.num, max(k.snap_id) FILTER (WHERE epoch_ms(k.seen_at) <= at_ms) IS NOT NULL AS known, CAST(count(*) FILTER (WHERE epoch_ms(k.seen_at) <= at_ms) AS BIGINT) AS seen FROM t JOIN k ON k.sitting_uid = t.sitting_uid AND k.num = t.num GROUP BY ALL""")
def agenda_asof(spark, d):
    """Amendment nodes against the agenda known when they were said: how many snapshots had the number by then."""
    n = table(spark, d, "thread_nodes").where("kind = 'amendment'").groupBy("sitting_uid", "seq").agg(F.min("t").alias("t"), F.min("canonical.amendement_uid").alias("uid")).where(F.col("uid").rlike("N[0-9]{6}$"))
    t = n.join(table(spark, d, "sittings").select("sitting_uid", "starttime"), "sitting_uid").select("sitting_uid", "seq", F.regexp_extract("uid", "N([0-9]{6})$", 1).cast("int").alias("num"), (F.col("starttime") * 1000 + F.col("t")).alias("at_ms"))
    k = amendments(lines_of(spark, d, "ligne_type", "ligne_amendement_uid")).select("sitting_uid", "num", F.unix_millis("seen_at").alias("at_ms"), "snap_id").distinct()
    # As-of by one ordered pass: the running count of snapshots of a number, read at each node. At the
    # same instant the snapshot comes first.
    both = k.select("sitting_uid", "num", "at_ms", F.lit(0).alias("probe"), F.col("snap_id").alias("seq")).union(t.select("sitting_uid", "num", "at_ms", F.lit(1), "seq"))
    s = scan(both, ["sitting_uid", "num"], ["at_ms", "probe", "seq"], total={"seen": (F.col("probe") == 0).cast("int")})
    on = k.select("sitting_uid", "num").distinct()
    return s.where("probe = 1").join(on, ["sitting_uid", "num"], "left_semi").select("sitting_uid", "seq", "num", (F.col("seen") > 0).alias("known"), "seen")


@query(f"WITH {_AGENDA}, {_HEARD} SELECT h.sitting_uid, uid, min(ord) AS ord FROM hn h JOIN ag ON ag.sitting_uid = h.sitting_uid AND ag.num = h.num GROUP BY ALL")
def first_occurrence(spark, d):
    """Where each amendment is woven: the first utterance that names it."""
    return heard_numbers(spark, d).join(agenda_of(spark, d), ["sitting_uid", "num"]).groupBy("sitting_uid", "uid").agg(F.min("ord").alias("ord"))


_SPEAKERS = "sp AS (SELECT sitting_uid, seq, any_value(canonical.acteur) AS uid, any_value(nullif(call, '')) AS call FROM thread_nodes WHERE kind = 'speaker' AND canonical.acteur IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_SPEAKERS}, f AS (SELECT *, last_value(CASE WHEN call IS NOT NULL THEN uid END IGNORE NULLS) OVER (PARTITION BY sitting_uid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM sp)
    SELECT sitting_uid, seq, uid, floor FROM f WHERE floor IS NULL OR uid <> floor""")
def speaker_turns(spark, d):
    """Speaker nodes that are not the one who has the floor; only calls move the floor."""
    n = table(spark, d, "thread_nodes").where("kind = 'speaker' and canonical.acteur is not null").groupBy("sitting_uid", "seq").agg(F.min("canonical.acteur").alias("uid"), F.min(F.nullif("call", F.lit(""))).alias("call"))
    s = scan(n, ["sitting_uid"], ["seq"], last={"floor": F.when(F.col("call").isNotNull(), F.col("uid"))})
    return s.where("floor is null or uid <> floor").select("sitting_uid", "seq", "uid", "floor")


@query("SELECT a.uid, a.civ, a.nom, o.libelle AS groupe_label FROM acteurs a LEFT JOIN organes o ON o.uid = a.groupe_uid")
def speaker_group(spark, d):
    """Persons with their group's label, null where there is none."""
    o = table(spark, d, "organes").select(F.col("uid").alias("groupe_uid"), F.col("libelle").alias("groupe_label"))
    return table(spark, d, "acteurs").join(o, "groupe_uid", "left").select("uid", "civ", "nom", "groupe_label")


@query(f"""WITH {_LINES}, sn AS (SELECT snap_id, sitting_uid, row_number() OVER (PARTITION BY sitting_uid ORDER BY snap_id) AS k FROM b), h AS (SELECT lg.sitting_uid, k, lg.id, min({_LABEL}) AS label FROM lg JOIN sn ON sn.snap_id = lg.snap_id WHERE ligne_video_highlighted = 'true' AND lg.id IS NOT NULL GROUP BY ALL),
    w AS (SELECT *, lag(k) OVER (PARTITION BY sitting_uid, id ORDER BY k) AS pk, lag(label) OVER (PARTITION BY sitting_uid, id ORDER BY k) AS pl FROM h)
    SELECT sitting_uid, k, id, label, CASE WHEN pk IS NULL OR pk <> k - 1 THEN 'entry' ELSE 'relabel' END AS change FROM w WHERE pk IS NULL OR pk <> k - 1 OR pl IS DISTINCT FROM label""")
def highlight_transitions(spark, d):
    """Highlighted lines that enter, come back, or change their label from one snapshot to the next."""
    snaps = table(spark, d, "derouleur").where("snap_id is not null").select("sitting_uid", "snap_id").distinct()
    k = scan(snaps, ["sitting_uid"], ["snap_id"], total={"n": F.lit(1)}).select("snap_id", (F.col("n") + 1).alias("k"))
    h = lines_of(spark, d, "ligne_video_highlighted", "id", "ligne_libelle_1", "ligne_libelle_compl_1").where("ligne_video_highlighted = 'true' and id is not null").join(k, "snap_id")
    h = h.groupBy("sitting_uid", "id", "k").agg(F.min(F.concat_ws(" ", blank("ligne_libelle_1"), blank("ligne_libelle_compl_1"))).alias("label"))
    s = scan(h, ["sitting_uid", "id"], ["k"], lag={"was": F.struct("k", "label")})
    fresh = F.col("was").isNull() | (F.col("was.k") != F.col("k") - 1)
    return s.where(fresh | ~F.col("was.label").eqNullSafe(F.col("label"))).select("sitting_uid", "k", "id", "label", F.when(fresh, "entry").otherwise("relabel").alias("change"))


@query(f"""WITH {_LINES}, pt AS (SELECT snap_id, phase_no, p ->> '$.phase_libelle' AS libelle FROM ph WHERE json_type(p) = 'OBJECT'), c AS (SELECT snap_id, count(*) AS n, count(*) FILTER (WHERE ligne_video_highlighted = 'true') AS lit, count(*) FILTER (WHERE ligne_type = 'INSCRITQAG') AS qag, max(phase_no) FILTER (WHERE ligne_video_highlighted = 'true') AS hp FROM lg GROUP BY snap_id),
    x AS (SELECT snap_id, max(phase_no) AS lp FROM pt GROUP BY snap_id), ty AS (SELECT snap_id, string_agg(t || ':' || n, ',' ORDER BY t) AS types FROM (SELECT snap_id, coalesce(ligne_type, '?') AS t, count(*) AS n FROM lg GROUP BY ALL) q GROUP BY snap_id)
    SELECT x.snap_id, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(coalesce(lit, 0) AS BIGINT) AS highlighted, CAST(coalesce(qag, 0) AS BIGINT) AS qag, coalesce(pt.libelle, '') AS phase, coalesce(types, '') AS types FROM x LEFT JOIN ty ON ty.snap_id = x.snap_id LEFT JOIN c ON c.snap_id = x.snap_id LEFT JOIN pt ON pt.snap_id = x.snap_id AND pt.phase_no = coalesce(c.hp, x.lp)""")
def snapshot_summary(spark, d):
    """Lines, highlights, questions, lines by type, and the active phase: the last one with a highlight, else the last."""
    lines, phases = tables_of(spark, d, "ligne_video_highlighted", "ligne_type")
    lit = F.col("ligne_video_highlighted") == "true"
    c = lines.groupBy("snap_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(lit).alias("highlighted"), F.count_if(F.col("ligne_type") == "INSCRITQAG").alias("qag"), F.max(F.when(lit, F.col("phase_no"))).alias("hp"))
    last = phases.groupBy("snap_id").agg(F.max("phase_no").alias("lp"))
    at = last.join(c, "snap_id", "left").withColumn("phase_no", F.coalesce("hp", "lp"))
    typed = lines.groupBy("snap_id", F.coalesce("ligne_type", F.lit("?")).alias("t")).agg(F.count(F.lit(1)).alias("k"))
    types = typed.groupBy("snap_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "k")))).alias("types"))  # one entry a type
    shown = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    at = at.join(phases.select("snap_id", "phase_no", "phase_libelle"), ["snap_id", "phase_no"], "left").join(types, "snap_id", "left")
    return at.select("snap_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n", "highlighted", "qag")], F.coalesce("phase_libelle", F.lit("")).alias("phase"), F.coalesce(shown, F.lit("")).alias("types"))


@query(f"WITH {_LINES} SELECT snap_id, phase_no, ligne_no, nullif(regexp_extract(ligne_libelle_1, '{T.LABEL_NUMBER}', 1), '') AS num FROM lg WHERE regexp_matches(ligne_libelle_1, '{T.LABEL_NUMBER}')")
def label_number(spark, d):
    """The amendment number in a line's label."""
    return lines_of(spark, d, "ligne_libelle_1").select("snap_id", "phase_no", "ligne_no", T.label_number(F.col("ligne_libelle_1")).alias("num")).where("num is not null")


#: Keys of one request to a reference interface.
BATCH = 20


@query(f"""WITH k AS (SELECT DISTINCT canonical.acteur AS uid FROM thread_nodes WHERE canonical.acteur IS NOT NULL), r AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS place FROM k)
    SELECT CAST(place // {BATCH} AS BIGINT) AS batch, r.uid, CAST(place AS BIGINT) AS place, a.prenom, a.nom FROM r LEFT JOIN acteurs a ON a.uid = r.uid""")
def keyed_batches(spark, d):
    """Keys in batches of one request, with what the reference holds of each, in the order asked for."""
    k = table(spark, d, "thread_nodes").select(F.col("canonical.acteur").alias("uid")).where("uid is not null").distinct().withColumn("g", F.lit(0))
    r = scan(k, ["g"], ["uid"], total={"place": F.lit(1)})
    return r.join(table(spark, d, "acteurs").select("uid", "prenom", "nom"), "uid", "left").select(F.floor(F.col("place") / BATCH).alias("batch"), "uid", "place", "prenom", "nom")


@query(f"""WITH {_LINES}, c AS (SELECT snap_id, phase_no, count(*) AS n, bool_or(coalesce(starts_with(ligne_type, 'NEXTSEANCE'), false)) AS nxt, bool_or(coalesce(ligne_type IN ('ADT', 'ARTICLE', 'SSADT'), false)) AS work FROM lg GROUP BY ALL),
    s AS (SELECT ph.snap_id, ph.phase_no, coalesce(p ->> '$.phase_type' = 'IS', false) OR contains(upper(coalesce(p ->> '$.phase_libelle', '')), 'PROVID') OR coalesce(nxt, false) AS slate, coalesce(work, false) AS work, coalesce(n, 0) AS n FROM ph LEFT JOIN c ON c.snap_id = ph.snap_id AND c.phase_no = ph.phase_no WHERE json_type(p) = 'OBJECT'),
    o AS (SELECT snap_id, bool_or(slate) AS slate, coalesce(sum(n) FILTER (WHERE work AND NOT slate), 0) AS n FROM s GROUP BY snap_id) SELECT snap_id, slate, CAST(n AS BIGINT) AS content_lines, NOT slate AND n >= {OPEN_LINES} AS open FROM o""")
def open_detection(spark, d):
    """Whether a snapshot shows a sitting on air: no slate, and enough lines of work."""
    lines, phases = tables_of(spark, d, "ligne_type")
    c = lines.groupBy("snap_id", "phase_no").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce(F.col("ligne_type").startswith("NEXTSEANCE"), F.lit(False))).alias("nxt"), F.bool_or(F.coalesce(F.col("ligne_type").isin("ADT", "ARTICLE", "SSADT"), F.lit(False))).alias("work"))
    s = phases.join(c, ["snap_id", "phase_no"], "left")
    slate = F.coalesce(F.col("phase_type") == "IS", F.lit(False)) | F.upper(F.coalesce("phase_libelle", F.lit(""))).contains("PROVID") | F.coalesce("nxt", F.lit(False))
    o = s.withColumn("slate", slate).groupBy("snap_id").agg(F.bool_or("slate").alias("slate"), F.coalesce(F.sum(F.when(F.coalesce("work", F.lit(False)) & ~F.col("slate"), F.col("n"))), F.lit(0)).alias("content_lines"))
    return o.withColumn("open", ~F.col("slate") & (F.col("content_lines") >= OPEN_LINES))


@query(f"WITH {_LINES}, h AS (SELECT snap_id, list(coalesce(id, '') ORDER BY phase_no, ligne_no) AS l FROM lg WHERE ligne_video_highlighted = 'true' GROUP BY snap_id) SELECT snap_id, coalesce(l[4], l[-1]) AS cursor FROM h")
def cursor_guess(spark, d):
    """The fourth highlighted line of a snapshot, else the last."""
    h = lines_of(spark, d, "ligne_video_highlighted", "id").where("ligne_video_highlighted = 'true'").groupBy("snap_id").agg(F.array_sort(F.collect_list(F.struct("phase_no", "ligne_no", F.coalesce("id", F.lit("")).alias("id")))).alias("l"))
    return h.select("snap_id", F.coalesce(F.try_element_at("l.id", F.lit(4)), F.element_at("l.id", -1)).alias("cursor"))


@query(f"""WITH {_LINES} SELECT DISTINCT kind, key FROM (SELECT 'tribun' AS kind, regexp_extract(depute_tribun_id, '[0-9]+', 0) AS key FROM lg UNION ALL SELECT 'amendement', trim(ligne_amendement_uid) FROM lg UNION ALL SELECT 'bibard', trim(texte_bibard) FROM lg) q WHERE key <> ''""")
def key_extraction(spark, d):
    """All keys that the snapshots mention, by kind."""
    x = lines_of(spark, d, "depute_tribun_id", "ligne_amendement_uid", "texte_bibard").select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("key")) for k, c in (("tribun", F.regexp_extract("depute_tribun_id", "[0-9]+", 0)), ("amendement", F.trim("ligne_amendement_uid")), ("bibard", F.trim("texte_bibard")))])).alias("x"))
    return x.select("x.*").where("key <> ''").distinct()


@query("SELECT groupe_uid AS uid FROM acteurs WHERE groupe_uid IS NOT NULL UNION SELECT canonical.groupe FROM thread_nodes WHERE canonical.groupe IS NOT NULL")
def group_union(spark, d):
    a = table(spark, d, "acteurs").select(F.col("groupe_uid").alias("uid"))
    return a.union(table(spark, d, "thread_nodes").select("canonical.groupe")).where("uid is not null").distinct()


@query(f"""WITH {_LINES}, f AS (SELECT snap_id, phase_no, ligne_no, unnest([{", ".join(f"{{'name': '{x}', 'v': {x}}}" for x in _FIELDS)}]) AS s FROM lg)
    SELECT s.name AS field, CAST(count(*) AS BIGINT) AS total, CAST(count(nullif(s.v, '')) AS BIGINT) AS filled, arg_min(s.v, snap_id * 1000000 + phase_no * 1000 + ligne_no) FILTER (WHERE s.v <> '') AS sample FROM f GROUP BY ALL""")
def schema_profile(spark, d):
    """Per line field: how many lines, how many with a value, and the first value."""
    f = lines_of(spark, d).select("snap_id", "phase_no", "ligne_no", F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(x).alias("v")) for x in _FIELDS])).alias("s")).select("*", "s.*")
    return f.groupBy("field").agg(F.count(F.lit(1)).alias("total"), F.count(F.nullif("v", F.lit(""))).alias("filled"), F.min_by("v", F.when(F.col("v") != "", F.struct("snap_id", "phase_no", "ligne_no"))).alias("sample"))


_KEYS = "k AS (SELECT DISTINCT canonical.acteur AS uid FROM thread_nodes WHERE canonical.acteur IS NOT NULL)"


@query(f"WITH {_KEYS} SELECT uid, civ, prenom, nom FROM acteurs a WHERE EXISTS (SELECT 1 FROM k WHERE k.uid = a.uid)")
def keyed_semi_join(spark, d):
    """Reference rows that were asked for."""
    k = table(spark, d, "thread_nodes").select(F.col("canonical.acteur").alias("uid")).where("uid is not null")
    return table(spark, d, "acteurs").join(k, "uid", "left_semi").select("uid", "civ", "prenom", "nom")


@query(f"WITH {_LINES} SELECT bibard, doc_id FROM documents d WHERE bibard IN (SELECT trim(texte_bibard) FROM lg WHERE texte_bibard <> '') AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY bibard ORDER BY doc_id DESC) = 1")
def documents_by_key(spark, d):
    """Of the documents of each bill on the agenda the last one that has a source."""
    k = lines_of(spark, d, "texte_bibard").where("texte_bibard <> ''").select(F.trim("texte_bibard").alias("bibard")).distinct()
    return table(spark, d, "documents").where("source is not null").join(k, "bibard", "left_semi").groupBy("bibard").agg(F.max("doc_id").alias("doc_id"))


@query(f"WITH {_LINES}, k AS (SELECT DISTINCT 'PA' || trim(depute_tribun_id) AS uid FROM lg WHERE trim(depute_tribun_id) <> '') SELECT CAST(count(*) AS BIGINT) AS asked, CAST(count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM acteurs a WHERE a.uid = k.uid)) AS BIGINT) AS unresolved FROM k")
def unresolved_keys(spark, d):
    k = durable(lines_of(spark, d, "depute_tribun_id").where("trim(depute_tribun_id) <> ''").select(F.concat(F.lit("PA"), F.trim("depute_tribun_id")).alias("uid")).distinct(), "keys")
    a = table(spark, d, "acteurs").select("uid", F.lit(1).alias("found")).distinct()
    return k.join(a, "uid", "left").agg(F.count(F.lit(1)).alias("asked"), F.count_if(F.col("found").isNull()).alias("unresolved"))


@query("SELECT uid AS ref, coalesce(nullif(libelle_abrege, ''), libelle) AS name, libelle, code_type FROM organes")
def referential_slice(spark, d):
    return table(spark, d, "organes").select(F.col("uid").alias("ref"), F.coalesce(blank("libelle_abrege"), F.col("libelle")).alias("name"), "libelle", "code_type")


@query(f"""WITH {_LINES} SELECT snap_id, phase_no, ligne_no, '{{"amendements":[{{"numero":"' || CAST(num AS VARCHAR) || '","bibard":"' || trim(coalesce(texte_bibard, '')) || '","legislature":"17"}}]}}' AS body FROM ({_ADT}) q""")
def reshape_json(spark, d):
    """Lines rebuilt in the shape of the detail interface."""
    a = amendments(lines_of(spark, d, "ligne_type", "ligne_amendement_uid", "texte_bibard"))
    item = F.struct(F.col("num").cast("string").alias("numero"), F.trim(F.coalesce("texte_bibard", F.lit(""))).alias("bibard"), F.lit("17").alias("legislature"))
    return a.select("snap_id", "phase_no", "ligne_no", F.to_json(F.struct(F.array(item).alias("amendements"))).alias("body"))


@query(f"""WITH {_LINES} SELECT DISTINCT snap_id, j ->> '$.racine.jaune.id' AS jaune_id, j ->> '$.racine.jaune.jaune_date_time' AS at, json_type(j, '$.racine.contenu') AS shape FROM j1 WHERE json_type(j) = 'OBJECT'""")
def pointer_summary(spark, d):
    """Head fields of every snapshot, with what stands under contenu; damaged bodies give no row."""
    from filament.operators.shredding import documents, entity, shred

    adj = shred(documents(table(spark, d, "derouleur"), "snap_id", "body"), "doc", "body", ["id", "jaune_date_time", "contenu"])
    adj = durable(adj.where("path in ('', 'racine', 'racine.jaune', 'racine.contenu', 'racine.jaune.id', 'racine.jaune.jaune_date_time')"), "heads")
    head = entity(adj, "racine.jaune", ["id", "jaune_date_time"]).select("key", F.col("id").alias("jaune_id"), F.col("jaune_date_time").alias("at"))
    kinds = F.create_map(F.lit("object"), F.lit("OBJECT"), F.lit("scalar"), F.lit("VARCHAR"), F.lit("null"), F.lit("NULL"))
    shape = adj.where("path = 'racine.contenu'").select("key", kinds[F.col("kind")].alias("shape"))
    roots = adj.where("path = '' and kind = 'object'").select("key")
    return roots.join(head, "key", "left").join(shape, "key", "left").select("key.snap_id", "jaune_id", "at", "shape").distinct()


@query(f"WITH {_TICKS} SELECT sitting_uid, coalesce(bool_or(raw_ref['liveplayer'] <> ''), false) AS current, CAST(count(*) AS BIGINT) AS ticks FROM ticks GROUP BY sitting_uid HAVING bool_or(coalesce(raw_ref['derouleur'] <> '', false)) AND bool_or(coalesce(raw_ref['nvs'] <> '', false))")
def catalog_filter(spark, d):
    """Recorded sittings that have both an agenda and a chapter tree."""
    k = ticks_of(spark, d).groupBy("sitting_uid").agg(F.bool_or(F.col("derouleur").isNotNull()).alias("a"), F.bool_or(F.col("nvs").isNotNull()).alias("b"), F.max(F.when(F.col("liveplayer").isNotNull(), True)).alias("c"), F.count(F.lit(1)).alias("ticks"))
    return k.where("a and b").select("sitting_uid", F.coalesce("c", F.lit(False)).alias("current"), "ticks")


@query(f"WITH {_LINES}, c AS (SELECT sitting_uid, snap_id, phase_no, ligne_no, id, ligne_video_highlighted = 'true' AS live FROM lg WHERE id IS NOT NULL) SELECT sitting_uid, arg_min(id, snap_id * 1000000 + phase_no * 1000 + ligne_no) AS first_live FROM c WHERE live GROUP BY sitting_uid")
def first_live_candidate(spark, d):
    """The first line of a sitting that was on air."""
    return lines_of(spark, d, "id", "ligne_video_highlighted").where("id is not null and ligne_video_highlighted = 'true'").groupBy("sitting_uid").agg(F.min_by("id", F.struct("snap_id", "phase_no", "ligne_no")).alias("first_live"))


@query(f"WITH {_TICKS} SELECT sitting_uid, coalesce(arg_max(raw_ref['liveplayer'], tick_id) FILTER (WHERE raw_ref['liveplayer'] <> ''), arg_max(raw_ref['nvs'], tick_id) FILTER (WHERE raw_ref['nvs'] <> '')) AS source FROM ticks GROUP BY sitting_uid")
def fallback_source(spark, d):
    """The last reference of the preferred source, else of the other."""
    return ticks_of(spark, d).groupBy("sitting_uid").agg(F.coalesce(F.max_by("liveplayer", F.when(F.col("liveplayer").isNotNull(), F.col("tick_id"))), F.max_by("nvs", F.when(F.col("nvs").isNotNull(), F.col("tick_id")))).alias("source"))


__all__ = ["QUERIES", "SQL", "agenda_of", "amendments", "lines_of", "tables_of"]
