"""Queries over the event log: two-pass weaving, supersession, causality, change detection."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filament.functions import text as T
from filament.operators.changefeed import standing
from filament.operators.ranges import scan
from filament.operators.shredding import loads
from filament.plans import registry
from filament.runtime import new_path, table

#: Parameters of the queries.
SEEK_MS, GATE_MS, GRACE_S, WINDOW, OVERLAP, LIMIT_TARGETS = 1_800_000, 3_600_000, 60, 20, 2, 100
SOURCES = ["derouleur", "nvs", "liveplayer", "eliasse"]

_EV = "ev AS (SELECT DISTINCT sitting_uid, ord, type, beg, text FROM segments WHERE ord IS NOT NULL AND beg IS NOT NULL)"
QUERIES, SQL, query = registry()


def events_of(spark: SparkSession, d: str) -> DataFrame:
    """Speech events of ``segments``, each once: (sitting_uid, ord, type, beg, text)."""
    return table(spark, d, "segments").where("ord is not null and beg is not null").select("sitting_uid", "ord", "type", "beg", "text").distinct()


def weave(events: DataFrame) -> DataFrame:
    """Log nodes of speech events in order: an event takes the place of the one before if that was an interim."""
    s = scan(events, ["sitting_uid"], ["ord"], lag={"_before": F.col("type")}, total={"seq": F.lit(1)})
    return s.select(
        "sitting_uid", "seq", (F.col("beg") * 1000).cast("bigint").alias("t"), F.lit("utterance").alias("kind"),
        F.when(F.col("type") == "interim", "provisional").otherwise("consolidated").alias("state"), "text", F.lit("stt").alias("source"),
        F.when(F.col("_before") == "interim", F.col("seq") - 1).alias("supersedes"),
    )


@query(f"""WITH {_EV} SELECT sitting_uid, CAST(row_number() OVER w - 1 AS BIGINT) AS seq, CAST(trunc(beg * 1000) AS BIGINT) AS t, 'utterance' AS kind,
    CASE WHEN type = 'interim' THEN 'provisional' ELSE 'consolidated' END AS state, text, 'stt' AS source,
    CASE WHEN lag(type) OVER w = 'interim' THEN CAST(row_number() OVER w - 2 AS BIGINT) END AS supersedes FROM ev WINDOW w AS (PARTITION BY sitting_uid ORDER BY ord)""")
def two_pass_thread(spark, d):
    return weave(events_of(spark, d))


@query(f"""WITH {_EV}, i AS (SELECT sitting_uid, ord, text, lag(text) OVER (PARTITION BY sitting_uid ORDER BY ord) AS b FROM ev WHERE type = 'interim' AND text IS NOT NULL)
    SELECT sitting_uid, ord, text FROM i WHERE b IS NULL OR b <> text""")
def interim_distinct(spark, d):
    """Interims that differ from the interim before."""
    i = events_of(spark, d).where("type = 'interim' and text is not null").drop("beg", "type")
    return scan(i, ["sitting_uid"], ["ord"], lag={"b": F.col("text")}).where("b is null or b <> text").select("sitting_uid", "ord", "text")


# The SQL of the text rules is made of the same fixed patterns as the columns.
_NUMS = f"CASE WHEN regexp_matches(text, '{T.sql_text(T.TRIGGER)}') THEN list_distinct(list_transform(list_filter(regexp_extract_all(text, '{T.NUMBER}', 1), lambda x: NOT list_contains(regexp_extract_all(text, '{T.ARTICLE}', 1), x)), lambda x: CAST(x AS INTEGER))) ELSE [] END"
_BALLOT = "CASE " + " ".join(f"WHEN regexp_matches(text, '{T.sql_text(p)}') THEN '{n}'" for n, p in (("open", T.BALLOT_OPEN), ("rejected", T.BALLOT_REJECTED), ("adopted", T.BALLOT_ADOPTED), ("vote", T.BALLOT_VOTE))) + " END"


@query("SELECT sitting_uid, CAST(max(seq) + 1 AS BIGINT) AS next_seq FROM thread_nodes GROUP BY sitting_uid")
def seq_resume(spark, d):
    return table(spark, d, "thread_nodes").groupBy("sitting_uid").agg((F.max("seq") + 1).alias("next_seq"))


@query("""WITH n AS (SELECT DISTINCT sitting_uid, seq FROM thread_nodes), s AS (SELECT DISTINCT sitting_uid, x FROM (SELECT sitting_uid, seq, unnest(supersedes) AS x FROM thread_nodes) q WHERE x IS NOT NULL AND x <> seq)
    SELECT n.sitting_uid, n.seq FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.sitting_uid = n.sitting_uid AND s.x = n.seq)""")
def thread_current(spark, d):
    """Nodes that no other node names directly."""
    n = table(spark, d, "thread_nodes").select("sitting_uid", "seq", "supersedes")
    named = n.select("sitting_uid", F.col("seq").alias("by"), F.explode("supersedes").alias("seq")).where("seq is not null and seq <> by").select("sitting_uid", "seq").distinct()
    return n.select("sitting_uid", "seq").distinct().join(named, ["sitting_uid", "seq"], "left_anti")


# SQL: the record of every node, spread along the naming links until nothing changes: (sitting_uid, node, top, place).
RECORDS = """n AS (SELECT sitting_uid, seq, bool_or(regexp_replace(lower(state), '\\s+', '', 'g') = 'retracted') AS gone FROM thread_nodes GROUP BY ALL),
    e AS (SELECT DISTINCT q.sitting_uid, q.seq AS a, q.x AS b FROM (SELECT sitting_uid, seq, unnest(supersedes) AS x FROM thread_nodes) q JOIN n ON n.sitting_uid = q.sitting_uid AND n.seq = q.x WHERE q.x < q.seq),
    g AS (SELECT sitting_uid, a, b FROM e UNION ALL SELECT sitting_uid, b, a FROM e),
    r AS (SELECT sitting_uid, seq AS top, seq AS node FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.sitting_uid = n.sitting_uid AND e.b = n.seq) UNION SELECT r.sitting_uid, r.top, g.b FROM r JOIN g ON g.sitting_uid = r.sitting_uid AND g.a = r.node),
    m AS (SELECT sitting_uid, node, max(top) AS top FROM r GROUP BY ALL), rec AS (SELECT sitting_uid, top, min(node) AS place FROM m GROUP BY ALL)"""


@query(f"WITH RECURSIVE {RECORDS} SELECT n.sitting_uid, rec.place, n.seq FROM n JOIN rec ON rec.sitting_uid = n.sitting_uid AND rec.top = n.seq WHERE NOT n.gone")
def thread_view(spark, d):
    """What a reader of the log sees: every record that stands, at the place of the first node that it took over."""
    return standing(table(spark, d, "thread_nodes"), new_path(spark, "view"), batches=1).select("sitting_uid", F.col("record").alias("place"), "seq")


@query(f"SELECT sitting_uid, kind, CAST(count(DISTINCT seq) AS BIGINT) AS n FROM thread_nodes WHERE t <= {SEEK_MS} GROUP BY ALL")
def seek_purge(spark, d):
    """What is left of each sitting after a seek back to half an hour."""
    kept = table(spark, d, "thread_nodes").where(F.col("t") <= SEEK_MS).select("sitting_uid", "kind", "seq").distinct()
    return kept.groupBy("sitting_uid", "kind").agg(F.count("seq").alias("n"))


@query(f"""WITH {_EV}, t AS (SELECT *, CAST(count(*) FILTER (WHERE type = 'utterance') OVER (PARTITION BY sitting_uid ORDER BY ord) AS BIGINT) AS k FROM ev)
    SELECT sitting_uid, ord, type FROM t WHERE k <= {LIMIT_TARGETS} AND NOT (k = {LIMIT_TARGETS} AND type <> 'utterance')""")
def limit_targets(spark, d):
    """A sitting's events up to its 100th utterance: the limit counts targets only, and is the feature."""
    target = F.col("type") == "utterance"
    s = scan(events_of(spark, d), ["sitting_uid"], ["ord"], total={"k": target.cast("int")})
    return s.where((F.col("k") < LIMIT_TARGETS)).select("sitting_uid", "ord", "type")


def count_windows_of(events: DataFrame, size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` utterances with the last ``overlap`` of the window before as context."""
    u = events.where("type = 'utterance' and text is not null").select("sitting_uid", "ord", "text")
    s = scan(u, ["sitting_uid"], ["ord"], total={"k": F.lit(1)}).withColumn("win", F.floor(F.col("k") / size).cast("bigint"))
    w = s.groupBy("sitting_uid", "win").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("targets"))  # at most ``size`` rows a window
    before = w.select("sitting_uid", (F.col("win") + 1).alias("win"), F.transform(F.slice("targets", F.greatest(F.size("targets") - overlap + 1, F.lit(1)), overlap), lambda x: x["text"]).alias("context"))
    return w.join(before, ["sitting_uid", "win"], "left")


@query(f"""WITH {_EV}, u AS (SELECT sitting_uid, ord, text, (row_number() OVER (PARTITION BY sitting_uid ORDER BY ord) - 1) // {WINDOW} AS win FROM ev WHERE type = 'utterance' AND text IS NOT NULL),
    w AS (SELECT sitting_uid, win, count(*) AS n, min(ord) AS first_ord, max(ord) AS last_ord, string_agg(text, ' ' ORDER BY ord) AS text, list(text ORDER BY ord) AS l FROM u GROUP BY ALL)
    SELECT w.sitting_uid, CAST(w.win AS BIGINT) AS win, CAST(w.n AS BIGINT) AS n, w.first_ord, w.last_ord, w.text, coalesce(array_to_string(list_slice(b.l, -{OVERLAP}, -1), ' '), '') AS context
    FROM w LEFT JOIN w b ON b.sitting_uid = w.sitting_uid AND b.win = w.win - 1""")
def count_windows(spark, d):
    w = count_windows_of(events_of(spark, d))
    return w.select("sitting_uid", "win", F.size("targets").cast("bigint").alias("n"), F.col("targets")[0]["ord"].alias("first_ord"), F.element_at("targets", -1)["ord"].alias("last_ord"), F.array_join("targets.text", " ").alias("text"), F.coalesce(F.array_join("context", " "), F.lit("")).alias("context"))


@query("""WITH n AS (SELECT sitting_uid, seq, any_value(t) AS t FROM thread_nodes GROUP BY ALL), m AS (SELECT DISTINCT sitting_uid, seq, unnest(supersedes) AS x FROM thread_nodes WHERE source = 'llm')
    SELECT m.sitting_uid, m.seq, CAST(min(n.t) AS BIGINT) AS t, CAST(count(*) AS BIGINT) AS covered FROM m JOIN n ON n.sitting_uid = m.sitting_uid AND n.seq = m.x GROUP BY ALL""")
def merge_nodes(spark, d):
    """Corrections start with the earliest node they cover."""
    n = table(spark, d, "thread_nodes")
    m = n.where("source = 'llm'").select("sitting_uid", "seq", F.explode("supersedes").alias("x")).distinct()
    t = n.groupBy("sitting_uid", F.col("seq").alias("x")).agg(F.min("t").alias("t"))
    return m.join(t, ["sitting_uid", "x"]).groupBy("sitting_uid", "seq").agg(F.min("t").alias("t"), F.count(F.lit(1)).alias("covered"))


@query("""SELECT DISTINCT 'data: {"seq":' || seq || ',"t":' || t || ',"kind":' || to_json(kind) || ',"text":' || to_json(text) || '}' || chr(10) || chr(10) AS frame FROM thread_nodes WHERE kind IS NOT NULL AND text IS NOT NULL AND t IS NOT NULL""")
def sse_frames(spark, d):
    n = table(spark, d, "thread_nodes").where("kind is not null and text is not null and t is not null").select("seq", "t", "kind", "text")
    return n.select(T.sse_frame(F.to_json(F.struct("seq", "t", "kind", "text"))).alias("frame")).distinct()


@query("SELECT DISTINCT sitting_uid, seq, t, kind, text, supersedes, canonical.acteur AS acteur FROM thread_nodes")
def ndjson_roundtrip(spark, d):
    """The log written as NDJSON, absent for null, and read back with its schema."""
    n = table(spark, d, "thread_nodes").select("sitting_uid", "seq", "t", "kind", "text", "supersedes", "canonical").withColumn("canonical", F.struct(F.col("canonical.acteur").alias("acteur")))
    path = new_path(spark, "ndjson")
    n.write.json(path)
    return spark.read.schema(n.schema).json(path).select("sitting_uid", "seq", "t", "kind", "text", "supersedes", F.col("canonical.acteur").alias("acteur")).distinct()


# Causality

_TICKS = "ticks AS (SELECT tick_id, any_value(k.sitting_uid) AS sitting_uid, any_value(received_at) AS received_at, any_value(raw_ref) AS raw_ref, any_value(starttime) AS starttime FROM capture_ticks k JOIN sittings s ON s.sitting_uid = k.sitting_uid GROUP BY tick_id)"


def ticks_of(spark: SparkSession, d: str) -> DataFrame:
    """Ticks, each once, with their sitting's start: (tick_id, sitting_uid, rel_ms, raw_ref)."""
    k = table(spark, d, "capture_ticks").where("tick_id is not null").select("tick_id", "sitting_uid", "received_at", *[F.nullif(F.col("raw_ref")[s], F.lit("")).alias(s) for s in SOURCES]).distinct()
    s = table(spark, d, "sittings").select("sitting_uid", "starttime")
    return k.join(s, "sitting_uid").withColumn("rel_ms", F.unix_millis("received_at") - F.col("starttime") * 1000)


@query(f"WITH {_TICKS} SELECT sitting_uid, CAST(count(*) AS BIGINT) AS visible FROM ticks WHERE epoch_ms(received_at) <= starttime * 1000 + {GATE_MS} GROUP BY ALL")
def causal_gate(spark, d):
    """Ticks a viewer may see one hour in: those received by then, inclusive."""
    return ticks_of(spark, d).where(F.col("rel_ms") <= GATE_MS).groupBy("sitting_uid").agg(F.count(F.lit(1)).alias("visible"))


@query(f"WITH {_TICKS} SELECT sitting_uid, arg_max(raw_ref['derouleur'], tick_id) AS ref FROM ticks WHERE epoch_ms(received_at) <= starttime * 1000 + {GATE_MS} AND raw_ref['derouleur'] <> '' GROUP BY ALL")
def current_ref(spark, d):
    """The last listed reference among the visible ticks that have one."""
    return ticks_of(spark, d).where((F.col("rel_ms") <= GATE_MS) & F.col("derouleur").isNotNull()).groupBy("sitting_uid").agg(F.max_by("derouleur", "tick_id").alias("ref"))


_PROBES = [900_000, 1_800_000, 3_600_000, 7_200_000]


@query(f"""WITH {_TICKS}, r AS (SELECT sitting_uid, tick_id, epoch_ms(received_at) - starttime * 1000 AS rel, src, raw_ref[src] AS ref FROM ticks, (SELECT unnest({SOURCES}) AS src)),
    p AS (SELECT unnest({_PROBES}) AS t_ms) SELECT sitting_uid, src, CAST(t_ms AS BIGINT) AS t_ms, arg_max(ref, tick_id) AS ref FROM r JOIN p ON rel <= t_ms WHERE ref <> '' GROUP BY ALL""")
def current_ref_multi(spark, d):
    """The same for several probe times and every source, in one pass of the ticks."""
    k = ticks_of(spark, d)
    long = k.select("sitting_uid", "tick_id", "rel_ms", F.explode(F.array(*[F.struct(F.lit(s).alias("src"), F.col(s).alias("ref")) for s in SOURCES])).alias("x")).select("sitting_uid", "tick_id", "rel_ms", "x.*").where("ref is not null")
    agg = long.groupBy("sitting_uid", "src").agg(*[F.max_by("ref", F.when(F.col("rel_ms") <= p, F.col("tick_id"))).alias(str(p)) for p in _PROBES])
    return agg.select("sitting_uid", "src", F.explode(F.array(*[F.struct(F.lit(p).cast("bigint").alias("t_ms"), F.col(str(p)).alias("ref")) for p in _PROBES])).alias("x")).select("sitting_uid", "src", "x.*").where("ref is not null")


@query(f"WITH {_TICKS} SELECT tick_id, starttime * 1000 + (epoch_ms(received_at) - starttime * 1000) AS wall_ms, strftime(timezone('Europe/Paris', received_at), '%Y-%m-%d %H:%M:%S') AS paris FROM ticks")
def broadcast_wall(spark, d):
    """Origin plus t, and as the clock on the wall shows it."""
    k = ticks_of(spark, d)
    wall = F.col("starttime") * 1000 + F.col("rel_ms")
    return k.select("tick_id", wall.alias("wall_ms"), F.date_format(F.from_utc_timestamp(F.timestamp_millis(wall), "Europe/Paris"), "yyyy-MM-dd HH:mm:ss").alias("paris"))


_NAIVE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}\z"
_STAMP = r"^20[0-9]{12}\z"


def _pin(x: str) -> str:
    """SQL: a civil time of Paris as an instant; where it occurs twice the first, where it is skipped by the offset before."""
    return f"CASE WHEN timezone('Europe/Paris', timezone('Europe/Paris', {x}) - INTERVAL 1 HOUR) = {x} THEN timezone('Europe/Paris', {x}) - INTERVAL 1 HOUR ELSE timezone('Europe/Paris', {x}) END"


@query(f"""WITH w AS (SELECT DISTINCT tick_id, try_strptime(wall, '%Y-%m-%dT%H:%M:%S.%g') AS x FROM capture_ticks WHERE regexp_matches(wall, '{_NAIVE}')) SELECT tick_id, epoch_ms({_pin("x")}) AS wall_ms FROM w WHERE x IS NOT NULL""")
def paris_pin(spark, d):
    """Naive stamps are Paris time, whatever the session's zone; those of no real day are left out."""
    k = table(spark, d, "capture_ticks").where(F.col("wall").rlike(_NAIVE))
    return k.select("tick_id", F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp("wall", F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), "Europe/Paris")).alias("wall_ms")).where("wall_ms is not null").distinct()


@query(f"""WITH w AS (SELECT DISTINCT tick_id, try_strptime(wall, '%Y%m%d%H%M%S') AS x FROM capture_ticks WHERE regexp_matches(wall, '{_STAMP}')) SELECT tick_id, CAST(epoch_ms({_pin("x")}) // 1000 AS BIGINT) AS origin FROM w WHERE x IS NOT NULL""")
def origin_stamp(spark, d):
    """The epoch second of a 14-digit stamp, pinned to Paris; stamps of no real time are left out."""
    k = table(spark, d, "capture_ticks").where(F.col("wall").rlike(_STAMP))
    return k.select("tick_id", F.unix_seconds(F.to_utc_timestamp(F.try_to_timestamp("wall", F.lit("yyyyMMddHHmmss")), "Europe/Paris")).alias("origin")).where("origin is not null").distinct()


@query("""WITH k AS (SELECT DISTINCT tick_id, sitting_uid, changed FROM capture_ticks WHERE tick_id IS NOT NULL), s AS (SELECT sitting_uid, unnest(map_entries(changed)) AS e FROM k) SELECT sitting_uid, e.key AS source, CAST(count(*) AS BIGINT) AS polled, CAST(count(*) FILTER (WHERE e.value) AS BIGINT) AS saved FROM s GROUP BY ALL""")
def saved_counters(spark, d):
    """Per sitting and source how often it was polled, and how often a snapshot was saved."""
    k = table(spark, d, "capture_ticks").where("tick_id is not null").select("tick_id", "sitting_uid", F.array_sort(F.map_entries("changed")).alias("c")).distinct()
    s = k.select("sitting_uid", F.explode("c").alias("e"))
    return s.groupBy("sitting_uid", F.col("e.key").alias("source")).agg(F.count(F.lit(1)).alias("polled"), F.count_if("e.value").alias("saved"))


@query("""WITH k AS (SELECT tick_id, any_value(sitting_uid) AS sitting_uid, any_value(t) AS t FROM capture_ticks WHERE tick_id IS NOT NULL GROUP BY tick_id) SELECT s.sitting_uid, s.starttime, CAST(count(k.tick_id) AS BIGINT) AS n_synchro, arg_max(k.t, k.tick_id) AS last_timecode_ms, max(k.tick_id) FILTER (WHERE k.t IS NOT NULL) AS last_id
    FROM sittings s LEFT JOIN k ON k.sitting_uid = s.sitting_uid GROUP BY s.sitting_uid, s.starttime""")
def sync_summary(spark, d):
    """Per sitting its start, its number of ticks, and the last one that has a time."""
    k = table(spark, d, "capture_ticks").where("tick_id is not null").select("tick_id", "sitting_uid", "t").distinct()
    timed = F.when(F.col("t").isNotNull(), F.col("tick_id"))
    a = k.groupBy("sitting_uid").agg(F.count(F.lit(1)).alias("n"), F.max_by("t", timed).alias("last_timecode_ms"), F.max(timed).alias("last_id"))
    return table(spark, d, "sittings").select("sitting_uid", "starttime").join(a, "sitting_uid", "left").select("sitting_uid", "starttime", F.coalesce("n", F.lit(0)).alias("n_synchro"), "last_timecode_ms", "last_id")


@query("""WITH a AS (SELECT sitting_uid, max(beg) - min(beg) AS audio FROM segments WHERE beg IS NOT NULL GROUP BY ALL), w AS (SELECT sitting_uid, (epoch_ms(max(received_at)) - epoch_ms(min(received_at))) / 1000 AS wall FROM capture_ticks WHERE received_at IS NOT NULL GROUP BY ALL)
    SELECT a.sitting_uid, round(wall / audio, 6) AS factor FROM a JOIN w ON w.sitting_uid = a.sitting_uid WHERE audio > 0""")
def real_time_factor(spark, d):
    """Wall seconds a second of audio, per sitting."""
    a = table(spark, d, "segments").groupBy("sitting_uid").agg((F.max("beg") - F.min("beg")).alias("audio")).where("audio > 0")
    w = table(spark, d, "capture_ticks").groupBy("sitting_uid").agg(((F.unix_millis(F.max("received_at")) - F.unix_millis(F.min("received_at"))) / 1000).alias("wall")).where("wall is not null")
    return a.join(w, "sitting_uid").select("sitting_uid", F.round(F.col("wall") / F.col("audio"), 6).alias("factor"))


@query("""WITH r AS (SELECT DISTINCT unnest(map_values(raw_ref)) AS ref FROM capture_ticks), p AS (SELECT '/' || ref AS path FROM r WHERE ref <> '' UNION SELECT '/referential/' || slug || '.json' FROM acteurs UNION SELECT '/ground-truth/' || uid FROM organes UNION SELECT unnest(['/derouleur.json', '/amendement.do', '/prochainADiscuter.do', '/ground-truth/tree', '/ground-truth/timeline', '/thread/x', '/referential/a/b.json']))
    SELECT path, CASE WHEN path = '/derouleur.json' THEN 'derouleur' WHEN path IN ('/amendement.do', '/prochainADiscuter.do') THEN 'eliasse' WHEN path LIKE '/referential/%.json' AND length(path) - length(replace(path, '/', '')) = 2 AND path <> '/referential/.json' THEN 'referential' WHEN path = '/ground-truth/timeline' THEN 'timeline' WHEN path = '/ground-truth/tree' THEN 'tree' WHEN path LIKE '/ground-truth/_%' THEN 'ground-truth' END AS route,
      CAST(CASE WHEN path IN ('/derouleur.json', '/amendement.do', '/prochainADiscuter.do') THEN 1 WHEN path LIKE '/referential/%.json' AND length(path) - length(replace(path, '/', '')) = 2 AND path <> '/referential/.json' OR path LIKE '/ground-truth/_%' THEN 0 END AS BOOLEAN) AS causal FROM p""")
def route_dispatch(spark, d):
    """Where a path leads, and whether it is gated by the clock; no route is a 404."""
    r = table(spark, d, "capture_ticks").select(F.explode(F.map_values("raw_ref")).alias("ref")).where("ref <> ''").select(F.concat(F.lit("/"), "ref").alias("path"))
    fixed = spark.createDataFrame([(x,) for x in ("/derouleur.json", "/amendement.do", "/prochainADiscuter.do", "/ground-truth/tree", "/ground-truth/timeline", "/thread/x", "/referential/a/b.json")], "path string")
    p = r.union(table(spark, d, "acteurs").select(F.concat(F.lit("/referential/"), "slug", F.lit(".json")))).union(table(spark, d, "organes").select(F.concat(F.lit("/ground-truth/"), "uid"))).union(fixed).where("path is not null").distinct()
    return p.withColumn("r", T.route(F.col("path"))).select("path", F.col("r.name").alias("route"), F.col("r.causal").alias("causal"))


# Change detection

_SNAPS = "snaps AS (SELECT snap_id, any_value(sitting_uid) AS sitting_uid, any_value(seen_at) AS seen_at, any_value(body) AS body FROM derouleur GROUP BY snap_id)"
# SQL: the leaves of a document as sorted lines of path and value, without the volatile ones; the text itself if it is none.
_LEAVES = """lf AS (SELECT snap_id, t.fullkey || '=' || (t.atom ->> '$') AS line FROM snaps, json_tree(CASE WHEN json_valid(body) THEN body ELSE 'null' END) t WHERE t.atom IS NOT NULL AND t.type <> 'NULL' AND t.fullkey NOT IN ('$.racine.jaune.extract_date_time', '$.racine.jaune.jaune_date_time')),
    hs AS (SELECT s.snap_id, s.sitting_uid, md5(CASE WHEN json_valid(any_value(s.body)) THEN coalesce(string_agg(l.line, chr(10) ORDER BY l.line), '') ELSE any_value(s.body) END) AS hash FROM snaps s LEFT JOIN lf l ON l.snap_id = s.snap_id GROUP BY ALL)"""


def canonical(body: Column) -> Column:
    """A document as sorted lines of path and value, without its two volatile times; a text that is none as it is."""

    @F.pandas_udf("string")
    def lines(bodies: pd.Series) -> pd.Series:
        return pd.Series([canonical_text(b) for b in bodies], dtype=object)

    return lines(body)


def canonical_text(body: str | None) -> str | None:
    try:
        value = loads(body) if body is not None else None
    except ValueError:
        return body
    if body is None:
        return None
    out, stack = [], [("$", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack.extend((f"{path}.{k}", x) for k, x in v.items())
        elif isinstance(v, list):
            stack.extend((f"{path}[{k}]", x) for k, x in enumerate(v))
        elif v is not None and path not in ("$.racine.jaune.extract_date_time", "$.racine.jaune.jaune_date_time"):
            out.append(f"{path}={v if isinstance(v, str) else json.dumps(v)}")
    return "\n".join(sorted(out))


def snapshots_of(spark: SparkSession, d: str, *columns: Column) -> DataFrame:
    """Snapshots, each once: (snap_id, sitting_uid, *columns)."""
    return table(spark, d, "derouleur").where("snap_id is not null").select("snap_id", "sitting_uid", *columns).distinct()


@query(f"WITH {_SNAPS}, {_LEAVES} SELECT snap_id, hash FROM hs WHERE hash IS NOT NULL")
def canonical_hash(spark, d):
    """The hash of a snapshot without its volatile fields, whatever the order of its keys and its spacing."""
    return snapshots_of(spark, d, F.md5(canonical(F.col("body"))).alias("hash")).where("hash is not null").select("snap_id", "hash")


@query(f"""WITH {_SNAPS}, {_LEAVES},
    c AS (SELECT *, coalesce(hash IS NOT NULL AND hash IS DISTINCT FROM last_value(hash IGNORE NULLS) OVER (PARTITION BY sitting_uid ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS changed FROM hs)
    SELECT sitting_uid, snap_id, changed, last_value(CASE WHEN changed THEN snap_id END IGNORE NULLS) OVER (PARTITION BY sitting_uid ORDER BY snap_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ref FROM c""")
def content_dedup(spark, d):
    """Snapshots that differ from the last good one; the others, failed ones too, repeat its reference."""
    h = snapshots_of(spark, d, F.md5(canonical(F.col("body"))).alias("hash"))
    s = scan(h, ["sitting_uid"], ["snap_id"], last={"was": F.col("hash")})
    s = s.withColumn("changed", F.col("hash").isNotNull() & ~F.col("hash").eqNullSafe(F.col("was"))).drop("was", "hash")
    own = F.when(F.col("changed"), F.col("snap_id"))
    return scan(s, ["sitting_uid"], ["snap_id"], last={"prior": own}).select("sitting_uid", "snap_id", "changed", F.coalesce(own, "prior").alias("ref"))


@query(f"""WITH {_TICKS}, k AS (SELECT sitting_uid, tick_id, nullif(raw_ref['eliasse'], '') AS ref FROM ticks), c AS (SELECT *, lag(ref) OVER (PARTITION BY sitting_uid ORDER BY tick_id) AS was, row_number() OVER (PARTITION BY sitting_uid ORDER BY tick_id) AS rn FROM k)
    SELECT sitting_uid, tick_id, was, ref FROM c WHERE ref IS DISTINCT FROM was""")
def pointer_transitions(spark, d):
    """Ticks at which the pointer differs from the tick before."""
    k = ticks_of(spark, d).select("sitting_uid", "tick_id", F.col("eliasse").alias("ref"))
    return scan(k, ["sitting_uid"], ["tick_id"], lag={"was": F.col("ref")}).where(~F.col("ref").eqNullSafe(F.col("was"))).select("sitting_uid", "tick_id", "was", "ref")


@query(f"""WITH {_SNAPS}, i AS (SELECT snap_id, sitting_uid, regexp_extract_all(coalesce(body, ''), '\\\\?"id\\\\?" *: *\\\\?"([0-9]{{6}})', 1) AS ids FROM snaps),
    p AS (SELECT *, lag(ids) OVER (PARTITION BY sitting_uid ORDER BY snap_id) AS was FROM i) SELECT sitting_uid, snap_id, array_to_string(list_filter(ids, lambda x: NOT list_contains(was, x)), ' ') AS added FROM p WHERE was IS NOT NULL AND len(list_filter(ids, lambda x: NOT list_contains(was, x))) > 0""")
def snapshot_diff(spark, d):
    """Line ids that the snapshot before did not have, in order."""
    i = snapshots_of(spark, d, F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r'\\?"id\\?" *: *\\?"([0-9]{6})'), F.lit(1)).alias("ids"))
    s = scan(i, ["sitting_uid"], ["snap_id"], lag={"was": F.col("ids")})
    return s.select("sitting_uid", "snap_id", F.array_join(F.filter("ids", lambda x: ~F.array_contains("was", x)), " ").alias("added")).where("added <> ''")


@query(f"""WITH i AS (SELECT user_id, ts, event_id, event_type = 'view' AS vod, count(*) FILTER (WHERE event_type <> 'view') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS isle FROM events),
    r AS (SELECT *, min(ts) OVER (PARTITION BY user_id, isle) AS begun FROM i WHERE vod) SELECT user_id, min(ts) AS stop_at FROM r WHERE ts > begun AND epoch_us(ts) - epoch_us(begun) >= {GRACE_S} * 1000000 GROUP BY user_id""")
def auto_stop(spark, d):
    """The first event at which a run of one status has lasted the grace; other statuses reset it."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("event_type") == "view").alias("vod"))
    s = scan(e, ["user_id"], ["ts", "event_id"], total={"isle": (~F.col("vod")).cast("int")}).where("vod")
    begun = s.groupBy("user_id", "isle").agg(F.min("ts").alias("begun"))
    late = s.join(begun, ["user_id", "isle"]).where((F.col("ts") > F.col("begun")) & (F.unix_micros("ts") - F.unix_micros("begun") >= GRACE_S * 1_000_000))
    return late.groupBy("user_id").agg(F.min("ts").alias("stop_at"))


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS w, event_type AS c, CAST(round(value * 1000) AS BIGINT) AS arg, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
    a AS (SELECT *, coalesce(last_value(CASE c WHEN 'view' THEN 1 WHEN 'error' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS playing, lag(w) OVER (PARTITION BY user_id ORDER BY k) AS was FROM e),
    b AS (SELECT *, CASE WHEN playing = 1 THEN w - was ELSE 0 END AS step FROM a),
    r(user_id, event_id, k, t_ms) AS (SELECT user_id, event_id, k, CASE c WHEN 'click' THEN greatest(0, arg) WHEN 'purchase' THEN greatest(0, -arg) ELSE 0 END FROM b WHERE k = 1
      UNION ALL SELECT b.user_id, b.event_id, b.k, CASE b.c WHEN 'click' THEN greatest(0, b.arg) WHEN 'purchase' THEN greatest(0, r.t_ms + b.step - b.arg) ELSE r.t_ms + b.step END FROM r JOIN b ON b.user_id = r.user_id AND b.k = r.k + 1)
    SELECT event_id, CAST(t_ms AS BIGINT) AS t_ms FROM r""".replace("WITH e", "WITH RECURSIVE e"))
def clock_fold(spark, d):
    """The master clock after each command: view plays, error pauses, click seeks, purchase seeks back by its value.

    Time runs while playing and no seek goes below zero. Between two seeks the clock is the running sum
    of its steps above the lowest point that it was lifted from, so sums and peaks give it.
    """
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("w"), F.col("event_type").alias("c"), F.round(F.col("value") * 1000).cast("bigint").alias("arg"))
    order = ["w", "event_id"]
    a = scan(e, ["user_id"], order, lag={"was": F.col("w")}, last={"playing": F.when(F.col("c") == "view", 1).when(F.col("c") == "error", 0)})
    run = F.when(F.col("playing") == 1, F.col("w") - F.col("was")).otherwise(0)
    back = F.col("c") == "purchase"
    a = a.select("user_id", "event_id", "w", "c", "arg", (run - F.when(back, F.col("arg")).otherwise(0)).alias("step"), (F.col("c") == "click").cast("int").alias("seek"))
    b = scan(a, ["user_id"], order, total={"base": F.col("step"), "epoch": F.col("seek")})
    total = F.col("base") + F.col("step")
    # What a row lifts the clock to, less the sum up to there: a seek its target, a seek back zero.
    lift = F.when(F.col("c") == "click", F.greatest(F.lit(0), F.col("arg")) - total).when(back, -total)
    b = b.select("user_id", "event_id", "w", total.alias("total"), lift.alias("lift"), (F.col("epoch") + F.col("seek")).alias("epoch"))
    s = scan(b, ["user_id", "epoch"], order, peak={"high": F.col("lift")})
    start = F.when(F.col("epoch") == 0, 0)  # before any seek the clock starts at zero
    return s.select("event_id", (F.col("total") + F.greatest("high", "lift", start)).alias("t_ms"))


__all__ = ["QUERIES", "SQL", "count_windows_of", "events_of", "query", "snapshots_of", "ticks_of", "weave"]
