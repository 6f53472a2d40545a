"""Queries over trees, intervals and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filament.operators.intervals import overlap_argmax as best_overlap, window_density
from filament.operators.ranges import greedy_gap, scan
from filament.operators.trees import walk
from filament.plans import registry
from filament.runtime import table

QUERIES, SQL, query = registry()

SILENCE, SUSTAIN_S, DENSITY, COOLDOWN_S, BOUNDARY_WINDOW_S, MIN_TURN_S = 0.2, 60.0, 0.5, 3.0, 600.0, 1.0

_TREE = """tree AS (SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent, CAST(r_regionkey AS BIGINT) AS ord, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_custkey, c_name FROM customer),
    w AS (SELECT id, parent, 0 AS depth, [ord] AS path, [id] AS chain FROM tree WHERE parent IS NULL UNION ALL SELECT t.id, t.parent, w.depth + 1, list_append(w.path, t.ord), list_append(w.chain, t.id) FROM tree t JOIN w ON t.parent = w.id)"""


def chapters(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree of chapters."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_regionkey").alias("ord"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_nationkey")
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_custkey")
    return r.union(n).union(c)


@query(f"WITH RECURSIVE {_TREE} SELECT id, parent, CAST(depth AS INTEGER) AS depth, array_to_string(path, '.') AS path FROM w")
def chapter_tree(spark, d):
    return walk(chapters(spark, d)).select("id", "parent", "depth", F.array_join("path", ".").alias("path"))


@query(f"WITH RECURSIVE {_TREE} SELECT id, array_to_string(list_slice(chain, 1, -2), ' > ') AS ancestors FROM w WHERE depth = 2")
def ancestor_chain(spark, d):
    """The ancestors of every leaf, from the root down."""
    return walk(chapters(spark, d)).where("depth = 2").select("id", F.array_join(F.slice("chain", 1, F.size("chain") - 1), " > ").alias("ancestors"))


@query("""SELECT r_name AS region, CAST(count(DISTINCT n_nationkey) AS BIGINT) AS chapters, CAST(count(DISTINCT c_custkey) AS BIGINT) AS leaves, arg_max(c_name, c_custkey) AS last_leaf FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name""")
def tree_summary(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("c_custkey", "c_name")).alias("m"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("region")).agg(F.count(F.lit(1)).alias("chapters"), F.sum("k").alias("leaves"), F.max("m").alias("m")).select("region", "chapters", "leaves", F.col("m.c_name").alias("last_leaf"))


@query(f"WITH RECURSIVE {_TREE}, t AS (SELECT 'n' || s_nationkey AS id, arg_max(CAST(round(s_acctbal * 100) AS BIGINT), s_suppkey) AS t_ms FROM supplier GROUP BY ALL) SELECT w.id, array_to_string(w.path, '.') AS path, t.t_ms FROM w LEFT JOIN t ON t.id = w.id")
def chapter_times(spark, d):
    """Every chapter with its place in the tree and the time of its last synchro, null where it has none."""
    last = table(spark, d, "supplier").groupBy(F.concat(F.lit("n"), "s_nationkey").alias("id")).agg(F.max_by(F.round(F.col("s_acctbal") * 100).cast("bigint"), "s_suppkey").alias("t_ms"))
    return walk(chapters(spark, d)).select("id", F.array_join("path", ".").alias("path")).join(last, "id", "left")


@query("SELECT n_nationkey AS chapter, n_name AS label, nullif(r_name, '') AS speaker, s_suppkey AS synchro, CAST(round(s_acctbal * 100) AS BIGINT) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def timeline_join(spark, d):
    """One row per synchro with its chapter and that chapter's speaker; a consumer orders by (t, synchro)."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_nationkey").alias("chapter"), F.col("n_name").alias("label"), F.nullif("r_name", F.lit("")).alias("speaker"), F.col("s_suppkey").alias("synchro"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("t"))


@query(f"SELECT vec_id, CAST(CASE WHEN list_max(embedding) < CAST({SILENCE} AS FLOAT) THEN -1 ELSE list_position(embedding, list_max(embedding)) - 1 END AS INTEGER) AS dominant FROM embeddings")
def dominant_frame(spark, d):
    """The first largest entry of each vector, -1 below the silence level."""
    e = table(spark, d, "embeddings")
    top = F.array_max("embedding")
    return e.select("vec_id", F.when(top < F.lit(SILENCE).cast("float"), F.lit(-1)).otherwise((F.array_position("embedding", top) - 1).cast("int")).alias("dominant"))


_SEG = f"s AS (SELECT seg_id, any_value(sitting_uid) AS sitting_uid, any_value(speaker) AS speaker, any_value(beg) AS beg, any_value(\"end\") AS fin FROM segments WHERE type = 'utterance' AND beg IS NOT NULL GROUP BY seg_id)"
_OK = "fin > beg"
#: Diarized pieces: those whose label is a number label in any of its spellings.
_NUM = r"(?i)^\s*(?:speaker|spkr|spk|sp|s|locuteur|locutrice|loc|orateur|intervenant|voix)[\s_.#°n-]*[0-9]+[\s:.]*$"


def pieces(spark: SparkSession, d: str) -> DataFrame:
    """Utterances, each once: (seg_id, sitting_uid, speaker, beg, end)."""
    return table(spark, d, "segments").where("type = 'utterance' and beg is not null").select("seg_id", "sitting_uid", "speaker", "beg", "end").distinct()


def sensible(df: DataFrame) -> DataFrame:
    """Those whose end lies after their begin."""
    return df.where(F.col("end") > F.col("beg"))


@query(f"""WITH {_SEG}, u AS (SELECT * FROM s WHERE {_OK} AND NOT coalesce(regexp_matches(speaker, '{_NUM}'), false)), t AS (SELECT * FROM s WHERE {_OK} AND regexp_matches(speaker, '{_NUM}')),
    j AS (SELECT u.sitting_uid, u.seg_id, t.speaker, t.seg_id AS o, least(u.fin, t.fin) - greatest(u.beg, t.beg) AS ov FROM u JOIN t ON t.sitting_uid = u.sitting_uid AND t.beg < u.fin AND u.beg < t.fin),
    b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY sitting_uid, seg_id ORDER BY ov DESC, o) = 1) SELECT u.sitting_uid, u.seg_id, b.speaker, round(b.ov, 6) AS overlap FROM u LEFT JOIN b ON b.sitting_uid = u.sitting_uid AND b.seg_id = u.seg_id""")
def overlap_argmax(spark, d):
    """For each utterance the diarized piece, one with a number label, that it shares most time with."""
    p = sensible(pieces(spark, d))
    turn = F.coalesce(F.col("speaker").rlike(_NUM), F.lit(False))
    return best_overlap(p.where(~turn), p.where(turn), "sitting_uid", "seg_id", "speaker", "seg_id").withColumn("overlap", F.round("overlap", 6)).select("sitting_uid", "seg_id", "speaker", "overlap")


@query(f"""WITH {_SEG}, u AS (SELECT * FROM s WHERE {_OK}), v AS (SELECT a.sitting_uid, a.seg_id, a.beg, sum(least(b.fin, a.beg + {SUSTAIN_S}) - greatest(b.beg, a.beg)) AS voiced FROM u a JOIN u b ON a.sitting_uid = b.sitting_uid AND b.beg < a.beg + {SUSTAIN_S} AND a.beg < b.fin GROUP BY ALL)
    SELECT sitting_uid, arg_min(beg, seg_id) AS start_s FROM v WHERE round(voiced / {SUSTAIN_S}, 9) >= {DENSITY} GROUP BY sitting_uid""")
def sustained_start(spark, d):
    """Where speech first holds on: the first piece after which half a minute's window is voiced."""
    p = sensible(pieces(spark, d))
    v = window_density(p, "sitting_uid", "seg_id", SUSTAIN_S).where(F.round(F.col("voiced") / SUSTAIN_S, 9) >= DENSITY)
    return v.join(p.select("sitting_uid", "seg_id", "beg"), ["sitting_uid", "seg_id"]).groupBy("sitting_uid").agg(F.min_by("beg", "seg_id").alias("start_s"))


_RUNS = f"""{_SEG}, a AS (SELECT *, coalesce(speaker <> lag(speaker) OVER w, true) AS fresh FROM s WHERE trim(speaker) <> '' WINDOW w AS (PARTITION BY sitting_uid ORDER BY beg, seg_id)),
    c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY sitting_uid ORDER BY beg, seg_id) AS run FROM a), r AS (SELECT sitting_uid, CAST(run AS BIGINT) AS run, any_value(speaker) AS speaker, min(beg) AS first_beg, max(beg) AS last_beg, CAST(count(*) AS BIGINT) AS n FROM c GROUP BY sitting_uid, run)"""


def runs_of(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one label in the order of a sitting; pieces without label, the silence, are passed over."""
    p = pieces(spark, d).where("trim(speaker) <> ''").select("sitting_uid", "seg_id", "speaker", "beg")
    a = scan(p, ["sitting_uid"], ["beg", "seg_id"], lag={"was": F.col("speaker")})
    a = a.withColumn("fresh", (~F.col("speaker").eqNullSafe(F.col("was"))).cast("int")).drop("was")
    c = scan(a, ["sitting_uid"], ["beg", "seg_id"], total={"before": F.col("fresh")}).withColumn("run", F.col("before") + F.col("fresh"))
    return c.groupBy("sitting_uid", "run").agg(F.min("speaker").alias("speaker"), F.min("beg").alias("first_beg"), F.max("beg").alias("last_beg"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RUNS} SELECT * FROM r")
def run_segments(spark, d):
    return runs_of(spark, d)


_BOUND = f"""{_RUNS}, l AS (SELECT *, lag(last_beg) OVER w AS p_last, lag(last_beg - first_beg) OVER w AS p_len FROM r WINDOW w AS (PARTITION BY sitting_uid ORDER BY run)),
    bd AS (SELECT sitting_uid, run, (p_last + first_beg) / 2 AS boundary FROM l WHERE p_len >= {MIN_TURN_S} AND last_beg - first_beg >= {MIN_TURN_S})"""


def boundaries_of(spark: SparkSession, d: str) -> DataFrame:
    """Switches between two runs that both last: the middle of the gap."""
    s = scan(runs_of(spark, d), ["sitting_uid"], ["run"], lag={"p": F.struct("first_beg", "last_beg")})
    long = (F.col("p.last_beg") - F.col("p.first_beg") >= MIN_TURN_S) & (F.col("last_beg") - F.col("first_beg") >= MIN_TURN_S)
    return s.where(long).select("sitting_uid", "run", ((F.col("p.last_beg") + F.col("first_beg")) / 2).alias("boundary"))


@query(f"WITH {_BOUND} SELECT sitting_uid, CAST(floor(boundary / {BOUNDARY_WINDOW_S}) AS BIGINT) AS win, arg_max(boundary, run) AS boundary FROM bd GROUP BY ALL")
def turn_boundary(spark, d):
    """The last switch of each ten-minute window."""
    return boundaries_of(spark, d).groupBy("sitting_uid", F.floor(F.col("boundary") / BOUNDARY_WINDOW_S).cast("bigint").alias("win")).agg(F.max_by("boundary", "run").alias("boundary"))


@query(f"""WITH RECURSIVE {_SEG}, x AS (SELECT DISTINCT sitting_uid, beg FROM s), k AS (SELECT sitting_uid, min(beg) AS beg FROM x GROUP BY sitting_uid UNION ALL SELECT k.sitting_uid, (SELECT min(x.beg) FROM x WHERE x.sitting_uid = k.sitting_uid AND x.beg >= k.beg + {COOLDOWN_S}) FROM k WHERE k.beg IS NOT NULL)
    SELECT sitting_uid, beg FROM k WHERE beg IS NOT NULL""")
def cooldown(spark, d):
    """Begins that come at least the cooldown after the last one let through."""
    return greedy_gap(pieces(spark, d), "sitting_uid", "beg", COOLDOWN_S)
