"""Queries of text rules: numbers, names, calls, ballots, normalisation, replies, resolution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filament.functions import text as T
from filament.functions.resolve import BANDS, THRESHOLD, realign, resolve_names, wer
from filament.operators.deduction import called_names
from filament.operators.ranges import scan
from filament.plans import registry
from filament.plans.thread import _BALLOT, _NUMS, WINDOW, count_windows_of, events_of
from filament.runtime import durable, table

QUERIES, SQL, query = registry()

#: Utterances in one page of the nested projection.
PAGE = 1000
# The hint for a name that is nobody's, and the parts of a prompt.
NO_CANDIDATE = "aucun candidat proche : ne pas corriger, à signaler si un nom de personne est en cause"
PROMPT = "Candidats :\n<<CANDIDATES>>\nIndices :\n<<HINTS>>\nContexte : <<CONTEXT>>\nTexte : <<TARGET>>"

_UTT = "u AS (SELECT DISTINCT sitting_uid, ord, text FROM segments WHERE type = 'utterance' AND text IS NOT NULL AND ord IS NOT NULL AND beg IS NOT NULL)"
_NAME = T.sql_text(T.NAME).removeprefix(r"\b")


def utterances(spark: SparkSession, d: str) -> DataFrame:
    return events_of(spark, d).where("type = 'utterance' and text is not null").select("sitting_uid", "ord", "text").distinct()


@query(f"WITH {_UTT}, n AS (SELECT sitting_uid, ord, {_NUMS} AS l FROM u) SELECT sitting_uid, ord, array_to_string(list_sort(l), ' ') AS numbers FROM n WHERE len(l) > 0")
def amendment_numbers(spark, d):
    u = utterances(spark, d).withColumn("l", T.amendment_numbers(F.col("text"))).where("size(l) > 0")
    return u.select("sitting_uid", "ord", F.array_join(F.array_sort("l"), " ").alias("numbers"))


@query(f"WITH {_UTT}, n AS (SELECT sitting_uid, ord, regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])({_NAME})', 1) AS l FROM u) SELECT sitting_uid, ord, array_to_string(l, '|') AS names FROM n WHERE len(l) > 0")
def speaker_names(spark, d):
    u = utterances(spark, d).withColumn("l", T.speaker_names(F.col("text"))).where("size(l) > 0")
    return u.select("sitting_uid", "ord", F.array_join("l", "|").alias("names"))


@query(f"SELECT doc_id, {_BALLOT} AS event FROM documents WHERE {_BALLOT} IS NOT NULL")
def ballot_events(spark, d):
    return table(spark, d, "documents").select("doc_id", T.ballot_event(F.col("text")).alias("event")).where("event is not null")


# SQL: the names of every utterance in order, each called to speak or only mentioned: nm(sitting_uid, ord, pos, name, call).
NAMES = f"""np AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY sitting_uid ORDER BY ord), '') AS prev, regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])({_NAME})', 1) AS l FROM u),
    na AS (SELECT *, substr(text, 1, instr(text, name) - 1) AS head, substr(text, instr(text, name) + length(name)) AS after FROM (SELECT sitting_uid, ord, text, prev, unnest(l) AS name, generate_subscripts(l, 1) - 1 AS pos FROM np) q),
    nb AS (SELECT *, CASE WHEN trim(head) = '' AND prev <> '' AND NOT regexp_matches(rtrim(prev), '{T.SENTENCE_END}') THEN prev ELSE head END AS before FROM na),
    nm AS (SELECT sitting_uid, ord, CAST(pos AS INTEGER) AS pos, name, CASE WHEN regexp_matches(after, '{T.CALL_AFTER}') THEN 'strong'
      WHEN regexp_matches(before, '{T.CALL_BEFORE}') THEN 'strong' WHEN regexp_matches(before, '{T.AMENDMENT}') THEN 'strong'
      WHEN trim(regexp_extract(before, '([^.!?]*)$', 1)) = '' AND trim(regexp_extract(after, '^([^.!?]*)', 1)) = '' THEN 'weak' ELSE 'none' END AS call FROM nb)"""


@query(f"WITH {_UTT}, {NAMES} SELECT * FROM nm")
def speaker_call(spark, d):
    return called_names(utterances(spark, d))


_NORM = r"trim(regexp_replace(regexp_replace(lower(strip_accents(coalesce({c}, ''))), '[^\p{{L}} \-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT DISTINCT heard, {_NORM.format(c='heard')} AS name FROM thread_nodes WHERE heard IS NOT NULL UNION SELECT nom, {_NORM.format(c='nom')} FROM acteurs")
def normalize_name(spark, d):
    heard = table(spark, d, "thread_nodes").where("heard is not null").select("heard").union(table(spark, d, "acteurs").select("nom")).distinct()
    return heard.select("heard", T.normalize_name(F.col("heard")).alias("name"))


@query(f"SELECT DISTINCT heard, array_to_string(list_filter(string_split({_NORM.format(c='heard')}, ' '), lambda x: x <> '' AND NOT list_contains({T.STOP}, x)), ' ') AS tokens FROM thread_nodes WHERE heard IS NOT NULL")
def name_tokens(spark, d):
    return table(spark, d, "thread_nodes").where("heard is not null").select("heard").distinct().select("heard", F.array_join(T.name_tokens(F.col("heard")), " ").alias("tokens"))


_PLAIN = f"regexp_replace(heard, '{T.CIVILITY}', '')"
_NOISY = rf"regexp_replace(regexp_replace(trim({_PLAIN}), '\s+', ' ', 'g'), '{T.LAST_VOWEL}', '\1')"


@query(f"SELECT DISTINCT heard, {_PLAIN} AS plain, {_NOISY} AS noisy FROM thread_nodes WHERE heard IS NOT NULL")
def noise_variants(spark, d):
    h = table(spark, d, "thread_nodes").where("heard is not null").select("heard").distinct()
    return h.select("heard", T.strip_civility(F.col("heard")).alias("plain"), T.noisy_name(F.col("heard")).alias("noisy"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS x FROM documents), f AS (SELECT doc_id, CASE WHEN starts_with(x, '```') THEN regexp_replace(regexp_replace(x, '^```[^\n]*\n?', ''), '\n?```[^\n]*$', '') ELSE x END AS x FROM t),
    h AS (SELECT doc_id, regexp_split_to_array(x, '(?i)\n\s*NOTES?\s*:\s*\n?') AS p FROM f) SELECT doc_id, md5(regexp_replace(p[1], '^\s+|\s+$', '', 'g')) AS text_md5, CAST(length(regexp_replace(p[1], '^\s+|\s+$', '', 'g')) AS BIGINT) AS n FROM h WHERE regexp_replace(p[1], '^\s+|\s+$', '', 'g') <> ''""")
def parse_reply(spark, d):
    """Texts read as replies: fence and notes taken off, empty ones dropped."""
    r = table(spark, d, "documents").select("doc_id", T.corrected_reply(F.col("text")).alias("r")).where("r is not null")
    return r.select("doc_id", F.md5("r.text").alias("text_md5"), F.length("r.text").cast("bigint").alias("n"))


@query(r"""WITH r AS (SELECT DISTINCT unnest(map_values(raw_ref)) AS ref FROM capture_ticks) SELECT ref, regexp_matches(ref, '^[A-Za-z0-9_][A-Za-z0-9_.-]*$') AND NOT contains(ref, '..') AS safe, regexp_replace(ref, '[^A-Za-z0-9-]', '-', 'g') AS unit,
    regexp_matches(regexp_extract(ref, '[^/]*$'), '^[A-Za-z0-9_][A-Za-z0-9_.-]*$') AS safe_file FROM r WHERE ref IS NOT NULL""")
def safe_name(spark, d):
    r = table(spark, d, "capture_ticks").select(F.explode(F.map_values("raw_ref")).alias("ref")).where("ref is not null").distinct()
    return r.select("ref", T.safe_name(F.col("ref")).alias("safe"), T.unit_name(F.col("ref")).alias("unit"), F.regexp_extract("ref", "[^/]*$", 0).rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$").alias("safe_file"))


@query("SELECT sitting_uid, 'https://video.example/' || salle || '/' || strftime(make_timestamp(starttime * 1000000), '%Y%m%d%H%M%S') || '/master.m3u8' AS url FROM sittings")
def url_template(spark, d):
    s = table(spark, d, "sittings")
    return s.select("sitting_uid", F.format_string("https://video.example/%s/%s/master.m3u8", "salle", F.date_format(F.timestamp_seconds("starttime"), "yyyyMMddHHmmss")).alias("url"))


@query(r"""SELECT DISTINCT p[1] AS label, p[2] AS tribun FROM (SELECT unnest(list_transform(regexp_extract_all(replace(coalesce(body, ''), '\"', '"'), '"ligne_libelle_1" *: *"[^"]*"[^{}]*"depute_tribun_id" *: *"[0-9]+"'),
    lambda x: [regexp_extract(x, '"ligne_libelle_1" *: *"([^"]*)"', 1), regexp_extract(x, '"depute_tribun_id" *: *"([0-9]+)"', 1)])) AS p FROM derouleur) q""")
def pair_extraction(spark, d):
    """Distinct (label, id) pairs that stand together in a body, taken out by pattern."""
    whole = r'"ligne_libelle_1" *: *"[^"]*"[^{}]*"depute_tribun_id" *: *"[0-9]+"'
    body = F.replace(F.coalesce("body", F.lit("")), F.lit('\\"'), F.lit('"'))
    pairs = table(spark, d, "derouleur").select(F.explode(F.regexp_extract_all(body, F.lit(whole), F.lit(0))).alias("x"))
    return pairs.select(F.regexp_extract("x", r'"ligne_libelle_1" *: *"([^"]*)"', 1).alias("label"), F.regexp_extract("x", r'"depute_tribun_id" *: *"([0-9]+)"', 1).alias("tribun")).distinct()


# SQL: the longest common part of two strings, the first of equal ones; what is left of it and right of it is compared in turn.
_LONGEST = "list_max(flatten(list_transform(range(1, least(length(x), length(y)) + 1), lambda k: list_transform(list_filter(range(1, length(x) - k + 2), lambda i: contains(y, substr(x, i, k))), lambda i: {'k': k, 'i': -i}))))"
_LETTERS = "list_sum(list_transform(string_split('abcdefghijklmnopqrstuvwxyz -', ''), lambda c: least(length(q) - length(replace(q, c, '')), length(n) - length(replace(n, c, '')))))"
#: SQL: res(heard, uid, score) of the names in asked(heard), by the ratio, with refusal of near ties.
RESOLVED = f"""ppl AS (SELECT DISTINCT uid, {_NORM.format(c="nom")} AS one, {_NORM.format(c="coalesce(prenom, '') || ' ' || coalesce(nom, '')")} AS more FROM acteurs WHERE uid IS NOT NULL),
    tk AS (SELECT heard, list_filter(string_split({_NORM.format(c="heard")}, ' '), lambda x: x <> '' AND NOT list_contains({T.STOP}, x)) AS l FROM asked),
    qs AS (SELECT heard, array_to_string(l, ' ') AS q, len(l) > 1 AS several FROM tk WHERE len(l) > 0),
    pr AS (SELECT * FROM (SELECT heard, several, uid, q, CASE WHEN several THEN more ELSE one END AS n FROM qs, ppl) z WHERE least(length(q), length(n)) * 2.0 / (length(q) + length(n)) >= 0.66 AND {_LETTERS} * 2.0 / (length(q) + length(n)) >= 0.66),
    rs(heard, uid, x, y) AS (SELECT heard, uid, q, n FROM pr UNION ALL SELECT heard, uid, c.x, c.y FROM (SELECT heard, uid, unnest([{{'x': substr(x, 1, i - 1), 'y': substr(y, 1, j - 1)}}, {{'x': substr(x, i + k), 'y': substr(y, j + k)}}]) AS c FROM
      (SELECT heard, uid, x, y, b.k AS k, -b.i AS i, strpos(y, substr(x, -b.i, b.k)) AS j FROM (SELECT heard, uid, x, y, {_LONGEST} AS b FROM rs) z WHERE b IS NOT NULL) z) z WHERE c.x <> '' AND c.y <> ''),
    mt AS (SELECT heard, uid, sum(coalesce(b.k, 0)) AS m FROM (SELECT heard, uid, {_LONGEST} AS b FROM rs) z GROUP BY ALL),
    sc AS (SELECT pr.heard, several, pr.uid, 2.0 * m / (length(q) + length(n)) AS r FROM pr JOIN mt ON mt.heard = pr.heard AND mt.uid = pr.uid),
    bs AS (SELECT heard, max(r) AS best FROM sc GROUP BY heard HAVING max(r) >= {THRESHOLD}),
    tp AS (SELECT sc.heard, any_value(best) AS best, count(DISTINCT uid) AS n, min(uid) FILTER (WHERE r = best) AS uid FROM sc JOIN bs ON bs.heard = sc.heard WHERE r >= best - CASE WHEN several THEN {BANDS[1]} ELSE {BANDS[0]} END GROUP BY sc.heard),
    res AS (SELECT a.heard, CASE WHEN n = 1 THEN uid END AS uid, CASE WHEN n = 1 THEN CAST(format('{{:.3f}}', best) AS DOUBLE) END AS score FROM asked a LEFT JOIN tp ON tp.heard = a.heard)"""


@query(f"WITH RECURSIVE asked AS (SELECT DISTINCT heard FROM thread_nodes WHERE heard IS NOT NULL), {RESOLVED} SELECT heard, uid, score FROM res")
def fuzzy_resolve(spark, d):
    """Every name heard, resolved by similarity; near ties are refused."""
    return resolve_names(table(spark, d, "thread_nodes").where("heard is not null"), "heard", table(spark, d, "acteurs")).select("heard", "uid", "score")


_VARIANTS = f"""v AS (SELECT DISTINCT canonical.acteur AS truth, unnest([{{'variant': 'heard', 'name': heard}}, {{'variant': 'plain', 'name': {_PLAIN}}}, {{'variant': 'noisy', 'name': {_NOISY}}}]) AS x FROM thread_nodes WHERE heard IS NOT NULL AND canonical.acteur IS NOT NULL),
    va AS (SELECT truth, x.variant AS variant, x.name AS heard FROM v), asked AS (SELECT DISTINCT heard FROM va), {RESOLVED}, ev AS (SELECT variant, truth, va.heard, uid FROM va JOIN res ON res.heard = va.heard)"""


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """(variant, truth, heard, uid): recorded names as heard, without civility and noisy, with what they resolve to."""
    truth = table(spark, d, "thread_nodes").where("heard is not null and canonical.acteur is not null").select("heard", F.col("canonical.acteur").alias("truth")).distinct()
    forms = (("heard", F.col("heard")), ("plain", T.strip_civility(F.col("heard"))), ("noisy", T.noisy_name(F.col("heard"))))
    variants = durable(truth.select("truth", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), c.alias("heard")) for n, c in forms])).alias("v")).select("truth", "v.*"), "variants")
    return variants.join(resolve_names(variants, "heard", table(spark, d, "acteurs")), "heard").select("variant", "truth", "heard", "uid")


@query(f"""WITH RECURSIVE {_VARIANTS} SELECT variant, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE uid = truth) AS BIGINT) AS hits, CAST(count(*) FILTER (WHERE uid <> truth) AS BIGINT) AS wrong, CAST(count(*) FILTER (WHERE uid IS NULL) AS BIGINT) AS refused,
    round(count(*) FILTER (WHERE uid = truth) * 100.0 / greatest(count(*), 1), 6) AS percent FROM ev GROUP BY variant""")
def resolver_eval(spark, d):
    """Hits, wrong and refused answers against the recorded actor, as heard and for two noise variants."""
    n, hit = F.count(F.lit(1)), F.count_if(F.col("uid") == F.col("truth"))
    return evaluated(spark, d).groupBy("variant").agg(n.alias("n"), hit.alias("hits"), F.count_if(F.col("uid") != F.col("truth")).alias("wrong"), F.count_if(F.col("uid").isNull()).alias("refused"), F.round(hit * 100.0 / F.greatest(n, F.lit(1)), 6).alias("percent"))


#: Failures that a report shows of each variant.
SHOWN = 8


@query(f"""WITH RECURSIVE {_VARIANTS}, f AS (SELECT variant, heard, truth, uid, row_number() OVER (PARTITION BY variant ORDER BY heard, truth) AS k, count(*) OVER (PARTITION BY variant) AS n FROM ev WHERE uid IS DISTINCT FROM truth)
    SELECT variant, CAST(k AS BIGINT) AS k, heard, truth, uid, CAST(greatest(n - {SHOWN}, 0) AS BIGINT) AS more FROM f WHERE k <= {SHOWN}""")
def first_failures(spark, d):
    """The first failures of each variant, and how many more there are: the limit is the report's."""
    f = durable(evaluated(spark, d).where(~F.col("uid").eqNullSafe(F.col("truth"))), "failures")
    ranked = scan(f, ["variant"], ["heard", "truth"], total={"k": F.lit(1)}).where(F.col("k") < SHOWN)
    n = f.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))
    return ranked.join(n, "variant").select("variant", (F.col("k") + 1).alias("k"), "heard", "truth", "uid", F.greatest(F.col("n") - SHOWN, F.lit(0)).alias("more"))


@query("""WITH h AS (SELECT DISTINCT heard, canonical.acteur AS uid FROM thread_nodes WHERE heard IS NOT NULL AND canonical.acteur IS NOT NULL)
    SELECT h.heard, h.uid, CAST(levenshtein(strip_accents(lower(h.heard)), strip_accents(lower(coalesce(a.civ, '') || ' ' || a.prenom || ' ' || a.nom))) AS BIGINT) AS edits FROM h JOIN acteurs a ON a.uid = h.uid""")
def edit_distance_resolve(spark, d):
    """How far each name heard is from the resolved actor's."""
    h = table(spark, d, "thread_nodes").where("heard is not null").select("heard", F.col("canonical.acteur").alias("uid")).distinct()
    j = h.join(table(spark, d, "acteurs"), "uid")
    return j.select("heard", "uid", F.levenshtein(T.unaccent(F.col("heard")), T.unaccent(F.concat_ws(" ", F.coalesce("civ", F.lit("")), "prenom", "nom"))).cast("bigint").alias("edits"))


# SQL: the names of each count window, in the order they are first heard in it, with a hint: hi(sitting_uid, win, heard, place, hint).
_HINTS = f"""{_UTT}, {NAMES}, wo AS (SELECT sitting_uid, ord, (row_number() OVER (PARTITION BY sitting_uid ORDER BY ord) - 1) // {WINDOW} AS win FROM u),
    wn AS (SELECT wo.sitting_uid, win, name AS heard, min({{'ord': nm.ord, 'pos': pos}}) AS place FROM nm JOIN wo ON wo.sitting_uid = nm.sitting_uid AND wo.ord = nm.ord GROUP BY ALL),
    asked AS (SELECT DISTINCT heard FROM wn), {RESOLVED},
    hi AS (SELECT sitting_uid, CAST(win AS BIGINT) AS win, wn.heard, place, CASE WHEN res.uid IS NULL THEN '«' || wn.heard || '» → {NO_CANDIDATE}' ELSE '«' || wn.heard || '» → suggestion : ' || trim(concat_ws(' ', a.civ, a.prenom, a.nom)) || ' (score ' || format('{{:.2f}}', res.score) || ')' END AS hint
      FROM wn JOIN tk ON tk.heard = wn.heard AND len(tk.l) > 0 JOIN res ON res.heard = wn.heard LEFT JOIN acteurs a ON a.uid = res.uid)"""


def window_hints(spark: SparkSession, d: str, windows: DataFrame) -> DataFrame:
    """(sitting_uid, win, place, heard, hint) of the distinct names in count windows."""
    names = F.array_distinct(F.flatten(F.transform("targets", lambda x: T.speaker_names(x["text"]))))
    w = windows.select("sitting_uid", "win", F.posexplode(names).alias("place", "heard"))
    w = durable(w.where(F.size(T.name_tokens(F.col("heard"))) > 0), "names")
    people = table(spark, d, "acteurs")
    got = resolve_names(w, "heard", people).join(people.select("uid", "civ", "prenom", "nom"), "uid", "left")
    hint = F.when(F.col("uid").isNull(), F.concat(F.lit("«"), "heard", F.lit(f"» → {NO_CANDIDATE}"))).otherwise(F.concat(F.lit("«"), "heard", F.lit("» → suggestion : "), F.trim(F.concat_ws(" ", "civ", "prenom", "nom")), F.lit(" (score "), "shown", F.lit(")")))
    return w.join(got.select("heard", hint.alias("hint")), "heard").select("sitting_uid", "win", "place", "heard", "hint")


@query(f"WITH RECURSIVE {_HINTS} SELECT sitting_uid, win, heard, hint FROM hi")
def resolution_hints(spark, d):
    """A hint for every distinct name in a count window: the suggestion with its score, or none close."""
    return window_hints(spark, d, count_windows_of(events_of(spark, d))).drop("place")


@query(f"""WITH RECURSIVE {_HINTS}, hw AS (SELECT sitting_uid, win, string_agg(hint, chr(10) ORDER BY place) AS hints FROM hi GROUP BY ALL),
    ww AS (SELECT wo.sitting_uid, CAST(win AS BIGINT) AS win, string_agg(text, ' ' ORDER BY u.ord) AS target, list(text ORDER BY u.ord) AS l FROM wo JOIN u ON u.sitting_uid = wo.sitting_uid AND u.ord = wo.ord GROUP BY ALL),
    cd AS (SELECT string_agg(trim(concat_ws(' ', civ, prenom, nom)), chr(10) ORDER BY uid) AS names FROM acteurs)
    SELECT ww.sitting_uid, ww.win, replace(replace(replace(replace('{PROMPT}', '<<CANDIDATES>>', names), '<<HINTS>>', coalesce(hints, '(aucun)')), '<<CONTEXT>>', coalesce(nullif(array_to_string(list_slice(b.l, -2, -1), ' '), ''), '(début de séance)')), '<<TARGET>>', ww.target) AS prompt
    FROM ww CROSS JOIN cd LEFT JOIN hw ON hw.sitting_uid = ww.sitting_uid AND hw.win = ww.win LEFT JOIN ww b ON b.sitting_uid = ww.sitting_uid AND b.win = ww.win - 1""")
def prompt_text(spark, d):
    """A prompt per count window: candidates, hints, what went before, and the text to correct."""
    w = durable(count_windows_of(events_of(spark, d)), "windows")
    h = window_hints(spark, d, w).groupBy("sitting_uid", "win").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hint"))), lambda x: x["hint"]), "\n").alias("hints"))
    people = table(spark, d, "acteurs").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", F.trim(F.concat_ws(" ", "civ", "prenom", "nom")).alias("name")))), lambda x: x["name"]), "\n").alias("names"))
    names = people.collect()[0][0] or ""  # the reference list as one text, part of every prompt
    prompt = F.lit(PROMPT)
    for token, value in (("CANDIDATES", F.lit(names)), ("HINTS", F.coalesce("hints", F.lit("(aucun)"))), ("CONTEXT", F.coalesce(F.nullif(F.array_join("context", " "), F.lit("")), F.lit("(début de séance)"))), ("TARGET", F.array_join("targets.text", " "))):
        prompt = F.replace(prompt, F.lit(f"<<{token}>>"), value)
    return w.join(h, ["sitting_uid", "win"], "left").select("sitting_uid", "win", prompt.alias("prompt"))


def corrections(windows: DataFrame, reply) -> DataFrame:
    """(sitting_uid, win, seqs, text, flags) of windows realigned with a reply to each paragraph.

    ``reply`` maps a window's texts to a reply, whose fence is taken off and whose notes are the window's
    flags, kept on its first row (with seqs null if nothing was corrected). A window whose reply fails
    or is empty is left.
    """

    @F.pandas_udf("string")
    def ask(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            try:
                out.append(reply(list(t)))
            except Exception:
                out.append(None)
        return pd.Series(out, dtype=object)

    @F.pandas_udf("array<struct<seqs: array<bigint>, text: string>>")
    def run(seqs: pd.Series, texts: pd.Series, corrected: pd.Series) -> pd.Series:
        return pd.Series([[{"seqs": a, "text": b} for a, b in realign([int(x) for x in s], list(t), c)] for s, t, c in zip(seqs, texts, corrected, strict=True)])

    w = windows.withColumn("reply", T.corrected_reply(ask(F.col("targets.text")))).where("reply is not null")
    w = w.select("sitting_uid", "win", "reply.notes", F.posexplode_outer(run(F.col("targets.ord"), F.col("targets.text"), F.col("reply.text"))).alias("pos", "c"))
    flags = F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("notes")).otherwise(F.array().cast("array<string>"))
    return w.select("sitting_uid", "win", "c.seqs", "c.text", flags.alias("flags")).where("seqs is not null or size(flags) > 0")


def _rejoin(texts: list[str]) -> str:
    """A stand-in for a correction: fragments that begin in lower case join the line before."""
    lines: list[str] = []
    for t in texts:
        t = " ".join(t.split())
        if lines and t[:1].islower():
            lines[-1] += " " + t
        else:
            lines.append(t)
    return "\n".join(lines)


def _realigned(spark, d):
    """Count windows re-cut at sentence starts and mapped back onto their utterances."""
    return corrections(count_windows_of(events_of(spark, d)), _rejoin)


_WORDS = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(replace({c}, '<br/>', ' ')), '[^\\p{{L}}\\p{{N}}_\\s''-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"


def wer_text(c: Column) -> Column:
    """Lower case, line breaks and signs as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.replace(c, F.lit("<br/>"), F.lit(" "))), r"[^\p{L}\p{N}_\s'-]", " "), r"\s+", " "))


def _errors(spark: SparkSession, d: str) -> DataFrame:
    """Word errors of each interim against the utterance that took its place."""
    e = events_of(spark, d)
    s = scan(e, ["sitting_uid"], ["ord"], lag={"_t": F.col("type"), "_x": F.col("text")}).where("type = 'utterance' and _t = 'interim' and text is not null and _x is not null")
    return s.select("sitting_uid", wer(wer_text(F.col("text")), wer_text(F.col("_x"))).alias("e"))


# SQL: words become letters, so that the distance of letters is that of words.
@query(f"""WITH e AS (SELECT sitting_uid, ord, type, text, lag(type) OVER w AS t0, lag(text) OVER w AS x FROM (SELECT DISTINCT sitting_uid, ord, type, beg, text FROM segments WHERE ord IS NOT NULL AND beg IS NOT NULL) q WINDOW w AS (PARTITION BY sitting_uid ORDER BY ord)),
    p AS (SELECT sitting_uid, {_WORDS.format(c="text")} AS a, {_WORDS.format(c="x")} AS b FROM e WHERE type = 'utterance' AND t0 = 'interim' AND text IS NOT NULL AND x IS NOT NULL), c AS (SELECT *, list_distinct(list_concat(a, b)) AS v FROM p),
    l AS (SELECT sitting_uid, len(a) AS n, levenshtein(array_to_string(list_transform(a, lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), ''), array_to_string(list_transform(b, lambda x: chr(CAST(32 + list_position(v, x) AS INTEGER))), '')) AS k FROM c)
    SELECT sitting_uid, CAST(sum(k) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS n, round(sum(k) / nullif(sum(n), 0), 9) AS wer FROM l GROUP BY sitting_uid""")
def wer_total(spark, d):
    """Word errors of the interims of each sitting, and their rate."""
    t = _errors(spark, d).groupBy("sitting_uid").agg(F.sum(F.col("e.s") + F.col("e.d") + F.col("e.i")).alias("errors"), F.sum("e.n").alias("n"))
    return t.withColumn("wer", F.round(F.col("errors") / F.nullif(F.col("n"), F.lit(0)), 9))


def _word_errors(spark, d):
    """The same by kind: substitutions, deletions, insertions."""
    total = _errors(spark, d).groupBy("sitting_uid").agg(*[F.sum(f"e.{k}").alias(k) for k in "sdin"])
    return total.withColumn("wer", (F.col("s") + F.col("d") + F.col("i")) / F.nullif(F.col("n"), F.lit(0)))


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    """Pages of utterances as nested segments, with the speakers who are named in them."""
    w = count_windows_of(events_of(spark, d), PAGE, 0)
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("targets", lambda x: T.speaker_names(x["text"])))))
    return w.select("sitting_uid", F.col("win").alias("page"), F.col("targets").alias("segments"), names.alias("speakers"))


@query(f"""WITH {_UTT}, wo AS (SELECT sitting_uid, ord, text, (row_number() OVER (PARTITION BY sitting_uid ORDER BY ord) - 1) // {PAGE} AS page, regexp_extract_all(text, '(?:^|[^\\p{{L}}\\p{{N}}_])({_NAME})', 1) AS l FROM u)
    SELECT sitting_uid, CAST(page AS BIGINT) AS page, CAST(count(*) AS BIGINT) AS n, min(ord) AS first_ord, max(ord) AS last_ord, md5(string_agg(text, ' ' ORDER BY ord)) AS text_md5, array_to_string(list_sort(list_distinct(flatten(list(l)))), '|') AS speakers FROM wo GROUP BY ALL""")
def segments_projection(spark, d):
    """The nested projection, its text and speakers as one string each."""
    s = pages_of(spark, d)
    return s.select("sitting_uid", "page", F.size("segments").cast("bigint").alias("n"), F.col("segments")[0]["ord"].alias("first_ord"), F.element_at("segments", -1)["ord"].alias("last_ord"), F.md5(F.array_join("segments.text", " ")).alias("text_md5"), F.array_join("speakers", "|").alias("speakers"))


QUERIES |= {"realign": _realigned, "wer": _word_errors}


__all__ = ["NAMES", "QUERIES", "RESOLVED", "SQL", "corrections", "utterances"]
