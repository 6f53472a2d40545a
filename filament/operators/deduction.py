"""What speech lets one deduce: amendments on the agenda known by then, speakers called, ballots, in one sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from filament.functions import text as T
from filament.functions.resolve import resolve_names
from filament.operators.ranges import scan
from filament.runtime import durable

# Texts of ballot nodes by event.
BALLOTS = {"open": "Scrutin ouvert", "vote": "Mise aux voix", "adopted": "Adopté", "rejected": "Rejeté"}
_CANONICAL = "struct<acteur: string, tribun: string, amendement_uid: string, article: string, groupe: string>"


def numbers_heard(utterances: DataFrame, agenda: DataFrame) -> DataFrame:
    """(sitting_uid, ord, pos, num, canonical, label) of the numbers in utterances that were on the agenda by then.

    ``utterances``: (sitting_uid, ord, at_ms, text); ``agenda``: (sitting_uid, num, at_ms, place, uid, tribun,
    label, article), one row a line and snapshot, ``place`` ordering those of one instant. The entry is the
    last one seen at or before the utterance; a number not seen by then resolves to nothing.
    """
    probes = utterances.select("sitting_uid", "ord", "at_ms", F.posexplode(T.amendment_numbers(F.col("text"))).alias("pos", "num"))
    entry = F.struct("uid", "tribun", "label", "article")
    # One ordered pass over snapshots and utterances; at the same instant the snapshot comes first.
    seen = agenda.select("sitting_uid", "num", "at_ms", F.lit(0).alias("probe"), F.col("place").alias("order"), entry.alias("entry"), F.lit(None).cast("bigint").alias("ord"), F.lit(None).cast("int").alias("pos"))
    asked = probes.select("sitting_uid", "num", "at_ms", F.lit(1), F.array(F.col("ord").cast("bigint"), F.col("pos").cast("bigint")), F.lit(None), "ord", "pos")
    both = scan(seen.union(asked), ["sitting_uid", "num"], ["at_ms", "probe", "order"], last={"known": F.col("entry")})
    tribun = F.nullif("known.tribun", F.lit(""))
    canonical = F.struct(F.concat(F.lit("PA"), tribun).alias("acteur"), tribun.alias("tribun"), F.col("known.uid").alias("amendement_uid"), F.col("known.article").alias("article"), F.lit(None).cast("string").alias("groupe"))
    return both.where("probe = 1 and known is not null").select("sitting_uid", "ord", "pos", "num", canonical.alias("canonical"), F.coalesce("known.label", F.lit("")).alias("label"))


def on_hand(utterances: DataFrame, heard: DataFrame) -> DataFrame:
    """(sitting_uid, ord, event, canonical): at every utterance its ballot event and the last amendment heard up to it, itself included."""
    hit = heard.groupBy("sitting_uid", "ord").agg(F.max_by("canonical", "pos").alias("own"))
    u = utterances.select("sitting_uid", "ord", T.ballot_event(F.col("text")).alias("event")).join(hit, ["sitting_uid", "ord"], "left")
    s = scan(u, ["sitting_uid"], ["ord"], last={"prior": F.col("own")})
    return s.select("sitting_uid", "ord", "event", F.coalesce("own", "prior").alias("canonical"))


def called_names(utterances: DataFrame) -> DataFrame:
    """(sitting_uid, ord, pos, name, call) of every name in utterances: called to speak (strong, weak) or only mentioned."""
    u = scan(utterances.select("sitting_uid", "ord", "text"), ["sitting_uid"], ["ord"], lag={"prev": F.col("text")})
    u = u.select("sitting_uid", "ord", "text", "prev", F.posexplode(T.speaker_names(F.col("text"))).alias("pos", "name"))
    return u.select("sitting_uid", "ord", "pos", "name", T.speaker_call(F.col("text"), F.col("name"), F.coalesce("prev", F.lit(""))).alias("call"))


def speakers(utterances: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """(sitting_uid, ord, pos, uid, label, call, heard, groupe, groupe_label) of the names that do not have the floor.

    Names are resolved by similarity; only a call moves the floor, a mention never does.
    """
    names = durable(called_names(utterances), "called")
    known = resolve_names(names, "name", people).select(F.col("heard").alias("name"), "uid").where("uid is not null")
    n = names.join(known, "name")
    s = scan(n, ["sitting_uid"], ["ord", "pos"], last={"floor": F.when(F.col("call") != "none", F.col("uid"))}).where("floor is null or uid <> floor")
    who = people.groupBy("uid").agg(F.min(F.concat_ws(" ", "civ", "prenom", "nom")).alias("label"), F.min("groupe_uid").alias("groupe"))
    what = groups.groupBy(F.col("uid").alias("groupe")).agg(F.min("libelle").alias("groupe_label"))
    return s.join(who, "uid").join(what, "groupe", "left").select("sitting_uid", "ord", "pos", "uid", "label", F.nullif("call", F.lit("none")).alias("call"), F.col("name").alias("heard"), "groupe", "groupe_label")


def deduce(utterances: DataFrame, agenda: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """(sitting_uid, ord, rank, pos, kind, text, canonical, call, heard, groupe_label) of all nodes that utterances let one deduce.

    In an utterance amendments come first (rank 1), each woven once a sitting, then speakers (2), then
    its ballot (3), which takes the amendment on hand. Off-agenda numbers, unknown or ambiguous names
    and titles give nothing.
    """
    heard = durable(numbers_heard(utterances, agenda), "heard")
    first = heard.groupBy("sitting_uid", F.col("canonical.amendement_uid").alias("woven")).agg(F.min_by(F.struct("ord", "pos", "canonical", "label"), F.struct("ord", "pos")).alias("m"))
    none = F.lit(None).cast("string")
    a = first.select("sitting_uid", "m.ord", F.lit(1).alias("rank"), "m.pos", F.lit("amendment").alias("kind"), F.col("m.label").alias("text"), F.col("m.canonical").cast(_CANONICAL).alias("canonical"), none.alias("call"), none.alias("heard"), none.alias("groupe_label"))
    person = F.struct(F.col("uid").alias("acteur"), F.expr("substr(uid, 3)").alias("tribun"), none.alias("amendement_uid"), none.alias("article"), F.col("groupe").alias("groupe"))
    s = speakers(utterances, people, groups).select("sitting_uid", "ord", F.lit(2), "pos", F.lit("speaker"), "label", person.cast(_CANONICAL), "call", "heard", "groupe_label")
    label = F.create_map(*[F.lit(x) for kv in BALLOTS.items() for x in kv])
    empty = F.struct(*[none.alias(n) for n in ("acteur", "tribun", "amendement_uid", "article", "groupe")])
    b = on_hand(utterances, heard).where("event is not null").select("sitting_uid", "ord", F.lit(3), F.lit(0), F.lit("ballot"), label[F.col("event")], F.coalesce("canonical", empty).cast(_CANONICAL), none, none, none)
    return a.union(s).union(b)


def numbered(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sitting_uid, ord, rank, pos, kind, seq): one sequence from 0 over events (rank 0) and the nodes deduced from them."""
    rows = events.select("sitting_uid", "ord", F.lit(0).alias("rank"), F.lit(0).alias("pos"), F.lit("utterance").alias("kind")).union(nodes.select("sitting_uid", "ord", "rank", "pos", "kind"))
    return scan(rows, ["sitting_uid"], ["ord", "rank", "pos"], total={"seq": F.lit(1)})
