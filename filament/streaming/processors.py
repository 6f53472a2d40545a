"""Stateful streaming twins of the batch rules, keyed by sitting.

Each keeps the state its rule needs and nothing more, so the same rows give the same nodes as the
windows of the batch form, batch borders or not. Rows inside a micro-batch are put in order; a row
that arrives after a later one of its sitting was handled keeps its place in the arrival order.
They need the RocksDB state store (``state_store``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filament.functions import text as T
from filament.functions.resolve import Matcher
from filament.operators.deduction import BALLOTS

WOVEN = "sitting_uid string, seq bigint, t bigint, kind string, state string, text string, source string, supersedes bigint"


def state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Weave(StatefulProcessor):
    """Two-pass log: an event takes the place of the one before it if that was an interim."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq bigint, interim boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        seq, interim = self.head.get() if self.head.exists() else (0, False)
        out = []
        for kind, beg, text in zip(pdf["type"], pdf["beg"], pdf["text"], strict=True):
            out.append((key[0], seq, int(beg * 1000), "utterance", "provisional" if kind == "interim" else "consolidated", text, "stt", seq - 1 if interim else None))
            seq, interim = seq + 1, kind == "interim"
        self.head.update((seq, interim))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in WOVEN.split(", ")]).astype({"supersedes": "Int64"})

    def close(self) -> None:
        pass


class Floor(StatefulProcessor):
    """Speaker nodes that are not the one who has the floor; only calls move the floor."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.floor = handle.getValueState("floor", "uid string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("seq", kind="stable")
        floor = self.floor.get()[0] if self.floor.exists() else None
        out = []
        for seq, uid, call in zip(pdf["seq"], pdf["uid"], pdf["call"], strict=True):
            if floor is None or uid != floor:
                out.append((key[0], seq, uid, floor))
            if call:
                floor = uid
        if floor is not None:
            self.floor.update((floor,))
        yield pd.DataFrame(out, columns=["sitting_uid", "seq", "uid", "floor"])

    def close(self) -> None:
        pass


class Context(StatefulProcessor):
    """The amendment on hand at every utterance: the last one named so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "uid string")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = self.held.get()[0] if self.held.exists() else None
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        out = []
        for place, uid in zip(pdf["ord"], pdf["uid"], strict=True):
            held = uid if isinstance(uid, str) and uid else held
            out.append((key[0], int(place), held))
        if held is not None:
            self.held.update((held,))
        yield pd.DataFrame(out, columns=["sitting_uid", "ord", "amendement_uid"])

    def close(self) -> None:
        pass


class ChangedOnly(StatefulProcessor):
    """Content that differs from the last good one; null content repeats the last reference."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string, ref bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("snap_id", kind="stable")
        known, ref = self.last.get() if self.last.exists() else (None, None)
        out = []
        for snap, digest in zip(pdf["snap_id"], pdf["hash"], strict=True):
            changed = digest is not None and digest == digest and digest != known
            if changed:
                known, ref = digest, int(snap)
            out.append((key[0], int(snap), bool(changed), ref))
        if known is not None:
            self.last.update((known, ref))
        yield pd.DataFrame(out, columns=["sitting_uid", "snap_id", "changed", "ref"]).astype({"ref": "Int64"})

    def close(self) -> None:
        pass


class Cooldown(StatefulProcessor):
    """Boundaries that come at least ``seconds`` after the last one let through."""

    def __init__(self, seconds: float = 3.0):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in sorted(pd.concat(list(rows))["beg"].unique()):
            if last is None or t >= last + self.seconds:
                out.append((key[0], float(t)))
                last = float(t)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["sitting_uid", "beg"])

    def close(self) -> None:
        pass


class CountWindow(StatefulProcessor):
    """Windows of ``size`` utterances with context; an idle sitting flushes after ``idle_ms``."""

    def __init__(self, size: int = 20, overlap: int = 2, idle_ms: int = 30_000):
        self.size, self.overlap, self.idle_ms = size, overlap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ord bigint, text string")
        self.before = handle.getListState("before", "text string")

    def _emit(self, key, targets):
        context = [x[0] for x in self.before.get()] if self.before.exists() else []
        self.before.put([(t[1],) for t in targets[-self.overlap :]])
        return (key[0], len(targets), int(targets[0][0]), int(targets[-1][0]), " ".join(t[1] for t in targets), " ".join(context))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        held += list(zip(pdf["ord"].astype(int), pdf["text"], strict=True))
        out = []
        while len(held) >= self.size:
            out.append(self._emit(key, held[: self.size]))
            held = held[self.size :]
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.held.put(held)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.held.clear()
        yield pd.DataFrame(out, columns=_WINDOW)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        self.held.clear()
        yield pd.DataFrame([self._emit(key, held)] if held else [], columns=_WINDOW)

    def close(self) -> None:
        pass


_WINDOW = ["sitting_uid", "n", "first_ord", "last_ord", "text", "context"]
WINDOWS = "sitting_uid string, n bigint, first_ord bigint, last_ord bigint, text string, context string"


DEDUCED = "sitting_uid string, seq bigint, t bigint, kind string, state string, text string, source string, supersedes bigint, acteur string, tribun string, amendement_uid string, article string, groupe string, call string, heard string, groupe_label string"


class Deduce(StatefulProcessor):
    """The log of events and of what they let one deduce, in one sequence: both passes share the state.

    ``agenda``: number -> entries (at_ms, place, uid, tribun, label, article) in rising order; ``names``: heard
    -> uid; ``people``: uid -> (label, group); ``groups``: uid -> label.
    """

    def __init__(self, agenda: dict, matcher: Matcher, people: dict, groups: dict):
        self.agenda, self.matcher, self.people, self.groups = agenda, matcher, people, groups

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "seq bigint, interim boolean, floor string, held array<string>, tail array<boolean>")
        self.woven = handle.getMapState("woven", "uid string", "seq bigint")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("ord", kind="stable")
        seq, interim, floor, held, tail = self.head.get() if self.head.exists() else (0, False, None, None, None)
        out: list[tuple] = []

        def node(t, kind, state, text, supersedes=None, canonical=(None,) * 5, rest=(None,) * 3) -> None:
            nonlocal seq
            out.append((key[0], seq, t, kind, state, text, "stt", supersedes, *canonical, *rest))
            seq += 1

        for r in pdf.itertuples():
            t = int(r.beg * 1000)
            node(t, "utterance", "provisional" if r.type == "interim" else "consolidated", r.text, seq - 1 if interim else None)
            interim = r.type == "interim"
            if r.type != "utterance" or not isinstance(r.text, str):
                continue
            for n in r.nums:
                known = [e for e in self.agenda.get((key[0], int(n)), ()) if e[0] <= r.at_ms]
                if not known:
                    continue
                _, _, uid, tribun, label, article = known[-1]
                held = [f"PA{tribun}" if tribun else None, tribun or None, uid, article, None]
                if not self.woven.containsKey((uid,)):
                    self.woven.updateValue((uid,), (seq,))
                    node(t, "amendment", "consolidated", label or "", canonical=held)
            for n in r.names:
                uid = self.matcher.resolve(list(n["words"]))[0]
                if uid is None or uid == floor:
                    continue
                call = n["call"]
                if n["opens"] and tail is not None and tail[0]:
                    call = "strong" if n["group"] or tail[1] or tail[2] else "weak" if tail[3] and n["ends"] else "none"
                if call != "none":
                    floor = uid
                label, group = self.people[uid]
                node(t, "speaker", "consolidated", label, canonical=(uid, uid[2:], None, None, group), rest=(None if call == "none" else call, n["name"], self.groups.get(group)))
            if isinstance(r.event, str):
                node(t, "ballot", "consolidated", BALLOTS[r.event], canonical=held or (None,) * 5)
            tail = list(r.tail)
        self.head.update((seq, interim, floor, list(held) if held is not None else None, [bool(x) for x in tail] if tail is not None else None))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DEDUCED.split(", ")]).astype({"supersedes": "Int64"})

    def close(self) -> None:
        pass


def deduce_stream(events: DataFrame, agenda: DataFrame, people: DataFrame, groups: DataFrame, most: int = 200_000) -> DataFrame:
    """(sitting_uid, ord, type, beg, at_ms, text[, source]) into the whole log; tables as in ``deduction.deduce``.

    Rows of another source than speech, such as corrections, are not deduced from. The tables of a live
    sitting are small: each is counted, and more than ``most`` rows are an error.
    """
    for x in (agenda, people, groups):
        if x.count() > most:
            raise ValueError("a table of a live sitting is too large to be held by every task")
    seen: dict = {}
    for r in sorted(agenda.select("sitting_uid", "num", "at_ms", "place", "uid", "tribun", "label", "article").collect(), key=lambda r: (r[2], r[3])):
        seen.setdefault((r[0], r[1]), []).append(tuple(r[2:]))
    listed = people.where("uid is not null").select("uid", T.normalize_name(F.col("nom")).alias("one"), T.normalize_name(F.concat_ws(" ", F.coalesce("prenom", F.lit("")), F.coalesce("nom", F.lit("")))).alias("more")).distinct()
    matcher = Matcher(sorted(tuple(r) for r in listed.collect()))
    who = {r[0]: (r[1], r[2]) for r in people.select("uid", F.concat_ws(" ", "civ", "prenom", "nom"), "groupe_uid").collect()}
    what = {r[0]: r[1] for r in groups.select("uid", "libelle").collect()}
    text = F.col("text")
    after = lambda n: F.substring(text, F.instr(text, n) + F.length(n), F.length(text))
    blank = lambda c: F.trim(c) == ""
    names = F.transform(T.speaker_names(text), lambda n: F.struct(n.alias("name"), T.name_tokens(n).alias("words"), T.speaker_call(text, n, F.lit("")).alias("call"), blank(F.substring(text, F.lit(1), F.instr(text, n) - 1)).alias("opens"), after(n).rlike(T.CALL_AFTER).alias("group"), blank(F.split(after(n), "[.!?]", 2)[0]).alias("ends")))
    tail = F.array(~F.rtrim(text).rlike(T.SENTENCE_END) & (text != ""), text.rlike(T.CALL_BEFORE), text.rlike(T.AMENDMENT), blank(F.element_at(F.split(text, "[.!?]", -1), -1)))
    if "source" in events.columns:
        events = events.where("source = 'stt'")
    cols = events.select("sitting_uid", "ord", "type", "beg", "at_ms", "text", F.coalesce(T.amendment_numbers(text), F.array().cast("array<int>")).alias("nums"), F.coalesce(names, F.array()).alias("names"), T.ballot_event(text).alias("event"), tail.alias("tail"))
    return _run(cols, Deduce(seen, matcher, who, what), DEDUCED)


def _run(stream: DataFrame, processor: StatefulProcessor, schema: str, mode: str = "None") -> DataFrame:
    return stream.groupBy("sitting_uid").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=mode)


def weave_stream(events: DataFrame) -> DataFrame:
    """(sitting_uid, ord, type, beg, text) into log nodes."""
    return _run(events.select("sitting_uid", "ord", "type", "beg", "text"), Weave(), WOVEN)


def floor_stream(speakers: DataFrame) -> DataFrame:
    return _run(speakers.select("sitting_uid", "seq", "uid", "call"), Floor(), "sitting_uid string, seq bigint, uid string, floor string")


def context_stream(utterances: DataFrame) -> DataFrame:
    """(sitting_uid, ord, uid) into the amendment on hand; ``uid`` is the one an utterance names, or null."""
    return _run(utterances.select("sitting_uid", "ord", "uid"), Context(), "sitting_uid string, ord bigint, amendement_uid string")


def dedup_stream(snapshots: DataFrame) -> DataFrame:
    return _run(snapshots.select("sitting_uid", "snap_id", "hash"), ChangedOnly(), "sitting_uid string, snap_id bigint, changed boolean, ref bigint")


def cooldown_stream(boundaries: DataFrame, seconds: float = 3.0) -> DataFrame:
    return _run(boundaries.select("sitting_uid", "beg"), Cooldown(seconds), "sitting_uid string, beg double")


def voice_nodes(boundaries: DataFrame, seconds: float = 3.0) -> DataFrame:
    """Voice boundaries into provisional speaker nodes of nobody: (sitting_uid, t, kind, state, text, source)."""
    b = cooldown_stream(boundaries, seconds)
    return b.select("sitting_uid", (F.col("beg") * 1000).cast("bigint").alias("t"), F.lit("speaker").alias("kind"), F.lit("provisional").alias("state"), F.lit("(nouvelle voix)").alias("text"), F.lit("diar").alias("source"))


def window_stream(utterances: DataFrame, size: int = 20, overlap: int = 2, idle_ms: int = 30_000) -> DataFrame:
    return _run(utterances.select("sitting_uid", "ord", "text"), CountWindow(size, overlap, idle_ms), WINDOWS, "ProcessingTime")


def speech_rate(events: DataFrame, origin_ms: int = 0, size: str = "10 seconds", hop: str = "2 seconds", late: str = "30 seconds") -> DataFrame:
    """Events per sliding window of event time, with a watermark: (sitting_uid, begin, n)."""
    ts = F.timestamp_millis(F.lit(origin_ms) + (F.col("beg") * 1000).cast("bigint"))
    w = events.withColumn("ts", ts).withWatermark("ts", late).groupBy("sitting_uid", F.window("ts", size, hop)).agg(F.count(F.lit(1)).alias("n"))
    return w.select("sitting_uid", F.col("window.start").alias("begin"), "n")


def enrich_batches(stream: DataFrame, read_dimension, key: str, handle, checkpoint: str):
    """Joins each micro-batch with a dimension that is read anew, so it may change while the stream runs."""

    def step(batch: DataFrame, _: int) -> None:
        handle(batch.join(read_dimension(), key, "left"))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
