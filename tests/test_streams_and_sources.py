"""Streams against their batch twins, and the file and polling sources."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from filament.functions.clock import MasterClock, broadcast_ms
from filament.operators import deduction
from filament.operators.ranges import scan
from filament.plans.thread import count_windows_of, weave
from filament.sources import files, sinks
from filament.sources.polling import PollingSource
from filament.runtime import durable
from filament.streaming import processors as P


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = random.Random(3)
    rows, path = [], tmp_path_factory.mktemp("events")
    for part in "ab":
        for i in range(120):
            rows.append((part, i, rng.choice(["interim", "utterance", "utterance"]), i * 1.5, f"mot {i}"))
    for k in range(4):
        chunk = [r for r in rows if r[1] // 30 == k]
        rng.shuffle(chunk)
        (path / f"{k}.json").write_text("\n\n".join(json.dumps(dict(zip(("sitting_uid", "ord", "type", "beg", "text"), r, strict=True))) for r in chunk) + "\n")
        os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files arrive in the order of their times
    schema = "sitting_uid string, ord bigint, type string, beg double, text string"
    return spark.createDataFrame(rows, schema), str(path), schema


def stream_of(spark, events):
    P.state_store(spark)
    return spark.readStream.schema(events[2]).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(events[1])


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def same(a, b):
    cols = sorted(a.columns)
    return sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def test_weave_twin(spark, events, tmp_path):
    assert same(drain(P.weave_stream(stream_of(spark, events)), tmp_path, "woven"), weave(events[0]))


def test_count_window_twin(spark, events, tmp_path):
    s = stream_of(spark, events).where("type = 'utterance'")
    w = count_windows_of(events[0])
    q = P.window_stream(s, 20, 2).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", str(tmp_path / "w")).start()
    full = w.where(F.size("targets") == 20).count()
    for _ in range(60):
        q.awaitTermination(0.5)
        if spark.table("windows").where("n = 20").count() == full:
            break
    q.stop()
    got = spark.table("windows").where("n = 20")
    want = w.where(F.size("targets") == 20).select("sitting_uid", F.lit(20).cast("bigint").alias("n"), F.col("targets")[0]["ord"].alias("first_ord"), F.element_at("targets", -1)["ord"].alias("last_ord"), F.array_join("targets.text", " ").alias("text"), F.coalesce(F.array_join("context", " "), F.lit("")).alias("context"))
    assert same(got, want) and got.count() > 2


def test_cooldown_and_rate(spark, events, tmp_path):
    got = sorted(r[1] for r in drain(P.cooldown_stream(stream_of(spark, events), 4.0), tmp_path, "cool").where("sitting_uid = 'a'").collect())
    assert got == [4.5 * k for k in range(len(got))] and len(got) == 40
    rate = drain(P.speech_rate(stream_of(spark, events)), tmp_path, "rate")
    assert rate.where("n > 14").count() == 0 and rate.count() > 10


def test_context_twin(spark, events, tmp_path):
    named = F.when(F.col("ord") % 7 == 3, F.concat(F.lit("A"), F.col("ord").cast("string")))
    got = drain(P.context_stream(stream_of(spark, events).withColumn("uid", named)), tmp_path, "context")
    e = events[0].withColumn("uid", named)
    want = scan(e, ["sitting_uid"], ["ord"], last={"prior": F.col("uid")}).select("sitting_uid", "ord", F.coalesce("uid", "prior").alias("amendement_uid"))
    assert same(got, want)


def test_deduced_log_twin(spark, tmp_path):
    """Batch and stream give the same log; both follow the rules one utterance after the other."""
    rng = random.Random(13)
    phrases = [
        "La parole est à Mme Anne Tournefeu.", "L'amendement 12 de M. Paul Brulet", "M. Brulat.", "Comme M. Paul Brulet le disait", "Le scrutin est ouvert sur le 12", "Il est adopté.", "Amendements 7, 12 et 99", "Sur ce point la parole est à", "Mme Anne Tournefeu.",
        "M. Paul Brulet, pour le groupe Rivages.", "Rien à dire", "Monsieur le ministre.", "Mme Anne Tournefeu et M. Paul Brulet", "Je mets aux voix l'amendement 7", "le 7, il est rejeté, scrutin", "", None,
    ]
    rows = [(rng.choice("ab"), i, rng.choice(["interim", "utterance", "utterance"]), i * 1.5, i * 1500, rng.choice(phrases)) for i in range(160)]
    schema = "sitting_uid string, ord bigint, type string, beg double, at_ms bigint, text string"
    (tmp_path / "d").mkdir()
    for k in range(4):
        chunk = rows[k * 40 : k * 40 + 40]
        (tmp_path / "d" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(schema.replace(" string", "").replace(" bigint", "").replace(" double", "").split(", "), r, strict=True)) | {"source": "stt"}) for r in rng.sample(chunk, 40)) + '\n{"sitting_uid": "a", "ord": 999, "type": "utterance", "beg": 1.0, "at_ms": 1, "text": "amendement 12", "source": "llm"}\n')
        os.utime(tmp_path / "d" / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
    events = spark.createDataFrame(rows, schema)
    agenda = spark.createDataFrame([("a", 12, 30_000, [1, 1, 1], "UN12", "55", "L12", "art 1"), ("a", 12, 90_000, [2, 1, 1], "UN12b", "", None, None), ("b", 7, 0, [1, 1, 1], "UN7", None, "L7", "art 2"), ("b", 7, 0, [1, 1, 2], "UN7c", "56", "L7c", "art 3"), ("b", 12, 200_000, [1, 1, 1], "UN12", "55", "L12", None)], "sitting_uid string, num int, at_ms bigint, place array<bigint>, uid string, tribun string, label string, article string")
    people = spark.createDataFrame([("PA1", "Mme", "Anne", "Tournefeu", "g1"), ("PA2", "M.", "Paul", "Brulet", None), ("PA3", "Mme", "Jeanne", "Brulat", "g9")], "uid string, civ string, prenom string, nom string, groupe_uid string")
    groups = spark.createDataFrame([("g1", "Groupe Un", "GU")], "uid string, libelle string, libelle_abrege string")
    P.state_store(spark)
    s = spark.readStream.schema(schema + ", source string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "d"))
    got = drain(P.deduce_stream(s, agenda, people, groups), tmp_path, "deduced")
    said = events.where("type = 'utterance' and text is not null")
    nodes = durable(deduction.deduce(said, agenda, people, groups), "nodes")
    numbered = deduction.numbered(events, nodes)
    batch = nodes.join(numbered.where("rank > 0").drop("kind"), ["sitting_uid", "ord", "rank", "pos"]).select("sitting_uid", "seq", "kind", "text", "canonical.*", "call", "heard", "groupe_label")
    stream = got.where("kind <> 'utterance'").select(*batch.columns)
    assert same(stream, batch) and batch.count() > 40
    assert {r["kind"] for r in batch.select("kind").distinct().collect()} == {"amendment", "speaker", "ballot"}
    assert same(got.where("kind = 'utterance'").select("sitting_uid", "seq"), numbered.where("rank = 0").select("sitting_uid", "seq"))
    seqs = sorted((r[0], r[1]) for r in got.select("sitting_uid", "seq").collect())
    assert seqs == [(p, i) for p in "ab" for i in range(sum(x[0] == p for x in seqs))]
    one = {r["seq"]: r for r in got.where("sitting_uid = 'b'").collect()}
    # Amendments are woven once a sitting, with the entry that was known; a ballot takes the one on hand.
    woven = [r["amendement_uid"] for r in one.values() if r["kind"] == "amendment"]
    assert len(woven) == len(set(woven)) and "UN7c" in woven and "UN7" not in woven


def test_floor_and_dedup(spark, tmp_path):
    P.state_store(spark)
    (tmp_path / "s").mkdir()
    rows = [("x", i, u, c) for i, (u, c) in enumerate([("A", None), ("A", "weak"), ("A", None), ("B", None), ("B", "strong"), ("A", None), ("B", None)])]
    (tmp_path / "s" / "a.json").write_text("\n".join(json.dumps(dict(zip(("sitting_uid", "seq", "uid", "call"), r, strict=True))) for r in rows))
    s = spark.readStream.schema("sitting_uid string, seq bigint, uid string, call string").json(str(tmp_path / "s"))
    assert [(r["seq"], r["floor"]) for r in drain(P.floor_stream(s), tmp_path, "floor").orderBy("seq").collect()] == [(0, None), (1, None), (3, "A"), (4, "A"), (5, "B")]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "a.json").write_text("\n".join(json.dumps({"sitting_uid": "x", "snap_id": i, "hash": h}) for i, h in enumerate(["p", "p", None, "q", "p"])))
    s = spark.readStream.schema("sitting_uid string, snap_id bigint, hash string").json(str(tmp_path / "h"))
    assert [(r["changed"], r["ref"]) for r in drain(P.dedup_stream(s), tmp_path, "dedup").orderBy("snap_id").collect()] == [(True, 0), (False, 0), (False, 0), (True, 3), (True, 4)]


def test_scan_against_windows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", None]), i, rng.choice([None, i]), rng.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "part string, ord int, v int, n int")
    got = {r["ord"]: (r["l"], r["k"], r["s"], r["p"]) for r in scan(df, ["part"], ["ord"], lag={"l": F.col("v")}, last={"k": F.col("v")}, total={"s": F.col("n")}, peak={"p": F.col("n")}).collect()}
    state, want = {}, {}
    for part, i, v, n in rows:
        was, known, total, high = state.get(part, (None, None, 0, None))
        want[i] = (was, known, total, high)
        state[part] = (v, v if v is not None else known, total + (n or 0), max((x for x in (n, high) if x is not None), default=None))
    assert got == want
    assert scan(df.limit(0), ["part"], ["ord"], lag={"l": F.col("v")}).count() == 0


def test_thread_log(spark, tmp_path):
    (tmp_path / "t.ndjson").write_text('{"seq": 1, "t": 5, "text": "été", "supersedes": 0, "canonical": {"acteur": null}}\n\n{"seq": 2, "supersedes": [0, 1]}\nnot json\n{"seq": 3}\n')
    rows = files.read_thread(spark, str(tmp_path / "t.ndjson")).orderBy("seq").collect()
    assert [(r["seq"], r["supersedes"], r["text"]) for r in rows] == [(1, [0], "été"), (2, [0, 1], None), (3, None, None)]


def test_raw_bytes_and_slices(spark, tmp_path):
    (tmp_path / "raw" / "nvs").mkdir(parents=True)
    (tmp_path / "raw" / "nvs" / "a.xml").write_bytes(b"\xff\x00<x/>")
    refs = spark.createDataFrame([("raw/nvs/a.xml",), ("raw/nvs/none.xml",)], "ref string")
    got = {r["ref"]: r["content"] for r in files.raw_by_reference(refs, "ref", files.read_raw(spark, str(tmp_path / "raw"))).collect()}
    assert bytes(got["raw/nvs/a.xml"]) == b"\xff\x00<x/>" and got["raw/nvs/none.xml"] is None
    (tmp_path / "ref.json").write_text('[{"uid": "a"}, {"uid": "b", "x": 1}]')
    assert files.read_reference(spark, str(tmp_path / "ref.json"), spark.createDataFrame([], "uid string").schema).count() == 2
    for _ in range(2):
        sinks.write_slice(refs, str(tmp_path / "slice"))
    assert spark.read.json(str(tmp_path / "slice")).count() == 2


def test_chapters_and_synchros(spark):
    xml = "<data status='vod'><speakers><speaker id='1'><name>Une Personne</name></speaker><speaker id='2'><name></name></speaker></speakers><chapters><chapter id='a' label='A'><chapter id='b' label='B'><speaker id='1'/></chapter><chapter id='x'><chapter id='c' label='C'><speaker id='2'/></chapter></chapter></chapter><chapter id='d' label='D'/></chapters></data>"
    df = spark.createDataFrame([("k", xml), ("bad", "<x"), ("none", None)], "k string, xml string")
    got = [tuple(r)[1:] for r in files.read_chapters(df, "k", "xml").orderBy("ord").collect()]
    assert got == [(0, "a", None, 0, "A", None, None), (1, "b", "a", 1, "B", "1", "Une Personne"), (2, "c", "a", 1, "C", "2", None), (3, "d", None, 0, "D", None, None)]
    player = spark.createDataFrame([("k", "<player starttime='17'><synchro id='a' timecode='5'/><synchro id='b' timecode='9'/></player>")], "k string, xml string")
    assert [(r["starttime"], r["id"], r["timecode"]) for r in files.read_synchros(player, "k", "xml").orderBy("ord").collect()] == [(17, "a", 5), (17, "b", 9)]


def test_polling(spark, tmp_path):
    for n in (0, 1, 3, 4):
        (tmp_path / f"agenda_{n}").write_text(f"body {n // 2}")
        (tmp_path / f"detail_{n}").write_text("detail")
    spark.dataSource.register(PollingSource)
    s = spark.readStream.format("polling").option("url", f"file://{tmp_path}/{{source}}_{{tick}}").option("sources", "agenda,down,agenda>detail").option("max_ticks", "5").load()
    q = s.writeStream.format("memory").queryName("polled").option("checkpointLocation", str(tmp_path / "c")).start()
    for _ in range(60):
        q.awaitTermination(0.5)
        if spark.table("polled").count() == 15:
            break
    q.stop()
    rows = {(r["tick"], r["source"]): r for r in spark.table("polled").collect()}
    assert [rows[n, "agenda"]["changed"] for n in range(5)] == [True, False, False, True, True]
    assert rows[2, "agenda"]["error"] and rows[2, "agenda"]["ref"] == rows[1, "agenda"]["ref"]
    assert rows[0, "down"]["ref"] is None and bytes(rows[0, "agenda>detail"]["content"]).endswith(b"detail")


def test_sinks(spark, events, tmp_path):
    s = spark.readStream.schema(events[2]).json(events[1])
    sinks.append_ndjson(s, str(tmp_path / "log"), str(tmp_path / "c1")).awaitTermination()
    seen = []
    for _ in range(2):
        sinks.follow(spark, str(tmp_path / "log"), events[0].schema, lambda df: seen.extend(df.collect()), str(tmp_path / "c2")).awaitTermination()
    assert len(seen) == 240
    assert sinks.frames(events[0].limit(1)).collect()[0][0].startswith("data: {")
    joined = []
    P.enrich_batches(s, lambda: spark.createDataFrame([("a", 1)], "sitting_uid string, d int"), "sitting_uid", lambda df: joined.extend(df.where("d = 1").collect()), str(tmp_path / "c3")).awaitTermination()
    assert len(joined) == 120


def test_clock():
    now = [0.0]
    c = MasterClock(lambda: now[0])
    c.play()
    now[0] = 1.5
    c.play()
    assert c.t_ms == 1500 and c.playing
    c.pause()
    now[0] = 9.0
    assert c.t_ms == 1500
    c.apply("seek_by", -5000)
    assert c.t_ms == 0
    c.apply("seek", 250.7)
    c.apply("play")
    now[0] = 10.0
    assert c.t_ms == 1250 and broadcast_ms(1000, c.t_ms) == 2250
    with pytest.raises(ValueError):
        c.apply("rewind")
