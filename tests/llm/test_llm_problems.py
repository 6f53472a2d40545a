"""Problems 1, 3, 6, 7 and 8 against brute force, and their edge cases."""

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from filament.llm import bktree, canonical, mixing, packing, splitting, turns
from filament.llm.names import label_key, reach, register_of
from filament.llm.queries import p1_found, p1_heldout, p3_found, p6_found, p7_found, p8_found, p8_pieces
from filament.llm.tokens import encoder
from filament.runtime import table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


# Problem 3


def test_distance_and_tree_against_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcé", k=rng.randint(0, 8))) for _ in range(300)]
    assert all(bktree.levenshtein(a, b) == plain(a, b) for a, b in zip(words, reversed(words), strict=True))
    assert bktree.levenshtein("a" * 500, "b" * 300) == 500
    tree = bktree.BKTree(words)
    for q in words[:40] + ["", "zzz"]:
        for r in range(4):
            want = sorted({(plain(q, w), w) for w in words if plain(q, w) <= r})
            assert tree.within(q, r) == want


@pytest.mark.parametrize("shards", [1, 3])
def test_search_broadcast_and_sharded(spark, shards):
    rng = random.Random(2)
    ref = ["".join(rng.choices("abc", k=5)) for _ in range(80)]
    qs = ["".join(rng.choices("abc", k=5)) for _ in range(60)] + ["ccccccccccccc"]
    q = spark.createDataFrame([(x, 1) for x in [*qs, *qs, None]], "v string, entry int")
    r = spark.createDataFrame([(x,) for x in [*ref, None]], "e string")
    got = {(x["value"], x["entry"], x["distance"]) for x in bktree.search(q, "v", r, "e", 2, shards=shards).collect()}
    want = set()
    for x in set(qs):
        d = min(plain(x, w) for w in ref)
        want |= {(x, w, d) for w in ref if plain(x, w) == d} if d <= 2 else {(x, None, None)}
    assert got == want


PEOPLE = [("u1", "M.", "Jean-Marc", "Brisoquier", "g1"), ("u2", "Mme", "Édith", "Talmoreau-Vinchard", "g2"), ("u3", "M.", "Paul", "de La Grondée", None), ("u4", "Mme", "Anne", "Lorvinet", "g1"), ("u5", "M.", "Adrien", "Lorvinet", "g2"), ("u6", "M.", "Louis", "Gortambel", "g1"), ("u7", "M.", "Louis", "Gortanbel", "g2"), (None, None, None, None, None)]
GROUPS = [("g1", "Groupe Un", "GU"), ("g2", "Rivages", "RV")]


@pytest.mark.parametrize(
    ("text", "uids"),
    [
        ("M. Brisoquier", ["u1"]), ("brisoqiuer jean-marc", ["u1"]), ("J.-M. BRISOQUIER", ["u1"]), ("M. P. Brisoquier", []), ("Mme Talmoreau", ["u2"]), ("Vinchard", []), ("Mme Ã‰dith Talmoreau Vinchard", ["u2"]), ("12. de la grondee, paul (2 min)", ["u3"]),
        ("Lorvinet", ["u4", "u5"]), ("Mme Lorvinet", ["u4"]), ("A. Lorvinet", ["u4", "u5"]), ("Lorvinet (RV)", ["u5"]), ("Lorvinet, groupe GU", ["u4"]), ("Lorvinet Adrien - abs.", ["u5"]), ("Gortambel", ["u6"]), ("Gortanbel *", ["u7"]), ("Gortaanbel, L. GU", ["u6"]),
        ("le rapporteur", []), ("M. le président Brisoquier", ["u1"]), ("", []), (None, []), ("?", []), ("Xyrtopul", []), ("a " * 50_000, []), ("groupe RV", []),
    ],
)
def test_meant(text, uids):
    assert register_of(PEOPLE, GROUPS).meant(text) == uids


def test_nearer_surname_does_not_hide_the_fitting_person(spark):
    """All surnames within reach count, in one list and in shards; the fewest slips in all decide."""
    people = [("v1", "M.", "Luc", "Martelvoine", None), ("v2", "Mme", "Héloïse", "Martalvaune", None), ("v3", "M.", "Luc", "Orbignasse", None)]
    reg = register_of(people, [])
    assert reg.scored("Héloïse Martelvoine") == (3, ["v2"]) and reg.scored("Mme Martelvoine") == (3, ["v2"]) and reg.scored("Martelvoine") == (0, ["v1"])
    e = spark.createDataFrame([(1, "Héloïse Martelvoine"), (2, "Martelvoine"), (3, "M. Martalvaune")], "entry_id bigint, text string")
    p = spark.createDataFrame(people, "uid string, civ string, prenom string, nom string, groupe_uid string")
    o = spark.createDataFrame(GROUPS, "uid string, libelle string, libelle_abrege string")
    for shards in (1, 2, 7):
        assert {r["entry_id"]: r["uids"] for r in canonical.match_entries(e, p, o, shards).collect()} == {1: ["v2"], 2: ["v1"], 3: ["v1"]}


def test_widening_circles_against_all_surnames_in_reach():
    rng = random.Random(7)
    people = [(f"w{i}", rng.choice(["M.", "Mme"]), "Anne", "".join(rng.choices("abe", k=rng.randint(5, 10))), None) for i in range(60)]
    reg = register_of(people, [])
    far = 0
    for _ in range(200):
        civ, name = rng.choice(["M.", "Mme"]), "".join(rng.choices("abe", k=rng.randint(5, 10)))
        near = {uid: d for uid, c, _, nom, _ in people if (d := plain(name, nom)) <= reach(min(len(name), len(nom))) and c == civ}
        least = min(near.values(), default=99)
        assert reg.scored(f"{civ} {name}") == (least, sorted(u for u, d in near.items() if d == least))
        far += 99 > least > 1 + min(plain(name, p[3]) for p in people)
    assert far


def test_long_entries_and_long_names(spark):
    note = "demande la parole sur le texte relatif aux transports collectifs dans les communes rurales"
    long = " ".join(["Abelorin", "de", "la", "Coste"] + ["Vautrebois", "du", "Plessard", "et", "Montrevel"] * 2)
    people = [*PEOPLE[:-1], ("u9", "Mme", "Rose", long, None)]
    e = {1: f"Jean-Marc Brisoquier {note}", 2: f"{note} Lorvinet Adrien", 3: f"{note} pour L. Gortambel {note}", 4: f"Zacharie Lorvinet {note}", 5: f"Louis Gortambel {note} Jean-Marc Brisoquier", 6: note, 7: f"Rose {long}", 8: f"Mme {long}x", 9: "a " * 20_000, 10: "§ " * 20_000 + "Brisoquier", 11: "x" * 100_000}
    want = {1: ["u1"], 2: ["u5"], 3: ["u6"], 4: [], 5: ["u1", "u6"], 6: [], 7: ["u9"], 8: ["u9"], 9: [], 10: ["u1"], 11: []}
    df = spark.createDataFrame(list(e.items()), "entry_id bigint, text string")
    p = spark.createDataFrame(people, "uid string, civ string, prenom string, nom string, groupe_uid string")
    o = spark.createDataFrame(GROUPS, "uid string, libelle string, libelle_abrege string")
    for shards in (None, 3):
        assert {r["entry_id"]: r["uids"] for r in canonical.match_entries(df, p, o, shards).collect()} == want
    # A label is no entry with a note: words around a name do not make it that person.
    assert register_of(people, GROUPS).meant(e[1]) == []


def test_match_entries_edges(spark):
    e = spark.createDataFrame([(1, "M. Brisoquier", 3), (1, "M. Brisoquier", 4), (2, None, 0), (None, "x", 0), (3, "Lorvinet", 0)], "entry_id bigint, text string, uid int")
    people = spark.createDataFrame([(*p, "x") for p in PEOPLE], "uid string, civ string, prenom string, nom string, groupe_uid string, text string")
    orgs = spark.createDataFrame(GROUPS, "uid string, libelle string, libelle_abrege string")
    want = {1: ["u1"], 2: [], 3: ["u4", "u5"]}
    for shards in (None, 3):
        assert {r["entry_id"]: r["uids"] for r in canonical.match_entries(e, people, orgs, shards).collect()} == want
    assert canonical.match_entries(e.limit(0), people, orgs).count() == 0
    assert {r["entry_id"]: r["uids"] for r in canonical.match_entries(e, people.limit(0), orgs).collect()} == {1: [], 2: [], 3: []}


@needs_data
def test_p3_found_is_consistent(spark):
    people = {a["uid"]: a for a in rows("acteurs")}
    got = p3_found(spark, DATA).collect()
    assert len({r[0] for r in got}) == len(got) > 30 and all(r[1] in people for r in got)


# Problem 1


def test_label_keys():
    reg = register_of(PEOPLE, GROUPS)
    same = [["SPEAKER_01", "spk1", "S1", " Locuteur 1 :", "speaker01."], ["M. le président", "LE PRÉSIDENT :", "Monsieur le president"], ["M. Brisoquier", "BRISOQUIER Jean-Marc", "M. BRISOQUIER (GU) :", "M. Brioquier"], ["M. le secrétaire d'État", "Le secrétaire d'État."]]
    keys = [{label_key(reg, x) for x in group} for group in same]
    assert all(len(k) == 1 for k in keys) and len(set.union(*keys)) == 4
    assert all(label_key(reg, x) is None for x in ["", None, " ", "?", "inconnu", "UNKNOWN", "null"])
    assert all(label_key(reg, x, True) is None for x in ["Je résume", "Dernier point", "Article 12", "Amendement 46", "12"])
    assert label_key(reg, "Mme Zorgueux", True) == label_key(reg, "mme zorgueux")


def frames(spark, segs):
    s = spark.createDataFrame(segs, "seg_id bigint, sitting_uid string, ord bigint, type string, speaker string, beg double, end double, text string, key string")
    people = spark.createDataFrame(PEOPLE, "uid string, civ string, prenom string, nom string, groupe_uid string")
    orgs = spark.createDataFrame(GROUPS, "uid string, libelle string, libelle_abrege string")
    hes = spark.createDataFrame([("euh", "hesitation"), ("hmm", "hesitation"), ("rires", "son"), (None, None)], "mot string, sorte string")
    return s.drop("ord"), people, orgs, hes


def seg(i, speaker, beg, text, sitting="s", kind="utterance", end=None):
    return (i, sitting, i, kind, speaker, beg, end, text, "clash")


def test_turn_rules(spark):
    segs = [
        seg(1, None, 0.0, "Avant tout label"), seg(2, "S1", 1.0, "Bonjour"), seg(2, "S1", 1.0, "Bonjour"), seg(3, "?", 2.0, "euuuh hmmm [rires] (03:12)"), seg(4, "inconnu", 3.0, "spk1 : la suite", end=5.0),
        seg(5, "", 3.0, "M. Brisoquier : RIRES"), seg(6, None, 40.0, "après une pause"), seg(7, "x", 41.0, None), seg(8, "S1", 42.0, "x", kind="interim"), seg(9, " ", 43.0, ">> M. Brisoquier – Merci.", end=1.0), seg(10, "Lorvinet", 44.0, "Je résume : oui"),
        seg(11, "S1", 5.0, "Ailleurs", "t"), seg(12, None, None, "sans temps"), seg(None, "S1", 1.0, "sans id"),
    ]
    parsed = turns.settle(turns.parse(*frames(spark, segs), text=True))
    out = turns.speaker_turns(parsed).collect()
    got = sorted((r["sitting_uid"], r["first_seg_id"], r["last_seg_id"], r["key"]) for r in out)
    assert got == [("s", 1, 1, None), ("s", 2, 4, "#1"), ("s", 6, 6, "#1"), ("s", 9, 9, "p:u1"), ("s", 10, 10, "a:u4|u5"), ("t", 11, 11, "#1")]
    by = {r["first_seg_id"]: r for r in out}
    assert by[2]["texts"] == ["Bonjour", "la suite"] and by[2]["end"] == 5.0 and by[9]["texts"] == ["Merci."] and by[9]["end"] is None
    assert turns.speaker_turns(parsed.limit(0)).count() == 0


def brute_turns(parsed):
    by = defaultdict(list)
    for r in parsed:
        by[r["sitting_uid"]].append(r)
    for s, group in by.items():
        group.sort(key=lambda r: (r["beg"], r["seg_id"]))
        key, cur = None, None
        for r in group:
            now = r["key"] or key
            if cur and now == key and r["beg"] - cur[2] <= 30:
                cur[1:] = [r["seg_id"], r["beg"]]
            else:
                if cur:
                    yield s, cur[0], cur[1]
                cur = [r["seg_id"], r["seg_id"], r["beg"]]
            key = now
        yield s, cur[0], cur[1]


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_turns_across_ranges(spark, parts):
    rng = random.Random(7)
    data, beg = [], 0.0
    for i in range(600):
        beg += rng.choice([0.0, 1.0, 5.0, 29.0, 31.0])
        data.append((rng.choice(["a", "a", "b"]), i, beg, rng.choice([None, None, None, "#1", "#2"])))
    df = spark.createDataFrame(data, "sitting_uid string, seg_id bigint, beg double, key string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sorted((r[0], r[2], r[3]) for r in turns.speaker_turns(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got == sorted(brute_turns([r.asDict() for r in df.collect()]))


@pytest.mark.parametrize("parts", ["2", "7", "40"])
def test_gaps_across_ranges_are_decoded_whole(spark, parts):
    """The inferred speakers do not depend on the number of ranges."""
    rng = random.Random(11)
    words = {"#1": ["digue", "canal", "rivage", "taux"], "#2": ["impôt", "budget", "taux", "canal"], "#3": ["forêt", "chêne", "budget", "taux"]}
    data = []
    for i in range(500):
        who, sitting = rng.choice(list(words)), rng.choice(["a", "a", None, "none"])
        data.append((sitting, i, float(i // 2), who if sitting != "none" and rng.random() < 0.1 else None, " ".join(rng.choices(words[who], k=2))))
    df = spark.createDataFrame(data, "sitting_uid string, seg_id bigint, beg double, key string, text string")
    old, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", parts):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got.append(sorted(((r[0] or "", r["key"] or "", r["first_seg_id"], r["last_seg_id"]) for r in turns.speaker_turns(df, True).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == got[1]
    assert {k for s, k, *_ in got[0] if s == "none"} == {""} and {k for s, k, *_ in got[0] if s != "none"} == set(words)


@needs_data
def test_p1_found(spark):
    t = lambda n: table(spark, DATA, n)
    parsed = [r.asDict() for r in turns.settle(turns.parse(t("segments"), t("acteurs"), t("organes"), t("hesitations"))).collect()]
    assert sorted(tuple(r) for r in p1_found(spark, DATA).collect()) == sorted(brute_turns(parsed)) and parsed


def test_viterbi_against_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    for left, right in (((0, 2), (1, 3)), ((2, 11), (2, 4)), ((2, 1), None), (None, (0, 1)), (None, None)):
        e, share, dur = rng.normal(size=(6, 3)) * 0.7, np.log(rng.dirichlet([2, 2, 2])), turns.Durations(rng.integers(0, 30, turns.LONGEST_RUN).tolist())
        keep, leave = (lambda n, x=x, d=dur: x[d.at(n)] for x in (dur.keep, dur.leave))

        def score(path, e=e, left=left, right=right, share=share, keep=keep, leave=leave):
            total, (now, run) = sum(e[i, s] for i, s in enumerate(path)), left or (None, 0)
            for s in [*path, *([right[0]] * right[1] if right else [])]:
                if s == now:
                    total, run = total + keep(run), run + 1
                else:
                    total += share[s] + (leave(run) if now is not None else 0)
                    now, run = s, 1
            return total + (leave(run) if right else 0)

        paths = list(itertools.product(range(3), repeat=6))
        got = tuple(turns.viterbi(e, share, left, right, dur))
        assert got in paths and score(got) == pytest.approx(max(map(score, paths)))


def test_durations_and_weight(spark):
    d = turns.Durations([0] * turns.LONGEST_RUN)
    assert np.isfinite(d.keep).all() and np.isfinite(d.leave).all()
    rng = random.Random(9)
    rows = [("a", i, float(i), f"#{i // 4 % 3}", " ".join(rng.choices("un deux trois quatre cinq six".split(), k=3))) for i in range(400)]
    df = spark.createDataFrame(rows, "sitting_uid string, seg_id bigint, beg double, key string, text string").withColumn("words", turns.features(F.col("text"))).withColumn("_pid", F.floor(F.col("seg_id") / 130).cast("int"))
    m = turns.Inference(df)
    # All runs have four segments, those cut by a range too; the words say nothing.
    assert m.weight < 0.5 and np.exp(m.durations.keep[:3]).min() > 0.98 and np.exp(m.durations.leave[3]) > 0.98


def test_hidden_markov_beats_carrying_on(spark):
    """Held-out labels: two speakers with words of their own; the profiles find who speaks."""
    rng = random.Random(4)
    words = {"#1": ["digue", "canal", "rivage", "écluse"], "#2": ["impôt", "budget", "taux", "crédit"]}
    data, truth, now = [], {}, "#1"
    for i in range(800):
        now = now if rng.random() < 0.7 else ("#2" if now == "#1" else "#1")
        truth[i] = now
        data.append(("s", i, float(i), now if rng.random() < 0.6 else None, " ".join(rng.choices(words[now], k=4))))
    df = spark.createDataFrame(data, "sitting_uid string, seg_id bigint, beg double, key string, text string")
    out = {}
    for r in turns.speaker_turns(df, True, pause=0.5).collect():  # each segment is its own turn
        out[r["first_seg_id"]] = r["key"]
    hidden = [d[1] for d in data if d[3] is None]
    right = np.mean([out[i] == truth[i] for i in hidden])
    held, now = [], None
    for d in data:
        now = d[3] or now
        held += [now == truth[d[1]]] if d[3] is None else []
    assert right > 0.97 > np.mean(held) + 0.1
    assert all(out[d[1]] == d[3] for d in data if d[3])


@needs_data
def test_held_out_labels(spark):
    got = p1_heldout(spark, "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else DATA).collect()[0]
    assert got["hidden"] > 100 and got["inferred"] > got["carried"]


def test_labels_against_a_list_in_shards(spark):
    labels = spark.createDataFrame([("M. Brisoquier", False), ("Lorvinet", False), ("Mme Zorgueux", True), ("S1", False), ("?", False), ("Je résume", True), ("Lorvinet (RV)", False)], "label string, strict boolean")
    people = spark.createDataFrame(PEOPLE, "uid string, civ string, prenom string, nom string, groupe_uid string")
    orgs = spark.createDataFrame(GROUPS, "uid string, libelle string, libelle_abrege string")
    got = [{(r["label"], r["key"]) for r in turns.resolve_labels(labels, people, orgs, n).collect()} for n in (1, 2, 7)]
    assert got[0] == got[1] == got[2] and ("Lorvinet", "a:u4|u5") in got[0] and ("Lorvinet (RV)", "p:u5") in got[0]


@pytest.mark.parametrize("parts", ["2", "9"])
def test_p1_found_decides_between_bearers_of_a_label(spark, tmp_path, parts):
    """A label that fits two participants is the one whom the hidden Markov model finds, in p1_found itself."""
    rng = random.Random(5)
    who = {"Mme Anne Lorvinet": ["digue", "canal", "rivage", "écluse"], "M. Adrien Lorvinet": ["impôt", "budget", "taux", "crédit"], "S1": ["forêt", "chêne"]}
    data, truth, now = [], {}, "S1"
    for i in range(300):
        now = now if rng.random() < 0.7 else rng.choice(list(who))
        bare = now != "S1" and rng.random() < 0.3
        truth[i] = now
        data.append(seg(i, "Lorvinet" if bare else None if i and truth[i - 1] == now and rng.random() < 0.3 else now, float(i), " ".join(rng.choices(who[now], k=5))))
    data.append(seg(900, "Lorvinet", 1.0, "digue", "nobody named"))
    segments, people, orgs, hes = frames(spark, data)
    for name, df in (("segments", segments.drop("key")), ("acteurs", people), ("organes", orgs), ("hesitations", hes)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    starts = [i for i in truth if not i or truth[i] != truth[i - 1]]
    want = {("s", a, z - 1) for a, z in zip(starts, [*starts[1:], 300], strict=True)} | {("nobody named", 900, 900)}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert {tuple(r) for r in p1_found(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


# Problem 6


def test_pack_histogram():
    rng = random.Random(8)
    for _ in range(30):
        cap = rng.choice([10, 37, 2048])
        hist = {rng.randint(1, cap): rng.randint(1, 500) for _ in range(rng.randint(0, 40))}
        packs = packing.pack_histogram(hist, cap)
        got = Counter()
        for n, pattern in packs:
            assert n > 0 and sum(k * m for k, m in pattern.items()) <= cap
            for k, m in pattern.items():
                got[k] += n * m
        assert got == Counter(hist)
        bound = -(-sum(k * n for k, n in hist.items()) // cap)
        assert sum(n for n, _ in packs) <= bound * 1.7 + 1


@needs_data
def test_p6(spark):
    enc, _ = encoder()
    docs = rows("documents")
    size = {d["doc_id"]: len(enc.encode_ordinary(d["text"] or "")) for d in docs}
    assert {r[0] for r in p6_found(spark, DATA).collect()} == {k for k, n in size.items() if n > 2048}
    placed = packing.pack(table(spark, DATA, "documents"))
    held = packing.containers(placed).collect()
    parts = defaultdict(list)
    for c in held:
        assert c["fill"] == sum(x["length"] for x in c["documents"]) <= 2048
        for x in c["documents"]:
            parts[x["doc_id"]].append(x["length"])
    assert {k: sum(v) for k, v in parts.items()} == size
    assert all(len(v) == max(1, -(-size[k] // 2048)) for k, v in parts.items())
    assert len(held) <= 1.03 * sum(size.values()) / 2048 + 1


def test_p6_edges(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (1, ""), (None, "mot")], "doc_id bigint, text string").withColumn("length", F.lit("x")).withColumn("container_id", F.lit(3))
    assert sorted((r["doc_id"], r["length"]) for r in packing.pack(df.where("doc_id is not null")).collect()) == [(1, 0), (1, 0), (2, 0)]
    assert packing.pack(df).count() == 4 and packing.pack(df.limit(0)).count() == 0
    big = spark.createDataFrame([(9, "mot " * 30_000)], "doc_id bigint, text string")
    assert packing.pack(big).agg(F.sum("length")).collect()[0][0] > 2048 * 10


# Problem 7


@needs_data
def test_p7(spark):
    enc, _ = encoder()
    have = Counter()
    targets = {t["source"]: t for t in rows("mix_targets")}
    for d in rows("documents"):
        if d["source"] in targets:
            have[d["source"]] += len(enc.encode_ordinary(d["text"] or ""))
    total = sum(have.values())
    want = {s for s, t in targets.items() if t["max_uses"] * have[s] < t["target_share"] * total}
    assert {r[0] for r in p7_found(spark, DATA).collect()} == want
    m = mixing.mix(table(spark, DATA, "documents"), table(spark, DATA, "mix_targets"))
    report = {r["source"]: r for r in m.report.collect()}
    assert {s: r["tokens"] for s, r in report.items()} == {s: have[s] for s in targets}
    assert all(r["uses"] <= targets[r["source"]]["max_uses"] for r in m.uses.collect())


def test_p7_shares_are_met(spark):
    sizes = {"a": 6000, "b": 600, "c": 50}
    docs = [(i, "mot " * (i % 17), ["fr", "en", None][i % 3], s, 0) for s, n in sizes.items() for i in range(hash(s) % 7, n)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, uses int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 10), ("c", 0.08, 1), ("d", 0.02, 3), (None, 0.5, 1)], "source string, target_share double, max_uses int")
    m = mixing.mix(df, targets)
    r = {x["source"]: x for x in m.report.collect()}
    total = sum(x["tokens"] for x in r.values())
    assert abs(r["a"]["used_tokens"] / total - 0.5) < 0.02 and abs(r["b"]["used_tokens"] / total - 0.4) < 0.02
    assert r["c"]["used_tokens"] == r["c"]["tokens"] and not r["c"]["feasible"] and not r["d"]["feasible"]
    assert m.uses.where("source = 'b'").agg(F.max("uses")).collect()[0][0] <= 10
    assert mixing.mix(df.limit(0), targets).uses.count() == 0 and mixing.mix(df, targets.limit(0)).report.count() == 0


def test_p7_given_margins_and_raking_as_a_table(spark):
    rng = random.Random(12)
    docs = [(i, "mot " * rng.randint(1, 30), rng.choice(["fr", "en"]), rng.choice("aab"), rng.choice(["x", "y", None])) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, theme string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.5, 3)], "source string, target_share double, max_uses int")
    out = []
    for cells in (mixing.DRIVER_CELLS, 1):
        m = mixing.mix(df, targets, lang_shares={"fr": 0.3, "en": 0.7}, topic_shares={"x": 0.6, "y": 0.2, "other": 0.2}, topic="theme", driver_cells=cells)
        used = m.uses.join(df.select("doc_id", "lang", F.coalesce("theme", F.lit("other")).alias("theme")), "doc_id").withColumn("w", F.col("tokens") * F.col("uses"))
        total = used.agg(F.sum("w")).collect()[0][0]
        for column, want in (("lang", {"fr": 0.3, "en": 0.7}), ("theme", {"x": 0.6, "y": 0.2, "other": 0.2}), ("source", {"a": 0.5, "b": 0.5})):
            got = {r[0]: r[1] / total for r in used.groupBy(column).agg(F.sum("w")).collect()}
            assert all(abs(got[k] - v) < 0.03 for k, v in want.items())
        assert {r["source"]: r["used_tokens"] for r in m.report.collect()} == {r[0]: r[1] for r in used.groupBy("source").agg(F.sum("w")).collect()}
        out.append({(r["doc_id"], r["uses"]) for r in m.uses.collect()})
    assert len(out[0] ^ out[1]) < 0.02 * len(out[0])


def test_topics_find_word_groups():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, 40).tolist() for _ in range(100)] + [rng.integers(500, 550, 40).tolist() for _ in range(100)] + [[]]
    model = mixing.TopicModel.fit(np.array([mixing.bag(t) for t in texts], float), 2)
    at = [model.topic(t) for t in texts]
    assert len(set(at[:100])) == len(set(at[100:200])) == 1 and at[0] != at[100] and at[200] == -1
    assert mixing.TopicModel.fit(np.zeros((0, mixing.TOPIC_FEATURES))).topic([1]) == -1


@pytest.mark.parametrize("parts", [1, 5])
def test_topics_are_fitted_on_all_documents(spark, parts):
    """The model over a table is that of all its texts in memory, however the rows are cut."""
    rng = random.Random(21)
    words = ["digue canal rivage écluse port".split(), "impôt budget taux crédit dette".split(), "forêt chêne sève racine tronc".split()]
    texts = ["", None] + [" ".join(rng.choices(words[i % 3 if i % 50 else 2], k=rng.randint(1, 12))) for i in range(6000)]
    enc, _ = encoder()
    want = mixing.TopicModel.fit(np.array([mixing.bag(enc.encode_ordinary(t or "")) for t in texts], float))
    df = spark.createDataFrame([(i % 5000, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(parts)
    bags = mixing.measure(df, "doc_id bigint")
    got = mixing.fit_topics(bags)
    assert len(got.centres) == mixing.TOPICS and np.array_equal(got.weight, want.weight) and np.allclose(got.centres, want.centres, atol=1e-9)
    topics = Counter(r[0] for r in mixing.assign(bags, got).select("topic").collect())
    assert topics == Counter(str(want.topic(enc.encode_ordinary(t or ""))) for t in texts) and topics["-1"] == 2


def test_topics_of_few_or_like_documents(spark):
    for texts, n in (([], 0), (["", None], 0), (["mot"] * 40, 1), (["mot", "digue", ""], 2)):
        model = mixing.fit_topics(mixing.measure(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"), "doc_id bigint"))
        assert len(model.centres) == n and np.isfinite(model.centres).all()


# Problem 8


def check_pieces(text, pieces, limit=512, overlap=64):
    enc, _ = encoder()
    ids = enc.encode_ordinary(text)
    pieces = sorted(pieces, key=lambda r: r["piece_no"])
    assert [p["piece_no"] for p in pieces] == list(range(len(pieces)))
    assert pieces[0]["first_token"] == 0 and pieces[-1]["last_token"] == len(ids)
    for p in pieces:
        assert 0 < p["n_tokens"] <= limit
        assert enc.decode_bytes(ids[p["first_token"] : p["last_token"]]).decode() == p["text"]
    for a, b in zip(pieces, pieces[1:], strict=False):
        assert overlap <= a["last_token"] - b["first_token"] <= overlap + 3 and b["last_token"] > a["last_token"]


@needs_data
def test_p8(spark):
    enc, _ = encoder()
    docs = {d["doc_id"]: d["text"] or "" for d in rows("documents")}
    large = {k for k, t in docs.items() if len(enc.encode_ordinary(t)) > 512}
    assert {r[0] for r in p8_found(spark, DATA).collect()} == large
    by = defaultdict(list)
    for r in p8_pieces(spark, DATA).collect():
        by[r["doc_id"]].append(r)
    assert set(by) == large
    for k, pieces in by.items():
        check_pieces(docs[k], pieces)


def test_p8_shapes(spark):
    rng = random.Random(9)
    texts = [
        "Une phrase assez courte. " * 400, "mot" * 4000, "日本語の文章です。" * 300, "🙂" * 900, "é\n\n" * 700, "a\r\n" * 2000, " " * 9000, "\n" * 3000, "x " * 600 + "\n\n" + "y " * 600, "€" * 2000,
        "".join(rng.choices("aé日🙂. \n,;!?M", k=6000)), "", None, "court", "l " * 60_000,
    ]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, signs string, key int")
    by = defaultdict(list)
    for r in splitting.split(df).collect():
        by[r["doc_id"]].append(r)
    enc, _ = encoder()
    assert set(by) == {i for i, t in enumerate(texts) if t and len(enc.encode_ordinary(t)) > 512}
    for i, pieces in by.items():
        check_pieces(texts[i], pieces)
    assert max(by[0], key=lambda r: -r["piece_no"])["text"].rstrip().endswith(".")
    assert sorted(by[8], key=lambda r: r["piece_no"])[0]["n_tokens"] <= 512
    assert splitting.split(df.limit(0)).count() == 0


def test_p8_prefers_paragraphs(spark):
    text = "\n\n".join("Ceci est une phrase. En voici une autre." * 4 for _ in range(40))
    pieces = splitting.split(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("piece_no").collect()
    check_pieces(text, pieces)
    assert all(p["text"].endswith("\n\n") for p in pieces[:-1])
    assert re.match(r"^\^\.\{1,512\}\$\|", splitting.piece_pattern(512, 64))
