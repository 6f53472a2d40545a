"""Text rules, resolution, trees and intervals on small cases of our own; the entry points."""

import random

import pytest

import __spark_entry__
from filament.functions import resolve as R, text as T
from filament.operators.intervals import overlap_argmax, window_density
from filament.operators.ranges import greedy_gap
from filament.operators.trees import walk
from filament.plans.text import corrections
from filament.plans.thread import canonical_text


def apply(spark, texts, f):
    df = spark.createDataFrame([(i, *(t if isinstance(t, tuple) else (t,))) for i, t in enumerate(texts)], "i int, a string" + (", b string, c string" if isinstance(texts[0], tuple) else ""))
    return [r[0] for r in df.orderBy("i").select(f(df).alias("x")).collect()]


def test_amendment_numbers(spark):
    texts = ["L'amendement 125 à l'article 7", "Scrutin sur le 0012 et le 12", "Il est 14 heures", "amendement 6 à l'article 6", None, "", "Aux voix : 7, 8, 7 et 12345"]
    assert apply(spark, texts, lambda d: T.amendment_numbers(d.a)) == [[125], [12], [], [], None, [], [7, 8]]


def test_names_and_ballots(spark):
    assert apply(spark, ["Merci, madame Élise Tournefeu-Brac et M. le Prévert", "personne", None, "Mme d'Orvault"], lambda d: T.speaker_names(d.a)) == [["madame Élise Tournefeu-Brac", "M. le Prévert"], [], None, []]
    texts = ["Le scrutin est ouvert.", "Il n'est pas adopté.", "L'amendement est rejeté", "Ils sont adoptés.", "Je mets aux voix l'article", "Bonjour", None]
    assert apply(spark, texts, lambda d: T.ballot_event(d.a)) == ["open", "rejected", "rejected", "adopted", "vote", None, None]


def test_calls(spark):
    cases = [
        ("La parole est à M. Brun.", "M. Brun", ""), ("M. Brun, pour le groupe Rivages.", "M. Brun", ""), ("L'amendement 12 de M. Brun", "M. Brun", ""), ("J'ai fini. M. Brun.", "M. Brun", ""), ("Comme M. Brun le disait", "M. Brun", ""),
        ("M. Brun.", "M. Brun", "Sur ce point la parole est à"), ("M. Brun.", "M. Brun", "Sur ce point."), ("Rien", "M. Brun", ""),
    ]
    assert apply(spark, cases, lambda d: T.speaker_call(d.a, d.b, d.c)) == ["strong", "strong", "strong", "weak", "none", "strong", "weak", "none"]


def test_normalising(spark):
    assert apply(spark, ["M. Éloïse  d'Avril-Noé 3", None, "", "ŠOLC"], lambda d: T.normalize_name(d.a)) == ["m eloise d avril-noe", "", "", "solc"]
    assert apply(spark, ["Mme la ministre Anne Anne", None], lambda d: T.name_tokens(d.a)) == [["anne", "anne"], []]
    assert apply(spark, ["M. Paul Tarbis", "Mme", ""], lambda d: T.noisy_name(d.a)) == ["Paul Tarbs", "Mm", ""]
    assert apply(spark, ["a.json", "../x", ".x", "a/b", ""], lambda d: T.safe_name(d.a)) == [True, False, False, False, False]


def test_replies(spark):
    got = apply(spark, ["```text\nUn.\nDeux.\n```", "Un.\nNOTES :\n- doute\n• autre\n", "  ", None], lambda d: T.corrected_reply(d.a))
    assert [None if g is None else (g["text"], g["notes"]) for g in got] == [("Un.\nDeux.", []), ("Un.", ["doute", "autre"]), None, None]


PEOPLE = [("1", "Jeanne", "Brulat"), ("2", "Paul", "Brulet"), ("3", "Anne", "Tournefeu"), ("4", "Luc", "Tournefeu")]


@pytest.mark.parametrize("shards", [None, 1, 3])
def test_resolve_names(spark, shards):
    want = {"madame Jeanne Brulat": "1", "Jeanne Brulatt": "1", "M. Brulat": "1", "M. Brulit": None, "Tournefeu": None, "Anne Tournefeu": "3", "le ministre": None, "Xyz": None, None: None, "": None}
    people = spark.createDataFrame([*PEOPLE, (None, "x", "y")], "uid string, prenom string, nom string")
    names = spark.createDataFrame([(n, 1) for n in [*want, "Xyz"]], "heard string, uid int")
    got = {r["heard"]: (r["uid"], r["score"], r["shown"]) for r in R.resolve_names(names, "heard", people, shards=shards).collect()}
    assert {k: v[0] for k, v in got.items()} == want and got["madame Jeanne Brulat"][1:] == (1.0, "1.00") and got["Xyz"] == (None, None, None)
    assert {r["uid"] for r in R.resolve_names(names, "heard", people.limit(0)).collect()} == {None} and R.resolve_names(names.limit(0), "heard", people).count() == 0


def test_matcher_against_all_ratios():
    from difflib import SequenceMatcher

    rng = random.Random(8)
    people = [(str(i), "".join(rng.choices("abeln", k=rng.randint(3, 9)))) for i in range(80)]
    m = R.Matcher([(u, n, n) for u, n in people])
    some = 0
    for _ in range(300):
        q = "".join(rng.choices("abeln", k=rng.randint(1, 9)))
        scored = [(SequenceMatcher(None, q, n).ratio(), u) for u, n in people]
        best = max(scored)[0]
        near = {u for r, u in scored if r >= best - 0.05}
        want = (near.pop(), round(best, 3)) if best >= 0.72 and len(near) == 1 else (None, None)
        assert m.resolve([q]) == want
        some += want[0] is not None
    assert some > 5


def plain_errors(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_word_errors_and_realign():
    assert R.word_errors("a b c d".split(), "a x c".split()) == (1, 1, 0) and R.word_errors([], ["a"]) == (0, 0, 1) and R.word_errors([], []) == (0, 0, 0)
    rng = random.Random(3)
    for _ in range(100):
        a, b = (rng.choices("abc", k=rng.randint(0, 9)) for _ in range(2))
        s, d, i = R.word_errors(a, b)
        assert s + d + i == plain_errors(a, b) and i - d == len(b) - len(a)
    seqs, texts = [4, 7, 9], ["nous voulons la", "réforme des ports", "merci"]
    assert R.realign(seqs, texts, "nous voulons la réforme des ports\nmerci") == [([4, 7], "nous voulons la réforme des ports")]
    assert R.realign(seqs, texts, "nous voulons la\nréforme des porcs\nmerci") == [([7], "réforme des porcs")]
    assert R.realign(seqs, texts, "nous voulons la\nréforme des ports\nune ligne inventée\nmerci") == []
    assert R.realign(seqs, texts, "nous\nvoulons la\nréforme des ports") == []
    assert R.realign(seqs, texts, "") == [] and R.realign([], [], "x") == []
    assert R.realign([1, 2], ["un deux trois", "quatre"], "un deux\ntrois quatre") == [([1, 2], "un deux trois quatre")]


def test_corrections_keep_flags_and_drop_failed_windows(spark):
    windows = spark.createDataFrame([("a", 0, [(1, "nous voulons"), (2, "la réforme")]), ("a", 1, [(3, "panne")]), ("a", 2, [(4, "vide")]), ("a", 3, [(5, "inchangé")])], "sitting_uid string, win int, targets array<struct<ord: bigint, text: string>>")

    def reply(texts):
        if texts == ["panne"]:
            raise OSError("no answer")
        return {"nous voulons": "```\nnous voulons la réforme\nNOTES:\n- un nom douteux\n```", "vide": " ", "inchangé": "inchangé\nNOTES : à voir"}[texts[0]]

    got = sorted((r["win"], r["seqs"], r["text"], r["flags"]) for r in corrections(windows, reply).collect())
    assert got == [(0, [1, 2], "nous voulons la réforme", ["un nom douteux"]), (3, None, None, ["à voir"])]


def test_routes(spark):
    paths = ["/derouleur.json", "/amendement.do", "/referential/acteurs.json", "/referential/a/b.json", "/ground-truth/tree", "/ground-truth/data.nvs", "/ground-truth/", "/x", "", None]
    got = apply(spark, paths, lambda d: T.route(d.a))
    assert [g and (g["name"], g["causal"]) for g in got] == [("derouleur", True), ("eliasse", True), ("referential", False), None, ("tree", False), ("ground-truth", False), None, None, None, None]
    assert apply(spark, ["Amendement n° 46 rect.", "n°7", "sans", None], lambda d: T.label_number(d.a)) == ["46", "7", None, None]


def test_walk(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("c", "a", 1), ("d", "c", 1), ("lost", "none", 1), ("x", "y", 1), ("y", "x", 1)], "id string, parent string, ord int")
    rows = sorted(walk(df).collect(), key=lambda r: r["path"])
    assert [(r["id"], r["depth"], r["chain"]) for r in rows] == [("a", 0, ["a"]), ("c", 1, ["a", "c"]), ("d", 2, ["a", "c", "d"]), ("b", 1, ["a", "b"])]
    assert walk(df.limit(0)).count() == 0


def test_intervals_against_loops(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.choice("pq"), i, b, b + rng.choice([0.0, 1.0, 40.0]), rng.choice("xy")) for i in range(n) for b in [rng.uniform(0, 200)]]
    left, right = make(60), [*make(40), ("p", 900, -50.0, 5000.0, "x"), ("q", 901, 100.0, 1e9, "y"), ("q", 902, None, 5.0, "y"), ("q", 903, 1.0, float("inf"), "y")]
    left += [("p", 800, 10.0, 700.0, "y")]
    schema = "part string, id int, beg double, end double, who string"
    got = {r["id"]: r["overlap"] for r in overlap_argmax(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "part", "id", "who", "id").collect()}
    for p, i, b, e, _ in left:
        best = max((min(e, y) - max(b, x) for q, _, x, y, _ in right if q == p and x is not None and y < 1e12 and min(e, y) > max(b, x)), default=None)
        assert got[i] == (best if best is None else pytest.approx(best))
    dense = {r["id"]: r["voiced"] for r in window_density(spark.createDataFrame(left, schema), "part", "id", 30.0).collect()}
    for p, i, b, _, _ in left:
        assert dense.get(i, 0) == pytest.approx(sum(max(0.0, min(y, b + 30) - max(x, b)) for q, _, x, y, _ in left if q == p))


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_greedy_gap_across_ranges(spark, parts):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "b", None]), rng.choice([None, *[rng.uniform(0, 400)] * 9])) for _ in range(700)]
    want, last = [], {}
    for p, v in sorted({r for r in rows if r[1] is not None}, key=lambda r: r[1]):
        if p not in last or v >= last[p] + 3.0:
            want.append((p, v))
            last[p] = v
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in greedy_gap(spark.createDataFrame(rows, "p string, v double"), "p", "v", 3.0).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert greedy_gap(spark.createDataFrame([], "p string, v double"), "p", "v", 3.0).count() == 0


def test_canonical_text():
    a = '{"racine": {"jaune": {"id": "1", "extract_date_time": "x"}, "contenu": {"phase": [{"n": 1.5}, null, true]}}}'
    b = '{"racine":{"contenu":{"phase":[{"n":1.5},null,true]},"jaune":{"jaune_date_time":"y","id":"1"}}}'
    assert canonical_text(a) == canonical_text(b) == "$.racine.contenu.phase[0].n=1.5\n$.racine.contenu.phase[2]=true\n$.racine.jaune.id=1"
    assert canonical_text("damaged {") == "damaged {" and canonical_text(None) is None and canonical_text("[]") == ""


def test_entry_points():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70
    assert all(f"p{n}_found" in queries for n in (2, 4, 5))
