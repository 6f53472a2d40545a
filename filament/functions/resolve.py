"""Names against a reference list: similarity, top-1 with refusal of near ties, hints, word errors, realignment.

Similarity is the Ratcliff-Obershelp ratio of the standard library. Names are normalised by the column
rules of ``text`` before they come here.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from filament.functions import text as T
from filament.operators.changefeed import components
from filament.runtime import durable, spread

#: A reference list of up to so many entries is broadcast; beyond it names meet it in shards.
MAX_REFERENCE = 100_000
#: The least similarity, and how near a second person must come to make a tie (one word, several).
THRESHOLD, BANDS = 0.72, (0.05, 0.02)


class Names:
    """Names indexed by length and letters, which bound the ratio from above."""

    def __init__(self, uids: list[str], names: list[str]):
        order = sorted(range(len(names)), key=lambda i: len(names[i]))
        self.uids, self.names = [uids[i] for i in order], [names[i] for i in order]
        self.lengths = np.array([len(n) for n in self.names])
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(names))))}
        self.counts = np.array([self._count(n) for n in self.names], np.int32).reshape(len(names), len(self.letters))

    def _count(self, name: str) -> np.ndarray:
        return np.bincount([self.letters[c] for c in name if c in self.letters], minlength=len(self.letters))

    def best(self, q: str, band: float, threshold: float) -> list[tuple[float, str]]:
        """The best ratio with its uid, and the next best of another uid, as far as they matter."""
        found: dict[str, float] = {}
        if not q or not self.names:
            return []
        # Of names as long as this the ratio can reach the threshold less the band at all.
        least = threshold - band
        low, high = np.searchsorted(self.lengths, [len(q) * least / (2 - least) - 1e-9, len(q) * (2 - least) / least + 1e-9])
        shared = np.minimum(self.counts[low:high], self._count(q)).sum(1)
        bound = 2.0 * shared / (self.lengths[low:high] + len(q))
        top = 0.0
        for k in np.argsort(-bound, kind="stable"):
            if bound[k] < max(threshold, top) - band - 1e-9:
                break
            r = SequenceMatcher(None, q, self.names[low + k]).ratio()
            uid = self.uids[low + k]
            found[uid] = max(found.get(uid, 0.0), r)
            top = max(top, r)
        return sorted(((r, u) for u, r in found.items() if r >= top - band), key=lambda x: (-x[0], x[1]))[:2]


class Matcher:
    """Top-1 by ratio over (uid, surname, full name), normalised: one word against surnames, more against full names."""

    def __init__(self, people: list[tuple[str, str, str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        uids = [p[0] for p in people]
        self.lists = (Names(uids, [p[1] for p in people]), Names(uids, [p[2] for p in people]))

    def best(self, words: list[str]) -> list[tuple[float, str]]:
        several = len(words) > 1
        return self.lists[several].best(" ".join(words), BANDS[several], self.threshold) if words else []

    def resolve(self, words: list[str]) -> tuple[str | None, float | None]:
        """(uid, score rounded to 3 places) of name words; nulls for no words, nobody close, or several too close."""
        return settle(self.best(words), len(words) > 1, self.threshold)


def settle(best: list[tuple[float, str]], several: bool, threshold: float) -> tuple[str | None, float | None]:
    """The person of a ranking, unless nobody is close enough or another is too close to the best."""
    if not best or best[0][0] < threshold or len({u for r, u in best if r >= best[0][0] - BANDS[several]}) > 1:
        return None, None
    return best[0][1], round(best[0][0], 3)


def resolve_names(names: DataFrame, column: str, people: DataFrame, threshold: float = THRESHOLD, shards: int | None = None) -> DataFrame:
    """(heard, uid, score, shown) of every distinct name; ``shown`` is the score with two decimals. A null name stays unresolved; no people, no uids.

    The list is counted: up to ``MAX_REFERENCE`` it is broadcast, beyond it is hashed into shards that
    every name visits, and of each shard's two best persons the best of all are settled.
    """
    spark = names.sparkSession
    listed = people.where("uid is not null").select("uid", T.normalize_name(F.col("nom")).alias("one"), T.normalize_name(F.concat_ws(" ", F.coalesce("prenom", F.lit("")), F.coalesce("nom", F.lit("")))).alias("more")).distinct()
    asked = names.select(F.col(column).cast("string").alias("heard")).distinct().withColumn("words", T.name_tokens(F.col("heard")))
    shards = shards or max(1, -(-listed.count() // MAX_REFERENCE))

    def rank(matcher: Matcher, b: pa.RecordBatch | pa.Table) -> list[list[dict]]:
        return [[{"score": r, "uid": u} for r, u in matcher.best(w)] for w in b.column("words").to_pylist()]

    kind = pa.list_(pa.struct([("score", pa.float64()), ("uid", pa.string())]))
    schema = "heard string, words array<string>, best array<struct<score: double, uid: string>>"
    if shards == 1:
        held = spark.sparkContext.broadcast(sorted(tuple(r) for r in listed.collect()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, threshold)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rank(matcher, b), kind)], names=["heard", "words", "best"])

        ranked = spread(asked, "heard").mapInArrow(run, schema)
    else:
        asked = durable(asked.withColumn("block", F.pmod(F.xxhash64("heard"), F.lit(spark.sparkContext.defaultParallelism))), "asked")
        blocks = spark.sparkContext.defaultParallelism
        left = listed.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
        right = asked.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

        def cell(persons: pa.Table, q: pa.Table) -> pa.Table:
            matcher = Matcher(sorted(zip(*(persons.column(c).to_pylist() for c in ("uid", "one", "more")), strict=True)), threshold)
            return pa.table({"heard": q.column("heard"), "words": q.column("words"), "best": pa.array(rank(matcher, q), kind)})

        cells = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, schema)
        ranked = cells.groupBy("heard").agg(F.first("words").alias("words"), F.flatten(F.collect_list("best")).alias("best"))  # two a shard

    @F.pandas_udf("uid string, score double, shown string")
    def one(words: pd.Series, best: pd.Series) -> pd.DataFrame:
        rows = [settle(sorted(((x["score"], x["uid"]) for x in b), key=lambda x: (-x[0], x[1])), len(w) > 1, threshold) for w, b in zip(words, best, strict=True)]
        out = pd.DataFrame(rows, columns=["uid", "score"]).astype({"uid": object, "score": float})
        return out.assign(shown=[None if u is None else f"{r:.2f}" for u, r in rows])

    return ranked.withColumn("r", one(F.coalesce("words", F.array().cast("array<string>")), "best")).select("heard", "r.uid", F.when(F.col("r.uid").isNotNull(), F.col("r.score")).alias("score"), "r.shown")


def word_errors(reference: list[str], heard: list[str]) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of a least edit of ``reference`` into ``heard``; row by row in numpy."""
    place: dict[str, int] = {}
    a, b = (np.array([place.setdefault(w, len(place)) for w in x], np.int64) for x in (reference, heard))
    n, m = len(a), len(b)
    steps = np.arange(m + 1)
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = steps
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(cost[i - 1, 1:] + 1, cost[i - 1, :-1] + (b != a[i - 1]))
        # Insertions come from the left: the least of what stands there and the way from it.
        cost[i] = np.minimum.accumulate(row - steps) + steps
    s = d = k = 0
    i, j = n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            s += int(a[i - 1] != b[j - 1])
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            k, j = k + 1, j - 1
    return s, d, k


def wer(reference: Column, heard: Column) -> Column:
    """struct(s, d, i, n): word errors of two normalised texts and the reference's words."""

    @F.pandas_udf("s int, d int, i int, n int")
    def errors(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(a, b, strict=True):
            ref = (x or "").split()
            out.append((*word_errors(ref, (y or "").split()), len(ref)))
        return pd.DataFrame(out, columns=["s", "d", "i", "n"], dtype="int32")

    return errors(reference, heard)


def _origins(before: list[str], after: list[str]) -> np.ndarray:
    """For every word of ``after`` the place in ``before`` it comes from, -1 for a new one.

    Between two stretches that agree, words that stand opposite each other are tied in proportion.
    """
    origin = np.full(len(after), -1)
    x = y = 0
    for i, j, size in SequenceMatcher(None, before, after).get_matching_blocks():
        if i > x and j > y:
            origin[y:j] = x + np.arange(j - y) * (i - x) // (j - y)
        origin[j : j + size] = np.arange(i, i + size)
        x, y = i + size, j + size
    return origin


def realign(seqs: list[int], texts: list[str], corrected: str) -> list[tuple[list[int], str]]:
    """Maps a corrected, re-cut paragraph onto the utterances it came from.

    Every word of the correction comes from a word of an utterance or from none, which ties its line to
    that utterance; what is tied together is one segment. Segments come in reading order; invented
    lines and utterances that stay as they were give none; an utterance whose words all went keeps its
    own text.
    """
    lines = [x.strip() for x in corrected.splitlines() if x.strip()]
    owner = np.repeat(np.arange(len(texts)), [len(t.split()) for t in texts])
    line = np.repeat(np.arange(len(lines)), [len(t.split()) for t in lines])
    origin = _origins(" ".join(texts).split(), " ".join(lines).split())
    tied = np.unique(np.stack([line[origin >= 0], owner[origin[origin >= 0]]], 1), axis=0) if (origin >= 0).any() else np.empty((0, 2), int)
    # Lines and utterances are the two sides of a graph, lines first: a part is named by its first line.
    part = components(len(lines) + len(texts), tied[:, 0], tied[:, 1] + len(lines))
    out = []
    for first in np.unique(part[tied[:, 0]]) if len(tied) else []:
        covered = sorted(seqs[u] for u in np.flatnonzero(part[len(lines) :] == first))
        text = " ".join(lines[k] for k in np.flatnonzero(part[: len(lines)] == first))
        if [text] != [t for s, t in zip(seqs, texts, strict=True) if s in covered]:
            out.append((covered, text))
    return out
