"""BK-trees under Levenshtein distance, and the search of free-typed values in a reference list.

``BKTree.within`` uses the triangle inequality: below a node at distance d only subtrees whose edge
lies in [d - r, d + r] can hold an entry within r. ``search`` runs it distributed: the reference list
is broadcast whole, or hashed into shards whose winners are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A shard of the reference list holds at most about this many entries in a worker's memory.
SHARD_ENTRIES = 200_000


def distance(peq: dict[str, int], m: int, text: str) -> int:
    """Levenshtein distance of a pattern (its bit masks ``peq``, length ``m``) and ``text``.

    Bit-parallel, after Myers and Hyyrö: one step of integer operations a character.
    """
    if m == 0:
        return len(text)
    pv, mv, score = (1 << m) - 1, 0, m
    full, high = pv, 1 << (m - 1)
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) | 1
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
    return score


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def levenshtein(a: str, b: str) -> int:
    return distance(masks(a), len(a), b)


class BKTree:
    """A tree of distinct strings; equal strings are one entry."""

    def __init__(self, entries: Iterable[str] = ()):
        self.words: list[str] = []
        self.children: list[dict[int, int]] = []
        self.place: dict[str, int] = {}
        for e in entries:
            self.add(e)

    def add(self, word: str) -> None:
        if word in self.place:
            return
        new = len(self.words)
        self.place[word] = new
        self.words.append(word)
        self.children.append({})
        if not new:
            return
        peq, m, at = masks(word), len(word), 0
        while True:
            d = distance(peq, m, self.words[at])
            nxt = self.children[at].get(d)
            if nxt is None:
                self.children[at][d] = new
                return
            at = nxt

    def within(self, query: str, radius: int, known: dict[int, int] | None = None) -> list[tuple[int, str]]:
        """Every (distance, entry) within ``radius``, nearest first.

        ``known`` holds the distances of this query that were worked out before, and takes the new ones:
        circles around one query that widen compare each entry once.
        """
        if radius < 0 or not self.words:
            return []
        if radius == 0:
            return [(0, query)] if query in self.place else []
        peq, m, found, stack = masks(query), len(query), [], [0]
        known = {} if known is None else known
        while stack:
            at = stack.pop()
            d = known.get(at)
            if d is None:
                d = known[at] = distance(peq, m, self.words[at])
            if d <= radius:
                found.append((d, self.words[at]))
            low, high = d - radius, d + radius
            stack.extend(child for edge, child in self.children[at].items() if low <= edge <= high)
        return sorted(found)

    def nearest(self, query: str, radius: int) -> list[tuple[int, str]]:
        """All entries at the least distance, if that is within ``radius``; by widening circles."""
        known: dict[int, int] = {}
        for r in range(radius + 1):
            if found := self.within(query, r, known):
                return found
        return []


def search(queries: DataFrame, column: str, reference: DataFrame, entry: str, radius: int, nearest: bool = True, shards: int | None = None) -> DataFrame:
    """(value, entry, distance): for every distinct ``column`` value the entries within ``radius``.

    ``nearest`` keeps those at the least distance, ties included. The reference list is counted; up
    to ``SHARD_ENTRIES`` it goes to every task whole, beyond that it is hashed into shards: each
    query visits each shard once and the shards' winners merge by an aggregation. A value without an
    entry in reach comes out once with entry and distance null. Null values and null entries are
    left out; an empty list leaves every value unmatched; strings count as they are, case included.
    """
    spark = queries.sparkSession
    ref = reference.select(F.col(entry).cast("string").alias("entry")).where("entry is not null").distinct()
    n = ref.count()
    shards = shards or max(1, -(-n // SHARD_ENTRIES))
    values = queries.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    schema = "value string, entry string, distance int"

    def look(words: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = BKTree(words)
        for b in batches:
            out: list[tuple] = []
            for v in b.column(b.schema.get_field_index("value")).to_pylist():
                hits = tree.nearest(v, radius) if nearest else tree.within(v, radius)
                out += [(v, e, d) for d, e in hits] or [(v, None, None)]
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32())], names=["value", "entry", "distance"])

    if shards == 1:
        held = spark.sparkContext.broadcast([r[0] for r in ref.collect()])  # at most SHARD_ENTRIES rows, counted above
        return values.mapInArrow(lambda it: look(held.value, it), schema)

    # Sharded: a shard's entries meet all queries, and the tree is built once a group.
    left = ref.withColumn("shard", F.pmod(F.xxhash64("entry"), F.lit(shards)).cast("int"))
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    right = values.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def cell(words: pa.Table, vals: pa.Table) -> pa.Table:
        found = list(look(words.column("entry").to_pylist(), iter(vals.to_batches())))
        return pa.Table.from_batches(found, pa.schema([("value", pa.string()), ("entry", pa.string()), ("distance", pa.int32())]))

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, schema)
    if nearest:
        best = hits.groupBy("value").agg(F.min("distance").alias("least"))
        merged = hits.where("distance is not null").join(best, "value").where("distance = least").select("value", "entry", "distance")
    else:
        merged = hits.where("distance is not null")
    return values.join(merged, "value", "left").select("value", "entry", "distance")
