"""Documents into containers of fixed capacity: shortest-pack-first histogram packing.

Only the histogram of lengths, one row a length, reaches the driver. The packing is done on it:
lengths longest first, each taken in by the shortest packing patterns with room, whole counts at a
time. The patterns come back as rank ranges per length, whose number depends on the capacity, not on
the data; a document finds its range by its rank among documents of its length.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from filament.llm.tokens import TOKENIZER, encoder
from filament.runtime import durable

CAPACITY = 2048


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[int, Counter]]:
    """(how many containers, lengths in each) for a histogram of lengths 1..capacity.

    Lengths are placed longest first. Each goes to the shortest packs that have room, splitting a
    pattern's count where fewer are needed. Deterministic.
    """
    room: dict[int, list[tuple[int, Counter]]] = {}
    rooms: list[int] = []  # sorted keys of room

    def put(space: int, n: int, pattern: Counter) -> None:
        if space not in room:
            room[space] = []
            bisect.insort(rooms, space)
        room[space].append((n, pattern))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        left, done = counts[length], []
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                # A new pattern takes one item; further ones come by the loop, so patterns stay even.
                done.append((capacity - length, left, Counter({length: 1}))) if per == 1 else put(capacity - length, -(-left // per), Counter({length: 1}))
                left -= left if per == 1 else -(-left // per)
                continue
            space = rooms[-1]
            n, pattern = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.remove(space)
            take = min(n, left)
            if n > take:
                put(space, n - take, pattern)
            put(space - length, take, pattern + Counter({length: 1}))
            left -= take
        for x in done:
            put(*x)
    return [(n, p) for s in sorted(room) for n, p in room[s]]


def pack(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(container_id, key, part, length, whole): the place of every document.

    A document larger than a container (``whole`` false) fills containers of its own; its last part is
    packed like any document. Documents of no tokens (empty or null text) take no room and are spread
    over the containers by rank; if there is nothing else they share one. Every row counts, repeated
    rows and null keys too; columns other than key and text are ignored. An empty table has no
    containers.
    """
    kind = documents.schema[key].dataType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoder(tokenizer)
        seen: Counter = Counter()
        pid = TaskContext.get().partitionId()
        for b in batches:
            at, part, size, rank, whole = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                n = len(enc.encode_ordinary(t)) if t else 0
                parts = [n] if n <= capacity else [capacity] * (n // capacity) + ([n % capacity] if n % capacity else [])
                for k, x in enumerate(parts):
                    at.append(i)
                    part.append(k)
                    size.append(x)
                    rank.append(seen[x])
                    whole.append(n <= capacity)
                    seen[x] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(part, pa.int32()), pa.array(size, pa.int64()), pa.array(rank, pa.int64()), pa.array(whole, pa.bool_()), pa.array([pid] * len(at), pa.int32())],
                names=["key", "part", "length", "local", "whole", "pid"],
            )

    spark = documents.sparkSession
    items = durable(documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(measure, f"key {kind.simpleString()}, part int, length bigint, local bigint, whole boolean, pid int"), "items")
    # Ranks: the place in the task plus the counts of the tasks before; a row per task and length.
    counts = items.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most capacity + 1 rows
    held = spark.sparkContext.broadcast(places(histogram, capacity))  # a few ranges a length, whatever the number of documents
    ranked = items.join(before.select("pid", "length", "before"), ["pid", "length"]).select("key", "part", "length", "whole", (F.col("local") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(4).to_numpy()
            box = np.empty(len(length), np.int64)
            for x in np.unique(length):
                start, base, n = table[int(x)]
                here = np.flatnonzero(length == x)
                at = np.searchsorted(start, rank[here], side="right") - 1
                box[here] = base[at] + (rank[here] - start[at]) % n[at]
            yield pa.RecordBatch.from_arrays([pa.array(box), b.column(0), b.column(1), b.column(2), b.column(3)], names=["container_id", key, "part", "length", "whole"])

    return ranked.mapInArrow(place, f"container_id bigint, `{key}` {kind.simpleString()}, part int, length bigint, whole boolean")


def places(histogram: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length the ranges of ranks: where each starts, the first container of its pattern, and how many these are."""
    sizes = dict(histogram)
    empty = sizes.pop(0, 0)
    ranges: dict[int, list[tuple[int, int, int]]] = {}
    used, base = Counter(), 0
    for n, pattern in pack_histogram(sizes, capacity):
        for length, m in pattern.items():
            ranges.setdefault(length, []).append((used[length], base, n))
            used[length] += m * n
        base += n
    if empty:
        ranges[0] = [(0, 0, max(base, 1))]
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in ranges.items()}


def containers(placed: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(container_id, documents, fill, room): what each container holds, in the order of keys."""
    held = F.array_sort(F.collect_list(F.struct(F.col(key), "part", "length")))
    return placed.groupBy("container_id").agg(held.alias("documents"), F.sum("length").alias("fill")).withColumn("room", F.lit(capacity) - F.col("fill"))
