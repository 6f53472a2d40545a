"""Hand-typed entries mapped to the persons of a reference list."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filament.llm.bktree import SHARD_ENTRIES
from filament.llm.names import Register, register_of
from filament.runtime import durable, spread

_SCHEMA = "entry_id bigint, text string, slips int, uids array<string>"


def _resolve(register: Register, batches: Iterator[pa.RecordBatch], notes: bool = True) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, texts = b.column(b.schema.get_field_index("entry_id")), b.column(b.schema.get_field_index("text"))
        memo: dict[str | None, tuple] = {}
        got = []
        for t in texts.to_pylist():
            if t not in memo:
                memo[t] = register.scored(t, notes=notes)
            got.append(memo[t])
        yield pa.RecordBatch.from_arrays([ids, texts, pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["entry_id", "text", "slips", "uids"])


def people_of(acteurs: DataFrame) -> DataFrame:
    return acteurs.select("uid", "civ", "prenom", "nom", "groupe_uid").where("uid is not null and nom is not null").distinct()


def groups_of(organes: DataFrame) -> list[tuple]:
    """The groups (uid, name, code), which every task holds: a list of parties, bounded here."""
    groups = [tuple(r) for r in organes.select("uid", "libelle", "libelle_abrege").limit(100_001).collect()]
    if len(groups) > 100_000:
        raise ValueError("more than 100,000 groups")
    return groups


def shards_for(people: DataFrame) -> int:
    return max(1, -(-people.count() // SHARD_ENTRIES))


def match_entries(entries: DataFrame, acteurs: DataFrame, organes: DataFrame, shards: int | None = None) -> DataFrame:
    """(entry_id, text, slips, uids): for each entry the persons that fit with the fewest slips.

    Surnames are found in a BK-tree (all within the slips allowed for their length); first name,
    initial, civility and group then decide. One uid means that person, several are told apart by
    nothing, none means nobody listed (or an office, a blank, a null text). Copies of an entry count
    once; rows with a null entry_id are left out. The list is counted: up to ``SHARD_ENTRIES`` persons
    it is broadcast, beyond that it is hashed into shards that each entry visits, and per entry the
    shards' winners merge, which gives the same rows for any number of shards. Texts of any length are
    read whole: in one of more than 12 name tokens, which holds a note besides, a name of up to 6 tokens
    with its first name or initial is looked for everywhere.
    """
    spark = entries.sparkSession
    once = entries.where("entry_id is not null").groupBy("entry_id").agg(F.min("text").alias("text"))
    people, groups = people_of(acteurs), groups_of(organes)
    shards = shards or shards_for(people)
    if shards == 1:
        held = spark.sparkContext.broadcast((sorted(tuple(r) for r in people.collect()), groups))  # at most SHARD_ENTRIES rows
        return spread(once, "entry_id").mapInArrow(lambda it: _resolve(register_of(*held.value), it), _SCHEMA)
    return search_sharded(once, people, groups, shards)


def search_sharded(once: DataFrame, people: DataFrame, groups: list[tuple], shards: int, notes: bool = True) -> DataFrame:
    """(entry_id, text, slips, uids) of distinct entries against a list in shards.

    Entries are cut into blocks and every block meets every shard, so a tree is built once for a shard
    and block; there are as many blocks as make a block about as large as a shard.
    """
    spark = once.sparkSession
    held = spark.sparkContext.broadcast(groups)
    once = durable(once, "entries")
    blocks = max(1, -(-once.count() // SHARD_ENTRIES), -(-spark.sparkContext.defaultParallelism // shards))
    left = people.withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = once.withColumn("block", F.pmod(F.xxhash64("entry_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))

    def cell(persons: pa.Table, texts: pa.Table) -> pa.Table:
        rows = zip(*(persons.column(c).to_pylist() for c in ("uid", "civ", "prenom", "nom", "groupe_uid")), strict=True)
        schema = pa.schema([("entry_id", pa.int64()), ("text", pa.string()), ("slips", pa.int32()), ("uids", pa.list_(pa.string()))])
        return pa.Table.from_batches(list(_resolve(register_of(rows, held.value), iter(texts.to_batches()), notes)), schema)

    hits = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, _SCHEMA)
    merged = hits.groupBy("entry_id").agg(F.min("text").alias("text"), F.min("slips").alias("slips"), F.collect_list(F.struct("slips", "uids")).alias("all"))
    return merged.select("entry_id", "text", "slips", F.array_sort(F.flatten(F.transform(F.filter("all", lambda x: x["slips"] == F.col("slips")), lambda x: x["uids"]))).alias("uids"))
