"""Queries pN_ of the llm problems (1, 3, 6, 7, 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filament.llm import canonical, mixing, packing, splitting, turns
from filament.runtime import table


def _segments(spark: SparkSession, d: str, text: bool = False, words: bool = False) -> DataFrame:
    tables = [table(spark, d, n) for n in ("segments", "acteurs", "organes", "hesitations")]
    return turns.settle(turns.parse(*tables, text, words), lambda: turns.parse(*tables, words=True))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Turns by their first and last speech segment; the floor moves by labels only.

    Labels that several participants bear are settled by the hidden Markov model.
    """
    return turns.speaker_turns(_segments(spark, d)).select("sitting_uid", "first_seg_id", "last_seg_id")


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with text and bounds, missing speakers inferred by the hidden Markov model."""
    out = turns.speaker_turns(_segments(spark, d, True, True), infer=True)
    return out.select("sitting_uid", F.col("key").alias("speaker"), F.array_join("texts", " ").alias("text"), "beg", "end")


def p1_heldout(spark: SparkSession, d: str) -> DataFrame:
    """Share of hidden labels that the model finds, and that carrying on finds."""
    return turns.held_out(_segments(spark, d, words=True))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries that mean exactly one person."""
    return canonical.match_entries(table(spark, d, "inscrits"), table(spark, d, "acteurs"), table(spark, d, "organes")).where("size(uids) = 1").select("entry_id", F.col("uids")[0].alias("uid"))


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Entries without a person, and whether nobody or several fit."""
    return canonical.match_entries(table(spark, d, "inscrits"), table(spark, d, "acteurs"), table(spark, d, "organes")).where("size(uids) <> 1").select("entry_id", "text", F.when(F.size("uids") == 0, "nobody").otherwise("several").alias("why"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that no container can hold whole."""
    return packing.pack(table(spark, d, "documents")).where("not whole").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.containers(packing.pack(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that cannot reach their share."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report.where("not feasible").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).report


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")).uses


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of more than 512 tokens."""
    return splitting.split(table(spark, d, "documents")).select("doc_id").distinct()


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_turns, p1_heldout, p3_found, p3_unmatched, p6_found, p6_containers, p7_found, p7_shares, p7_mixture, p8_found, p8_pieces)}
SQL: dict[str, str] = {}
