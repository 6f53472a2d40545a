"""File sources of a recorded sitting: NDJSON logs, raw snapshots, reference slices, chapter trees."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _L = T.StringType(), T.LongType()
NODE = _schema(
    sitting_uid=_S, t=_L, seq=_L, kind=_S, state=_S, text=_S, source=_S, supersedes=T.ArrayType(_L), call=_S, heard=_S, groupe_label=_S,
    canonical=_schema(acteur=_S, tribun=_S, amendement_uid=_S, scrutin=_S, article=_S, groupe=_S),
)
TICK = _schema(wall=_S, raw_ref=T.MapType(_S, _S), changed=T.MapType(_S, T.BooleanType()))


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per line that is not blank; absent fields are null; damaged lines are left out."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])).option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows.where("_bad is null").drop("_bad")


def read_thread(spark: SparkSession, path: str) -> DataFrame:
    """A thread log, whose ``supersedes`` may be written as a number or as a list."""
    fields = [T.StructField("supersedes", T.StringType()) if f.name == "supersedes" else f for f in NODE]
    rows = read_ndjson(spark, path, T.StructType(fields))
    listed = F.from_json(F.when(F.col("supersedes").startswith("["), F.col("supersedes")).otherwise(F.concat(F.lit("["), "supersedes", F.lit("]"))), "array<bigint>")
    return rows.withColumn("supersedes", listed).select(*NODE.names)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw snapshots by file name, bytes as they are: (name, path, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content")


def raw_by_reference(refs: DataFrame, column: str, raw: DataFrame) -> DataFrame:
    """References joined to the bytes they name; a missing file gives null content."""
    r = raw.select(F.col("name").alias("_name"), "content")
    return refs.join(r, F.element_at(F.split(F.col(column), "/"), -1) == F.col("_name"), "left").drop("_name")


def read_reference(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A reference slice: a JSON array of objects in one file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


_TREE = "key string, ord int, id string, parent string, depth int, label string, speaker_id string, speaker string"


def read_chapters(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Labelled chapters of tree documents in document order, whatever their depth.

    (key, ord, id, parent, depth, label, speaker_id, speaker); a document that does not parse gives no
    rows; empty speaker names are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(text)
                except (ET.ParseError, TypeError, ValueError):
                    continue
                speakers = {s.get("id"): next((c.text for c in s if c.tag == "name" and c.text), None) for s in root.iter("speaker") if len(s)}
                n, stack = 0, [(c, None, 0) for holder in root.findall("chapters") for c in reversed(holder.findall("chapter"))]
                while stack:
                    c, parent, depth = stack.pop()
                    mine, below = parent, depth
                    if c.get("label"):
                        who = next((s.get("id") for s in c.findall("speaker")), None)
                        out.append((k, n, c.get("id"), parent, depth, c.get("label"), who, speakers.get(who)))
                        n, mine, below = n + 1, c.get("id"), depth + 1
                    stack.extend((x, mine, below) for x in reversed(c.findall("chapter")))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _TREE.split(", ")])

    return df.select(F.col(key).cast("string"), F.col(xml).cast("string")).mapInArrow(run, _TREE)


def read_synchros(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, starttime, ord, id, timecode) of player documents."""
    p = F.from_xml(F.col(xml), F.lit("_starttime BIGINT, synchro ARRAY<STRUCT<_id: STRING, _timecode: BIGINT>>"))
    return df.select(F.col(key).alias("key"), p.alias("p")).select("key", F.col("p._starttime").alias("starttime"), F.posexplode("p.synchro").alias("ord", "s")).select("key", "starttime", "ord", F.col("s._id").alias("id"), F.col("s._timecode").alias("timecode"))
