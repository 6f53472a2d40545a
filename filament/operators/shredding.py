"""Nested documents into an adjacency table, and entity tables back out of it.

``shred`` turns every document into rows (node, parent, label, ordinal, kind, scalar), whatever its
depth. ``entity`` joins object nodes with their scalar children and pivots these into columns;
``link`` attaches the ordinal and key of an ancestor, so child tables keep the tie to the parent.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from filament.runtime import durable

#: A path of more characters is written as a digest, so that deep documents do not grow quadratically.
LONGEST_PATH = 500

_OPEN = {"{": "}", "[": "]"}
_SPACE = re.compile(r"[ \t\r\n]*")
_ATOM = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity")


def parse_deep(text: str):
    """A JSON value of any depth, by a stack; ``ValueError`` where the text is not one."""
    at, open_ = 0, []  # open_: container and name of what is not closed yet

    def skip(i: int) -> int:
        return _SPACE.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        i = skip(i)
        if text[i : i + 1] != '"':
            raise ValueError("a name is missing")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("a colon is missing")
        return name, i + 1

    while True:
        at = skip(at)
        c = text[at : at + 1]
        if c in ("{", "["):
            value, inner = {} if c == "{" else [], skip(at + 1)
            if text[inner : inner + 1] != _OPEN[c]:
                name, at = key(inner) if c == "{" else (None, inner)
                open_.append([value, name])
                continue
            at = inner + 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif m := _ATOM.match(text, at):
            value, at = json.loads(m.group()), m.end()
        else:
            raise ValueError("no value")
        while open_:
            holder, name = open_[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                if name is None:
                    at += 1
                else:
                    open_[-1][1], at = key(at + 1)
                break
            if c != ("]" if name is None else "}"):
                raise ValueError("a bracket is missing")
            value, at = open_.pop()[0], at + 1
        else:
            if skip(at) != len(text):
                raise ValueError("more text")
            return value


def loads(text: str):
    """A JSON value of any depth."""
    try:
        return json.loads(text)
    except RecursionError:
        return parse_deep(text)


def decode(body: str | None):
    """The JSON value a body holds, or None if it holds none that is complete.

    Byte order marks, white space, text around the document and wrapping as a JSON string, however
    often, are taken off. A cut-off document stays cut off: its outermost bracket never closes.
    """
    value = body
    while isinstance(value, str):  # each round takes off two signs at least
        text = value.strip("\ufeff\u200b\x00 \t\r\n\f\v\xa0")
        try:
            value = loads(text)
        except ValueError:
            start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
            end = text.rfind(_OPEN[text[start]]) if start >= 0 else -1
            if end <= start:
                return None
            try:
                value = loads(text[start : end + 1])
            except ValueError:
                return None
    return value


def documents(df: DataFrame, key: str, body: str) -> DataFrame:
    """Every (key, body) once, as (doc, body): copies are removed before they are shredded.

    ``doc`` is a struct of ``key`` and a number no other document has, so that different bodies under
    one key are different documents, whose nodes are never joined with each other. Rows whose key or
    body is null are left out. The numbers differ from run to run; ``shred`` the result once, into a
    ``durable`` table.
    """
    once = df.select(F.col(key), F.col(body).cast("string").alias("body")).where(F.col(key).isNotNull() & F.col("body").isNotNull()).groupBy(key, "body").agg(F.lit(1).alias("_one"))
    return once.select(F.struct(F.col(key), F.monotonically_increasing_id().alias("no")).alias("doc"), "body")


def _scalar(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def _below(path: str, label: str) -> str:
    """The path of a child; a long one goes on from its digest."""
    if len(path) + len(label) <= LONGEST_PATH:
        return f"{path}.{label}" if path else label
    return "#" + hashlib.md5(f"{path}.{label}".encode()).hexdigest()


def path_of(*labels: str) -> str:
    """The path under which ``shred`` writes the objects below these labels."""
    path = ""
    for x in labels:
        path = _below(path, x)
    return path


def _walk(value, keep: frozenset[str] | None) -> Iterator[tuple]:
    """(node, parent, path, label, ordinal, kind, scalar) in document order, without recursion.

    An element of a list is a child of the list's owner, under the list's label; ordinals count the
    elements that are not null, from 1, and a lone value counts as a list of one.
    """
    n = 0
    stack = [(value, -1, "", "", 1)]
    while stack:
        v, parent, path, label, ordinal = stack.pop()
        if isinstance(v, list):
            flat, todo = [], [v]
            while todo:
                x = todo.pop()
                if isinstance(x, list):
                    todo.extend(reversed(x))
                elif x is not None:
                    flat.append(x)
            stack.extend((x, parent, path, label, k) for k, x in reversed(list(enumerate(flat, 1))))
        elif isinstance(v, dict):
            node, n = n, n + 1
            yield node, parent, path, label, ordinal, "object", None
            stack.extend((x, node, _below(path, k), k, 1) for k, x in reversed(v.items()))
        elif keep is None or label in keep:
            node, n = n, n + 1
            yield node, parent, path, label, ordinal, "null" if v is None else "scalar", _scalar(v)


def shred(df: DataFrame, key: str, body: str, keep: Sequence[str] | None = None) -> DataFrame:
    """Adjacency table (key, node, parent, path, label, ordinal, kind, scalar) of every document.

    ``keep`` names the scalar labels that are wanted; others are not produced (column pruning).
    Result for edge cases: a null, empty or damaged body gives no rows; a body that is a lone scalar
    gives no rows; an empty object gives its node; of a label repeated in one object the last counts.
    A document given twice gives its rows twice, on the same keys; remove copies by ``documents``
    before joining nodes.
    """
    kind = df.schema[key].dataType
    wanted = None if keep is None else frozenset(keep)
    schema = T.StructType(
        [T.StructField("key", kind), T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("label", T.StringType()), T.StructField("ordinal", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("scalar", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, cols = batch.column(0), [], [[] for _ in range(7)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                value = decode(text)
                if not isinstance(value, (dict, list)):
                    continue
                for row in _walk(value, wanted):
                    at.append(i)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
                if len(at) > 100_000:
                    yield _batch(keys, at, cols)
                    at, cols = [], [[] for _ in range(7)]
            if at:
                yield _batch(keys, at, cols)

    return df.select(F.col(key).alias("key"), F.col(body).cast("string").alias("body")).where("body is not null").mapInArrow(run, schema)


def _batch(keys, at, cols) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
    names = ["key", "node", "parent", "path", "label", "ordinal", "kind", "scalar"]
    return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def entity(adjacency: DataFrame, path: str, fields: Sequence[str]) -> DataFrame:
    """One row per object node at ``path``: (key, node, parent, ordinal, *fields).

    A field is the object's scalar child of that label (the first, if it holds a list of scalars);
    absent, null and nested children give null.
    """
    objects = adjacency.where((F.col("path") == path) & (F.col("kind") == "object")).select("key", "node", "parent", "ordinal")
    if not fields:
        return objects
    scalars = (
        adjacency.where(F.col("path").isin([_below(path, f) for f in fields]) & (F.col("kind") == "scalar"))
        .groupBy("key", F.col("parent").alias("node"))
        .agg(*(F.min_by("scalar", F.when(F.col("label") == f, F.col("ordinal"))).alias(f) for f in fields))
    )
    return objects.join(scalars, ["key", "node"], "left")


def link(child: DataFrame, parent: DataFrame, name: str) -> DataFrame:
    """Adds the parent's place: ``<name>_no`` and ``<name>_parent`` (the grandparent node)."""
    p = parent.select("key", F.col("node").alias("parent"), F.col("ordinal").alias(f"{name}_no"), F.col("parent").alias(f"{name}_parent"))
    return child.join(p, ["key", "parent"])


#: Scalar fields of an agenda line.
LINE_FIELDS = ["id", "ligne_type", "ligne_libelle_1", "ligne_libelle_compl_1", "depute_tribun_id", "ligne_amendement_uid", "ligne_amendement_derouleur_division_ancre", "ligne_video_highlighted", "texte_bibard"]


def agenda_tables(snapshots: DataFrame, fields: Sequence[str] = LINE_FIELDS) -> dict[str, DataFrame]:
    """Snapshot, phase and line tables of agenda bodies (``snap_id``, ``body``).

    ``fields`` are the line fields that are wanted; others are not shredded. Copies of a snapshot
    (same snap_id and body) count once; rows whose snap_id is null can't be told apart and are left out.
    """
    once = documents(snapshots, "snap_id", "body")
    adj = shred(once, "doc", "body", [*{"id": 0, "phase_libelle": 0, "phase_type": 0, "jaune_date_time": 0, "extract_date_time": 0} | dict.fromkeys(fields)])
    adj = durable(adj, "adjacency")  # shredded once, read once per entity
    snaps = entity(adj, "racine.jaune", ["id", "jaune_date_time", "extract_date_time"]).selectExpr("key.snap_id", "id as jaune_id", "jaune_date_time", "extract_date_time").distinct()
    ligne = link(entity(adj, "racine.contenu.phase.ligne", fields), entity(adj, "racine.contenu.phase", []), "phase")
    return {
        "snapshots": snaps,
        "phases": entity(adj, "racine.contenu.phase", ["phase_libelle", "phase_type"]).selectExpr("key.snap_id", "cast(ordinal as bigint) as phase_no", "phase_libelle", "phase_type").distinct(),
        "lignes": ligne.selectExpr("key.snap_id", "cast(phase_no as bigint) as phase_no", "cast(ordinal as bigint) as ligne_no", *fields).distinct(),
    }
