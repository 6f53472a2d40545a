"""Change feeds applied to a bucketed copy-on-write table.

``BucketedTable`` keeps its rows hashed by key into buckets of Parquet files, named by a manifest.
``apply`` keeps the last change of every key, routes it to its bucket, sort-merges only the touched
buckets into replacement files and commits a new manifest by an atomic rename, so readers always see
one whole version and a lost job leaves the last version as it was.

``SupersessionTable`` keeps the records of a log in such tables, where changes name the records they
replace by sequence number.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from filament.runtime import durable, filesystem

#: Links are resolved in blocks of 2**BLOCK_BITS consecutive sequence numbers.
BLOCK_BITS = 16
#: A bucket of a log's records is made for about this many rows, if there are no more shuffle partitions anyway.
BUCKET_ROWS = 2_000_000


class BucketedTable:
    """A keyed table of which ``apply`` rewrites only the buckets that a batch of changes touches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        head = self._read(self._versions()[-1])
        self.keys, self.order, self.buckets = head["keys"], head["order"], head["buckets"]
        self.schema = T.StructType.fromJson(head["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: str, buckets: int) -> BucketedTable:
        """An empty table. ``schema`` has the key, order and payload columns; ``_deleted`` is added.

        Choose ``buckets`` so that one bucket fits a task: about the table's size / 128 MB.
        """
        full = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField("_deleted", T.BooleanType())])
        head = {"version": 0, "keys": list(keys), "order": order, "buckets": buckets, "schema": json.loads(full.json()), "files": {}}
        _commit(spark, f"{path.rstrip('/')}/_manifest", head)
        return cls(spark, path)

    def _versions(self) -> list[int]:
        fs, p = filesystem(self.spark, f"{self.path}/_manifest")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def _read(self, version: int) -> dict:
        fs, p = filesystem(self.spark, f"{self.path}/_manifest/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @property
    def version(self) -> int:
        return self._versions()[-1]

    def snapshot(self, version: int | None = None, deleted: bool = False) -> DataFrame:
        """The rows of a version (the latest by default); tombstones only if ``deleted``."""
        head = self._read(self.version if version is None else version)
        dirs = sorted({f"{self.path}/{d}" for d in head["files"].values()})
        rows = self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)
        return rows if deleted else rows.where("not _deleted").drop("_deleted")

    def apply(self, changes: DataFrame, deleted: str = "_deleted") -> int:
        """Applies changes (key, order and payload columns plus a boolean ``deleted``) once.

        Out-of-order and repeated changes have no effect: a change counts if its order value exceeds
        that of the row or tombstone it meets. Changes whose order is null are ignored; a null
        ``deleted`` means no. Null keys are a key of their own. Of changes equal in key and order one
        is kept. Missing payload columns become null, unknown columns are left out.
        An empty batch commits nothing. Returns the version that holds afterwards.
        """
        version = self.version
        head = self._read(version)
        names = [f.name for f in self.schema if f.name != "_deleted"]
        have = set(changes.columns)
        rows = changes.where(F.col(f"`{self.order}`").isNotNull()).select(
            *[(F.col(f"`{n}`") if n in have else F.lit(None)).cast(self.schema[n].dataType).alias(n) for n in names],
            (F.coalesce(F.col(f"`{deleted}`").cast("boolean"), F.lit(False)) if deleted in have else F.lit(False)).alias("_deleted"),
        )
        payload = [n for n in [*names, "_deleted"] if n not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*payload), F.col(f"`{self.order}`")).alias("_c"))
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        routed = last.select(*self.keys, *[F.col(f"_c.`{n}`").alias(n) for n in payload], bucket.alias("_bucket"))
        if head["files"]:
            routed = durable(routed, "changes")
            # Bounded by the number of buckets, which is fixed when the table is made.
            touched = [r[0] for r in routed.select("_bucket").distinct().collect()]
            dirs = [f"{self.path}/{head['files'][str(b)]}" for b in touched if str(b) in head["files"]]
            if dirs:
                routed = self._merge(self.spark.read.schema(self.schema).parquet(*dirs), routed, payload, bucket)
        # A folder of its own for every attempt: a writer that loses the race for the manifest touches no one's files.
        where = f"data/v{version + 1:012d}-{uuid.uuid4().hex}"
        if not head["files"] or not dirs:
            routed = routed.repartition(max(1, min(self.buckets, 4096)), "_bucket")
        (
            routed.sortWithinPartitions("_bucket", *self.keys)
            .select(*[f.name for f in self.schema], "_bucket")
            .write.partitionBy("_bucket").parquet(f"{self.path}/{where}")
        )
        fs, p = filesystem(self.spark, f"{self.path}/{where}")
        new = {n.removeprefix("_bucket="): f"{where}/{n}" for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith("_bucket=")}
        if not new:
            fs.delete(p, True)
            return version
        try:
            _commit(self.spark, f"{self.path}/_manifest", head | {"version": version + 1, "files": head["files"] | new})
        except RuntimeError:
            fs.delete(p, True)
            raise
        return version + 1

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows, tombstones included, of distinct ``keys``; only the buckets these fall into are read."""
        head = self._read(self.version)
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in keys.select(bucket.alias("b")).distinct().collect()]  # at most one a bucket
        dirs = [f"{self.path}/{head['files'][str(b)]}" for b in touched if str(b) in head["files"]]
        rows = self.spark.read.schema(self.schema).parquet(*dirs) if dirs else self.spark.createDataFrame([], self.schema)
        return rows.join(keys.select(*self.keys), self.keys, "left_semi")

    def _merge(self, base: DataFrame, changes: DataFrame, payload: list[str], bucket) -> DataFrame:
        """Base and changes meet by bucket, the one shuffle there is; inside a bucket they merge in key order."""
        row = F.struct(*payload).alias("_r")
        at = lambda old: F.struct(F.col(f"`{self.order}`"), F.lit(old)).alias("_at")  # noqa: E731  the base wins a tie
        both = base.select(*self.keys, bucket.alias("_bucket"), row, at(True)).union(changes.select(*self.keys, "_bucket", row, at(False)))
        one = both.repartition(max(1, min(self.buckets, 4096)), "_bucket").groupBy("_bucket", *self.keys).agg(F.max_by("_r", "_at").alias("_r"))
        return one.select(*self.keys, *[F.col(f"_r.`{n}`").alias(n) for n in payload], "_bucket")


def _commit(spark: SparkSession, folder: str, head: dict) -> None:
    fs, target = filesystem(spark, f"{folder}/{head['version']:012d}.json")
    if fs.exists(target):
        raise RuntimeError(f"version {head['version']} was committed by another writer")
    _, temp = filesystem(spark, f"{folder}/_{head['version']:012d}-{uuid.uuid4().hex}.tmp")
    stream = fs.create(temp, True)
    stream.write(bytearray(json.dumps(head).encode()))
    stream.close()
    if not fs.rename(temp, target):
        raise RuntimeError(f"version {head['version']} could not be committed")


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component; hooking and pointer jumping, a logarithm of rounds."""
    lab = np.arange(n)
    while len(a):
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(lab, np.maximum(la, lb), low)
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
    return lab


_LOCAL = T.StructType([T.StructField("part", T.StringType()), T.StructField("foreign", T.BooleanType()), T.StructField("node", T.LongType()), T.StructField("root", T.LongType())])


def _resolve_block(tbl: pa.Table) -> pa.Table:
    """The links of one block's later ends: roots of its nodes, and for every named node of another block the one root that it is tied to."""
    a, b = (tbl.column(c).to_numpy() for c in ("a", "b"))
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    here = (ids >> BLOCK_BITS) == (a[0] >> BLOCK_BITS)
    # Nodes of the block come first, so that the least of them stands for each component.
    place = np.empty(len(ids), np.int64)
    order = np.argsort(~here, kind="stable")
    place[order] = np.arange(len(ids))
    lab = components(len(ids), place[at[: len(a)]], place[at[len(a) :]])
    root = ids[order][lab[place]]
    return pa.table({"part": pa.array([tbl.column("part")[0].as_py()] * len(ids), pa.string()), "foreign": ~here, "node": ids, "root": root})


def graph_components(edges: DataFrame) -> DataFrame:
    """(part, node, root): the least member of each node's component, for (part, a, b) links of nodes.

    A link is solved in the block of 2**16 numbers that its greater end lies in. There all nodes that
    are tied to one node of another block meet, so of a node that a third of all links name one link a
    block is left; only these are solved by stars. Nodes without a link give no row.
    """
    e = edges.selectExpr("part", "greatest(a, b) as a", "least(a, b) as b").where("a <> b").distinct()
    local = durable(e.groupBy("part", F.shiftright("a", BLOCK_BITS).alias("blk")).applyInArrow(lambda key, tbl: _resolve_block(tbl), _LOCAL), "blocks")
    own = local.where("not foreign").select("part", "node", "root")
    tied = local.where("foreign").select("part", "node", F.col("root").alias("a"))
    links = durable(tied.join(own, ["part", "node"], "left").select("part", "a", F.coalesce("root", "node").alias("b"), "node"), "links")
    if not links.take(1):
        return own
    stars = star_components(links.select("part", "a", "b")).select("part", F.col("node").alias("root"), F.col("root").alias("top"))
    every = own.union(links.select("part", "node", F.col("b").alias("root"))).distinct()
    return durable(every.join(stars, ["part", "root"], "left").select("part", "node", F.coalesce("top", "root").alias("root")), "roots")


def star_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(part, node, root): the least member of each node's component, for (part, a, b) edges.

    Alternating large and small stars, each a join and an aggregation of the edges; every round is
    written to the shared folder. Any size and shape; ends when the edges don't change.
    """
    e = durable(edges.selectExpr("part", "greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "stars")
    before = None
    for _ in range(rounds):
        # Bounded: one row of figures.
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("part", "u", "v").cast("bigint"))).collect()[0]
        if now[0] == 0 or tuple(now) == before:
            break
        before = tuple(now)
        both = e.union(e.selectExpr("part", "v as u", "u as v"))
        low = both.groupBy("part", "u").agg(F.min("v").alias("m")).selectExpr("part", "u", "least(m, u) as m")
        large = both.join(low, ["part", "u"]).where("v > u").selectExpr("part", "v as u", "m as v").where("u <> v").distinct()
        low = large.groupBy("part", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["part", "u"]).selectExpr("part", "inline(array(struct(greatest(v, m) as u, least(v, m) as v), struct(u as u, m as v)))").where("u <> v").distinct()
        e = durable(small, "stars")
    else:
        raise RuntimeError("components did not settle")
    return e.selectExpr("part", "u as node", "v as root")


class SupersessionTable:
    """The records of a log whose nodes name what they replace, fed batch by batch in any order.

    In rising ``seq`` a node replaces the records its ``supersedes`` names; a name stands for whatever
    has replaced it since, and replacing a merged record replaces all of it. So a record is a connected
    component of the naming links, named by its least seq, and its last node decides.

    ``nodes`` is a bucketed table with one row a node: the record it was put into, and on the record's
    own row the last node and whether that is retracted. A batch that joins two records changes one row,
    the lesser's takes over and the other's becomes a tombstone that points to it, so record names
    survive merges. ``pending`` holds the links to nodes that have not arrived; a late node finds the
    links that name it there.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        fields = lambda text: T.StructType([T.StructField(n, t) for n, t in text])
        string, big = T.StringType(), T.LongType()
        self.spark, self.path, self.batch = spark, path.rstrip("/"), 0
        self.nodes = BucketedTable.create(spark, f"{self.path}/nodes", fields([("part", string), ("node", big), ("root", big), ("last", big), ("gone", T.BooleanType()), ("batch", big)]), ["part", "node"], "batch", buckets)
        self.pending = BucketedTable.create(spark, f"{self.path}/pending", fields([("part", string), ("name", big), ("by", big), ("batch", big)]), ["part", "name", "by"], "batch", buckets)

    def _find(self, keys: DataFrame) -> DataFrame:
        """(part, node, root, head, last, gone) of the nodes among ``keys`` that have arrived; head is the record now."""
        columns = ["part", "node", "root", "head", "last", "gone"]
        found = durable(self.nodes.lookup(keys).select("part", "node", "root", F.col("root").alias("head"), "last", "gone"), "found")
        done, open_ = found.where("root = node").select(*columns), found.where("root <> node").select("part", "node", "root", "head")
        for _ in range(self.batch + 1):
            # A pointer may lead to a record that was joined to another since: follow it.
            if not open_.take(1):
                return done
            heads = self.nodes.lookup(open_.select("part", F.col("head").alias("node")).distinct()).select("part", F.col("node").alias("head"), F.col("root").alias("next"), "last", "gone")
            both = durable(open_.join(heads, ["part", "head"]), "found")
            done = done.union(both.where("next = head").select(*columns))
            open_ = both.where("next <> head").select("part", "node", "root", F.col("next").alias("head"))
        raise RuntimeError("pointers do not end")

    def apply(self, log: DataFrame) -> None:
        """Applies (part, seq, gone, names) rows: a new version of both tables.

        Rows with a null part or seq can't be placed and are left out. Null names, a node's own seq and
        those of later nodes have no effect; names that never arrive stay pending. Repeats have no
        effect; of rows that repeat a seq one that is gone is enough.
        """
        self.batch += 1
        at = F.lit(self.batch).cast("bigint").alias("batch")
        log = log.where("part is not null and seq is not null")
        names = F.filter(F.coalesce("names", F.array().cast("array<bigint>")), lambda x: x < F.col("seq"))
        rows = log.groupBy("part", F.col("seq").alias("node")).agg(F.max(F.coalesce("gone", F.lit(False))).alias("new"), F.array_distinct(F.flatten(F.collect_set(names))).alias("names"))
        waiting = None
        if self.nodes.version:
            rows = durable(rows, "batch")
            keys = rows.select("part", "node").union(rows.select("part", F.explode("names")))
            span = rows.agg(F.min("node"), F.max("node")).collect()[0]
            if self.pending.version and span[0] is not None:
                # Files are in the order of names, so in a feed without late nodes nothing is read here.
                waiting = self.pending.snapshot().where(F.col("name").between(span[0], span[1]))
                waiting = durable(waiting.join(rows.select("part", F.col("node").alias("name")), ["part", "name"], "left_semi").select("part", "name", "by"), "waiting")
                keys = keys.union(waiting.select("part", "by"))
            known = self._find(keys.distinct())
        else:
            known = self.spark.createDataFrame([], "part string, node bigint, root bigint, head bigint, last bigint, gone boolean")
        # Every node of the batch or named by it, as far as it has arrived, and where it stood before: in a record or new.
        nodes = durable(rows.join(known, ["part", "node"], "full").withColumn("at", F.coalesce("head", "node")), "nodes")
        links = nodes.select("part", F.explode("names").alias("name"), F.col("node").alias("by"), F.col("at").alias("a"), F.lit(False).alias("waited"))
        if waiting is not None:
            links = links.union(waiting.join(nodes.select("part", F.col("node").alias("by"), F.col("at").alias("a")), ["part", "by"]).select("part", "name", "by", "a", F.lit(True)))
        ends = durable(links.join(nodes.select("part", F.col("node").alias("name"), F.col("at").alias("b")), ["part", "name"], "left"), "ends")
        # A link waits while its name is missing; those that waited and are tied now leave.
        self.pending.apply(ends.where("(b is null) <> waited").select("part", "name", "by", at, F.col("waited").alias("_deleted")))
        roots = graph_components(ends.where("b is not null").select("part", "a", "b")).select("part", F.col("node").alias("at"), F.col("root").alias("top"))
        placed = nodes.join(roots, ["part", "at"], "left").withColumn("top", F.coalesce("top", "at"))
        # What each node says: of its record, the last node so far, as it was and as it comes; of rows that
        # point elsewhere now, its own and that of a record that was joined to another, where they point.
        none = lambda kind: F.lit(None).cast(kind)
        state, last = "struct<last: bigint, gone: boolean>", lambda n, g: F.struct(F.col(n).alias("last"), F.col(g).alias("gone"))
        was = F.when(F.col("head").isNotNull(), last("last", "gone")).cast(state)
        come = F.when(F.col("new").isNotNull(), last("node", "new")).cast(state)
        say = lambda key, m, o, to: F.struct(key.alias("node"), m.alias("m"), o.alias("o"), to.alias("to"))
        top, node, head = F.col("top"), F.col("node"), F.col("head")
        said = F.array(
            say(top, F.greatest(was, come), F.when(head == top, was), none("bigint")),
            F.when((node != top) & ~F.coalesce(F.col("root") == top, F.lit(False)), say(node, none(state), none(state), top)),
            F.when(head != top, say(head, none(state), none(state), top)),
        )
        said = placed.select("part", F.explode(said).alias("s")).where("s is not null").select("part", "s.*")
        one = said.groupBy("part", "node").agg(F.max("m").alias("m"), F.max("o").alias("o"), F.max("to").alias("to")).where("to is not null or o is null or o <> m")
        gone = F.coalesce("m.gone", F.lit(True)) | F.col("to").isNotNull()
        self.nodes.apply(one.select("part", "node", F.coalesce("to", "node").alias("root"), F.when(F.col("to").isNull(), F.col("m.last")).alias("last"), F.when(F.col("to").isNull(), F.col("m.gone")).alias("gone"), at, gone.alias("_deleted")))

    def standing(self) -> DataFrame:
        """(part, record, seq): the records that stand now, with their last node."""
        return self.nodes.snapshot().select("part", F.col("node").alias("record"), F.col("last").alias("seq"))


def standing(nodes: DataFrame, path: str, buckets: int | None = None, batches: int = 2, part: str = "sitting_uid", seq: str = "seq", supersedes: str = "supersedes", state: str = "state", arrival: str = "ord") -> DataFrame:
    """The records of a node log that stand at its end: (part, record, seq).

    The log is applied to a ``SupersessionTable`` at ``path`` as it arrived, in ``batches`` of about
    equal size by ``arrival`` (without that column in one); the result does not depend on their number.
    State retracted, in any case and spacing, removes a record. An empty log gives no rows.
    """
    spark = nodes.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), nodes.count() // BUCKET_ROWS)
    table = SupersessionTable(spark, path, buckets)
    gone = F.lower(F.regexp_replace(F.col(f"`{state}`"), r"(?U)\s+", "")) == "retracted"
    order = F.col(f"`{arrival}`") if arrival in nodes.columns else F.lit(None).cast("bigint")
    log = nodes.select(F.col(f"`{part}`").cast("string").alias("part"), F.col(f"`{seq}`").cast("bigint").alias("seq"), gone.alias("gone"), F.col(f"`{supersedes}`").cast("array<bigint>").alias("names"), order.alias("arrival"))
    cuts = []
    if batches > 1 and arrival in nodes.columns:
        cuts = sorted({x for x in log.agg(F.percentile_approx("arrival", [k / batches for k in range(1, batches)])).collect()[0][0] or []})
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        fits = F.lit(True)
        if low is not None:
            fits = F.col("arrival") > low
        if high is not None:
            fits = fits & (F.col("arrival") <= high)
        if low is None and cuts:
            fits = fits | F.col("arrival").isNull()
        table.apply(log.where(fits))
    return table.standing().withColumnRenamed("part", part)


__all__ = ["BLOCK_BITS", "BucketedTable", "SupersessionTable", "components", "graph_components", "standing", "star_components"]
