"""Session, shared folder and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_made: list[tuple[weakref.ref, str]] = []


def session(app: str = "filament", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; any setting can be overridden."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder is made, but only for a local master: on a
    cluster a machine-local folder would lose data with its executor, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="filament-")
    sc.setCheckpointDir(made)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/filament/{name}-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns a reader of that table.

    This cuts the lineage: a lost executor costs a re-read, not a recomputation, and what reads the
    table twice does not compute it twice.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop file system and path object, so that any storage Spark can write to will do."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Enough tasks for every core, for few rows that each cost much; not merged again by size.

    Rows are spread by a hash of ``keys``, not by the keys: else an earlier partitioning by these,
    merged into few tasks, would count as the same.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, F.xxhash64(*keys))


def release(spark: SparkSession | None = None) -> None:
    """Deletes the intermediate tables made so far (of one session, or of all): for long sessions, between jobs.

    DataFrames that still read such a table can't be used afterwards. Runs at exit as well.
    """
    kept = []
    for ref, path in _made:
        own = ref()
        if spark is not None and own is not spark:
            kept.append((ref, path))
            continue
        try:
            if own is not None and own.sparkContext._jsc is not None:
                fs, p = filesystem(own, path)
                fs.delete(p, True)
        except Exception:
            local = path.removeprefix("file://").removeprefix("file:")
            if os.path.isdir(local):
                shutil.rmtree(local, ignore_errors=True)
    _made[:] = kept


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
