"""Session helpers: tables, checkpoints that outlive executors, joins that stand hot keys."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(context: SparkContext) -> None:
    """Give this package to the executors, once per application: they need no copy or path of their own."""
    if context.applicationId in _shipped:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="factloom-package-")  # on the driver only: Spark hands the archive out
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "factloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(home):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.relpath(path, os.path.dirname(home)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    ship(spark.sparkContext)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder in ``spark.checkpoint.dir``. Only where neither it nor a folder is set and everything runs in one
    machine's process, make one of our own, which is deleted at the end; a cluster without a shared folder is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="factloom-")
            atexit.register(shutil.rmtree, shared, ignore_errors=True)
        context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, held in the shared checkpoint folder: it survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession) -> str:
    """The path of a new folder in the shared checkpoint folder, for tables written between steps."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def drop_scratch(spark: SparkSession, folder: str) -> None:
    """Delete what was written below ``folder``."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int = 200_000, text: str | None = None, max_bytes: int = 1 << 26) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows and, where a column ``text`` of any length is named,
    at most ``max_bytes`` in it; else ``df`` itself, to be joined by shuffle."""
    if text is None:
        fits = df.limit(max_rows + 1).count() <= max_rows
    else:
        rows, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
        fits = rows <= max_rows and size <= max_bytes
    return F.broadcast(df) if fits else df


def spread(df: DataFrame, rows: int, rows_per_task: int = 2_000) -> DataFrame:
    """``df`` in as many even parts as work on each row is worth, whatever its bytes: for costly functions of rows."""
    parts = max(1, min(-(-rows // rows_per_task), 20_000))
    return df.repartition(parts)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "inner", hot_rows: int = 200_000, most_hot: int = 10_000) -> DataFrame:
    """Join ``rows`` with ``groups``, which has one row for each key and in ``size`` the number of its rows, and is read
    several times: it should be held.

    A key with more than ``hot_rows`` rows (or total / ``most_hot``, if that is more) is split: its rows are spread by a
    hash of their columns over so many parts that each has about that many rows, and its group's row is repeated for
    each. So no task gets all rows of a hot key. Only 64-bit hashes of hot keys and their numbers of parts are broadcast,
    at most ``most_hot`` of them at any size of the data; a key that shares its hash is split along, to no harm.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(hot_rows, total // most_hot)
    hash_of = F.xxhash64(*on)
    hot: dict[int, int] = {}
    for r in groups.filter(F.col(size) > limit).select(hash_of.alias("h"), F.ceil(F.col(size) / limit).cast("int").alias("n")).collect():  # at most most_hot
        hot[r.h] = max(hot.get(r.h, 1), r.n)
    if not hot:
        return rows.join(groups, on, how)
    parts = F.broadcast(rows.sparkSession.createDataFrame(sorted(hot.items()), "_hot bigint, _parts int"))
    split = lambda df: df.withColumn("_hot", hash_of).join(parts, "_hot", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = split(rows).withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.col("_parts")).cast("int")).drop("_hot", "_parts")
    right = split(groups).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_hot", "_parts")
    return left.join(right, [*on, "_part"], how).drop("_part")


def squeeze(column: Column) -> Column:
    """Outer spaces cut, runs of spaces made one."""
    return F.trim(F.regexp_replace(column, r"\s+", " "))
