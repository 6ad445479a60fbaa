"""Session helpers: shared scratch tables, shipping the package, size-checked joins."""

from __future__ import annotations

import atexit
import gc
import io
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PACKAGE = os.path.basename(os.path.dirname(os.path.abspath(__file__)))

#: A side of a join with more rows than this is never broadcast by hand.
BROADCAST_ROWS = 20_000
#: Rows or bytes of a task that writes a table whose size is known.
TASK_ROWS, TASK_BYTES = 25_000, 8_000_000
#: Bytes of a table's files whose rows are sorted in one task, where the table is dealt by a key.
SORT_BYTES = 2_000_000

#: With it, Spark removes a query's shuffle files when the query ends, not once the driver has collected its plan.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_scratch: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    Where none is set, a session in one process (``local[n]``, as in tests) gets a local one; on
    a cluster that is an error, as no executor would see what another one wrote.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliant-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def trim_driver(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage once its heap has grown to more than half of what it may take.

    Plans, metrics and relations of finished queries are garbage, but G1 lets the heap grow before it
    collects the old ones. A full collection gives memory back, and lets Spark drop the shuffle files
    and broadcasts that no table needs any more.
    """
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        gc.collect()  # what Python has forgotten only lets go of its Java objects then
        spark._jvm.java.lang.System.gc()


def _size(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` into a task for each ``SORT_BYTES`` of its files, for windows by this key.

    Left alone, Spark packs what is dealt into about as many tasks as there are cores, so a task's sorts and
    sums grow with the table. Where two tasks for each core at most are needed, the choice stays Spark's.
    """
    size = _size(df)
    parts = -(-size // SORT_BYTES)
    few = parts <= 2 * df.sparkSession.sparkContext.defaultParallelism
    return df if few or size >= 1 << 50 else df.repartition(parts, key)


def compacted(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` in no more partitions than the bytes of ``like`` need, and two for each core at least.

    Many small files cost more than they hold. ``like`` is the table that ``df`` is made of; where
    Catalyst overestimates its size, the partitions stay as they are.
    """
    size = _size(like)
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)) if size < 1 << 50 else 1 << 30)


def materialize(df: DataFrame, partitions: Sequence[str] = (), rows: int | None = None, like: DataFrame | None = None, release: bool = False) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet under the shared folder and read it back.

    Unlike ``checkpoint()`` this computes the plan once, and the copy survives lost executors.
    ``rows``, where it is known, is the most rows that ``df`` can have, ``like`` a table that is as
    large: tasks, and so files, are then as many as these need. The files go when the driver
    ends, or with ``drop_scratch``. With ``release`` the shuffle files that ``df`` took go as soon as
    it is written.
    """
    spark = df.sparkSession
    trim_driver(spark)
    path = f"{shared_dir(spark)}/foliant-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // TASK_ROWS)))
    if like is not None:
        df = compacted(df, like)
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    if release:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partitions).parquet(path) if partitions else df.write.parquet(path)
    finally:
        if release:
            spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark() -> int:
    """A point in time, for ``drop_scratch``."""
    return len(_scratch)


def drop_scratch(mark: int = 0, keep: int = 0) -> None:
    """Remove the tables that ``materialize`` wrote in this process since ``scratch_mark`` gave ``mark``, but for the last ``keep``."""
    while len(_scratch) > mark + keep:
        spark, path = _scratch.pop(-1 - keep)
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        except Exception:  # the session has gone, and its folder with it
            pass


atexit.register(drop_scratch)


def ship(spark: SparkSession) -> None:
    """Let Python workers import the package when the launcher's PYTHONPATH lacks it."""
    sc = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(ROOT, PACKAGE)):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(top, name)
                    z.write(file, os.path.relpath(file, ROOT))
    path = os.path.join(tempfile.mkdtemp(prefix="foliant-ship-"), f"{PACKAGE}.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    before = list(sys.path)
    sc.addPyFile(path)
    sys.path[:] = before


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows at most, as a side of a join: broadcast if these are few, else dealt by the key.

    Left alone, Spark goes by the bytes of a table's files. Numbers are packed so well in these that it would
    send tables of a million rows through the driver, several for each query, and the larger the table the more.
    """
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df.hint("merge")


def join_dimension(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 64) -> DataFrame:
    """Join a table with skewed keys to a table with one row per key.

    The small side is broadcast only after its rows were counted. Beyond that size both sides
    shuffle, and the big side's keys are salted so that a hot key is dealt over many tasks.
    """
    if is_small(small, rows):
        return big.join(F.broadcast(small), list(on), how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(spread.hint("merge"), [*on, "__salt"], how).drop("__salt")


def numbered(df: DataFrame, keys: Sequence[str], into: str, first: int = 1) -> DataFrame:
    """Distinct ``keys``, numbered without gaps in their order, and in many tasks.

    Ranges of keys are sorted in a task each and written; a number is the place in its range after
    the sizes of the ranges before, of which there is one for each task.
    """
    rows = df.select(*keys).distinct().repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__p", before.alias("__before"))
    return join_dimension(rows.withColumn("__p", part), offsets, ["__p"]).select(*keys, (F.col("__before") + place + first).alias(into))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
