"""What the corpus operators share: scratch tables on the shared folder, shipping of
the package to Python workers, and distributed connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: What the deletion of a job's shuffle files may take.
FREEING_SECONDS = 2.0


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Where it is unset, on a local master (tests), a temporary folder is made once per
    application and removed when the process ends; on a cluster it must be set.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own scratch folder, which is deleted when the driver's process ends."""
    folder = f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}"
    if folder not in _OWN:
        _OWN[folder] = folder
        atexit.register(_deleted, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _deleted(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: what follows is not recomputed when an executor is lost, and
    the rows cannot change between two uses.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    jvm_trimmed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def bucketed(df: DataFrame, by: str, buckets: int, name: str, kind: str | None = None) -> DataFrame:
    """The same as a table bucketed by a column, so that joins on it don't shuffle its rows; in a folder for each ``kind``.

    The files lie in the shared folder; only their description is in the session's catalog, until the driver's process ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"lodestone_{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, by)
    (writer.partitionBy(kind) if kind else writer).saveAsTable(table)
    atexit.register(_forgotten, spark, table)
    out = spark.table(table)
    out._lodestone_path = path
    return out


def _forgotten(spark: SparkSession, table: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def dropped(df: DataFrame, inside: str = "") -> None:
    """Delete the files of a table made here that nothing reads any more, or those of a folder inside."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{df._lodestone_path}/{inside}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def trimmed() -> None:
    """Give memory that Python has freed back to the system; where the C library can't, nothing happens."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def jvm_trimmed(spark: SparkSession) -> None:
    """The same for what the driver's JVM has freed outside its heap, most of it its compilers'; a JVM that can't does nothing."""
    with contextlib.suppress(Exception):
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        lang = jvm.java.lang

        def array(kind: object, *items: object) -> object:
            out = gateway.new_array(kind, len(items))
            for i, x in enumerate(items):
                out[i] = x
            return out

        # the server's own class is hidden from py4j, so its interface's method is called
        names = "javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"
        invoke = lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, *map(lang.Class.forName, names)))
        commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        server = lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke.invoke(server, array(lang.Object, commands, "systemTrimNativeHeap", None, None))


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver happens to collect its garbage.

    Spark holds on to the last job until another has run, so a small one comes first. Files are deleted in the
    background once the driver has forgotten a job, hence the pause.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    trimmed()
    spark.sparkContext._jvm.System.gc()
    jvm_trimmed(spark)
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # one process deletes its files itself
        time.sleep(FREEING_SECONDS)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per application."""
    key = f"shipped-{spark.sparkContext.applicationId}"
    if key in _OWN:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="lodestone-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/lodestone_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(archive)
    _OWN[key] = archive


def partitions_for(n_units: float, per_partition: float, least: int = 1) -> int:
    return max(least, int(-(-n_units // per_partition)))


# --- connected components -------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, smallest id) of the components of the given links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, label[u], low)
        np.minimum.at(after, label[v], low)
        after = after[after]
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, label):
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the links of a partition by a spanning forest; memory follows the nodes."""
    a = b = np.empty(0, np.int64)
    for x in batches:
        a = np.concatenate([a, x.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, x.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 4_000_000:
            a, b = forest(a, b)
    if len(a):
        a, b = forest(a, b)
        for i in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (two long columns, any names).

    The component id is the smallest node reachable. Each partition first contracts its
    links to a forest; then large-star and small-star steps alternate until the edge set
    no longer changes. A step is an aggregate by node and a join on it, so nothing grows
    with the largest component: partial aggregation folds a hot node before the shuffle
    and adaptive execution splits the join. Null or equal ends are ignored; nodes with no
    link do not appear.
    """
    spark = links.sparkSession
    ship(spark)
    first, second = links.columns[:2]
    pairs = links.select(F.col(first).cast("long").alias("u"), F.col(second).cast("long").alias("v")).where("u <> v")
    edges = written(pairs.mapInArrow(_contract, "u long, v long").distinct(), "edges")
    signature = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == signature or now[0] == 0:
            break
        signature = now
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                    F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
                )
            ).alias("e")
        ).select("e.u", "e.v")
        after = written(small.where("u <> v").distinct(), "edges")
        dropped(edges)
        edges = after
    roots = edges.select(F.col("v").alias("u"), "v").distinct()
    return edges.union(roots).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
