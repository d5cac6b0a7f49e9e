"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session pinned to UTC with adaptive execution on; extra settings by keyword (dots as ``__``)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def _local(spark: SparkSession) -> bool:
    """Driver and executors are one process on one machine."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a fresh local
    one; on a cluster that is an error, because no folder of one machine is seen by all."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        set_to = jdir.get() if jdir.isDefined() else None
    if not set_to and not _local(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not set_to:
        set_to = tempfile.mkdtemp(prefix="tessera-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(set_to)
    return set_to.rstrip("/")


def _path(spark: SparkSession, path: str):
    """The file system and Hadoop path of a name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage, survives executor loss. The table goes
    when ``discard`` is called on the result, or else when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    fs, p = _path(spark, path)
    df.write.parquet(path)
    fs.deleteOnExit(p)
    out = spark.read.schema(schema).parquet(path)
    out._stored_at = path
    return out


def at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    fs, p = _path(spark, path)
    fs.deleteOnExit(p)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no result still to be computed reads."""
    for df in tables:
        fs, p = _path(df.sparkSession, df._stored_at)
        fs.delete(p, True)


def importable(spark: SparkSession) -> None:
    """Python workers find this package: by path where they run on the driver's machine, else as a zip shipped to them."""
    root = Path(__file__).resolve().parents[1]
    sc = spark.sparkContext
    if _local(spark):
        env = sc.environment
        if str(root) not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (str(root), env.get("PYTHONPATH", "")) if x)
    elif not any(x.startswith("tessera-") for x in sc._python_includes):
        package = Path(__file__).resolve().parent
        name = f"tessera-{sc.applicationId}.zip"
        fs, to = _path(spark, f"{shared_dir(spark)}/{name}")
        with tempfile.TemporaryDirectory() as d:
            with zipfile.ZipFile(f"{d}/{name}", "w", zipfile.ZIP_DEFLATED) as z:
                for f in sorted(package.rglob("*.py")):
                    z.write(f, f.relative_to(root))
            fs.copyFromLocalFile(True, True, sc._jvm.org.apache.hadoop.fs.Path(f"file://{d}/{name}"), to)
        fs.deleteOnExit(to)
        sc.addPyFile(to.toString())


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the workers, which hand freed memory back after each task."""
    importable(df.sparkSession)
    return df.mapInArrow(lean(run), schema)


def lean(run):
    """``run`` over batches, after which the worker's allocators return what is free: a reused worker waits small."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def in_order(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once, with consecutive numbers from 0 by partition and place as ``name``."""
    from pyspark.sql import functions as F
    from pyspark.sql import Window as W

    at, part, n, base = own_name(df, "at", "part", "n", "base")
    rows = stored(df.withColumn(at, F.monotonically_increasing_id()), "numbered")  # partition in the upper bits, place below
    rows = rows.withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias(n))  # one row a partition
    before = F.coalesce(F.sum(n).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return rows.join(sizes.select(part, before.alias(base)), part).withColumn(name, number).select(name, *df.columns)


def own_name(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have in any letter case, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for s in stems:
        while s.lower() in taken:
            s = f"{s}_"
        taken.add(s.lower())
        out.append(s)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
