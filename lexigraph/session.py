"""Session settings and small driver-side helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(cores: int | str = "*", shuffle_partitions: int = 8,
              app: str = "lexigraph", memory: str | None = "12g") -> SparkSession:
    """A local session with AQE on and the UI off (for tests and the bench).

    On a cluster, build the session the usual way; nothing in the library
    depends on these settings except ``spark.checkpoint.dir`` (see
    :func:`checkpoint_dir`).
    """
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if memory:
        b = b.config("spark.driver.memory", memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there.  Only a local session may run
    without one (tests): it gets a fresh folder under the temp directory.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(d or tempfile.mkdtemp(prefix="lexigraph-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives
    executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def bounded(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` marked for broadcast if it has ``rows`` rows at most (counted);
    beyond that it is joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def as_table(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet into the shared checkpoint folder and read
    back: later reads prune columns and push filters down."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of tables that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Rounds:
    """The tables of an iterative operator, as Parquet in the shared checkpoint
    folder: lineage ends at each, and a round's table goes once the next one of
    its name is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4()}"
        self.last: dict[str, str] = {}
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table; the table of this name before it is deleted."""
        self.count += 1
        path = f"{self.folder}/{name}-{self.count}"
        df.write.parquet(path)
        old, self.last[name] = self.last.get(name), path
        if old:
            drop_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` as a table of its own; all tables of the rounds are deleted."""
        path = f"{self.folder}-result"
        df.write.parquet(path)
        drop_path(self.spark, self.folder)
        return self.spark.read.schema(df.schema).parquet(path)


def files_mark(spark: SparkSession, path: str) -> tuple:
    """Changes when the files of a table do: their number and bytes, and a mark
    of their names, sizes and times.  Files are listed, none is read; one row
    reaches the driver."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return tuple(files.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lexigraph`` importable on the executors' Python workers
    (``SparkContext.addPyFile`` of a zip of the package, once per
    application) - the same as submitting with ``--py-files``."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="lexigraph-py-"), "lexigraph.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
