"""Session and lineage helpers.

Everything heavy in this package runs as Spark jobs; these helpers only build
a session for tests and benches, find the shared checkpoint folder the cluster
names, and write intermediate tables there so long plans can be cut.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "vitae") -> SparkSession:
    """A local session for tests and benches (clusters bring their own)."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(os.environ.get("VITAE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("VITAE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the session or its context names it.

    A fresh folder under the system's temporary directory is made only where
    none is named and the master is local, as in tests. On a cluster such a
    folder would be a different one on each machine, so there it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="vitae-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def prepare(spark: SparkSession) -> SparkSession:
    """Make the session ready for this package's operators.

    Finds the shared folder, and sends the package to the executors once per
    context, so that their Python workers can import it wherever it lies on
    the driver.
    """
    ensure_checkpoint_dir(spark)
    context = spark.sparkContext
    if getattr(context, "_vitae_shipped", False) is not True:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(prefix="vitae-src-"), "vitae.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.join("vitae", os.path.relpath(path, root)))
        context.addPyFile(archive)
        context._vitae_shipped = True
    return spark


def materialize(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder, with the writer's ``options``, and read it back.

    Cuts lineage (a lost executor re-reads the files instead of recomputing the
    scan and shuffles behind them) and gives the optimizer true file sizes.
    """
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the shuffle files and broadcasts of queries that have ended, now.

    Spark deletes them when the driver collects the query's objects, which a driver
    with room in its heap may never do; until then they lie on the executors' disks.
    """
    spark.sparkContext._jvm.System.gc()


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows; scans at most limit+1 rows."""
    return df.limit(limit + 1).count() <= limit
