"""Session settings and the shared scratch folder that cuts long lineages."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app_name: str = "hazegrid", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every operator here assumes (UTC, AQE, Arrow)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.parquet.compression.codec": "zstd",
        # larger generated methods would run interpreted: the JVM does not compile them
        "spark.sql.codegen.hugeMethodLimit": "8000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not start in its folder. Once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="hazegrid-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/hazegrid.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session may run without that setting; it then gets a temporary
    folder of its own. A cluster without the setting is refused, because a folder on one
    machine does not outlive that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    # local-cluster has executors of its own and counts as a cluster
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="hazegrid-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def checkpoint_folder(spark: SparkSession) -> None:
    """Give Spark's own ``checkpoint()`` the scratch folder, unless it has one."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_root(spark))


#: Session setting: shuffle files are deleted at the end of the job that wrote them.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, partition_by: Sequence[str] = (), keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` to the scratch folder and read it back, optionally in Hive partitions.

    Iterative operators use this between rounds: the plan stays short, a lost executor
    re-reads files instead of recomputing every earlier round, and the file sizes give the
    optimiser real statistics for its broadcast decision. Shuffle files usually stay until the
    driver collects its garbage; without ``keep_shuffles`` those of this job go when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREE_SHUFFLES, None)
    if not keep_shuffles:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        if not keep_shuffles:
            spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files behind an earlier :func:`materialize` result."""
    path = getattr(df, "_scratch_path", None)
    if path is None:  # not a scratch table
        return
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete every scratch table of this application; call it once its results are stored."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{spark.sparkContext.applicationId}")
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
