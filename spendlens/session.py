"""Session helpers.

The library never creates its own cluster settings when a session exists: it reads
what the cluster configured (checkpoint folder, shuffle partitions) and only fills
in values that are unset, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Defaults for local runs and tests. On a cluster these come from the deployment.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Small-in-bytes but sort-heavy stages (windows over distinct values) keep the
    # cores busy instead of being merged into a few 1 MB partitions.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # Broadcast decisions stay behind Spark's own size checks: the static one uses
    # plan statistics, the adaptive one the measured size of a finished shuffle stage.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Constraint propagation only adds inferred filters (IsNotNull, ...); on the k-NN
    # and winsorising plans, which alias many conditional expressions, it costs the
    # optimizer seconds per round. Recommended on the cluster for those jobs too.
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.driver.memory": "16g",
    # Remove checkpoint files once the DataFrames that use them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "spendlens") -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Only when it is unset (local
    tests) a folder is created under the system temp dir and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spendlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder (model files, written tables)."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name.strip("/")


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever their folder.

    The sources travel as one small zip through Spark's own file distribution, once per
    context, so a caller needs the package on the driver's path only.
    """
    sc = spark.sparkContext
    if getattr(sc, "_spendlens_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="spendlens-src-"), "spendlens_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._spendlens_shipped = True


def checkpointed(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    Used where a plan shrinks (value counts, per-customer aggregates) and the
    result feeds several branches: the big input is read once, the branches read
    the small table, and a lost executor re-reads the files instead of recomputing
    the whole upstream plan. Reliable ``checkpoint`` only, never a local one.
    """
    from pyspark.sql import functions as F

    ensure_checkpoint_dir(df.sparkSession)
    cp = df.checkpoint(eager=True)
    # Fresh column identities, so frames checkpointed from one another can be joined.
    return cp.select(*[F.col(f"`{c}`").alias(c) for c in cp.columns])
