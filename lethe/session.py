"""Session helpers: one place for the configuration every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings a job needs regardless of cluster size.  Shuffle partitions and
# file split size are left to the cluster; AQE coalesces small partitions
# and splits skewed join partitions at run time.
_CORE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Rows of an Arrow batch, at most, where rows hold texts.
ARROW_ROWS = 2000
# Target bytes per shuffle partition and per scan split on a cluster.
PARTITION_BYTES = 256 << 20
# Shuffle bookkeeping grows with map tasks x reduce partitions; above this
# many partitions each one grows instead (spill-friendly sort shuffle).
MAX_SHUFFLE_PARTITIONS = 250_000


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 expansion: float = 3.0) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of input.

    Shuffle partitions are sized so that the largest shuffle (token- and
    element-level explodes grow the data by about ``expansion``) lands
    near ``PARTITION_BYTES`` per partition, never below the cluster's
    core count; AQE then coalesces small partitions and splits skewed
    ones.  Scan splits match the same size.  The checkpoint folder is not
    set here: it must be a shared folder given with the session."""
    cores = max(1, executors * cores_per_executor)
    parts = max(cores * 2, min(MAX_SHUFFLE_PARTITIONS, int(input_bytes * expansion // PARTITION_BYTES) + 1))
    return {
        **_CORE_CONF,
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(PARTITION_BYTES),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
    }


def local_session(cores: int | str = 8, shuffle_partitions: int = 8,
                  app: str = "lethe") -> SparkSession:
    """A local session for tests and the benchmark (never for a cluster)."""
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", os.environ.get("LETHE_DRIVER_MEM", "16g")))
    for k, v in _CORE_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    On a cluster the setting must come with the session (a shared file
    system every executor sees).  Only a local-mode session without the
    setting, i.e. a test, gets a private scratch folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        d = tempfile.mkdtemp(prefix="lethe-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str = "frozen") -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back.
    What is not fixed by the data (a row's number, a range's bounds) is fixed
    from here on, also for a task that runs again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession) -> None:
    """For functions that run Python over texts: the session's Arrow batches
    are lowered to ``ARROW_ROWS`` rows, if they are larger, so that a worker's
    memory follows a batch of so many rows and not its partition."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Makes the package importable by Python workers anywhere: a zip of its
    modules goes out with ``addPyFile``, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_lethe_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    # Written on the driver only; Spark distributes it.
    archive = os.path.join(tempfile.mkdtemp(prefix="lethe-package-"), "lethe_package.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("lethe", os.path.relpath(full, package)))
    sc.addPyFile(archive)
    sc._lethe_shipped = True
