"""Spark session helpers.

The session settings that matter at scale are set here once: adaptive execution (runtime
coalescing and skew-join splitting), Arrow batches for the one Python job, and a reliable
checkpoint directory for the operators that must cut lineage.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Source files can be long; small Arrow batches keep the Python worker's memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.session.timeZone": "UTC",
    # Checkpoint files go once nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "chunkgraph", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the defaults above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that setting always wins.
    Only a local-mode session without the setting (tests, benchmarks on one machine) gets a
    fresh folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster job needs a shared checkpoint folder")
    local_dir = tempfile.mkdtemp(prefix="chunkgraph-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


#: Parquet bytes of an input for each of the partitions that shuffles begin with.
BYTES_PER_PARTITION = 4 << 20
_INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
#: Shuffled bytes that AQE merges to one partition. Names and paths compress to a fifteenth of
#: what they take in a sort, so Spark's 64 MB are a gigabyte of a task's memory.
_ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ADVISORY_BYTES = 16 << 20


def initial_partitions(spark: SparkSession) -> int:
    """How many partitions the shuffles of this session begin with, before AQE merges small ones."""
    set_to = spark.conf.get(_INITIAL, None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(set_to or 0))


def grow_shuffles(spark: SparkSession, path: str) -> int:
    """Let shuffles begin with a number of partitions that grows with the input at ``path``, so
    that what a task sorts or aggregates does not: AQE merges partitions that come out small,
    and still splits skewed ones. The number is only ever raised, and with it goes the size that
    AQE merges to, unless the session names one. Without AQE both have no effect."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    n = -(-fs.getContentSummary(p).getLength() // BYTES_PER_PARTITION)
    if n > initial_partitions(spark):
        spark.conf.set(_INITIAL, str(n))
        if spark.sparkContext.getConf().get(_ADVISORY) is None:
            spark.conf.set(_ADVISORY, str(ADVISORY_BYTES))
    return initial_partitions(spark)


def remember(spark: SparkSession, path: str) -> str:
    """Note a folder of intermediate data, for :func:`clear_stores`."""
    sc = spark.sparkContext
    sc._chunkgraph_stores = [*getattr(sc, "_chunkgraph_stores", []), path]
    return path


def clear_stores(spark: SparkSession) -> int:
    """Delete the intermediate tables that this session's operators have stored, and return how
    many. To be called once the results that read them are written; a job that dies leaves its
    folders to the clean-up of ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    paths, sc._chunkgraph_stores = getattr(sc, "_chunkgraph_stores", []), []
    for path in paths:
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def store(df, name: str):
    """Write ``df`` once, as Parquet in the shared checkpoint folder, and read it back: what
    follows starts from the files and computes nothing of it again."""
    spark = df.sparkSession
    path = remember(spark, f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by the Python workers, as ``--py-files`` would.

    Operators that run Python on executors (extraction, splitter, directory source and
    sink) call this first. The package is zipped once per SparkContext and added with
    ``addPyFile``; Spark distributes it to every executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_chunkgraph_shipped", False):
        return
    import zipfile
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out = os.path.join(tempfile.mkdtemp(prefix="chunkgraph-pyfiles-"), "chunkgraph.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for base, _dirs, files in os.walk(pkg_dir):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    sc._chunkgraph_shipped = True
