"""Session set-up and durable intermediates."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A session for tests and single-machine runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediates: the one that ``spark.checkpoint.dir`` names.

    Only a local master may go without that setting: it then gets a temporary folder of its
    own. On a cluster a missing setting is an error, since a machine-local folder would not
    survive a lost executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tessera-checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most: int = 2 << 20) -> None:
    """Send at most ``most`` bytes (or a single row) to a Python worker at once, unless the session says less.

    The default of 64 MB holds a batch of texts several times over: in the buffers of the
    executor, in those of the worker, and as strings. No result hangs on it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, f"{most}b")


#: Rows of the input for each partition of a shuffle, and bytes up to which small partitions are put together.
SHUFFLE_ROWS, SHUFFLE_BYTES = 500_000, 16 << 20
_UNITS = {"": 0, "b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30, "t": 40, "tb": 40}


def dealt_by_size(spark: SparkSession, rows: int) -> None:
    """Let shuffles have a partition for each ``SHUFFLE_ROWS`` of an input, unless the session has more.

    With a fixed number of partitions a task's rows grow with the input, until they no longer
    fit its memory and are spilled; the default size of partitions that are put together (64 MB
    compressed) is some ten million pairs of numbers. No result hangs on it.
    """
    key, size = "spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if int(spark.conf.get(key)) < (need := -(-rows // SHUFFLE_ROWS)):
        spark.conf.set(key, str(need))
    now = re.fullmatch(r"(\d+)\s*([a-z]*)", spark.conf.get(size).strip().lower())
    if now is None or int(now[1]) << _UNITS.get(now[2], 0) > SHUFFLE_BYTES:
        spark.conf.set(size, f"{SHUFFLE_BYTES}b")


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediates wherever it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
