"""Session helpers: a local session for tests/bench and the shared scratch folder."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "staylens") -> SparkSession:
    """Session for tests and the local bench.  Cluster deployments configure their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(FIT_PARTITIONS, "2")  # small inputs: fewer tasks per pass of a fit
        .config("spark.driver.memory", os.environ.get("STAYLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables and checkpoints.

    The folder named by ``spark.checkpoint.dir``, or else one on the default Hadoop file system
    if that is shared.  A temporary folder is only made up for a session that runs in one process.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        default = sc._jvm.org.apache.hadoop.fs.FileSystem.get(sc._jsc.hadoopConfiguration())
        if default.getUri().getScheme() != "file":
            root = f"{default.getHomeDirectory().toString()}/staylens-{sc.applicationId}"
        elif re.fullmatch(r"local(\[.*\])?", sc.master):
            root = tempfile.mkdtemp(prefix="staylens-ckpt-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


def durable_root(spark: SparkSession) -> str:
    """The configured checkpoint folder itself, which outlives an application; the application's own folder if none is set."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return root.rstrip("/") if root else checkpoint_root(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the checkpoint root for one written table."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_HELD: dict = {}
_HELD_LOCK = threading.Lock()


@contextmanager
def held_setting(spark, key: str, value: str):
    """A session setting with another value for a while.  Uses may overlap (threads of a pool, nesting): the last
    one to end restores the setting."""
    at = (id(spark._jsparkSession), key)
    with _HELD_LOCK:
        users, old = _HELD.get(at, (0, None))
        if not users:
            old = spark.conf.get(key)
            spark.conf.set(key, value)
        _HELD[at] = (users + 1, old)
    try:
        yield
    finally:
        with _HELD_LOCK:
            users, old = _HELD.pop(at)
            if users > 1:
                _HELD[at] = (users - 1, old)
            else:
                spark.conf.set(key, old)


def wide_projection_mode(spark):
    """Run an action over a wide derived projection with constraint propagation off.

    Dozens of CASE / COALESCE aliases of the same source columns (one-hot levels,
    imputed copies) under a null filter make the optimizer's constraint inference
    combinatorial: planning, not execution, then takes minutes.
    """
    return held_setting(spark, "spark.sql.constraintPropagation.enabled", "false")


#: Session setting: partitions of the input of iterative fits (default: the cluster's parallelism).
FIT_PARTITIONS = "spark.staylens.fitPartitions"


def materialize(df, cache: bool = True, narrow: bool = True):
    """Cut the lineage of a frame that many jobs will re-read (fits, restarts, CV folds).

    The rows are written once to the shared checkpoint folder (``checkpoint``,
    which survives executor loss, unlike a local checkpoint) and optionally
    cached on top so repeated passes do not re-read the files.  With ``narrow``, partitions are
    merged (no shuffle) to at most ``spark.staylens.fitPartitions``: every pass of a fit runs one
    task per partition.  The number comes from the configuration, never from the data.  A caller
    that caches unpersists the frame when it is done.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    with wide_projection_mode(spark):
        out = df.checkpoint(eager=True)
    want = int(spark.conf.get(FIT_PARTITIONS, str(default_parallelism(spark))))
    if narrow and out.rdd.getNumPartitions() > want:
        out = out.coalesce(want)
    return out.persist() if cache else out


#: Bytes of rows that one task of a fit holds or reads at most, as the fit keeps them.
TASK_BYTES = 256 << 20


def size_parts(rows: int, row_bytes: int) -> int:
    """Partitions that ``rows`` rows of ``row_bytes`` each need, so that none passes ``TASK_BYTES``."""
    return max(1, -(-rows * row_bytes // TASK_BYTES))


def by_size(df, row_bytes: int, rows: int | None = None):
    """``df`` dealt evenly over as many partitions as its rows (counted unless given) need, and at least one for
    every core; a frame that fits one task stays as it is."""
    parts = size_parts(df.count() if rows is None else rows, row_bytes)
    return df if parts == 1 else df.repartition(max(parts, default_parallelism(df.sparkSession)))


def written(df, name: str, **options) -> tuple:
    """(frame, path): the rows written once to the shared folder as columns, of which each reader takes its own."""
    path = scratch_path(df.sparkSession, name)
    with wide_projection_mode(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def default_parallelism(spark) -> int:
    return max(1, int(spark.sparkContext.defaultParallelism))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark application.

    Functions that run on executors are pickled by reference, so the workers must be able to
    import the package also where only the driver's ``sys.path`` holds it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_staylens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="staylens-pkg-"), "staylens_pkg"), "zip",
                                  os.path.dirname(here), os.path.basename(here))
    sc.addPyFile(archive)
    sc._staylens_shipped = True
