"""Session defaults and helpers that every other module may rely on."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that results depend on, or that a cluster run wants by default.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int = 8, name: str = "rosterloom", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and for the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", memory)
    spark = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints. Where none is named, one of this machine, in local mode only."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "rosterloom-shared")


_WRITTEN: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder, removed by ``release`` or when Python ends."""
    path = f"{shared_folder(spark)}/rosterloom-{kind}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: a lost executor costs only its own tasks.

    A written table, unlike a checkpoint, also has a size that the optimizer knows.
    """
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Remove the intermediate tables written so far (from number ``since``): once the results built on them are written."""
    for spark, path in _WRITTEN[since:]:
        _remove(spark, path)
    del _WRITTEN[since:]
    if not _WRITTEN:
        atexit.unregister(release)


@contextmanager
def intermediates() -> Iterator[None]:
    """``with intermediates(): query(spark, d).write...``: what the query wrote on its way goes when the block ends."""
    before = len(_WRITTEN)
    try:
        yield
    finally:
        release(before)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before Python did
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


_SHIPPED: set[int] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package: nothing to do where their path has it, else send it along once."""
    root = Path(__file__).resolve().parent.parent
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or id(context) in _SHIPPED:
        return
    folder = tempfile.mkdtemp()  # of the driver only: Spark copies the archive to its executors, until the end
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/rosterloom", "zip", root, "rosterloom"))
    _SHIPPED.add(id(context))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
