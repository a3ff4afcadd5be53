"""Intermediate tables in the folder that driver and executors share.

Long jobs here cut their lineage by writing a table and reading it back.  The
folder is the one the cluster names in ``spark.checkpoint.dir``.  Where that is unset
a temporary folder of this machine is used under a local master, whose executors
share it; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}
#: Paths given out since the innermost ``scratch`` began, and those before.
_given: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this application, below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "root" not in _local:
            _local["root"] = tempfile.mkdtemp(prefix="leakwright-")
            atexit.register(shutil.rmtree, _local["root"], ignore_errors=True)
        root = f"file://{_local['root']}"
    return f"{root.rstrip('/')}/leakwright-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    for paths in _given:
        paths.append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Tables made inside are deleted at the end, but for those whose paths were put into the list given.

    To be put around a step whose result is written inside: nothing else that it made is read again.
    Paths are compared by their last name, which is unlike any other: Spark spells the folder before it
    in other ways than ``spark.checkpoint.dir`` does (``/a``, ``file:/a`` and ``file:///a``).
    """
    kept, made = [], []
    _given.append(made)
    try:
        yield kept
    finally:
        _given.remove(made)
        names = {path.rstrip("/").rsplit("/", 1)[-1] for path in kept}
        for path in made:
            if path.rsplit("/", 1)[-1] not in names:
                _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Have the driver notice which finished steps nothing refers to, so that their shuffle files go.

    Executors keep shuffle files until the driver's garbage is collected, which may be
    long after a job that spans many steps has filled the disks.  To be called after a
    step that shuffled much, not after each.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stash(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and return it as a fresh scan, which survives the loss of executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of up to so many rows is broadcast by ``small_side``.
BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written and counted: broadcast if it has no more than ``BROADCAST_ROWS`` rows, joined as any table otherwise."""
    written = stash(df, tag)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by ``stash`` that nothing reads any more."""
    spark = df.sparkSession
    own = shared_folder(spark)
    inside = own.rsplit("/", 1)[-1]
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        *_, parent, name = folder.split("/")
        if parent == inside:
            _delete(spark, f"{own}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
