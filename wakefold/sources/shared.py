"""What all executors share: the folder of checkpoints and intermediate tables, and the package's code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
_local: dict[str, str] = {}
_shipped: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a fresh temporary one only for a local master."""
    configured = spark.conf.get(_CONF, None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="wakefold-")
    return _local[app]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_root(spark))


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def _ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors unless their path has it already."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = Path(tempfile.mkdtemp()) / "wakefold.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((root / "wakefold").rglob("*.py")):
            z.write(path, path.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def in_tasks(frame: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with the package at hand on every executor."""
    _ship(frame.sparkSession)
    return frame.mapInArrow(work, schema)


_FOLDERS = {"spark.sql.maxConcurrentOutputFileWriters": "64", "spark.sql.optimizer.plannedWrite.enabled": "false"}


@contextmanager
def unsorted_folders(spark: SparkSession) -> Iterator[None]:
    """Writes by ``partitionBy`` keep a file open per folder instead of sorting wide rows by folder first.

    With more than 64 folders a task sorts its rows as usual.
    """
    before = {name: spark.conf.get(name) for name in _FOLDERS}
    try:
        for name, value in _FOLDERS.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
