"""Intermediate tables in the folder that the cluster shares, and this package on its executors."""

from __future__ import annotations

import atexit
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no spark.checkpoint.dir, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's own folder below spark.checkpoint.dir; removed when Python ends."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        base = FALLBACK_DIR
    place = f"{base.rstrip('/')}/tesserae-{sc.applicationId}"
    if getattr(sc, "_tesserae_dir", None) != place:
        sc._tesserae_dir = place
        atexit.register(_remove, sc, place)
    return place


def _remove(sc, place: str) -> None:
    try:
        path = sc._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have stopped already; nothing depends on this
        pass


def shared_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet below spark.checkpoint.dir and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    for paths in _OPEN:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Paths of the tables written within each open `scratch`.
_OPEN: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Remove the tables written in this block at its end. What it yields writes a table that stays."""
    paths: list[str] = []
    kept: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table = shared_table(df, label)
        kept.append(paths[-1])
        return table

    _OPEN.append(paths)
    try:
        yield keep
    finally:
        _OPEN.pop()
        for path in paths:
            if path not in kept:
                _remove(spark.sparkContext, path)


#: Bytes of a batch that goes to a Python worker, about; Spark's own bound is eight times that.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, for clusters on which it isn't installed; bound the batches for Python by bytes."""
    sc = spark.sparkContext
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(sc, "_tesserae_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if str(root.parent) not in os.environ.get("PYTHONPATH", "").split(":") and root.parent.is_dir():
        import tempfile

        place = Path(tempfile.mkdtemp(prefix="tesserae-")) / "tesserae_code.zip"  # served by the driver, not shared by path
        with zipfile.ZipFile(place, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(place))
    sc._tesserae_shipped = True
