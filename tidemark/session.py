"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution. On a cluster ``master`` comes from spark-submit."""
    b = (
        SparkSession.builder.appName("tidemark")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark context, so that they need no installation of it.

    It goes through the shared folder, never a folder of one machine.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    home, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    at = f"{scratch_path(spark, 'package')}/tidemark.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(packed.getvalue())
    out.close()
    sc.addPyFile(at)
    sc._tidemark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a local one only where that is unset and Spark is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(at)
    return at


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when Python ends, or at the end of :func:`scratch`."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Deletes at its end the scratch tables made within it, so that a long session doesn't fill the shared folder.

    DataFrames made within can't be read afterwards: collect or write the results first.
    """
    kept = list(_written)
    try:
        yield
    finally:
        made = [x for x in _written if x not in kept]
        _written[:] = kept
        _delete(made)


def _clean() -> None:
    _delete(_written)


def _delete(paths: list[tuple[SparkSession, str]]) -> None:
    for spark, path in paths:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
