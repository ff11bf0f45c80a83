"""Session and shared-folder helpers."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local session without one, as in tests, gets a new folder of its own."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), f"inkstone-{uuid.uuid4().hex}"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the driver ends."""
    sc = spark.sparkContext
    if not (path := getattr(sc, "_inkstone_dir", None)):
        sc._inkstone_dir = path = f"{shared_dir(spark)}/inkstone-{sc.applicationId}"

        def remove() -> None:
            try:
                place = sc._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
            except Exception:  # noqa: BLE001 - the session may have ended before
                pass

        atexit.register(remove)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = f"{own_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, which is materialized or cheap to count, marked for broadcasting if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def fence(df: DataFrame) -> DataFrame:
    """df as it is, but no column is computed again where it is used: the optimizer does not merge projections across a generator.

    Array functions need this, as a column that a lambda refers to would be computed for every element.
    """
    return df.select(F.inline(F.array(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_inkstone_shipped", False):
        return
    root, held = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(held, "w") as out:
        for folder, _, names in os.walk(root):
            for full in (os.path.join(folder, n) for n in names if n.endswith(".py")):
                out.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = f"{own_dir(spark)}/package/inkstone.zip"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(held.getvalue()))
    stream.close()
    sc.addPyFile(path)
    sc._inkstone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
