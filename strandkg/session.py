"""What every operator needs from the session: the shared folder and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is made, but only in local mode: on a cluster a
    machine-local folder would not be seen by the other executors, so a missing setting is an error.
    """
    found = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='strandkg-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def written(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, with a folder for each value of the columns ``folders``: computed once, its lineage cut, lost executors do no harm. It is
    deleted when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandkg/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(str(Path(sf_dir) / f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")


_once: dict[tuple, object] = {}


def once(spark: SparkSession, sf_dir: str, name: str, tables: tuple[str, ...], make: Callable[[], T]) -> T:
    """What ``make`` gives for the data folder, made once per application while the files of ``tables`` stay as they are (names, sizes and times are compared) and the shared folder is there."""
    state = []
    for t in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        state += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)]
    key = (spark.sparkContext.applicationId, sf_dir, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/strandkg")
    if key not in _once or _once[key][0] != state or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        _once[key] = (state, make())
    return _once[key][1]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that they need no installation of it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="strandkg-")) / "strandkg_package.zip"  # read by the driver only, which serves it
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
