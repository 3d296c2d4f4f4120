"""Session defaults and the small amount of shared state a job needs."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that only steer how plans run; results don't depend on them.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(name: str = "confab", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults of this library; `conf` overrides them."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**TUNING, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by the cluster in spark.checkpoint.dir.

    Only where it is unset and the master is local (tests), a temporary folder is made and set.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="confab-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    at = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", at)
    return at


_STAGED: list[str] = []
#: Spark's setting that shuffle files go when the execution ends that made them.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def swept(spark: SparkSession):  # noqa: ANN201
    """Shuffle files of what runs inside the block go when it ends; else they stay until the driver happens to collect its
    garbage, so that steps done add up on disk. Only for executions that nothing else continues."""
    had = spark.conf.get(SWEEP)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, had)


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stage(df: DataFrame) -> DataFrame:
    """Writes df into the shared folder and reads it again: cuts lineage and survives lost executors. The folder goes when
    the application ends, or with the `staging` block it was made in; the shuffle files that made it go at once."""
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"stage-{uuid.uuid4().hex}")
    with swept(spark):
        df.write.parquet(path)
    files, target = _folder(spark, path)
    files.deleteOnExit(target)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession):  # noqa: ANN201
    """What is staged inside is deleted at the end of the block; results must be written or collected before."""
    have = len(_STAGED)
    try:
        yield
    finally:
        for path in _STAGED[have:]:
            files, target = _folder(spark, path)
            files.delete(target, True)
        del _STAGED[have:]


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package's code to all Python workers, present and future, once an application: the archive lies in the
    shared folder, so workers need neither the repository nor a search path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(package.rglob("*.py")):
            archive.write(path, Path(package.name, path.relative_to(package)))
    at = f"{shared_dir(spark)}/{package.name}-{uuid.uuid4().hex}.zip"
    target = sc._jvm.org.apache.hadoop.fs.Path(at)
    out = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(at)
    _SHIPPED.add(sc.applicationId)
