"""Session helpers: shared folder, checkpoints, parallelism."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a folder of our own is made and used for checkpoints, if all of Spark is this machine's one
    process (tests); on a cluster that is an error, as the executors wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="refweave-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder and read from there on: lineage ends here.

    A table rather than checkpoint(), which would run the last stage twice.
    """
    return shared_table(df, "cut")


def shared_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back, columns prunable.

    All tables of an application lie in one folder, which goes when the application ends, or with :func:`drop_shared`.
    """
    spark = df.sparkSession
    at = f"{own_folder(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one; the file system deletes it when the application ends."""
    at = f"{shared_dir(spark)}/refweave-{spark.sparkContext.applicationId}"
    if at not in _made:
        fs, path = _file_system(spark, at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(at)
    return at


def _file_system(spark: SparkSession, at: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_shared(spark: SparkSession) -> None:
    """Delete the tables that this application wrote to the shared folder; no result that reads them may be open."""
    at = own_folder(spark)
    fs, path = _file_system(spark, at)
    fs.delete(path, True)
    _made.discard(at)


def partitions(spark: SparkSession) -> int:
    """Number of shuffle partitions of this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


_made: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that their Python finds it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="refweave-")) / "refweave.zip"  # the driver serves it from here
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, f"refweave/{p.relative_to(package).as_posix()}")
    spark.sparkContext.addPyFile(str(at))
    _shipped.add(app)
