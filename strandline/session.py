"""Session helpers: reading tables, and cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, unless PYTHONPATH holds it already."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(_ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    path = Path(tempfile.mkdtemp(prefix="strandline-")) / "strandline.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in _ROOT.rglob("*.py"):
            archive.write(file, file.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as a parquet scan (columns are pruned by Catalyst)."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder is used if the master is local (tests); on a
    cluster a machine-local folder would lose data with its machine, so the absence is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"strandline-{os.getpid()}")
    return f"file://{own}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    The result has no lineage behind the files, so it outlives lost executors, and a column-pruned
    scan replaces the recomputation. The files go when the Python driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_durable(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`durable` that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/strandline-" in path:
            _remove(df.sparkSession, path)
