"""Session factory and the shared folder that cut lineage is written to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "parlance", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume: UTC, AQE and Arrow."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors of a cluster on which it is not installed; gives the archive's path."""
    import pathlib
    import zipfile

    root = pathlib.Path(__file__).parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="parlance-")) / "parlance.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    return str(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset one made for this process (local masters only)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = os.environ.get("PARLANCE_SHARED_DIR")
    if not own:
        own = os.environ["PARLANCE_SHARED_DIR"] = tempfile.mkdtemp(prefix="parlance-")
    return f"file://{own}"


_written: list[str] = []


def release(spark: SparkSession) -> int:
    """Deletes the tables that materialize wrote so far, and gives their number. Results that still read them must be written before."""
    n = 0
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return n


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of the shared folder that release removes, else the end of the driver's JVM."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages neither recompute it nor depend on an executor.

    The folder is removed by release, else when the driver's JVM ends.
    """
    path = new_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
