"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "tracewell", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the library is tuned for; on a cluster pass your own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return builder.config(map=defaults | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A cluster names it in spark.checkpoint.dir; where that is unset, a local session makes a
    temporary one and sets it, so later calls find the same, and any other is refused."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        set_on_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = set_on_context.get() if set_on_context.isDefined() else None
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_OWN: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if path not in _OWN:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(place)
        files.deleteOnExit(place)
        _OWN.add(path)
    return path


class Written:
    """A table written to the shared folder: its lineage is cut and it outlives the executors that made it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path = spark, path
        self.df = spark.read.schema(schema).parquet(path)

    def drop(self) -> None:
        """Delete the files; only for tables no returned frame still reads."""
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, partition_by: list[str] | None = None) -> Written:
    """Write df to the shared folder and hand back the table read from there."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return Written(spark, path, df.schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: White space of any script, for trimming; Java's \s alone is ASCII only.
BLANK = r"[\s\p{Z}\x{0085}\x{001C}-\x{001F}]"


def stripped(col) -> F.Column:
    """Without surrounding white space of any script."""
    return F.regexp_replace(col, f"^{BLANK}+|{BLANK}+$", "")
