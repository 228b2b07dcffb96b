"""Session helpers: the local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "spanwright", **conf: str) -> SparkSession:
    """A session for one machine; on a cluster use the session that the cluster gives."""
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("SPANWRIGHT_DRIVER_MEMORY", "8g"),
    }
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Only where that is unset (tests, one machine) a temporary folder is made and set; on a master other
    than local an unset folder is an error, since a machine-local one would lose data with its machine.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = getattr(spark, "_spanwright_folder", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        known = "file://" + tempfile.mkdtemp(prefix="spanwright-")
        spark._spanwright_folder = known
    return known.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that their lineage ends and a lost executor costs one read.

    ``keep(df)`` writes and reads back; ``drop(df)`` deletes a table that is no longer needed, which loops
    call as soon as the next round's table stands.
    """

    def __init__(self, spark: SparkSession, name: str = "t") -> None:
        self.spark, self.root, self.n, self.at = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0, {}

    def keep(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        path = f"{self.root}/{self.n}"
        self.n += 1
        w = df.write.option("compression", "zstd")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.at[id(out)] = path
        out._spanwright_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_spanwright_path", None)
        if path:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
