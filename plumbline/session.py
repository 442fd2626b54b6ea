"""Session defaults and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "plumbline", cpus: str | int = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster brings its own settings."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine, which
    goes with the process; a cluster without the setting is refused, as its executors could not read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        path = "file://" + local
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Written tables that cut lineage, in the shared folder.

    ``cut`` writes and reads back a frame, ``drop`` removes one that nothing
    reads any more. Unlike cached or locally checkpointed blocks, the files
    survive the loss of any executor.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame) -> str:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        return path

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.write(df)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
