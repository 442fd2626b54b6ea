"""Append-only logs as streams: idempotent merging by key, running rates, refusal of changed settings.

The reference form of these logs is a file that jobs append to and resume from;
the streaming form is an adaptation of that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_rates(stream: DataFrame, *keys: str, time: str = "ts", late: str = "30 days") -> DataFrame:
    """Running count and rate per key; rows delivered again within the watermark count once."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([*keys, "sample_idx"])
    return once.groupBy(*keys).agg(F.count("*").alias("k"), F.avg((F.col("label") == 2).cast("double")).alias("p_hat"))


def run_to_table(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return its result as a written table: the last version in complete mode, else all batches.

    Each batch is written by the executors; a batch that is run again overwrites its own files.
    """
    spark = df.sparkSession
    scratch, done = Scratch(spark, f"stream-{name}"), []

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{scratch.root}/out/v={n}")
        done.append(n)

    q = df.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", f"{scratch.root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    at = [max(done)] if mode == "complete" else sorted(set(done))
    return spark.read.schema(df.schema).parquet(*[f"{scratch.root}/out/v={n}" for n in at])


def merge_into(stream: DataFrame, target: str, keys: list[str], order: str, checkpoint: str):
    """Merge each batch into versions of a keyed table: the latest row by ``order`` holds, replays change nothing.

    Each batch writes ``target/v=<batch id>`` from the version before it; a batch
    that is run again overwrites its own version.
    """

    def step(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        prev = spark.read.parquet(f"{target}/v={n - 1}") if n else batch.limit(0)
        rows = prev.unionByName(batch.select(*prev.columns))
        cols = rows.columns
        rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{target}/v={n}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def check_settings(spark: SparkSession, path: str, settings: dict[str, str]) -> None:
    """Write the settings of a log once; refuse to go on with others."""
    from ..sources.files import exists

    rows = sorted((k, str(v)) for k, v in settings.items())
    if exists(spark, path):
        old = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
        if old != rows:
            raise ValueError(f"settings changed: {set(old) ^ set(rows)}")
    else:
        spark.createDataFrame(rows, "k string, v string").coalesce(1).write.parquet(path)


def tumbling_rates(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts and rates in event-time windows, late rows dropped beyond the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *keys).agg(F.count("*").alias("n"), F.avg((F.col("label") == 2).cast("double")).alias("p_hat"))
