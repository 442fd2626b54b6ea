"""File sources and sinks: JSON lines in strict, lenient and tolerant form, CSV, vectors, configs, reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hits = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return hits is not None and len(hits) > 0


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, missing: str = "error") -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped. A missing path is an error or, on request, empty."""
    if missing == "empty" and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, ``file, error_line`` of the lines that don't parse)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file")).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    df = lines.select("file", F.from_json("value", f"{schema}, _corrupt_record string", options).alias("j"))
    good = df.where("j._corrupt_record is null").select("j.*").drop("_corrupt_record")
    return good, df.where("j._corrupt_record is not null").select("file", F.col("j._corrupt_record").alias("error_line"))


def write_jsonl(df: DataFrame, path: str, append: bool = False, compress: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path, compression="gzip" if compress else "none")


def read_csv(spark: SparkSession, path: str, schema: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=multiline, escape='"')


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def with_path_columns(df: DataFrame, pattern: str, names: list[str], path: Column | None = None) -> DataFrame:
    """Columns from the groups of a pattern over each row's file path, e.g. model and prefix directories."""
    p = path if path is not None else F.col("_metadata.file_path")
    return df.select("*", *[F.regexp_extract(p, pattern, i + 1).alias(n) for i, n in enumerate(names)])


def npy_to_vectors(spark: SparkSession, matrix: str, id_map: str, out: str) -> DataFrame:
    """A matrix file and its {id: row} map as ``id, v`` rows, written in slices of the memory-mapped file."""
    import numpy as np

    m = np.load(matrix, mmap_mode="r")
    rows = sorted(((r, i) for i, r in json.loads(Path(id_map).read_text()).items()))
    for at in range(0, len(rows), 10_000):
        part = [(str(i), [float(x) for x in m[r]]) for r, i in rows[at : at + 10_000]]
        spark.createDataFrame(part, "id string, v array<float>").write.mode("append").parquet(out)
    return spark.read.parquet(out)


def read_config(path: str, **override: object) -> dict:
    """YAML (or JSON, if no YAML library is there) as a dict; non-null overrides win."""
    text = Path(path).read_text()
    try:
        import yaml

        conf = yaml.safe_load(text)
    except ImportError:
        conf = json.loads(text)
    return (conf or {}) | {k: v for k, v in override.items() if v is not None}


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A small result as a markdown table; reports show at most ``limit`` rows."""
    rows = df.limit(limit).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|") for x in xs) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])
