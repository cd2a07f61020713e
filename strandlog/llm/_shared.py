"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where the session names none, a temporary folder stands in if one machine does it all; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all columns but those used under names that no operator has, and what brings docs' columns back."""
    new = {name: name if name in used else f"_aside_{i}" for i, name in enumerate(docs.columns)}

    def back(out: DataFrame) -> DataFrame:
        return out.select(*(F.col(new[name]).alias(name) for name in docs.columns))

    return docs.toDF(*new.values()), back
