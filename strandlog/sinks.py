"""Results written out: CSV, JSON lines, JSON lists, column-oriented JSON, raw messages, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one JSON document; a larger result is written as several.
DOCUMENT_ROWS = 10_000


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)


def _numbered(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """df with _document and _place. Ranges of the order are numbered each on its own, so documents hold `rows` or fewer rows."""
    ranged = df.repartitionByRange(*order) if order else df
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1 if order else F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("_place", place).withColumn("_document", F.struct("_part", F.floor(F.col("_place") / rows).alias("n")))


def json_lists(df: DataFrame, order: list[str], rows: int = DOCUMENT_ROWS) -> DataFrame:
    """(_document, value): JSON lists of rows in order, at most `rows` each."""
    one = F.struct(*df.columns)
    parts = _numbered(df, order, rows).groupBy("_document").agg(F.array_sort(F.collect_list(F.struct("_place", one.alias("row")))).alias("x"))
    return parts.select("_document", F.to_json(F.transform("x", lambda p: p["row"]), {"ignoreNullFields": "false"}).alias("value"))


def json_columns(df: DataFrame, order: list[str], rows: int = DOCUMENT_ROWS) -> DataFrame:
    """(_document, value): one list for each column in place of one object for each row."""
    parts = _numbered(df, order, rows).groupBy("_document").agg(F.array_sort(F.collect_list(F.struct("_place", F.struct(*df.columns).alias("row")))).alias("x"))
    lists = [F.col("x")["row"][c].alias(c) for c in df.columns]
    return parts.select("_document", F.to_json(F.struct(*lists)).alias("value"))


def write_json(df: DataFrame, path: str, order: list[str], columns: bool = False, mode: str = "error", rows: int = DOCUMENT_ROWS) -> None:
    """JSON documents, one a line, in the order given."""
    (json_columns if columns else json_lists)(df, order, rows).sort("_document").select("value").write.mode(mode).text(path)


def write_raw(messages: DataFrame, path: str, text: str = "log_raw_text", mode: str = "error") -> None:
    """The messages' own texts; mode append adds to what is there."""
    messages.select(text).write.mode(mode).text(path)


def write_marked(messages: DataFrame, path: str, text: str = "log_raw_text", mark: str = "log_mark", mode: str = "error") -> None:
    write_raw(messages.where(F.coalesce(F.col(mark), F.lit(False))), path, text, mode)


def save_table(df: DataFrame, name: str, mode: str = "error") -> None:
    df.write.mode(mode).format("parquet").saveAsTable(name)
