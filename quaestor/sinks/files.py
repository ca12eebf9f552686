"""Writers whose bytes depend on their rows alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_cell
from ..operators.catalogue import shard_parts

BOM = "﻿"


def csv_lines(df: DataFrame) -> Column:
    """One line of quoted cells for each row."""
    return F.concat_ws(",", *(csv_cell(F.col(c)) for c in df.columns))


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A table for spreadsheets: byte-order mark, heading, CRLF, every cell quoted and tamed.

    Files are in order of their names, rows in order within and across them; the heading is
    in a file of its own before the others.
    """
    spark = df.sparkSession
    heading = BOM + ",".join(f'"{c}"' for c in df.columns)
    spark.createDataFrame([(heading,)], "line string").coalesce(1).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/0-heading")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(csv_lines(df).alias("line")).write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/1-rows")


def write_backup(df: DataFrame, path: str, order: list[str]) -> None:
    """Rows as JSON lines in order, without null fields."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct(*df.columns)).alias("line")).write.mode("overwrite").text(path)


def write_shards(records: DataFrame, path: str, limit: int) -> None:
    """Records by group and part, each part up to a limit of bytes and in order of id."""
    body = F.to_json(F.struct(*records.columns))
    sized = records.withColumn("bytes", F.octet_length(body).cast("bigint") + 1)
    parts = shard_parts(sized, limit)
    parts.repartition("group", "part").sortWithinPartitions("group", "part", "id").drop("bytes").write.mode("overwrite").partitionBy("group", "part").parquet(path)
