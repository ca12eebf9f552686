"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, read by Spark, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Like cut, by a Parquet table in the shared folder: smaller than a checkpoint where there are many rows."""
    place = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def bit_filter(df: DataFrame, slot: str, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits in which the slots of df are set, whatever the number of rows.

    Tasks merge their bitmaps before anything moves; only the fixed-size result is fetched.
    """
    chunk = 15
    made = df.groupBy(F.shiftright(slot, chunk).alias("at")).agg(F.bitmap_construct_agg(F.col(slot).bitwiseAND((1 << chunk) - 1)).alias("map"))
    out = np.zeros((1 << (bits - chunk), 1 << (chunk - 3)), "u1")
    for row in made.collect():
        out[row["at"]] = np.frombuffer(row["map"], "u1")
    return out.ravel()


def is_set(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 3] >> (slots & 7).astype("u1")) & 1 == 1
