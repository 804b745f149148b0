"""Session-level helpers: table access, checkpoint folder, checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir`` and that value is used as it is. Only where
    neither the setting nor a folder on the context exists (tests, laptops) a temporary one is made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        if named is None and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="mailquarry-ckpt-"))
        current = sc.getCheckpointDir()
    return named or current


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there from now on."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows`` + 1 of them."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else ``df`` as it is."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


#: Repeated ids are broadcast up to so many, beyond that joined by shuffling.
BROADCAST_IDS = 500_000


def first_deliveries(df: DataFrame, id_col: str = "id", order_col: str = "arrival") -> DataFrame:
    """``df`` with one row per id, the one with the least ``order_col``; rows without an id are left out.

    Only ids that repeat are gathered, and kept, so the wide rows are not shuffled while those ids are few.
    """
    again = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(order_col).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select(id_col, "_first").persist()
    joined = df.where(F.col(id_col).isNotNull()).join(broadcast_if(again, BROADCAST_IDS), id_col, "left")
    return joined.where(F.col("_first").isNull() | (F.col("_first") == F.col(order_col))).drop("_first")
