"""Session helpers shared by all modules."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder.  A cluster names it in ``spark.checkpoint.dir``; where that is unset a temporary
    folder is made if all runs on this machine (tests), and an error raised if not: executors elsewhere couldn't read it."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="parlaweave-ckpt-")
        atexit.register(shutil.rmtree, wanted, ignore_errors=True)
    sc.setCheckpointDir(wanted)
    return sc.getCheckpointDir() or wanted


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)
