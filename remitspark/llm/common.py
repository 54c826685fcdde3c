"""What the operators share: tables, stored intermediate results, input size."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of one Arrow batch: a few MB of documents, so that a Python worker holds little at a time.
BATCH_ROWS = 500
ROOT = str(Path(__file__).resolve().parents[2])
#: White space of the word patterns: space and 0x09-0x0D.
WORD = "[^\\x20\\x09-\\x0D]+"
#: The letters that are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows of an Arrow batch from now on: texts and blocks may be long, and a worker's memory is bounded by the batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    on_path(spark)


def on_path(spark: SparkSession) -> None:
    """Let Python workers find the package; for functions that cut the batches themselves and leave the session's sizes alone."""
    # workers on this machine find the package wherever the driver was started from; a cluster has it installed
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and go on from the written rows.

    Cuts the lineage: a lost executor costs no more than reading the files again.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def folded(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is; null counts as empty.

    A text of ASCII characters alone takes the engine's quick path, which changes only A-Z there.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
