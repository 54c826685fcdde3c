"""The staging and quarantine jobs run incrementally over a folder that receives files.

Each run takes the files that arrived since the last one and stops (available-now trigger); the
streaming checkpoint remembers which files are done, so a lost run is repeated without doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.contracts import Contract, quarantine
from ..sources.delimited import ENCODING, typed
from ..sources.schema_rules import column_plan, text_schema


def file_stream(spark: SparkSession, folder: str, columns: Sequence[str], delimiter: str = "|") -> DataFrame:
    """New files of a folder as a text stream with known columns."""
    return (
        spark.readStream.schema(text_schema(columns))
        .option("sep", delimiter)
        .option("header", True)
        .option("encoding", ENCODING)
        .option("nullValue", "")
        .option("emptyValue", "")
        .csv(folder)
    )


def stage_new_files(
    spark: SparkSession, folder: str, columns: Sequence[str], target: str, state: str, delimiter: str = "|"
) -> None:
    """Append the typed rows of all new files to a Parquet data set; returns when they are done."""
    rows = typed(file_stream(spark, folder, columns, delimiter), column_plan(columns))
    query = (
        rows.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def quarantine_new_rows(
    spark: SparkSession, folder: str, columns: Sequence[str], contract: Contract, target: str, state: str,
    delimiter: str = "|",
) -> None:
    """Append the row-rule violations of all new files to the quarantine data set.

    A batch writes to a folder named by its number, so a repeated batch replaces its own rows.
    """
    rows = typed(file_stream(spark, folder, columns, delimiter), column_plan(columns))

    def write(batch: DataFrame, number: int) -> None:
        quarantine(batch, contract).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    query.awaitTermination()
