"""Writers: idempotent tables, ordered loads, result files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def write_result(df: DataFrame, target: str, fmt: str = "parquet") -> None:
    """Parquet, or CSV with a header."""
    writer = df.write.mode("overwrite")
    if fmt == "parquet":
        writer.parquet(target)
    elif fmt == "csv":
        writer.option("header", True).csv(target)
    elif fmt == "json":
        writer.json(target)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def reload_table(df: DataFrame, name: str) -> int:
    """Replace the rows of a managed table; running it twice leaves the same table."""
    df.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name).count()


def load_star(spark: SparkSession, root: str, dims: Mapping[str, DataFrame], facts: Mapping[str, DataFrame]) -> dict[str, int]:
    """Dimensions before facts, one Parquet data set each; returns the rows written.

    Every dimension must hold its Unknown member (key 0) exactly once.
    """
    rows = {}
    for name, df in dims.items():
        key = next(c for c in df.columns if c.endswith("_key"))
        if df.where(f"{key} = 0").count() != 1:
            raise ValueError(f"{name}: the Unknown member must occur exactly once")
    for name, df in {**dims, **facts}.items():
        write_result(df, f"{root}/{name}")
        rows[name] = spark.read.parquet(f"{root}/{name}").count()
    return rows


def bucketed_table(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by a join key, so later joins on the key need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def keyed_table(df: DataFrame, path: str, key: str, *, files: int | None = None, group_bytes: int = 16 << 20) -> None:
    """A Parquet data set for point lookups by ``key``: range-partitioned and sorted by it, with small row groups and a bloom filter.

    A lookup then reads the footers of all files and the row groups of one: the pushed predicate is compared with every
    group's bounds and filter. Without ``files`` the session's shuffle width is taken.
    """
    if key not in df.columns:
        raise ValueError(f"no column {key}")
    ranged = df.repartitionByRange(files, key) if files else df.repartitionByRange(key)
    writer = ranged.sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", group_bytes)
    writer.option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)
