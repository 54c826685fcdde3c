"""Distributed prefix sums within groups: range sort, sums in the sorted pass, offsets of partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shuffle_width, stored


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, *, out: str = "before", partitions: int | None = None) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the same group that come earlier in ``order``.

    ``group`` is a string column without nulls. Rows are range-partitioned by group and order, so a group
    with a third of all rows is many partitions. Sums run in the sorted pass; what the earlier partitions
    hold of a group is added by a join on (partition, group), whose table has at most one row for each
    partition and one for each group. Rows that tie in ``order`` are interchangeable.
    """
    n = partitions or shuffle_width(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])
    names = df.columns
    gi, vi = names.index(group), names.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            g = b.column(gi).dictionary_encode()
            codes = g.indices.to_numpy(zero_copy_only=False)
            v = b.column(vi).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v) - v
            starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            base = total[starts].copy()
            if last is not None and g.dictionary[int(codes[0])].as_py() == last:
                base[0] -= carried
            local = total - np.repeat(base, np.diff(np.r_[starts, len(v)]))
            last, carried = g.dictionary[int(codes[-1])].as_py(), int(local[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local)], names=[*b.schema.names, "_local"])

    ranged = df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id())
    rows = stored(ranged.mapInArrow(run, schema))
    parts = rows.groupBy("_part", group).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", group, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    joined = rows.join(offsets, ["_part", group])
    return joined.select(*names, (F.col("_local") + F.col("_offset")).alias(out))
