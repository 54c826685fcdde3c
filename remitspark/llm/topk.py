"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_rows, shuffle_width, stored

#: Vectors of one block; a pair of blocks is the unit of scoring.
BLOCK = 1024
#: Bins that each refinement splits a range into.
BINS = 4096
LONG = 2**63 - 1


def components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as whole doubles; null unless all are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * float(scale)).cast("double")))


def _blocks(rows: DataFrame, kind: str, per: int) -> DataFrame:
    """Rows (id, dim, v) as blocks of one dimension: block id, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int, ids: list, vs: list) -> pa.RecordBatch:
            at = np.array(ids, dtype=np.int64)
            m = np.array(vs, dtype=np.float64).reshape(len(ids), dim)
            return pa.RecordBatch.from_arrays(
                [pa.array([int(part[0])]), pa.array([dim], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())],
                names=["part", "dim", "ids", "v"],
            )

        part = [0]
        for b in batches:
            for key, i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                part[0] = key
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) >= per:
                    yield block(len(v), *held.pop(len(v)))
        for dim, (ids, vs) in held.items():
            yield block(dim, ids, vs)

    return rows.mapInArrow(run, "part long, dim int, ids binary, v binary").withColumn("kind", F.lit(kind))


def _scores(q: bytes, c: bytes, dim: int, nq: int, nc: int) -> np.ndarray:
    """Whole inner products; beyond the range of a long the nearest long."""
    a, b = np.frombuffer(q).reshape(nq, dim), np.frombuffer(c).reshape(nc, dim)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1)
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    a, b = (np.array([[int(x) for x in r] for r in m], dtype=object).reshape(m.shape) for m in (a, b))
    return np.clip(a @ b.T, -LONG, LONG).astype(np.int64)


def top_k(
    vectors: DataFrame,
    queries: Column,
    *,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 256,
    block: int = BLOCK,
    bins: int = BINS,
) -> DataFrame:
    """The ``k`` rows of highest inner product for every row that ``queries`` marks, against all other rows.

    Everything is scored, block against block (a stated query set against all rows). Pass by pass a histogram of each
    query's scores is summed over all blocks and the bin that holds the k-th highest score is split again, until the bin is
    one value wide: the exact k-th value. Of a block's histogram only the bins down to its own k-th score are sent: the
    global k-th value is never below a block's own. The last pass keeps scores above that value and, of those equal to
    it, each block's k smallest ids, so a vector that a third of the rows share sends k rows a block. Ties go to the
    smaller id.

    Returns query_id, rank (from 1), vec_id, score (long). Vectors that are null or hold null or non-finite
    components take no part; only vectors of the same length are compared. Rows with the query's own id are never
    its candidates; repeated candidate rows are ranked each; of repeated query rows of one id the one with the
    lowest vector is asked. Fewer than k candidates: all of them. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    batch_rows(spark)
    width = shuffle_width(spark)
    plain = vectors.select(
        F.col(id_col).cast("long").alias("id"), components(F.col(vector_col), scale).alias("v"), queries.alias("asked")
    ).filter("id is not null and v is not null")
    plain = stored(plain)
    count = plain.agg(F.count(F.lit(1)), F.sum(F.when(F.col("asked"), 1).otherwise(0)), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), F.max(F.size("v"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not count[1]:
        return spark.createDataFrame([], schema)
    c_parts = -(-count[0] // (4 * block))
    q_parts = -(-count[1] // block)
    asked = plain.filter("asked").groupBy("id").agg(F.min("v").alias("v"))
    q_rows = asked.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(q_parts))).repartition(q_parts, "p").sortWithinPartitions("p", "id")
    c_rows = plain.withColumn("p", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(c_parts))).repartition(c_parts, "p").sortWithinPartitions("p", "id")
    # many partition numbers may share a task; blocks never mix dimensions and are named by their content's first id
    qs = stored(_blocks(q_rows.select("p", "id", "v"), "q", block).select(F.monotonically_increasing_id().alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("v").alias("q_v")))
    cs = stored(_blocks(c_rows.select("p", "id", "v"), "c", 4 * block).select(F.monotonically_increasing_id().alias("c_block"), "dim", F.col("ids").alias("c_ids"), F.col("v").alias("c_v")))
    batch_rows(spark, 16)  # pairs of blocks are a few MB each
    # every query block goes to every candidate block of its dimension: an equality join on (dim, lane)
    lanes = max(1, min(c_parts, width))
    c_lane = cs.withColumn("lane", F.pmod(F.xxhash64("c_block"), F.lit(lanes)).cast("int"))
    q_lane = qs.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))

    bound = int(min(2.0**63, (count[2] or 0.0) ** 2 * (count[3] or 0) + 1))
    step = 1
    while step * bins < 2 * bound + 2:
        step *= bins
    low = -(-(-bound // step) * step)  # a multiple of the bin's width, and a long
    # thresholds: for each query block the low end of each query's bin, how many scores lie above the bin, and its width
    limits = qs.select("q_block", F.lit(None).cast("binary").alias("lows"))
    while True:
        counts = (
            q_lane.join(limits, "q_block").join(c_lane, ["dim", "lane"])
            .select("q_block", "q_ids", "q_v", "c_ids", "c_v", "dim", "lows")
            .mapInArrow(_histogram(k, step, bins, low), "q_block long, q int, bin long, n long")
        )
        total = counts.groupBy("q_block", "q", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("q_block", "q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        at = total.withColumn("above", F.sum("n").over(down) - F.col("n")).filter(F.col("above") < k)
        # the lowest bin reached with fewer than k scores above it holds the k-th score, or the last one there is
        kth = at.groupBy("q_block", "q").agg(F.min("bin").alias("bin"))
        rows = kth.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("q", "bin"))).alias("kth"))
        limits = stored(rows.mapInArrow(_pack, "q_block long, lows binary"))
        if step == 1:
            break
        step //= bins
    best = (
        q_lane.join(limits, "q_block").join(c_lane, ["dim", "lane"])
        .select("q_block", "q_ids", "q_v", "c_ids", "c_v", "dim", "lows")
        .mapInArrow(_winners(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's thresholds as bytes: query number and the low end of its bin, by query number."""
    for b in batches:
        out = []
        for kth in b.column(1).to_pylist():
            out.append(np.array([(x["q"], x["bin"]) for x in kth], dtype=np.int64).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["q_block", "lows"])


def _pairs(b: pa.RecordBatch) -> Iterator[tuple]:
    for i in range(b.num_rows):
        q_block, q_ids, q_v, c_ids, c_v, dim, lows = (b.column(j)[i].as_py() for j in range(7))
        q_ids, c_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64)
        s = _scores(q_v, c_v, dim, len(q_ids), len(c_ids))
        yield q_block, q_ids, c_ids, s, None if lows is None else np.frombuffer(lows, np.int64).reshape(-1, 2)


def _histogram(k: int, step: int, bins: int, low: int):
    """Counts of each query's scores by bin of ``step`` values, within the query's bin of the pass before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q_block, q_ids, c_ids, s, lows in _pairs(b):
                out_q, out_bin, out_n = [], [], []
                start = np.full(len(q_ids), low) if lows is None else np.full(len(q_ids), LONG)
                if lows is not None:
                    start[lows[:, 0]] = lows[:, 1]
                for i in range(len(q_ids)):
                    x = s[i][c_ids != q_ids[i]]
                    x = x[x >= start[i]]
                    if len(x) > k:  # the block's own k-th score bounds what can matter
                        x = x[x >= np.partition(x, len(x) - k)[len(x) - k] // step * step]
                    if len(x):
                        at, n = np.unique(np.maximum(x // step * step, start[i]), return_counts=True)
                        out_q += [i] * len(at)
                        out_bin.append(at)
                        out_n.append(n)
                if out_q:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(out_q), q_block)), pa.array(out_q, pa.int32()), pa.array(np.concatenate(out_bin)), pa.array(np.concatenate(out_n))],
                        names=["q_block", "q", "bin", "n"],
                    )

    return run


def _winners(k: int):
    """Scores above the k-th value and, of those equal to it, the k smallest ids of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, q_ids, c_ids, s, lows in _pairs(b):
                q, c, v = [], [], []
                for i, value in lows.tolist():
                    x, own = s[i], c_ids != q_ids[i]
                    over = np.flatnonzero((x > value) & own)
                    equal = np.flatnonzero((x == value) & own)
                    equal = equal[np.argsort(c_ids[equal], kind="stable")[:k]]
                    at = np.r_[over, equal]
                    q.append(np.full(len(at), q_ids[i]))
                    c.append(c_ids[at])
                    v.append(x[at])
                if q:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (q, c, v)], names=["query_id", "vec_id", "score"])

    return run
