"""Gradient-boosted trees over a feature vector, fitted on counted bins.

The algorithm is that of Spark's ``GBTClassifier``: logistic loss on labels -1 and 1, regression trees on its negative gradient, the first
tree with weight 1 and the others with the step. Of the rows only bins are kept, packed into 16-bit codes of several slots each,
so that one count of a code serves all slots in it; a task counts its blocks and the driver gets counts and sums for each node and bin.
Gradients are taken in units of 2^-24, so that sums are whole numbers and a fit does not depend on how the rows are dealt out.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import package_on_path, pin
from .ordering import exact_quantiles

BINS = 32
#: Bits of a code; a node's counts of one code take 2^bits cells.
CODE_BITS = 12
BLOCK_ROWS = 1 << 15
#: Rows that a task counts before there are more tasks than cores.
TASK_ROWS = 1 << 22
#: Rows below which another task costs more than it counts.
FEW_ROWS = 1 << 17
UNIT = float(1 << 24)
#: Blocks are arrays of bytes already; kept as they are, no job has to unpack them.
HELD = StorageLevel.MEMORY_AND_DISK_DESER


@dataclass(frozen=True)
class Layout:
    """Where a slot's bin lies.

    ``cuts``: a value up to the k-th threshold has a bin up to k. ``owner``: the slot's field, -1 if it has one value only. A field is a
    slot of its own, or several slots with two values of which no row has more than one set; then the field holds the number
    ``member`` of the one that is set. ``code``, ``shift``, ``bits``: a field's place.
    """

    cuts: Sequence[np.ndarray]
    owner: Sequence[int]
    member: Sequence[int]
    code: Sequence[int]
    shift: Sequence[int]
    bits: Sequence[int]

    @property
    def codes(self) -> int:
        return max(self.code, default=-1) + 1

    @cached_property
    def starts(self) -> list[int]:
        """Where each field's bins start among the bins of all fields."""
        return [0, *np.cumsum([1 << b for b in self.bits]).tolist()]

    @staticmethod
    def of(cuts: Sequence[np.ndarray], together: np.ndarray | None = None, room: int = CODE_BITS) -> Layout:
        """``together[i, j]``: whether any row has both slots set (not 0); without it each slot has a field of its own."""
        fields: list[list[int]] = []
        for s, cut in enumerate(cuts):
            if len(cut):
                alone = together is None or len(cut) > 1 or not 0.0 < cut[0] < np.inf
                # a slot whose lower value is 0 is set where it is above the cut
                free = [] if alone else [f for f in fields if len(cuts[f[0]]) == 1 and cuts[f[0]][0] > 0.0 and len(f) < (1 << room) - 1 and not together[s, f].any()]
                free[0].append(s) if free else fields.append([s])
        owner, member = [-1] * len(cuts), [0] * len(cuts)
        for i, f in enumerate(fields):
            for j, s in enumerate(f):
                owner[s], member[s] = i, j + 1 if len(f) > 1 else 0
        bits = [len(f if len(f) > 1 else cuts[f[0]]).bit_length() for f in fields]
        code, shift, left = [0] * len(fields), [0] * len(fields), []
        for i in sorted(range(len(fields)), key=lambda i: -bits[i]):  # wide fields first, narrow ones fill up
            at = next((k for k, r in enumerate(left) if r >= bits[i]), len(left))
            if at == len(left):
                left.append(room)
            code[i], shift[i] = at, room - left[at]
            left[at] -= bits[i]
        return Layout(cuts, owner, member, code, shift, bits)

    def pack(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.codes, len(x)), np.uint16)
        for s, cut in enumerate(self.cuts):
            f = self.owner[s]
            if f >= 0:
                found = np.searchsorted(cut, x[:, s]) if len(cut) > 1 else (x[:, s] > cut[0]) * max(self.member[s], 1)
                out[self.code[f]] |= found.astype(np.uint16) << np.uint16(self.shift[f])
        return out

    def right(self, codes: np.ndarray, s: int, b: int) -> np.ndarray:
        """Which rows have a bin above ``b`` in slot ``s``."""
        f = self.owner[s]
        found = (codes[self.code[f]] >> np.uint16(self.shift[f])) & np.uint16((1 << self.bits[f]) - 1)
        return found == self.member[s] if self.member[s] else found > b

    def left_sums(self, counts: np.ndarray, s: int) -> np.ndarray:
        """(2, splits): rows and gradient sums to the left of every split of slot ``s``; ``counts``: (2, bins of all fields)."""
        f = self.owner[s]
        at = self.starts[f]
        own = counts[:, at : at + (1 << self.bits[f])]
        if self.member[s]:
            return own.sum(axis=1, keepdims=True) - own[:, self.member[s] : self.member[s] + 1]
        return np.cumsum(own, axis=1)[:, : len(self.cuts[s])]


@dataclass
class Tree:
    """Nodes as in a heap (root 1, children 2k and 2k + 1): (slot, bin, threshold) of split nodes, the mean at every node."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, n: int, right: Callable[[int, int, float], np.ndarray]) -> np.ndarray:
        """Each row's leaf; ``right`` tells which rows go to the right at a split."""
        at = np.ones(n, np.uint16)
        for k in sorted(self.splits):
            at = np.where(at == k, right(*self.splits[k]) + np.uint16(2 * k), at)
        return at

    def table(self) -> np.ndarray:
        out = np.zeros(max(self.values) + 1)
        out[list(self.values)] = list(self.values.values())
        return out


@dataclass
class Block:
    """Rows of one partition: codes, labels (-1, 1), keys of the draw, and the trees' sum so far."""

    codes: np.ndarray
    y: np.ndarray
    key: np.ndarray
    score: np.ndarray

    def nodes(self, tree: Tree, layout: Layout) -> np.ndarray:
        return tree.nodes(len(self.y), lambda s, b, _: layout.right(self.codes, s, b))

    def after(self, trees: Sequence[tuple[Tree, float]], shared: Broadcast[Layout]) -> Block:
        score = self.score
        for tree, weight in trees:
            score = score + weight * tree.table()[self.nodes(tree, shared.value)]
        return Block(self.codes, self.y, self.key, score)

    def gradient(self, first: bool) -> np.ndarray:
        """The negative gradient in units; the first tree is fitted on the labels."""
        y = self.y.astype(np.float64)
        return np.rint(UNIT * (y if first else 4.0 * y / (1.0 + np.exp(2.0 * y * self.score))))

    def drawn(self, seed: int, share: float) -> np.ndarray:
        if share >= 1.0:
            return np.ones(len(self.key), bool)
        h = self.key + np.uint64(seed)
        for by, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(by))) * np.uint64(factor)
        return (h ^ (h >> np.uint64(31))) < np.uint64(int(share * float(1 << 53))) << np.uint64(11)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _seen(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """A partition's slots: different values, at most one more than ``most``, and the slots that are set (not 0) in a row with it."""
    found: list[np.ndarray] = []
    together = np.zeros((0, 0), bool)
    for b in batches:
        x = _matrix(b.column(0)) + 0.0
        if not found:
            found, together = [np.zeros(0)] * x.shape[1], np.zeros((x.shape[1],) * 2, bool)
        on = (x != 0.0).astype(np.float32)
        together |= on.T @ on > 0.0
        for s, known in enumerate(found):
            if len(known) <= most:
                # most slots have two values, and those two are soon known
                new = x[(x[:, s] != known[0]) & (x[:, s] != known[-1]), s] if len(known) else x[:, s]
                found[s] = np.union1d(known, new)[: most + 1] if len(new) else known
    if found:
        columns = [np.arange(len(found), dtype=np.int32), [v.tolist() for v in found], [np.flatnonzero(t).tolist() for t in together]]
        types = (pa.int32(), pa.list_(pa.float64()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["slot", "v", "others"])


def layout_of(rows: DataFrame, bins: int = BINS) -> Layout:
    """Thresholds of each slot of ``x`` (array): between all values if there are at most ``bins``, else exact quantiles; and the places."""
    seen = rows.select("x").mapInArrow(partial(_seen, most=bins), "slot int, v array<double>, others array<int>")
    got = seen.groupBy("slot").agg(
        F.expr("sort_array(array_distinct(flatten(collect_set(v)))) as v"), F.expr("array_distinct(flatten(collect_set(others))) as others")
    ).collect()  # one row a slot
    if not got:
        raise ValueError("no rows to fit trees on")
    cuts, together = [np.zeros(0)] * len(got), np.zeros((len(got),) * 2, bool)
    for r in got:
        v = np.array(r["v"])
        cuts[r["slot"]] = (v[1:] + v[:-1]) / 2.0
        together[r["slot"], r["others"]] = True
    many = [r["slot"] for r in got if len(r["v"]) > bins]
    if many:
        long = rows.selectExpr(f"inline(transform(array({', '.join(map(str, many))}), s -> struct(s as slot, x[s] + 0D as value)))")
        found: dict[int, set[float]] = {s: set() for s in many}
        for r in exact_quantiles(long, "value", [k / bins for k in range(1, bins)], ["slot"]).collect():
            found[r["slot"]].add(r["quantile"])
        for s in many:
            cuts[s] = np.array(sorted(found[s]))
    if not any(len(c) for c in cuts):
        cuts[0] = np.array([np.inf])  # nothing to split on: rows are still counted
    return Layout.of(cuts, together)


def _packed(batches: Iterator[pa.RecordBatch], layout: Layout) -> Iterator[pa.RecordBatch]:
    """One row for each block: packed codes, labels and keys."""
    parts: list[tuple[np.ndarray, ...]] = []

    def block() -> pa.RecordBatch:
        codes, y, key = (np.concatenate(p, axis=-1) for p in zip(*parts))
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (codes, y, key)], names=["codes", "y", "key"])

    for b in batches:
        if len(b):
            parts.append((layout.pack(_matrix(b.column(0))), b.column(1).to_numpy(zero_copy_only=False).astype(np.int8), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))
            if sum(len(p[1]) for p in parts) >= BLOCK_ROWS:
                yield block()
    if parts:
        yield block()


def _block(row: Sequence[bytearray], codes: int) -> Block:
    y = np.frombuffer(bytes(row[1]), np.int8)
    return Block(np.frombuffer(bytes(row[0]), np.uint16).reshape(codes, len(y)), y, np.frombuffer(bytes(row[2]), np.uint64), np.zeros(len(y)))


def _counts(blocks: Iterator[Block], tree: Tree, wanted: Sequence[int], shared: Broadcast[Layout], first: bool, seed: int, share: float) -> Iterator[np.ndarray]:
    """A partition's rows and gradient sums for each wanted node and bin: (2, nodes, bins of all fields)."""
    layout = shared.value
    place = np.full(max(wanted) + 1, -1, np.int64)
    place[list(wanted)] = np.arange(len(wanted))
    cells = len(wanted) << CODE_BITS
    total = np.zeros((2, layout.codes, cells), np.int64)
    for block in blocks:
        node = block.nodes(tree, layout)
        use = block.drawn(seed, share)
        if len(tree.splits):
            at = np.where(node < len(place), place[np.minimum(node, len(place) - 1)], -1)
            use &= at >= 0
        pick = np.flatnonzero(use)
        base = at[pick] << CODE_BITS if len(tree.splits) else np.zeros(len(pick), np.int64)
        weight = block.gradient(first)[pick]
        for c in range(layout.codes):
            cell = base + block.codes[c][pick]
            total[0, c] += np.bincount(cell, minlength=cells)
            total[1, c] += np.bincount(cell, weights=weight, minlength=cells).astype(np.int64)
    fields = []
    for code, shift, bits in zip(layout.code, layout.shift, layout.bits):
        fields.append(total[:, code].reshape(2, len(wanted), -1, 1 << bits, 1 << shift).sum(axis=(2, 4)))
    yield np.concatenate(fields, axis=2)


def _best(counts: np.ndarray, layout: Layout, usable: Sequence[int], min_rows: int) -> tuple[int, int, float] | None:
    """The split of a node with the largest gain in variance; the first slot and bin on ties."""
    rows, whole_g = _whole(counts, layout)
    best, at = 1e-12 * whole_g * whole_g / rows if rows else 0.0, None
    for s in sorted(usable):
        if layout.owner[s] >= 0:
            left, g = layout.left_sums(counts, s)
            ok = np.flatnonzero((left >= min_rows) & (rows - left >= min_rows))
            if len(ok):
                left, g = left[ok], g[ok] / UNIT
                gain = g * g / left + (whole_g - g) ** 2 / (rows - left) - whole_g * whole_g / rows
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, at = float(gain[k]), (s, int(ok[k]), float(layout.cuts[s][ok[k]]))
    return at


def _whole(counts: np.ndarray, layout: Layout) -> tuple[int, float]:
    """A node's rows and gradient sum; every field counts each row once."""
    n, g = counts[:, : 1 << layout.bits[0]].sum(axis=1).tolist()
    return n, g / UNIT


def _grown(blocks: RDD, shared: Broadcast[Layout], number: int, depth: int, share: float, columns: float, min_rows: int, seed: int) -> Tree:
    """A tree, level by level. Of two children the smaller is counted, the other is the parent less that one."""
    rng = np.random.default_rng([seed, number])
    draw = int(rng.integers(1 << 63))
    tree, known, wanted = Tree(), {}, [1]
    layout = shared.value
    slots = len(layout.cuts)
    for level in range(depth):
        count = partial(_counts, tree=tree, wanted=wanted, shared=shared, first=number == 0, seed=draw, share=share)
        sums = blocks.mapPartitions(count).reduce(np.add)  # counts of each node and bin, no rows
        new = dict(zip(wanted, np.moveaxis(sums, 1, 0)))
        if level:
            new |= {k ^ 1: known[k // 2] - counted for k, counted in new.items()}
        known, wanted = new, []
        for k in sorted(known):
            n, g = _whole(known[k], layout)
            tree.values[k] = g / n if n else 0.0
            split = _best(known[k], layout, rng.choice(slots, max(1, int(np.ceil(columns * slots))), replace=False).tolist(), min_rows)
            if split:
                tree.splits[k] = split
                nl, gl = layout.left_sums(known[k], split[0])[:, split[1]].tolist()
                tree.values[2 * k], tree.values[2 * k + 1] = gl / UNIT / nl, (g - gl / UNIT) / (n - nl)
                wanted.append(2 * k if 2 * nl <= n else 2 * k + 1)
        if not wanted:
            break
    return tree


class BoostedTrees(Model, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted trees; ``transform`` adds ``probability`` as a vector of both classes."""

    state = Param(Params._dummy(), "state", "the trees and their weights as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, trees: Sequence[tuple[Tree, float]] = ()) -> None:
        super().__init__()
        self._set(state=json.dumps([[w, [[k, *v] for k, v in t.splits.items()], list(t.values.items())] for t, w in trees]))

    @property
    def trees(self) -> list[tuple[Tree, float]]:
        read = json.loads(self.getOrDefault(self.state))
        return [(Tree({k: (s, b, cut) for k, s, b, cut in splits}, {k: v for k, v in values}), w) for w, splits, values in read]

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        package_on_path(dataset.sparkSession)
        trees = self.trees

        def probability(vectors: pd.Series) -> pd.Series:
            if not len(vectors):
                return pd.Series([], dtype="float64")
            x = np.ascontiguousarray(np.stack(vectors.to_numpy()).T)
            score = np.zeros(x.shape[1])
            for tree, weight in trees:
                score = score + weight * tree.table()[tree.nodes(x.shape[1], lambda s, _, cut: x[s] > cut)]
            return pd.Series(1.0 / (1.0 + np.exp(-2.0 * score)))

        p = F.pandas_udf(probability, "double")(vector_to_array("features"))
        return dataset.withColumn("_p", p).withColumn("probability", array_to_vector(F.expr("array(1D - _p, _p)"))).drop("_p")


def fit_trees(
    rows: DataFrame, label: str, key: str | None = None, *, trees: int, depth: int, step: float, subsample: float, columns: float,
    min_rows: int, seed: int, refresh: int = 50,
) -> BoostedTrees:
    """Fit on ``features`` (vector) and ``label`` (0 or 1, or boolean). A row is drawn for a tree by ``key``, or by its place without one.

    Every tree's job reads the sums of the trees before; each ``refresh`` trees these are worked out anew from the packed rows, so the
    lineage stays short and nothing is written but the packed rows.
    """
    spark = rows.sparkSession
    package_on_path(spark)
    drawn_by = F.xxhash64(key) if key else F.xxhash64(F.monotonically_increasing_id())
    data = rows.select(vector_to_array("features").alias("x"), F.expr(f"cast(2 * cast({label} as int) - 1 as int)").alias("y"), drawn_by.alias("key"))
    layout = layout_of(data)
    packed = pin(data.mapInArrow(partial(_packed, layout=layout), "codes binary, y binary, key binary"))
    n = packed.agg(F.sum(F.length("y"))).first()[0]
    cores = spark.sparkContext.defaultParallelism
    parts = min(-(-n // FEW_ROWS), cores * -(-n // (cores * TASK_ROWS)))
    codes = layout.codes
    read = packed.rdd.map(lambda r: _block(r, codes)).zipWithIndex().map(lambda p: (p[1], p[0]))
    start = read.partitionBy(parts, int).values().persist(HELD)
    shared = spark.sparkContext.broadcast(layout)  # every map of the lineage names it
    fitted: list[tuple[Tree, float]] = []
    blocks, held = start, []
    for m in range(trees):
        tree = _grown(blocks, shared, m, depth, subsample, columns, min_rows, seed)
        for old in held[:-1]:
            old.unpersist()
        del held[:-1]
        fitted.append((tree, step if m else 1.0))
        source, more = (start, list(fitted)) if len(fitted) % refresh == 0 else (blocks, fitted[-1:])
        blocks = source.map(partial(Block.after, trees=more, shared=shared)).persist(HELD)
        held.append(blocks)
    for old in (*held, start, shared):
        old.unpersist()
    return BoostedTrees(fitted)
