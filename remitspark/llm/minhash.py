"""Near-duplicate documents: ProbMinHash of weighted word shingles, banding, exact verification, components."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import FOLD, SPACE, Spans, find_words, mixed, powers, text_bytes
from .common import batch_rows, stored
from .components import components

WORDS = 5
SIMILARITY = 0.8
#: Bands of registers: a pair at the threshold meets in at least one of them with probability 0.99994.
BANDS, ROWS = 32, 6
#: Registers that agree may fall short of the threshold by so many standard errors: a pair at the threshold does so with probability 3e-5.
SLACK = 4.0
#: Bytes of shingles and rows of a block of a bucket.
CELL_BYTES, CELL_ROWS = 16 << 20, 1024
_MIX = mixed(np.arange(1, 64, dtype=np.uint64)) | np.uint64(1)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, and where each text's begin. A word is a run without white space, A-Z folded."""
    data, at = text_bytes(texts)
    data = FOLD[data]
    w = find_words(data, at, ~SPACE)
    return Spans(data).of(w.start, w.end), w.bounds


def contents(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence: sums of word hashes times powers, as for bytes."""
    power, inverse = powers(len(h))
    out = []
    for seed in (0, 1):
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mixed(h + _MIX[40 + seed]) * power[: len(h)], out=sums[1:])
        out.append(mixed((sums[bounds[1:]] - sums[bounds[:-1]]) * inverse[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).astype(np.int64))
    return out[0], out[1]


def shingles(h: np.ndarray, bounds: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a batch: text number, hash, count.

    A text of fewer words is one shingle; one without words has none.
    """
    n = np.diff(bounds)
    full = np.maximum(n - words + 1, 0)
    rows = np.repeat(np.arange(len(n)), full)
    first = np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full - bounds[:-1], full)
    s = np.zeros(len(first), np.uint64)
    for j in range(words):
        s += h[first + j] * _MIX[j]
    short = np.flatnonzero((n > 0) & (n < words))
    few = np.array([(h[bounds[i] : bounds[i + 1]] * _MIX[: n[i]]).sum(dtype=np.uint64) for i in short], dtype=np.uint64)
    s, rows = mixed(np.concatenate([s, few])), np.concatenate([rows, short])
    # one key for (text, shingle), so one sort counts the shingles of all texts
    _, index, count = np.unique(mixed(s + mixed(rows.astype(np.uint64))), return_index=True, return_counts=True)
    return rows[index], s[index], count


def sketch(rows: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash: each element arrives as a Poisson process of its weight's rate, every arrival at a random register.

    A register keeps its first element. An element stops as soon as its next arrival is later than the latest register of
    its text, as no further arrival can matter. Two texts agree in a register with the probability Jaccard
    similarity of their weights. Returns n x registers element hashes (0 where a text has no element).
    """
    time = np.full(n * registers, np.inf)
    got = np.zeros(n * registers, dtype=np.uint64)
    latest = np.full(n, np.inf)
    live, clock, turn = np.arange(len(rows)), np.zeros(len(rows)), 0
    while len(live):
        block = 1 if len(live) > 4096 else 64  # few elements left: many arrivals of each at once
        step = np.arange(turn, turn + block, dtype=np.uint64)
        seed = mixed(element[live][:, None] + (step * np.uint64(2) + np.uint64(1)) * _MIX[50])
        gap = -np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live][:, None]
        arrival = clock[live][:, None] + np.cumsum(gap, axis=1)
        at = (mixed(seed ^ _MIX[51]) % np.uint64(registers)).astype(np.int64) + rows[live][:, None] * registers
        use = arrival < latest[rows[live]][:, None]
        a, r = arrival[use], at[use]
        e = np.broadcast_to(element[live][:, None], arrival.shape)[use]
        np.minimum.at(time, r, a)
        first = time[r] == a
        got[r[first]] = e[first]
        latest = time.reshape(n, registers).max(axis=1)
        clock[live] = arrival[:, -1]
        live = live[clock[live] < latest[rows[live]]]
        turn += block
    return got.reshape(n, registers)


def band_keys(signature: np.ndarray, bands: int = BANDS, per: int = ROWS) -> np.ndarray:
    """One key for each band of registers; the band's number is part of it."""
    x = signature.reshape(len(signature), bands, per)
    key = np.zeros((len(signature), bands), np.uint64)
    for j in range(per):
        key += mixed(x[:, :, j]) * _MIX[j]
    return mixed(key + np.arange(bands, dtype=np.uint64) * _MIX[52]).astype(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted elements, weights)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    rest_x, rest_y = x.sum() - x[ia].sum(), y.sum() - y[ib].sum()
    ratio = x[ia] / y[ib]
    out = 0.0
    for r in np.unique(ratio):  # sum over j of max(x_j / x_i, y_j / y_i), by the ratio x_i / y_i
        total = rest_x + rest_y * r + np.maximum(x[ia], y[ib] * r).sum()
        out += x[ia][ratio == r].sum() / total
    return out


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            h, at = _words(b.column(1))
            c1, c2 = contents(h, at)
            rows, s, count = shingles(h, at, words)
            keys = band_keys(sketch(rows, s, count, b.num_rows, BANDS * ROWS))
            some = np.bincount(rows, minlength=b.num_rows) > 0
            flat = keys[some].ravel()
            bounds = np.r_[0, np.cumsum(some * BANDS)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c1), pa.array(c2), lists], names=["doc_id", "c1", "c2", "bands"])

    return docs.mapInArrow(run, "doc_id long, c1 long, c2 long, bands array<long>")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes (node, c1, c2, doc_id): the row of the node's own doc_id, so copies of a hot content meet nobody."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c1, c2 = contents(*_words(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c1), pa.array(c2), b.column(1)], names=["id", "c1", "c2", "text"])

    found = docs.select("doc_id", "text").mapInArrow(run, "id long, c1 long, c2 long, text string")
    same = found["id"].eqNullSafe(wanted["doc_id"]) & (found["c1"] == wanted["c1"]) & (found["c2"] == wanted["c2"])
    return found.join(wanted, same).groupBy("node").agg(F.first("text").alias("text"))  # an id may come again with its text


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """Each node's shingles and counts, a byte of every register, and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, s, count = shingles(*_words(b.column(1)), words)
            signature = sketch(rows, s, count, b.num_rows, BANDS * ROWS)
            keys = band_keys(signature)
            order = np.lexsort((s, rows))
            at = np.searchsorted(rows[order], np.arange(b.num_rows + 1))
            s, count = s[order], count[order].astype(np.int32)
            pieces = [(s[x:y].tobytes(), count[x:y].tobytes()) for x, y in zip(at[:-1], at[1:])]
            columns = [[x for x, _ in pieces], [y for _, y in pieces], [r.tobytes() for r in (mixed(signature) >> np.uint64(56)).astype(np.uint8)], [k.tobytes() for k in keys]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.binary()) for c in columns)], names=["node", "elements", "counts", "registers", "bands"])

    return texts.select("node", "text").mapInArrow(run, "node long, elements binary, counts binary, registers binary, bands binary")


def _cell_links(key: int, cross: bool, rows: list[tuple], least: float) -> list[tuple[int, int, float]]:
    """Links that join the labels of one cell: pairs of different labels that share this band and none before it.

    Pairs whose registers agree in far fewer places than similar ones do are passed over; of the others the likeliest
    come first, each is compared exactly, and pairs that are joined by then are not.
    """
    node, label, block = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    sets = [(np.frombuffer(r[3], np.uint64), np.frombuffer(r[4], np.int32)) for r in rows]
    register = np.array([np.frombuffer(r[5], np.uint8) for r in rows])
    band = np.array([np.frombuffer(r[6], np.int64) for r in rows])
    this = int(np.flatnonzero(band[0] == key)[0])
    n, width = len(rows), register.shape[1]
    cut = least - SLACK * np.sqrt(least * (1 - least) / width)
    found: list[tuple[np.ndarray, ...]] = []
    step = max(1, (1 << 24) // (n * width))
    for lo in range(0, n - 1, step):
        i = np.arange(lo, min(lo + step, n))
        open_ = (label[i][:, None] != label[None, :]) & (i[:, None] < np.arange(n)[None, :])
        if cross:
            open_ &= block[i][:, None] != block[None, :]
        if not open_.any():
            continue
        alike = (register[i][:, None, :] == register[None, :, :]).sum(axis=2, dtype=np.int32) / width
        open_ &= alike >= cut
        x, y = np.nonzero(open_)
        new = ~(band[i[x], :this] == band[y, :this]).any(axis=1)
        found.append((i[x[new]], y[new], alike[x[new], y[new]]))
    if not found:
        return []
    x, y, alike = (np.concatenate(c) for c in zip(*found))
    root = {v: v for v in label.tolist()}

    def top(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    links = []
    for k in np.argsort(-alike, kind="stable"):
        p, q = top(int(label[x[k]])), top(int(label[y[k]]))
        if p != q and (value := probability_jaccard(sets[x[k]], sets[y[k]])) >= least - 1e-12:
            root[p] = q
            links.append((int(node[x[k]]), int(node[y[k]]), value))
    return links


def _linked(open_rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links between the labels of every bucket in ``open_rows`` (key, node, label), found where its members are.

    A bucket of up to CELL_BYTES of shingles and CELL_ROWS rows is one cell, a larger one a cell for each pair of its blocks, so
    no task holds more than two blocks. Only links leave a cell, fewer than it has labels.
    """
    rows = open_rows.join(sets, "node")
    size = F.octet_length("elements") + F.octet_length("counts")
    buckets = rows.groupBy("key").agg(F.greatest(F.lit(1), F.ceil(F.sum(size) / CELL_BYTES), F.ceil(F.count(F.lit(1)) / CELL_ROWS)).cast("int").alias("blocks"))
    placed = open_rows.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    cells = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = cells.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in b.slice(s, 256).columns))

        for (key, i, j), cell in groupby(rows_of(), key=lambda r: r[:3]):
            links = _cell_links(key, i != j, [r[3:] for r in cell], least)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links)], names=["a", "b", "similarity"])

    return dealt.select("key", "i", "j", "node", "label", "block", "elements", "counts", "registers", "bands").mapInArrow(run, "a long, b long, similarity double")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches ``least``."""
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(tb, "b").join(ta, "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, tuple] = OrderedDict()  # a pivot comes with many partners
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            sets: dict[int, tuple] = {}
            for ids, column in ((a, batch.column(2)), (b, batch.column(3))):
                new = {x: i for i, x in enumerate(ids) if x not in known and x not in sets}
                if new:
                    at = list(new.values())
                    rows, s, count = shingles(*_words(column.take(pa.array(at))), words)
                    order = np.lexsort((s, rows))
                    bounds = np.searchsorted(rows[order], np.arange(len(at) + 1))
                    for j, x in enumerate(new):
                        o = order[bounds[j] : bounds[j + 1]]
                        sets[x] = (s[o], count[o])
            value = np.array([probability_jaccard(sets.get(x) or known[x], sets.get(y) or known[y]) for x, y in zip(a, b)])
            for x in a:
                if x in sets:
                    known[x] = sets[x]
                    if len(known) > 64:
                        known.popitem(last=False)
            hit = value >= least - 1e-12
            yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)[hit]), pa.array(np.array(b, np.int64)[hit]), pa.array(value[hit])], names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Classes of near-duplicate documents: doc_id, class_id, class_size, kept, class_key.

    Texts of one word sequence are one node. Nodes that share a band are candidates; a link is a candidate pair whose exact
    probability Jaccard similarity is at least ``similarity``; classes are the connected components of the links.
    No pair of a bucket becomes a row. First every member is compared with one pivot, the member that shares most buckets: for
    most buckets that leaves one label, and nothing more is to be done. The members of the others meet once more, with their shingles and in
    blocks of bounded size, and are compared there: pairs of different labels whose registers agree nearly often enough, likeliest first,
    exactly, until one label is left or no pair is. So every candidate pair of two classes is decided, at any size of a bucket.

    class_key is a class's own key, from its least content; class_id is the smallest doc_id of a class, which several classes
    share if an id stands on texts that are not alike; of a class's rows the first with that id is kept. Rows without words are
    one class (equal word sequences). Null ids come after all others; a class of null ids alone has a null class_id.
    Ties and repeated rows are copies of one node. An empty table gives no rows; other columns are ignored.
    """
    batch_rows(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(_sketches(plain, words).withColumn("row", F.monotonically_increasing_id()))
    # the least row of a content and then of a class by aggregation, so no id or class is gathered in one task
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "c1", "c2", "row"))
    one = rows.groupBy("c1", "c2").agg(first.alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = stored(one.withColumn("node", F.monotonically_increasing_id()))
    labels = _labels(plain, nodes, words, similarity)
    classed = nodes.select("node", "c1", "c2", "first", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = F.min(F.struct("c1", "c2"))
    key = F.concat(F.lpad(F.hex(least["c1"]), 16, "0"), F.lpad(F.hex(least["c2"]), 16, "0"))
    classes = classed.groupBy("label").agg(F.min("first").alias("first"), F.sum("n").alias("class_size"), key.alias("class_key"))
    classes = classes.select("label", F.col("first.doc_id").alias("class_id"), F.col("first.row").alias("kept_row"), "class_size", "class_key")
    placed = classed.select("c1", "c2", "label").join(classes, "label").drop("label")
    found = rows.select("doc_id", "c1", "c2", "row").join(placed, ["c1", "c2"])
    return found.withColumn("kept", F.col("row") == F.col("kept_row")).select("doc_id", "class_id", "class_size", "kept", "class_key", "c1", "c2")


def _labels(docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    spread = nodes.select("node", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(spread.join(buckets, "key"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    ranked = members.join(degree, "node")
    pivots = stored(ranked.groupBy("key").agg(F.max(F.struct("degree", "node")).alias("top")).select("key", F.col("top.node").alias("pivot")))
    pairs = stored(_ordered(members.join(pivots, "key").filter("node <> pivot").select("pivot", "node")))
    # the texts of candidates only
    candidates = members.select("node").distinct()
    wanted = nodes.select("node", "c1", "c2", F.col("first.doc_id").alias("doc_id")).join(candidates, "node", "left_semi")
    texts = stored(_texts(docs, wanted))
    links = stored(_verified(pairs, texts, words, similarity))
    labels = components(links)
    state = members.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # a pivot has been compared with all of its bucket; are the others of one label, so have they
    others = state.join(pivots, (state["key"] == pivots["key"]) & (state["node"] == pivots["pivot"]), "left_anti")
    several = others.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    waiting = stored(others.join(several, "key", "left_semi"))
    if waiting.isEmpty():
        return labels
    sets = stored(_sets(texts.join(waiting.select("node").distinct(), "node", "left_semi"), words))
    more = stored(_linked(waiting, sets, similarity))
    return components(links.unionByName(more), start=labels)


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller node first."""
    return pairs.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class, with all its columns: the row of the smallest doc_id."""
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    flat = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    found = stored(near_duplicates(flat, **options))
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("c1").alias("k1"), F.col("c2").alias("k2"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c1, c2 = contents(*_words(b.column(2)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c1), pa.array(c2)], names=["row", "doc_id", "c1", "c2"])

    tagged = flat.mapInArrow(run, T.StructType([*flat.schema.fields[:2], T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType())]))
    same = tagged["doc_id"].eqNullSafe(kept["kept_id"]) & (tagged["c1"] == kept["k1"]) & (tagged["c2"] == kept["k2"])
    one = tagged.join(kept, same, "left_semi")
    if found.filter(F.col("doc_id").eqNullSafe(F.col("class_id")) & ~F.col("kept")).isEmpty():
        return one.select("row.*")
    # an id comes more than once: any one row of those with the kept content
    return one.groupBy("doc_id", "c1", "c2").agg(F.first("row").alias("row")).select("row.*")
