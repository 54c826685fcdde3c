"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch_rows, stored
from .running import prefix_sums
from .tokens import token_ids

CAPACITY = 4096
END_ID = 1
#: Rounds of the multiplicative weights; each covers one part of every length's count.
ROUNDS = 24


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenise whole documents and cut those longer than ``capacity``; a piece's ids are summed up by their CRC-32.

    Returns doc_id, piece, start, length, ids_crc32 and, if asked for, ids. A null or empty text is the end id alone.
    """
    batch_rows(docs.sparkSession)
    path = tokenizer or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids, bounds = token_ids(b.column(1), path, end_id)
            n = np.diff(bounds)
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(n[row] - start, capacity)
            first = bounds[row] + start
            data = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * (a + m)]) for a, m in zip(first.tolist(), length.tolist())]
            columns = [b.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[first, first[-1] + length[-1]], pa.int32()), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _knapsack(value: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best value of each capacity, and the length taken last (0: none); lengths may be taken again and again."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], took[c] = best[c - 1], 0
        if fit[c]:
            v = value[: fit[c]] + best[c - lengths[: fit[c]]]
            i = int(v.argmax())
            if v[i] > best[c - 1]:
                best[c], took[c] = v[i], lengths[i]
    return best, took


def _filled(took: np.ndarray, room: int) -> list[int]:
    """The lengths of the best filling of ``room``."""
    out = []
    while room > 0:
        if took[room]:
            out.append(int(took[room]))
            room -= int(took[room])
        else:
            room -= 1
    return out


def configurations(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, eta: float = 4.0) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often to use which filling of a sequence: (times, [(length, copies), ...]).

    The program: the fewest fillings (weighted) that cover the count of every length. Prices start at length / capacity,
    the dual that proves the volume bound, and grow by exp(eta * lag) for lengths that lag in coverage. In each
    round dynamic programming finds the best completion of every lagging length at these prices, and that filling's weight
    grows until the length has its part. The weights are rounded down within what is left of each length; what remains,
    a number of pieces that depends on the number of fillings and not on the input, is packed by best fit, longest first.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return []
    if lengths[0] < 1 or lengths[-1] > capacity:
        raise ValueError("lengths must be between 1 and the capacity")
    count = np.zeros(capacity + 1)
    count[lengths] = [histogram[int(k)] for k in lengths]
    covered = np.zeros(capacity + 1)
    weight: dict[tuple, float] = defaultdict(float)
    for r in range(1, rounds + 1):
        part = covered[lengths] / count[lengths]
        price = lengths / capacity * np.exp(eta * (part.mean() - part))
        _, took = _knapsack(price, lengths, capacity)
        for ell in lengths[::-1].tolist():
            if covered[ell] >= count[ell] * r / rounds:
                continue
            copies: dict[int, int] = defaultdict(int)
            for k in [ell, *_filled(took, capacity - ell)]:
                copies[k] += 1
            step = (count[ell] * r / rounds - covered[ell]) / copies[ell]
            for k, a in copies.items():  # no length runs ahead by more than a round
                step = min(step, (count[k] * min(1.0, (r + 1) / rounds) - covered[k]) / a)
            if step <= 0:
                continue
            for k, a in copies.items():
                covered[k] += a * step
            weight[tuple(sorted(copies.items(), reverse=True))] += step
    left = count.astype(np.int64)
    out = []
    carry = 0.0
    for config, x in sorted(weight.items(), key=lambda kv: (-kv[1], kv[0])):
        carry += x
        times = min(int(carry + 1e-9), *(int(left[k]) // a for k, a in config))
        if times > 0:
            carry -= times
            for k, a in config:
                left[k] -= a * times
            out.append((times, list(config)))
        carry = min(carry, 1.0)
    return out + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first; sequences of equal content are handled together."""
    groups: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # room -> content -> sequences
    is_open = np.zeros(capacity + 1, dtype=bool)
    for ell in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[ell])
        while todo:
            at = int(is_open[ell:].argmax()) + ell if is_open[ell:].any() else -1
            if at < 0:
                fit = capacity // ell
                full, rest = divmod(todo, fit)
                for times, copies in ((full, fit), (1 if rest else 0, rest)):
                    if times:
                        room = capacity - copies * ell
                        groups[room][((ell, copies),)] += times
                        is_open[room] = True
                break
            content, have = next(iter(groups[at].items()))
            fit = at // ell
            if todo >= fit:
                use, copies = min(have, todo // fit), fit
            else:
                use, copies = 1, todo
            todo -= use * copies
            if use == have:
                del groups[at][content]
            else:
                groups[at][content] -= use
            if not groups[at]:
                is_open[at] = False
            groups[at - copies * ell][(*content, (ell, copies))] += use
            is_open[at - copies * ell] = True
    return [(times, list(content)) for by in groups.values() for content, times in by.items()]


def _places(configs: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """For each length and range of its pieces' numbers: (length, first number, first sequence, sequences, offset)."""
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, content in configs:
        offset = 0
        for ell, copies in content:
            rows.append((ell, used[ell], sequence, times, offset))
            used[ell] += times * copies
            offset += ell * copies
        sequence += times
    out = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(cut: DataFrame, *, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Give every piece (a row with ``length``) a sequence and the offset there; sequences are gapless from 0.

    The driver sees the length histogram only (at most ``capacity`` rows). Pieces of one length are numbered by
    distributed prefix sums, and the number says where a piece goes; the table of places is bounded by the rounds and
    the capacity, not by the input. Pieces that tie in ``order`` are interchangeable. No rows in, no rows out.
    """
    cut = stored(cut)
    histogram = {int(r[0]): int(r[1]) for r in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}
    spark = cut.sparkSession
    places = spark.sparkContext.broadcast(_places(configurations(histogram, capacity)))
    keyed = cut.withColumns({"_g": F.lpad(F.col("length").cast("string"), 12, "0"), "_one": F.lit(1).cast("long")})
    numbered = prefix_sums(keyed, "_g", list(order), "_one", out="_nth").drop("_g", "_one")
    names = cut.columns
    at = {c: i for i, c in enumerate(numbered.columns)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        keys = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            ell, nth = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (at["length"], at["_nth"]))
            t = table[np.searchsorted(keys, ell << 44 | nth, side="right") - 1]
            i = nth - t[:, 1]
            sequence = t[:, 2] + i % t[:, 3]
            offset = t[:, 4] + i // t[:, 3] * ell
            yield pa.RecordBatch.from_arrays([*(b.column(at[c]) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Tokenise, cut and pack documents: the pieces with sequence_id and offset."""
    return pack(pieces(docs, **options), capacity=options.get("capacity", CAPACITY))
