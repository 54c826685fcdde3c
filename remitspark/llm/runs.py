"""Periodic runs of words, found with a dictionary of basic factors.

The factors of 1, 2, 4 ... words of each text get names; of each name the occurrences are sorted. Occurrences closer than twice the
factor's length form arithmetic progressions, and a run of period p (L <= p < 2 L) shows as two occurrences of its factor of L words
that are p apart. Inside a progression such pairs repeat one another, so only pairs with an end of a progression are proposed:

Let a, b = a + p be occurrences in a run of period p, and take the gaps to their neighbours. If both have an equal gap to the next
occurrence, the next pair lies in the same run (the copies overlap), and likewise backwards. So walk to a pair whose next gaps differ.
If neither end of the walk is the end of a progression, a has gap d on both sides and b gap e <> d on both, and the gaps lead out of
the run; then p words of the run have both periods and, as d + e <= p, the period gcd(d, e) too, and the factor would occur at that
smaller distance. So every run is proposed by a pair with an end of a progression, of which there are a few in 2 L words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE, Spans, byte_slices, find_words, mixed, text_bytes
from .common import on_path

#: A run has at least so many words, and at least two periods.
LEAST = 12
#: Bytes of text that are worked on at a time; a longer text is on its own.
CHUNK = 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_NONE = np.int64(1) << 60
#: Texts' numbers begin here, far from any word's hash in the tests and elsewhere.
_TEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def _named(key: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name the factors that begin in ``at`` by equal keys: a name for every place (-1: occurs once), and the places of
    the repeated ones, sorted by name and place, with their names."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = np.r_[True, sorted_key[1:] != sorted_key[:-1]] if len(key) else np.zeros(0, bool)
    number = np.cumsum(first) - 1
    again = np.bincount(number)[number] > 1 if len(key) else first
    names = np.full(size + 1, -1, dtype=np.int64)
    place, name = at[order[again]], number[again]
    names[place] = name
    return names, place, name


def _proposed(place: np.ndarray, name: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, distance), size <= distance < 2 size, of equally named factors of which one ends a progression."""
    n = len(place)
    gap = np.full(n + 1, _NONE)
    same = name[1:] == name[:-1]
    gap[1:n][same] = (place[1:] - place[:-1])[same]
    gap[gap >= 2 * size] = _NONE
    before, after = gap[:-1], gap[1:]
    end = (before != after) | (before > size)
    ends = np.flatnonzero(end)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for step in (1, -1):
        # the next end after (before) every occurrence, then the one after that, while less than 2 size away
        where = np.searchsorted(ends, np.arange(n), side="right") if step == 1 else np.searchsorted(ends, np.arange(n), side="left") - 1
        live = np.arange(n)
        while True:
            inside = (where >= 0) & (where < len(ends))
            live, where = live[inside], where[inside]
            other = ends[where]
            distance = np.abs(place[other] - place[live])
            near = (name[other] == name[live]) & (distance < 2 * size)
            live, where, other, distance = live[near], where[near], other[near], distance[near]
            if not len(live):
                break
            far = distance >= size
            out.append((np.minimum(place[other], place[live])[far], distance[far]))
            where = where + step
    a, p = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((a, p))
    a, p = a[order], p[order]
    # pairs of one distance whose factors touch lie in one run: the first stands for all
    new = np.r_[True, (p[1:] != p[:-1]) | (a[1:] > a[:-1] + size)] if len(a) else np.zeros(0, bool)
    return a[new], p[new]


def word_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs: maximal stretches with smallest period p and at least max(least, 2 p) words.

    ``words`` are the words' hashes (or any numbers) of several texts, text i has words bounds[i] .. bounds[i + 1]. Runs never cross
    texts; they are sorted by start, then period. Time and memory grow as n log n at most.
    """
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = mixed(words.astype(np.uint64)) + mixed(text.astype(np.uint64) + _TEXT)
    names, place, name = _named(key, np.arange(n), n)
    levels, found, size = [], [], 1
    while len(place):
        levels.append(names)
        found.append(_proposed(place, name, size))
        # a factor of twice the length repeats only if both halves do; names tell texts apart, so halves are of one text
        at = np.sort(place)
        at = at[at + size < n]
        half = names[at + size]
        joins = (half >= 0) & (text[at] == text[at + size])
        at, half = at[joins], half[joins]
        names, place, name = _named(names[at] * np.int64(n) + half, at, n)
        size *= 2
    a, p = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    right, left = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for k in reversed(range(len(levels))):  # how far the text and itself p words on agree, to both sides, in powers of two
        names, size = levels[k], 1 << k
        x, y = a + right, np.minimum(a + p + right, n)
        right += size * ((names[x] >= 0) & (names[x] == names[y]))
        x = a - left - size
        y = np.where(x < 0, n, x + p)
        left += size * ((names[y] >= 0) & (names[np.where(x < 0, n, x)] == names[y]))
    start, length = a - left, left + p + right
    keep = length >= np.maximum(least, 2 * p)
    start, length, p = start[keep], length[keep], p[keep]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    # one stretch of several periods: the smallest is its own, the others are its multiples
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, p = start[new], length[new], p[new]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, docs: int) -> pa.Array:
    """The words data[start:end], joined by one space within each text."""
    size = end - start + 1  # with the space after it
    at = np.cumsum(size) - size
    source = np.repeat(start - at, size) + np.arange(int(size.sum()))
    out = data[np.minimum(source, max(len(data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out[at + size - 1] = 32
    last = np.r_[doc[1:] != doc[:-1], True] if len(doc) else np.zeros(0, bool)
    keep = np.ones(len(out), dtype=bool)
    keep[(at + size - 1)[last]] = False
    length = np.bincount(doc, weights=size - last, minlength=docs).astype(np.int64)
    offsets = np.r_[0, np.cumsum(length)]
    return pa.LargeStringArray.from_buffers(docs, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[keep].tobytes())).cast(pa.string())


def _collapse(texts: pa.Array, least: int) -> tuple[pa.Array, ...]:
    data, at = text_bytes(texts)
    w = find_words(data, at, ~SPACE)
    start, length, period = word_runs(Spans(data).of(w.start, w.end), w.bounds, least)
    text = np.searchsorted(w.bounds, start, side="right") - 1
    drop = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = np.cumsum(drop[:-1]) == 0
    runs = pa.StructArray.from_arrays([pa.array(start - w.bounds[text]), pa.array(length), pa.array(period)], fields=list(RUN))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=len(texts)))], pa.int32()), runs)
    return pa.array(np.diff(w.bounds)), lists, _joined(data, w.start[kept], w.end[kept], w.doc[kept], len(texts))


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """The periodic runs of words of every text, and the text without their repetitions.

    Returns one row per input row: doc_id, n_words, runs (start, length and period in words, by start, then period) and collapsed: the words
    that no run holds after its first period, joined by single spaces. A word is a maximal run without white space (space,
    0x09-0x0D), case-sensitive; words are told apart by 64-bit hashes.

    Each text is one row's work and no row is shuffled. Texts are taken in chunks of about a megabyte, a longer text on its own: memory is
    linear in the chunk for each doubling of the longest repetition in it. Null, empty and white texts have no words and no runs. Repeated
    rows and null ids are rows like others. No rows in, no rows out; other columns are ignored.
    """
    on_path(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in byte_slices(b.column(1), CHUNK):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *_collapse(b.column(1).slice(lo, hi - lo), least)], names=["doc_id", "n_words", "runs", "collapsed"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where every tenth document, by the hash h of its id, repeats itself: with g = h div 10 and n words, each word
    i >= a = g mod n becomes word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Rows without id or words stay."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", h)
    chosen = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words))
    n, g = F.size("words"), F.expr("h div 10")
    chosen = chosen.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.expr("(size(words) - a) div (3 + (h div 10) % 8)")).cast("int"))

    def word(i: Column) -> Column:
        return F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")))

    rewritten = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")
    return chosen.select("doc_id", F.when(n > 0, rewritten).otherwise(F.col("text")).alias("text"))


def run_rows(found: DataFrame) -> DataFrame:
    """Counts and digests of :func:`periodic_runs`: the number of runs, the longest (ties: least start, then period) and SHA-256 digests of
    all runs (a line ``start,length,period`` each) and of the collapsed text."""
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("short"), r["start"].alias("start"), r["period"].alias("period")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    top = F.array_min(order)
    rows = found.withColumn("top", top)
    length = -F.col("top.short")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), length.alias("length"), F.col("top.period").alias("period"),
        F.expr("(1000 * -top.short) div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
