"""Removal of repeated passages: buckets of equal substrings, refined by identifiers of longer and longer strings.

All suffixes of a corpus are as many rows as it has bytes. Here only anchors are: of each window of ``length`` bytes the
q-gram with the smallest hash (the leftmost, if several). Equal windows have equal anchors at the same place, so a
window can only repeat within its anchor's bucket. Bucket-pointer refinement would sort every suffix by bucket identifiers of later offsets;
here, in its place, the anchors' buckets are refined by hashes of what lies around them: first of whole runs of windows that share an
anchor, then of ever shorter blocks of them, and each level takes up only what the level before left open.

Passages shorter than ``length`` bytes are found the same way among windows of words (``shared_passages``); they are counted, not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import SPACE, Spans, find_words, text_bytes
from .common import batch_rows, stored

LENGTH = 400
#: Bytes of an anchor; longer ones make fewer false candidates and more anchors.
GRAM = 160
#: Sizes of the blocks of windows in the refinements after the first; the last must be 1.
LEVELS = (16, 1)
#: Words of a passage, of its anchor, and the blocks of its windows.
WORDS, WORD_GRAM, WORD_LEVELS = 51, 12, (8, 1)
#: Bytes that are hashed at a time.
SECTION = 1 << 21
_POSITION = np.uint64((1 << 24) - 1)


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i at which that fits."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int, spans: tuple[Spans, Spans] | None = None) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text number, first and last window, anchor (bytes from the text's start),
    the anchor's hash and the hash of all the run's bytes. ``spans`` are those of ``data``, if they are there already."""
    out: list[tuple[np.ndarray, ...]] = []
    lo = 0
    while lo + length <= len(data):
        hi = min(lo + SECTION, len(data))  # windows that begin in lo .. hi - length
        part = data[lo:hi]
        one, two = spans if spans and len(part) == len(data) else (Spans(part, 1), Spans(part, 2))
        i = np.arange(len(part) - gram + 1)
        h = one.of(i, i + gram)
        key = (h & ~_POSITION) | i.astype(np.uint64)
        least = _sliding_least(key, length - gram + 1)
        where = (least & _POSITION).astype(np.int64)
        first = np.arange(len(where))
        text = np.searchsorted(at, first + lo, side="right") - 1
        fits = at[text + 1] >= first + lo + length
        change = np.ones(len(where) + 1, dtype=bool)
        change[1:-1] = (where[1:] != where[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
        edge = np.flatnonzero(change)
        s, e = edge[:-1], edge[1:] - 1
        ok = fits[s]
        s, e = s[ok], e[ok]
        t, a = text[s], where[s]
        base = at[t] - lo
        out.append((t, s - base, e - base, a - base, h[a], two.of(s, e + length)))
        if hi == len(data):
            break
        lo = hi - length + 1
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(6))


def _both(data: np.ndarray) -> tuple[Spans, Spans]:
    return Spans(data, 1), Spans(data, 2)


def _words(data: np.ndarray, at: np.ndarray, one: Spans) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, the same for equal words, and where each text's words begin."""
    words = find_words(data, at, ~SPACE)
    return one.of(words.start, words.end), words.bounds


def _content(at: np.ndarray, spans: tuple[Spans, Spans]) -> tuple[np.ndarray, np.ndarray]:
    """Two identifiers of each text: 64 and 32 bits."""
    c1, c2 = (x.of(at[:-1], at[1:]) for x in spans)
    return c1.astype(np.int64), (c2 >> np.uint64(33)).astype(np.int32)


_RUNS = "c1 long, c2 int, s int, e int, a int, bucket long, id long"


def _runs(docs: DataFrame, length: int, gram: int, *, of_words: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            spans = _both(data)
            c1, c2 = _content(at, spans)
            t, s, e, a, bucket, u = anchor_runs(*_words(data, at, spans[0]), length, gram) if of_words else anchor_runs(data, at, length, gram, spans)
            if len(t):
                columns = [c1[t], c2[t], *(x.astype(np.int32) for x in (s, e, a)), bucket.astype(np.int64), u.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c1", "c2", "s", "e", "a", "bucket", "id"])

    return docs.select("text").mapInArrow(run, _RUNS)


def _in_shared_buckets(runs: DataFrame) -> DataFrame:
    """Most anchors are alone in their bucket; only the others are looked at any further."""
    runs = stored(runs)
    shared = runs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    return runs.join(shared, "bucket", "left_semi")


def _blocks(open_runs: DataFrame, length: int, size: int, *, of_words: bool = False) -> DataFrame:
    """Split the runs (lists, with the text) into blocks of ``size`` windows, counted from the anchor, so that
    equal places are split alike. A block's bucket is the string that all its windows share, its identifier the
    string that they cover together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in (part for batch in batches for part in _parts(batch)):
            texts = [unpack.decompress(x) for x in b.column(2).to_pylist()]
            at = np.cumsum([0, *map(len, texts)])
            data = np.frombuffer(b"".join(texts), np.uint8)
            if of_words:
                data, at = _words(data, at, Spans(data, 1))
            one, two = _both(data)
            runs = pc.list_flatten(b.column(3))
            s, e, a, w = (pc.struct_field(runs, k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("s", "e", "a", "w"))
            t = np.repeat(np.arange(len(b)), pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False))
            k0, k1 = (a - e) // size, (a - s) // size
            n = k1 - k0 + 1
            i = np.repeat(np.arange(len(s)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - k0, n)
            low, high = a[i] - (k + 1) * size + 1, a[i] - k * size
            bs, be = np.maximum(low, s[i]), np.minimum(high, e[i])
            c1, c2, base = b.column(0).to_numpy()[t[i]], b.column(1).to_numpy()[t[i]], at[t[i]]
            bucket, u = one.of(base + high, base + low + length), two.of(base + bs, base + be + length)
            columns = [c1, c2, *(x.astype(np.int32) for x in (bs, be, a[i])), bucket.astype(np.int64), u.astype(np.int64), w[i].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["c1", "c2", "s", "e", "a", "bucket", "id", "w"])

    return open_runs.select("c1", "c2", "blob", "runs", "size").mapInArrow(run, f"{_RUNS}, w int")


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Cut a batch into ranges of texts of bounded bytes (their last column); a longer text is on its own."""
    number = np.cumsum(batch.column(batch.num_columns - 1).to_numpy()) // (SECTION // 4)
    edge = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else []
    for x, y in zip(edge[:-1], edge[1:]):
        yield batch.slice(int(x), int(y - x))


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, c1, c2, blob, size): the texts, compressed for the way through a shuffle, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, at = text_bytes(b.column(1))
            c1, c2 = _content(at, _both(data))
            view = memoryview(np.ascontiguousarray(data))
            blobs = [pack.compress(view[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c1), pa.array(c2), pa.array(blobs, pa.binary()), pa.array(np.diff(at))], names=["doc_id", "c1", "c2", "blob", "size"])

    return docs.mapInArrow(run, "doc_id long, c1 long, c2 int, blob binary, size long")


_PLACE = ("c1", "c2", "s", "e", "a")


def _any_place() -> list[Column]:
    """One row of a group, whichever comes first."""
    return [F.first(k).alias(k) for k in _PLACE]


def _states(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of equal identifier: how many places there are, and one of them; and those of them that are in open
    buckets, with w = 2 for many places."""
    groups = stored(rows.groupBy("bucket", "id").agg(F.sum("w").alias("n"), *_any_place()))
    buckets = groups.groupBy("bucket").agg(F.sum("n").alias("total"), F.count(F.when(F.col("n") == 1, 1)).alias("single"))
    open_buckets = buckets.filter("total > 1 and single > 0").select("bucket")
    return groups, groups.join(open_buckets, "bucket", "left_semi").select(*_PLACE, F.least(F.col("n"), F.lit(2)).cast("int").alias("w"))


def repeated_windows(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(c1, c2, s, e): runs of window starts, by text content, whose windows of ``length`` bytes also start elsewhere."""
    if levels[-1] != 1 or not 0 < gram <= length:
        raise ValueError("the last level has blocks of one window, and an anchor fits into a window")
    rows = stored(_in_shared_buckets(_runs(docs, length, gram)).withColumn("w", F.lit(1)))
    found, texts = None, None
    for size in (*levels, None):
        groups, still_open = _states(rows)
        many = groups.filter("n > 1").select("bucket", "id")
        sure = rows.filter("w = 1").join(many, ["bucket", "id"], "left_semi").select("c1", "c2", "s", "e").distinct()
        found = stored(sure) if found is None else stored(found.unionByName(sure))
        if size is None:
            break
        runs = stored(still_open.groupBy("c1", "c2").agg(F.collect_list(F.struct("s", "e", "a", "w")).alias("runs")))
        if texts is None:
            texts = _open_texts(docs, runs)
        rows = stored(_blocks(texts.join(runs, ["c1", "c2"]), length, size))
    return found


def _open_texts(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(c1, c2, blob, size): the texts that are still open; of equal ones any will do."""
    packed = _packed(docs.select(F.lit(0).cast("long").alias("doc_id"), "text")).drop("doc_id")
    return stored(packed.join(runs.select("c1", "c2"), ["c1", "c2"], "left_semi").groupBy("c1", "c2").agg(F.first("blob").alias("blob"), F.first("size").alias("size")))


def shared_passages(docs: DataFrame, *, words: int = WORDS, gram: int = WORD_GRAM, levels: tuple[int, ...] = WORD_LEVELS) -> DataFrame:
    """(c1, c2, s, e): runs of word numbers, by text content, where ``words`` words start that another row holds too.

    Repeats within one row do not count; a text that is in the table twice is shared as a whole."""
    if levels[-1] != 1 or not 0 < gram <= words:
        raise ValueError("the last level has blocks of one window, and an anchor fits into a window")
    runs = _in_shared_buckets(_runs(docs, words, gram, of_words=True))
    # equal texts make equal rows; w is 2 for a place that stands for several rows of the table
    rows = stored(runs.groupBy("bucket", "id", *_PLACE).agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("w")))
    found, texts = None, None
    for size in (*levels, None):
        many = (F.max("w") > 1) | (F.min("c1") != F.max("c1")) | (F.min("c2") != F.max("c2"))
        groups = stored(rows.groupBy("bucket", "id").agg(many.alias("many"), *_any_place()))
        own = rows if found is None else rows.filter("w = 1")  # the others were found before, and only stand for their group
        sure = own.join(groups.filter("many").select("bucket", "id"), ["bucket", "id"], "left_semi").select("c1", "c2", "s", "e")
        found = stored(sure if found is None else found.unionByName(sure))
        if size is None:
            break
        buckets = groups.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("many"), 1)).alias("single"))
        still = groups.join(buckets.filter("n > 1 and single > 0").select("bucket"), "bucket", "left_semi")
        alone = own.join(still.filter("not many").select("bucket", "id"), ["bucket", "id"], "left_semi").select(*_PLACE, F.lit(1).alias("w"))
        places = alone.unionByName(still.filter("many").select(*_PLACE, F.lit(2).alias("w")))
        runs = stored(places.groupBy("c1", "c2").agg(F.collect_list(F.struct("s", "e", "a", "w")).alias("runs")))
        if texts is None:
            texts = _open_texts(docs, runs)
        rows = stored(_blocks(texts.join(runs, ["c1", "c2"]), words, size, of_words=True))
    return found


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, levels: tuple[int, ...] = LEVELS, with_text: bool = False, passage_words: int | None = None) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else.

    Strings are judged on the input and never cross texts; overlaps within one text count. Returns one row per input
    row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the removed spans (first byte, byte after the
    last) and the bytes that are kept. A null text is empty; texts shorter than ``length`` lose nothing; a text that is in
    the table twice loses every byte. Repeated rows and null ids are rows like others. No rows in, no rows out.

    With ``passage_words`` there is also n_shared_words: how many of the text's words lie in a string of that many words that
    another row holds too, however few bytes it has. It changes nothing of what is removed.
    """
    batch_rows(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    windows = repeated_windows(plain, length=length, gram=gram, levels=levels)
    lists = stored(windows.groupBy("c1", "c2").agg(F.collect_list("s").alias("s"), F.collect_list("e").alias("e")))
    rows = _packed(plain).join(lists, ["c1", "c2"], "left")
    if passage_words is None:
        rows = rows.withColumns({"ws": F.lit(None).cast("array<int>"), "we": F.lit(None).cast("array<int>")})
    else:
        passages = shared_passages(plain, words=passage_words, gram=min(WORD_GRAM, passage_words))
        rows = rows.join(stored(passages.groupBy("c1", "c2").agg(F.collect_list("s").alias("ws"), F.collect_list("e").alias("we"))), ["c1", "c2"], "left")
    rows = rows.select("doc_id", "blob", "s", "e", "ws", "we")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in made}
            for blob, s, e, ws, we in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                text = unpack.decompress(blob)
                spans = _merged(s, e, length)
                kept, last = [], 0
                for x, y in spans:
                    kept.append(text[last:x])
                    last = y
                rest = b"".join([*kept, text[last:]])
                shared = sum(y - x for x, y in _merged(ws, we, passage_words)) if ws else 0
                values = {"n_bytes": len(text), "n_removed": len(text) - len(rest), "n_spans": len(spans), "kept_sha256": hashlib.sha256(rest).hexdigest(), "n_shared_words": shared, "spans": [list(x) for x in spans], "kept": rest}
                for name, column in out.items():
                    column.append(values[name])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[f.name], f.type) for f in made)], names=["doc_id", *out])

    made = [pa.field("n_bytes", pa.int64()), pa.field("n_removed", pa.int64()), pa.field("n_spans", pa.int64()), pa.field("kept_sha256", pa.string())]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if passage_words is not None:
        made.append(pa.field("n_shared_words", pa.int64()))
        schema += ", n_shared_words long"
    if with_text:
        made += [pa.field("spans", pa.list_(pa.list_(pa.int64()))), pa.field("kept", pa.binary())]
        schema += ", spans array<array<long>>, kept binary"
    return rows.mapInArrow(run, schema)


def _merged(s: list[int] | None, e: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal spans that the windows starting in s .. e cover."""
    if not s:
        return []
    start, end = np.array(s, np.int64), np.array(e, np.int64) + length
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > end[:-1]]
    at = np.flatnonzero(new)
    return list(zip(start[at].tolist(), end[np.r_[at[1:] - 1, len(end) - 1]].tolist()))
