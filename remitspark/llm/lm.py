"""Language-model scores: a hierarchical Pitman-Yor bigram model, its seating sampled by Gibbs, on partitions of contexts.

Each context (the word before) is a restaurant; all of them share one parent, the restaurant of single words, whose base
is uniform over the known words and one unknown. The rows of a shuffle are blobs: the counts that one chunk of
documents adds to one partition of contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Spans, mixed, text_bytes
from .common import batch_rows, stored
from .tokens import split_words

#: The token that ends a text; as a context it also stands before the first word.
END = np.uint64(0x5DEECE66D1234567)
#: Tokens of a chunk.
CHUNK = 3_000_000
#: Discount and strength of the contexts' restaurants and of the parent.
DISCOUNT, STRENGTH = 0.75, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.5, 1.0
BURN_IN, SAMPLES = 3, 3
#: Up to this count a dish's tables are drawn from their exact conditional distribution.
EXACT = 48
#: Words whose share of the tokens is at least 1 / this are counted beforehand; contexts of a share of 1 / 1000 are split.
FREQUENT = 1 << 15
SPLIT = 1000


def pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(a.tobytes() for a in arrays)]))


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        out.append(np.frombuffer(data, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    no_id: np.ndarray
    held: np.ndarray
    size: np.ndarray  # tokens of each text, its end included
    tokens: np.ndarray


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of a batch, and how many each text has."""
    index, dictionary, offsets = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    data, at = text_bytes(dictionary)
    words = Spans(data).of(at[:-1], at[1:]) if len(dictionary) else np.zeros(0, np.uint64)
    real = np.diff(at) > 0
    keep = real[index] if len(index) else np.zeros(0, bool)
    before = np.r_[0, np.cumsum(keep)][offsets - offsets[0]]
    size = np.diff(before) + 1
    out = np.full(int(size.sum()), END, np.uint64)
    place = np.arange(int(before[-1])) + np.repeat(np.arange(len(size)), np.diff(before))
    out[place] = words[index[keep]]
    return out, size


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    """Rows (doc_id, held, text) as chunks of about ``CHUNK`` tokens; a text is never cut."""
    number, held_back, total = TaskContext.get().partitionId() << 24, [], 0
    for b in chain(batches, [None]):
        if b is not None and b.num_rows:
            tokens, size = _tokens(b.column(2))
            ids = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False)
            held_back.append((ids, pc.is_null(b.column(0)).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(bool), size, tokens))
            total += len(tokens)
        if held_back and (b is None or total >= CHUNK):
            yield Chunk(number, *(np.concatenate(x) for x in zip(*held_back)))
            number, held_back, total = number + 1, [], 0


@dataclass
class Plan:
    """What all tasks know: partitions, and of the most frequent words the hashes and shares."""

    parts: int
    word: np.ndarray
    share: np.ndarray
    total: int = 1  # training tokens

    def by_word(self, w: np.ndarray) -> np.ndarray:
        """The partition of words that sums up a word."""
        return (mixed(w ^ np.uint64(11)) % np.uint64(self.parts)).astype(np.int64)

    def splits(self, u: np.ndarray) -> np.ndarray:
        """Over how many partitions a context is spread."""
        if not len(self.word):
            return np.ones(len(u), np.int64)
        at = np.minimum(np.searchsorted(self.word, u), len(self.word) - 1)
        share = np.where(self.word[at] == u, self.share[at], 0.0)
        return np.where(share >= 1 / SPLIT, np.minimum(self.parts, 1 + np.ceil(share * 4 * self.parts)), 1).astype(np.int64)

    def part(self, u: np.ndarray, w: np.ndarray, splits: np.ndarray) -> np.ndarray:
        sub = mixed(w) % splits.astype(np.uint64)
        return ((mixed(u ^ np.uint64(7)) + sub * np.uint64(2654435761)) % np.uint64(self.parts)).astype(np.int64)


def _entries(c: Chunk, plan: Plan, by_doc: bool):
    """The chunk's (context, word[, text]) counts by partition: part, contexts, words, text numbers, counts, train counts."""
    words, number = np.unique(c.tokens, return_inverse=True)
    last = np.cumsum(c.size)
    before = np.empty_like(number)
    before[1:] = number[:-1]
    before[np.r_[0, last[:-1]]] = np.searchsorted(words, END)
    splits = plan.splits(words)
    part = plan.part(words[before], words[number], splits[before])
    doc = np.repeat(np.arange(len(c.size)), c.size)
    key = (part << 48) | (before << 24) | number
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if by_doc:
        new[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(new)
    count = np.diff(np.r_[at, len(key)])
    train = np.add.reduceat((~c.held[doc]).astype(np.int64), at)
    k = key[at]
    part = k >> 48
    edge = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        u_number, w_number = (k[x:y] >> 24) & 0xFFFFFF, k[x:y] & 0xFFFFFF
        uu, ui = np.unique(u_number, return_counts=True)
        wu, wi = np.unique(w_number, return_inverse=True)
        yield int(part[x]), words[uu], ui, words[wu], wi, doc[at[x:y]], count[x:y], train[x:y]


def _small(x: np.ndarray) -> np.ndarray:
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], names=list(columns))


def _blob_rows(plan, by_doc: bool, words_only: bool = False):
    """Chunks as rows (part, kind 0, chunk, blob); the chunk's first blob also carries its texts' ids. ``words_only``: words and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches):
            meta = [c.ids, c.no_id, c.held, c.size] if by_doc else []
            for part, u, u_n, w, w_i, doc, count, train in _entries(c, plan.value, by_doc):
                if by_doc:
                    blob = pack(u, _small(u_n), w, _small(w_i), _small(doc), _small(count), c.held.astype(np.uint8), *meta)
                elif words_only:
                    blob = pack(w, _small(np.bincount(w_i, weights=train, minlength=len(w)).astype(np.int64)))
                else:
                    blob = pack(u, _small(u_n), w, _small(w_i), _small(train))
                meta = []
                yield _rows({"part": ([part], pa.int64()), "kind": ([0], pa.int32()), "source": ([c.number], pa.int64()), "blob": ([blob], pa.binary())})

    return run


_BLOBS = "part long, kind int, source long, blob binary"


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, as (key, rows)."""
    key, rows = None, []
    for b in batches:
        columns = [c.to_pylist() for c in b.columns]
        for row in zip(*columns):
            if row[0] != key and rows:
                yield key, rows
                rows = []
            key = row[0]
            rows.append(row[1:])
        columns = None
    if rows:
        yield key, rows


def _gathered(rows: DataFrame, parts: int, key: str) -> DataFrame:
    return rows.repartition(parts, key).sortWithinPartitions(key)


_stirling: dict[float, np.ndarray] = {}


def _log_stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers up to EXACT: ways to seat c customers at t tables."""
    if discount not in _stirling:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[0, 0] = 0.0
        for c in range(1, EXACT + 1):
            t = np.arange(1, c + 1)
            with np.errstate(divide="ignore"):
                out[c, 1 : c + 1] = np.logaddexp(out[c - 1, 0:c], out[c - 1, 1 : c + 1] + np.log(np.maximum(c - 1 - discount * t, 1e-300)))
        _stirling[discount] = out
    return _stirling[discount]


def seat(c: np.ndarray, prior: np.ndarray, group: np.ndarray, groups: int, scale: np.ndarray, discount: float, strength: float, rng) -> Iterator[np.ndarray]:
    """Gibbs sweeps over the tables of each dish; yields ``SAMPLES`` states after the burn-in.

    c customers of a dish sit at t tables; t is drawn given the tables of the restaurant's other dishes and the parent's
    probability of the dish, from its exact conditional S(c, t) prod(strength + discount (T + k)) prior^t. Of a
    dish of more than EXACT customers the first are drawn so, the others are seated one after another, in blocks that grow
    by a tenth, each at a new table with the restaurant's probability. ``scale`` is for restaurants that are split by dish.
    """
    t = np.ones(len(c), np.int64)
    log_prior = np.log(prior)
    many = np.flatnonzero(c > 1)
    head = np.minimum(c, EXACT)
    by = [many[head[many] == k] for k in range(2, EXACT + 1)]
    table = _log_stirling(discount)
    for sweep in range(BURN_IN + SAMPLES):
        total = np.bincount(group, weights=t, minlength=groups) * scale
        for k, rows in enumerate(by, 2):
            for i in range(0, len(rows), 1 + 400_000 // k):
                r = rows[i : i + 1 + 400_000 // k]
                others = np.maximum(total[group[r]] - t[r], 0.0)
                weight = np.cumsum(np.log(strength + discount * (others[:, None] + np.arange(k))) + log_prior[r][:, None], axis=1) + table[k, 1 : k + 1]
                weight = np.cumsum(np.exp(weight - weight.max(axis=1)[:, None]), axis=1)
                t[r] = 1 + (weight < (rng.random(len(r)) * weight[:, -1])[:, None]).sum(axis=1).clip(max=k - 1)
        rows, at = np.flatnonzero(c > EXACT), float(EXACT)
        others = total[group[rows]]
        while len(rows):
            step = np.minimum(np.ceil(at * 0.1), c[rows] - at)
            new = (strength + discount * np.maximum(others, t[rows])) * prior[rows]
            t[rows] += rng.binomial(step.astype(np.int64), new / (new + np.maximum(at - discount * t[rows], 1e-9)))
            at += np.ceil(at * 0.1)
            more = c[rows] > at
            rows, others = rows[more], others[more]
        if sweep >= BURN_IN:
            yield t.copy()


@dataclass
class Part:
    """A partition's training counts by (context, word), and the sampled tables."""

    u: np.ndarray  # contexts, sorted
    w: np.ndarray  # words, sorted; of all texts
    pair_u: np.ndarray
    pair_w: np.ndarray
    count: np.ndarray
    tables: list[np.ndarray]


def _part(u: np.ndarray, w: np.ndarray, train: np.ndarray, told: np.ndarray, plan: Plan, part: int) -> tuple[Part, np.ndarray]:
    """The restaurants of a partition, and the pair of each entry. The draws depend on the counts only, so that the
    partition can be seated again with the same result. ``told``: the words' counts in all training texts, in the order of the requests;
    a word's prior is its share of the training tokens."""
    us, ui = np.unique(u, return_inverse=True)
    ws, wi = np.unique(w, return_inverse=True)
    key = ui * np.int64(len(ws)) + wi
    del ui, wi
    pairs, at = np.unique(key, return_inverse=True)
    del key
    count = np.bincount(at, weights=train, minlength=len(pairs)).astype(np.int64)
    pair_u, pair_w = pairs // max(len(ws), 1), pairs % max(len(ws), 1)
    known = np.flatnonzero(count)
    tables = []
    assert len(told) == len(ws), "answers do not fit the requests"
    prior = np.empty(len(ws))
    prior[np.argsort(plan.by_word(ws), kind="stable")] = told / max(plan.total, 1)
    rng = np.random.default_rng([17, part])
    # only pairs that training texts have take part in the seating, in the order of context and word
    for t in seat(count[known], prior[pair_w[known]], pair_u[known], len(us), plan.splits(us).astype(float), DISCOUNT, STRENGTH, rng):
        full = np.zeros(len(pairs), np.int64)
        full[known] = t
        tables.append(full)
    return Part(us, ws, pair_u, pair_w, count, tables), at


def _asked(plan_b):
    """Each partition's words and their counts, by the partition of words that sums them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = plan_b.value
        for part, rows in _by_key(batches):
            blobs = [unpack(r[2]) for r in rows]
            words, at = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
            count = np.bincount(at, weights=np.concatenate([b[1] for b in blobs]), minlength=len(words)).astype(np.int64)
            to_part = plan.by_word(words)
            for to in np.unique(to_part).tolist():
                own = to_part == to
                yield _rows({"part": ([to], pa.int64()), "kind": ([1], pa.int32()), "source": ([part], pa.int64()), "blob": ([pack(words[own], _small(count[own]))], pa.binary())})

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words' counts in all training texts, to every partition that asked, in its order."""
    for part, rows in _by_key(batches):
        blobs = [unpack(r[2]) for r in rows]
        words, at = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
        count = np.bincount(at, weights=np.concatenate([b[1] for b in blobs]), minlength=len(words)).astype(np.int64)
        edge = np.cumsum([0, *(len(b[0]) for b in blobs)])
        for i, r in enumerate(rows):
            blob = pack(_small(count[at[edge[i] : edge[i + 1]]]))
            yield _rows({"part": ([r[1]], pa.int64()), "kind": ([1], pa.int32()), "source": ([part], pa.int64()), "blob": ([blob], pa.binary())})


def _requests(plan_b):
    """Each partition's word counts and tables, by the partition of words that sums them up; and of split contexts the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = plan_b.value
        for part, rows in _by_key(batches):
            blobs = [unpack(r[2]) for r in rows if r[0] == 0]
            told = np.concatenate([unpack(r[2])[0] for r in sorted((r for r in rows if r[0] == 1), key=lambda r: r[1])])
            u = np.concatenate([np.repeat(b[0], b[1]) for b in blobs])
            w = np.concatenate([b[2][b[3]] for b in blobs])
            p, _ = _part(u, w, np.concatenate([b[4] for b in blobs]), told, plan, part)
            n = len(p.w)
            sums = [np.bincount(p.pair_w, weights=x, minlength=n).astype(np.int64) for x in (p.count, *p.tables)]
            at = plan.by_word(p.w)
            for to in np.unique(at).tolist():
                own = at == to
                yield _rows({"part": ([to], pa.int64()), "kind": ([1], pa.int32()), "source": ([part], pa.int64()), "blob": ([pack(p.w[own], *(_small(x[own]) for x in sums))], pa.binary())})
            hot = np.flatnonzero(plan.splits(p.u) > 1)
            if len(hot):
                sums = [np.bincount(p.pair_u, weights=x, minlength=len(p.u)).astype(np.int64)[hot] for x in (p.count, *p.tables)]
                yield _rows({"part": ([plan.parts], pa.int64()), "kind": ([2], pa.int32()), "source": ([part], pa.int64()), "blob": ([pack(p.u[hot], *sums)], pa.binary())})

    return run


def _answers(plan_b):
    """Sum up the words' counts; seat the parent's customers (the tables of the contexts); answer every partition in its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = plan_b.value
        for part, rows in _by_key(batches):
            blobs = [unpack(r[2]) for r in rows]
            words, at = np.unique(np.concatenate([b[0] for b in blobs]), return_inverse=True)
            sums = [np.bincount(at, weights=np.concatenate([b[i] for b in blobs]), minlength=len(words)).astype(np.int64) for i in range(1, 2 + SAMPLES)]
            if part == plan.parts:
                yield _rows({"part": ([-1], pa.int64()), "kind": ([2], pa.int32()), "source": ([part], pa.int64()), "blob": ([pack(words, *sums)], pa.binary()), "sums": ([[]], pa.list_(pa.int64()))})
                continue
            known = np.flatnonzero(sums[0])
            parent = []
            for s in range(SAMPLES):
                tables = np.zeros(len(words), np.int64)
                rng = np.random.default_rng([23, part, s])
                # the base is uniform and one word in parts is here, so the parent's tables are as many times those here
                base = np.full(len(known), 1.0 / max(len(known) * plan.parts + 1, 2))
                for t in seat(sums[1 + s][known], base, np.zeros(len(known), np.int64), 1, np.array([float(plan.parts)]), PARENT_DISCOUNT, PARENT_STRENGTH, rng):
                    tables[known] = t
                parent.append(tables)
            totals = [int(sums[0].sum()), len(known), *(int(x.sum()) for x in (*sums[1:], *parent))]
            edge = np.cumsum([0, *(len(b[0]) for b in blobs)])
            for i, r in enumerate(rows):
                own = at[edge[i] : edge[i + 1]]
                blob = pack(*(_small(x[own]) for x in (*sums, *parent)))
                yield _rows({"part": ([r[1]], pa.int64()), "kind": ([1], pa.int32()), "source": ([part], pa.int64()), "blob": ([blob], pa.binary()), "sums": ([totals if i == 0 else []], pa.list_(pa.int64()))})

    return run


def _scores(plan_b, totals: list[int], hot: list[np.ndarray]):
    """Log probabilities of each chunk's texts, as far as their pairs are in this partition."""
    tokens, known_words = totals[0], totals[1]
    customers, parent_tables = totals[2 : 2 + SAMPLES], totals[2 + SAMPLES :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Plan = plan_b.value
        for part, rows in _by_key(batches):
            chunks, entries = [], [[], [], [], []]
            for kind, number, blob in rows:
                if kind == 0:
                    u, u_n, w, w_i, doc, n, held, *meta = unpack(blob)
                    for column, x in zip(entries, (np.repeat(u, u_n), w[w_i], n.astype(np.int32), (n * (1 - held[doc])).astype(np.int32))):
                        column.append(x)
                    chunks.append((number, doc.copy(), len(held), [x.copy() for x in meta]))
            replies = sorted(((r[1], unpack(r[2])) for r in rows if r[0] == 1), key=lambda x: x[0])
            rows.clear()
            u, w, count, train = (np.concatenate(column) for column in entries)
            entries.clear()
            got = [np.concatenate([b[i] for _, b in replies]).astype(np.int64) for i in range(1 + 2 * SAMPLES)]
            p, at = _part(u, w, train, got[0], plan, part)
            del u, w, train
            order = np.argsort(plan.by_word(p.w), kind="stable")  # the order of the requests
            info = [np.empty(len(order), np.int64) for _ in got]
            for x, y in zip(info, got):
                x[order] = y
            c_word = info[0]
            base = np.log10((c_word + 0.5) / (tokens + 0.5 * (known_words + 1)))
            c_u = np.bincount(p.pair_u, weights=p.count, minlength=len(p.u))
            hot_at = np.searchsorted(p.u, hot[0]) if len(hot[0]) else np.zeros(0, np.int64)
            here = [i for i, x in enumerate(hot_at) if x < len(p.u) and p.u[x] == hot[0][i]]
            c_u[hot_at[here]] = hot[1][here]
            mean = np.zeros(len(p.count))
            for s in range(SAMPLES):
                k, t = info[1 + s], info[1 + SAMPLES + s]
                single = (k - PARENT_DISCOUNT * t + (PARENT_STRENGTH + PARENT_DISCOUNT * parent_tables[s]) / (known_words + 1)) / (PARENT_STRENGTH + customers[s])
                t_u = np.bincount(p.pair_u, weights=p.tables[s], minlength=len(p.u))
                t_u[hot_at[here]] = hot[2 + s][here]
                rest = STRENGTH + DISCOUNT * t_u[p.pair_u]
                mean += (p.count - DISCOUNT * p.tables[s] + rest * single[p.pair_w]) / (STRENGTH + c_u[p.pair_u])
            value = np.log10(mean / SAMPLES)
            entry_score, entry_word = value[at] * count, p.pair_w[at]
            lo = 0
            for number, doc, n, meta in chunks:
                hi = lo + len(doc)
                sums = [np.bincount(doc, weights=x, minlength=n) for x in (entry_score[lo:hi], base[entry_word[lo:hi]] * count[lo:hi])]
                seen = np.bincount(doc, weights=(c_word[entry_word[lo:hi]] > 0) * count[lo:hi], minlength=n)
                # a chunk's texts that have nothing here are left out
                some = np.flatnonzero(np.bincount(doc, minlength=n))
                blob = pack(_small(some), sums[0][some], sums[1][some], _small(seen[some].astype(np.int64)), *meta)
                yield _rows({"chunk": ([number], pa.int64()), "blob": ([blob], pa.binary())})
                lo = hi

    return run


def _sums(tokens: int):
    """Add up a chunk's partial sums: one row for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_key(batches):
            blobs = [unpack(r[0]) for r in rows]
            ids, no_id, held, size = next(b[4:] for b in blobs if len(b) > 4)
            out = np.zeros((3, len(ids)))
            for b in blobs:
                for i in range(3):
                    out[i][b[0]] += b[1 + i]
            columns = [pa.array(ids, mask=no_id), pa.array(held), pa.array(size), pa.array(out[2].astype(np.int64)), pa.array(np.full(len(ids), tokens)), pa.array(out[1]), pa.array(out[0])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training tokens of a task, and the words that are a share of 1 / FREQUENT of them (hash, count)."""
    for c in _chunks(batches):
        words, n = np.unique(c.tokens[np.repeat(~c.held, c.size)], return_counts=True)
        total = int(n.sum())
        keep = n * FREQUENT >= total
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[0, words[keep].view(np.int64)]), pa.array(np.r_[0, n[keep]]), pa.array(np.r_[total, np.zeros(int(keep.sum()), np.int64)])], names=["word", "n", "total"])


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held_out=None, part_tokens: int = 1_600_000, least_parts: int = 40) -> DataFrame:
    """Log10 probabilities of all texts under a model learned from those that are not held out.

    A text's tokens are its words (runs without white space, A-Z folded) and one end. 1. The most frequent words are
    counted (at most ``FREQUENT``), to split contexts. 2. Each partition of contexts is told its words' counts in all training
    texts, their priors. The training counts go, chunk by chunk, to partitions of contexts; a context of a
    thousandth of all tokens is spread by the next word. Each partition seats its customers. 3. Partitions of words sum up
    counts and tables and seat the parent's customers. 4. All texts' pairs go to the partitions of contexts, which
    seat the same counts in the same way again and score them with probabilities averaged over the samples. Partitions
    grow with the input; the driver sees the frequent words, the split contexts and a few sums.

    ``held_out`` is a boolean column (default: crc32 of the id as text, modulo 5, is 1; null ids are not held out).
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-half unigram), score. Null and empty
    texts have one token, the end. Repeated rows are scored each. Without training texts all words are unknown. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    if held_out is None:
        held_out = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 1
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    counts = stored(plain.mapInArrow(_frequent, "word long, n long, total long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
    total = counts.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    frequent = counts.filter(F.col("n") * FREQUENT >= F.lit(max(total, 1))).select("word", "n").collect()
    words = np.array([r["word"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(words)
    share = np.array([r["n"] for r in frequent], float)[order] / max(total, 1)
    parts = min(30_000, max(least_parts, total // part_tokens))  # a partition's number has 15 bits in the keys
    plan = spark.sparkContext.broadcast(Plan(parts, words[order], share, int(total)))

    asked = _gathered(plain.mapInArrow(_blob_rows(plan, False, words_only=True), _BLOBS), parts, "part").mapInArrow(_asked(plan), _BLOBS)
    told = stored(_gathered(asked, parts, "part").mapInArrow(_told, _BLOBS))
    pairs = _gathered(plain.mapInArrow(_blob_rows(plan, False), _BLOBS).unionByName(told), parts, "part")
    requests = _gathered(pairs.mapInArrow(_requests(plan), _BLOBS), parts, "part")
    answers = stored(requests.mapInArrow(_answers(plan), _BLOBS + ", sums array<long>"))
    sizes = 2 + 2 * SAMPLES
    totals = answers.filter(F.size("sums") > 0).agg(*[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)).alias(f"s{i}") for i in range(sizes)]).first()
    split = answers.filter("kind = 2").select("blob").first()
    hot = unpack(split[0]) if split else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * (1 + SAMPLES)

    everything = plain.mapInArrow(_blob_rows(plan, True), _BLOBS).unionByName(answers.filter("kind = 1").select("part", "kind", "source", "blob"))
    partial = _gathered(everything, parts, "part").mapInArrow(_scores(plan, list(totals), hot), "chunk long, blob binary")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return _gathered(partial, parts, "chunk").mapInArrow(_sums(int(totals[0])), schema)
