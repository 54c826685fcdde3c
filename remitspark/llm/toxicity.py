"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is (noisy-or)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import FOLD, LETTER, Spans, find_words, mixed, text_bytes
from .common import batch_rows, stored

#: Word features, of whole words and of their first bytes: hashes modulo this.
FEATURES = 1 << 22
PREFIXES = (4, 5, 6)
#: A feature needs so many toxic training documents to get a weight.
LEAST = 2
#: About how many labelled documents the classifier is fitted on, drawn by a hash of the id; all, if there are fewer.
TRAIN_ROWS = 20_000
TRAIN_PARTS = 12
STEPS = 48
#: Documents that a feature is taken to have been seen in without effect.
PRIOR = 8
#: Clean sentences of any number may add this much to a document's hazard; no more than ``MOST_LEVEL`` is taken off a sentence's
#: own, so one that is likelier toxic than not always counts.
CLEAN_HAZARD, MOST_LEVEL = 0.05, float(np.log(2.0))
#: Edges of the histogram of clean sentences' hazards.
EDGES = np.r_[0.0, np.geomspace(1e-7, MOST_LEVEL, 400)]
#: What ends a sentence.
ENDS = np.zeros(256, dtype=bool)
ENDS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Sentences:
    """Sentences of a batch: the text each belongs to, its bytes, and its distinct word features one after another."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    feature: np.ndarray
    sentence: np.ndarray  # of each feature


def sentences(texts: pa.Array) -> Sentences:
    data, at = text_bytes(texts)
    n = len(at) - 1
    data = FOLD[data]
    stop = np.flatnonzero(ENDS[data]) + 1
    edges = np.unique(np.concatenate([at, stop]))
    start, end = edges[:-1], edges[1:]
    doc = np.searchsorted(at, start, side="right") - 1
    empty = np.flatnonzero(at[:-1] == at[1:])  # an empty text is one empty sentence
    start, end, doc = (np.concatenate([a, b]) for a, b in ((start, at[:-1][empty]), (end, at[:-1][empty]), (doc, empty)))
    order = np.lexsort((start, doc))
    start, end, doc = start[order], end[order], doc[order]
    words = find_words(data, at, LETTER)
    spans = Spans(data)
    real = np.flatnonzero(end > start)
    where = real[np.searchsorted(start[real], words.start, side="right") - 1] if len(words.start) else np.zeros(0, np.int64)
    keys = []
    for n_bytes in (0, *PREFIXES):
        long = np.flatnonzero(words.end - words.start > n_bytes)
        # the number of bytes is part of a prefix's hash, and a word's is told apart from it
        h = spans.of(words.start[long], words.start[long] + n_bytes if n_bytes else words.end) + np.uint64(n_bytes)
        keys.append(where[long] * FEATURES + (mixed(h) % np.uint64(FEATURES)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    assert n == 0 or doc[-1] == n - 1
    return Sentences(doc, start, end, key % FEATURES, key // FEATURES)


def _logits(s_feature: np.ndarray, s_sentence: np.ndarray, n: int, weight: np.ndarray, bias: float) -> np.ndarray:
    return bias + np.bincount(s_sentence, weights=weight[s_feature], minlength=n)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _training(rows: DataFrame) -> DataFrame:
    """(label, text) as (label, sentences, features): numbers as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            s = sentences(b.column(1))
            per_doc = np.searchsorted(s.doc, np.arange(b.num_rows + 1))
            per_feature = np.searchsorted(s.sentence, per_doc)
            out = ([], [])
            for i in range(b.num_rows):
                f = slice(per_feature[i], per_feature[i + 1])
                out[0].append((s.sentence[f] - per_doc[i]).astype(np.int32).tobytes())
                out[1].append(s.feature[f].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(per_doc).astype(np.int32)), pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary())],
                names=["label", "n", "sentence", "feature"],
            )

    return rows.mapInArrow(run, "label int, n int, sentence binary, feature binary")


def _toxic_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic documents of a partition hold each feature."""
    found = [np.unique(np.frombuffer(f, np.int32)) for b in batches for label, f in zip(b.column(0).to_pylist(), b.column(3).to_pylist()) if label]
    at, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([at.tobytes()], pa.binary()), pa.array([n.astype(np.int32).tobytes()], pa.binary())], names=["at", "n"])


def _chosen_only(chosen):
    """Features as positions among the chosen ones; all others leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = chosen.value
        for b in batches:
            out = ([], [])
            for sentence, feature in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                s, f = np.frombuffer(sentence, np.int32), np.frombuffer(feature, np.int32)
                at = np.minimum(np.searchsorted(features, f), len(features) - 1)
                hit = features[at] == f
                out[0].append(s[hit].tobytes())
                out[1].append(at[hit].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in out)], names=["label", "n", "sentence", "feature"])

    return run


def _label_counts(size: int):
    """Documents of each label, and how many of each hold each chosen feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, held = np.zeros(2, np.int64), np.zeros((2, size), np.int32)
        for b in batches:
            for label, feature in zip(b.column(0).to_pylist(), b.column(3).to_pylist()):
                docs[label] += 1
                held[label, np.unique(np.frombuffer(feature, np.int32))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([docs.tobytes()], pa.binary()), pa.array([held.tobytes()], pa.binary())], names=["docs", "held"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


@dataclass
class Model:
    feature: np.ndarray  # sorted
    weight: np.ndarray
    bias: float
    #: What is taken off each sentence's hazard: ``level[i]`` in documents of up to ``reach[i]`` sentences.
    level: np.ndarray = field(default_factory=lambda: np.zeros(1))
    reach: np.ndarray = field(default_factory=lambda: np.full(1, np.inf))

    def dense(self) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        out = np.zeros(FEATURES, dtype=np.float32)
        out[self.feature] = self.weight
        return out, self.bias, self.level, self.reach


def _noisy_or(s: Sentences, n: int, weight: np.ndarray, bias: float, level: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Each document's score: the noisy-or of what its sentences have above the level of its number of sentences."""
    hazard = _softplus(_logits(s.feature, s.sentence, len(s.doc), weight, bias))
    off = level[np.minimum(np.searchsorted(reach, np.bincount(s.doc, minlength=n)), len(level) - 1)]
    return -np.expm1(-np.bincount(s.doc, weights=np.maximum(hazard - off[s.doc], 0.0), minlength=n))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = TRAIN_ROWS, steps: int = STEPS, rate: float = 3.0, l2: float = 0.05) -> Model:
    """Fit on documents with a label of 0 or 1 (the larger, if several).

    Features are those of at least ``LEAST`` toxic documents; their weights start at the smoothed log odds of their documents
    and then follow the gradient of the noisy-or's likelihood, 1 - prod(1 - p(sentence)) for a toxic document. Each
    step sums the gradient over the stored training rows on the executors; the driver holds one number for each
    feature. A last pass takes the hazards, -log(1 - p), of the clean documents' sentences, from which follows what is
    taken off each sentence's in long documents, so that their length alone does not make them toxic. About ``rows`` labels are drawn and broadcast. Without toxic or without clean documents the
    score is the same for every sentence.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003))
    sample = known.filter(draw < F.lit(int(1_000_003 * min(1.0, rows / max(total, 1)))))
    sample = sample.withColumnRenamed("doc_id", "label_id")
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("label", "text")
    data = stored(_training(joined)).coalesce(TRAIN_PARTS)
    counts = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in data.mapInArrow(_toxic_counts, "at binary, n binary").toLocalIterator()]
    dense = np.zeros(FEATURES, np.int32)
    for at, n in counts:
        dense[at] += n
    features = np.flatnonzero(dense >= LEAST).astype(np.int32)
    if not len(features):
        return Model(features, np.zeros(0), -3.0)
    chosen = spark.sparkContext.broadcast(features)
    data = stored(data.mapInArrow(_chosen_only(chosen), "label int, n int, sentence binary, feature binary")).coalesce(TRAIN_PARTS)
    n_docs, held = np.zeros(2), np.zeros((2, len(features)))
    for r in data.mapInArrow(_label_counts(len(features)), "docs binary, held binary").toLocalIterator():
        n_docs += np.frombuffer(r["docs"], np.int64)
        held += np.frombuffer(r["held"], np.int32).reshape(2, -1)
    if not n_docs.all():
        return Model(features, np.zeros(len(features)), 3.0 if n_docs[1] else -3.0)
    share = n_docs[1] / n_docs.sum()
    weight = np.log((held[1] + 4 * share) / (held[0] + 4 * (1 - share)) * (1 - share) / share)
    weight, bias = np.where(weight > 1.0, weight, 0.0), -6.0
    # a feature moves by its gradient over the documents that hold it: rare ones move little, whatever the sample's size
    weigh = np.r_[held.sum(axis=0), n_docs.sum()] + PRIOR
    for _ in range(steps):
        model = spark.sparkContext.broadcast((weight, bias))
        grad = np.zeros(len(features) + 1)
        for r in data.mapInArrow(_gradient(model), "g binary").toLocalIterator(prefetchPartitions=True):
            grad += np.frombuffer(r["g"], np.float64)
        model.unpersist()
        move = rate * (grad - l2 * np.r_[weight, 0.0]) / weigh
        weight, bias = weight + move[:-1], bias + move[-1]
    model = spark.sparkContext.broadcast((weight, bias))
    found = np.zeros((2, len(EDGES)))
    for r in data.mapInArrow(_clean_hazards(model), "h binary").toLocalIterator():
        found += np.frombuffer(r["h"], np.float64).reshape(2, -1)
    model.unpersist()
    return Model(features, weight, float(bias), *_levels(*found))


def _clean_hazards(model):
    """Of a partition's clean documents: how many sentences have a hazard from each edge to the next, and the sums of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        out = np.zeros((2, len(EDGES)))
        for b in batches:
            for label, n, sentence, feature in zip(*(c.to_pylist() for c in b.columns)):
                if label == 0:
                    hazard = _softplus(_logits(np.frombuffer(feature, np.int32), np.frombuffer(sentence, np.int32), n, weight, bias))
                    at = np.searchsorted(EDGES, hazard, side="right") - 1
                    out += [np.bincount(at, minlength=len(EDGES)), np.bincount(at, weights=hazard, minlength=len(EDGES))]
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["h"])

    return run


def _levels(count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels, and up to how many clean sentences have no more than ``CLEAN_HAZARD`` above each in all. Short documents have
    level 0: all of their sentences' hazards count."""
    above = np.cumsum(total[::-1])[::-1] - EDGES * np.cumsum(count[::-1])[::-1]
    with np.errstate(divide="ignore"):
        reach = np.where(above > 0, CLEAN_HAZARD * count.sum() / np.maximum(above, 1e-300), np.inf)
    return EDGES, np.maximum.accumulate(reach)


def _gradient(model):
    """The log likelihood's gradient, summed over a partition; the bias is the last number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = model.value
        grad = np.zeros(len(weight) + 1)
        for b in batches:
            if not b.num_rows:
                continue
            label, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            own = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            f = np.concatenate([np.frombuffer(x, np.int32) for x in b.column(3).to_pylist()])
            s = np.concatenate(own) + np.repeat(np.cumsum(n) - n, [len(x) for x in own])
            doc = np.repeat(np.arange(b.num_rows), n)
            z = _logits(f, s, len(doc), weight, bias)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            clean = np.exp(-np.bincount(doc, weights=_softplus(z), minlength=b.num_rows))
            g = p * np.where(label == 1, clean / np.maximum(1 - clean, 1e-6), -1.0)[doc]
            grad[:-1] += np.bincount(f, weights=g[s], minlength=len(weight))
            grad[-1] += g.sum()
        yield pa.RecordBatch.from_arrays([pa.array([grad.tobytes()], pa.binary())], names=["g"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row; only the text is read for the score.

    Null and empty texts are one empty sentence: the bias alone. Repeated rows get equal scores. No rows in, no rows out.
    """
    spark = docs.sparkSession
    batch_rows(spark)
    shared = spark.sparkContext.broadcast(model.dense())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = _noisy_or(sentences(b.column(1)), b.num_rows, *shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(out, 0.0, 1.0))], names=["doc_id", "score"])

    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def offending(docs: DataFrame, model: Model, *, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sentences whose own probability reaches the threshold: doc_id, sentence (from 0), start and end byte, score, text."""
    batch_rows(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.dense())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias, *_ = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            s = sentences(b.column(1))
            data, at = text_bytes(b.column(1))
            p = 1 / (1 + np.exp(-_logits(s.feature, s.sentence, len(s.doc), weight, bias)))
            hit = np.flatnonzero(p >= threshold)
            first = np.searchsorted(s.doc, s.doc[hit])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(s.doc[hit])), pa.array((hit - first).astype(np.int32)), pa.array(s.start[hit] - at[s.doc[hit]]), pa.array(s.end[hit] - at[s.doc[hit]]), pa.array(p[hit]),
                 pa.array([bytes(data[a:e]).decode("utf-8", "replace") for a, e in zip(s.start[hit], s.end[hit])], pa.string())],
                names=["doc_id", "sentence", "start", "end", "score", "text"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, sentence int, start long, end long, score double, text string"
    )


def train_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(~held_out())


def toxic_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted without the labels of held-out rows, then every row scored.

    A null doc_id is not held out. See ``fit`` and ``score``.
    """
    model = fit(docs, train_labels(labels), **options)
    return score(docs, model).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` below the threshold, with all their columns; the decision is made on the row's own text.

    The text is the column ``text``. Null and empty texts are one empty sentence, clean under any fitted bias; equal texts are kept or go
    together, repeated rows too; null ids are rows like others. Without labels nothing goes; an empty table gives no rows.
    """
    model = fit(docs, train_labels(labels), **options)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.dense())
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = _noisy_or(sentences(b.column(at)), b.num_rows, *shared.value)
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(run, docs.schema)
