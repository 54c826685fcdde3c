import numpy as np
import pyarrow as pa

from remitspark.llm import toxicity


def planted(n=400):
    rng = np.random.default_rng(6)
    clean = [f"word{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(clean, 7)) for _ in range(int(rng.integers(1, 9)))]
        toxic = int(i % 4 == 0)
        if toxic:
            k = int(rng.integers(len(sentences)))
            sentences[k] += " " + " ".join(rng.choice(["vile", "awful", "nasty"], 2))
        rows.append((i, ". ".join(sentences) + ".", "s"))
        labels.append((i, 1, toxic))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_sentences_and_features():
    s = toxicity.sentences(pa.array(["One two. Two one!\nx", "", None, "no end"]))
    assert s.doc.tolist() == [0, 0, 0, 0, 1, 2, 3]
    first, second = (set(s.feature[s.sentence == i].tolist()) for i in (0, 1))
    assert first == second and len(first) == 2


def test_held_out_documents_and_the_sentence(spark, make):
    rows, labels = planted()
    docs, labels_df = make(rows), spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], LABELS)
    out = toxicity.toxic_rows(docs, labels_df).collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(rows) and 0 < len(held) < len(rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_sentences_are_located(spark, make):
    """Of documents that are labelled toxic, the sentence with the toxic words; its bytes and number are those of the text."""
    rows, labels = planted()
    docs, labels_df = make(rows), spark.createDataFrame(labels, LABELS)
    model = toxicity.fit(docs, labels_df)
    spans = toxicity.offending(docs, model).collect()
    bad = ("vile", "awful", "nasty")
    truth, text = {i for i, _, t in labels if t}, {i: t for i, t, _ in rows}
    hit = [r for r in spans if any(w in r["text"] for w in bad)]
    assert len(hit) >= 0.95 * len(spans) and len({r["doc_id"] for r in hit}) >= 0.9 * len(truth)
    assert all(r["doc_id"] in truth for r in hit)
    for r in spans:
        assert text[r["doc_id"]].encode()[r["start"] : r["end"]].decode() == r["text"]
        assert text[r["doc_id"]].encode()[: r["start"]].count(b".") == r["sentence"]


def test_noisy_or_as_written_out(make, rows):
    """Without levels a score is one minus the product of the sentences' own chances of being clean."""
    texts = [r for r in rows if len(r[1] or "") < 5000] + [(50, "Vile. Vile awful! clean words here? nasty\nend", "s")]
    batch = toxicity.sentences(pa.array([t for _, t, _ in texts]))
    feature = np.unique(batch.feature)
    model = toxicity.Model(feature.astype(np.int32), np.random.default_rng(3).normal(0, 1, len(feature)), -1.5)
    weight = dict(zip(feature.tolist(), model.weight))
    want = []
    for k, (i, _, _) in enumerate(texts):
        clean = 1.0
        for s in np.flatnonzero(batch.doc == k):
            z = model.bias + sum(weight[f] for f in batch.feature[batch.sentence == s].tolist())
            clean *= 1 - 1 / (1 + np.exp(-z))
        want.append((i, 1 - clean))
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(make(texts), model).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert np.allclose([v for _, v in sorted(got, key=key)], [v for _, v in sorted(want, key=key)], atol=1e-9)


def test_labels_of_held_out_rows_do_not_matter(spark, make):
    rows, labels = planted(200)
    docs = make(rows)
    changed = spark.createDataFrame(labels, LABELS).withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxic_rows(docs, x).collect()} for x in (spark.createDataFrame(labels, LABELS), changed))
    assert a == b


def test_messy_rows_no_labels_and_empty_table(spark, make, messy, rows):
    none = spark.createDataFrame([], LABELS)
    out = toxicity.toxic_rows(messy, none).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    kept = toxicity.drop_toxic(messy, none)
    assert kept.columns == messy.columns
    assert toxicity.toxic_rows(make([]), none).count() == 0
    assert toxicity.drop_toxic(make([]), none).count() == 0


def test_length_alone_is_not_toxic(spark, make):
    rows, labels = planted()
    model = toxicity.fit(make(rows), spark.createDataFrame(labels, LABELS))
    rng = np.random.default_rng(8)
    long = {n: ". ".join(" ".join(f"word{k}" for k in rng.integers(0, 80, 7)) for _ in range(n)) + "." for n in (1, 200, 20_000)}
    docs = make([(n, t, "s") for n, t in long.items()] + [(-n, t + " vile awful nasty.", "s") for n, t in long.items()])
    flat = toxicity.Model(model.feature, model.weight, model.bias)
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, flat).collect()}[20_000] == 1  # without levels
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()} == {n: int(n < 0) for k in long for n in (k, -k)}
