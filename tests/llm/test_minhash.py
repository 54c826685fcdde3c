import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from remitspark.llm import minhash
from remitspark.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingle_counts(t, k=5):
    w = WORD.findall(fold(t))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)])


def similarity(x, y):
    keys = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in keys) for i in set(x) & set(y))


def plain_classes(rows, least=0.8):
    sets = [shingle_counts(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = WORD.findall(fold(rows[i][1])) == WORD.findall(fold(rows[j][1]))
            if same or similarity(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    out = []
    for ids in members.values():
        first = min((i for i in ids if i is not None), default=None)
        out += [(i, first, len(ids)) for i in ids]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "class_id", "class_size").collect()), key=repr)


def test_classes_as_brute_force(messy, rows):
    got = minhash.near_duplicates(messy)
    assert found(got) == plain_classes(rows)
    kept = Counter(r["class_id"] for r in got.filter("kept").collect())
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("rows_of_a_block", [1024, 7])
def test_large_bucket_of_unequal_members(make, monkeypatch, rows_of_a_block):
    """Edited copies of a text and of its edits: many pairs share bands, not all are similar enough."""
    monkeypatch.setattr(minhash, "CELL_ROWS", rows_of_a_block)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(60):
        t = list(base)
        for j in rng.choice(150, int(rng.integers(0, 9)), replace=False):
            t[j] = f"edit{i}x{j}"
        rows.append((i, " ".join(t), "s"))
    assert found(minhash.near_duplicates(make(rows))) == plain_classes(rows)


def test_recall_of_planted_edits(make):
    """Links of at least the threshold between edited copies, against brute force: those that end in one class."""
    rng = np.random.default_rng(8)
    rows = []
    for g in range(40):
        base = [f"g{g}w{i}" for i in range(120)]
        for k in range(4):
            t = list(base)
            for j in rng.choice(120, int(rng.integers(0, 4)), replace=False):
                t[j] = f"edit{k}x{j}"
            rows.append((4 * g + k, " ".join(t), "s"))
    rng.shuffle(rows)
    rows = [(int(i), t, s) for i, t, s in rows]
    label = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(make(rows)).collect()}
    sets = {i: shingle_counts(t) for i, t, _ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and a // 4 == b // 4 and similarity(sets[a], sets[b]) >= 0.8]
    assert len(links) > 80
    assert sum(label[a] == label[b] for a, b in links) >= 0.99 * len(links)
    assert all(label[i] // 4 == i // 4 for i in label)


def test_exact_similarity_formula():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a = {int(k): int(rng.integers(1, 5)) for k in rng.choice(30, 12, replace=False)}
        b = {int(k): int(rng.integers(1, 5)) for k in rng.choice(30, 15, replace=False)}
        pack = lambda d: (np.array(sorted(d)), np.array([d[k] for k in sorted(d)]))
        assert minhash.probability_jaccard(pack(a), pack(b)) == pytest.approx(similarity(Counter(a), Counter(b)))


def test_registers_agree_with_the_similarity():
    rng = np.random.default_rng(4)
    both = rng.integers(1, 2**62, 60).astype(np.uint64)
    own = [rng.integers(1, 2**62, 20).astype(np.uint64) for _ in range(2)]
    w = rng.integers(1, 4, 80)
    element = np.concatenate([both, own[0], both, own[1]])
    rows = np.repeat([0, 1], 80)
    sig = minhash.sketch(rows, element, np.concatenate([w, w]), 2, 4096)
    x = Counter({int(e): int(c) for e, c in zip(element[:80], w)})
    y = Counter({int(e): int(c) for e, c in zip(element[80:], w)})
    assert (sig[0] == sig[1]).mean() == pytest.approx(similarity(x, y), abs=0.04)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}


def test_dropping_and_empty_table(messy, make, rows):
    kept = minhash.drop_near_duplicates(messy)
    assert kept.columns == messy.columns
    classes = Counter(c for _, c, _ in set((None, c, n) for _, c, n in plain_classes(rows)))
    assert kept.count() == len(classes)
    assert minhash.near_duplicates(make([])).count() == 0
    assert minhash.drop_near_duplicates(make([])).count() == 0


def test_unlike_texts_of_null_or_equal_ids_are_all_kept(make):
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(5)]
    docs = make([(None, texts[0], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (7, texts[3], "s"), (7, texts[4], "s"), (None, texts[2], "s"), (7, texts[4], "s"), (8, texts[4], "s")])
    got = minhash.near_duplicates(docs).collect()
    sizes = {r["class_key"]: (r["class_id"], r["class_size"]) for r in got}
    assert sorted(sizes.values(), key=repr) == sorted([(None, 1), (None, 1), (None, 2), (7, 1), (7, 3)], key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == 5 and len({r["class_key"] for r in kept}) == 5 and all(r["doc_id"] == r["class_id"] for r in kept)
    left = sorted((r["doc_id"], r["text"]) for r in minhash.drop_near_duplicates(docs).fillna({"doc_id": -1}).collect())
    assert left == sorted([(-1, texts[0]), (-1, texts[1]), (-1, texts[2]), (7, texts[3]), (7, texts[4])])
