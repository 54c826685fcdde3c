import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from remitspark.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(x, least=12):
    """Every stretch x[i] == x[i + p] of every p; of equal stretches the smallest p."""
    best = {}
    for p in range(1, len(x) // 2 + 1):
        i = 0
        while i + p < len(x):
            j = i
            while j + p < len(x) and x[j] == x[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                best.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in best.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    x = WORD.findall(text or "")
    n, h = len(x), 1
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    found = plain_runs(x)
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    drop = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (doc_id, len(found), *best, sha("".join(f"{s},{m},{p}\n" for s, m, p in found)), sha(" ".join(w for i, w in enumerate(x) if i not in drop)))


def found(df):
    return sorted((tuple(r)[:8] for r in df.collect()), key=repr)


def several(texts, least):
    bounds = np.cumsum([0] + [len(x) for x in texts])
    got = runs.word_runs(np.array(sum(texts, []), dtype=np.uint64), bounds, least)
    want = [(s + int(bounds[i]), n, p) for i, x in enumerate(texts) for s, n, p in plain_runs(x, least)]
    assert list(zip(*(v.tolist() for v in got))) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=60), max_size=4), st.sampled_from([2, 3, 12]))
def test_runs_of_few_words(texts, least):
    several(texts, least)


def test_runs_of_repetitions_in_repetitions():
    rng = random.Random(5)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    several([b, [], [7] * 100, [1]], 2)
    for _ in range(60):
        x = []
        while len(x) < 150:
            block = [rng.randrange(3) for _ in range(rng.randint(1, 12))]
            x += (block * 6)[: rng.randint(1, 5 * len(block))]
            if rng.random() < 0.4:
                x += x[-rng.randint(1, 40):]
        several([x, x[::-1]], 2)


def test_documents_as_brute_force(spark, make, rows):
    line = " ".join(f"w{i % 7}" for i in range(40))
    rows = [r for r in rows if len(r[1] or "") < 50_000] + [
        (20, "x  x\tx " * 10, "a"), (21, line + " end " + line, "a"), (22, "A a " * 3 + "B b " * 8, "a"), (23, "é ü é ü " * 9, "a"), (24, ("p q r " * 9 + "s ") * 3, "a"),
    ] + [(i, " ".join(f"v{(i * j) % 97}" for j in range(150)), "b") for i in range(100, 160)]
    got = runs.run_rows(runs.periodic_runs(runs.with_periods(make(rows))))
    assert found(got) == sorted((expected(i, t) for i, t, _ in rows), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in rows if i is not None)


def test_long_text_and_chunks(make, monkeypatch):
    text = "start " + " ".join(f"u{i}" for i in range(5000)) * 2 + " tail" * 20_000
    r = runs.periodic_runs(make([(1, text, "a"), (2, "b " * 12, "a")])).orderBy("doc_id").collect()
    assert (5001 + 4999, 20_000, 1) in [(x["start"], x["length"], x["period"]) for x in r[0]["runs"]]
    assert [tuple(x) for x in r[1]["runs"]] == [(0, 12, 1)] and r[1]["collapsed"] == "b" and r[1]["n_words"] == 12


def test_texts_and_spans_of_the_operator(make):
    r = runs.periodic_runs(make([(1, " a b\na b a b  a b a b\ta b c ", "x"), (2, None, None)])).orderBy("doc_id").collect()
    assert [tuple(x) for x in r[0]["runs"]] == [(0, 12, 2)] and r[0]["collapsed"] == "a b c"
    assert r[1]["runs"] == [] and r[1]["collapsed"] == "" and r[1]["n_words"] == 0
    assert runs.run_rows(runs.periodic_runs(make([]))).count() == 0
