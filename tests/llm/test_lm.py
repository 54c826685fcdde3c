import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from remitspark.llm import lm

WORD = re.compile("[^\x20\x09-\x0d]+")


def tokens(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check_base(got, rows):
    count = Counter(w for i, t, _ in rows if not held(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted(((i, held(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 5)) for i, t, _ in rows), key=repr)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 5)) for r in got), key=repr) == expected


def test_counts_and_base_as_brute_force(messy, rows):
    got = lm.score(messy, least_parts=5).collect()
    check_base(got, rows)
    assert all(r["score"] < 0 for r in got)


def test_better_than_the_base_on_held_out_texts(make):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(300):  # every word is followed by one of three
        w, out = int(rng.integers(50)), []
        for _ in range(60):
            out.append(f"w{w}")
            w = (w * 3 + int(rng.integers(3))) % 50
        rows.append((i, " ".join(out), "s"))
    got = lm.score(make(rows), least_parts=7).collect()
    check_base(got, rows)
    mine, base = (sum(r[c] for r in got if r["held_out"]) for c in ("score", "base_score"))
    assert mine > 0.75 * base
    again = {r["doc_id"]: r["score"] for r in lm.score(make(rows), least_parts=7).collect()}
    assert again == {r["doc_id"]: r["score"] for r in got}


def test_what_training_texts_hold_is_likelier(make):
    train = [(i, "a b a c b a", "s") for i in range(1, 40) if not held(i)]
    ids = [i for i in range(100, 200) if held(i)][:3]
    got = {r["doc_id"]: r["score"] for r in lm.score(make(train + list(zip(ids, ("a b", "b b", "b zz"), "sss"))), least_parts=3).collect()}
    assert got[ids[0]] > got[ids[1]] > got[ids[2]]


def test_seating_stays_possible_and_follows_the_prior():
    c = np.array([1, 2, 10, 40, 500, 20_000])
    for p in (1e-9, 0.3):
        for t in lm.seat(c, np.full(6, p), np.zeros(6, np.int64), 1, np.ones(1), 0.75, 1.0, np.random.default_rng(1)):
            assert (t >= 1).all() and (t <= c).all()
            if p < 1e-6:
                assert t[:4].tolist() == [1, 1, 1, 1]


def test_tables_of_two_customers_have_their_exact_distribution():
    """Two customers of one dish: one table with weight 1 - d, two with (strength + d (T + 1)) times the prior."""
    n, d, strength, prior = 20_000, 0.75, 1.0, 0.2
    t = list(lm.seat(np.full(n, 2), np.full(n, prior), np.arange(n), n, np.ones(n), d, strength, np.random.default_rng(2)))[-1]
    two = (strength + d) * prior
    assert (t == 2).mean() == pytest.approx(two / (1 - d + two), abs=0.015)


def test_no_training_text_and_empty_table(make):
    i = next(k for k in range(100) if held(k))
    only = lm.score(make([(i, "a b", "s")]), least_parts=3).collect()
    assert only[0]["n_known"] == 0 and only[0]["train_tokens"] == 0 and math.isfinite(only[0]["score"])
    assert lm.score(make([])).count() == 0


def test_prior_of_a_rare_word_is_its_own_share(monkeypatch):
    import pyarrow as pa

    plan = lm.Plan(2, np.zeros(0, np.uint64), np.zeros(0), 10**8)
    shared = type("Shared", (), {"value": plan})
    words = np.arange(100, 130, dtype=np.uint64)
    blobs = {0: [(words[:20], np.arange(1, 21))], 1: [(words[10:], np.arange(1, 21)), (words[10:12], np.array([5, 0]))]}
    total = Counter()
    for w, n in (x for part in blobs.values() for x in part):
        total.update(dict(zip(w.tolist(), n.tolist())))
    rows = [(p, 0, i, lm.pack(w, n)) for p, part in blobs.items() for i, (w, n) in enumerate(part)]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted(rows, key=lambda r: r[0]))], names=["part", "kind", "source", "blob"])

    def flat(out):
        return [tuple(c[0].as_py() for c in b.columns) for b in out]

    told = flat(lm._told(iter([batch(flat(lm._asked(shared)(iter([batch(rows)]))))])))
    priors = []
    monkeypatch.setattr(lm, "seat", lambda c, prior, *rest: (priors.append(prior), iter([np.ones(len(c), np.int64)]))[1])
    for part, own in ((0, words[:20]), (1, words[10:])):
        counts = np.concatenate([lm.unpack(r[3])[0] for r in sorted((r for r in told if r[0] == part), key=lambda r: r[2])])
        lm._part(np.full(len(own), 5, np.uint64), own, np.full(len(own), 3), counts, plan, part)
        assert priors[-1].tolist() == [total[w] / 1e8 for w in own.tolist()]
