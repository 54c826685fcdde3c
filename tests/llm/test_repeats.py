import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from remitspark.llm import repeats


def plain(rows, length):
    seen = Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if seen[b[j : j + length]] > 1:
                gone[j : j + length] = [True] * length
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_messy_documents_as_brute_force(make, rows):
    rows = [r for r in rows if r[0] != 12] + [(12, "ab" * 900, "d"), (18, "ab" * 300 + "é" * 500 + "z" * 399, "d")]
    assert found(repeats.remove_repeats(make(rows))) == plain(rows, 400)


@pytest.mark.parametrize("length,gram,levels", [(12, 5, (4, 1)), (9, 9, (1,)), (16, 1, (8, 2, 1))])
def test_short_strings_as_brute_force(make, length, gram, levels):
    rng = np.random.default_rng(length)
    parts = ["".join(rng.choice(list("abé"), int(rng.integers(3, 30)))) for _ in range(25)]
    rows = [(i, "".join(rng.choice(parts, int(rng.integers(0, 7)))), "s") for i in range(60)]
    assert found(repeats.remove_repeats(make(rows), length=length, gram=gram, levels=levels)) == plain(rows, length)


def test_long_texts_are_cut_into_sections(make, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(repeats, "SECTION", 500)
    text = np.frombuffer("".join(rng.choice(list("abcd"), 3000)).encode(), np.uint8)
    data = np.concatenate([text, text[100:2000]])
    t, s, e, a, bucket, span = repeats.anchor_runs(data, np.array([0, len(data)]), 60, 20)
    covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(s, e)])
    assert np.array_equal(np.sort(covered), np.arange(len(data) - 59))
    anchor = dict(zip(np.concatenate([np.arange(x, y + 1) for x, y in zip(s, e)]).tolist(), np.repeat(bucket, e - s + 1).tolist()))
    assert all(anchor[p] == anchor[p + 2900] for p in range(100, 1900))


def test_spans_text_and_empty_table(make):
    docs = make([(1, "x" * 10 + "hello world again" + "y" * 10, "s"), (2, "hello world again", "s")])
    out = {r["doc_id"]: r for r in repeats.remove_repeats(docs, length=12, gram=5, levels=(4, 1), with_text=True).collect()}
    assert bytes(out[1]["kept"]) == b"x" * 10 + b"y" * 10 and out[1]["spans"] == [[10, 27]]
    assert out[2]["n_removed"] == 17
    assert repeats.remove_repeats(make([])).count() == 0


def plain_words(rows, length):
    holders = {}
    for k, (_, t, _) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for j in range(len(w) - length + 1):
            holders.setdefault(tuple(w[j : j + length]), set()).add(k)
    out = []
    for i, t, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        held = set()
        for j in range(len(w) - length + 1):
            if len(holders[tuple(w[j : j + length])]) > 1:
                held.update(range(j, j + length))
        out.append((i, len(held)))
    return sorted(out, key=repr)


def test_passages_of_few_bytes_that_documents_share(make, rows):
    own = [" ".join(f"{c}{j}" for j in range(70)) for c in "pqrstuv"]
    passage = " ".join(f"z{j}" for j in range(51))  # below 400 bytes
    short = " ".join(passage.split()[:50])
    rows = [
        *rows, (20, f"{own[0]} {passage} {own[1]}", "d"), (21, f"{own[2]}\n{passage.replace(' ', '  ')}", "d"), (22, f"{short} {own[3]}", "d"),
        (23, f"{own[4]} {own[5]} {own[4]}", "d"), (24, "again " * 300, "d"), (25, "once " + "again " * 52, "d"), (26, own[6], "d"),
    ]
    df = repeats.remove_repeats(make(rows), passage_words=51)
    assert found(df) == plain(rows, 400)
    got = sorted((tuple(r) for r in df.select("doc_id", "n_shared_words").collect()), key=repr)
    assert got == plain_words(rows, 51)
    got = dict(got)
    assert (got[20], got[21], got[22], got[23], got[24], got[25], got[26]) == (51, 51, 0, 0, 300, 52, 0)


@pytest.mark.parametrize("length,gram,levels", [(7, 3, (4, 1)), (5, 5, (1,)), (6, 1, (3, 2, 1))])
def test_shared_words_as_brute_force(make, length, gram, levels):
    rng = np.random.default_rng(length)
    parts = [" ".join(rng.choice(list("abcé"), int(rng.integers(2, 12)))) for _ in range(25)]
    rows = [(i, " \n".join(rng.choice(parts, int(rng.integers(0, 7)))), "s") for i in range(60)] + [(None, None, "s"), (3, "b c " * 9, "s"), (3, "b c " * 9, "s")]
    runs = repeats.shared_passages(make(rows).select("doc_id", "text"), words=length, gram=gram, levels=levels)
    spans = {}
    for r in runs.collect():
        spans.setdefault((r["c1"], r["c2"]), []).append((r["s"], r["e"]))
    got = []
    for i, t, _ in rows:
        b = (t or "").encode()
        c1, c2 = repeats._content(np.array([0, len(b)]), repeats._both(np.frombuffer(b, np.uint8)))
        at = spans.get((int(c1[0]), int(c2[0])), [])
        got.append((i, sum(y - x for x, y in repeats._merged([s for s, _ in at], [e for _, e in at], length))))
    assert sorted(got, key=repr) == plain_words(rows, length)
