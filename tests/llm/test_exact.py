import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from remitspark.llm import exact


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[fold(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_groups_as_brute_force(messy, rows):
    assert found(exact.exact_dedup(messy)) == expected(rows)


def test_hot_group_by_broadcast_and_salts(make):
    rows = [(i, "same Text", "s") for i in range(400)] + [(1000 + i, f"text {i % 90}", "s") for i in range(200)]
    assert found(exact.exact_dedup(make(rows), salts=4, hot_share=3)) == expected(rows)


def test_equal_digests_of_different_texts_stay_apart(make, rows):
    weak = lambda body: F.substring(F.sha2(body, 256), 1, 1)
    got = exact.exact_dedup(make(rows), digest=weak)
    assert [x[:4] for x in found(got)] == [x[:4] for x in expected(rows)]


def test_no_python_in_the_plan(messy):
    plan = exact.exact_dedup(messy)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_empty_table(make):
    assert exact.exact_dedup(make([])).count() == 0
    assert exact.drop_copies(make([])).count() == 0


def test_dropping_keeps_columns_and_one_row_of_each_text(messy, rows):
    kept = exact.drop_copies(messy)
    assert kept.columns == messy.columns
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, fold(r["text"])) for r in kept.collect())
    assert got == sorted((i is not None, i or 0, fold(t)) for i, t in {(x[0], fold(next(t for j, t, _ in rows if j == x[0] and hashlib.sha256(fold(t).encode()).hexdigest() == x[4]))) for x in expected(rows) if x[3]})
