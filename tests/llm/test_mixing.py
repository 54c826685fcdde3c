import hashlib
import re
from collections import Counter, defaultdict

from remitspark.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def size(t):
    return len(WORD.findall(t or ""))


def plain_mix(rows):
    """(id, size, source size, target, taken) of each row, one by one."""
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(f"{'' if i is None else i}:17".encode()).hexdigest(), i if i is not None else -1, size(t), i))
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(x[2] for x in by[s]) for s in by}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        w = sum(weight[s] for s in by if s not in capped)
        target = {s: 3.0 * total[s] if s in capped else left * weight[s] / w for s in by}
        new = {s for s in by if s not in capped and target[s] > 3 * total[s]}
        if not new:
            break
        capped |= new
    out = []
    for s in by:
        budget, before = int(target[s] + 0.5), 0
        for _, _, n, i in sorted(by[s]):
            whole = budget // total[s] if total[s] else 0
            out.append((i, n, total[s], round(target[s], 6), whole * n + max(0, min(n, budget - whole * total[s] - before))))
            before += n
    return sorted(out, key=repr)


def found(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=repr)


def test_mix_as_brute_force(messy, rows):
    assert found(mixing.mix(messy)) == plain_mix(rows)


def test_targets_caps_and_hot_source(make):
    rows = [(i, "a b c d " * (i % 7), "hot") for i in range(300)] + [(500 + i, "x y " * i, f"s{i % 5}") for i in range(60)]
    got = mixing.mix(make(rows))
    assert found(got) == plain_mix(rows)
    sums, targets = Counter(), {}
    for r in got.collect():
        sums[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
        assert r["taken"] <= 3 * r["size"]
    assert all(abs(sums[s] - targets[s]) <= 0.5 for s in targets)


def test_documents_of_the_mix(make):
    rows = [(i, f"  w{i} \t x  y z{i}\n", "a" if i < 4 else "b") for i in range(30)]
    docs = make(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += size(r["text"])
        assert rows[r["doc_id"]][1].startswith(r["text"])
    assert got == Counter({k: v for k, v in taken.items() if v})


def test_empty_table_and_no_words(make):
    assert mixing.mix(make([])).count() == 0
    assert [tuple(r)[1:5] for r in mixing.mix(make([(1, None, None), (2, " ", "a")])).collect()] == [(0, 0, 0.0, 0)] * 2
    assert mixing.mixed_documents(make([(1, None, None)])).count() == 0


def test_rows_of_equal_id_and_size_are_taken_one_by_one(make):
    rows = [(i, "x " * 50, "a") for i in range(100)] + [(None, f"t{i} " * 50, "b") for i in range(100)]
    taken = sorted(x[4] for x in plain_mix(rows) if x[0] is None and x[4])
    got = sorted(size(r["text"]) for r in mixing.mixed_documents(make(rows)).filter("source = 'b'").collect())
    assert got == taken == [7] + [50] * 57
