import re
from collections import Counter
from itertools import permutations

from remitspark.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """The letters that each (doc_id, text, lang) fails."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = []
    for i, t, _ in rows:
        t = t or ""
        w = WORD.findall(t)
        e = i is not None and least.get(t, i) < i
        checks = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": e}
        out.append({f for f, bad in checks.items() if bad})
    return out


def plain(rows, good, toxic):
    """Every order played through, document by document."""
    failed, out = fails(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        mine = [(i, f) for (i, _, lang), f in zip(rows, failed) if (lang or "") == part]
        total, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i, bad in left if f in bad]
                left = [(i, bad) for i, bad in left if f not in bad]
                redundant = sum(f in bad for _, bad in mine) - len(gone)
                total[f] += len(gone)
                lines.append(("".join(order), step, f, len(left), len(gone), redundant, sum(bad == {f} for _, bad in mine), sum(i in good for i in gone), sum(i in toxic for i in gone)))
        for order, step, f, *rest in lines:
            out[part, order, step] = (*rest, total[f])
    return out


def found(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in df.collect()}


def documents(spark, rows):
    # extra columns with names that the operator uses inside
    full = [(i, t, lang, "x", "y", "z", 1) for i, t, lang in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, part string, filter string, key string, mask int").repartition(3)


def test_all_orders_as_played_through(spark, rows):
    words = " ".join(f"w{i}" for i in range(250))
    mine = [(i, t, s) for i, t, s in rows] + [
        (100, words, "a"), (101, words, "a"), (101, words, "b"), (102, words + " #", "a"), (103, words.upper(), "b"), (104, "same " * 300, "a"), (105, "SAME $ " * 300, ""),
        (None, words, "a"), (106, "SAME $ " * 300, None),
    ]
    good, toxic = {1, 100, 101, 104}, {3, 101, 105}
    labels = [(i, int(i in good), int(i in toxic)) for i in (1, 3, 100, 101, 101, 104, 105, 999)] + [(None, 1, 1), (4, None, None)]
    got = audit.audit_documents(documents(spark, mine), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got.columns[:3] == ["part", "filter_order", "step"]
    assert found(got) == plain(mine, good, toxic)


def test_hot_group_of_copies_by_broadcast(spark):
    rows = [(i, "copied text", "a") for i in range(300)] + [(1000 + i, f"text {i % 70}", "b") for i in range(150)]
    facts = audit.text_facts(documents(spark, rows))
    ids = {r["doc_id"] for r in audit.later_copies(facts, hot_share=3).join(facts, "key").collect()}
    assert ids == {i for (i, _, _), f in zip(rows, fails(rows)) if "E" in f}


def test_other_filters_and_sets(spark):
    base = spark.range(20).selectExpr("id AS key", "'p' AS part")
    failing = {"x": base.filter("key % 2 = 0"), "y": base.filter("key % 3 = 0")}
    got = {(r["filter_order"], r["step"]): r for r in audit.filter_audit(base, failing, {"odd": base.filter("key % 2 = 1")}).collect()}
    assert len(got) == 4
    assert [got["xy", 2][c] for c in ("kept", "removed", "redundant", "unique_fails", "odd_lost", "shapley")] == [7, 3, 4, 3, 3, 10]
    assert [got["yx", 1][c] for c in ("kept", "removed", "redundant", "unique_fails", "odd_lost", "shapley")] == [13, 7, 0, 3, 3, 10]


def test_no_failures_and_no_rows(spark):
    clean = [(i, " ".join(f"v{i}x{j}" for j in range(220)), "a") for i in range(3)]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = found(audit.audit_documents(documents(spark, clean), labels))
    assert len(got) == 600 and set(got.values()) == {(3, 0, 0, 0, 0, 0, 0)}
    assert audit.audit_documents(documents(spark, []), labels).count() == 0


def test_the_plan_stays_small(spark):
    """Steps are written one by one: what is left to plan at the end joins counts, not the documents of 32 sets."""
    base = spark.range(40).selectExpr("id AS key", "'p' AS part")
    failing = {f: base.filter(f"key % {n} = 0") for f, n in zip("ABCDE", (2, 3, 5, 7, 11))}
    got = audit.filter_audit(base, failing, {"odd": base.filter("key % 2 = 1")})
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
