import pytest
from pyspark.sql import functions as F

from remitspark.operators.check_suite import KeyCheck, KeyRole, MemberCheck, Source, resolves, run_checks, unique


def suite(spark, child, parent):
    kids = spark.createDataFrame(child, "k string, amount int")
    folks = spark.createDataFrame(parent, "k string, total int")
    sources = [
        Source(kids, {"amounts": "amount < 0"}, [KeyRole("kid", "k", "k", {"sum": ("sum", "amount")})]),
        Source(folks, {}, [KeyRole("folk", "k", "k", {"total": ("max", "total")})]),
    ]
    checks = [
        resolves("fk", "k", "kid", "folk"), resolves("coverage", "k", "folk", "kid"), unique("parent key", "k", "folk"), unique("child key", "k", "kid"),
        KeyCheck("identity", "k", "if(key is not null and n_folk > 0 and n_kid > 0 and folk_total <> kid_sum, 1L, 0L)"), MemberCheck("member", "k", "folk", "0"),
    ]
    return {r["check_name"]: (r["violations"], r["passed"]) for r in run_checks(sources, checks).collect()}


def test_checks_that_fire(spark):
    child = [("a", 1), ("a", 2), ("b", -5), ("x", 1), (None, 1), ("hot", 0)] + [("hot", 1)] * 200
    got = suite(spark, child, [("a", 3), ("b", 9), ("b", 9), ("c", 1), ("hot", 200), (None, 0), ("0", 0), ("0", 0)])
    assert {n: v for n, (v, _) in got.items()} == {
        "amounts": 1, "fk": 2, "coverage": 4, "parent key": 3, "child key": 202, "identity": 1, "member": 1,
    }
    assert not any(passed for _, passed in got.values())


def test_checks_that_hold_and_empty_tables(spark):
    assert all(v == 0 for v, _ in suite(spark, [("a", 3), ("0", 0)], [("a", 3), ("0", 0)]).values())
    empty = suite(spark, [], [])
    assert empty.pop("member") == (1, False)  # a member that should be there is missing
    assert all(x == (0, True) for x in empty.values())


def test_declarations_are_checked(spark):
    one = spark.createDataFrame([("a",)], "k string")
    with pytest.raises(ValueError, match="own name"):
        run_checks([Source(one, {}, [KeyRole("r", "k", "k"), KeyRole("r", "d", "k")])], [])
    with pytest.raises(ValueError, match="no source"):
        run_checks([Source(one, {}, [KeyRole("r", "k", "k")])], [unique("u", "other", "r")])


def test_each_source_is_read_once(spark):
    one, two = spark.range(5).selectExpr("id as k"), spark.range(7).selectExpr("id as k")
    sources = [Source(one, {"r": "k < 0"}, [KeyRole("a", "k", "k"), KeyRole("b", "other", "k + 1")]), Source(two, {}, [KeyRole("c", "k", "k")])]
    plan = run_checks(sources, [resolves("f", "k", "a", "c"), unique("u", "other", "b"), unique("v", "k", "c")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (0") == 2 and "Join" not in plan


def test_domains_share_the_counts_of_a_key(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), (None, 2, None)], "k string, g int, v int")
    other = spark.createDataFrame([(1, 4), (3, 9)], "g int, v int")
    sources = [
        Source(rows, {"small": "v < 6"}, [KeyRole("row", "k", "k", {"v": ("sum", "v"), "top": ("max", "v")}), KeyRole("use", "g", "g", {"v": ("sum", "v")})]),
        Source(other, {}, [KeyRole("group", "g", "g", {"v": ("sum", "v")})]),
    ]
    checks = [
        unique("rows", "k", "row"), resolves("fk", "g", "use", "group"), resolves("coverage", "g", "group", "use"),
        KeyCheck("top", "k", "if(row_top <> row_v, 1L, 0L)"), KeyCheck("sums", "g", "if(n_use > 0 and n_group > 0 and use_v <> group_v, 1L, 0L)"),
    ]
    done = run_checks(sources, checks)
    assert {r["check_name"]: r["violations"] for r in done.collect()} == {"small": 1, "rows": 2, "fk": 2, "coverage": 1, "top": 1, "sums": 1}
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "n_group" not in plan.split("Exchange")[-1] and "lambda" not in plan  # two places for three roles, entries compiled


def test_a_merged_source_gives_the_checks_of_its_tables(spark):
    child = [("a", 1), ("a", 2), ("b", -5), ("x", 1), (None, 1), ("hot", 0)] + [("hot", 1)] * 200
    parent = [("a", 3), ("b", 9), ("b", 9), ("c", 1), ("hot", 200), (None, 0), ("0", 0), ("0", 0)]
    apart = suite(spark, child, parent)
    kids = spark.createDataFrame(child, "key string, amount int").selectExpr("*", "1 as n_kid", "0 as n_folk", "amount as kid_sum", "null as folk_total", "amount < 0 as bad")
    folks = spark.createDataFrame(parent, "key string, amount int").selectExpr("*", "0 as n_kid", "1 as n_folk", "null as kid_sum", "amount as folk_total", "false as bad")
    by_key = kids.unionByName(folks).groupBy("key").agg(
        *[F.expr(f"{f}({c}) as {c}") for f, c in (("sum", "n_kid"), ("sum", "n_folk"), ("sum", "kid_sum"), ("max", "folk_total"))], F.expr("count_if(bad) as amounts")
    )
    checks = [
        resolves("fk", "k", "kid", "folk"), resolves("coverage", "k", "folk", "kid"), unique("parent key", "k", "folk"), unique("child key", "k", "kid"),
        KeyCheck("identity", "k", "if(key is not null and n_folk > 0 and n_kid > 0 and folk_total <> kid_sum, 1L, 0L)"), MemberCheck("member", "k", "folk", "0"),
        resolves("use", "g", "used", "group"),
    ]
    used = KeyRole("used", "g", "if(key = 'a', 'in', 'out')", rows="n_kid")
    sources = [Source(by_key, roles=[used], counts={"amounts": "amounts"}, merged="k"), Source(spark.sql("select 'in' as g"), {}, [KeyRole("group", "g", "g")])]
    merged = {r["check_name"]: (r["violations"], r["passed"]) for r in run_checks(sources, checks).collect()}
    assert merged.pop("use") == (len(child) - 2, False)
    assert merged == apart
    with pytest.raises(ValueError, match="merged domain"):
        run_checks([Source(by_key, merged="k"), Source(by_key, {}, [KeyRole("r", "k", "key")])], [])
