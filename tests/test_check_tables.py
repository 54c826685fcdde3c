import datetime as dt
from pathlib import Path

import pytest

from remitspark.plans.check_tables import outcome_layer_checks
from remitspark.session import ensure_checkpoint_dir


def t(text):
    return text and dt.datetime.fromisoformat(text)


def line(order, number, flag="N", status="F", ship="2024-01-10", price=10.0, part=1):
    return (order, part, 1, number, 5.0, price, 0.1, 0.02, flag, status, t(ship))


ORDERS = [
    (1, 1, "F", 1.0, t("2024-01-02"), "1-URGENT"), (1, 1, "F", 1.0, t("2024-01-03"), "1-URGENT"),  # one key twice
    (2, 1, "F", 1.0, t("2024-01-02"), "1-URGENT"),  # no lines
    (3, 2, "F", 1.0, t("2024-02-01"), None),  # two customers, paid before it was submitted, denied without a category
    (4, 7, "F", 1.0, t("2024-01-02"), "2-HIGH"),  # no customer, its part is there twice
    (None, 1, "F", 1.0, t("2024-01-02"), "2-HIGH"),
]
LINES = [
    line(1, 1), line(1, 2, ship=None), line(1, 3, price=None),
    line(3, 1, "R"), line(3, 2, "R"), line(3, 70, "A"), line(3, 70, "A", price=4.0), line(3, None, "R", "O"),
    line(4, 1, part=5), line(4, 1, part=6),
    line(9, 1, "R"), line(9, 2, "R"), line(9, 3, "A"), line(9, 3, "A", "O"), line(9, 4, "R"),  # no order: appeals of no claim
    line(None, 1, "R"), line(None, 2, "A"),
]
CUSTOMERS = [(1, "a", 1, 1.0, "BUILDING"), (2, "b", 1, 1.0, "MACHINERY"), (2, "c", 1, 1.0, None), (3, "d", 1, 1.0, "NOBODY")]
PARTS = [(1, "p", "b", "t", 5, 1.0), (5, "q", "b", "t", 20, 1.0), (5, "r", "b", "t", None, 1.0)]
# claims: order 1 twice, order 3 for each of its customers' rows, order 4 for each row of its part
EXPECTED = {
    "unique:claims.claim_sk": 3, "unique:appeals.grain": 2, "fk:claims.payer": 2, "fk:appeals.claim_sk": 2, "coverage:every order has an outcome": 2,
    "coverage:every payer has claims": 1, "money:billed equals the lines": 3, "grain:line count equals the lines": 3, "money:recovered equals the appeals": 1,
    "outcome:appeal levels equal the appeals": 1, "cost:appeal cost follows the appeals": 1, "outcome:category iff denied": 2, "outcome:payments have an event": 2,
    "time:paid after submission": 2,
}
SCHEMAS = {
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
    "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
}


def run(spark, folder, **tables):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(tables[name], schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return outcome_layer_checks(spark, str(folder))


@pytest.fixture(scope="module")
def checked(spark, tmp_path_factory):
    kept = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = {p for p in kept.rglob("*") if p.is_file()}
    done = run(spark, tmp_path_factory.mktemp("odd"), orders=ORDERS, lineitem=LINES, customer=CUSTOMERS, part=PARTS)
    found = {r["check_name"]: r["violations"] for r in done.collect()}
    return done, found, {p for p in kept.rglob("*") if p.is_file()} - before


def test_outcome_checks_of_repeated_and_missing_rows(checked):
    _, found, _ = checked
    assert len(found) == 39
    assert {name: n for name, n in found.items() if n} == EXPECTED


def test_outcome_checks_write_no_claims_or_events(checked):
    done, _, written = checked
    assert not written  # claims and their log were written in full
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "MapInArrow" not in plan  # lines laid together (and those past line 62), events numbered in place


def test_outcome_checks_of_clean_and_empty_tables(spark, tmp_path):
    clean = run(
        spark, tmp_path / "clean", orders=[(1, 1, "F", 1.0, t("2024-01-02"), "1-URGENT")], lineitem=[line(1, 1), line(1, 2)], customer=CUSTOMERS[:1], part=PARTS[:1]
    )
    assert [r["check_name"] for r in clean.collect() if r["violations"]] == []
    empty = run(spark, tmp_path / "empty", orders=[], lineitem=[], customer=[], part=[]).collect()
    assert len(empty) == 39 and all(r["violations"] == 0 and r["passed"] for r in empty)
