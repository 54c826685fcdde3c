import datetime as dt

from remitspark.operators import contracts

C = contracts.Contract(
    "inpatient", required=("CLM_ID", "CLM_LINE_NUM", "CLM_PMT_AMT"), unique_key=("CLM_ID", "CLM_LINE_NUM"),
    date_order=(("CLM_FROM_DT", "CLM_THRU_DT"),), non_negative=("CLM_PMT_AMT",),
)
SCHEMA = "CLM_ID string, CLM_LINE_NUM int, CLM_FROM_DT date, CLM_THRU_DT date, CLM_PMT_AMT double"


def d(day):
    return dt.date(2024, 1, day)


def test_every_duplicate_row_is_quarantined(spark, as_rows):
    df = spark.createDataFrame([("c1", 1, d(1), d(2), 5.0), ("c1", 1, d(1), d(2), 6.0), ("c2", 1, d(1), d(2), 1.0)], SCHEMA)
    q = contracts.quarantine(df, C)
    assert as_rows(q, "contract", "entity_key") == [("key_uniqueness", "c1|1")] * 2
    assert not contracts.table_passes(contracts.contract_report(df, C))


def test_row_rules(spark, as_rows):
    df = spark.createDataFrame(
        [("c1", 1, d(1), d(2), -5.0), ("c2", 1, d(3), d(2), 1.0), ("c3", 1, None, d(2), None)], SCHEMA
    )
    q = contracts.quarantine(df, C)
    assert as_rows(q, "contract", "entity_key", "reason") == [
        ("date_order", "c2|1", "CLM_FROM_DT > CLM_THRU_DT"), ("non_negative_money", "c1|1", "CLM_PMT_AMT < 0"),
    ]
    assert contracts.table_passes(contracts.contract_report(df, C))


def test_text_columns_are_parsed_and_bad_text_is_null(spark, as_rows):
    df = spark.createDataFrame(
        [("c1", 1, "2024-01-03", "2024-01-02", "x"), ("c2", 1, "bad", "2024-01-02", "-1")],
        "CLM_ID string, CLM_LINE_NUM int, CLM_FROM_DT string, CLM_THRU_DT string, CLM_PMT_AMT string",
    )
    assert as_rows(contracts.quarantine(df, C), "contract", "entity_key") == [
        ("date_order", "c1|1"), ("non_negative_money", "c2|1"),
    ]


def test_missing_column_fails_the_table(spark):
    df = spark.createDataFrame([("c1", 1)], "CLM_ID string, CLM_LINE_NUM int")
    assert contracts.missing_columns(df, C) == ["CLM_PMT_AMT"]
    assert not contracts.table_passes(contracts.contract_report(df, C))


def test_a_key_with_very_many_copies_keeps_them_all(spark):
    df = spark.range(25_000).selectExpr(
        "'c1' as CLM_ID", "1 as CLM_LINE_NUM", "date'2024-01-01' as CLM_FROM_DT", "date'2024-01-02' as CLM_THRU_DT",
        "1D as CLM_PMT_AMT",
    )
    assert contracts.quarantine(df, C).count() == 25_000


def test_row_reconciliation(spark):
    a = spark.createDataFrame([("x", 3), ("y", 4)], "name string, row_count long")
    b = spark.createDataFrame([("x", 3), ("y", 5), ("z", 1)], "name string, row_count long")
    got = {r["name"]: r["passed"] for r in contracts.row_reconciliation(a, b).collect()}
    assert got == {"x": True, "y": False, "z": False}


def test_keys_dealt_by_count_give_the_same_rows(spark, as_rows, monkeypatch):
    monkeypatch.setattr(contracts, "KEYS_PER_TASK", 3)
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (2, None), (2, None), (2, None), *[(9, "hot")] * 40], "k int, t string")
    contract = contracts.Contract("x", unique_key=("k", "t"))
    got = contracts.quarantine(df, contract, rows=48)
    assert as_rows(got, *got.columns) == as_rows(contracts.quarantine(df, contract), *got.columns)
    assert contracts._copies(df, ["k", "t"], 48).rdd.getNumPartitions() == 16  # by the rows, not by bytes
