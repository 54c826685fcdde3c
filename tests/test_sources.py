import datetime as dt
import hashlib

import pytest

from remitspark.operators.contracts import Contract
from remitspark.sources import catalog, code_files, delimited, schema_rules, sinks
from remitspark.streaming import incremental

PIPE = """BENE_ID|PRVDR_NUM|CLM_FROM_DT|CLM_PMT_AMT|CLM_UTLZTN_DAY_CNT|PRNCPAL_DGNS_CD
-1|011500|25-Mar-2015|96.65|0|S134XX
-2|000700||100.00|3|Z3480
-3|012000|BADDATE|1.00|1|A00
"""


def test_kinds_follow_names():
    plan = schema_rules.column_plan(["CLM_FROM_DT", "PRCDR_DT25", "CLM_PMT_AMT", "AGE_YR", "CLM_LINE_NUM", "COVSTART", "BENE_ID"])
    assert list(plan.values()) == ["date", "date", "money", "int", "int", "date", "string"]
    assert schema_rules.typed_schema(plan)["BENE_ID"].metadata == {"provenance": "SOURCE"}
    with pytest.raises(ValueError):
        schema_rules.columns_of(plan, "nope")


def test_stage_file_types_rejects_and_reconciles(spark, tmp_path):
    (tmp_path / "in.csv").write_text(PIPE)
    report = delimited.stage_file(spark, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert (report["rows_in"], report["rows_out"], report["rejects"]) == (3, 3, {"CLM_FROM_DT": 1})
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("PRVDR_NUM").collect()
    assert [r["PRVDR_NUM"] for r in got] == ["000700", "011500", "012000"]
    assert got[1]["BENE_ID"] == "-1" and got[1]["CLM_FROM_DT"] == dt.date(2015, 3, 25) and got[0]["CLM_FROM_DT"] is None


def test_extracts(spark, tmp_path):
    (tmp_path / "npi.csv").write_text("NPI,State,Name\n1, dc ,a\n2,VA,b\n3,DC,\n")
    counts = delimited.extract_rows(spark, str(tmp_path / "npi.csv"), str(tmp_path / "dc"), "State", "dc")
    assert counts == {"scanned": 3, "kept": 2}
    delimited.extract_columns(spark, str(tmp_path / "npi.csv"), str(tmp_path / "two"), ["NPI", "Name"])
    assert spark.read.csv(str(tmp_path / "two"), header=True).columns == ["NPI", "Name"]
    with pytest.raises(ValueError):
        delimited.extract_columns(spark, str(tmp_path / "npi.csv"), str(tmp_path / "x"), ["Nope"])
    with pytest.raises(ValueError):
        delimited.extract_rows(spark, str(tmp_path / "npi.csv"), str(tmp_path / "x"), "Nope", "1")


def test_directory_scan_renames_and_requires(spark, tmp_path):
    (tmp_path / "dir").mkdir()
    (tmp_path / "dir" / "a.csv").write_text("CCN,Facility Name\n1,x\n,y\n")
    df = delimited.scan_directory(spark, str(tmp_path / "dir"), {"CCN": "ccn", "Facility Name": "name"}, ["ccn"])
    assert [tuple(r) for r in df.collect()] == [("1", "x")]


def test_manifest_hashes_files(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("a,b\n1,2\n3,4\n")
    row = delimited.file_manifest(spark, [str(path)], "v1").first()
    assert row["sha256"] == hashlib.sha256(path.read_bytes()).hexdigest()
    assert (row["bytes"], row["data_rows"], row["vintage"]) == (path.stat().st_size, 2, "v1")


def test_whitespace_codes_keep_the_first(spark, tmp_path, as_rows):
    (tmp_path / "c.txt").write_text("A00    Cholera, any\nA01 Typhoid fever\nA00 later text\nlonely\n")
    assert as_rows(code_files.split_codes(spark, str(tmp_path / "c.txt")), "code", "long_desc") == [
        ("A00", "Cholera, any"), ("A01", "Typhoid fever"),
    ]


def test_fixed_width_joins_continuations(spark, tmp_path):
    def record(code, kind, long, short=""):
        return f"{code:<5}{'':5}{kind}{long:<80}{short:<28}"

    text = "\n".join([
        record("A0021", "3", "Ambulance service, outside state", "Outside state"),
        record("A0021", "4", "per mile", ""),
        record("D0120", "3", "Dental", "x"), record("99213", "3", "Visit", "y"), record("B4034", "3", "", ""),
    ])
    (tmp_path / "h.txt").write_text(text + "\n")
    got = {r["hcpcs_code"]: (r["long_desc"], r["short_desc"]) for r in code_files.fixed_width_codes(spark, str(tmp_path / "h.txt")).collect()}
    assert got == {"A0021": ("Ambulance service, outside state per mile", "Outside state"), "B4034": (None, None)}


def test_tab_codes_skip_the_preamble(spark, tmp_path):
    (tmp_path / "d.txt").write_text('TABLE 5\nMS-DRG\ta\tb\tMDC\tTYPE\tTITLE\n1\tx\ty\t \tSURG\t"HEART, TRANSPLANT"\n20\tx\ty\t01\tMED\tSHUNT\n')
    got = {r["drg_cd"]: (r["title"], r["mdc"]) for r in code_files.tab_codes(spark, str(tmp_path / "d.txt")).collect()}
    assert got == {"001": ("HEART, TRANSPLANT", None), "020": ("SHUNT", "01")}


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.range(5)
    assert sinks.reload_table(df, "t_reload") == 5 and sinks.reload_table(df, "t_reload") == 5
    for fmt in ("parquet", "csv", "json"):
        sinks.write_result(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() >= 5
    with pytest.raises(ValueError):
        sinks.write_result(df, str(tmp_path / "x"), "xml")


def test_star_load_needs_the_unknown_member(spark, tmp_path):
    good = spark.createDataFrame([(0, "U"), (1, "a")], "a_key int, a string")
    assert sinks.load_star(spark, str(tmp_path), {"dim_a": good}, {"fact": spark.range(3)}) == {"dim_a": 2, "fact": 3}
    with pytest.raises(ValueError):
        sinks.load_star(spark, str(tmp_path), {"dim_a": good.where("a_key > 0")}, {})


def test_bucketed_join_has_no_exchange(spark):
    for name in ("b_left", "b_right"):
        sinks.bucketed_table(spark.range(1000).selectExpr("id as k", "id * 2 as v"), name, "k", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.table("b_left").join(spark.table("b_right"), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_catalog_names_and_register(spark):
    cat = catalog.Catalog(spark, [catalog.Dataset("numbers", "DERIVED", "one row per n", lambda s: s.range(4).selectExpr("id as sim_n"), ("sim_n",))])
    with pytest.raises(KeyError, match="numbers"):
        cat.frame("nope")
    row = cat.register({"numbers": cat.extract("numbers")}).first()
    assert (row["row_count"], row["column_count"], row["simulated_columns"]) == (4, 1, "sim_n")
    with pytest.raises(ValueError):
        cat.register({})
    marked = catalog.with_provenance(cat.frame("numbers"), {"sim_n": "SIMULATED"})
    assert catalog.provenance_of(marked).first()["provenance"] == "SIMULATED"


def test_incremental_staging_takes_new_files_once(spark, tmp_path):
    folder, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    columns = PIPE.splitlines()[0].split("|")
    (folder / "1.csv").write_text(PIPE)
    incremental.stage_new_files(spark, str(folder), columns, target, state)
    incremental.stage_new_files(spark, str(folder), columns, target, state)
    assert spark.read.parquet(target).count() == 3
    (folder / "2.csv").write_text(PIPE)
    incremental.stage_new_files(spark, str(folder), columns, target, state)
    assert spark.read.parquet(target).count() == 6


def test_incremental_quarantine(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.csv").write_text("CLM_ID|CLM_PMT_AMT\na|-1\nb|2\n")
    contract = Contract("c", unique_key=("CLM_ID",), non_negative=("CLM_PMT_AMT",))
    incremental.quarantine_new_rows(spark, str(folder), ["CLM_ID", "CLM_PMT_AMT"], contract, str(tmp_path / "q"), str(tmp_path / "s"))
    assert [(r["contract"], r["entity_key"]) for r in spark.read.parquet(str(tmp_path / "q")).collect()] == [("non_negative_money", "a")]
