import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitspark.functions.codes import SSA_POSTAL, carc_labels, postal_state
from remitspark.operators import checks, crosswalk, star
from remitspark.operators import relational as rel
from remitspark.plans import views


def d(day):
    return dt.date(2024, 1, day)


LINES = "CLM_ID string, CLM_LINE_NUM int, PRVDR_NUM string, CLM_DRG_CD string, CLM_FROM_DT date, CLM_THRU_DT date, CLM_PMT_AMT double, ICD_DGNS_CD1 string, CLM_POA_IND_SW1 string, ICD_DGNS_CD2 string, CLM_POA_IND_SW2 string"


def lines(spark):
    return spark.createDataFrame(
        [
            ("c1", 1, "p1", "470", d(1), d(3), 10.123, "A00", "Y", "B01", None),
            ("c1", 2, "p1", "470", d(1), d(3), 10.123, "A00", "Y", "B01", None),
            ("c2", 1, None, " ", None, d(9), 5.0, "Z99", "N", " ", "N"),
        ],
        LINES,
    )


def test_star_from_three_lines(spark):
    raw = lines(spark)
    headers = star.claim_headers(raw, "CLM_ID", "CLM_LINE_NUM")
    providers = star.surrogate_dim(raw, "PRVDR_NUM", "provider_key")
    drgs = star.surrogate_dim(raw, "CLM_DRG_CD", "drg_key")
    fact = star.header_fact(
        headers, [(providers, "PRVDR_NUM", "provider_key"), (drgs, "CLM_DRG_CD", "drg_key")],
        [("CLM_FROM_DT", "from_date_key"), ("CLM_THRU_DT", "thru_date_key")], ["CLM_PMT_AMT"], ("CLM_FROM_DT", "CLM_THRU_DT"),
    )
    got = {r["CLM_ID"]: r for r in fact.collect()}
    assert len(got) == 2 and raw.count() == 3
    assert (got["c2"]["provider_key"], got["c2"]["drg_key"], got["c2"]["from_date_key"]) == (0, 0, 0)
    assert (got["c1"]["provider_key"], got["c1"]["drg_key"], got["c1"]["from_date_key"]) == (1, 1, 20240101)
    assert got["c1"]["length_of_stay_days"] == 3 and got["c2"]["length_of_stay_days"] is None
    assert got["c1"]["CLM_PMT_AMT"] == Decimal("10.12")
    dx = star.diagnosis_fact(headers, "CLM_ID", "ICD_DGNS_CD", "CLM_POA_IND_SW")
    assert sorted((r["CLM_ID"], r["dgns_seq"], r["icd_dgns_cd"]) for r in dx.collect()) == [("c1", 1, "A00"), ("c1", 2, "B01"), ("c2", 1, "Z99")]
    report = star.star_report(raw, headers, fact, dx, "CLM_PMT_AMT", ["provider_key", "drg_key"]).first()
    assert (report["claims"], report["raw_lines"], report["diagnoses"], report["unresolved_provider_key"]) == (2, 3, 3, 1)


def test_dimensions_have_one_unknown_and_dense_keys(spark):
    dim = star.surrogate_dim(lines(spark), "PRVDR_NUM", "provider_key")
    assert checks.unknown_member_once(dim, "provider_key").first()["passed"]
    many = spark.range(500).selectExpr("concat('n', lpad(id, 4, '0')) as n", "id % 3 as a", "id as o")
    keyed = star.surrogate_dim(many.unionAll(many), "n", "k", ["a"], ["o"]).orderBy("k").collect()
    assert [r["k"] for r in keyed] == list(range(501)) and [r["n"] for r in keyed[1:]] == sorted(r["n"] for r in keyed[1:])


def test_calendar(spark):
    cal = {r["date_key"]: r for r in star.calendar_dim([(lines(spark), ["CLM_FROM_DT", "CLM_THRU_DT"])]).collect()}
    assert set(cal) == {0, 20240101, 20240103, 20240109}
    assert (cal[20240101]["day_of_week"], cal[20240101]["day_name"], cal[20240101]["is_weekend"]) == (0, "Monday", False)
    assert cal[0]["full_date"] is None and cal[0]["is_weekend"] is None


def star_tables(spark):
    cal = star.calendar_dim([(lines(spark), ["CLM_FROM_DT", "CLM_THRU_DT"])])
    return {
        "claims": spark.createDataFrame(
            [(1, "c1", 1, 1, 1, 20240101, 20240103, "A00", "B01", Decimal("100.00"), Decimal("60.00")),
             (2, "c2", 0, 0, 0, 0, 20240109, None, "A00", Decimal("50.00"), Decimal("0.00"))],
            "claim_sk long, clm_id string, provider_key long, drg_key long, discharge_status_key long, admission_date_key int, "
            "discharge_date_key int, prncpal_dgns_cd string, admtg_dgns_cd string, billed_charge_amt decimal(14,2), medicare_source_paid_amt decimal(14,2)",
        ),
        "providers": spark.createDataFrame([(0, "UNKNOWN", None), (1, "p1", "05")], "provider_key long, prvdr_num string, provider_state_cd string"),
        "drgs": spark.createDataFrame([(0, "UNKNOWN"), (1, "470")], "drg_key long, drg_cd string"),
        "discharge_statuses": spark.createDataFrame([(0, "UNKNOWN"), (1, "01")], "discharge_status_key long, discharge_status_cd string"),
        "calendar": cal,
        "adjudication": spark.createDataFrame(
            [(1, "P", "L", d(5), d(7), d(20), None, 15, 2, False, Decimal("80.00"), Decimal("80.00"), Decimal("0.00"), False, "NONE", None, None, None),
             (2, "P", "L", d(9), d(11), None, d(12), None, 2, True, Decimal("40.00"), Decimal("10.00"), Decimal("30.00"), True, "PARTIAL", "CODING", "181", "coding")],
            "claim_sk long, sim_payer_id string, sim_service_line_id string, sim_submission_date date, sim_adjudication_date date, sim_payment_date date, "
            "sim_denial_review_date date, sim_days_to_payment int, sim_days_to_adjudication int, sim_late_filing_flag boolean, sim_allowed_amount decimal(14,2), "
            "sim_paid_amount decimal(14,2), sim_denied_amount decimal(14,2), sim_denial_flag boolean, sim_denial_type string, sim_denial_category string, "
            "sim_denial_carc_group string, sim_denial_driver_mechanism string",
        ),
        "payers": spark.createDataFrame([("P", "Payer P", 1.0, 90)], "sim_payer_id string, sim_payer_name string, sim_payer_mix_share double, sim_timely_filing_days int"),
        "service_lines": spark.createDataFrame([("L", "Line L")], "sim_service_line_id string, sim_service_line_name string"),
        "authorization": spark.createDataFrame([(1, True, False, None)], "claim_sk long, sim_auth_required boolean, sim_auth_missing boolean, sim_eligibility_failed boolean"),
        "documentation": spark.createDataFrame([(1, True, Decimal("0.90"), False, False, Decimal("1.00"))],
            "claim_sk long, sim_documentation_complete boolean, sim_documentation_score decimal(6,4), sim_duplicate_submission_flag boolean, "
            "sim_coding_specificity_deficit boolean, sim_coding_complexity_score decimal(6,4)"),
        "costs": spark.createDataFrame([(1, 0, 10), (2, 25, 40)], "claim_sk long, sim_denial_rework_cost int, sim_total_cost_to_collect int"),
        "facilities": spark.createDataFrame([("p1", "Real Hospital")], "prvdr_num string, sim_facility_name string"),
        "codes": spark.createDataFrame([("A00", "Cholera"), ("B01", "Varicella")], "code string, long_desc string"),
        "diagnoses": spark.createDataFrame([(1,), (1,), (2,)], "claim_sk long"),
        "appeals": spark.createDataFrame([(2, 1, "UPHELD", Decimal("0.00")), (2, 2, "OVERTURNED", Decimal("20.00"))],
            "claim_sk long, sim_appeal_level int, sim_appeal_outcome string, sim_appeal_recovered_amount decimal(14,2)"),
    }


def test_all_views_over_the_star(spark):
    e = views.enriched_claims(star_tables(spark)).cache()
    got = {r["claim_sk"]: r for r in e.collect()}
    assert len(got) == 2
    one, two = got[1], got[2]
    assert (one["prncpal_dgns_desc"], one["admtg_dgns_desc"], one["diagnosis_count"]) == ("Cholera", "Varicella", 2)
    assert one["admission_date"] == d(1) and two["admission_date"] is None and two["discharge_date"] == d(9)
    assert one["sim_clean_claim_flag"] and one["sim_first_pass_paid_flag"] and not one["sim_ar_open_flag"]
    assert not two["sim_clean_claim_flag"] and two["sim_ar_balance_amt"] == Decimal("30.0000")
    assert (two["sim_appeal_levels"], two["any_overturned"], two["recovered_amt"]) == (2, True, Decimal("20.00"))

    m = views.executive_monthly(e).first()
    assert (m["sim_claims_submitted"], m["sim_denied_claims"], m["sim_denial_rate"]) == (2, 1, Decimal("0.5000"))
    assert m["sim_net_collection_rate"] == Decimal("0.7500") and m["sim_avg_days_to_payment"] == Decimal("15.0")
    assert m["sim_appeal_overturn_rate"] == Decimal("1.0000") and m["sim_cost_to_collect_ratio"] == Decimal("0.5556")

    r = views.denial_root_cause(e, carc_labels(spark)).first()
    assert (r["sim_denial_count"], r["carc_category_label"], r["sim_share_of_denials"]) == (1, "Invalid or non-specific coding", Decimal("1.0000"))

    aging = {x["sim_aging_bucket"]: x for x in views.ar_aging(e).collect()}
    assert len(aging) == 5 and aging["0-30"]["sim_open_claims"] == 1 and aging["120+"]["sim_open_claims"] == 0
    assert aging["0-30"]["sim_max_days_outstanding"] == 11 and aging["120+"]["sim_min_days_outstanding"] is None

    p = views.payer_performance(e).first()
    assert (p["sim_claims"], p["sim_median_days_to_payment"], p["sim_realized_claim_share"]) == (2, 15.0, Decimal("1.0000"))
    q = {x["prvdr_num"]: x for x in views.provider_quality(e).collect()}
    assert q["p1"]["sim_display_facility_name"] == "Real Hospital" and q["UNKNOWN"]["low_volume_flag"]
    w = views.heuristic_queue(e).first()
    assert (w["claim_sk"], w["sim_action_type"], w["sim_priority_tier"]) == (2, "DENIAL_RESOLVED_MONITOR", 1)
    assert w["sim_heuristic_priority_score"] == pytest.approx(Decimal(str(round(30 * (1 + 11 / 365), 2))))
    drift = {x["feature_name"]: x for x in views.drift_monthly(e).collect()}
    assert len(drift) == 9 and drift["denial_rate"]["metric_kind"] == "outcome_rate"
    assert float(drift["auth_required_rate"]["sim_metric_value"]) == 0.5


def test_crosswalk_is_reproducible_and_falls_back(spark):
    ents = spark.createDataFrame([(i, "TX" if i % 2 else "ZZ", "acute") for i in range(40)], "e long, state string, kind string")
    pool = spark.createDataFrame([(i, "TX", "acute" if i < 3 else "other") for i in range(10)] + [(99, "CA", "acute")], "f long, state string, kind string")
    run = lambda seed: crosswalk.stratified_assignment(
        ents, pool, "e", "f", [("state+kind", ["state", "kind"]), ("state", ["state"]), ("nationwide", [])], seed
    )
    one = {r["e"]: (r["assigned"], r["match_rule"]) for r in run(1).collect()}
    assert one == {r["e"]: (r["assigned"], r["match_rule"]) for r in run(1).collect()}
    assert one != {r["e"]: (r["assigned"], r["match_rule"]) for r in run(2).collect()}
    assert all(v[1] == ("state+kind" if k % 2 else "nationwide") for k, v in one.items())
    assert all(v[0] < 3 for k, v in one.items() if k % 2)


def test_postal_states(spark):
    df = spark.createDataFrame([("01",), ("05",), ("53",), ("99",), ("x",), ("00",)], "s string")
    assert [r["p"] for r in df.selectExpr(f"{postal_state('s')} as p").collect()] == ["AL", "CA", "WY", None, None, None]
    assert len(SSA_POSTAL) == 53


def test_range_bucket_and_modal(spark):
    ranges = spark.createDataFrame([("A", 1, 50), ("B", 51, 51), ("C", 60, 999)], "l string, lo int, hi int")
    df = spark.createDataFrame([(1,), (50,), (51,), (55,), (999,), (None,), (-3,)], "c int")
    got = {r["c"]: r["b"] for r in rel.range_bucket(df, "c", ranges, "lo", "hi", "l", "b").collect()}
    assert got == {1: "A", 50: "A", 51: "B", 55: "UNKNOWN", 999: "C", None: "UNKNOWN", -3: "UNKNOWN"}
    m = spark.createDataFrame([("a", "y"), ("a", "x"), ("b", "z"), ("b", "z"), ("b", "a"), ("c", None)], "k string, v string")
    assert {r["k"]: r["mode"] for r in rel.modal_value(m, "k", "v").collect()} == {"a": "x", "b": "z"}


def test_bag_difference_and_equality(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (2,), (None,)], "x int")
    assert {r["x"]: r["excess"] for r in rel.bag_difference(a, b).collect()} == {1: 1, 2: -1}
    assert rel.same_bag(a, a.repartition(3)) and not rel.same_bag(a, b) and not rel.same_bag(a, a.selectExpr("cast(x as long) x"))


def test_relational_helpers(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string")
    with pytest.raises(ValueError):
        rel.checked_join(left, spark.createDataFrame([(1, 2), (1, 3)], "k int, v int"), "k")
    assert rel.checked_join(left, spark.createDataFrame([(1, 2)], "k int, v int"), "k").count() == 2
    with pytest.raises(ValueError):
        rel.project(left, ["k", "missing"])
    assert rel.drop_prefixed(left.withColumn("sim_x", F.lit(1)), ["sim_"], ["c"]).columns == ["k"]
    assert rel.orphans(left, left.where("k = 1"), "k", "k").count() == 1
    assert rel.matching(left, left.where("k = 1"), "k").count() == 1
    assert rel.key_difference(left, left.where("k = 1"), "k").first()["k"] == 2
    assert rel.rename_columns(left, {"k": "key"}).columns == ["key", "c"]
    kept = rel.keep_first(spark.createDataFrame([(1, 5, "x"), (1, 2, "y")], "k int, o int, v string"), ["k"], ["o"]).first()
    assert kept["v"] == "y"


def test_checks(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, -1.0, "a")], "k int, v double, s string")
    got = {r["check_name"]: r["violations"] for r in checks.violation_counts(df, {"neg": "v < 0", "null s": "s is null"}).collect()}
    assert got == {"neg": 1, "null s": 1}
    prof = {r["column_name"]: r for r in checks.null_profile(df).collect()}
    assert float(prof["s"]["null_rate"]) == 0.5 and prof["v"]["data_type"] == "double"
    drift = checks.profile_drift(checks.null_profile(df.drop("s").where("k = 1")), checks.null_profile(df))
    assert {(r["column_name"], r["deviation"]) for r in drift.collect()} == {("s", "column_removed"), ("*", "row_count_changed")}
    assert checks.table_fingerprint(df).first() == checks.table_fingerprint(df.repartition(3)).first()
    assert checks.keys_agree(df, df, "k").first()["passed"] and not checks.keys_agree(df, df.where("k = 1"), "k").first()["passed"]
    rep = checks.reconcile([("a", df.selectExpr("count(1) as v"), df.selectExpr("count(1) as v"), 0.0), ("b", None, df, 0.0)], spark)
    assert {r["check_name"]: r["status"] for r in rep.collect()} == {"a": "PASS", "b": "MISSING_INPUT"}
    assert checks.reconcile_summary(rep).first().asDict() == {"passed": 1, "failed": 0, "unevaluated": 1, "checks": 2}
    moved = checks.perturbation_lineage(df, "k", ["v"], lambda x: x.selectExpr("k", "v * 2 as w", "s"), {"v": "v + 1"})
    assert [(r["input_column"], r["column_name"], r["changed_rows"]) for r in moved.collect()] == [("v", "w", 2)]
    with pytest.raises(ValueError):
        checks.require_rows(df.where("false"), "empty")
