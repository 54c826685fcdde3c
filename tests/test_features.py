import datetime as dt
from decimal import Decimal

import pytest

from remitspark.plans import roles
from remitspark.plans import features as f


def d(text):
    return dt.date.fromisoformat(text)


def tables(spark):
    t = lambda day, h: dt.datetime(2024, 1, day, h)
    return {
        "adjudication": spark.createDataFrame(
            [(1, "P", "L", d("2024-01-02"), d("2024-01-05"), 90, 10, False, False, Decimal("0.00")),
             (2, "P", "L", d("2024-02-02"), d("2024-06-05"), 90, 45, True, True, Decimal("30.00"))],
            "claim_sk long, sim_payer_id string, sim_service_line_id string, sim_coded_date date, sim_submission_date date, sim_filing_limit_days int, "
            "sim_days_service_to_submission int, sim_late_filing_flag boolean, sim_denial_flag boolean, sim_denied_amount decimal(14,2)",
        ),
        "authorization": spark.createDataFrame(
            [(1, True, True, False, False, True, False, False, d("2024-01-01")), (2, False, False, False, False, True, True, True, None)],
            "claim_sk long, sim_auth_required boolean, sim_auth_obtained boolean, sim_auth_missing boolean, sim_auth_obtained_late boolean, "
            "sim_eligibility_checked boolean, sim_eligibility_failed boolean, sim_secondary_payer_present boolean, sim_auth_decision_date date",
        ),
        "documentation": spark.createDataFrame(
            [(1, True, 0.9, False, False, 0.2, False), (2, False, 0.3, True, True, 0.8, False)],
            "claim_sk long, sim_documentation_complete boolean, sim_documentation_score double, sim_coder_query_outstanding boolean, "
            "sim_coding_specificity_deficit boolean, sim_coding_complexity_score double, sim_duplicate_submission_flag boolean",
        ),
        "claims": spark.createDataFrame([(1, 1, 1, 1, 20240101, 100.0, 3), (2, 1, 1, 1, 0, 50.0, None)],
            "claim_sk long, provider_key long, drg_key long, bene_key long, admission_date_key int, billed_charge_amt double, length_of_stay_days int"),
        "providers": spark.createDataFrame([(1, "p1", "05")], "provider_key long, prvdr_num string, provider_state_cd string"),
        "drgs": spark.createDataFrame([(1, "470")], "drg_key long, drg_cd string"),
        "beneficiaries": spark.createDataFrame([(1, d("1950-01-01"))], "bene_key long, birth_date date"),
        "calendar": spark.createDataFrame([(0, None), (20240101, d("2024-01-01"))], "date_key int, full_date date"),
        "diagnoses": spark.createDataFrame([(1,), (1,), (2,)], "claim_sk long"),
        "events": spark.createDataFrame(
            [(1, t(2, 7), "CODING_COMPLETE", 12.0), (1, t(2, 9), "CLAIM_SUBMITTED", 3.0), (1, t(9, 9), "DENIAL_REVIEWED", 60.0)],
            "claim_sk long, sim_event_ts timestamp_ntz, sim_event_type string, sim_touch_minutes double",
        ),
    }


def test_all_declared_inputs_are_built(spark):
    assert len(f.CLAIM_FEATURES.names) == len(set(f.CLAIM_FEATURES.names)) == 39
    df = f.submission_frame(f.submission_source(tables(spark)), f.CLAIM_FEATURES)
    assert df.columns == [*f.PASSTHROUGH, *f.CLAIM_FEATURES.names]
    one, two = df.orderBy("claim_sk").collect()
    assert (one["sim_pre_submission_touch_minutes"], one["sim_coding_to_submission_hours"]) == (15.0, 2.0)
    assert two["sim_pre_submission_touch_minutes"] is None
    assert float(one["patient_age_years"]) == 74.0 and two["patient_age_years"] is None
    assert (one["sim_filing_headroom_days"], two["sim_filing_use_ratio"]) == (80, 0.5)
    assert (one["sim_coding_lag_days"], one["sim_auth_decision_lead_days"], two["sim_submission_month"]) == (3, 4, "6")
    assert one["sim_overall_prior_denial_rate"] is None and two["sim_overall_prior_denial_rate"] == 0.0
    assert two["sim_payer_prior_claims"] == 1 and one["diagnosis_count"] == 2


def test_undeclared_or_missing_inputs_fail(spark):
    source = f.submission_source(tables(spark)).drop("birth_date")
    with pytest.raises(ValueError, match="patient_age_years"):
        f.submission_frame(source, f.CLAIM_FEATURES)


def test_triage_counts_only_decided_appeals(spark):
    rows = [
        (1, "P", "C", d("2023-01-01"), d("2023-01-20"), d("2023-01-25"), 100.0, 80.0, 40.0, True, True),
        (2, "P", "C", d("2023-01-02"), d("2023-01-20"), d("2023-01-25"), 100.0, 80.0, 40.0, True, None),
        (3, "P", "C", d("2023-12-01"), d("2023-12-20"), d("2023-12-29"), 0.0, 80.0, 40.0, True, False),
        (4, "P", None, d("2023-12-01"), None, None, 10.0, 8.0, 0.0, False, None),
    ]
    df = spark.createDataFrame(rows, "claim_sk long, sim_payer_id string, sim_denial_category string, sim_submission_date date, sim_adjudication_date date, "
        "sim_denial_review_date date, billed_charge_amt double, sim_allowed_amount double, sim_denied_amount double, sim_denial_flag boolean, any_overturned boolean")
    got = {r["claim_sk"]: r for r in f.triage_frame(df).collect()}
    assert set(got) == {1, 2, 3} and [got[i]["appealed"] for i in (1, 2, 3)] == [True, False, True]
    assert got[3]["sim_payer_prior_appeals"] == 1 and got[3]["sim_overall_prior_overturn_rate"] == 1.0
    assert got[1]["sim_denied_share_of_billed"] == 0.4 and got[3]["sim_denied_share_of_billed"] is None
    assert got[3]["sim_denial_review_lag_days"] == 9


def test_claims_need_no_set_for_each_claim(spark):
    lines = spark.createDataFrame(
        [(1, n) for n in (1, 2, 2)] + [(2, n) for n in (1, 65, 65, -1, None)] + [(3, None)], "claim_sk int, line_num int"
    ).selectExpr("*", *[f"1L as {c}" for c in ("part_key", "provider_key", "quantity", "billed_u", "allowed_u", "discount_pct", "tax_pct")], "date'2020-01-01' as ship_date", *[f"true as {c}" for c in ("is_denied", "is_appeal", "is_final")])
    got = roles.claim_measures(lines)
    assert {r["claim_sk"]: (r["distinct_lines"], r["line_count"]) for r in got.collect()} == {1: (2, 3), 2: (3, 5), 3: (0, 1)}
    plan = roles.claims(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [step for step in plan.splitlines() if "collect_set" in step and "billed_u" in step]
