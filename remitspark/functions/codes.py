"""Fixed code tables. These values must be these exact ones for results to agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .inline import literal, values_frame

# Feature -> (worklist reason code, analyst action).
REASON_CODES = {
    "sim_auth_missing": ("AUTH-01", "Obtain prior authorization before submitting."),
    "sim_auth_required": ("AUTH-02", "Confirm the payer's authorization requirement for this service."),
    "sim_auth_obtained_late": ("AUTH-03", "Authorization post-dates the service; attach the retro-auth."),
    "sim_auth_obtained": ("AUTH-04", "Authorization on file; verify it covers the billed service."),
    "sim_auth_decision_lead_days": ("AUTH-05", "Check the authorization decision date against the service."),
    "sim_eligibility_failed": ("ELIG-01", "Re-verify coverage and correct the payer/plan on the claim."),
    "sim_eligibility_checked": ("ELIG-02", "Run an eligibility check before submitting."),
    "sim_secondary_payer_present": ("ELIG-03", "Confirm coordination of benefits and primary/secondary order."),
    "sim_documentation_complete": ("DOC-01", "Complete the clinical documentation package."),
    "sim_documentation_score": ("DOC-02", "Documentation is thin for this service; request the missing notes."),
    "sim_coder_query_outstanding": ("COD-01", "Resolve the open coder query before release."),
    "sim_coding_specificity_deficit": ("COD-02", "Code to the specificity the payer expects."),
    "sim_coding_complexity_score": ("COD-03", "Complex coding; route for a second-level coding review."),
    "sim_duplicate_submission_flag": ("DUP-01", "Check for an earlier submission of the same encounter."),
    "sim_late_filing_flag": ("TFL-01", "Past the filing limit; escalate before submitting."),
    "sim_filing_headroom_days": ("TFL-02", "Filing window is nearly consumed; submit now."),
    "sim_filing_use_ratio": ("TFL-02", "Filing window is nearly consumed; submit now."),
    "sim_days_service_to_submission": ("TFL-03", "Long service-to-submission lag; check the billing hold."),
    "sim_filing_limit_days": ("TFL-04", "Short contractual filing limit on this payer."),
    "sim_coding_lag_days": ("WFL-01", "Coding-to-submission backlog on this claim."),
    "sim_pre_submission_touch_minutes": ("WFL-02", "Unusual pre-submission handling effort; review the account."),
    "sim_coding_to_submission_hours": ("WFL-03", "Long pre-submission cycle time; check for a work queue hold."),
    "sim_payer_id": ("PAY-01", "Payer-specific risk; apply that payer's edit checklist."),
    "sim_payer_prior_denial_rate": ("PAY-02", "This payer denies at an elevated rate historically."),
    "sim_payer_prior_claims": ("PAY-03", "Limited history with this payer; treat the rate as uncertain."),
    "sim_provider_prior_denial_rate": ("PRV-01", "Provider's recent denial rate is elevated; coach the front end."),
    "sim_provider_prior_claims": ("PRV-02", "Little history for this provider; treat the rate as uncertain."),
    "sim_service_line_id": ("SVC-01", "Service-line risk; apply the line's pre-bill edits."),
    "sim_service_line_prior_denial_rate": ("SVC-02", "Service line denies at an elevated rate (weak signal here)."),
    "sim_service_line_prior_claims": ("SVC-03", "Thin service-line history; treat the rate as uncertain."),
    "sim_overall_prior_denial_rate": ("BOOK-01", "Book-wide denial rate at the time of submission."),
    "billed_charge_amt": ("CHG-01", "High-dollar claim; route for pre-bill review."),
    "log_billed_charge_amt": ("CHG-01", "High-dollar claim; route for pre-bill review."),
    "drg_cd": ("DRG-01", "DRG-specific risk; check DRG-to-documentation alignment."),
    "length_of_stay_days": ("LOS-01", "Length of stay is atypical for this DRG; verify the stay."),
    "diagnosis_count": ("DX-01", "Diagnosis count is atypical; confirm the coded diagnoses."),
    "patient_age_years": ("DEM-01", "Age-related coverage rule; verify benefit applicability."),
    "provider_state_cd": ("GEO-01", "Provider state; check state-specific payer policy."),
    "sim_submission_month": ("SEA-01", "Seasonal submission effect; no claim-level action."),
}

# Denial code label table.
CARC_LABELS = {
    "16": "Missing or incomplete documentation",
    "18": "Duplicate claim or service",
    "22": "Coordination of benefits — other payer primary",
    "27": "Coverage terminated or not in effect",
    "29": "Timely filing limit exceeded",
    "50": "Not medically necessary",
    "96": "Non-covered service",
    "97": "Payment bundled into another service",
    "181": "Invalid or non-specific coding",
    "197": "Prior authorization absent or invalid",
}

# Two-digit SSA state code -> postal state.
SSA_POSTAL = {
    "01": "AL",
    "02": "AK",
    "03": "AZ",
    "04": "AR",
    "05": "CA",
    "06": "CO",
    "07": "CT",
    "08": "DE",
    "09": "DC",
    "10": "FL",
    "11": "GA",
    "12": "HI",
    "13": "ID",
    "14": "IL",
    "15": "IN",
    "16": "IA",
    "17": "KS",
    "18": "KY",
    "19": "LA",
    "20": "ME",
    "21": "MD",
    "22": "MA",
    "23": "MI",
    "24": "MN",
    "25": "MS",
    "26": "MO",
    "27": "MT",
    "28": "NE",
    "29": "NV",
    "30": "NH",
    "31": "NJ",
    "32": "NM",
    "33": "NY",
    "34": "NC",
    "35": "ND",
    "36": "OH",
    "37": "OK",
    "38": "OR",
    "39": "PA",
    "40": "PR",
    "41": "RI",
    "42": "SC",
    "43": "SD",
    "44": "TN",
    "45": "TX",
    "46": "UT",
    "47": "VT",
    "48": "VI",
    "49": "VA",
    "50": "WA",
    "51": "WV",
    "52": "WI",
    "53": "WY",
}


def carc_labels(spark: SparkSession) -> DataFrame:
    return values_frame(spark, list(CARC_LABELS.items()), "carc_code string, category_label string")


def postal_state(ssa: str) -> str:
    """SQL text: postal state of an SSA code column, null when unknown."""
    pairs = ", ".join(f"{literal(code)}, {literal(state)}" for code, state in SSA_POSTAL.items())
    return f"try_element_at(map({pairs}), lpad(cast(try_cast({ssa} as int) as string), 2, '0'))"


def reason_table(spark: SparkSession) -> DataFrame:
    rows = [(f, code, action) for f, (code, action) in REASON_CODES.items()]
    return values_frame(spark, rows, "feature string, sim_reason_code string, sim_analyst_action string")
