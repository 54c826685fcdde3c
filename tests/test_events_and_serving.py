import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from remitspark.functions import scalars as s
from remitspark.functions.hashing import hash_fold, hash_unit
from remitspark.operators import checks, events, serving


def d(text):
    return dt.date.fromisoformat(text)


def log(spark):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    return spark.createDataFrame(
        [("a", 1, t(7), "CODED", 10.0), ("a", 2, t(9, 30), "SUBMITTED", 5.0), ("a", 3, t(11), "DENIED", 60.0),
         ("a", 4, t(12), "SUBMITTED", 7.0), ("b", 1, t(7), "CODED", 3.0), ("c", 1, t(8), "SUBMITTED", 2.0), ("c", 2, t(8), "CODED", 1.0)],
        "case_id string, seq int, ts timestamp_ntz, kind string, minutes double",
    )


def test_totals_stop_at_the_first_boundary(spark):
    got = {r["case_id"]: (r["touch_minutes"], r["elapsed_hours"]) for r in
           events.totals_before_boundary(log(spark), "case_id", "ts", "kind", "SUBMITTED", "minutes").collect()}
    assert got == {"a": (15.0, 2.5), "c": (3.0, 0.0)}


def test_order_checks(spark):
    bad = events.not_increasing(log(spark), "case_id", "seq", "ts").collect()
    assert [(r["case_id"], r["seq"]) for r in bad] == [("c", 2)]
    gap = spark.createDataFrame([("x", 1), ("x", 3), ("y", 1), ("y", 1), ("z", 1), ("z", 2)], "c string, q int")
    assert sorted(r["c"] for r in events.sequence_gaps(gap, "c", "q").collect()) == ["x", "y"]


def test_timeline_becomes_a_numbered_log(spark):
    claims = spark.createDataFrame([(1, d("2024-01-02"), d("2024-01-02"), None)], "k int, coded date, sent date, paid date")
    rows = events.timeline_to_events(
        claims, "k", {"CODED": (1, "coded"), "SENT": (2, "sent"), "PAID": (3, "paid")}, closing=("CLOSED", 9, 3)
    ).orderBy("event_seq").collect()
    assert [(r["event_type"], r["event_seq"], str(r["event_ts"])) for r in rows] == [
        ("CODED", 1, "2024-01-02 07:00:00"), ("SENT", 2, "2024-01-02 07:45:00"), ("CLOSED", 3, "2024-01-05 08:30:00"),
    ]


def test_events_numbered_in_their_case_are_those_of_the_log(spark):
    days = [None, "2024-01-02", "2024-01-02", "2024-01-09", None, "2024-03-01"]
    rows = [(i // 2, *[d(x) if x else None for x in (days[i % 6], days[(i // 3) % 6], days[(i * 5 + 1) % 6])], i % 4 == 0) for i in range(40)]
    claims = spark.createDataFrame([*rows, (99, None, None, None, False), (98, None, None, None, True)], "k int, coded date, sent date, paid date, won boolean")
    timeline, closing = {"CODED": (2, "coded"), "SENT": (1, "sent"), "PAID": (2, "paid")}, ("CLOSED", 9, 3)
    extra = claims.where("won").select("k", F.inline(events.timeline_rows({"WON": (6, "paid")})))
    want = events.timeline_to_events(claims, "k", timeline, extra=extra, closing=closing)
    mine = F.concat(F.filter(events.timeline_rows(timeline), lambda e: e["event_date"].isNotNull()), F.when(F.col("won"), events.timeline_rows({"WON": (6, "paid")})).otherwise(F.array()))
    cases = claims.select("k", mine.alias("e")).groupBy("k").agg(F.flatten(F.collect_list("e")).alias("e"))
    got = events.number_in_array(cases, "e", closing).select("k", F.inline("log"))
    columns = ["k", "event_type", "event_date", "event_seq", "event_ts"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_process_mining(spark):
    v = {r["path"]: (r["claims"], r["share"]) for r in events.path_variants(log(spark), "case_id", ["seq"], "kind").collect()}
    assert v["CODED -> SUBMITTED -> DENIED -> SUBMITTED"] == (1, pytest.approx(1 / 3))
    f = {r["stage"]: r["cases"] for r in events.rework_funnel(log(spark), "case_id", "kind", {"rework": ["DENIED"], "any": ["CODED"]}).collect()}
    assert f == {"rework": 1, "any": 3}
    b = {r["kind"]: (r["total_minutes"], r["events"]) for r in events.bottlenecks(log(spark), "kind", "minutes").collect()}
    assert b["CODED"] == (14.0, 3)
    split = events.automation_split(log(spark), "kind", "CODED").first()
    assert (split["automated"], split["manual"]) == (3, 4)


def test_costs_from_minutes(spark):
    p = events.minutes_by_activity(log(spark), "case_id", "kind", "minutes", ["CODED", "DENIED"])
    got = {r["case_id"]: r for r in events.operating_costs(p, {"DENIED": "30.00"}, {"CODED": "1.50"}).collect()}
    assert got["a"]["DENIED_cost"] == Decimal("30.00") and got["a"]["total_cost"] == Decimal("31.50")
    assert got["c"]["DENIED_minutes"] == 0.0 and got["c"]["CODED_events"] == 1


def test_strongest_contributor(spark):
    sql = events.strongest_contributor({"b": "y", "a": "x"})
    df = spark.createDataFrame([(1, 2), (2, 2), (0, 0), (-1, -5), (None, None)], "x int, y int")
    assert [r["d"] for r in df.selectExpr(f"{sql} as d").collect()] == ["b", "a", "baseline", "baseline", "baseline"]


def test_rollup_sums_then_divides(spark):
    cols = ", ".join(f"{c} double" if c.endswith("amt") or "cost" in c else f"{c} long" for c in serving.SUMMED)
    base = {c: 0 for c in serving.SUMMED}
    def row(month, n, denied, days):
        r = {**base, "sim_claims_submitted": n, "sim_denied_claims": denied}
        return (month, days, *[float(v) if c.endswith("amt") or "cost" in c else v for c, v in r.items()])
    df = spark.createDataFrame([row("2024-01", 10, 5, 10.0), row("2024-02", 90, 9, 20.0), row("2024-03", 50, 0, None)],
                               f"sim_submission_year_month string, sim_avg_days_to_payment double, {cols}")
    r = serving.executive_rollup(df).first()
    assert (r["sim_period_from"], r["sim_period_to"], r["sim_claims_submitted"]) == ("2024-01", "2024-03", 150)
    assert r["sim_denial_rate"] == Decimal("0.093333") and r["sim_avg_days_to_payment"] == Decimal("19.00")
    assert r["sim_net_collection_rate"] == 0 and serving.control_totals(df).first()["sim_months"] == 3


def test_two_book_rates_differ(spark):
    root = spark.createDataFrame([("A", 100, 50), ("B", 1, 1), ("C", 0, 0)], "sim_denial_category string, sim_claims_appealed long, sim_claims_overturned long")
    r = serving.book_overturn_rates(serving.category_overturn_rates(root)).first()
    assert r["mean_of_category_rates"] == 0.75 and r["pooled_rate"] == pytest.approx(51 / 101)


def test_thin_months_become_bands(spark):
    months = [("2020-01-01", 2), ("2020-02-01", 3), ("2020-03-01", 100), ("2020-04-01", 110), ("2020-05-01", 90), ("2020-06-01", 100),
              ("2020-07-01", 100), ("2020-09-01", 1), (None, 1)]
    df = spark.createDataFrame(months, "m string, n int").withColumn("m", F.to_date("m"))
    got = sorted((str(r["start"]), str(r["end"])) for r in serving.thin_months(df, "m", "n").collect())
    assert got == [("2020-01-01", "2020-03-03"), ("2020-09-01", "2020-10-02")]


def test_reasons_keep_order_and_limit(spark):
    df = spark.createDataFrame([(1, True, False, True, None), (2, False, True, False, None)],
                               "k int, sim_auth_missing boolean, sim_documentation_complete boolean, sim_duplicate_submission_flag boolean, sim_late_filing_flag boolean")
    got = {r["k"]: [x["code"] for x in r["reasons"]] for r in serving.reason_codes(df, 2).collect()}
    assert got == {1: ["AUTH-01", "DOC-01"], 2: []}
    freq = {r["code"]: r["claims"] for r in serving.reason_frequency(serving.reason_codes(df), "k").collect()}
    assert freq == {"AUTH-01": 1, "DOC-01": 1, "DUP-01": 1}


def test_lookup_prefers_the_natural_id(spark):
    df = spark.createDataFrame([(7, "9", "x"), (9, "c9", "y")], "claim_sk long, clm_id string, sim_facility_name string")
    assert serving.lookup_claim(df, "9").first()["claim_sk"] == 7
    assert serving.lookup_claim(df, "c9").first()["claim_sk"] == 9
    assert serving.lookup_claim(df, "nope'").isEmpty()
    rec = serving.claim_record(serving.lookup_claim(df, "c9")).first()
    assert json.loads(rec["claim"]) == {"claim_sk": 9, "clm_id": "c9"} and json.loads(rec["facility_display"]) == {"sim_facility_name": "y"}


def test_imputation_and_unknown_features(spark):
    df = spark.createDataFrame([(1, 5, None)], "request_id int, a int, b int")
    r = serving.imputation_report(df, ["a", "b", "c"]).first()
    assert (r["supplied_count"], r["imputed_count"], r["imputed_features"]) == (1, 2, ["b", "c"])
    with pytest.raises(ValueError):
        serving.imputation_report(df, ["a"])


def test_monitoring_rows(spark):
    df = spark.createDataFrame([("2024-01", "f", 0.5, 3), ("bad", "f", 0.1, 1), ("2024-02", "g", 0.1, 1), ("2024-03", "f", None, 1)],
                               "sim_submission_year_month string, feature_name string, sim_metric_value double, sim_n_claims int")
    assert [str(r["month"]) for r in serving.monitored_series(df, "f").orderBy("month").collect()] == ["2024-01-01", "2024-03-01"]
    usable, reason = serving.usable_monitoring(df)
    assert usable.count() == 3 and reason == ""
    assert serving.usable_monitoring(df.drop("feature_name"))[0] is None and serving.usable_monitoring(None)[1]


def test_bands_status_json_and_small_helpers(spark):
    df = spark.createDataFrame([(0.05,), (0.06,), (0.2,), (0.9,), (None,)], "p double")
    assert [r["b"] for r in df.selectExpr(f"{serving.risk_band('p')} as b").collect()] == ["low", "moderate", "elevated", "high", None]
    a = spark.createDataFrame([(False, False, False), (True, True, True), (True, False, True), (True, False, False)],
                              "sim_auth_required boolean, sim_auth_missing boolean, sim_auth_obtained_late boolean")
    assert [r["s"] for r in a.selectExpr(f"{serving.auth_status_sql()} as s").collect()] == ["not_required", "required_missing", "obtained_late", "obtained_ontime"]
    j = serving.metrics_json(spark.range(1).selectExpr("0.8D as ratio"), {"recovery_ratio": "ratio"})
    assert serving.json_metric(j, "sim_metrics_json", "$.recovery_ratio", "r").first()["r"] == 0.8
    n = spark.createDataFrame([("x", 1), ("x", 1), (None, 2), ("y", 3)], "c string, v int")
    top = serving.top_concentration(n, ["c"], 2).collect()
    assert (top[0]["c"], top[0]["n"], float(top[0]["share"])) == ("x", 2, 0.5) and top[1]["c"] is None
    assert [r["v"] for r in serving.nlargest(n, "v", 2, "c").collect()] == [3, 2]
    assert serving.two_measure_long(spark.range(1).selectExpr("'k' as k", "1 as a", "2 as b"), "k", ["a", "b"]).count() == 2


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(d("2024-02-29"), 7, "  ", "Ab-C_1", float("nan")), (None, 1234, "x", "q", float("inf"))], "d date, n int, t string, u string, f double")
    got = df.select(
        s.date_key(F.col("d")).alias("k"), s.date_from_key(s.date_key(F.col("d"))).alias("back"), s.zero_pad(F.col("n"), 3).alias("z"),
        s.blank_to_null(F.col("t")).alias("b"), s.normalise_name(F.col("u")).alias("m"),
        s.cut_points(F.col("n").cast("double"), [10.0], ["lo", "hi"]).alias("c"),
    ).collect()
    assert tuple(got[0]) == (20240229, d("2024-02-29"), "007", None, "abc1", "lo")
    assert tuple(got[1]) == (0, None, "1234", "x", "q", "hi")
    assert [r["f"] for r in s.scrub_non_finite(df).collect()] == [None, None]
    one = spark.range(1).select(
        s.expit(s.logit(F.lit(0.3))).alias("p"), s.age_years(F.lit("2000-01-01").cast("date"), F.lit("2024-01-01").cast("date")).alias("a"),
        s.inclusive_days(F.lit("2024-01-01").cast("date"), F.lit("2024-01-03").cast("date")).alias("i"), s.clip(F.lit(5.0), 0.0, 1.0).alias("c"),
        s.zscore(F.lit(3.0), F.lit(1.0), F.lit(0.0)).alias("z"), s.month_start_from_text(F.lit("nope")).alias("m"),
        s.same_text(F.lit(" dc "), "DC").alias("e"), s.day_to_date(s.day_number(F.lit("2024-01-01").cast("date"))).alias("r"),
    ).first()
    assert one["p"] == pytest.approx(0.3) and float(one["a"]) == 24.0 and one["i"] == 3 and one["c"] == 1.0
    assert one["z"] is None and one["m"] is None and one["e"] and one["r"] == d("2024-01-01")


def test_hash_draws_are_uniform_and_repeatable(spark):
    df = spark.range(20_000)
    a = df.select(F.avg(hash_unit(1, "id")), F.min(hash_unit(1, "id")), F.max(hash_unit(1, "id"))).first()
    assert abs(a[0] - 0.5) < 0.01 and 0 <= a[1] < 0.001 and 0.999 < a[2] < 1
    folds = [r["count"] for r in df.groupBy(hash_fold(5, 9, "id").alias("f")).count().collect()]
    assert len(folds) == 5 and min(folds) > 3700


def test_scorecard_rules(spark):
    rows = spark.createDataFrame(
        [("a", 9, 10, 1.0, "critical"), ("b", 0, 0, 0.0, "critical"), ("c", 3, 0, 0.0, "warning"), ("d", 1, 3, None, "info"), ("e", 10, 10, 1.0, "critical")],
        "check_id string, numerator long, denominator long, threshold_min double, severity string",
    )
    got = {r["check_id"]: (float(r["metric_value"]), r["pass_flag"]) for r in checks.scorecard(rows).collect()}
    assert got == {"a": (0.9, False), "b": (0.0, True), "c": (3.0, False), "d": (0.333333, None), "e": (1.0, True)}


def test_bands_and_directions(spark):
    df = spark.createDataFrame([(1, True), (1, True), (0, True), (0, False), (0, False), (1, False)], "y int, hi boolean")
    r = checks.directional_checks(df, "y", {"up": ("hi", "not hi", 0.3), "too much": ("hi", "not hi", 0.5)})
    assert {x["check_name"]: x["passed"] for x in r.collect()} == {"up": True, "too much": False}
    b = checks.band_checks(df, {"rate": ("avg(y)", 0.4, 0.6), "none": ("avg(if(y > 5, y, null))", 0.0, 1.0)})
    assert {x["check_name"]: x["passed"] for x in b.collect()} == {"rate": True, "none": False}
    assert checks.run_report(df, {"n": "count(1)"}).first()["n"] == 6
    assert checks.duplicate_surplus(df, ["y", "hi"]).first().asDict() == {"row_count": 6, "distinct_keys": 4, "surplus": 2}
