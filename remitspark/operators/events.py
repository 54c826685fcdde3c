"""Event-log work: building the log, ordering checks, point-in-time totals, process mining."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as m
from ..session import pin
from .ordering import number_in_group

#: Between two steps of a path's text, and the steps of a piece of it.
PATH_ARROW, PATH_BLOCK = " -> ", 10_000


def strongest_contributor(contributions: Mapping[str, str], fallback: str = "baseline") -> str:
    """SQL text: name of the largest contribution; ties go to the first name in alphabetical
    order, and when none is above zero the fallback is given."""
    names = sorted(contributions)
    best = f"greatest({', '.join(contributions[n] for n in names)})"
    whens = " ".join(f"when ({contributions[n]}) = {best} then '{n}'" for n in names)
    return f"case when coalesce({best} <= 0, true) then '{fallback}' {whens} end"


def number_events(events: DataFrame, case: str, order_by: Sequence[Column | str], out: str = "event_seq") -> DataFrame:
    """1..n inside each case, also when one case holds very many events."""
    return number_in_group(events, [case], order_by, out)


def event_timestamp(date: Column, seq: Column, start_hour: int = 7, step_minutes: int = 45) -> Column:
    """Working-day clock: the first event at ``start_hour``, each next one ``step_minutes`` later."""
    minutes = F.lit(start_hour * 60) + (seq - F.lit(1)) * F.lit(step_minutes)
    return F.timestamp_add("MINUTE", minutes.cast("int"), date.cast("timestamp_ntz"))


def timeline_rows(timeline: Mapping[str, tuple[int, str]]) -> Column:
    """The events of one row, as an array; dates that are missing are in it."""
    return F.array(
        *[
            F.struct(F.lit(kind).alias("event_type"), F.lit(rank).alias("rank"), F.col(column).cast("date").alias("event_date"))
            for kind, (rank, column) in timeline.items()
        ]
    )


def timeline_to_events(
    claims: DataFrame,
    case: str,
    timeline: Mapping[str, tuple[int, str]],
    extra: DataFrame | None = None,
    closing: tuple[str, int, int] | None = None,
) -> DataFrame:
    """One event row per non-null timeline date, plus extra rows and a closing event per case.

    ``timeline`` maps event type -> (rank within a day, date column). ``closing`` is (event type,
    rank, lag days after the case's last event). Output: case, event_type, event_date, rank, seq,
    event_ts.
    """
    log = claims.select(case, F.inline(timeline_rows(timeline))).where("event_date is not null")
    if extra is not None:
        log = log.unionByName(extra.select(case, "event_type", "rank", "event_date"))
    if closing is not None:
        kind, rank, lag = closing
        last = log.groupBy(case).agg(F.date_add(F.max("event_date"), lag).alias("event_date"))
        log = log.unionByName(last.select(case, F.lit(kind).alias("event_type"), F.lit(rank).alias("rank"), "event_date"))
    numbered = number_events(log, case, ["event_date", "rank", "event_type"])
    return numbered.withColumn("event_ts", event_timestamp(F.col("event_date"), F.col("event_seq")))


def number_in_array(df: DataFrame, events: str, closing: tuple[str, int, int] | None = None, out: str = "log") -> DataFrame:
    """The numbered log of a case from the array of its events (:func:`timeline_rows`), in the case's own row.

    Numbers, times and the closing event are those of :func:`timeline_to_events`, without an exchange of the events. For cases with few
    events, as a case is one array; ``out`` holds (event_type, event_date, event_seq, event_ts).
    """
    if closing is not None:
        kind, rank, lag = closing
        last = F.date_add(F.array_max(F.transform(events, lambda e: e["event_date"])), lag)
        closed = F.struct(F.lit(kind).alias("event_type"), F.lit(rank).alias("rank"), last.alias("event_date"))
        df = df.withColumn(events, F.when(F.size(events) > 0, F.concat(events, F.array(closed))).otherwise(F.col(events)))
    keys = lambda e: F.struct(e["event_date"].isNull().alias("undated"), e["event_date"].alias("event_date"), e["rank"].alias("rank"), e["event_type"].alias("event_type"))
    df = df.withColumn(out, F.sort_array(F.transform(events, keys)))
    numbered = lambda e, i: F.struct(
        e["event_type"].alias("event_type"), e["event_date"].alias("event_date"), (i + 1).alias("event_seq"), event_timestamp(e["event_date"], i + 1).alias("event_ts")
    )
    return df.withColumn(out, F.transform(out, numbered))


def not_increasing(events: DataFrame, case: str, seq: str, ts: str) -> DataFrame:
    """Events whose timestamp is not later than that of the event numbered one less in their case.

    Neighbours meet by (case, number), so a long case is spread over all tasks.
    """
    before = events.selectExpr(case, f"{seq} + 1 as {seq}", f"{ts} as _prev")
    return events.join(before, [case, seq]).where(F.col(ts) <= F.col("_prev")).select(*events.columns)


def sequence_gaps(events: DataFrame, case: str, seq: str) -> DataFrame:
    """Cases whose sequence numbers are not exactly 1..n."""
    stats = events.groupBy(case).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(seq).alias("lo"),
        F.max(seq).alias("hi"),
        F.count_distinct(seq).alias("different"),
    )
    return stats.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("different") != F.col("n")))


def totals_before_boundary(
    events: DataFrame, case: str, ts: str, kind: str, boundary: str, minutes: str
) -> DataFrame:
    """Per case: minutes and elapsed hours over events at or before its first boundary event.

    Events meet a one-row-per-case boundary table, are filtered, and only then summed. The sum
    combines before the shuffle and the join may split a hot case.
    """
    until = (
        events.where(F.col(kind) == boundary).groupBy(case).agg(F.expr(f"min({ts}) as _until"))
    )
    allowed = events.select(case, ts, minutes).join(until, case).where(F.col(ts) <= F.col("_until"))
    span = f"unix_micros(cast(max(_until) as timestamp)) - unix_micros(cast(min({ts}) as timestamp))"
    return allowed.groupBy(case).agg(
        F.expr(f"sum({minutes}) as touch_minutes"), F.expr(f"({span}) / 3600000000D as elapsed_hours")
    )


def path_fingerprints(events: DataFrame, case: str, order_by: Sequence[Column | str], kind: str) -> DataFrame:
    """(case, length, print_a, print_b): 128 bits of each case's ordered path of event types.

    A path is the set of its (place, type) pairs, so it is the exclusive-or of their hashes: that combines in any order and on the
    map side, and a case of a third of all events is many tasks, in the numbering (one range exchange) and here.
    """
    placed = number_in_group(events.select(case, *_columns(order_by), F.col(kind).alias("_k")), [case], order_by, "_place")
    return _printed(placed, case)


def _columns(order_by: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def _printed(placed: DataFrame, case: str) -> DataFrame:
    one = [F.xxhash64(F.lit(seed), "_place", "_k") for seed in (11, 23)]
    return placed.groupBy(case).agg(
        F.count(F.lit(1)).alias("length"), F.bit_xor(one[0]).alias("print_a"), F.bit_xor(one[1]).alias("print_b")
    )


def path_variants(events: DataFrame, case: str, order_by: Sequence[str], kind: str) -> DataFrame:
    """Ordered event path per case and how many cases follow it: (path, claims, share). Events without a type are no part of the text.

    Cases are counted by the fingerprint of their path; the text is put together for one case of each distinct path only,
    first within each range of the sorted events, then from these few pieces.
    """
    narrow = events.select(case, *order_by, F.col(kind).alias("_k"))
    placed = pin(number_in_group(narrow, [case], order_by, "_place"))
    counts = _printed(placed, case).groupBy("length", "print_a", "print_b").agg(F.count(F.lit(1)).alias("claims"), F.min(F.struct(F.col(case))).alias("_one"))
    counts = pin(counts.select("claims", F.col(f"_one.{case}").alias("_case")))
    total = counts.agg(F.sum("claims").alias("n"))
    # places are dense, so a block of places is a bounded group, also of a hot case
    block = F.floor((F.col("_place") - F.lit(1)) / F.lit(PATH_BLOCK)).alias("_block")
    chosen = placed.join(counts.select("_case"), F.col(case).eqNullSafe(F.col("_case")), "left_semi").where("_k is not null")
    pieces = chosen.groupBy(case, block).agg(_in_order("_place", "_k").alias("_text"))
    texts = pieces.groupBy(case).agg(_in_order("_block", "_text").alias("path"))
    found = counts.join(texts, F.col(case).eqNullSafe(F.col("_case")), "left")
    return found.select(F.coalesce("path", F.lit("")).alias("path"), "claims", (F.col("claims") / total.scalar()).alias("share"))


def _in_order(place: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, text))), lambda e: e[text]), PATH_ARROW)


def rework_funnel(events: DataFrame, case: str, kind: str, stages: Mapping[str, Sequence[str]]) -> DataFrame:
    """(stage, cases, share): distinct cases with at least one event of the stage's types."""
    per_case = events.groupBy(case).agg(
        *[F.bool_or(F.col(kind).isin(list(types))).alias(name) for name, types in stages.items()]
    )
    row = per_case.agg(
        F.count(F.lit(1)).alias("cases_total"), *[F.count_if(F.col(name)).alias(name) for name in stages]
    )
    return row.unpivot(["cases_total"], list(stages), "stage", "cases").withColumn(
        "share", F.col("cases") / F.nullif(F.col("cases_total"), F.lit(0))
    )


def bottlenecks(events: DataFrame, activity: str, minutes: str) -> DataFrame:
    """Minutes per activity, activities without minutes left out."""
    return (
        events.groupBy(activity)
        .agg(
            F.sum(minutes).alias("total_minutes"),
            F.avg(minutes).alias("mean_minutes"),
            F.count(minutes).alias("events"),
        )
        .where("total_minutes > 0")
    )


def automation_split(events: DataFrame, activity: str, automated: str = "AUTOMATED") -> DataFrame:
    return events.agg(
        F.count_if(F.col(activity) == automated).alias("automated"),
        F.count_if(F.col(activity) != automated).alias("manual"),
    )


def minutes_by_activity(events: DataFrame, case: str, activity: str, minutes: str, activities: Sequence[str]) -> DataFrame:
    """Fixed-column pivot of minutes per case (missing activity -> 0) and event counts."""
    return events.groupBy(case).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(activity) == a, F.col(minutes))), F.lit(0)).alias(f"{a}_minutes")
            for a in activities
        ],
        *[F.count_if(F.col(activity) == a).alias(f"{a}_events") for a in activities],
    )


def operating_costs(pivoted: DataFrame, hourly_rates: Mapping[str, str], per_event: Mapping[str, str]) -> DataFrame:
    """Cost columns from pivoted minutes (rate per hour) and events (fee each), plus their total.

    Rates are decimal text, so the cents are exact.
    """
    parts: dict[str, Column] = {}
    for a, rate in hourly_rates.items():
        minutes = F.col(f"{a}_minutes").cast("decimal(18,4)")
        parts[f"{a}_cost"] = F.round(minutes * F.lit(rate).cast("decimal(10,2)") / F.lit(60).cast("decimal(4,0)"), 2)
    for a, fee in per_event.items():
        parts[f"{a}_fee"] = F.round(F.col(f"{a}_events").cast("decimal(18,0)") * F.lit(fee).cast("decimal(10,2)"), 2)
    priced = pivoted.select("*", *[c.cast("decimal(18,2)").alias(n) for n, c in parts.items()])
    total = None
    for n in parts:
        total = F.col(n) if total is None else total + F.col(n)
    return priced.withColumn("total_cost", total.cast("decimal(20,2)"))


def activity_shares(events: DataFrame, activity: str) -> DataFrame:
    counts = events.groupBy(activity).agg(F.count(F.lit(1)).alias("events"))
    total = counts.agg(F.sum("events").alias("n"))
    return counts.withColumn("_t", total.scalar()).selectExpr(
        activity, "events", f"{m.count_ratio('events', '_t', 6)} as share"
    )
