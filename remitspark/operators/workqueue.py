"""Expected-recovery work queues: score, policy tiers, ranked positions, rule comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_long
from ..functions.inline import literal, values_frame
from .ordering import with_position
from .relational import month_snapshots

# Tiers in queue order and the action each one recommends.
TIERS = {
    "DEADLINE_CRITICAL": "File now — appeal window closing.",
    "MANDATORY_REVIEW": "Human review required by policy before any write-off.",
    "VALUE": "Appeal — expected recovery exceeds the cost of working it.",
    "BELOW_COST": "Do not appeal on value grounds; expected recovery below cost.",
    "EXPIRED": "Appeal window has closed. Do not work; write off or escalate.",
}


@dataclass(frozen=True)
class Economics:
    """The assumptions behind the score and the tiers."""

    processing_cost: float = 45.0
    recovery_ratio: float = 0.8
    filing_window_days: int = 120
    critical_days: int = 14
    mandatory_categories: Sequence[str] = ("MEDICAL_NECESSITY", "ELIGIBILITY_COVERAGE", "COORDINATION_BENEFITS")


def recovery_ratio(df: DataFrame, recovered: str, denied: str, won: str) -> float:
    """Mean recovered/denied over won rows with a non-zero denied amount."""
    value = df.where(F.col(won)).agg(
        F.expr(f"avg(cast({recovered} as double) / nullif(cast({denied} as double), 0D)) as r")
    ).first()["r"]
    if value is None:
        raise ValueError("no won rows; the recovery ratio cannot be estimated")
    return float(value)


def score_sql(probability: str, amount: str, e: Economics) -> str:
    """SQL text of the expected net recovery."""
    return f"{probability} * cast({amount} as double) * {e.recovery_ratio!r}D - {e.processing_cost!r}D"


def tier_sql(days_left: str, category: str, net: str, e: Economics) -> str:
    """SQL text of the tier. Deadline beats mandatory review; only VALUE can fall to BELOW_COST."""
    mandatory = ", ".join(literal(c) for c in e.mandatory_categories) or "null"
    return (
        f"case when {days_left} < 0 then 'EXPIRED' "
        f"when {days_left} <= {e.critical_days} then 'DEADLINE_CRITICAL' "
        f"when {category} in ({mandatory}) then 'MANDATORY_REVIEW' "
        f"when {net} <= 0 then 'BELOW_COST' else 'VALUE' end"
    )


def score_claims(
    df: DataFrame,
    key: str,
    probability: str,
    amount: str,
    review_date: str,
    category: str,
    e: Economics,
    as_of: str | None = None,
) -> DataFrame:
    """Scored and tiered rows without positions.

    ``as_of`` is SQL text of the snapshot date; without it every row is triaged on arrival, with
    the whole filing window ahead.
    """
    left = (
        f"{e.filing_window_days}"
        if as_of is None
        else f"datediff(date_add({review_date}, {e.filing_window_days}), {as_of})"
    )
    names = ", ".join(f"'{t}', {i}" for i, t in enumerate(TIERS))
    actions = ", ".join(f"{literal(t)}, {literal(a)}" for t, a in TIERS.items())
    carried = [c for c in df.columns if c not in (key, probability, amount, category)]
    return (
        df.selectExpr(
            key,
            f"{probability} as sim_p_overturn",
            f"cast({amount} as double) as sim_recoverable_amt",
            f"{probability} * cast({amount} as double) * {e.recovery_ratio!r}D as sim_expected_recovery_amt",
            f"{score_sql(probability, amount, e)} as sim_expected_net_recovery",
            f"cast({left} as int) as sim_days_to_deadline",
            f"{category} as sim_denial_category",
            *carried,
        )
        .withColumn("tier", F.expr(tier_sql("sim_days_to_deadline", "sim_denial_category", "sim_expected_net_recovery", e)))
        .selectExpr(
            "*", f"map({names})[tier] as tier_rank", f"map({actions})[tier] as recommended_action"
        )
    )


def queue_order(key: str) -> list:
    """Tier first; inside the deadline tier the fewest days, elsewhere the most money; then the key."""
    within = F.expr(
        "if(tier = 'DEADLINE_CRITICAL', cast(sim_days_to_deadline as double), -sim_expected_net_recovery)"
    )
    return [F.col("tier_rank"), within, F.col(key)]


def work_queue(
    df: DataFrame,
    key: str,
    probability: str,
    amount: str,
    review_date: str,
    category: str,
    e: Economics,
    as_of: str | None = None,
) -> DataFrame:
    """The ranked queue with ``queue_position`` 1..n and the snapshot date."""
    scored = score_claims(df, key, probability, amount, review_date, category, e, as_of)
    placed = with_position(scored, queue_order(key), "queue_position")
    if as_of is not None:
        return placed.selectExpr("*", f"cast({as_of} as date) as as_of")
    return placed.withColumn("as_of", df.agg(F.expr(f"cast(max({review_date}) as date)")).scalar())


def outranked_tiers(queue: DataFrame) -> DataFrame:
    """Tier boundaries that are broken: some earlier-tier row sits after a later-tier row. Empty = good."""
    ends = queue.groupBy("tier_rank").agg(
        F.expr("min(queue_position) as first_pos"), F.expr("max(queue_position) as last_pos")
    )
    return ends.selectExpr("*", "lead(first_pos) over (order by tier_rank) as next_first").where(
        "last_pos > next_first"
    )


def monthly_queue_rows(
    df: DataFrame, key: str, probability: str, amount: str, review_date: str, category: str, e: Economics
) -> DataFrame:
    """Scored rows of every month-start snapshot on which a row is open."""
    bounds = df.agg(F.expr(f"min({review_date}) as lo"), F.expr(f"max({review_date}) as hi"))
    opened = month_snapshots(
        df, review_date, e.filing_window_days, bounds.select("lo").scalar(), bounds.select("hi").scalar()
    )
    return score_claims(opened, key, probability, amount, review_date, category, e, "as_of")


def deadline_pressure(snapshots: DataFrame, key: str) -> DataFrame:
    """(tier, appearances, claims): row appearances over all snapshots and distinct rows per tier."""
    per_row = snapshots.groupBy("tier", key).agg(F.expr("count(1) as n"))
    return per_row.groupBy("tier").agg(F.expr("sum(n) as appearances"), F.expr("count(1) as claims"))


def compare_rules(
    df: DataFrame, key: str, rules: Mapping[str, str], dollars: str, share: float, seed: int = 1337
) -> DataFrame:
    """(rule, queue_rows, worked, captured, total, share) at a capacity share, one row per rule.

    ``rules`` maps a name to the SQL of its score. Ties are broken by the same seeded hash for all.
    """
    items = ", ".join(f"struct({literal(n)} as rule, cast({sql} as double) as score)" for n, sql in rules.items())
    long = df.selectExpr(key, f"coalesce({dollars}, 0) as dollars", f"inline(array({items}))").withColumn(
        "_tie", hash_long(seed, key)
    )
    # all rules are put in order at once; a rule's rows start where the rule before it ends
    placed = with_position(long, ["rule", F.col("score").desc_nulls_last(), "_tie", key], "_pos")
    ends = placed.groupBy("rule").agg(F.expr("min(_pos) as _first"), F.expr("count(1) as _n"))
    flagged = placed.join(ends, "rule").selectExpr(
        "rule", "dollars", f"_pos - _first + 1 <= greatest(1, bround(_n * {share}D)) as in_top"
    )
    return flagged.groupBy("rule").agg(
        F.expr("count(1) as queue_rows"),
        F.expr("count_if(in_top) as worked"),
        F.expr("coalesce(sum(if(in_top, dollars, 0)), 0) as captured"),
        F.expr("coalesce(sum(dollars), 0) as total"),
    ).selectExpr("*", "if(total > 0, cast(captured as double) / cast(total as double), null) as share")


# Where an overturn probability came from.
PROBABILITY_SOURCES = ("caller", "shipped_score", "category_rule", "book_rate")


def resolve_probability(
    requests: DataFrame, shipped: DataFrame, category_rates: DataFrame, key: str, category: str, given: str
) -> DataFrame:
    """First known of: given value, shipped score of the row, category rate, mean of category rates.

    ``shipped`` holds (key, p_shipped); ``category_rates`` (category, p_category).
    """
    book = category_rates.agg(F.expr("avg(p_category) as b"))
    joined = requests.join(shipped, key, "left").join(category_rates, category, "left").withColumn("_book", book.scalar())
    names = [literal(s) for s in PROBABILITY_SOURCES]
    return joined.selectExpr(
        *requests.columns,
        f"coalesce({given}, p_shipped, p_category, _book, 0D) as probability",
        f"case when {given} is not null then {names[0]} when p_shipped is not null then {names[1]} "
        f"when p_category is not null then {names[2]} else {names[3]} end as probability_source",
    )


def page(queue: DataFrame, limit: int = 50, offset: int = 0, tier: str | None = None) -> DataFrame:
    """One page of the queue in shipped order (the limit is the feature)."""
    rows = queue if tier is None else queue.where(F.upper(F.col("tier")) == tier.upper())
    return rows.orderBy("tier_rank", "queue_position").offset(offset).limit(limit)


def tier_counts(queue: DataFrame, column: str = "tier") -> DataFrame:
    return queue.groupBy(F.col(column).cast("string").alias(column)).agg(F.expr("count(1) as n"))


def empty_tiers(queue: DataFrame) -> DataFrame:
    """Counts for every tier, also those without rows."""
    spine = values_frame(queue.sparkSession, [(t,) for t in TIERS], "tier string")
    return spine.join(tier_counts(queue), "tier", "left").selectExpr("tier", "coalesce(n, 0) as n")
