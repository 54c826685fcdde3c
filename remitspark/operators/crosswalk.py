"""Reproducible stratified assignment with fallback pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_long
from .ordering import number_in_group, with_position


def stratified_assignment(
    entities: DataFrame,
    pool: DataFrame,
    entity_key: str,
    pool_key: str,
    levels: Sequence[tuple[str, Sequence[str]]],
    seed: int = 1337,
) -> DataFrame:
    """Assign every entity a pool member from the narrowest level that has one.

    ``levels`` lists (rule name, shared columns) from narrow to wide; an empty column list is the
    whole pool. Members are numbered inside their pool, the entity's hash picks a number, and the
    two meet by (pool, number), so a large pool or many entities on one pool stay spread out.
    Adds ``assigned`` and ``match_rule``.
    """
    columns = [c for _, cols in levels for c in cols]
    members = pool.select(pool_key, *dict.fromkeys(columns)).distinct()
    drawn = entities.withColumn("_draw", hash_long(seed, entity_key))
    for i, (_, cols) in enumerate(levels):
        if cols:
            inside = members.where(" and ".join(f"{c} is not null" for c in cols))
            numbered = number_in_group(inside, list(cols), [pool_key], "_rank")
            sizes = inside.groupBy(*cols).agg(F.expr("count(1) as _size"))
            drawn = drawn.join(sizes, list(cols), "left")
        else:
            numbered = with_position(members, [pool_key], "_rank")
            drawn = drawn.withColumn("_size", members.agg(F.count(F.lit(1))).scalar())
        drawn = drawn.selectExpr("*", "pmod(_draw, nullif(_size, 0)) + 1 as _rank").drop("_size")
        picked = numbered.select(*cols, "_rank", F.col(pool_key).alias(f"_hit{i}"))
        drawn = drawn.join(picked, [*cols, "_rank"], "left").drop("_rank")
    hits = [f"_hit{i}" for i in range(len(levels))]
    rules = " ".join(f"when {h} is not null then '{name}'" for h, (name, _) in zip(hits, levels))
    return drawn.selectExpr(
        *entities.columns, f"coalesce({', '.join(hits)}) as assigned", f"case {rules} else 'none' end as match_rule"
    )
