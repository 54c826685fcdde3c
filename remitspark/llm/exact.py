"""Exact deduplication by skew-safe combining; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import folded, stored


def sha256_hex(body: Column) -> Column:
    return F.sha2(body, 256)


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 32,
    hot_share: int = 2000,
    digest: Callable[[Column], Column] = sha256_hex,
) -> DataFrame:
    """Group equal texts (A-Z folded, null as empty) and mark the row that stays.

    1. Each task combines the copies it reads (the aggregate's map side, keyed by digest, content and salt).
    2. The salted digest groups are merged: a group that holds a third of all rows is ``salts`` keys here.
    3. The winners of the salts are combined: at most ``salts`` rows for each content.

    The content is part of the key at every stage, so texts of equal digest never merge. The groups (no
    content any more) go back to the documents by a join on the digest. Groups that hold at least one row in
    ``hot_share`` are at most ``hot_share`` many; these are broadcast, so no task of the join gets more
    than that share of one key. Digests that stand for several contents, if any, are told apart by content.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of a
    group stays; a null doc_id is below any other. Of repeated rows with that doc_id exactly one is kept.
    Empty and null texts are one group. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), folded(F.col(text_col)).alias("body"))
    keyed = rows.select("doc_id", "body", digest(F.col("body")).alias("text_sha256"))
    salted = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    merged = salted.groupBy("text_sha256", "body", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    winners = merged.groupBy("text_sha256", "body").agg(F.max("top").alias("keep_id"), F.sum("n").alias("group_size"))
    groups = stored(winners.select("text_sha256", "keep_id", "group_size"))

    clashes = groups.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("text_sha256")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    if clashes.isEmpty():
        found = _placed(keyed.select("doc_id", "text_sha256"), groups, total, hot_share)
    else:
        clear = groups.join(clashes, "text_sha256", "left_anti")
        same = keyed.join(clashes, "text_sha256", "left_semi").join(winners, ["text_sha256", "body"])
        found = _placed(keyed.select("doc_id", "text_sha256").join(clashes, "text_sha256", "left_anti"), clear, total, hot_share)
        found = found.unionByName(same.select(found.columns))
    # rows that carry the id that stays are told apart by a number; the key holds the id, so no group meets in one task
    top = Window.partitionBy("text_sha256", "doc_id", "keep_id").orderBy("doc_id")
    nth = found.withColumn("nth", F.row_number().over(top))
    return nth.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256"
    )


def _placed(rows: DataFrame, groups: DataFrame, total: int, hot_share: int) -> DataFrame:
    """Each row with its group: the few hot groups by broadcast, all others by a shuffled join."""
    hot = groups.filter(F.col("group_size") * F.lit(hot_share) >= F.lit(total)).select(
        F.col("text_sha256").alias("hot_sha"), F.col("keep_id").alias("hot_keep"), F.col("group_size").alias("hot_size")
    )
    near = rows.join(F.broadcast(hot), F.col("text_sha256") == F.col("hot_sha"), "left")
    is_hot = F.col("hot_sha").isNotNull()
    # a row that is placed already gets a key of its own, so that it spreads
    spread = near.withColumn("at", F.when(is_hot, F.concat(F.lit("placed "), F.coalesce(F.col("doc_id").cast("string"), F.expr("uuid()")))).otherwise(F.col("text_sha256")))
    rest = groups.select(F.col("text_sha256").alias("at"), F.col("keep_id").alias("rest_keep"), F.col("group_size").alias("rest_size"))
    return spread.join(rest, "at", "left").select(
        "doc_id", "text_sha256",
        F.when(is_hot, F.col("hot_keep")).otherwise(F.col("rest_keep")).alias("keep_id"),
        F.when(is_hot, F.col("hot_size")).otherwise(F.col("rest_size")).alias("group_size"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows are told apart by doc_id and text; repeated rows leave one.
    """
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    id_col, text_col = options.pop("id_col", "doc_id"), options.pop("text_col", "text")
    flat = row.select("row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"))
    found = stored(exact_dedup(flat, **options))
    kept = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha"))
    digest = options.get("digest", sha256_hex)
    tagged = flat.select("row", "doc_id", digest(folded(F.col("text"))).alias("text_sha256"))
    one = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept["kept_id"]) & (tagged["text_sha256"] == kept["kept_sha"]), "left_semi")
    if found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")) & ~F.col("kept")).isEmpty():
        return one.select("row.*")
    # an id comes more than once with the same text: the first of those rows
    nth = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id"))
    return one.withColumn("nth", nth).filter("nth = 1").select("row.*")
