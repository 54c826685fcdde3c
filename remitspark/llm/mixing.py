"""Mixing sources to target weights: random order, prefix sums, a cut at each source's budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored
from .running import prefix_sums

#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A string that sorts as the source by code point, null last."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = 3,
    share: float = 1.0,
    seed: int = 17,
) -> DataFrame:
    """How many words of each document a mix of the given weights takes.

    The mix has ``share`` of all words. A source's target is its weight's part, but no more than ``most`` times its
    own words; what is over goes to the others by weight until none is above. The documents of a source are put in the
    order of a hash of their id, prefix sums of their words are taken in that order, and the source is cut at its
    budget (the target, rounded): whole epochs first, then the documents before the cut, and of the one
    at the cut the words that are missing.

    Returns one row per input row: doc_id, size, source_size, target, taken, plus source. Null and empty texts have size
    0 and take 0; null sources are one source, the last. Repeated rows count each on their own; rows with equal id
    and size are interchangeable. Reruns agree. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    return _mix(plain, weights, most, share, seed)


def _mix(plain: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, share: float = 1.0, seed: int = 17, ties: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` of (doc_id, text, source); the columns ``ties`` order rows of equal id and size and are in the result."""
    sized = plain.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        *ties,
    ).withColumns({"_g": source_key(F.col("source")), "_key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")))})
    ordered = prefix_sums(sized, "_g", ["_key", "doc_id", "size", *ties], "size")
    # the prefix sums stand on stored rows, so the totals below read those and not the texts again
    targets = source_targets(ordered, weights, most, share)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
    return ordered.join(targets, "_g").select(
        "doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"), "source", *ties,
    )


def source_targets(rows: DataFrame, weights: tuple[int, ...], most: int, share: float) -> DataFrame:
    """Words and target of each source (_g, source_size, target); its loop sends two sums to the driver."""
    totals = rows.groupBy("_g").agg(F.sum("size").alias("source_size")).withColumns({"_all": F.lit("x"), "_one": F.lit(1).cast("long")})
    ranked = prefix_sums(totals, "_all", ["_g"], "_one", out="rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("_g", "source_size", weight.alias("weight")))
    sums = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    total, capped, left = share * sums[0], 0.0, sums[1]
    cap = F.col("source_size") * float(most)
    while left > 0:
        above = cap < F.lit(total - capped) * F.col("weight") / F.lit(left)
        now = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(above, 0.0).otherwise(F.col("weight"))), F.lit(0.0))).first()
        if (now[0], now[1]) == (capped, left):
            break
        capped, left = now
    even = F.lit(total - capped) * F.col("weight") / F.lit(left) if left > 0 else cap
    return sources.select("_g", "source_size", F.when(cap < even, cap).otherwise(even).alias("target"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with all their columns: as many copies of each as it is taken whole, and one cut text
    (the first words, white space as it was) where the budget ends within it. Documents without words are not in it."""
    id_col, text_col, source_col = (options.get(f"{k}_col", v) for k, v in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    at = {"id": id_col, "text": text_col, "source": source_col}
    # the rows are stored with numbers of their own, by which what is taken of each comes back to it
    rows = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("row_id", F.monotonically_increasing_id()))
    plain = rows.select(*[F.col(f"row.`{v}`").alias(k) for k, v in (("doc_id", at["id"]), ("text", at["text"]), ("source", at["source"]))], "row_id")
    plain = plain.withColumn("digest", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    taken = _mix(plain, ties=("digest", "row_id"), **{k: v for k, v in options.items() if not k.endswith("_col")})
    joined = rows.join(taken.filter("taken > 0").select("row_id", "size", "taken"), "row_id")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    over = (F.col("taken") % F.col("size")).cast("int")
    pieces = joined.withColumn("words", F.explode(F.concat(F.array_repeat(F.col("size").cast("int"), copies), F.when(over > 0, F.array(over)).otherwise(F.array().cast("array<int>")))))
    text = F.col(f"row.{text_col}")
    # a part is the white space before a word and the word; the first n parts are the first n words
    parts = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    cut = F.array_join(F.slice(parts, 1, F.col("words")), "")
    changed = F.when(F.col("words") < F.col("size"), cut).otherwise(text)
    return pieces.withColumn("new", changed).select(*[F.col("new").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
