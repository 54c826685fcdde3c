"""Filter interaction audit: one relation of failing keys for each filter, prefixes compared by left-anti and left-semi joins."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Groups of equal texts that hold at least one row in so many are joined by broadcast: at most this many rows.
HOT_SHARE = 2000
SPACES = r"[\x20\x09-\x0D]+"


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def filter_audit(base: DataFrame, failing: dict[str, DataFrame], lost: dict[str, DataFrame]) -> DataFrame:
    """What every filter does at every place of every order of the filters, by part.

    ``base`` has one row per document: key (unique, no nulls) and part. ``failing`` gives for each filter's letter the rows of ``base`` that
    fail it, ``lost`` names sets of keys whose removal is to be counted; in these, repeated keys and keys outside ``base`` tell nothing.

    A prefix of an order removes what its *set* of filters removes, so 2^k relations of survivors, not k! of them, hold all that is
    needed: those of a set with one filter more are a left-anti join with that filter's failing keys. Removals are the left-semi join
    of the survivors with the failing keys, redundancies the failing keys left-anti the removals, losses the removals left-semi a named
    set. Documents that fail no filter survive everywhere and are counted once. Every join is on the unique key, so no part,
    and no filter that fails a third of all rows, is a hot key.

    Returns part, filter_order, step (from 1), kept, removed, redundant, unique_fails, one column ``<name>_lost`` for each set, and shapley
    (the filter's removals summed over all orders). Parts without failures get zeros; an empty table gives no rows.
    """
    letters = list(failing)
    bit = {f: 1 << i for i, f in enumerate(letters)}
    k = len(letters)
    base = base.select("key", "part")
    # every step is written and read again: no plan holds more than a few joins, whatever the number of filters
    relation = stored(_all([failing[f].select("key", "part", F.lit(f).alias("filter"), F.lit(bit[f]).alias("bit")) for f in letters]))
    any_failing = relation.select("key")
    clean = stored(base.join(any_failing, "key", "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("clean")))

    mask = F.col("mask")
    alive = stored(base.join(any_failing, "key", "left_semi").withColumn("mask", F.lit(0)))
    for f in letters:
        alive = alive.unionByName(stored(alive.join(relation.filter(F.col("filter") == f), "key", "left_anti").withColumn("mask", mask.bitwiseOR(F.lit(bit[f])))))
    survivors = stored(alive.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("survivors")))
    still_open = F.filter(_table(list(bit.items()), ("filter", "bit")), lambda x: mask.bitwiseAND(x["bit"]) == 0)
    open_to = alive.select("key", "part", "mask", F.explode(still_open).alias("at")).select("key", "part", "mask", "at.filter")
    # these two sides grow with documents times filters; small files of them would fill the driver as a broadcast
    removed = stored(open_to.join(relation.select("filter", "key").hint("merge"), ["filter", "key"], "left_semi"))

    before = F.filter(F.sequence(F.lit(0), F.lit((1 << k) - 1)), lambda m: m.bitwiseAND(F.col("bit")) == 0)  # the sets that a filter may come after
    tried = relation.select("key", "part", "filter", F.explode(before).alias("mask"))
    cases = {"removed": removed, "redundant": tried.join(removed.hint("merge"), ["filter", "mask", "key"], "left_anti")}
    cases |= {f"{name}_lost": removed.join(keys.select("key"), "key", "left_semi") for name, keys in lost.items()}
    counts = _all([stored(x.groupBy("part", "filter", "mask").agg(F.count(F.lit(1)).alias("n"))).withColumn("what", F.lit(name)) for name, x in cases.items()])
    counts = counts.groupBy("part", "filter", "mask").pivot("what", list(cases)).agg(F.sum("n"))
    alone = stored(_alone(relation).groupBy("part", "filter").agg(F.count(F.lit(1)).alias("unique_fails")))

    parts = stored(base.select("part").distinct()).join(clean, "part", "left")
    places = [(f, m, m | bit[f], factorial(m.bit_count()) * factorial(k - 1 - m.bit_count())) for f in letters for m in range(1 << k) if not m & bit[f]]
    grid = parts.select("part", "clean", F.explode(_table(places, ("filter", "mask", "after", "orders"))).alias("at")).select("part", "clean", "at.*")
    grid = grid.join(counts, ["part", "filter", "mask"], "left").join(alone, ["part", "filter"], "left")
    after = survivors.select("part", F.col("mask").alias("after"), "survivors")
    grid = stored(grid.join(after, ["part", "after"], "left").fillna(0))
    shapley = grid.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    orders = []
    for order in permutations(letters):
        gone = 0
        for step, f in enumerate(order, 1):
            orders.append(("".join(order), step, f, gone))
            gone |= bit[f]
    steps = base.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, mask int")
    found = grid.join(F.broadcast(steps), ["filter", "mask"]).join(shapley, ["part", "filter"])  # k * k! rows, whatever the input
    numbers = [(F.col("clean") + F.col("survivors")).alias("kept"), "removed", "redundant", "unique_fails", *(f"{name}_lost" for name in lost), "shapley"]
    return found.select("part", "filter_order", "step", *numbers)


def _alone(relation: DataFrame) -> DataFrame:
    """Keys that fail a filter and no other, with that filter."""
    other = relation.select(F.col("key").alias("_key"), F.col("filter").alias("_filter"))
    return relation.join(other, (F.col("key") == F.col("_key")) & (F.col("filter") != F.col("_filter")), "left_anti")


def _table(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def text_facts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One written row per document: a key of its own, doc_id, part (null: empty), the text's digest, and which of A-D it fails.

    A: under 200 words; B: fewer than half of the words distinct; C: more than 3 % of the code points in A-Z; D: one of ``#$%&*|``.
    Words are maximal runs without white space. A null text is empty: it fails A alone of these four.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    words = plain.withColumn("words", F.array_remove(F.split("text", SPACES), ""))
    few = F.size("words") < 200
    repeated = F.lit(100) * F.size(F.array_distinct("words")) < F.lit(50) * F.size("words")
    shouting = F.lit(100) * F.regexp_count("text", F.lit("[A-Z]")) > F.lit(3) * F.char_length("text")
    facts = words.select(
        "doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), few.alias("A"), repeated.alias("B"), shouting.alias("C"), F.col("text").rlike(r"[#$%&*|]").alias("D")
    )
    return stored(facts.withColumn("key", F.monotonically_increasing_id()))


def later_copies(facts: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """(key, part) of the rows whose digest a smaller doc_id has too. A null doc_id is neither smaller nor larger than any other.

    A digest's least id is merged map-side. Groups of at least one row in ``hot_share`` are at most that many: they meet their rows by
    broadcast, so no task gets a group of a third of all rows; all other groups by a join on the digest.
    """
    groups = stored(facts.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = facts.count()
    hot = F.broadcast(groups.filter(F.col("n") * F.lit(hot_share) >= F.lit(total)))
    rows = facts.select("key", "part", "doc_id", "digest")
    some = rows.join(hot, "digest").filter("doc_id > least")
    others = rows.join(hot, "digest", "left_anti").join(groups.filter(F.col("n") * F.lit(hot_share) < F.lit(total)), "digest").filter("doc_id > least")
    return some.select("key", "part").unionByName(others.select("key", "part"))


def audit_documents(docs: DataFrame, labels: DataFrame, *, hot_share: int = HOT_SHARE, **columns) -> DataFrame:
    """The audit of five text filters over ``docs`` by part, with the losses among documents labelled good (quality 1) and toxic.

    Filters A-D see one text each (:func:`text_facts`); E fails texts that a smaller doc_id has too, table-wide, removed or not (equal
    SHA-256 digests count as equal). Every row is a document of its own, also where ids are null or repeat; a null id has no label, and
    a document counts once however many label rows it has. Null parts are the empty string. Other columns are ignored.
    """
    facts = text_facts(docs, **columns)
    failing = {f: facts.filter(f) for f in "ABCD"} | {"E": later_copies(facts, hot_share)}
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
    named = {"good": "quality = 1", "toxic": "toxic = 1"}
    lost = {name: stored(facts.select("key", "doc_id").join(ids.filter(rule).select("doc_id"), "doc_id", "left_semi").select("key")) for name, rule in named.items()}
    return filter_audit(facts, failing, lost)
