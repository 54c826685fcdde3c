"""Probes over a feature matrix: dependency on forbidden columns, hidden keys, single-feature AUC."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_fold
from ..functions.inline import literal
from ..session import package_on_path, pin
from .evaluation import metrics_from_counts
from .ordering import exact_quantiles, mid_ranks

NUMERIC = ("int", "bigint", "smallint", "tinyint", "double", "float", "date", "boolean")


def _is_numeric(kind: str) -> bool:
    return kind in NUMERIC or kind.startswith("decimal")


def _as_double(column: str, kind: str) -> str:
    if kind == "date":
        return f"cast(datediff({column}, date'1970-01-01') as double)"
    if kind == "boolean":
        return f"cast(cast({column} as int) as double)"
    return f"cast({column} as double)"


def long_numbers(df: DataFrame, columns: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """(extra…, feature, value) of numeric columns, one row per feature and row."""
    kinds = dict(df.dtypes)
    items = ", ".join(f"struct({literal(c)} as feature, {_as_double(c, kinds[c])} as value)" for c in columns)
    return df.selectExpr(*extra, f"inline(array({items}))")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """Rows and distinct non-null values per column (two numbers per column on the driver).

    Values are merged per (column, value) first, so the counting is spread over the values.
    """
    items = ", ".join(f"struct({literal(c)} as feature, cast({c} as string) as value)" for c in columns)
    per = df.selectExpr(f"inline(array({items}))").groupBy("feature", "value").agg(F.expr("count(1) as n"))
    rows = per.groupBy("feature").agg(F.expr("sum(n) as n"), F.expr("count(value) as different")).collect()
    return {r["feature"]: (r["n"], r["different"]) for r in rows}


def level_sql(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, str]:
    """SQL text of each column's discrete level: quantile bins for numbers with many values, the
    value itself otherwise, and a level of its own for null.

    All columns' quantile edges come from one job.
    """
    kinds = dict(df.dtypes)
    different = distinct_counts(df, columns)
    wide = [c for c in columns if _is_numeric(kinds[c]) and different[c][1] > bins]
    edges: dict[str, list[float]] = {}
    if wide:
        q = exact_quantiles(long_numbers(df, wide), "value", [i / bins for i in range(1, bins)], ["feature"])
        for r in q.collect():  # bins x columns numbers
            edges.setdefault(r["feature"], []).append(r["quantile"])
    out = {}
    for c in columns:
        if c in edges:
            value = _as_double(c, kinds[c])
            whens = " ".join(f"when {value} <= {e!r}D then {i}" for i, e in enumerate(sorted(set(edges[c]))))
            out[c] = f"case when {c} is null then '~' else cast(case {whens} else {bins} end as string) end"
        else:
            out[c] = f"coalesce(cast({c} as string), '~')"
    return out


def pair_counts(df: DataFrame, pairs: Sequence[tuple[str, str]], held: int = 1 << 20) -> DataFrame:
    """Contingency counts of many pairs of text columns in one pass: (pair, x, f, n), pairs numbered from 0.

    Each partition numbers the levels that it meets and counts all pairs in arrays, so no row is repeated for each pair, and what
    is shuffled are cells, not rows. Of columns with very many levels the cells are handed on whenever ``held`` of them are
    held. Rows of one cell are summed at the end.
    """
    package_on_path(df.sparkSession)
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = [(columns.index(a), columns.index(b)) for a, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[dict] = [{} for _ in columns]
        cells: list[dict[int, int]] = [{} for _ in pairs]

        def out() -> Iterator[pa.RecordBatch]:
            level = [list(d) for d in names]
            for k, (i, j) in enumerate(at):
                if cells[k]:
                    key = np.fromiter(cells[k].keys(), np.int64)
                    x, f = level[i], level[j]
                    arrays = [np.full(len(key), k, np.int32), [x[v] for v in key >> 32], [f[v] for v in key & 0xFFFFFFFF], np.fromiter(cells[k].values(), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(arrays, (pa.int32(), pa.string(), pa.string(), pa.int64()))], names=["pair", "x", "f", "n"])
                cells[k].clear()

        for b in batches:
            codes = []
            for c, known in zip(b.columns, names):
                d = c.dictionary_encode()
                place = np.array([known.setdefault(v, len(known)) for v in d.dictionary.to_pylist()], np.int64)
                codes.append(place[d.indices.to_numpy(zero_copy_only=False)] if b.num_rows else np.zeros(0, np.int64))
            for k, (i, j) in enumerate(at):
                wide = len(names[j])
                if len(names[i]) * wide <= 1 << 16:
                    n = np.bincount(codes[i] * wide + codes[j])
                    cell = np.flatnonzero(n)
                    key, n = (cell // wide << 32) + cell % wide, n[cell]
                else:
                    key, n = np.unique((codes[i] << 32) + codes[j], return_counts=True)
                mine = cells[k]
                for v, m in zip(key.tolist(), n.tolist()):
                    mine[v] = mine.get(v, 0) + m
            if sum(map(len, cells)) > held:
                yield from out()
                names[:] = [{} for _ in columns]
        yield from out()

    counted = df.select(*columns).mapInArrow(run, "pair int, x string, f string, n long")
    return counted.groupBy("pair", "x", "f").agg(F.sum("n").alias("n"))


def dependency(
    df: DataFrame, features: Sequence[str], forbidden: Sequence[str], bins: int = 12, truth_bins: int = 64
) -> DataFrame:
    """(feature, forbidden, u): share of the feature's entropy the forbidden column explains.

    All pairs are counted in one pass, see :func:`pair_counts`. Date against date is skipped, row-unique
    forbidden columns too.
    """
    # several passes follow; the named columns are written once instead of being derived each time
    df = pin(df.select(*dict.fromkeys([*features, *forbidden])))
    counts = distinct_counts(df, list(forbidden))
    usable = [c for c in forbidden if counts[c][1] / max(1, counts[c][0]) < KEY_RATIO]
    kinds = dict(df.dtypes)
    fx, tx = level_sql(df, features, bins), level_sql(df, usable, truth_bins)
    pairs = [
        (a, b) for a in features for b in usable if not (kinds[a] == "date" and kinds[b] == "date")
    ]
    coded = df.selectExpr(
        *[f"{sql} as `_f_{c}`" for c, sql in fx.items()], *[f"{sql} as `_t_{c}`" for c, sql in tx.items()]
    )
    named = ", ".join(f"struct({literal(a)} as feature, {literal(b)} as forbidden)" for a, b in pairs)
    joint = pair_counts(coded, [(f"_f_{a}", f"_t_{b}") for a, b in pairs]).selectExpr(f"inline(array(array({named})[pair]))", "x", "f", "n")

    def entropy(keys: Sequence[str], name: str) -> DataFrame:
        return (
            joint.groupBy("feature", "forbidden", *keys)
            .agg(F.expr("cast(sum(n) as double) as n"))
            .groupBy("feature", "forbidden")
            .agg(F.expr(f"ln(sum(n)) - sum(n * ln(n)) / sum(n) as {name}"))
        )

    h = entropy(["x"], "hx").join(entropy(["f"], "hf"), ["feature", "forbidden"]).join(
        entropy(["x", "f"], "hxf"), ["feature", "forbidden"]
    )
    return h.selectExpr(
        "feature", "forbidden", "if(hx <= 1e-12, 0D, greatest(hx + hf - hxf, 0D) / hx) as u"
    )


KEY_RATIO = 0.9


def row_keys(df: DataFrame, columns: Sequence[str], ratio: float = KEY_RATIO) -> list[str]:
    """Columns with so many distinct values that they identify the row."""
    return [c for c, (n, d) in distinct_counts(df, columns).items() if n and d / n >= ratio]


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (rho): correlation of mid-ranks."""
    kinds = dict(df.dtypes)
    rows = df.selectExpr(f"{_as_double(a, kinds[a])} as a", f"{_as_double(b, kinds[b])} as b").where(
        "a is not null and b is not null"
    )
    ra = mid_ranks(rows, "a").selectExpr("a", "mid_rank as ra")
    rb = mid_ranks(rows, "b").selectExpr("b", "mid_rank as rb")
    return rows.join(ra, "a").join(rb, "b").agg(F.expr("corr(ra, rb) as rho"))


def identifier_findings(df: DataFrame, features: Sequence[str], key: str, threshold: float = 0.99) -> DataFrame:
    """Row-unique features that rise or fall with the surrogate key: (feature, rho)."""
    df = pin(df.select(*dict.fromkeys([key, *features])))
    kinds = dict(df.dtypes)
    found = [c for c in row_keys(df, features) if _is_numeric(kinds[c])]
    out = df.sparkSession.createDataFrame([], "feature string, rho double")
    for c in found:
        out = out.unionByName(spearman(df, c, key).selectExpr(f"{literal(c)} as feature", "rho"))
    return out.where(f"abs(rho) >= {threshold}D")


def feature_auc(
    df: DataFrame, key: str, y: str, numeric: Sequence[str], categorical: Sequence[str] = (), folds: int = 5, seed: int = 1337
) -> DataFrame:
    """(feature, auc): one-sided AUC of each feature alone, all features in one ranking job.

    Numbers rank as they are (null at the median); categories are scored by the positive rate of
    the other folds, worked out on (feature, level, fold) counts so no row is joined.
    """
    df = pin(df.select(*dict.fromkeys([key, y, *numeric, *categorical])))
    counts = None
    if numeric:
        medians = exact_quantiles(long_numbers(df, numeric), "value", [0.5], ["feature"]).selectExpr(
            "feature", "quantile as median"
        )
        per = long_numbers(df, numeric, [y]).groupBy("feature", "value").agg(
            F.expr("count(1) as n"), F.expr(f"sum(cast({y} as bigint)) as pos")
        )
        counts = per.join(medians, "feature").selectExpr("feature", "coalesce(value, median) as score", "n", "pos")
    if categorical:
        coded = encoded_counts(df, key, y, categorical, folds, seed)
        counts = coded if counts is None else counts.unionByName(coded)
    merged = counts.groupBy("feature", "score").agg(F.expr("sum(n) as n"), F.expr("sum(pos) as pos"))
    return metrics_from_counts(merged, "score", ["feature"]).selectExpr(
        "feature", "coalesce(greatest(roc_auc, 1D - roc_auc), 0.5D) as auc"
    )


def encoded_counts(
    df: DataFrame, key: str, y: str, categorical: Sequence[str], folds: int = 5, seed: int = 1337
) -> DataFrame:
    """(feature, score, n, pos) of out-of-fold target encoding."""
    items = ", ".join(f"struct({literal(c)} as feature, coalesce(cast({c} as string), '~') as level)" for c in categorical)
    per = (
        df.withColumn("_fold", hash_fold(folds, seed, key))
        .selectExpr("_fold", f"cast({y} as bigint) as _y", f"inline(array({items}))")
        .groupBy("feature", "level", "_fold")
        .agg(F.expr("count(1) as n"), F.expr("sum(_y) as pos"))
    )
    # levels of one feature meet over their folds; the whole-feature totals over folds only
    level = per.groupBy("feature", "level").agg(F.expr("sum(n) as ln"), F.expr("sum(pos) as lp"))
    fold = per.groupBy("feature", "_fold").agg(F.expr("sum(n) as fn"), F.expr("sum(pos) as fp"))
    whole = fold.groupBy("feature").agg(F.expr("sum(fn) as wn"), F.expr("sum(fp) as wp"))
    joined = per.join(level, ["feature", "level"]).join(fold, ["feature", "_fold"]).join(whole, "feature")
    return joined.selectExpr(
        "feature",
        "coalesce((lp - pos) / nullif(ln - n, 0), (wp - fp) / nullif(wn - fn, 0)) as score",
        "n",
        "pos",
    )


def null_indicator_auc(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """(feature, auc) of each feature's missingness alone; 0.5 when nothing or everything is missing."""
    items = ", ".join(f"struct({literal(c)} as feature, if({c} is null, 1D, 0D) as score)" for c in features)
    counts = df.selectExpr(f"cast({y} as bigint) as _y", f"inline(array({items}))").groupBy("feature", "score").agg(
        F.expr("count(1) as n"), F.expr("sum(_y) as pos")
    )
    return metrics_from_counts(counts, "score", ["feature"]).selectExpr(
        "feature", "coalesce(greatest(roc_auc, 1D - roc_auc), 0.5D) as auc"
    )


def label_findings(aucs: DataFrame, ceiling: float) -> DataFrame:
    """Features at or above the ceiling no honest feature can reach."""
    return aucs.where(f"auc >= {ceiling}D")
