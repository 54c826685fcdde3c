"""Delimited files: all-text scans, typed staging with reject counts, extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.inline import literal, values_frame
from .schema_rules import SQL_TYPES, column_plan, parse_sql, text_schema

ENCODING = "ISO-8859-1"


def header_of(spark: SparkSession, path: str, delimiter: str = "|") -> list[str]:
    """Column names of a delimited file (reads the header line only)."""
    return spark.read.csv(path, sep=delimiter, header=True, encoding=ENCODING, inferSchema=False).columns


def scan_text(
    spark: SparkSession, path: str, delimiter: str = "|", columns: Sequence[str] | None = None
) -> DataFrame:
    """All columns as text; only the empty string is null, so codes keep zeros and signs."""
    names = list(columns) if columns else header_of(spark, path, delimiter)
    return spark.read.csv(
        path, sep=delimiter, header=True, encoding=ENCODING, schema=text_schema(names), nullValue="",
        emptyValue="", quote='"',
    )


def typed(df: DataFrame, plan: Mapping[str, str] | None = None) -> DataFrame:
    """Text columns cast by their kind; unparseable text becomes null."""
    plan = plan or column_plan(df.columns)
    return df.selectExpr(*[f"{parse_sql(c, plan[c])} as `{c}`" for c in df.columns])


def reject_measures(plan: Mapping[str, str]) -> dict[str, str]:
    """SQL aggregates: present values that did not parse, per non-text column."""
    return {c: f"count_if(`{c}` is not null and {parse_sql(c, k)} is null)" for c, k in plan.items() if k != "string"}


def reject_report(df: DataFrame, plan: Mapping[str, str] | None = None) -> DataFrame:
    """(column_name, kind, present, rejected) of a text frame, one scan."""
    plan = plan or column_plan(df.columns)
    names = [c for c in df.columns if plan[c] != "string"]
    rejected = reject_measures(plan)
    row = df.agg(*[F.expr(f"struct(count(`{c}`) as present, {rejected[c]} as rejected) as `{c}`") for c in names])
    kinds = ", ".join(f"{literal(c)}, {literal(plan[c])}" for c in names)
    return row.unpivot([], names, "column_name", "v").selectExpr(
        "column_name", f"map({kinds})[column_name] as kind", "v.present as present", "v.rejected as rejected"
    )


def stage_file(spark: SparkSession, source: str, target: str, delimiter: str = "|") -> dict:
    """Typed Parquet of one delimited file; rows in must equal rows written.

    Rows and rejects are counted while the file is written, so the text is parsed once.
    """
    raw = scan_text(spark, source, delimiter)
    plan = column_plan(raw.columns)
    seen = Observation("stage")
    measures = {"rows_in": "count(1)", **{f"reject_{c}": sql for c, sql in reject_measures(plan).items()}}
    observed = raw.observe(seen, *[F.expr(f"{sql} as `{n}`") for n, sql in measures.items()])
    typed(observed, plan).write.mode("overwrite").parquet(target)
    figures = seen.get
    written = spark.read.parquet(target).count()
    if written != figures["rows_in"]:
        raise ValueError(f"{source}: {figures['rows_in']} rows read but {written} written")
    return {
        "rows_in": figures["rows_in"],
        "rows_out": written,
        "rejects": {n.removeprefix("reject_"): v for n, v in figures.items() if n.startswith("reject_") and v},
        "types": {c: SQL_TYPES[k] for c, k in plan.items()},
    }


def scan_directory(
    spark: SparkSession, path: str, renames: Mapping[str, str], required: Sequence[str] = (), delimiter: str = ","
) -> DataFrame:
    """A directory of CSV files with chosen columns renamed and rows without required values left out."""
    raw = spark.read.csv(path, sep=delimiter, header=True, encoding=ENCODING, inferSchema=False)
    missing = [c for c in renames if c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: columns not found: {missing}")
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in renames.items()]).dropna(subset=list(required) or None, how="any" if required else "all")


def extract_rows(spark: SparkSession, source: str, target: str, column: str, value: str, delimiter: str = ",") -> dict:
    """Keep rows whose column equals a value (trimmed, any case); returns scanned and kept counts.

    The file is read once in splits; both counts come from the same pass.
    """
    raw = spark.read.csv(source, sep=delimiter, header=True, encoding=ENCODING, inferSchema=False)
    if column not in raw.columns:
        raise ValueError(f"{source}: no column {column}")
    keep = f"upper(trim(`{column}`)) = {literal(value.strip().upper())}"
    seen = Observation("extract")
    raw.observe(seen, F.expr("count(1) as scanned"), F.expr(f"count_if({keep}) as kept")).where(keep).write.mode(
        "overwrite"
    ).csv(target, header=True, sep=delimiter)
    return dict(seen.get)


def extract_columns(spark: SparkSession, source: str, target: str, keep: Sequence[str], delimiter: str = ",") -> None:
    """Only the named columns of a wide CSV; a missing one is an error."""
    raw = spark.read.csv(source, sep=delimiter, header=True, encoding=ENCODING, inferSchema=False)
    missing = [c for c in keep if c not in raw.columns]
    if missing:
        raise ValueError(f"{source}: columns not found: {missing}")
    raw.select(*[F.col(f"`{c}`") for c in keep]).write.mode("overwrite").csv(target, header=True, sep=delimiter)


def file_manifest(spark: SparkSession, paths: Sequence[str], vintage: str = "") -> DataFrame:
    """(name, bytes, sha256, data_rows, vintage) per file. Hashing reads each file whole: for files < 2 GB."""
    binary = spark.read.format("binaryFile").load(list(paths)).selectExpr(
        "element_at(split(path, '/'), -1) as name", "length as bytes", "sha2(content, 256) as sha256"
    )
    lines = (
        spark.read.text(list(paths))
        .selectExpr("element_at(split(_metadata.file_path, '/'), -1) as name")
        .groupBy("name")
        .agg(F.expr("count(1) - 1 as data_rows"))
    )
    return binary.join(lines, "name", "left").selectExpr(
        "name", "bytes", "sha256", "coalesce(data_rows, 0) as data_rows", f"{literal(vintage)} as vintage"
    )


def empty_frame(spark: SparkSession, schema: str) -> DataFrame:
    return values_frame(spark, [], schema)
