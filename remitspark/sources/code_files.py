"""Code-list files: whitespace-split, fixed-width with continuation records, tab with a preamble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inline import literal
from ..operators.relational import keep_first

ENCODING = "ISO-8859-1"
# One letter (not D) and four digits.
HCPCS_PATTERN = "^[A-CE-Z][0-9]{4}$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) in file order: the block start orders the splits, the row id the lines."""
    return spark.read.option("encoding", ENCODING).text(path).selectExpr(
        "struct(_metadata.file_path as f, _metadata.file_block_start as s, monotonically_increasing_id() as i) as line_no",
        "value",
    )


def split_codes(spark: SparkSession, path: str, code: str = "code", text: str = "long_desc") -> DataFrame:
    """`code<whitespace>description` lines; the first description of a code is kept."""
    lines = numbered_lines(spark, path).selectExpr(
        "line_no",
        r"regexp_extract(value, '^\\s*(\\S+)\\s+(.*\\S)\\s*$', 1) as c",
        r"regexp_extract(value, '^\\s*(\\S+)\\s+(.*\\S)\\s*$', 2) as t",
    ).where("c <> ''")
    return keep_first(lines, ["c"], ["line_no"]).selectExpr(f"c as {code}", f"t as {text}")


def fixed_width_codes(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width records: code 1-5, long text 12-91, short text 92-119.

    A code's long text may run over several records; they are joined in file order. The short text
    is that of the first record.
    """
    records = (
        numbered_lines(spark, path)
        .selectExpr(
            "line_no", "trim(substring(value, 1, 5)) as code", "rtrim(substring(value, 12, 80)) as piece",
            "trim(substring(value, 92, 28)) as short",
        )
        .where(f"code rlike {literal(HCPCS_PATTERN)}")
    )
    grouped = records.groupBy("code").agg(
        F.expr(
            "trim(array_join(transform(filter(array_sort(collect_list(struct(line_no, piece))), r -> r.piece <> ''), "
            "r -> r.piece), ' ')) as long_desc"
        ),
        F.expr("min_by(short, line_no) as short_desc"),
    )
    return grouped.selectExpr("code as hcpcs_code", "nullif(long_desc, '') as long_desc", "nullif(short_desc, '') as short_desc")


def tab_codes(spark: SparkSession, path: str, key: str = "drg_cd", width: int = 3) -> DataFrame:
    """Tab file with title lines before the header: rows with a digits-only first field.

    Fields: 0 code (zero-padded), 3 category, 4 type, 5 title (quoted).
    """
    raw = spark.read.csv(path, sep="\t", quote='"', header=False, encoding=ENCODING, schema="a string, b string, c string, mdc string, kind string, title string")
    rows = raw.selectExpr("monotonically_increasing_id() as line_no", "trim(a) as a", "mdc", "kind", "title").where(
        r"a rlike '^[0-9]+$'"
    )
    padded = f"if(length(a) >= {width}, a, lpad(a, {width}, '0'))"
    shaped = rows.selectExpr(
        "line_no", f"{padded} as {key}", "coalesce(trim(title), '') as title", "nullif(trim(mdc), '') as mdc",
        "nullif(trim(kind), '') as drg_type",
    )
    return keep_first(shaped, [key], ["line_no"]).drop("line_no")
