"""Declared data sets by name, and the register built from them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.inline import values_frame
from ..operators.relational import union_labelled


@dataclass(frozen=True)
class Dataset:
    name: str
    provenance: str
    grain: str
    build: Callable[[SparkSession], DataFrame]
    order_by: Sequence[str] = ()


class Catalog:
    """Named data sets; an unknown name is an error that lists the known ones."""

    def __init__(self, spark: SparkSession, datasets: Sequence[Dataset]):
        self.spark = spark
        self.datasets = {d.name: d for d in datasets}

    def frame(self, name: str) -> DataFrame:
        if name not in self.datasets:
            raise KeyError(f"unknown data set {name!r}; declared: {', '.join(sorted(self.datasets))}")
        return self.datasets[name].build(self.spark)

    def extract(self, name: str) -> DataFrame:
        """The data set in its declared order (for export)."""
        df = self.frame(name)
        order = self.datasets[name].order_by
        return df.orderBy(*order) if order else df

    def register(self, written: Mapping[str, DataFrame]) -> DataFrame:
        """(name, provenance, grain, row_count, column_count, simulated_columns) per data set.

        Every declared set must be written and every written set declared.
        """
        missing, extra = set(self.datasets) - set(written), set(written) - set(self.datasets)
        if missing or extra:
            raise ValueError(f"not written: {sorted(missing)}; not declared: {sorted(extra)}")
        counts = union_labelled({n: df.selectExpr("count(1) as row_count") for n, df in written.items()}, "name")
        info = values_frame(
            self.spark,
            [
                (
                    n, d.provenance, d.grain, len(written[n].columns),
                    ",".join(c for c in written[n].columns if c.startswith("sim_")),
                )
                for n, d in self.datasets.items()
            ],
            "name string, provenance string, grain string, column_count int, simulated_columns string",
        )
        return info.join(counts, "name")


def with_provenance(df: DataFrame, provenance: Mapping[str, str]) -> DataFrame:
    """Column metadata saying where each column's values come from."""
    out = df
    for column, origin in provenance.items():
        out = out.withMetadata(column, {"provenance": origin})
    return out


def provenance_of(df: DataFrame) -> DataFrame:
    rows = [(f.name, f.metadata.get("provenance", "UNDECLARED")) for f in df.schema.fields]
    return values_frame(df.sparkSession, rows, "column_name string, provenance string")

