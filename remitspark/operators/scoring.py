"""A saved scoring model: preprocessor, classifier and calibrator written, read again, and applied to incomplete requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model, PipelineModel
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import modeling
from .modeling import FeatureSpec, Preprocessor
from .serving import risk_band

_STATE = (
    "numeric array<string>, boolean array<string>, categorical array<string>, medians map<string,double>, indicators array<string>, "
    "means map<string,double>, deviations map<string,double>, modes map<string,double>, owners array<string>, with_calibrator boolean"
)


@dataclass
class ScoringModel:
    """What a request meets: all of it learned on the fit rows (the calibrator on the calibration rows)."""

    preprocessor: Preprocessor
    classifier: Model
    calibrator: Model | None = None

    def save(self, folder: str) -> None:
        """Write every part below ``folder``, over what is there: state and levels as Parquet, the stages by ML persistence."""
        p, spec = self.preprocessor, self.preprocessor.spec
        spark = p.frequent.sparkSession
        row = (
            list(spec.numeric), list(spec.boolean), list(spec.categorical), dict(p.medians), list(p.indicators), {c: float(m) for c, (m, _) in p.scale.items()},
            {c: float(s) for c, (_, s) in p.scale.items()}, {c: float(v) for c, v in p.modes.items()}, list(p.owners), self.calibrator is not None,
        )
        spark.createDataFrame([row], _STATE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/state")
        p.frequent.select("feature", "level").write.mode("overwrite").parquet(f"{folder}/levels")
        p.stages.write().overwrite().save(f"{folder}/stages")
        self.classifier.write().overwrite().save(f"{folder}/classifier")
        if self.calibrator is not None:
            self.calibrator.write().overwrite().save(f"{folder}/calibrator")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> ScoringModel:
        s = spark.read.schema(_STATE).parquet(f"{folder}/state").first()  # one row
        spec = FeatureSpec(tuple(s["numeric"]), tuple(s["boolean"]), tuple(s["categorical"]))
        scale = {c: (s["means"][c], s["deviations"][c]) for c in s["means"]}
        levels = spark.read.schema("feature string, level string").parquet(f"{folder}/levels")
        prep = Preprocessor(spec, dict(s["medians"]), list(s["indicators"]), scale, dict(s["modes"]), levels, PipelineModel.load(f"{folder}/stages"), list(s["owners"]))
        kind = lambda name: DefaultParamsReader.loadParamsInstance(f"{folder}/{name}", spark)
        return ScoringModel(prep, kind("classifier"), kind("calibrator") if s["with_calibrator"] else None)

    def score(self, requests: DataFrame, request_id: str = "request_id") -> DataFrame:
        """One row per request: id, probability, risk band, what was supplied and what was imputed (names and counts).

        A request has any of the declared inputs; what it leaves out or gives as null is imputed from the fit rows, and named. A
        column that is no declared input is an error, so a misspelt name never becomes an imputed one. Unseen and rare levels
        of a category are supplied, and take the slot for such levels.
        """
        spec = self.preprocessor.spec
        unknown = sorted(set(requests.columns) - set(spec.names) - {request_id})
        if unknown:
            raise ValueError(f"not declared inputs: {unknown}")
        if request_id not in requests.columns:
            raise ValueError(f"requests have no {request_id}")
        kinds = {**dict.fromkeys(spec.numeric, "double"), **dict.fromkeys(spec.boolean, "boolean"), **dict.fromkeys(spec.categorical, "string")}
        whole = requests.select(request_id, *[(F.col(c) if c in requests.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()])
        given = ", ".join(f"if({c} is not null, '{c}', null)" for c in spec.names)
        missing = ", ".join(f"if({c} is null, '{c}', null)" for c in spec.names)
        named = whole.selectExpr("*", f"array_sort(array_compact(array({given}))) as supplied", f"array_sort(array_compact(array({missing}))) as imputed")
        raw = modeling.raw_scores(self.classifier, self.preprocessor.transform(named), "score")
        done = raw.withColumn("probability", F.col("score")) if self.calibrator is None else modeling.calibrated(self.calibrator, raw, "probability")
        return done.selectExpr(request_id, "probability", f"{risk_band('probability')} as band", "size(supplied) as supplied_count", "size(imputed) as imputed_count", "supplied", "imputed")
