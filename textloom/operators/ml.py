"""The text classifier as a Spark ML estimator and model, for pipelines."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasTol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import fixed
from textloom.operators.classifier import TextClassifier, fit_classifier
from textloom.operators.solver import TOLERANCE
from textloom.session import materialize

_KEY = "_row_key"


class _TextParams(HasLabelCol, HasPredictionCol, HasProbabilityCol):
    textCol = Param(Params._dummy(), "textCol", "column of texts", TypeConverters.toString)

    def getTextCol(self) -> str:
        return self.getOrDefault(self.textCol)


def _keyed(dataset: DataFrame) -> DataFrame:
    """Rows with a key of their own, written: a second evaluation would draw other keys."""
    return materialize(dataset.withColumn(_KEY, F.monotonically_increasing_id()), "keyed")


class TextClassification(Estimator, _TextParams, HasMaxIter, HasTol, DefaultParamsWritable, DefaultParamsReadable):
    """Fits ``classifier.fit_classifier`` to ``textCol`` and ``labelCol`` (a string)."""

    @keyword_only
    def __init__(self, *, textCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=fixed.MAX_ITERATIONS, tol=TOLERANCE):
        super().__init__()
        self._setDefault(textCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability", maxIter=fixed.MAX_ITERATIONS, tol=TOLERANCE)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> TextClassificationModel:
        rows = dataset.select(F.col(self.getTextCol()).alias("text"), F.col(self.getLabelCol()).cast("string").alias("label"))
        fitted = fit_classifier(_keyed(rows), _KEY, max_iter=self.getMaxIter(), tolerance=self.getTol())
        return self._copyValues(TextClassificationModel(fitted))


class TextClassificationModel(Model, _TextParams, MLWritable, MLReadable):
    """Adds the probabilities of all labels as a vector, and the index of the best one as a double; the
    metadata of both name the labels."""

    def __init__(self, classifier: TextClassifier | None = None):
        super().__init__()
        self._setDefault(textCol="text", labelCol="label", predictionCol="prediction", probabilityCol="probability")
        self.classifier = classifier

    @property
    def labels(self) -> tuple[str, ...]:
        return self.classifier.labels

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, best = self.getProbabilityCol(), self.getPredictionCol()
        keyed = _keyed(dataset.drop(out, best))
        scored = self.classifier.probabilities(keyed.select(_KEY, F.col(self.getTextCol()).alias("_text")), _KEY, "_text")
        shares = keyed.join(scored.select(_KEY, "probabilities"), _KEY).drop(_KEY)
        names = list(self.labels)
        place = F.array_position("probabilities", F.array_max("probabilities")) - 1
        vector = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": x} for i, x in enumerate(names)]}, "num_attrs": len(names)}}
        nominal = {"ml_attr": {"type": "nominal", "name": best, "vals": names}}
        return shares.select(
            *[c for c in shares.columns if c != "probabilities"],
            array_to_vector("probabilities").alias(out, metadata=vector),
            place.cast("double").alias(best, metadata=nominal),
        )

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: TextClassificationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.classifier.save(f"{path}/classifier")


class _ModelReader(MLReader):
    def load(self, path: str) -> TextClassificationModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TextClassificationModel(TextClassifier.load(SparkSession.active(), f"{path}/classifier"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
