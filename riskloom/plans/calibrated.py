"""One saved model: features, classifier, calibration and decision threshold as a ``PipelineModel``.

``calibrated_model`` puts what ``training.train`` returns into a single pipeline that Spark ML
saves and loads whole, so a loaded model gives the calibrated scores and decisions of the unsaved one.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import vocab as v

SCORE, DECISION = "score", "prediction_at_threshold"


class _OneColumn(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A column from another one; saved with its parameters."""

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**self._input_kwargs)


class SecondOf(_OneColumn):
    """The second entry of a vector: the probability, or the margin, of class 1."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), vector_to_array(self.getInputCol())[1])


class Share(_OneColumn):
    """A number brought into [0, 1]."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(self.getInputCol()))))


class Decision(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """1 where a score reaches the threshold."""

    threshold = Param(Params._dummy(), "threshold", "scores from here on are positive", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol: str | None = None, outputCol: str | None = None, threshold: float | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def getThreshold(self) -> float:
        return self.getOrDefault(self.threshold)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn(self.getOutputCol(), (F.col(self.getInputCol()) >= self.getThreshold()).cast("int"))


def calibrated_model(result: dict) -> PipelineModel:
    """The model, calibrator and threshold of ``training.train`` as one pipeline: adds ``score`` and the decision."""
    calibrator, stages = result["calibrator"], [result["model"]]
    if calibrator is None:
        stages.append(SecondOf(inputCol="probability", outputCol=SCORE))
    elif calibrator.method == "isotonic":
        stages += [SecondOf(inputCol="probability", outputCol="_x"), calibrator.stage, Share(inputCol="_calibrated", outputCol=SCORE)]
    else:
        stages += [SecondOf(inputCol="rawPrediction", outputCol="_x"), calibrator.stage, SecondOf(inputCol="_calibrated_probability", outputCol=SCORE)]
    stages.append(Decision(inputCol=SCORE, outputCol=DECISION, threshold=float(result["threshold"])))
    return PipelineModel(stages)


def threshold_of(model: PipelineModel) -> float:
    """The decision threshold kept in a calibrated model."""
    return next(s.getThreshold() for s in model.stages if isinstance(s, Decision))


def decided(model: PipelineModel, inputs: DataFrame) -> DataFrame:
    """Rows (ID, score, decision) from model inputs."""
    return model.transform(inputs).select(v.KEY, SCORE, DECISION)
