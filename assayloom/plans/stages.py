"""``pyspark.ml`` stages for the package's own fits, so they work inside Pipeline and
CrossValidator and are saved with the model."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayloom.functions.kernels import scaled_vector
from assayloom.operators.scale import CorrelationPrune, RobustScale
from assayloom.settings import CORRELATION_THRESHOLD


#: Vectors of up to so many positions are scaled position by position in Spark's own code; wider ones go
#: through a kernel.
NARROW = 64


def as_array(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, VectorUDT):
        return vector_to_array(F.col(column))
    return F.col(column).cast("array<double>")


def as_numbers(df: DataFrame, column: str) -> Column:
    """For kernels, which widen floats by themselves: the array as it is, or as doubles."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType):
        return F.col(column)
    return as_array(df, column)


def as_vector(df: DataFrame, column: str) -> Column:
    if isinstance(df.schema[column].dataType, VectorUDT):
        return F.col(column)
    return array_to_vector(F.col(column).cast("array<double>"))


class _InOut(HasInputCol, HasOutputCol):
    pass


class PruneModel(Model, _InOut, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the vector positions in ``kept``; the output is an ML vector."""

    kept = Param(Params._dummy(), "kept", "positions kept", TypeConverters.toListInt)
    removed = Param(Params._dummy(), "removed", "names removed", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        if not self.getOrDefault("removed"):
            return df.withColumn(self.getOutputCol(), as_vector(df, self.getInputCol()))
        made = df.withColumn("_v", as_vector(df, self.getInputCol()))
        slicer = VectorSlicer(
            inputCol="_v", outputCol=self.getOutputCol(), indices=self.getOrDefault("kept"))
        return slicer.transform(made).drop("_v")


class PruneCorrelated(Estimator, _InOut, DefaultParamsReadable, DefaultParamsWritable):
    threshold = Param(Params._dummy(), "threshold", "|r| limit", TypeConverters.toFloat)
    names = Param(Params._dummy(), "names", "feature names", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kept", names=None,
                 threshold=CORRELATION_THRESHOLD):
        super().__init__()
        self._setDefault(threshold=CORRELATION_THRESHOLD)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> PruneModel:
        source = self.getInputCol()
        train = df.select(as_array(df, source).alias("a"))
        if self.isSet("names"):
            names = self.getOrDefault("names")
        else:
            names = [f"f{i}" for i in range(len(train.first()["a"]))]
        fitted = CorrelationPrune.fit(train, "a", names, self.getOrDefault("threshold"))
        model = PruneModel()._set(
            inputCol=source, outputCol=self.getOutputCol(), kept=list(fitted.kept),
            removed=fitted.removed_names,
        )
        return model


class RobustModel(Model, _InOut, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / divisor per position; the output is an ML vector."""

    medians = Param(Params._dummy(), "medians", "medians", TypeConverters.toListFloat)
    divisors = Param(Params._dummy(), "divisors", "divisors", TypeConverters.toListFloat)

    def _transform(self, df: DataFrame) -> DataFrame:
        medians, divisors = self.getOrDefault("medians"), self.getOrDefault("divisors")
        if len(medians) > NARROW:
            scaled = scaled_vector(as_array(df, self.getInputCol()), medians, divisors)
            return df.withColumn(self.getOutputCol(), array_to_vector(scaled))
        made = df.withColumn("_a", as_array(df, self.getInputCol()))
        numbers = F.array(*[
            (F.get("_a", F.lit(i)) - F.lit(m)) / F.lit(d) for i, (m, d) in enumerate(zip(medians, divisors))])
        wrong = F.raise_error(F.lit(f"a vector of {len(medians)} numbers is wanted"))
        scaled = F.when(F.size("_a") == len(medians), numbers).when(F.col("_a").isNotNull(), wrong)
        return made.withColumn(self.getOutputCol(), array_to_vector(scaled)).drop("_a")


class ScaleRobust(Estimator, _InOut, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="scaled"):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> RobustModel:
        fitted = RobustScale.fit(df.select(as_array(df, self.getInputCol()).alias("a")), "a")
        model = RobustModel()._set(
            inputCol=self.getInputCol(), outputCol=self.getOutputCol(),
            medians=list(fitted.medians), divisors=list(fitted.divisors),
        )
        return model
