"""Principal components of vector columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions.vectors import complete_vector
from areascope.operators.stats import sample_rows


@dataclass
class Projection:
    """Centring and rotation, with the sign of each component fixed (largest loading > 0)."""

    stages: PipelineModel

    @property
    def ratios(self) -> list[float]:
        """Share of the variance each component explains."""
        return [float(v) for v in self.stages.stages[-1].explainedVariance.toArray()]

    @property
    def signs(self) -> list[float]:
        loadings = self.stages.stages[-1].pc.toArray()
        top = loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])]
        return [-1.0 if v < 0 else 1.0 for v in top]

    @property
    def components(self) -> np.ndarray:
        """One row per component."""
        return (self.stages.stages[-1].pc.toArray() * self.signs).T

    def explained(self, df: DataFrame) -> DataFrame:
        """(component, ratio, cumulative) in the session of `df`."""
        total = np.cumsum(self.ratios)
        rows = [(i, r, float(t)) for i, (r, t) in enumerate(zip(self.ratios, total, strict=True))]
        return df.sparkSession.createDataFrame(
            rows, "component int, ratio double, cumulative double"
        )

    def save(self, path: str) -> None:
        self.stages.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Projection:
        return cls(PipelineModel.load(path))


def pca_fit(df: DataFrame, vector: str, k: int) -> Projection:
    """Fit on the complete vectors. The covariance (dims²) is summed on the executors."""
    rows = df.where(complete_vector(F.col(vector))).select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("__raw")
    )
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred")
    centring = scaler.fit(rows)
    rotation = PCA(k=k, inputCol="__centred", outputCol="__pc").fit(centring.transform(rows))
    return Projection(PipelineModel(stages=[centring, rotation]))


def pca_fit_sample(
    df: DataFrame, vector: str, key: str, k: int, frac: float = 0.05, seed: int = 42
) -> Projection:
    """Fit on a seeded sample of max(20·k, 5 %) complete vectors, as for pixel maps."""
    rows = df.where(complete_vector(F.col(vector)))
    return pca_fit(sample_rows(rows, key, 20 * k, frac, seed), vector, k)


def pca_apply(df: DataFrame, vector: str, projection: Projection, out: str = "pc") -> DataFrame:
    """Add the component scores; an incomplete vector gets null."""
    ok = complete_vector(F.col(vector))
    dims = int(projection.stages.stages[0].mean.size)
    zeros = F.array_repeat(F.lit(0.0), dims)
    raw = array_to_vector(F.when(ok, F.col(vector).cast("array<double>")).otherwise(zeros))
    scored = projection.stages.transform(df.withColumn("__raw", raw))
    signs = F.array(*[F.lit(s) for s in projection.signs])
    flipped = F.zip_with(vector_to_array("__pc"), signs, lambda a, s: a * s)
    return scored.withColumn(out, F.when(ok, flipped)).drop("__raw", "__centred", "__pc")
