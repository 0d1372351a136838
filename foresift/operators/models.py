"""Model interface: `fit(train)` returns a fitted model, `transform(df)` adds the quantile array `q`."""
from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.functions.scores import LEVELS
from foresift.operators import baselines as B
from foresift.operators.emos import emos_predict, fit_emos


class NotFitted(RuntimeError):
    pass


class Postprocessor(ABC):
    def __init__(self, levels=LEVELS):
        self.levels = tuple(levels)

    @abstractmethod
    def fit(self, train: DataFrame) -> "Postprocessor": ...

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...


class Fitted(Postprocessor):
    """Base of models with a parameter table."""

    def __init__(self, levels=LEVELS):
        super().__init__(levels)
        self._model: DataFrame | None = None

    @property
    def model(self) -> DataFrame:
        if self._model is None:
            raise NotFitted("call fit() before transform()")
        return self._model


class Climatology(Fitted):
    def fit(self, train):
        self._model = B.climatology(train, self.levels)
        return self

    def transform(self, df):
        return B.apply_constant(df, self.model)


class RawEnsemble(Postprocessor):
    """Passes through ensemble quantiles computed with the instance (column `raw_q`)."""

    def fit(self, train):
        return self

    def transform(self, df):
        return df.withColumn("q", F.col("raw_q"))


class Persistence(Postprocessor):
    """Repeats column `last_obs`."""

    def fit(self, train):
        return self

    def transform(self, df):
        return df.withColumn("q", F.array_repeat("last_obs", len(self.levels)))


class Emos(Fitted):
    """One fit per key group (none: pooled); with `predictors` of two columns the second is the last observation."""

    def __init__(self, levels=LEVELS, keys=(), predictors=("ens_mean",), min_rows: int = 1):
        super().__init__(levels)
        self.keys, self.predictors, self.min_rows = list(keys), tuple(predictors), min_rows

    def fit(self, train):
        self._model = fit_emos(train, self.keys, self.predictors, min_rows=self.min_rows)
        return self

    def transform(self, df):
        return emos_predict(df, self.model, self.keys, self.predictors, levels=self.levels)


class VarianceInflation(Fitted):
    """Fitted multiplier, or a fixed one, or one chosen for a training coverage."""

    def __init__(self, levels=LEVELS, multiplier: float | None = None):
        super().__init__(levels)
        self.multiplier = multiplier

    @classmethod
    def for_coverage(cls, train: DataFrame, target: float, levels=LEVELS) -> "VarianceInflation":
        self = cls(levels)
        self._model = B.coverage_inflation(train, target)
        self.multiplier = float("nan")      # later fits leave the chosen multiplier alone
        return self

    def fit(self, train):
        if self.multiplier is None:
            self._model = B.fit_inflation(train)
        elif self._model is None:
            self._model = B.fixed_inflation(train, self.multiplier)
        return self

    def transform(self, df):
        if self._model is None and self.multiplier is not None:
            self._model = B.fixed_inflation(df, self.multiplier)
        return B.inflation_predict(df, self.model, levels=self.levels)
