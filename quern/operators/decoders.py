"""Scorers with weights that array functions can't express: numpy makes the query's vector, the dot product stays in Spark."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.scoring import dot, sigmoid


@dataclass
class Norm:
    """A batch normalisation at inference: (x - mean) / sqrt(var + eps) * gain + shift."""

    mean: np.ndarray
    var: np.ndarray
    gain: np.ndarray
    shift: np.ndarray
    eps: float = 1e-5

    def __call__(self, x: np.ndarray, axis: int = -1) -> np.ndarray:
        form = [1] * x.ndim
        form[axis] = -1
        m, v, g, s = (np.reshape(a, form) for a in (self.mean, self.var, self.gain, self.shift))
        return (x - m) / np.sqrt(v + self.eps) * g + s


@dataclass
class ConvE:
    """Head and relation as stacked images, convolved, projected back: filters [n, 3, 3], dense [n * rows * columns, d]."""

    height: int
    filters: np.ndarray
    filter_bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    norms: tuple[Norm | None, Norm | None, Norm | None] = (None, None, None)

    def vectors(self, h: np.ndarray, r: np.ndarray) -> np.ndarray:
        image = np.concatenate([h.reshape(len(h), self.height, -1), r.reshape(len(r), self.height, -1)], 1)
        if self.norms[0]:
            image = self.norms[0](image[:, None], 1)[:, 0]
        windows = np.lib.stride_tricks.sliding_window_view(image, self.filters.shape[1:], (1, 2))
        x = np.einsum("bijxy,nxy->bnij", windows, self.filters) + self.filter_bias[:, None, None]
        if self.norms[1]:
            x = self.norms[1](x, 1)
        x = np.maximum(x, 0).reshape(len(h), -1) @ self.dense + self.dense_bias
        if self.norms[2]:
            x = self.norms[2](x)
        return np.maximum(x, 0)


@dataclass
class TuckER:
    """Head times the core [relation, head, tail] contracted with the relation."""

    core: np.ndarray
    norms: tuple[Norm | None, Norm | None] = (None, None)

    def vectors(self, h: np.ndarray, r: np.ndarray) -> np.ndarray:
        if self.norms[0]:
            h = self.norms[0](h)
        x = np.einsum("bh,br,rht->bt", h, r, self.core)
        return self.norms[1](x) if self.norms[1] else x


def query_vectors(queries: DataFrame, model: ConvE | TuckER, h: str = "h", r: str = "r") -> DataFrame:
    """Adds vec, the query's vector, to rows with arrays h and r. The weights are broadcast once."""
    shared = queries.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def vec(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        return pd.Series(list(shared.value.vectors(np.stack(a.to_list()), np.stack(b.to_list()))))

    return queries.withColumn("vec", vec(h, r))


def answer(vec: Column, t: Column, bias: Column | float = 0.0) -> Column:
    return sigmoid(dot(vec, t) + bias)
