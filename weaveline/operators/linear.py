"""Covariance sums and principal components of vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covariance(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, covariance) of a vector column; every task sends one sum of d x d products, added up in two levels."""

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, s, p = 0, None, None
        for b in batches:
            if len(b):
                x = np.stack(b[vector].to_numpy()).astype(float)
                n, s, p = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if p is None else p + x.T @ x
        if n:
            yield pd.DataFrame({"g": [TaskContext.get().partitionId() % 64], "n": [n], "s": [s.tobytes()], "p": [p.tobytes()]})

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [0], "n": [int(g["n"].sum())], "s": [sum(np.frombuffer(x) for x in g["s"]).tobytes()], "p": [sum(np.frombuffer(x) for x in g["p"]).tobytes()]})

    schema = "g int, n long, s binary, p binary"
    got = df.filter(F.col(vector).isNotNull()).select(vector).mapInPandas(products, schema).groupBy("g").applyInPandas(add, schema).groupBy(F.lit(0).alias("one")).applyInPandas(add, schema).collect()
    if not got:
        raise ValueError("no vectors")
    n, s = got[0]["n"], np.frombuffer(got[0]["s"])
    mean = s / n
    return n, mean, np.frombuffer(got[0]["p"]).reshape(len(s), len(s)) / n - np.outer(mean, mean)


def principal_axes(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, axes as rows, variances) of the first k components."""
    _, mean, cov = covariance(df, vector)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return mean, axes[:, order].T, values[order]


def explained_variance(df: DataFrame, vector: str, k: int) -> DataFrame:
    """(component, variance) of the first k principal components, rounded to 9 places."""
    _, _, values = principal_axes(df, vector, k)
    return df.sparkSession.createDataFrame([(i + 1, round(float(v), 9)) for i, v in enumerate(values)], "component int, variance double")


def project(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(key, components): each vector's coordinates on the first k axes."""
    from weaveline.functions.vectors import dot

    mean, axes, _ = principal_axes(df, vector, k)
    shift = [float(a @ mean) for a in axes]
    return df.filter(F.col(vector).isNotNull()).select(key, F.array(*[dot(F.col(vector), F.array(*[F.lit(float(v)) for v in a])) - s for a, s in zip(axes, shift)]).alias("components"))
