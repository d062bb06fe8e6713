"""Pipelines of table stages: fit once, apply to any table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helioscope.operators.graph import cut

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Stages in order. Nothing runs before the result is used, but for taps and checkpoints."""

    stages: list[tuple[str, Stage]] = field(default_factory=list)

    def map(self, name: str, stage: Stage) -> Pipeline:
        return Pipeline([*self.stages, (name, stage)])

    def where(self, condition: Column | str) -> Pipeline:
        return self.map("where", lambda df: df.where(condition))

    def with_columns(self, **columns: Column) -> Pipeline:
        return self.map("with_columns", lambda df: df.withColumns(columns))

    def tap(self, name: str, look: Callable[[DataFrame], None]) -> Pipeline:
        """Calls look with the table and passes it on."""
        def stage(df: DataFrame) -> DataFrame:
            look(df)
            return df

        return self.map(name, stage)

    def checkpoint(self) -> Pipeline:
        return self.map("checkpoint", cut)

    def branch(self, select: Callable[[DataFrame], str], branches: dict[str, Pipeline]) -> Pipeline:
        """One of the branches, by a name that `select` gives; an unknown name is an error."""
        def stage(df: DataFrame) -> DataFrame:
            name = select(df)
            if name not in branches:
                raise KeyError(f"no branch {name}")
            return branches[name](df)

        return self.map("branch", stage)

    def parallel(self, branches: list[Pipeline], combine: Callable[[list[DataFrame]], DataFrame]) -> Pipeline:
        return self.map("parallel", lambda df: combine([b(df) for b in branches]))

    def __call__(self, df: DataFrame) -> DataFrame:
        for name, stage in self.stages:
            try:
                df = stage(df)
            except Exception as error:
                error.add_note(f"in stage {name}")
                raise
        return df


class Scaler:
    """Standardises columns by the means and deviations of the table it was fitted to: one row for any number of columns."""

    def __init__(self, columns: list[str]):
        self.columns, self.stats = columns, None

    def fit(self, df: DataFrame) -> Scaler:
        self.stats = df.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in self.columns]).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.try_divide(F.col(c) - F.lit(m), F.lit(s)) for c, (m, s) in self.stats.items()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, (m, s) in self.stats.items()})


class Imputer:
    """Nulls become the mean, the median or the most frequent value of the table it was fitted to."""

    def __init__(self, columns: list[str], by: str = "mean"):
        self.columns, self.by, self.values = columns, by, None

    def fit(self, df: DataFrame) -> Imputer:
        f = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "mode": F.mode}[self.by]
        self.values = df.agg(*[f(c).alias(c) for c in self.columns]).first().asDict()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.fillna({c: v for c, v in self.values.items() if v is not None})


class PCA:
    """Principal components from the covariance matrix, which is one aggregate of as many cells as pairs of columns."""

    def __init__(self, columns: list[str], k: int):
        self.columns, self.k = columns, k

    def fit(self, df: DataFrame) -> PCA:
        import numpy as np

        n = len(self.columns)
        cells = [F.covar_samp(a, b) for i, a in enumerate(self.columns) for b in self.columns[i:]]
        row = list(df.agg(*cells, *[F.avg(c) for c in self.columns]).first())
        cov = np.zeros((n, n))
        cov[np.triu_indices(n)] = row[: n * (n + 1) // 2]
        cov = cov + np.triu(cov, 1).T
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)[: self.k]
        self.means, self.values, self.vectors = row[-n:], values[order], vectors[:, order]
        self.vectors *= np.sign(self.vectors[np.abs(self.vectors).argmax(0), range(self.k)])
        self.ratio = self.values / values.sum()
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def project(j: int) -> Column:
            out = F.lit(0.0)
            for c, m, v in zip(self.columns, self.means, self.vectors[:, j]):
                out = out + (F.col(c) - F.lit(m)) * F.lit(float(v))
            return out

        return df.withColumns({f"pc{j + 1}": project(j) for j in range(self.k)})


def equal_frequency(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bin numbers by quantile edges; equal values share a bin."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("e")).first()["e"]
    out = F.lit(0)
    for e in edges:
        out = out + F.when(F.col(value) > F.lit(e), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), out))
