"""Scaling of numeric columns: standard, min-max, robust, power, quantile."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from netsift.functions.scaling import quantiles
from netsift.operators.profile import numeric_columns
from netsift.prepare.base import StateModel

STRATEGIES = ("standard", "minmax", "robust", "power", "quantile", "none")
AFFINE = ("standard", "minmax", "robust")


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-10 else (F.pow(x + 1.0, F.lit(lam)) - 1.0) / lam
    down = -F.log1p(-x) if abs(lam - 2.0) < 1e-10 else -(F.pow(1.0 - x, F.lit(2.0 - lam)) - 1.0) / (2.0 - lam)
    return F.when(x >= 0, up).otherwise(down)


def inverse_yeo_johnson(y: Column, lam: float) -> Column:
    up = F.exp(y) - 1.0 if abs(lam) < 1e-10 else F.pow(y * lam + 1.0, F.lit(1.0 / lam)) - 1.0
    down = 1.0 - F.exp(-y) if abs(lam - 2.0) < 1e-10 else 1.0 - F.pow(1.0 - (2.0 - lam) * y, F.lit(1.0 / (2.0 - lam)))
    return F.when(y >= 0, up).otherwise(down)


def fit_lambdas(df: DataFrame, columns: list[str], rounds: int = 8, points: int = 13) -> dict[str, float]:
    """Maximum-likelihood Yeo-Johnson exponents of all columns together: every round scores a grid of
    exponents for every column in one aggregate and narrows around the best."""
    span = {c: (-3.0, 5.0) for c in columns}
    for _ in range(rounds):
        grid = {c: [float(v) for v in np.linspace(*span[c], points)] for c in columns}
        row = df.agg(*[
            F.struct(F.count(_x(c)).alias("n"), F.sum(F.signum(_x(c)) * F.log1p(F.abs(_x(c)))).alias("j"),
                     *[F.var_pop(yeo_johnson(_x(c), lam)).alias(f"v{k}") for k, lam in enumerate(grid[c])]).alias(f"s{i}")
            for i, c in enumerate(columns)]).first()
        for i, c in enumerate(columns):
            s = row[f"s{i}"]
            score = [(-s["n"] / 2.0 * np.log(s[f"v{k}"]) + (lam - 1.0) * s["j"]) if s[f"v{k}"] and np.isfinite(s[f"v{k}"]) else -np.inf
                     for k, lam in enumerate(grid[c])]
            best, step = int(np.argmax(score)), (span[c][1] - span[c][0]) / (points - 1)
            span[c] = (grid[c][best] - step, grid[c][best] + step)
    return {c: (lo + hi) / 2.0 for c, (lo, hi) in span.items()}


class NumericScaler(Estimator):
    def __init__(self, strategy: str = "robust", columns: list[str] | None = None, skip: list[str] = (), output: str = "uniform",
                 n_quantiles: int = 1000, exact: bool = True):
        super().__init__()
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown scaling strategy: {strategy}")
        self.strategy, self.columns, self.skip, self.output, self.n_quantiles, self.exact = strategy, columns, list(skip), output, n_quantiles, exact

    def _fit(self, df):
        cols = [] if self.strategy == "none" else [
            c for c in (self.columns if self.columns is not None else numeric_columns(df)) if c not in self.skip]
        params = getattr(self, f"_fit_{self.strategy}")(df, cols) if cols else {}
        return NumericScalerModel(strategy=self.strategy, columns=cols, params=params, output=self.output)

    @staticmethod
    def _one_row(df, cols, **stats):
        row = df.agg(*[F.struct(*[fn(_x(c)).alias(k) for k, fn in stats.items()]).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return {c: row[f"s{i}"] for i, c in enumerate(cols)}

    def _fit_standard(self, df, cols):
        r = self._one_row(df, cols, mean=F.avg, var=F.var_pop)
        return {c: {"center": s["mean"], "scale": s["var"] ** 0.5 or 1.0, "mean": s["mean"], "var": s["var"]} for c, s in r.items()}

    def _fit_minmax(self, df, cols):
        r = self._one_row(df, cols, lo=F.min, hi=F.max)
        return {c: {"center": s["lo"], "scale": (s["hi"] - s["lo"]) or 1.0, "data_min": s["lo"], "data_max": s["hi"], "data_range": s["hi"] - s["lo"]}
                for c, s in r.items()}

    def _fit_robust(self, df, cols):
        q = quantiles(df.select(*[_x(c).alias(c) for c in cols]), cols, [0.25, 0.5, 0.75], exact=self.exact)
        return {c: {"center": m, "scale": (b - a) or 1.0} for c, (a, m, b) in q.items()}

    def _fit_power(self, df, cols):
        lam = fit_lambdas(df, cols)
        row = df.agg(*[F.struct(F.avg(yeo_johnson(_x(c), lam[c])).alias("m"), F.stddev_pop(yeo_johnson(_x(c), lam[c])).alias("s")).alias(f"s{i}")
                       for i, c in enumerate(cols)]).first()
        return {c: {"lambda": lam[c], "center": row[f"s{i}"]["m"], "scale": row[f"s{i}"]["s"] or 1.0} for i, c in enumerate(cols)}

    def _fit_quantile(self, df, cols):
        n = min(self.n_quantiles, df.count())
        probs = [float(p) for p in np.linspace(0, 1, max(n, 2))]
        q = quantiles(df.select(*[_x(c).alias(c) for c in cols]), cols, probs, exact=self.exact)
        return {c: {"quantiles": [float(v) for v in np.maximum.accumulate(v)]} for c, v in q.items()}


class NumericScalerModel(StateModel):
    """Columns missing from the table are simply not scaled: every column is its own expression."""

    def _forward(self, c: str, p: dict) -> Column:
        s = self.fitted
        if s["strategy"] in AFFINE:
            return (_x(c) - F.lit(p["center"])) / F.lit(p["scale"])
        if s["strategy"] == "power":
            return (yeo_johnson(_x(c), p["lambda"]) - F.lit(p["center"])) / F.lit(p["scale"])
        return _quantile_udf(p["quantiles"], s["output"])(_x(c))

    def _backward(self, c: str, p: dict) -> Column:
        s = self.fitted
        if s["strategy"] in AFFINE:
            return _x(c) * F.lit(p["scale"]) + F.lit(p["center"])
        if s["strategy"] == "power":
            return inverse_yeo_johnson(_x(c) * F.lit(p["scale"]) + F.lit(p["center"]), p["lambda"])
        return _inverse_quantile_udf(p["quantiles"], s["output"])(_x(c))

    def _map(self, df, fn):
        p = self.fitted["params"]
        return df.select(*[fn(c, p[c]).alias(c) if c in p else F.col(f"`{c}`") for c in df.columns])

    def _transform(self, df):
        return self._map(df, self._forward)

    def inverse_transform(self, df):
        """Back to the original scale; left alone unless every scaled column is present."""
        if not set(self.fitted["params"]) <= set(df.columns):
            return df
        return self._map(df, self._backward)

    def report(self, spark) -> DataFrame:
        s = self.fitted
        keys = ["center", "scale", "mean", "var", "data_min", "data_max", "data_range", "lambda"]
        rows = [(c, s["strategy"], *[float(p[k]) if p.get(k) is not None else None for k in keys]) for c, p in s["params"].items()]
        return spark.createDataFrame(rows, "column_name string, strategy string, " + ", ".join(f"`{k}` double" for k in keys))


def _quantile_udf(refs: list[float], output: str):
    q, grid = np.array(refs), np.linspace(0, 1, len(refs))

    @F.pandas_udf(DoubleType())
    def scale(x: pd.Series) -> pd.Series:
        # the mean of both one-sided interpolations puts repeated values in the middle of their range
        u = 0.5 * (np.interp(x, q, grid) - np.interp(-x, -q[::-1], -grid[::-1]))
        u = np.where(x.isna(), np.nan, u)
        if output == "normal":
            inv = NormalDist().inv_cdf
            u = np.array([inv(min(max(v, 1e-7), 1 - 1e-7)) if v == v else v for v in u])
        return pd.Series(u)

    return scale


def _inverse_quantile_udf(refs: list[float], output: str):
    q, grid = np.array(refs), np.linspace(0, 1, len(refs))

    @F.pandas_udf(DoubleType())
    def unscale(u: pd.Series) -> pd.Series:
        if output == "normal":
            u = pd.Series([NormalDist().cdf(v) if v == v else v for v in u])
        return pd.Series(np.interp(u, grid, q))

    return unscale


def compare_strategies(df: DataFrame, column: str) -> DataFrame:
    """Shape of one column under each strategy: mean, std, min, max, median, skewness, kurtosis."""
    names = {"Original": None, "StandardScaler": "standard", "MinMaxScaler": "minmax", "RobustScaler": "robust", "PowerTransformer": "power"}
    x = df.select(_x(column).alias(column))
    exprs = {}
    for name, strategy in names.items():
        model = NumericScaler(strategy, [column]).fit(x) if strategy else None
        exprs[name] = model._forward(column, model.fitted["params"][column]) if model else _x(column)
    wide = x.select(*[e.alias(n) for n, e in exprs.items()])
    med = quantiles(wide, list(names), [0.5])
    n = F.col("n")
    row = wide.agg(*[F.struct(
        F.lit(c).alias("strategy"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.lit(med[c][0]).alias("median"), F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2"), F.count(c).alias("n")).alias(f"s{i}") for i, c in enumerate(names)])
    t = row.select(F.inline(F.array(*[f"s{i}" for i in range(len(names))])))
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6)
    return t.select("strategy", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median")],
                    F.round(skew, 4).alias("skewness"), F.round(kurt, 4).alias("kurtosis"))
