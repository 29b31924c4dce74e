"""Dropping, imputing, selecting and capping columns."""

from __future__ import annotations

from pyspark.ml import Estimator, Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import functions as F

from netsift.functions.cleaning import to_number
from netsift.functions.scaling import correlations, quantiles
from netsift.operators.packets import domain_features
from netsift.operators.profile import column_facts, information_probs, mutual_information, numeric_columns, text_columns
from netsift.prepare.base import StateModel, feature_columns


class DomainFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """duration, packet_rate and byte_ratio."""

    def _transform(self, df):
        return domain_features(df)


class NumericGuard(StateModel):
    """The listed features as finite doubles, anything else 0; other columns are left alone."""

    def _transform(self, df):
        features = set(self.fitted["features"])
        return df.select(*[to_number(F.col(f"`{c}`"), 0).alias(c) if c in features else F.col(f"`{c}`") for c in df.columns])


class DropColumns(Estimator):
    """Configured drops plus columns that are mostly missing or constant in the training data."""

    def __init__(self, missing_threshold: float = 0.20, drop: list[str] = (), passthrough: list[str] = ()):
        super().__init__()
        self.missing_threshold, self.drop, self.passthrough = missing_threshold, list(drop), list(passthrough)

    def _fit(self, df):
        x = df.select(*feature_columns(df, self.passthrough))
        facts = column_facts(x).collect()
        missing = sorted(r["column_name"] for r in facts if r["missing_ratio"] > self.missing_threshold)
        constant = sorted(r["column_name"] for r in facts if r["constant"])
        drops = sorted({"srcip", "dstip", *self.drop, *missing, *constant} - set(self.passthrough))
        return DropColumnsModel(missing=missing, constant=constant, drop=drops)


class DropColumnsModel(StateModel):
    def _transform(self, df):
        return df.drop(*self.fitted["drop"])


class ValueImputer(Estimator):
    """Median for numbers, most frequent value (smallest on ties) for text, '' when all are missing."""

    def __init__(self, passthrough: list[str] = (), exact: bool = True):
        super().__init__()
        self.passthrough, self.exact = list(passthrough), exact

    def _fit(self, df):
        x = df.select(*feature_columns(df, self.passthrough))
        medians = {c: q[0] for c, q in quantiles(x, numeric_columns(x), [0.5], exact=self.exact).items() if q[0] is not None}
        text = text_columns(x)
        modes = {c: "" for c in text}
        if text:
            counts = x.select(*text).unpivot([], text, "c", "v").where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
            best = counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"))
            modes.update({r["c"]: r["v"] for r in best.collect()})
        return ValueImputerModel(numeric=medians, text=modes)


class ValueImputerModel(StateModel):
    def _transform(self, df):
        fill = {**self.fitted["numeric"], **self.fitted["text"]}
        out = []
        for c, t in df.dtypes:
            if c in self.fitted["numeric"] and t in ("bigint", "int") and not float(fill[c]).is_integer():
                out.append(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fill[c])).alias(c))
            else:
                out.append(F.coalesce(F.col(f"`{c}`"), F.lit(fill[c]).cast(t)).alias(c) if c in fill else F.col(f"`{c}`"))
        return df.select(*out)


def correlated_to_remove(pairs: list[tuple[str, str]], variance: dict[str, float], protected: set[str]) -> list[str]:
    """Which member of each correlated pair goes: never a protected one, else the one that varies less.
    `pairs` are (row, column) in column order; a tie removes the column."""
    gone: list[str] = []
    for row, col in pairs:
        if col in protected:
            victim = row
        elif row in protected:
            victim = col
        else:
            victim = row if variance[col] > variance[row] else col
        if victim not in gone:
            gone.append(victim)
    return gone


class FeatureSelector(Estimator):
    """Removes correlated and uninformative numbers and learns percentile caps for the rest."""

    def __init__(self, label: str | None = None, correlation_threshold: float = 0.95, mi_threshold: float = 0.01, lower_pct: float = 1.0,
                 upper_pct: float = 99.0, protected: list[str] = (), drop: list[str] = (), passthrough: list[str] = (), exact: bool = True):
        super().__init__()
        self.label, self.correlation_threshold, self.mi_threshold = label, correlation_threshold, mi_threshold
        self.lower_pct, self.upper_pct, self.protected = lower_pct, upper_pct, list(protected)
        self.drop, self.passthrough, self.exact = list(drop), list(passthrough), exact

    def _fit(self, df):
        keep = [c for c in feature_columns(df, [*self.passthrough, *([self.label] if self.label else [])]) if c not in self.drop]
        numeric = [c for c in keep if c in set(numeric_columns(df))]
        x = df.select(*numeric, *([F.col(self.label).alias("_y")] if self.label else []))
        gone: list[str] = []
        if len(numeric) > 1:
            high = correlations(x, numeric).where((F.col("i") < F.col("j")) & (F.abs("correlation") > self.correlation_threshold))
            pairs = sorted((r["j"], r["i"], r["feature_1"], r["feature_2"]) for r in high.collect())
            var = x.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in numeric]).first().asDict()
            gone = correlated_to_remove([(a, b) for _, _, a, b in pairs], {c: v or 0.0 for c, v in var.items()}, set(self.protected))
        # one quantile pass serves the information bins and the caps
        info, ends = information_probs(), [self.lower_pct / 100.0, self.upper_pct / 100.0]
        probs = sorted({*info, *ends}) if self.label else ends
        q = quantiles(x, numeric, probs, exact=self.exact)
        pick = lambda wanted: {c: [v[probs.index(p)] for p in wanted] for c, v in q.items()}
        scores = {}
        if self.label and numeric:
            scores = {r["feature"]: r["mi"] for r in mutual_information(x, numeric, "_y", known=pick(info)).collect()}
        low = sorted(c for c, s in scores.items() if s < self.mi_threshold and c not in self.protected)
        caps = pick(ends)
        return FeatureSelectorModel(drop=[c for c in self.drop if c in df.columns], correlated=gone, low_mi=low, scores=scores,
                                    caps={c: q for c, q in caps.items() if q[0] is not None}, mi_threshold=self.mi_threshold)


class FeatureSelectorModel(StateModel):
    def removed(self) -> list[str]:
        s = self.fitted
        return sorted({*s["drop"], *s["correlated"], *s["low_mi"]})

    def _transform(self, df):
        caps = self.fitted["caps"]
        df = df.drop(*self.removed())
        return df.select(*[
            F.when(F.col(f"`{c}`").isNotNull(), F.least(F.greatest(F.col(f"`{c}`").cast("double"), F.lit(caps[c][0])), F.lit(caps[c][1]))).alias(c)
            if c in caps else F.col(f"`{c}`") for c in df.columns])

    def importance_report(self, spark):
        """Rank, feature, score and removal flag from the fitted scores."""
        s = self.fitted
        if not s["scores"]:
            raise RuntimeError("no information scores: fit with a label")
        rows = sorted(s["scores"].items(), key=lambda kv: (-kv[1], kv[0]))
        return spark.createDataFrame([(i + 1, c, v, v < s["mi_threshold"]) for i, (c, v) in enumerate(rows)],
                                     "rank int, feature string, mi_score double, will_remove boolean")
