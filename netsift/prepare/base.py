"""A fitted stage whose state is one JSON parameter, so Spark ML can save and load it."""

from __future__ import annotations

import json

from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable


class StateModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted values as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, **values):
        super().__init__()
        if values:
            self._set(state=json.dumps(values))

    @property
    def fitted(self) -> dict:
        if not self.isSet(self.state):
            raise RuntimeError(f"{type(self).__name__} must be fitted before use")
        return json.loads(self.getOrDefault(self.state))


def feature_columns(df, passthrough) -> list[str]:
    return [c for c in df.columns if c not in set(passthrough)]
