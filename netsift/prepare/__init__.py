"""Feature preparation: estimators fitted on training data, models that transform any table."""

from netsift.prepare.encoding import CategoricalEncoder, CategoricalEncoderModel, TargetEncoder, TargetEncoderModel
from netsift.prepare.flow import FlowPreparation, FlowPreparationModel, PreparationConfig
from netsift.prepare.scaling import NumericScaler, NumericScalerModel, compare_strategies
from netsift.prepare.selection import (
    DropColumns, DropColumnsModel, DomainFeatures, FeatureSelector, FeatureSelectorModel, NumericGuard, ValueImputer, ValueImputerModel,
)

__all__ = [
    "CategoricalEncoder", "CategoricalEncoderModel", "TargetEncoder", "TargetEncoderModel", "FlowPreparation", "FlowPreparationModel",
    "PreparationConfig", "NumericScaler", "NumericScalerModel", "compare_strategies", "DropColumns", "DropColumnsModel", "DomainFeatures",
    "FeatureSelector", "FeatureSelectorModel", "NumericGuard", "ValueImputer", "ValueImputerModel",
]
