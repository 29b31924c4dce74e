"""Imports every query module, so that the registry is complete."""

from netsift.plans import (  # noqa: F401
    cleaning, drift, evaluate, models, monitoring, packets, prepare, profile, sampling, sources, streams,
)
from netsift.plans.registry import ORACLES, QUERIES  # noqa: F401
