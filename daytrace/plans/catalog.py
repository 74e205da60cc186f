"""Imports every plan module, so that the registry holds all queries."""

from daytrace.plans import activity, audit, files, logaudit, pending, recaps, scalars, sessions, streams, texts  # noqa: F401
from daytrace.plans.registry import ORACLES, QUERIES  # noqa: F401
