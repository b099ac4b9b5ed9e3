"""Imports every module that registers queries."""

from turnloom.plans import feature_queries  # noqa: F401
from turnloom.plans import cleaning_queries  # noqa: F401
from turnloom.plans import data_queries  # noqa: F401
from turnloom.plans import model_queries  # noqa: F401
from turnloom.plans import learning_queries  # noqa: F401
from turnloom.plans import file_queries  # noqa: F401
