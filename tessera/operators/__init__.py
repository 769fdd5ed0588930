"""Operators: functions from DataFrames to a lazy DataFrame."""

from .relational import *  # noqa: F401,F403
from .semantic import *  # noqa: F401,F403
from .vision import *  # noqa: F401,F403
