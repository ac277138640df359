"""Species-occurrence monitoring insights as Spark DataFrames."""

from taxatrend.params import Params, Window

__all__ = ["Params", "Window"]
