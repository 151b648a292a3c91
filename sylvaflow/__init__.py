"""Spark analytics for stand and cell time series: table operators on DataFrames."""

from sylvaflow.session import get_spark

__all__ = ["get_spark"]
