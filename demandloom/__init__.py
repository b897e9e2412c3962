"""Demand-flexibility analytics as PySpark DataFrame transformations."""

from demandloom.session import get_spark, scratch_dir

__all__ = ["get_spark", "scratch_dir"]
