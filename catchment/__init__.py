"""Catchment analytics on Spark: spatial joins, catchment features, profiling,
whitespot scoring and revenue models as DataFrame operators."""
