"""metricslake: engineering-metrics lakehouse operators on Spark DataFrames.

Subpackages
-----------
functions  column helpers that pin down formatting, rounding and casting rules
sources    table readers/writers and the adapter views over the test tables
operators  derived benchmark aggregates and incremental ingestion operators
plans      source views and parameterized reports
streaming  Structured Streaming forms of the ingestion
"""

from metricslake.session import build_session, configure

__all__ = ["build_session", "configure"]
