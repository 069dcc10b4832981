"""seriesframe: labelled time-series analytics on plain Spark DataFrames."""

from seriesframe.config import Settings
from seriesframe.plans.request import Aggregation, QueryRequest
from seriesframe.plans.store import SeriesStore

__all__ = ["Aggregation", "SeriesStore", "QueryRequest", "Settings"]
