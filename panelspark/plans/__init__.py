"""Named queries over the stored tables.  Importing this package fills the registry."""

from panelspark.plans import q_anomaly, q_customer, q_explore, q_forecast, q_ml, q_models, q_series, q_stream  # noqa: F401
from panelspark.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
