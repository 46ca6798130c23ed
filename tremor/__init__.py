"""tremor — event-catalogue analytics and forecasting on Spark.

Every operator is a pure ``DataFrame -> DataFrame`` function over column
names; Catalyst plans the work, executors scan, shuffle and aggregate.
Python runs inside tasks only for the two per-series recursions
(PACF, Holt-Winters) through ``applyInPandas``.
"""

from tremor.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
