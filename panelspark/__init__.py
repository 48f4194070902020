"""panelspark: Spark-native operators over long time-series panels and customer usage tables.

Every operator takes and returns ``pyspark.sql.DataFrame``; heavy work stays in Spark (windows, joins, aggregates),
Python runs only on small per-group arrays via Arrow.
"""

__version__ = "0.1.0"

# Functions of this package used inside Arrow UDFs travel with the task (pickled by value), so executors need no
# installed copy of the package.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
