"""relmine — response-reliability mining on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark
built-in expressions, aggregates, joins and windows; nothing is collected to
the driver except the few split decisions of the shallow risk tree.
"""

from relmine.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
